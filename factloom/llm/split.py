"""Splitting oversized texts at natural boundaries, with a stated overlap.

The least number of pieces is computed and equal-length targets are placed; each target is moved to the strongest boundary
nearby, or, where there is none, to the strongest one that leaves the other pieces room; what a piece's ends change of its
tokens is encoded again, and while a piece is over the limit the text is cut anew into one piece more. The boundaries of a text are found once, all together.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import bpe
from factloom.llm.encode import chunks
from factloom.runtime import ship, ship_file, shipped

LIMIT = 1024
OVERLAP = 64
#: A target moves by at most this share of a piece.
REACH = 0.15
#: A word of more tokens than this (or an eighth of the limit) may be cut inside, between slices of SLICE characters (or a 32nd).
LONG_WORD = 64
SLICE = 32

#: Strengths, strongest first.
KINDS = ("paragraph", "line", "sentence", "clause", "space", "none")
NONE = KINDS.index("none")
_space = regex.compile(r"\s")


def _marks(chars: str) -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[ord(c) for c in chars]] = True
    return out


#: Whether a code point is white space (none is beyond U+3000), or one of the fixed values given.
_SPACES = _marks("".join(chr(c) for c in range(0x3001) if _space.match(chr(c))))
_BREAKS = _marks("\n\r\x0b\x0c\x85\u2028\u2029")
_STOPS, _CLOSERS, _WIDE_STOPS, _PAUSES, _WIDE_PAUSES = map(_marks, (".!?…。！？", "\"'”’»)]", "。！？", ",;:，；：、", "，；、"))


def strengths(text: str, at: np.ndarray) -> np.ndarray:
    """Strength of a cut before text[p] for each p of `at`, as an index of KINDS.

    White space on either side of a cut counts as before it, but line breaks only if they are; a cut inside of a line break is none.
    """
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n, place = len(code), np.arange(len(code))
    space, closes = _SPACES[code], _CLOSERS[code]
    # where the white space before a place begins, and the last character before a place that closes no bracket or quote
    begins = np.append(0, np.maximum.accumulate(np.where(space, -1, place)) + 1)
    inner = np.append(-1, np.maximum.accumulate(np.where(closes, -1, place)))
    ends_line = _BREAKS[code]
    ends_line[:-1] &= (code[:-1] != 13) | (code[1:] != 10)
    breaks = np.append(0, np.cumsum(ends_line))
    begin = begins[at]
    gap = (begin < at) | np.append(space, False)[at]
    lines = breaks[at] - breaks[begin]
    last = code[np.maximum(begin - 1, 0)] if n else code
    stop = code[np.maximum(inner[begin], 0)]
    sentence = (gap & (inner[begin] >= 0) & _STOPS[stop]) | _WIDE_STOPS[last]
    clause = (gap & _PAUSES[last]) | _WIDE_PAUSES[last]
    return np.select([lines >= 2, lines == 1, sentence, clause, gap], [0, 1, 2, 3, 4], 5)


def boundary(text: str, at: int) -> int:
    """Strength of one cut."""
    return int(strengths(text, np.array([at]))[0])


def _joined(w: str, c: int) -> bool:
    """Whether a cut before w[c] would tear a character apart."""
    return bool(unicodedata.combining(w[c])) or w[c] in "\u200d\ufe0f" or w[c - 1] == "\u200d"


def _slices(w: str, size: int) -> list[int]:
    """Where to cut a long word: every `size` characters, a little later where a character would be torn apart."""
    cuts, at = [], size
    while at < len(w):
        near = next((c for c in range(at, min(at + size, len(w))) if not _joined(w, c)), at)
        cuts.append(near)
        at = near + size
    return cuts


def _units(words: list[str], n: np.ndarray, model: bpe.Bpe, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends in characters and token counts of what may be cut apart: words, and slices of long words."""
    most = min(LONG_WORD, limit // 8)
    if not (n > most).any():
        return np.cumsum([len(w) for w in words]), n
    ends, counts, at = [], [], 0
    for w, k in zip(words, n):
        if k <= most:
            ends.append(at + len(w))
            counts.append(k)
        else:
            cuts = _slices(w, max(1, min(SLICE, limit // 32)))
            parts = [w[a:b] for a, b in zip([0, *cuts], [*cuts, len(w)])]
            ends += [at + c for c in (*cuts, len(w))]
            counts += model.counts(parts).tolist()
        at += len(w)
    return np.array(ends), np.array(counts)


def pieces(text: str, words: list[str], n: np.ndarray, model: bpe.Bpe, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int, str]]:
    """(start, end, tokens, tokens shared with the piece before, kind of the boundary at the end) of each piece, in characters."""
    ends, counts = _units(words, n, model, limit)
    words_of = [text[a:b] for a, b in zip([0, *ends], ends)] if len(ends) > len(words) else words
    total = np.cumsum(counts)
    size, m = int(total[-1]), len(ends)
    before = np.append(0, total)  # tokens before unit u
    where = np.append(0, ends)
    strength = strengths(text, where[:-1])
    count = max(2, -(-(size - overlap) // (limit - overlap)))

    def strongest(lo: int, hi: int, target: float) -> int:
        own = strength[lo : hi + 1]
        near = lo + np.flatnonzero(own == own.min())
        return int(near[np.argmin(np.abs(before[near] - target))])

    word_ends = np.append(0, np.cumsum([len(w) for w in words]))
    at_word = np.minimum(np.searchsorted(word_ends, where), len(words))
    whole, exact = word_ends[at_word] == where, np.append(0, np.cumsum(n))[at_word]

    def tokens_of(spans: list[tuple[int, int]]) -> np.ndarray:
        """Tokens of unit ranges. Between ends of words only white space at the end of a range is cut into other words than in the text."""
        out, again = np.zeros(len(spans), np.int64), []
        for k, (a, b) in enumerate(spans):
            c = b
            while c > a and words_of[c - 1].isspace():
                c -= 1
            if not (whole[a] and whole[b] and c > a):
                again.append((k, text[where[a] : where[b]]))
            else:
                out[k] = exact[c] - exact[a]
                if c < b:
                    again.append((k, text[where[c] : where[b]]))
        if again:
            np.add.at(out, [k for k, _ in again], model.counts([t for _, t in again]))
        return out

    while True:
        step = (size - overlap) / count
        reach = REACH * (step + overlap)
        cuts: list[int] = []
        for k in range(1, count):
            target = k * step + overlap
            last = cuts[-1] if cuts else 0
            lo, hi = np.searchsorted(total, [target - reach, target + reach])
            lo, hi = max(int(lo) + 1, last + 1), min(int(hi) + 1, m - 1)
            if lo <= hi:
                cut = strongest(lo, hi, target)
            else:
                cut = min(max(int(np.searchsorted(total, target)), last + 1), m - 1)
            if strength[cut] == NONE:  # anywhere that leaves the pieces on both sides room
                least, most = size - (count - k) * (limit - overlap) - overlap, before[last] + limit - (overlap if last else 0)
                lo, hi = max(int(np.searchsorted(before, least)), last + 1), min(int(np.searchsorted(before, most, "right")) - 1, m - 1)
                if lo <= hi and strength[lo : hi + 1].min() < NONE:
                    cut = strongest(lo, hi, target)
            cuts.append(cut)
        cuts = sorted({c for c in cuts if 0 < c < m})
        starts = [0]
        for c, former in zip(cuts, [0, *cuts]):
            u = int(np.searchsorted(total, before[c] - overlap)) + 1  # the first unit whose piece shares at most `overlap` tokens
            if u and before[u] < before[c] - overlap:
                u += 1
            starts.append(min(max(u, former + 1), c))
        # what slices of words share is encoded anew, so it may come out longer than their sum
        for k, c in enumerate(cuts, 1):
            while starts[k] < c and tokens_of([(starts[k], c)])[0] > overlap:
                starts[k] += 1
        if count > m:  # every unit is a piece, which leaves no room for an overlap
            starts = [0, *cuts]
        spans = list(zip(starts, [*cuts, m]))
        tokens = tokens_of(spans)
        if (tokens <= limit).all():
            shared = tokens_of(list(zip(starts[1:], cuts)))
            kinds = [*(KINDS[strength[c]] for c in cuts), "end"]
            return [(int(where[a]), int(where[b]), int(t), int(v), k) for (a, b), t, v, k in zip(spans, tokens, [0, *shared], kinds)]
        if count > m:
            raise ValueError(f"a single character has more than {limit} tokens")
        count += 1


def split(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, path: str | None = None, with_text: bool = True) -> DataFrame:
    """(key, piece, n_pieces, start, stop, n_tokens, n_shared, boundary[, text]) of each text of more than `limit` tokens.

    start and stop count code points; n_shared is the number of tokens that a piece shares with the piece before, at most
    `overlap`, in whole words (of words longer than the overlap none, or slices). No piece has more than `limit` tokens.
    Texts within the limit, null texts and empty texts give no rows. Rows come out as often as they go in. A limit below four
    tokens, which one character may have, or not above the overlap is refused.
    """
    if limit < 4 or not 0 <= overlap < limit:
        raise ValueError("the limit must be at least 4 and above the overlap")
    file = ship_file(df.sparkSession, path or bpe.default_path())
    ship(df.sparkSession)
    names = ["key", "piece", "n_pieces", "start", "stop", "n_tokens", "n_shared", "boundary", *(["text"] if with_text else [])]

    def run(batches):
        model = bpe.load(shipped(file))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks([len(t or "") for t in texts]):
                cut, _, n, per = model.words(texts[a:b])
                first = np.append(0, np.cumsum(per))
                rows, of = [], []
                for k, words in enumerate(cut):
                    own = n[first[k] : first[k + 1]]
                    if own.sum() > limit:
                        got = pieces(texts[a + k], words, own, model, limit, overlap)
                        of += [a + k] * len(got)
                        rows += [(j, len(got), *p, *([texts[a + k][p[0] : p[1]]] if with_text else [])) for j, p in enumerate(got)]
                if rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *(pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]))], names)

    kind = df.schema[key].dataType.simpleString()
    # a token has at least one byte, so no shorter text can be over the limit; it never reaches Python
    rows = df.filter(F.octet_length(df[text]) > limit).select(df[key].alias("key"), df[text].alias("text"))
    out = rows.mapInArrow(run, f"key {kind}, piece int, n_pieces int, start long, stop long, n_tokens int, n_shared int, boundary string" + (", text string" if with_text else ""))
    return out.withColumnRenamed("key", key)
