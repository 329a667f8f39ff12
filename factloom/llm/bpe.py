"""Byte-level BPE by batched numpy merge rounds.

Texts are cut into words by the tokenizer's pattern. The words of a batch that are not known yet lie in one flat array of
symbols. Each round looks up every neighbouring pair by binary search over the sorted pair keys, takes each word's
lowest rank and merges all its occurrences in that word, left to right; words without a pair left leave the array.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

#: Fixed value: how the public byte-level tokenizers cut text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words kept per worker process; beyond it the memory is cleared and filled anew.
KNOWN_WORDS = 300_000
#: Only shorter words are kept.
KNOWN_LENGTH = 64

#: Longer words (in bytes) are merged one pair at a time from a heap, to the same ids: a word has about as many rounds as it has
#: different pairs, so that rounds take the square of its length (64 KB of random letters: 20 s in rounds, 0.2 s from the heap).
HEAP_BYTES = 4096

NEVER = np.int64(1) << 40


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in the vocabulary file: printable Latin-1 for itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Bpe:
    """ids(texts): the token ids of each text, without special tokens; [] for empty and null."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, pairs = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        letters = _byte_letters()
        self.first = np.full(256, -1, np.int64)
        for letter, b in letters.items():
            if letter in vocab:
                self.first[b] = vocab[letter]
        self.size = max(vocab.values()) + 1
        left, right, made = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs)))
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        # of a pair listed twice the first counts
        self.keys, where = np.unique(keys[order], return_index=True)
        self.rank, self.made = order[where].astype(np.int64), made[order][where]
        self.pairs: dict[int, tuple[int, int]] | None = None
        self.find = regex.compile(PATTERN).findall
        self._forget()

    def _forget(self):
        self.known: dict[str, int] = {}
        self.store = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)

    def _merge_one(self, coded: bytes) -> list[int]:
        """Token ids of one long word: neighbouring pairs by rank, then from the left."""
        sym = self.first[np.frombuffer(coded, np.uint8)]
        if self.pairs is None:
            self.pairs = dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.made.tolist())))
        pairs, size, n = self.pairs, self.size, len(sym)
        s: list = sym.tolist()
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(p[0], k, s[k], s[k + 1]) for k in range(n - 1) if (p := pairs.get(s[k] * size + s[k + 1]))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k]
            if s[k] != a or j < 0 or s[j] != b:  # one of the two has been merged since
                continue
            s[k], s[j] = pairs[a * size + b][1], None
            after[k] = i = after[j]
            if i >= 0:
                before[i] = k
                if p := pairs.get(s[k] * size + s[i]):
                    heapq.heappush(heap, (p[0], k, s[k], s[i]))
            if (h := before[k]) >= 0 and (p := pairs.get(s[h] * size + s[k])):
                heapq.heappush(heap, (p[0], h, s[h], s[k]))
        return [x for x in s if x is not None]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in one array, and each word's number of them."""
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        long = [k for k, c in enumerate(coded) if len(c) > HEAP_BYTES]
        if not long:
            return self._rounds(coded)
        alone = {k: self._merge_one(coded[k]) for k in long}
        ids, n = self._rounds([b"" if k in alone else c for k, c in enumerate(coded)])
        parts = np.split(ids, np.cumsum(n)[:-1])
        for k, own in alone.items():
            parts[k], n[k] = np.array(own, np.int32), len(own)
        return np.concatenate(parts).astype(np.int32), n

    def _rounds(self, coded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words at once, a round merging the lowest pair of each."""
        n = len(coded)
        counts = np.fromiter(map(len, coded), np.int64, n)
        sym = self.first[np.frombuffer(b"".join(coded), np.uint8)]
        word = np.repeat(np.arange(n), counts)
        done_sym, done_word = [], []
        while len(sym):
            key = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            pair = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank = np.append(np.where(pair, self.rank[at], NEVER), NEVER)
            begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(begins, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, begins), size)
            take = (rank == least) & (rank < NEVER)
            # of overlapping occurrences in a run (as in aaaa) every second one counts, from the left
            i = np.flatnonzero(take)
            if len(i):
                run = np.maximum.accumulate(np.where(np.diff(i, prepend=-2) != 1, np.arange(len(i)), 0))
                i = i[(np.arange(len(i)) - run) % 2 == 0]
                sym[i] = self.made[at[i]]
                keep = np.ones(len(sym), bool)
                keep[i + 1] = False
            else:
                keep = np.ones(len(sym), bool)
            ended = least == NEVER
            if ended.any():
                done_sym.append(sym[ended])
                done_word.append(word[ended])
                keep &= ~ended
            sym, word = sym[keep], word[keep]
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        return sym[np.argsort(word, kind="stable")].astype(np.int32), np.bincount(word, minlength=n)

    def words(self, texts: list[str | None]) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
        """Each text's words; and of all words in order: token ids in one array, number of ids, and words per text."""
        if len(self.known) > KNOWN_WORDS:
            self._forget()
        cut = [self.find(t) if t else [] for t in texts]
        flat = [w for ws in cut for w in ws]
        new = sorted({w for w in flat if w not in self.known}, key=len)
        store, starts, lengths, at_word = self.store, self.starts, self.lengths, self.known
        if new:
            ids, n = self.merge(new)
            kept = sum(len(w) <= KNOWN_LENGTH for w in new)
            base = len(starts)
            store, starts, lengths = np.append(store, ids), np.append(starts, len(store) + np.cumsum(n) - n), np.append(lengths, n)
            self.known.update(zip(new[:kept], range(base, base + kept)))
            if kept < len(new):  # long words are known for this batch only
                at_word = self.known | dict(zip(new[kept:], range(base + kept, base + len(new))))
            self.store, self.starts, self.lengths = store[: len(self.store) + int(n[:kept].sum())], starts[: base + kept], lengths[: base + kept]
        at = np.fromiter(map(at_word.__getitem__, flat), np.int64, len(flat))
        n = lengths[at] if len(flat) else np.zeros(0, np.int64)
        total = int(n.sum())
        ids = store[np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(total)] if total else np.zeros(0, np.int32)
        return cut, ids, n, np.fromiter(map(len, cut), np.int64, len(cut))

    def ids(self, texts: list[str | None]) -> pa.ListArray:
        _, ids, n, per_text = self.words(texts)
        ends = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(per_text))]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))

    def counts(self, texts: list[str | None]) -> np.ndarray:
        _, _, n, per_text = self.words(texts)
        ends = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(per_text))]
        return np.diff(ends)


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """One tokenizer per worker process and file."""
    return Bpe(path)
