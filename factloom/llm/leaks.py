"""Evaluation texts leaking into a corpus: winnowed word k-grams joined, hits extended to whole shared spans.

A text's fingerprints are the smallest k-gram hash of every window of w = span - k + 1 k-grams. Two texts that share `span`
successive words share a whole window, so they share its smallest hash: every such span is met by at least one hit. Of a hit
only the part of the document between its first and last place is kept, so a pair is one row of fixed size however often a
text repeats itself. That part, longer by the item on either side, is read through the item's suffix automaton, which extends all
its hits at once on the words themselves in linear time; an accidental hash match reports nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.encode import chunks
from factloom.runtime import Scratch, broadcast_if_small, ship

GRAM = 5
SPAN = 12
#: A worker's memory of word hashes is cleared at this size.
KNOWN_WORDS = 500_000
#: Suffix automata that a worker keeps.
AUTOMATA = 2_000

_word = regex.compile(r"[\p{L}\p{N}]+").findall
_known: dict[str, int] = {}


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, without case."""
    return [w.casefold() for w in _word(text)] if text else []


def _hash(w: str) -> int:
    h = _known.get(w)
    if h is None:
        h = _known[w] = xxhash.xxh3_64_intdigest(w.casefold())
    return h


def fingerprints(text: str | None, gram: int = GRAM, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions in words), of each window the rightmost smallest; nothing for texts of fewer than `span` words."""
    ws = _word(text) if text else []
    if len(ws) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    if len(_known) > KNOWN_WORDS:
        _known.clear()
    h = np.fromiter(map(_hash, ws), np.uint64, len(ws))
    n = len(h) - gram + 1
    g = np.zeros(n, np.uint64)
    for k in range(gram):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    w = span - gram + 1
    windows = np.lib.stride_tricks.sliding_window_view(g, w)[:, ::-1]
    at = np.unique(np.arange(len(windows)) + (w - 1 - windows.argmin(axis=1)))
    return g[at].view(np.int64), at.astype(np.int32)


def _prints(df: DataFrame, key: str, text: str, gram: int, span: int) -> DataFrame:
    """(k, version, print, lo, hi): each text's different fingerprints with their first and last place in words. Texts of one key are told apart by version."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in chunks([len(t) for t in texts]):
                n, parts = [], []
                for t in texts[a:b]:
                    h, at = fingerprints(t, gram, span)
                    order = np.argsort(h, kind="stable")
                    h, at = h[order], at[order]
                    begin = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else order
                    n.append(len(begin))
                    parts.append((h[begin], at[begin], at[np.append(begin[1:], len(h)) - 1] if len(h) else at))
                rows = pa.array(np.repeat(np.arange(a, b), n))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(np.concatenate(c)) for c in zip(*parts))], ["k", "version", "print", "lo", "hi"])

    kind = df.schema[key].dataType.simpleString()
    # fewer than `span` words need fewer than 2 * span - 1 characters; such rows never reach Python
    rows = df.filter(df[key].isNotNull() & (F.length(df[text]) >= 2 * span - 1)).select(df[key].alias("k"), F.xxhash64(df[text]).alias("version"), df[text].alias("text"))
    return rows.mapInArrow(run, f"k {kind}, version long, print long, lo int, hi int")


class Automaton:
    """The suffix automaton of an item's words: `longest` finds the longest span that a list of words shares with it."""

    def __init__(self, ws: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        last = 0
        for k, w in enumerate(ws):
            new = self._state({}, self.length[last] + 1, k)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            else:
                q = self.next[p][w]
                if self.length[q] == self.length[p] + 1:
                    self.link[new] = q
                else:
                    twin = self._state(dict(self.next[q]), self.length[p] + 1, self.first[q])
                    self.link[twin] = self.link[q]
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = twin
                        p = self.link[p]
                    self.link[q] = self.link[new] = twin
            last = new

    def _state(self, after: dict[str, int], length: int, first: int) -> int:
        self.next.append(after)
        self.link.append(0)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def longest(self, ws: list[str]) -> tuple[int, int, int]:
        """(words, start in ws, start in the item) of the longest shared span, of equal ones the first in ws, and its first place in the item."""
        best, state, n = (0, 0, 0), 0, 0
        for k, w in enumerate(ws):
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            to = self.next[state].get(w)
            if to is not None:
                state, n = to, n + 1
                if n > best[0]:
                    best = (n, k - n + 1, self.first[state] - n + 1)
        return best


def _extend(span: int):
    def run(batches):
        items: dict[str, tuple[int, Automaton]] = {}
        for batch in batches:
            out, last_text, doc = [], None, []
            for key, text, item, item_text, lo, hi in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if text != last_text:
                    last_text, doc = text, words(text)
                if item_text not in items:
                    if len(items) > AUTOMATA:
                        items.clear()
                    ws = words(item_text)
                    items[item_text] = len(ws), Automaton(ws)
                size, automaton = items[item_text]
                begin = max(0, lo - size)
                n, d, i = automaton.longest(doc[begin : hi + size])
                if n >= span:
                    out.append((key, item, begin + d, i, n))
            if out:
                kinds = [batch.schema.field(0).type, batch.schema.field(2).type, pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["key", "item", "doc_word", "item_word", "n_words"])

    return run


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", gram: int = GRAM, span: int = SPAN) -> DataFrame:
    """(doc_key, item_key, doc_word, item_word, n_words): each pair sharing at least `span` successive words, with its longest span.

    Words are runs of letters and digits; case and everything between words do not matter. Of spans of equal length the first in
    the document counts. Null, empty and short texts share nothing; rows without a key are left out; repeated rows count once,
    and of several texts of one key the one with the longest span.
    """
    s = Scratch(docs.sparkSession, "leaks")
    ship(docs.sparkSession)
    theirs = _prints(items, item_key, text, gram, span).select(F.col("k").alias("item"), F.col("version").alias("item_version"), "print").distinct()
    theirs = broadcast_if_small(s.write(theirs, "item-prints"))
    hits = _prints(docs, doc_key, text, gram, span).withColumnsRenamed({"k": "doc", "version": "doc_version"}).join(theirs, "print")
    pairs = s.write(hits.groupBy("doc", "doc_version", "item", "item_version").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "hits")
    version = lambda df, key, name: df.filter(df[key].isNotNull() & df[text].isNotNull()).select(df[key].alias(name), F.xxhash64(df[text]).alias(f"{name}_version"), df[text].alias(f"{name}_text"))
    met = pairs.select("item", "item_version").distinct()
    few = version(items, item_key, "item").join(broadcast_if_small(met), ["item", "item_version"], "left_semi").dropDuplicates(["item", "item_version"])
    few = broadcast_if_small(s.write(few, "item-texts"))
    both = pairs.join(version(docs, doc_key, "doc"), ["doc", "doc_version"]).join(few, ["item", "item_version"]).select("doc", "doc_text", "item", "item_text", "lo", "hi")
    d, i = docs.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    found = both.mapInArrow(_extend(span), f"key {d}, item {i}, doc_word long, item_word long, n_words long")
    longest = found.groupBy("key", "item").agg(F.max(F.struct("n_words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))).alias("m"))
    return longest.select(F.col("key").alias(doc_key), F.col("item").alias(item_key), (-F.col("m.d")).alias("doc_word"), (-F.col("m.i")).alias("item_word"), F.col("m.n_words").alias("n_words"))
