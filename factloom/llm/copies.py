"""Duplicates hidden by formatting: recursive radix partitioning on canonical bytes, counted in a trie per bucket.

1. Every task folds its rows into a bounded table: the first record of a form stands for the others (its leader). However
   often one form occurs, at most a few leaders per task are shuffled, and the links of records to leaders never meet in one place.
2. Leaders are bucketed by the first bytes of their form. Buckets over the size limit are split by further bytes until each
   fits, or until all of a bucket's forms have ended, which the folding has made small.
3. Each bucket is read into a trie whose terminal counters hold the copies and the smallest id.
"""

from __future__ import annotations

import os
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.runtime import Scratch, broadcast_if_small, ship

#: Bytes by which a bucket is split further, and leaders a bucket may hold.
STEP = 2
BUCKET = 20_000
#: Rows, and their bytes, that a task folds together.
TABLE = 100_000
TABLE_BYTES = 64 << 20
#: Bytes of a form per trie level.
STRIDE = 8


def letters_digits(c: Column) -> Column:
    """Only letters and digits, without case; null stays null."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def canonical_properties(c: Column) -> Column:
    """Keys and values of a JSON object of strings in one order; text that is no object counts as text; null stays null."""
    entries = F.map_entries(F.from_json(c, "map<string,string>"))
    parts = F.transform(entries, lambda e: F.concat(letters_digits(e["key"]), F.lit("="), F.coalesce(letters_digits(e["value"]), F.lit("~"))))
    return F.coalesce(F.concat(F.lit("{"), F.array_join(F.array_sort(parts), ",")), F.concat(F.lit("!"), letters_digits(c)))


def canonical_form(df: DataFrame) -> Column:
    """Bytes that are equal for records alike in graph_name and confidence exactly, and in name, type and properties but for formatting."""
    fields = [letters_digits(df["name"]), letters_digits(df["entity_type"]), canonical_properties(df["properties"]), df["graph_name"], df["confidence"].cast("string")]
    # a null differs from every text; lengths keep fields apart
    return F.encode(F.concat_ws("|", *(F.coalesce(F.concat(F.lit("'"), f, F.lit("'"), F.length(f).cast("string")), F.lit("0")) for f in fields)), "UTF-8")


def _fold(batches):
    """(form, id, leader, n): of every TABLE rows of a task the first record of a form with its number of copies; of others only the link."""

    def folded(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows).combine_chunks()
        form, ids = t.column(0).combine_chunks(), t.column(1).to_numpy()
        coded = form.dictionary_encode()
        code = coded.indices.to_numpy()
        first = np.full(len(coded.dictionary), len(code), np.int64)
        np.minimum.at(first, code, np.arange(len(code)))
        leader = ids[first]
        yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(leader), pa.array(leader), pa.array(np.bincount(code, minlength=len(first)))], ["form", "id", "leader", "n"])
        copy = first[code] != np.arange(len(code))
        if copy.any():
            k = int(copy.sum())
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.binary()), pa.array(ids[copy]), pa.array(leader[code[copy]]), pa.nulls(k, pa.int64())], ["form", "id", "leader", "n"])

    rows, n, size = [], 0, 0
    for batch in batches:
        rows.append(batch)
        n, size = n + batch.num_rows, size + batch.nbytes
        if n >= TABLE or size >= TABLE_BYTES:
            yield from folded(rows)
            rows, n, size = [], 0, 0
    if n:
        yield from folded(rows)


class Trie:
    """Forms by STRIDE bytes a level; a form's end holds the place of its counters: copies and smallest id."""

    def __init__(self):
        self.root: dict = {}
        self.n: list[int] = []
        self.least: list[int] = []

    def add(self, form: bytes, n: int, least: int) -> int:
        """Adds copies of a form; the place of its counters."""
        node = self.root
        for k in range(0, len(form), STRIDE):
            node = node.setdefault(form[k : k + STRIDE], {})
        at = node.setdefault(b"", len(self.n))
        if at == len(self.n):
            self.n.append(n)
            self.least.append(least)
        else:
            self.n[at] += n
            self.least[at] = min(self.least[at], least)
        return at


def _count(batches):
    """(leader, first, n) of (bucket, form, leader, n, least) rows sorted by bucket: one trie at a time, each different form of a batch added once."""
    trie, held, bucket = Trie(), [], None

    def flush():
        nonlocal trie, held
        if held:
            leader, at = (np.concatenate(c) for c in zip(*held))
            yield pa.RecordBatch.from_arrays([pa.array(leader), pa.array(np.array(trie.least, np.int64)[at]), pa.array(np.array(trie.n, np.int64)[at])], ["leader", "first", "n"])
        trie, held = Trie(), []

    def add(part: pa.RecordBatch):
        coded = part.column(1).dictionary_encode()
        code = coded.indices.to_numpy()
        n = np.bincount(code, part.column(3).to_numpy(), len(coded.dictionary)).astype(np.int64)
        least = np.full(len(n), np.iinfo(np.int64).max)
        np.minimum.at(least, code, part.column(4).to_numpy())
        places = np.array([trie.add(*x) for x in zip(coded.dictionary.to_pylist(), n.tolist(), least.tolist())], np.int64)
        held.append((part.column(2).to_numpy(), places[code]))

    for batch in batches:
        last = batch.column(0)[batch.num_rows - 1] if batch.num_rows else None
        if last is None:
            continue
        begins = pc.index(batch.column(0), last).as_py()  # all buckets before the batch's last one are complete
        if begins:
            add(batch.slice(0, begins))
        if begins or last != bucket:
            yield from flush()
        add(batch.slice(begins))
        bucket = last
    yield from flush()


def _reach(batches):
    """(bucket, reach): bytes that the forms of an oversized bucket share, as the smallest and the largest share them, and STEP more."""
    for b in batches:
        reach = [len(os.path.commonprefix([lo, hi])) + STEP for lo, hi in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(reach, pa.int32())], ["bucket", "reach"])


def buckets(leaders: DataFrame, scratch: Scratch) -> DataFrame:
    """`leaders` with `bucket`, a prefix of `form` that at most BUCKET leaders share, or all of the form.

    Bytes that a whole bucket shares are skipped, so every round splits each bucket it touches; only those are written again.
    """
    active, parts = leaders.withColumn("bucket", F.substring("form", 1, STEP)), []
    while True:
        sizes = active.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("form").alias("lo"), F.max("form").alias("hi"))
        over = scratch.write(sizes.filter((F.col("size") > BUCKET) & (F.col("lo") != F.col("hi"))).select("bucket", "lo", "hi").mapInArrow(_reach, "bucket binary, reach int"), "oversized")
        if over.isEmpty():
            return reduce(DataFrame.unionByName, [*parts, active])
        o = broadcast_if_small(over)
        parts.append(active.join(o, "bucket", "left_anti"))
        split = active.join(o, "bucket").withColumn("bucket", F.substr("form", F.lit(1), F.col("reach"))).drop("reach")
        active = scratch.write(split.select(*leaders.columns, "bucket"), "split")


class Copies:
    """Copies among bulk records (record_id, graph_name, name, entity_type, properties, confidence).

    Copies have equal graph_name and confidence, and name, entity_type and properties that agree if only letters and digits
    count and case does not; keys may stand in any order. Null equals only null, so {} and null differ. Rows without a
    record_id are left out. An empty table has no copies.
    """

    def __init__(self, df: DataFrame, key: str = "record_id"):
        self.df, self.key = df, key
        s = self.scratch = Scratch(df.sparkSession, "copies")
        ship(df.sparkSession)
        forms = df.filter(df[key].isNotNull()).select(canonical_form(df).alias("form"), df[key].cast("long").alias("id"))
        folded = s.write(forms.mapInArrow(_fold, "form binary, id long, leader long, n long"), "folded")
        # a leader is its task's first record, not always its smallest
        self.links = folded.filter("form is null").select("id", "leader")
        least = self.links.groupBy("leader").agg(F.min("id").alias("least"))
        leaders = folded.filter("form is not null").select("form", "leader", "n").join(least, "leader", "left").select("form", "leader", "n", F.least("leader", "least").alias("least"))
        ready = buckets(s.write(leaders, "leaders"), s).select("bucket", "form", "leader", "n", "least")
        self.firsts = s.write(ready.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count, "leader long, first long, n long"), "firsts")

    def pairs(self) -> DataFrame:
        """(first_id, copy_id): the smallest id of every group of copies with each other one."""
        linked = self.links.join(self.firsts, "leader").select(F.col("first").alias("first_id"), F.col("id").alias("copy_id"))
        return linked.unionByName(self.firsts.select(F.col("first").alias("first_id"), F.col("leader").alias("copy_id"))).filter("first_id != copy_id")

    def records(self) -> DataFrame:
        """The first record of each group as it was written, with n_copies, the number of records in the group."""
        one = self.firsts.groupBy("first").agg(F.max("n").alias("n"))
        own = self.df.select(self.df[self.key].cast("long").alias("first"), F.struct("*").alias("record"))
        return own.join(one, "first").select("record.*", F.col("n").alias("n_copies"))
