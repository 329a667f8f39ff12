"""Token ids of whole corpora."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm import bpe
from factloom.runtime import ship, ship_file, shipped

#: Characters encoded at a time, so that memory does not depend on the batch; a longer text is a batch of its own.
BATCH_CHARS = 2_000_000


def chunks(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about BATCH_CHARS characters together."""
    start, total = 0, 0
    for k, n in enumerate(lengths):
        if total and total + n > BATCH_CHARS:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids): each row's token ids, without special tokens; names of special tokens in a text are ordinary text.

    Empty and null texts give an empty list. Rows come out as often as they go in; other columns are not read.
    """
    file = ship_file(df.sparkSession, path or bpe.default_path())
    ship(df.sparkSession)

    def run(batches):
        model = bpe.load(shipped(file))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks([len(t or "") for t in texts]):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), model.ids(texts[a:b])], ["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)
