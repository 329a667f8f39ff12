"""Trigram similarity of short texts: Jaccard over distinct character trigrams of the padded lower-case text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.ids import strip


def trigrams(text: str) -> set[str]:
    """Trigrams of the text in lower case with one blank on either side; none of a blank text."""
    core = text.strip().lower()
    padded = f" {core} "
    return {padded[k : k + 3] for k in range(len(padded) - 2)} if core else set()


def similarity(a: str, b: str) -> float:
    if a == b:
        return 1.0
    x, y = trigrams(a), trigrams(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def most_similar(text: str, others: list[str]) -> tuple[str, float] | None:
    """The most similar of `others` and its similarity; of equal ones the first."""
    scored = [(similarity(text, o), -k, o) for k, o in enumerate(others)]
    return (max(scored)[2], max(scored)[0]) if scored else None


def trigram_column(c: Column) -> Column:
    core = F.lower(strip(c))
    padded = F.concat(F.lit(" "), core, F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length(core)), lambda k: F.substr(padded, k, F.lit(3)))
    return F.when(F.length(core) > 0, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def similarity_column(a: Column, b: Column) -> Column:
    """Null if either is null."""
    x, y = trigram_column(a), trigram_column(b)
    both = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    return F.when(a.isNull() | b.isNull(), None).when(a == b, 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(both)
