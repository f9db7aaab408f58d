"""Pairs of rows of one group whose texts differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.work import cut, hashed


def differing(rows: DataFrame, at: tuple[str, ...], label: str) -> DataFrame:
    """(a, b): structs of ``at`` of rows of one group ``g`` with different texts ``s``, a before b.

    ``rows`` has (g, s, *at) with numbers for ``g`` and ``s``. Texts are paired first, then replaced by their
    rows, so rows of equal texts never meet and a group of one text costs one row.
    """
    rows = cut(rows.select("g", "s", F.struct(*at).alias("a")), label)
    texts = rows.groupBy("g", "s").agg(F.lit(1).alias("one"))
    several = rows.groupBy("g").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo < hi").select("g")
    texts = cut(texts.join(hashed(several), "g").select("g", "s"), f"{label}-texts")
    both = texts.join(texts.select("g", F.col("s").alias("t")), "g").where("s < t")
    # hashed, as it holds no text more often than its group has different ones
    half = rows.join(both.hint("shuffle_hash"), ["g", "s"]).select("g", F.col("t").alias("s"), F.col("a").alias("x"))
    full = half.join(rows, ["g", "s"])
    return full.select(F.least("x", "a").alias("a"), F.greatest("x", "a").alias("b"))
