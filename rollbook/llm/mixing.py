"""Mixing sources to target weights by fitting each source's token budget exactly.

Sizes are token counts of a public tokenizer. A mix is as large as its tightest source allows: with
share w, tokens T and at most R uses of a document, no source gives more than R * T. Each source's
budget is filled by whole rounds over all its documents and a remainder. The remainder is a
subset-sum: documents are counted by exact token length, most of it is taken in proportion to these
counts, and bounded-knapsack dynamic programming over what is left of the counts closes the gap.
Documents of each length are then picked in seeded order.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm import tokenizing

SEED = 20250101
#: The dynamic programme covers gaps up to this many tokens; larger gaps are first closed greedily.
DP_TOKENS = 30_000
#: Buckets of the seeded order, so that no length's documents are ranked in one task.
BUCKETS = 256


def fit(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take (at most its count) so that the sum is the largest reachable
    by this search that does not exceed ``budget``."""
    take = [0] * len(lengths)
    total = sum(n * c for n, c in zip(lengths, counts))
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return list(counts)
    share = budget / total
    take = [math.floor(c * share) for c in counts]
    gap = budget - sum(n * t for n, t in zip(lengths, take))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        if gap <= DP_TOKENS:
            break
        more = min(counts[i] - take[i], (gap - DP_TOKENS // 2) // lengths[i])
        if more > 0:
            take[i] += more
            gap -= more * lengths[i]
    # bounded knapsack: bit b of the set is on if b tokens are reachable
    reach, steps = 1, []
    mask = (1 << (gap + 1)) - 1
    for i in order[::-1]:
        left, size = counts[i] - take[i], 1
        while left > 0 and lengths[i] <= gap and not reach >> gap & 1:
            size_now = min(size, left)
            steps.append((i, size_now, reach))
            reach = (reach | reach << (size_now * lengths[i])) & mask
            left -= size_now
            size *= 2
    at = reach.bit_length() - 1
    for i, size_now, before in reversed(steps):
        if not before >> at & 1:
            take[i] += size_now
            at -= size_now * lengths[i]
    return take


def _fit_group(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values("tokens")
    lengths, counts = g["tokens"].astype(int).tolist(), g["docs"].astype(int).tolist()
    rounds, rest = int(g["rounds"].iloc[0]), int(g["rest"].iloc[0])
    got = fit(lengths, counts, rest)
    return pd.DataFrame({"mix_id": g["mix_id"], "source": g["source"], "tokens": lengths, "rounds": rounds, "extra": got})


def plan(targets: DataFrame, sizes: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, fit_share, max_repeats, available, budget, rounds, rest).

    ``fit_share`` is the share among the sources of the mix that have tokens: a source without any
    cannot give its share, and the others keep their proportions. Null or negative shares count as 0,
    null or negative ``max_repeats`` as 0 (the source gives nothing).
    """
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("available"))
    t = targets.select("mix_id", "source", F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))
    t = t.groupBy("mix_id", "source").agg(F.sum("share").alias("share"), F.max("max_repeats").alias("max_repeats"))
    mix = Window.partitionBy("mix_id")
    t = t.join(F.broadcast(have), "source", "left").withColumn("available", F.coalesce("available", F.lit(0)).cast("bigint"))
    usable = (F.col("available") > 0) & (F.col("max_repeats") > 0) & (F.col("share") > 0)
    t = t.withColumn("target_share", F.col("share") / F.nullif(F.sum("share").over(mix), F.lit(0.0)))
    t = t.withColumn("fit_share", F.when(usable, F.col("share") / F.sum(F.when(usable, F.col("share"))).over(mix)).otherwise(0.0))
    size = F.min(F.when(usable, F.col("max_repeats") * F.col("available") / F.col("fit_share"))).over(mix)
    most = (F.col("max_repeats") * F.col("available")).cast("bigint")
    t = t.withColumn("budget", F.when(usable, F.least(F.round(F.col("fit_share") * size).cast("bigint"), most)).otherwise(F.lit(0)).cast("bigint"))
    t = t.withColumn("rounds", F.when(F.col("available") > 0, F.expr("budget div available")).otherwise(0))
    return t.withColumn("rest", F.col("budget") - F.col("rounds") * F.col("available")).drop("share")


def document_sizes(docs: DataFrame, targets: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = tokenizing.TOKENIZERS) -> DataFrame:
    """(doc_id, h, source, tokens) of the documents of named sources. Texts without tokens are left out; equal rows count once."""
    names = targets.select("source").distinct()
    docs = docs.select("doc_id", "source", "text").join(F.broadcast(names), "source", "left_semi").distinct()
    keys = docs.select("doc_id", F.xxhash64("text").alias("h"), "source").where("source is not null")
    return keys.join(tokenizing.token_counts(docs, tokenizer, folder), ["doc_id", "h"])


def mix(sizes: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """(mix_id, source, doc_id, repeats, tokens): each used document with its number of uses, at least 1."""
    p = plan(targets, sizes)
    hist = sizes.groupBy("source", "tokens").agg(F.count("*").alias("docs"))
    groups = hist.join(F.broadcast(p.where("budget > 0").select("mix_id", "source", "rounds", "rest")), "source")
    take = groups.groupBy("mix_id", "source").applyInPandas(_fit_group, "mix_id int, source string, tokens bigint, rounds bigint, extra bigint")
    keyed = sizes.withColumn("o", F.xxhash64("doc_id", "h", F.lit(seed))).withColumn("b", F.pmod("o", F.lit(BUCKETS)))
    # documents of a length before each bucket of the seeded order, then ranks inside the bucket
    per = keyed.groupBy("source", "tokens", "b").agg(F.count("*").alias("n"))
    before = per.withColumn("before", F.sum("n").over(Window.partitionBy("source", "tokens").orderBy("b")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("source", "tokens", "b").orderBy("o", "doc_id", "h"))
    ranked = keyed.withColumn("r", rank).join(before, ["source", "tokens", "b"]).select("source", "tokens", "doc_id", (F.col("before") + F.col("r")).alias("r"))
    out = ranked.join(take, ["source", "tokens"]).withColumn("repeats", F.col("rounds") + (F.col("r") <= F.col("extra")).cast("int"))
    return out.where("repeats > 0").select("mix_id", "source", "doc_id", F.col("repeats").cast("int").alias("repeats"), "tokens")


def shares(mixed: DataFrame, targets: DataFrame, sizes: DataFrame) -> DataFrame:
    """The report: (mix_id, source, target_share, fit_share, actual_share, budget, tokens, docs, uses, most_repeats, max_repeats)."""
    got = mixed.groupBy("mix_id", "source").agg(
        F.sum(F.col("repeats") * F.col("tokens")).alias("tokens"), F.count("*").alias("docs"), F.sum("repeats").alias("uses"), F.max("repeats").alias("most_repeats")
    )
    p = plan(targets, sizes).join(got, ["mix_id", "source"], "left").fillna(0, ["tokens", "docs", "uses", "most_repeats"])
    actual = F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy("mix_id")), F.lit(0))
    return p.select("mix_id", "source", "target_share", "fit_share", F.coalesce(actual, F.lit(0.0)).alias("actual_share"), "budget", "tokens", "docs", "uses", "most_repeats", "max_repeats")
