"""Matching entities across two sources without keys, with a confidence for each match.

Businesses of ``members`` and rows of the registry that share a phone, a place and house number, a name
in a place, or a host become candidate pairs. Each pair has a vector of four similarities (name, phone,
address, website). A mixture of two Gaussians with regularised covariances is fitted to all vectors
without labels by expectation-maximisation. Similarities lie on a grid, so all pairs are summed up by at
most GRID cells, which is all that reaches the driver. Transitivity is enforced in every round: two
different businesses cannot both be one registry row, nor two registry rows one business, so of rival
pairs only the likeliest keeps its responsibility. The posterior is the confidence.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm import addresses, entities
from rollbook.work import cut

#: Cells of the similarity grid: 11 name levels, 3 phone, 5 address, 3 website.
GRID = 11 * 3 * 5 * 3
ROUNDS = 8
#: Added to the diagonal of each covariance.
RIDGE = 0.02
DIMS = ("name", "phone", "address", "website")


def _tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(c, " ")), "")


def _initials(c: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(F.split(c, " "), lambda t: F.substring(t, 1, 1))), "")


def name_similarity(a: Column, b: Column) -> Column:
    """0 to 1 in tenths: edit similarity of the cores, in order or sorted; initials of each other give 0.8; missing 0.5."""

    def sim(x: Column, y: Column) -> Column:
        return 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))

    x, y = F.regexp_replace(a, " ", ""), F.regexp_replace(b, " ", "")
    short = F.least(F.length(x), F.length(y)) <= 3
    one_letter = F.when(F.length(x) < F.length(y), F.array_join(F.array_sort(F.split(x, "")), "")).otherwise(F.array_join(F.array_sort(F.split(y, "")), ""))
    other = F.when(F.length(x) < F.length(y), _initials(b)).otherwise(_initials(a))
    by_initials = F.when(short & ((one_letter == other) | (F.regexp_replace(one_letter, "t", "") == F.regexp_replace(other, "t", ""))), 0.8).otherwise(0.0)
    starts = F.when((F.least(F.length(x), F.length(y)) >= 6) & (x.startswith(y) | y.startswith(x)), 0.9).otherwise(0.0)
    best = F.greatest(sim(x, y), sim(_tokens(a), _tokens(b)), by_initials, starts)
    return F.when(a.isNull() | b.isNull(), 0.5).otherwise(F.round(best, 1))


#: Firms move and change numbers, so values that differ speak less against a pair than equal ones speak for it.
DIFFERENT = 0.3


def _same(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), 0.5).when(a == b, 1.0).otherwise(DIFFERENT)


def candidates(firms: DataFrame, registry: DataFrame) -> DataFrame:
    """(business, npi, name, phone, address, website): the best similarity of any profile of a business, per pair.

    A side's rows meet the other's only under a shared key. Keys are numbers, joined as they are: the registry
    side of any key is small, so the pairs grow with the rows of ``firms``. The values come in afterwards.
    """

    def keys() -> Column:
        tag = lambda t, *c: F.when(F.concat(*c).isNotNull(), F.xxhash64(F.lit(t), *c))
        initial = F.when(F.length(F.regexp_replace("core", " ", "")) > 3, _tokens(F.col("core")))
        return F.array_distinct(F.array_compact(F.array(tag("p", F.col("phone")), tag("p", F.col("fax")), tag("s", F.col("spot")), tag("n", initial, F.col("place")), tag("h", F.col("host")))))

    side = ["core", "phone", "host", "place", "spot"]
    firms = cut(firms.withColumn("id", F.xxhash64(*firms.columns)), "p2-firms")
    registry = cut(registry, "p2-registry")
    a = firms.select("id", F.explode(keys()).alias("key"))
    b = registry.select("npi", F.explode(keys()).alias("key"))
    # neither side is bounded, so both are shuffled at every size
    met = a.join(b.hint("merge"), "key").select("id", "npi").distinct()
    both = met.join(firms.select("id", "business", *side), "id").join(registry.select("npi", *[F.col(c).alias(f"r_{c}") for c in side]), "npi")
    address = (
        F.when(F.col("spot") == F.col("r_spot"), 1.0)
        .when(F.col("place").isNull() | F.col("r_place").isNull(), 0.5)
        .when(F.col("place") != F.col("r_place"), DIFFERENT)
        .when(F.col("spot").isNull() | F.col("r_spot").isNull(), 0.6)
        .otherwise(0.4)
    )
    sims = both.select("business", "npi", name_similarity(F.col("core"), F.col("r_core")).alias("name"), _same(F.col("phone"), F.col("r_phone")).alias("phone"), address.alias("address"), _same(F.col("host"), F.col("r_host")).alias("website"))
    # the value that speaks most clearly: agreement before doubt, doubt only where nothing is known
    return sims.groupBy("business", "npi").agg(*[F.max(F.when(F.col(d) != 0.5, F.col(d))).alias(d) for d in DIMS]).fillna(0.5, list(DIMS))


def _density(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    inv, (_, logdet) = np.linalg.inv(cov), np.linalg.slogdet(cov)
    d = x - mean
    return -0.5 * (np.einsum("ij,jk,ik->i", d, inv, d) + logdet + x.shape[1] * np.log(2 * np.pi))


def posterior(x: np.ndarray, model: tuple) -> np.ndarray:
    (pi, m1, c1, m0, c0) = model
    a = np.log(pi) + _density(x, m1, c1)
    b = np.log(1 - pi) + _density(x, m0, c0)
    return 1 / (1 + np.exp(np.clip(b - a, -50, 50)))


def maximise(x: np.ndarray, n: np.ndarray, g: np.ndarray) -> tuple:
    """Mixture parameters from grid points, their counts and responsibilities."""

    def part(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = max(w.sum(), 1e-9)
        mean = (x * w[:, None]).sum(axis=0) / total
        d = x - mean
        return mean, (d * w[:, None]).T @ d / total + RIDGE * np.eye(x.shape[1])

    m1, c1 = part(n * g)
    m0, c0 = part(n * (1 - g))
    return (min(max((n * g).sum() / max(n.sum(), 1e-9), 1e-3), 1 - 1e-3), m1, c1, m0, c0)


def match(pairs: DataFrame) -> DataFrame:
    """(business, npi, confidence): pairs that keep their responsibility under the constraints, confidence over 0.5."""
    spark = pairs.sparkSession
    # a pair without rivals keeps its responsibility in every round, so only rivals are looked at again
    count = lambda key: F.count("*").over(Window.partitionBy(key))
    pairs = cut(pairs.withColumn("rival", (count("npi") > 1) | (count("business") > 1)), "p2-rivals")
    grid = pairs.groupBy(*DIMS).agg(F.count("*").alias("n"), F.count_if(~F.col("rival")).alias("alone")).collect()  # at most GRID rows
    if not grid:
        return pairs.select("business", "npi", F.lit(0.0).alias("confidence")).limit(0)
    x = np.array([[r[d] for d in DIMS] for r in grid], dtype=float)
    n = np.array([r["n"] for r in grid], dtype=float)
    alone = np.array([r["alone"] for r in grid], dtype=float)
    # start: pairs that agree on the name and on a number or place
    g = ((x[:, 0] >= 0.8) & ((x[:, 1] == 1) | (x[:, 2] == 1))).astype(float) * 0.9 + 0.05
    model = maximise(x, n, g)

    def scored_by(g: np.ndarray, which: str) -> DataFrame:
        cells = spark.createDataFrame([(*map(float, v), float(p)) for v, p in zip(x, g)], ", ".join(f"{d} double" for d in DIMS) + ", p double")
        return pairs.where(which).join(F.broadcast(cells), list(DIMS))

    def constrained(g: np.ndarray) -> DataFrame:
        """Rival pairs with ``p``, and whether they keep it: the likeliest does, the others lose theirs."""
        scored = scored_by(g, "rival")
        order = (F.col("p").desc(), (F.col("name") + F.col("phone") + F.col("address") + F.col("website")).desc())
        first = F.row_number().over(Window.partitionBy("npi").orderBy(*order, "business")) == 1
        # a business may be known by more than one registry row only if nothing tells them apart
        best = F.max("p").over(Window.partitionBy("business"))
        return scored.withColumn("keep", first & (F.col("p") >= best - 0.2))

    for _ in range(ROUNDS):
        g = posterior(x, model)
        kept = {tuple(v[d] for d in DIMS): v["k"] for v in constrained(g).where("keep").groupBy(*DIMS).agg(F.count("*").alias("k")).collect()}
        model = maximise(x, n, g * (alone + np.array([kept.get(tuple(v), 0) for v in x.tolist()])) / n)
    g = posterior(x, model)
    marked = cut(constrained(g).where("keep").drop("keep").unionByName(scored_by(g, "not rival")), "p2-marked")
    return marked.where("p > 0.5").select("business", "npi", F.col("p").alias("confidence"), *DIMS)


def linked(members: DataFrame, business: DataFrame | None, registry: DataFrame) -> DataFrame:
    """(member_id, npi, confidence): every row of a business that a registry row describes.

    By company_name, phone, street_address and website (and the fax and mailing address that members'
    rows are grouped by). Nulls and unusable values speak neither for nor against a pair. Empty tables
    give no rows. ``business`` is that of ``entities.businesses`` where it is known already.
    """
    known = entities.known_directories(members)
    rows = entities.member_features(members, known=known)
    side = ["core", "phone", "fax", "host", "place", "spot"]
    if business is None:
        named = rows.select("member_id", "h", "k", *side).join(entities.profile_businesses(rows).drop("n"), ["h", "k"], "left")
        business = cut(named.select("member_id", F.coalesce("business", "member_id").alias("business"), *side), "p2-members")
        firms = business.select("business", *side).distinct()
    else:
        firms = rows.join(business.select("member_id", "business"), "member_id").select("business", *side).distinct()
    reg = entities.own_host(entities.featured(registry.withColumn("mailing_address", F.lit(None).cast("string")), "npi"), known).select("npi", *side)
    pairs = cut(candidates(firms, reg), "p2-pairs")
    got = match(pairs)
    # a pair of good posterior still needs a name, or both number and address, in common
    sure = ((F.col("name") >= 0.6) & ((F.col("phone") == 1) | (F.col("address") >= 0.6))) | ((F.col("phone") == 1) & (F.col("address") == 1) & (F.col("name") == 0.5))
    return business.select("member_id", "business").join(got.where(sure), "business").select("member_id", "npi", "confidence")
