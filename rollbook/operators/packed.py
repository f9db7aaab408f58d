"""Several values packed in one field, split into one row per value with its position.

Delimiters differ from string to string and occur inside values too. What a comma or a slash means
is learned: an expectation-maximisation over the whole column estimates how often each candidate
value occurs, and a Viterbi pass over each string's lattice picks the likeliest split.

1. Each distinct string is cut at delimiters that never belong to a value (line ends, tabs, ``;``,
   ``|``, bullets, numbering, list syntax). Quoted spans are atomic. The parts are *chunks*.
2. A chunk with weak delimiters (``,`` or ``/``) is a lattice: every run of neighbouring pieces is a
   candidate value. E-step: forward-backward under the current frequencies; M-step: sum the expected
   counts over all chunks. Frequencies, supports and chunks are DataFrames; nothing is collected.
3. Viterbi with the final frequencies gives each chunk's values.

Chunks are processed once per distinct text, so a value that a third of all rows carry costs one
lattice; rows get their values back through a join in which hot strings are broadcast (their number
is bounded, see ``work.hot_join``).
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from rollbook.work import cut, hot_join

#: Factor in the likelihood for each weak delimiter that a value keeps inside.
KEEP = 0.05
ROUNDS = 4
#: Rows of one chunk that count like a second chunk with the same value.
OFTEN = 5
#: A piece that no other string shows has this count.
FLOOR = 0.01
#: Pieces up to which every run of a chunk is a candidate, and characters of a run in chunks that have more.
PIECES, LONG = 64, 80

_STRONG = re.compile(r"(?:^|(?<=\s))\(?\d{1,2}[.)]\s+|\s*(?:[;|\t\r\n•·‣▪◦]\s*(?:[-*–]\s+)?)+")
_WEAK = re.compile(r"\s*[,/]\s*")
_QUOTED = re.compile(r"""(?<![^\s,;|/\t\n\[])(["“])([^"“”]+)["”](?![^\s,;|/\t\n\]])""")
_LISTED = re.compile(r"""(["'])(.*?)(?<!\\)\1\s*(?=,|$)""", re.S)
_EDGE = " \t\r\n\u00a0\u200b\ufeff\"'“”•·"
#: Any sign that a string may hold several values; the cheap filter before Python.
MAYBE = r"[,/;|\t\r\n•·‣▪◦]|^\s*\[|\d[.)]\s"


def _clean(s: str) -> str:
    s = s.strip(_EDGE)
    s = re.sub(r"^(?:[-*–]\s+|\(?\d{1,2}[.)]\s+)", "", s)
    return s.strip(_EDGE)


def chunks(text: str | None) -> list[tuple[str, bool]]:
    """(chunk, weak) of one string; a weak chunk may still hold several values."""
    if text is None:
        return []
    s = text.strip(" \t\r\n\u00a0\u200b\ufeff")
    if len(s) > 1 and s[0] == "[" and s[-1] == "]":
        inner = s[1:-1].strip()
        got = _LISTED.findall(inner)
        if got and inner[:1] in "\"'":
            return [(v, False) for v in (_clean(x[1]) for x in got) if v]
        s = inner
    held: list[str] = []

    def hold(m: re.Match) -> str:
        held.append(m.group(2))
        return f"\x00{len(held) - 1}\x00"

    s = _QUOTED.sub(hold, s)
    out: list[tuple[str, bool]] = []
    for part in _STRONG.split(s):
        if held:
            bits, at = [], 0
            for m in re.finditer(r"\x00(\d+)\x00", part):
                bits.append((part[at : m.start()], False))
                bits.append((held[int(m.group(1))], True))
                at = m.end()
            bits.append((part[at:], False))
        else:
            bits = [(part, False)]
        for bit, atomic in bits:
            bit = re.sub(r"^\s*[,/]\s*|\s*[,/]\s*$", "", bit) if len(bits) > 1 and not atomic else bit
            bit = _clean(bit)
            if bit:
                out.append((bit, not atomic and bool(_WEAK.search(bit)) and "://" not in bit and bit[0] != "/"))
    return out


def pieces(chunk: str) -> tuple[list[str], list[str]]:
    """Pieces of a weak chunk and the delimiters between them."""
    parts = re.split(r"(\s*[,/]\s*)", chunk)
    return parts[::2], parts[1::2]


def fold(value: str) -> str:
    """The form under which values are counted."""
    return re.sub(r"\s+", " ", value).strip(_EDGE).casefold()


def arcs(chunk: str) -> list[tuple[int, int, str]]:
    """All candidate values of a weak chunk: pieces i..j-1, as written; in chunks of over ``PIECES`` pieces those of up to ``LONG`` characters."""
    ps, ds = pieces(chunk)
    out = []
    for i in range(len(ps)):
        text = ps[i]
        out.append((i, i + 1, text))
        for j in range(i + 1, len(ps)):
            text += ds[j - 1] + ps[j]
            if len(ps) > PIECES and len(text) > LONG:
                break
            out.append((i, j + 1, text))
    return out


def _lattice(rows: list, total: float) -> dict[tuple[int, int], float]:
    """Log score of each arc under frequencies ``f`` with support ``k`` (number of different chunks)."""
    out = {}
    for i, j, _, f, k in rows:
        f = f or 0.0
        if j - i > 1 and (k or 0) < 2:
            f = 0.0
        out[i, j] = math.log(max(f, FLOOR if j - i == 1 else 1e-9) / total) + (j - i - 1) * math.log(KEEP)
        if j - i > 1 and f == 0.0:
            out[i, j] -= 20.0
    return out


def expected(rows: list, total: float) -> list[tuple[int, int, float]]:
    """Posterior probability of each arc (forward-backward)."""
    sc = _lattice(rows, total)
    n = max(j for _, j in sc)
    fw, bw = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    fw[0] = bw[n] = 0.0

    def add(a: float, b: float) -> float:
        if a == -math.inf:
            return b
        if b == -math.inf:
            return a
        return max(a, b) + math.log1p(math.exp(-abs(a - b)))

    for (i, j), s in sorted(sc.items()):
        fw[j] = add(fw[j], fw[i] + s)
    for (i, j), s in sorted(sc.items(), reverse=True):
        bw[i] = add(bw[i], bw[j] + s)
    return [(i, j, math.exp(min(0.0, fw[i] + s + bw[j] - fw[n]))) for (i, j), s in sc.items()]


def best(rows: list, total: float) -> list[tuple[int, int]]:
    """The likeliest path (Viterbi); ties go to fewer, longer values."""
    sc = _lattice(rows, total)
    n = max(j for _, j in sc)
    top: list = [(0.0, 0, None)] + [None] * n
    for (i, j), s in sorted(sc.items()):
        if top[i] is not None:
            cand = (top[i][0] + s, top[i][1] - 1, i)
            if top[j] is None or cand[:2] > top[j][:2]:
                top[j] = cand
    path, at = [], n
    while at:
        path.append((top[at][2], at))
        at = top[at][2]
    return path[::-1]


_CHUNKS = T.ArrayType(T.StructType([T.StructField("chunk", T.StringType()), T.StructField("weak", T.BooleanType())]))
_ARCS = T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("v", T.StringType()), T.StructField("key", T.StringType())]))
_POST = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("n", T.DoubleType()), T.StructField("wide", T.BooleanType())]))


@pandas_udf(_CHUNKS)
def chunks_udf(s: pd.Series) -> pd.Series:
    return s.map(chunks)


@pandas_udf(_ARCS)
def arcs_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda c: [(i, j, v, fold(v)) for i, j, v in arcs(c)])


def _rows(a) -> list:
    return [(x["i"], x["j"], x["key"], x["n"], x["k"]) for x in a]


@pandas_udf(_POST)
def expected_udf(lat: pd.Series, total: pd.Series) -> pd.Series:
    def one(a, t):
        rows = _rows(a)
        key = {(i, j): k for i, j, k, _, _ in rows}
        return [(key[i, j], p, j - i > 1) for i, j, p in expected(rows, t) if p > 1e-4]

    return pd.Series([one(a, t) for a, t in zip(lat, total)])


@pandas_udf(T.ArrayType(T.StringType()))
def best_udf(lat: pd.Series, total: pd.Series) -> pd.Series:
    def one(a, t):
        text = {(x["i"], x["j"]): x["v"] for x in a}
        return [v for v in (_clean(text[p]) for p in best(_rows(a), t)) if v]

    return pd.Series([one(a, t) for a, t in zip(lat, total)])


def segment(strings: DataFrame) -> DataFrame:
    """(s, n) distinct strings with their row counts -> (s, vals): the values in order.

    Null or blank strings give an empty list. A string of one value gives that value, cleaned.
    """
    # What cannot hold several values counts as it stands; only the rest goes to Python.
    maybe = F.col("s").rlike(MAYBE)
    parts = cut(strings.where(maybe).withColumn("c", chunks_udf("s")), "p4-chunks")
    plain = strings.where(~maybe).select(F.lower(F.trim("s")).alias("key"), F.col("n").cast("double"))
    flat = parts.select("n", F.explode("c").alias("c")).groupBy("c.chunk", "c.weak").agg(F.sum("n").cast("double").alias("n"))
    flat = cut(flat, "p4-flat")
    sure = flat.where("not weak").select(F.lower(F.trim("chunk")).alias("key"), "n").unionByName(plain)
    sure = sure.groupBy("key").agg(F.sum("n").alias("n"))
    weak = flat.where("weak").select("chunk", "n", arcs_udf("chunk").alias("arcs"))
    arc = cut(weak.select("chunk", "n", F.explode("arcs").alias("a")).select("chunk", F.col("n").alias("w"), "a.*"), "p4-arcs")
    # seen in several different chunks, or again and again in one
    support = arc.groupBy("key").agg((F.countDistinct("chunk") + (F.max("w") >= OFTEN).cast("int")).alias("k"))
    support = support.join(sure.select("key", F.lit(2).alias("s")), "key", "full").select("key", (F.coalesce("k", F.lit(0)) + F.coalesce("s", F.lit(0))).alias("k"))
    first = arc.groupBy("key").agg(F.sum(F.col("w") * F.pow(F.lit(KEEP), F.col("j") - F.col("i") - 1)).alias("n"))
    base = cut(sure.select("key", "n", F.lit(0.0).alias("m")).unionByName(first.select("key", F.lit(0.0).alias("n"), F.col("n").alias("m"))).groupBy("key").agg(F.sum("n").alias("n0"), F.sum("m").alias("m")).join(support, "key"), "p4-base")
    freq = base.select("key", (F.col("n0") + F.col("m")).alias("n"), "k")

    def lattice(freq: DataFrame) -> DataFrame:
        total = freq.agg(F.sum("n").alias("total"))
        got = arc.join(freq, "key", "left").groupBy("chunk").agg(F.first("w").alias("w"), F.collect_list(F.struct("i", "j", "v", "key", F.col("n").alias("n"), "k")).alias("lat"))
        return got.crossJoin(F.broadcast(total))  # one row

    for r in range(ROUNDS):
        post = lattice(freq).select("w", F.explode(expected_udf("lat", "total")).alias("p"))
        new = post.groupBy("p.key").agg(F.sum(F.col("p.n") * F.col("w")).alias("m"))
        freq = cut(base.drop("m").join(new, "key", "left").select("key", (F.col("n0") + F.coalesce("m", F.lit(0.0))).alias("n"), "k"), f"p4-em{r}")
    split = lattice(freq).select("chunk", best_udf("lat", "total").alias("vals"))
    many = parts.select("s", F.posexplode_outer("c").alias("pos", "c"))
    many = many.join(split, F.col("c.chunk") == F.col("chunk"), "left")
    vals = F.when(F.col("c").isNull(), F.array().cast("array<string>")).when(F.col("c.weak"), F.col("vals")).otherwise(F.array("c.chunk"))
    done = many.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("pos", vals.alias("v")))).alias("v")).select("s", F.flatten(F.col("v.v")).alias("vals"))
    return done


def split_packed(members: DataFrame) -> DataFrame:
    """(member_id, field, pos, val): the values of each ``category`` that packs two or more, and of each
    ``services`` list in which at least one element does.

    Null rows, empty lists and null elements give no rows. Repeated ids keep one copy of equal rows.
    Columns beyond ``member_id``, ``category`` and ``services`` are not read.
    """
    one = members.where(F.col("category").rlike(MAYBE)).select("member_id", F.lit("category").alias("field"), F.lit(0).alias("at"), F.col("category").alias("s"))
    lists = members.where(F.exists("services", lambda x: F.coalesce(x.rlike(MAYBE), F.lit(False))))
    elems = lists.select("member_id", F.lit("services").alias("field"), F.posexplode("services").alias("at", "s")).where("s is not null")
    texts = members.select(F.col("category").alias("s")).unionByName(members.select(F.explode("services").alias("s"))).where("s is not null and s != ''")
    strings = cut(texts.groupBy("s").agg(F.count("*").alias("n")), "p4-strings")
    done = cut(segment(strings), "p4-vals")
    rows = one.unionByName(elems)
    total = strings.agg(F.sum("n")).first()[0] or 0
    maybe = F.col("s").rlike(MAYBE)
    packed = hot_join(rows.where(maybe), done, "s", strings, total)
    single = rows.where(~maybe).select("s", "member_id", "field", "at", F.array(F.trim("s")).alias("vals"))
    whole = packed.unionByName(single).groupBy("member_id", "field").agg(
        F.sort_array(F.collect_set(F.struct("at", "vals"))).alias("v"), F.max(F.size("vals")).alias("most")
    )
    out = whole.where("most > 1").select("member_id", "field", F.posexplode(F.filter(F.flatten("v.vals"), lambda x: x != "")).alias("pos", "val"))
    return out
