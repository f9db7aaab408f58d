"""Postal addresses: one location behind many spellings.

1. A gazetteer (postcode -> place and state) is learned from the well-formed addresses of the table.
   Postcodes have five digits, so it has at most 100,000 rows and is broadcast.
2. Each distinct string is parsed into components: box, number, directions, street tokens, street type,
   unit, place, state, postcode. Misspelt places resolve through the gazetteer's deletion neighbourhood.
3. Records are blocked by locality (postcode's place, which holds the neighbouring postcodes) and number.
   In a block, street tokens that share a deletion neighbour (edit distance up to 2) are variants; the
   components of a pair are assigned at minimal cost. House numbers and units are hard vetoes.
   Records that leave parts out join the one location that the rest of them fits.
Blocks are built over distinct parsed tuples, not rows; one above ``BLOCK`` tuples is divided by
street deletion keys, so no task holds an unbounded group.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from rollbook.llm.components import components
from rollbook.llm.names import edits
from rollbook.llm.pairs import differing
from rollbook.work import cut, drop_cut

#: Distinct parsed tuples up to which a block (place, number) is resolved in one call; a larger one is first taken apart
#: into streets that cannot meet.
BLOCK = 400

# Street types, directions, and ordinals as addresses write them.
TYPES = {
    "street": "st", "str": "st", "st": "st", "avenue": "ave", "av": "ave", "ave": "ave", "road": "rd", "rd": "rd", "lane": "ln", "ln": "ln", "drive": "dr", "dr": "dr", "drv": "dr",
    "court": "ct", "ct": "ct", "crt": "ct", "place": "pl", "pl": "pl", "boulevard": "blvd", "boul": "blvd", "blvd": "blvd", "circle": "cir", "circ": "cir", "cir": "cir",
    "terrace": "ter", "terr": "ter", "ter": "ter", "parkway": "pkwy", "pky": "pkwy", "pkwy": "pkwy", "pkw": "pkwy", "highway": "hwy", "hiway": "hwy", "hwy": "hwy", "way": "way", "square": "sq", "sq": "sq", "trail": "trl", "trl": "trl",
}
DIRECTIONS = {
    "n": "n", "no": "n", "north": "n", "s": "s", "so": "s", "south": "s", "e": "e", "east": "e", "w": "w", "west": "w",
    "ne": "ne", "northeast": "ne", "nw": "nw", "northwest": "nw", "se": "se", "southeast": "se", "sw": "sw", "southwest": "sw",
}
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth".split()
_ORD = {w: str(i + 1) for i, w in enumerate(ORDINALS)}

_COUNTRY = re.compile(r"[,\s]+(?:(?:usa|us|u\.s\.a?\.?)(?=\s*(?:,|$|\d))|united states(?: of america)?)")
_BOX = re.compile(r"\b(?:p\.?\s*o\.?\s*b(?:ox)?|post office box|pob|p o box|box)\.?\s*#?\s*(\d+)\b")
_UNIT = re.compile(r"(?:\b(?:suite|ste|unit|rm|room|apt|apartment|flat)\b\.?\s*#?|#)\s*([0-9]+[a-z]?|[a-z])\b")
_ZIP = re.compile(r"(?<![\d-])(\d{5})(?:-\d{4})?(?![\d-])")
_BLDG = re.compile(r"(?:^|,)\s*[^,\d#]*?\b(?:bldg|building|plaza|tower|center|centre|mall)\b\.?\s*(?=,|\d|$)")
_TOKEN = re.compile(r"[a-z0-9']+")
_HOUSE = re.compile(r"\d{1,6}[a-z]?$")
_BREAK = re.compile(r"\s*[\r\n;|]+\s*|\s+[-–—]\s+")
_BREAKS, _DIGIT = re.compile(r"[-;\n|\r–—]"), re.compile(r"\d")
_DOTTED, _DOTTED_END = re.compile(r"\b([nsew])\.\s?([ew])\b\.?"), re.compile(r"\b([nsew])\.\s?([ew])\.?(?=[\s,]|$)")
#: Values that state no address.
EMPTY = r"(?i)^[\s.,;-]*(?:same(?: as (?:above|street|physical))?|n/?a|none|null|unknown|see website|-+)?[\s.,;-]*$"


def plain(s: str) -> str:
    """Lower case, no accents, one kind of blank; line ends, semicolons and spaced dashes read as commas."""
    if not s.isascii():
        s = unicodedata.normalize("NFKD", s)
        s = "".join(c for c in s if not unicodedata.combining(c) and c not in "\u200b\u200c\u200d\ufeff\u00ad")
    s = s.lower()
    if _BREAKS.search(s):
        s = _BREAK.sub(", ", s)
    return " ".join(s.split()).strip(" ,.")


#: Names longer than this are no slips of others: they only match as they are.
LONG = 48


def deletions(s: str, depth: int) -> set[str]:
    """``s`` and every string with up to ``depth`` characters taken out; a long one alone."""
    if len(s) > LONG:
        return {s}
    out, last = {s}, {s}
    for _ in range(depth):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        out |= last
    return out


@lru_cache(maxsize=50_000)
def distance(a: str, b: str, most: int = 2) -> int:
    """Edit distance with neighbour swaps, ``most`` + 1 if larger."""
    return 0 if a == b else most + 1 if max(len(a), len(b)) > LONG else edits(a, b, most)


class Gazetteer:
    """Places by postcode, with a deletion index over their names."""

    def __init__(self, rows: list[tuple[str, str, str]]):
        self.zip = {z: (c, s) for z, c, s in rows}
        self.city: dict[str, tuple[str, str]] = {}
        for _, c, s in rows:
            self.city.setdefault(c, (c, s))
        self.states = {s for _, _, s in rows}
        self.near: dict[str, set[str]] = {}
        for c in self.city:
            for d in deletions(c.replace(" ", ""), 1):
                self.near.setdefault(d, set()).add(c)
        self.heads = {c.split()[0] for c in self.city}

    @lru_cache(maxsize=100_000)
    def fuzzy(self, name: str) -> str | None:
        """The one place within edit distance 2 of a name with a shared deletion neighbour."""
        got = {c for d in deletions(name.replace(" ", ""), 1) for c in self.near.get(d, ())}
        best = sorted((distance(name.replace(" ", ""), c.replace(" ", "")), c) for c in got)
        best = [x for x in best if x[0] <= 2]
        return best[0][1] if best and (len(best) == 1 or best[0][0] < best[1][0]) else None


#: The commonest form: number, street, perhaps a unit, place, state and postcode.
_PLAIN = re.compile(r"(\d{1,6}) ([a-z0-9'. ]+?)(?:,? (?:suite|ste|unit|rm|room|#)\.? ?#?([0-9]+[a-z]?))?, ([a-z ]+), ([a-z]{2}),? (\d{5})(?:-\d{4})?")


def _street(rest: list[str]) -> tuple[str, str, str]:
    """Direction, core and type of the tokens after the house number."""
    direction = kind = ""
    if len(rest) > 1 and rest[0] in DIRECTIONS:
        direction, rest = DIRECTIONS[rest[0]], rest[1:]
    elif len(rest) > 1 and rest[-1] in DIRECTIONS:
        direction, rest = DIRECTIONS[rest[-1]], rest[:-1]
    if len(rest) > 1 and rest[-1] in TYPES:
        kind, rest = TYPES[rest[-1]], rest[:-1]
        if not direction and len(rest) > 1 and rest[-1] in DIRECTIONS:
            direction, rest = DIRECTIONS[rest[-1]], rest[:-1]
    elif len(rest) > 1 and (t := _near_type(rest[-1])):
        kind, rest = t, rest[:-1]
    return direction, " ".join(_ordinal(t) for t in rest), kind


#: place, state, zip, box, number, direction, core, type, unit
FIELDS = ("place", "zip", "box", "number", "dir", "core", "type", "unit")


def parse(text: str | None, g: Gazetteer) -> tuple | None:
    """Components of one string in the order of FIELDS, each "" where absent; null where no address is stated."""
    if text is None:
        return None
    s = plain(text)
    if not _DIGIT.search(s):
        return None
    m = _PLAIN.fullmatch(s)
    if m and g.zip.get(m[6]) == (m[4], m[5]) and "box" not in m[2]:
        words = _TOKEN.findall(_DOTTED.sub(r"\1\2", m[2]) if "." in m[2] else m[2])
        direction, core, kind = _street(words)
        if core:
            return (m[4], m[6], "", m[1].lstrip("0") or "0", direction, core, kind, m[3] or "")
    # plain tests for parts of a pattern come before the pattern
    s = _COUNTRY.sub(", ", s) if "us" in s or "u.s" in s or "united" in s else s
    s = _DOTTED_END.sub(r"\1\2", s) if "." in s else s
    box = unit = zip_ = ""
    m = _BOX.search(s) if "box" in s or "ob" in s or "o.b" in s or "o b" in s or "o. b" in s else None
    if m:
        box = m.group(1).lstrip("0") or "0"
        s = s[: m.start()] + "," + s[m.end() :]
    zips = list(_ZIP.finditer(s))
    if zips:
        zip_ = next((m[1] for m in reversed(zips) if m[1] in g.zip), zips[-1][1])
        if box and zip_ in g.zip:
            return (g.zip[zip_][0], zip_, box, "", "", "", "", "")
        m = next(m for m in zips if m[1] == zip_)
        s = s[: m.start()] + " ," + s[m.end() :]
    m = _UNIT.search(s)
    if m:
        unit = m.group(1)
        s = s[: m.start()] + "," + s[m.end() :]
    s = _BLDG.sub(",", s) if "bldg" in s or "building" in s or "plaza" in s or "tower" in s or "cent" in s or "mall" in s else s
    place = state = ""
    hit = None
    if zip_ in g.zip:
        place, state = g.zip[zip_]
        i = s.rfind(place)
        j = i + len(place)
        if i >= 0 and (i == 0 or not s[i - 1].isalnum()) and (j == len(s) or not s[j].isalnum()):
            s, hit = s[:i] + "," + s[j:], place
    segs = [x for p in s.replace(".", " ").split(",") if (x := _TOKEN.findall(p))]
    # "place state number street" without commas
    for k, x in enumerate(segs):
        for i in range(1, len(x)):
            if x[i - 1] in g.states and _HOUSE.fullmatch(x[i]) and not x[0][0].isdigit():
                segs[k : k + 1] = [x[:i], x[i:]]
                break
    # state codes alone, or at the end of a segment
    for x in sorted(segs, key=lambda x: len(x) > 1):
        clear = x[-1] not in DIRECTIONS or any(g.city.get(" ".join(x[-n:-1]), ("", ""))[1] == x[-1] for n in (2, 3))
        if x[-1] in g.states and (len(x) == 1 or x[-1] == state or (not place and clear)) and (len(x) > 1 or len(segs) > 1):
            state = state or x[-1]
            if x[-1] == state:
                x.pop()
                break
    segs = [x for x in segs if x]
    # the place: exact before misspelt, whole segments before ends of segments
    for exact in (True, False) if not hit else ():
        for k in range(len(segs) - 1, -1, -1):
            x = segs[k]
            for n in (2, 1):
                if len(x) < n or hit:
                    continue
                for part, rest in ((x[-n:], x[:-n]), (x[:n], x[n:])):
                    if hit or part[0].isdigit() or part[-1].isdigit() or (rest is not x[:-n] and rest and not rest[0].isdigit()):
                        continue
                    name = " ".join(part)
                    if exact:
                        ok = name == place if place else name in g.city
                    elif place:
                        ok = distance(name.replace(" ", ""), place.replace(" ", "")) <= 2
                    else:
                        ok = len(name) > 5 and bool(g.fuzzy(name))
                    if ok:
                        hit = place or (name if exact else g.fuzzy(name))
                        segs[k] = list(rest)
                        if place and exact is False and rest and n == 1 and rest[-1] + name == place.replace(" ", ""):
                            segs[k] = list(rest[:-1])
        if hit:
            break
    if hit and not place:
        place = hit
        state = state or g.city[hit][1]
    segs = [x for x in segs if x]
    number = direction = core = kind = ""
    at = next((k for k, x in enumerate(segs) if _HOUSE.fullmatch(x[0])), None)
    if at is not None and not (box and len(segs[at]) == 1):
        x = segs[at]
        number = x[0].lstrip("0") or "0"
        rest = x[1:]
        for y in segs[at + 1 :] if not rest else ():
            rest = rest + y
        if not rest and at:
            rest = segs[at - 1]
        direction, core, kind = _street(rest)
    if box:
        # a box needs its place; the street of such a record is a second address line
        return (place, zip_, box, "", "", "", "", "") if place or zip_ else None
    if not number or not core:
        return None
    return (place or (f"?{zip_}" if zip_ else (f"?{state}" if state else "")), zip_, "", number, direction, core, kind, unit)


@lru_cache(maxsize=50_000)
def _near_type(t: str) -> str:
    """Street type of a long misspelt type word."""
    if len(t) < 5:
        return ""
    got = {v for k, v in TYPES.items() if len(k) >= 5 and distance(t, k) <= 1}
    return got.pop() if len(got) == 1 else ""


@lru_cache(maxsize=50_000)
def _ordinal(t: str) -> str:
    m = re.fullmatch(r"(\d+)(?:st|nd|rd|th)", t)
    if m:
        return m.group(1)
    if t in _ORD:
        return _ORD[t]
    if len(t) >= 5:
        got = [v for k, v in _ORD.items() if abs(len(k) - len(t)) <= 1 and distance(t, k) <= 1]
        if len(got) == 1:
            return got[0]
    return t


_BLANKS = r"\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def ending(c: Column) -> Column:
    """Place, state and postcode at the end of a well-formed string, as written; else "", or null without digits."""
    tail = rf"([,;][A-Za-z{_BLANKS}.'-]++[,;][{_BLANKS}]*+[A-Za-z]{{2}}[,;]?[{_BLANKS}]++\d{{5}})(?:-\d{{4}})?[{_BLANKS}]*+(?:,|$)"
    return F.when(c.rlike(r"\d"), F.regexp_extract(c, tail, 1))


def learn(texts: DataFrame) -> list[tuple[str, str, str]]:
    """``learned`` from the strings of ``s``."""
    return learned(texts.groupBy(ending(F.col("s")).alias("e")).agg(F.count("*").alias("m")))


def learned(ends: DataFrame) -> list[tuple[str, str, str]]:
    """(postcode, place, state) by majority over the endings ``e`` of ``m`` strings each; at most 100,000 rows. Only different
    endings are tidied and taken apart."""
    rx = r"[,;]\s*([a-z][a-z .'-]+?)\s*[,;]\s*([a-z]{2})[,;]?\s+(\d{5})$"
    low = F.lower(F.regexp_replace("e", rf"[{_BLANKS}]+", " "))
    got = ends.select("m", F.split(F.regexp_replace(low, rx, "$3|$1|$2"), r"\|").alias("h")).where("size(h) = 3").select(F.col("h")[0].alias("z"), F.trim(F.col("h")[1]).alias("c"), F.col("h")[2].alias("st"), "m")
    n = got.groupBy("z", "c", "st").agg(F.sum("m").alias("n"))
    top = n.groupBy("z").agg(F.max_by(F.struct("c", "st"), F.struct("n", "c", "st")).alias("t"), F.max("n").alias("n"))
    rows = [(r["z"], r["t"]["c"], r["t"]["st"], r["n"]) for r in top.collect()]
    # a spelling that few postcodes have is a slip where a near one has many
    count: dict[tuple[str, str], int] = {}
    for _, c, st, k in rows:
        count[c, st] = count.get((c, st), 0) + k
    index: dict[str, list[str]] = {}
    for c, _ in count:
        for d in deletions(c.replace(" ", ""), 1):
            index.setdefault(d, []).append(c)
    out = []
    for z, c, st, _ in rows:
        near = [b for d in deletions(c.replace(" ", ""), 1) for b in index[d] if (b, st) in count and distance(b, c) <= 2 and count[b, st] > 20 * count[c, st]]
        out.append((z, max(near, key=lambda b: count[b, st]) if near else c, st))
    return out


def parsed(texts: DataFrame, rows: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(s, *FIELDS) of the distinct strings that state an address."""
    rows = learn(texts) if rows is None else rows
    shared = texts.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = Gazetteer(shared.value)
        for b in batches:
            out = [(s, *p) for s in b["s"] if (p := parse(s, g))]
            yield pd.DataFrame(out, columns=["s", *FIELDS])

    schema = "s string, " + ", ".join(f"{f} string" for f in FIELDS)
    return texts.select("s").mapInPandas(run, schema)


def _pair_cost(a: tuple, b: tuple) -> float | None:
    """Cost of assigning the components of ``a`` to those of ``b``; null where a veto holds.

    Tuples: (zip, dir, core, type, unit). Number and place are equal in a block.
    """
    if a[4] and b[4] and a[4] != b[4]:
        return None
    if a[0] and b[0] and a[0] != b[0]:
        return None
    if a[3] and b[3] and a[3] != b[3]:
        return None
    if a[1] and b[1] and a[1] != b[1]:
        return None
    cost = 0.0
    if a[2] != b[2]:
        if a[2].isdigit() or b[2].isdigit():
            return None
        x, y = a[2].replace(" ", ""), b[2].replace(" ", "")
        d = distance(x, y)
        if d > 2 or (d == 2 and min(len(x), len(y)) < 6):
            return None
        cost += d
    for k, w in ((0, 0.1), (1, 0.6), (3, 0.4), (4, 0.5)):
        if bool(a[k]) != bool(b[k]):
            cost += w
    return cost


class Lexicon:
    """Street names that many records share; a rare spelling near one of them stands for it."""

    def __init__(self, names: list[str]):
        self.names = set(names)
        self.near: dict[str, list[str]] = {}
        for name in self.names:
            if len(name) >= 5:
                for d in deletions(name.replace(" ", ""), 1):
                    self.near.setdefault(d, []).append(name)

    @lru_cache(maxsize=100_000)
    def fix(self, core: str) -> str:
        key = core.replace(" ", "")
        if core in self.names or len(key) < 4 or key.isdigit():
            return core
        got = sorted({(distance(key, n.replace(" ", "")), n) for d in deletions(key, 1) for n in self.near.get(d, ())})
        return got[0][1] if got and got[0][0] <= 2 and (len(got) == 1 or got[0][0] < got[1][0]) else core


#: A street name with more than this share of all records is in the lexicon, which so has at most 20,000 names.
LEXICON_SHARE = 1 / 20_000


def street_keys(core: str) -> set[str]:
    """Keys under which streets meet: the name with up to a letter left out; a number alone."""
    key = core.replace(" ", "")
    return {key} if key.isdigit() else deletions(key, 1)


def resolve(items: list[tuple]) -> list[int]:
    """Cluster numbers of the tuples (zip, dir, core, type, unit, n) of one block.

    Tuples are taken from the most to the least complete; each joins the location of least cost among
    those it fits, where every tuple that states more is a location of its own unless it fits one.
    A tuple that fits several locations equally well stays on its own.
    """
    full = lambda t: (sum(map(bool, (t[1], t[3], t[4], t[0]))), t[5], t)
    order = sorted(range(len(items)), key=lambda i: full(items[i]), reverse=True)
    index: dict[tuple, list[int]] = {}
    where = [-1] * len(items)
    heads: list[list] = []
    for i in order:
        t = items[i]
        near: set[int] = set()
        dels = street_keys(t[2])
        # a unit meets only its own number and locations without one, so towers stay cheap
        for d in dels:
            for u in (t[4], "") if t[4] else (None,):
                near.update(index.get((d, u), ()))
        fits = sorted((c, h) for h in near if (c := _pair_cost(t[:5], tuple(heads[h]))) is not None)
        if fits and (len(fits) == 1 or fits[0][0] < fits[1][0] - 1e-9 or _same_but(heads[fits[0][1]], heads[fits[1][1]])):
            h = fits[0][1]
            where[i] = h
            named = not heads[h][4] and t[4]
            for k in (0, 1, 3, 4):
                heads[h][k] = heads[h][k] or t[k]
            if named:
                for d in dels:
                    index.setdefault((d, t[4]), []).append(h)
        else:
            h = len(heads)
            heads.append(list(t[:5]))
            where[i] = h
        for d in dels:
            for u in {heads[h][4], None}:
                index.setdefault((d, u), []).append(h)
    return where


def _same_but(a: list, b: list) -> bool:
    """Two locations that differ only by what one of them leaves out."""
    return _pair_cost(tuple(a), tuple(b)) is not None


_ITEM = T.StructType([T.StructField(k, T.StringType()) for k in ("zip", "dir", "core", "type", "unit")] + [T.StructField("n", T.LongType()), T.StructField("id", T.LongType())])
_LOC = T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("loc", T.LongType())]))


def locations(tuples: DataFrame) -> DataFrame:
    """(id, loc) from distinct tuples (id, *FIELDS, n): ``loc`` is the smallest id of the location."""
    names = tuples.where("box = ''").groupBy("core").agg(F.sum("n").alias("n")).where("n >= 5")
    names = cut(names, "p7-streets")
    total = names.agg(F.sum("n")).first()[0] or 0
    shared = tuples.sparkSession.sparkContext.broadcast([r["core"] for r in names.where(F.col("n") > total * LEXICON_SHARE).collect()])
    held: dict[str, Lexicon] = {}

    @pandas_udf(_LOC)
    def run(blocks: pd.Series) -> pd.Series:
        if not held:
            held["x"] = Lexicon(shared.value)
        fix = held["x"].fix

        def one(b):
            items = [(x["zip"], x["dir"], fix(x["core"]), x["type"], x["unit"], x["n"]) for x in b]
            ids = [x["id"] for x in b]
            where = resolve(items)
            low: dict[int, int] = {}
            for i, w in zip(ids, where):
                low[w] = min(i, low.get(w, i))
            return [(i, low[w]) for i, w in zip(ids, where)]

        return blocks.map(one)

    @pandas_udf(T.ArrayType(T.StringType()))
    def keys(cores: pd.Series) -> pd.Series:
        if not held:
            held["x"] = Lexicon(shared.value)
        return cores.map(lambda c: sorted(street_keys(held["x"].fix(c))))

    # a box belongs to its place, or to its postcode where no place is known
    area = F.when(F.col("place") == "", F.concat(F.lit("?"), "zip")).otherwise(F.col("place")).alias("area")
    at = tuples.where("box != ''").select("id", area, "box")
    boxes = at.join(at.groupBy("area", "box").agg(F.min("id").alias("loc")), ["area", "box"]).select("id", "loc")
    streets = tuples.where("box = ''")
    size = streets.groupBy("place", "number").agg(F.count("*").alias("size"))
    one = streets.join(size.where(F.col("size") == 1).select("place", "number"), ["place", "number"]).select("id", F.col("id").alias("loc"))
    item = F.struct("zip", "dir", "core", "type", "unit", "n", "id")
    small = streets.join(size.where((F.col("size") > 1) & (F.col("size") <= BLOCK)).select("place", "number"), ["place", "number"])
    small = small.groupBy("place", "number").agg(F.collect_list(item).alias("b"))
    parts = [one, boxes, small.select(F.explode(run("b")).alias("r")).select("r.*")]
    if size.where(F.col("size") > BLOCK).limit(1).count():
        # larger blocks: tuples meet in resolve() only under a deletion of their streets, so what is connected by
        # these is resolved in one call, and gives what the whole block would give
        large = streets.join(size.where(F.col("size") > BLOCK).select("place", "number"), ["place", "number"])
        keyed = large.select(F.col("id").alias("p"), "place", "number", F.explode(keys("core")).alias("k"))
        member = cut(keyed.select("p", F.xxhash64("place", "number", "k").alias("g")), "p7-large")
        part = components(member, "p7-labels").select(F.col("p").alias("id"), "c")  # each id has memberships, so it has a row
        drop_cut(member)
        apart = large.join(part, "id").groupBy("c").agg(F.collect_list(item).alias("b"))
        parts.append(apart.select(F.explode(run("b")).alias("r")).select("r.*"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


ADDRESS_FIELDS = ("street_address", "mailing_address")


def records(table: DataFrame, key: str = "member_id") -> DataFrame:
    """(key, field, s): the address records of a table. Values that state no address are left out."""
    both = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("s")) for f in ADDRESS_FIELDS])
    got = table.select(key, F.explode(both).alias("a")).select(key, "a.field", "a.s")
    return got.where(F.col("s").isNotNull() & F.col("s").rlike(r"\d") & ~F.col("s").rlike(EMPTY))


def located(recs: DataFrame) -> DataFrame:
    """(s, loc, place, number): the location of each distinct string of the records that states an address."""
    texts = recs.groupBy("s").agg(F.count("*").alias("n"))
    parts = parsed(texts).withColumn("id", F.xxhash64(*FIELDS))
    parts = cut(parts, "p7-parts")
    tuples = parts.groupBy("id", *FIELDS).agg(F.count("*").alias("n"))
    return parts.select("s", "id", "place", "number").join(locations(tuples), "id").select("s", "loc", "place", "number")


def same_location(table: DataFrame) -> DataFrame:
    """(member_id_a, field_a, member_id_b, field_b): pairs of address records of one location with different strings.

    Null, blank and placeholder values are no records. Records that only a box number and place state
    are locations too. Repeated rows pair like any others where their strings differ.
    """
    recs = cut(records(table), "p7-records")
    loc = recs.join(located(recs).select("s", "loc"), "s").select("member_id", "field", "s", "loc")
    rows = loc.select(F.col("loc").alias("g"), F.xxhash64("s").alias("s"), "member_id", "field")
    got = differing(rows, ("member_id", "field"), "p7-rows").where("a < b")
    return got.select(F.col("a.member_id").alias("member_id_a"), F.col("a.field").alias("field_a"), F.col("b.member_id").alias("member_id_b"), F.col("b.field").alias("field_b"))
