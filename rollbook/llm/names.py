"""Variant spellings of company and person names.

Names are put into tries, sharded by evidence that two records may mean one entity (a phone, a place
and house number, a website host in a place, a mailbox). In each shard a Levenshtein automaton walks
the trie and enumerates the neighbours of each name within a bounded distance; token-order
permutations, initials and cut-off forms are then checked. A shard above ``SHARD`` different names is
divided by the keys of ``shard_keys``, under which every pair that the checks accept meets; initials are
judged when the sub-shards are merged.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

#: Different names up to which a shard is one trie.
SHARD = 300

# Short forms, legal forms, words without weight, trades, as names write them.
SHORT = {
    "plbg": "plumbing", "plumb": "plumbing", "htg": "heating", "clg": "cooling", "clng": "cleaning", "svcs": "services", "svc": "service", "acctg": "accounting", "ins": "insurance", "grp": "group",
    "constr": "construction", "const": "construction", "elec": "electric", "elect": "electric", "phys": "physical", "thpy": "therapy", "ofcs": "offices", "ofc": "office", "vet": "veterinary",
    "bros": "brothers", "assoc": "associates", "assocs": "associates", "ctr": "center", "centre": "center", "photo": "photography", "photog": "photography", "landscpg": "landscaping", "lndscpg": "landscaping",
    "mtn": "mountain", "vly": "valley", "rfg": "roofing", "stor": "storage", "strg": "storage", "bkry": "bakery", "no": "northern", "nthn": "northern", "mgmt": "management", "intl": "international", "natl": "national",
}
LEGAL = frozenset("inc incorporated llc ltd limited corp corporation co company lp llp plc pllc pc".split())
IDLE = frozenset("the and of by a an".split())
TRADE = frozenset(
    "plumbing electric bakery roofing storage veterinary clinic dental care photography landscaping glass construction insurance group law offices office physical therapy"
    " cleaning services service heating cooling auto center accounting associates".split()
)
_TRADES: dict[str, list[str]] = {}
for _w in sorted(TRADE):
    _TRADES.setdefault(_w[0], []).append(_w)
_DBA = re.compile(r"\b(?:d\s*/?\s*b\s*/?\s*a|d\.b\.a\.?|doing business as|t/a|trading as)\b\s*[:.]?\s*", re.I)
_CUT = re.compile(r"(?:…|\.\s?\.+)\s*$")
_ASIDE, _CAMEL = re.compile(r"\s*\([^()]*\)\s*$"), re.compile(r"(?<=[a-z])(?=[A-Z])")
_OWNER, _WORD = re.compile(r"'s\b|(?<=[a-z])'(?=s\b)"), re.compile(r"[a-z0-9]+")


def bare(s: str) -> str:
    """Without accents, zero-width characters and odd blanks; case as written."""
    if not s.isascii():
        s = unicodedata.normalize("NFKD", s)
        s = "".join(c for c in s if not unicodedata.combining(c) and c not in "\u200b\u200c\u200d\ufeff\u00ad").replace("’", "'").replace("‘", "'")
    return " ".join(s.split())


def cut_off(s: str) -> bool:
    """Ends in the dots of a name that was cut off."""
    s = s.rstrip()
    return s.endswith((".", "…")) and bool(_CUT.search(s))


@lru_cache(maxsize=100_000)
def company(name: str) -> tuple[str, str, bool]:
    """(core, trade, cut): distinguishing tokens in order, trade tokens, whether the end is missing."""
    s = bare(name)
    cut = cut_off(s)
    s = _CUT.sub("", s) if cut else s
    low = s.lower()
    m = list(_DBA.finditer(s)) if "/" in s or "dba" in low or "d b" in low or "db a" in low or "d.b" in low or "doing" in low or "trading" in low else []
    if m and s[m[-1].end() :].strip():
        s = s[m[-1].end() :]
    s = _ASIDE.sub("", s) if "(" in s else s
    s = _CAMEL.sub(" ", s) if not s.isupper() else s
    s = _OWNER.sub("s", s.lower()) if "'" in s else s.lower()
    tokens = [SHORT.get(t, t) for t in _WORD.findall(s)]
    tokens = [t for t in tokens if t not in IDLE or len(t) == 1]
    while len(tokens) > 1 and (tokens[-1] in LEGAL or tokens[-3:] == ["l", "l", "c"]):
        del tokens[-3 if tokens[-3:] == ["l", "l", "c"] else -1 :]
    words = [trade_word(t, k > 0) for k, t in enumerate(tokens)]
    trade = [w for w in words if w]
    core = [t for t, w in zip(tokens, words) if not w and t not in LEGAL]
    if not core:
        core, trade = tokens, []
    if cut and len(core) > 1 and (len(core[-1]) < 3 or any(w.startswith(core[-1]) for w in TRADE)):
        core = core[:-1]
    return " ".join(core), " ".join(sorted(trade)), cut


@lru_cache(maxsize=100_000)
def trade_word(t: str, later: bool = True) -> str:
    """The trade word that a token is or, misspelt or (in a later place) shortened, stands for."""
    if t in TRADE:
        return t
    if later and len(t) >= 3:
        for w in _TRADES.get(t[0], ()):
            if w.startswith(t):
                return w
    if len(t) >= 5:
        for w in _TRADES.get(t[0], ()):
            if len(w) >= 5 and within(t, w, 1 if len(w) < 7 else 2):
                return w
    return ""


def edits(a: str, b: str, most: int) -> int:
    """Edit distance, neighbour swaps counting one; ``most`` + 1 if larger. Only a band of cells is filled, so
    the cost grows with the length, not with its square."""
    if a == b:
        return 0
    n, m, over = len(a), len(b), most + 1
    # an edit changes at most two of the letters that occur
    if abs(n - m) > most or len(set(a).symmetric_difference(b)) > 2 * most:
        return over
    # what they begin and end with in common costs nothing
    k, end = 0, min(n, m)
    while k < end and a[k] == b[k]:
        k += 1
    while end > k and a[n - 1] == b[m - 1]:
        n, m, end = n - 1, m - 1, end - 1
    if k == n or k == m:
        return n + m - 2 * k
    a, b, n, m = a[k:n], b[k:m], n - k, m - k
    two: dict[int, int] = {}
    one = {j: j for j in range(min(m, most) + 1)}
    for i in range(1, n + 1):
        row, low, x = {}, over, a[i - 1]
        for j in range(max(0, i - most), min(m, i + most) + 1):
            d = one.get(j, over) + 1
            if j:
                y = b[j - 1]
                d = min(d, row.get(j - 1, over) + 1, one.get(j - 1, over) + (x != y))
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                    d = min(d, two.get(j - 2, over) + 1)
            row[j] = d
            low = min(low, d)
        if low > most:
            return over
        two, one = one, row
    return min(one.get(m, over), over)


def within(a: str, b: str, most: int) -> bool:
    return edits(a, b, most) <= most


class Trie:
    """Names as a trie; ``near`` walks it with the Levenshtein automaton of a word."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, item: int) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node.setdefault("", []).append(item)

    def near(self, word: str, most: int) -> set[int]:
        """Items of the words within ``most`` edits (swaps of neighbours count one).

        A state of the automaton is the band of edit counts around the depth, 2 * most + 1 cells wide. Along the
        word itself the counts are the differences of the depths, so only branches off it are counted.
        """
        out: set[int] = set()
        n, over = len(word), most + 1
        stack: list = []
        node, depth = self.root, 0
        while node:
            on = word[depth] if depth < n else None
            if len(node) > 1 or on not in node:
                lo, lo0, row0 = max(0, depth - most), max(0, depth - 1 - most), None
                row = [abs(depth - j) for j in range(lo, min(n, depth + most) + 1)]
                if depth:
                    row0 = [abs(depth - 1 - j) for j in range(lo0, min(n, depth - 1 + most) + 1)]
                for c, child in node.items():
                    if c == "":
                        if n - depth <= most:
                            out.update(child)
                    elif c != on:
                        stack.append(({c: child}, depth, lo, row, lo0, row0, word[depth - 1] if 0 < depth <= n else ""))
            node, depth = node.get(on), depth + 1
        while stack:
            node, depth, lo, row, lo0, row0, last = stack.pop()
            deep = depth + 1
            lo1, hi1, width = (deep - most if deep > most else 0), min(n, deep + most), len(row)
            for c, child in node.items():
                if c == "":
                    if 0 <= n - lo < width and row[n - lo] <= most:
                        out.update(child)
                    continue
                new, low, left = [], over, over
                for j in range(lo1, hi1 + 1):
                    k = j - lo
                    d = left + 1
                    if k < width and row[k] + 1 < d:
                        d = row[k] + 1
                    if k > 0:
                        y = word[j - 1]
                        if row[k - 1] + (c != y) < d:
                            d = row[k - 1] + (c != y)
                        if row0 is not None and j > 1 and last == y and c == word[j - 2] and 0 <= j - 2 - lo0 < len(row0) and row0[j - 2 - lo0] + 1 < d:
                            d = row0[j - 2 - lo0] + 1
                    new.append(d)
                    left = d
                    if d < low:
                        low = d
                if low <= most:
                    stack.append((child, deep, lo1, new, lo, row, c))
        return out

    def starting(self, prefix: str) -> set[int]:
        """Items of the words that begin with ``prefix``."""
        node = self.root
        for c in prefix:
            node = node.get(c)
            if node is None:
                return set()
        out: set[int] = set()
        stack = [node]
        while stack:
            for c, child in stack.pop().items():
                if c == "":
                    out.update(child)
                else:
                    stack.append(child)
        return out


def bound(word: str) -> int:
    """Edits allowed for a name of this length."""
    return 0 if len(word) < 4 else 1 if len(word) < 8 else 2


def initials(core: str) -> str:
    """Sorted first letters of the core's tokens; of an initials form, its letters."""
    ts = core.split()
    if len(ts) == 1 and 2 <= len(ts[0]) <= 3:
        return "".join(sorted(ts[0]))
    return "".join(sorted(t[0] for t in ts))


def abbreviated(core: str) -> bool:
    """Nothing but initials."""
    ts = core.split()
    return all(len(t) == 1 for t in ts) or (len(ts) == 1 and len(ts[0]) <= 3)


def dropped(word: str, most: int) -> set[str]:
    """``word`` with up to ``most`` characters left out."""
    out = now = {word}
    for _ in range(most):
        now = {w[:i] + w[i + 1 :] for w in now for i in range(len(w))}
        out = out | now
    return out


def _number(s: str) -> int:
    return int.from_bytes(blake2b(s.encode(), digest_size=8).digest(), "big")


def _rests(tokens: set[str]) -> list[tuple[int, str]]:
    """(number of the set without it, token) for each token."""
    each = {t: _number(t) for t in tokens}
    total = sum(each.values())
    return [((total - v) % 2**64, t) for t, v in each.items()]


def initial_keys(core: str) -> list[str]:
    """Keys under which initials meet the names they may stand for; a "t" for "The" may be missing on either side."""
    s = initials(core)
    return [s] if abbreviated(core) else sorted({s, s.replace("t", "", 1), "".join(sorted(s + "t"))})


#: Letters of a word that its deletion keys are taken from: words within an edit bound also meet by these.
REACH = 10


def shard_keys(core: str, cut: bool = False) -> list[str]:
    """Keys of a divided shard, led by the kind of check they serve: each pair that ``link_companies`` accepts shares one.

    e: the word and its sorted tokens with letters left out up to the edit bound; c: first letters, for names
    cut off; p: leading words; r: all tokens but one; i: initials.
    """
    ts = core.split()
    out = {"i" + k for k in initial_keys(core)}
    for w in {"".join(ts), "".join(sorted(ts))}:
        out.update("e" + d for d in dropped(w[:REACH], bound(w)))
        if len(w) >= 4:
            out.add("c" + w[:4])
    h, size = blake2b(digest_size=8), 0
    for t in ts:
        h.update(t.encode() + b" ")
        size += len(t)
        if size >= 6:
            out.add("p" + h.hexdigest())
    if len(set(ts)) > 1:
        out.update(f"r{k}" for k, _ in _rests(set(ts)))
    return sorted(out)


class Sets:
    """Numbers 0 to n - 1 in disjoint sets, known by their smallest; ``left`` is the number of sets."""

    def __init__(self, n: int):
        self.root = list(range(n))
        self.left = n

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.root[max(a, b)] = min(a, b)
            self.left -= 1

    def all(self) -> list[int]:
        return [self.find(i) for i in range(len(self.root))]


def _has_near(sizes: Counter, size: int, most: int) -> bool:
    """Another word than this one has a length within the bound."""
    return sum(sizes[size + d] for d in range(-most, most + 1)) > 1


#: Different words up to which each pair is compared, which then costs less than a trie.
FEW = 6


def near_words(words: list[str], most: Callable[[str], int]) -> Iterator[tuple[int, int]]:
    """(i, j): places of different words, the second within the bound of the first."""
    if len(words) <= FEW:
        bounds = [most(w) for w in words]
        for i, w in enumerate(words):
            for j in range(i):
                d = edits(w, words[j], max(bounds[i], bounds[j]))
                if d <= bounds[i]:
                    yield i, j
                if d <= bounds[j]:
                    yield j, i
        return
    sizes = Counter(map(len, words))
    trie = Trie()
    for i, w in enumerate(words):
        trie.add(w, i)
    for i, w in enumerate(words):
        if _has_near(sizes, len(w), most(w)):
            for j in trie.near(w, most(w)):
                if j != i:
                    yield i, j


def link_alike(names: list[tuple[str, bool]], kinds: str = "ecpr") -> list[int]:
    """Cluster numbers of distinct (core, cut) in one shard by the checks on pairs, of the kinds of ``shard_keys``.

    The checks only ever join, so they end once all names are one cluster.
    """
    sets = Sets(len(names))
    forms = [(core.replace(" ", ""), "".join(sorted(core.split()))) for core, _ in names]
    if {*kinds} & {*"ecp"}:
        at: dict[str, list[int]] = {}
        for i, (whole, perm) in enumerate(forms):
            for w in {whole, perm}:
                at.setdefault(w, []).append(i)
        words, trie = list(at), None
        for i, (whole, _) in enumerate(forms):
            core, cut = names[i]
            if sets.left > 1 and len(whole) >= (4 if cut else 6) and ("c" if cut else "p") in kinds:
                if len(words) > FEW and trie is None:
                    trie = Trie()
                    for k, w in enumerate(words):
                        trie.add(w, k)
                for k in trie.starting(whole) if trie else [k for k, w in enumerate(words) if w.startswith(whole)]:
                    for j in at[words[k]]:  # cut off, or the rest left out
                        if cut or names[j][0].startswith(core + " "):
                            sets.join(i, j)
        if "e" in kinds:
            for own in at.values():
                for j in own:
                    sets.join(own[0], j)
            for i, j in near_words(words, bound) if sets.left > 1 else ():
                sets.join(at[words[i]][0], at[words[j]][0])
                if sets.left == 1:
                    break
    if "r" in kinds and sets.left > 1:  # one token misspelt out of order
        words = [set(core.split()) for core, _ in names]
        by: dict[int, list[tuple[str, int]]] = {}
        for i, tokens in enumerate(words):
            if len(tokens) > 1:
                for k, t in _rests(tokens):
                    by.setdefault(k, []).append((t, i))
        for group in by.values():
            odd: dict[str, list[int]] = {}
            for t, i in group:
                odd.setdefault(t, []).append(i)
            if len(odd) > 1:
                tokens = sorted(odd)
                trie = Trie()
                for k, t in enumerate(tokens):
                    trie.add(t, k)
                for k, t in enumerate(tokens):
                    for o in trie.near(t, 2):
                        if o < k:
                            for i in odd[t]:
                                for j in odd[tokens[o]]:
                                    if sets.find(i) != sets.find(j) and words[i] - words[j] == {t} and words[j] - words[i] == {tokens[o]}:
                                        sets.join(i, j)
    return sets.all()


def link_initials(names: list[tuple[str, str, bool]], at: list[int]) -> list[tuple[int, int]]:
    """Pairs of sorted (core, trade, cut) that initials add to the clusters ``at``: with the only cluster they fit, else with like initials."""
    short: dict[str, list[int]] = {}
    by: dict[str, list[int]] = {}
    for i, (core, _, _) in enumerate(names):
        (short if abbreviated(core) else by).setdefault(initials(core), []).append(i)
    out = []
    for mine, own in short.items():
        pool = by.get(mine, []) + (by.get(mine.replace("t", "", 1), []) if "t" in mine else [])  # "The" may count
        for k, i in enumerate(own):
            trade = names[i][1]
            hits = {at[j]: j for j in pool if not trade or not names[j][1] or trade == names[j][1] or names[j][2]}
            if len(hits) == 1:
                out.append((i, *hits.values()))
            else:
                out.extend((i, j) for j in own[:k])
    return out


def link_companies(names: list[tuple[str, str, bool]]) -> list[int]:
    """Cluster numbers of distinct (core, trade, cut) in one shard."""
    # names of one core are one; only different cores go on
    heads: dict[str, bool] = {}
    for core, _, cut in names:
        heads[core] = heads.get(core, False) or cut
    if len(heads) == 1:
        return [0] * len(names)
    where = dict(zip(heads, link_alike(list(heads.items()))))
    first: dict[int, int] = {}
    at = [first.setdefault(where[core], i) for i, (core, _, _) in enumerate(names)]
    sets = Sets(len(names))
    for i, j in [*enumerate(at), *link_initials(names, at)]:
        sets.join(i, j)
    return sets.all()


# Nicknames by given name.
NICKNAMES = {
    "alexander": "alex sasha al xander", "andre": "dre", "anthony": "tony", "charles": "charlie chuck", "chloe": "clo", "daniel": "dan danny", "deborah": "deb debbie", "edward": "ed ted eddie ned",
    "elizabeth": "liz beth betsy lizzie eliza betty", "francisco": "frank paco pancho cisco", "gerald": "jerry gerry", "hiro": "", "ingrid": "inga", "james": "jim jimmy jamie", "jennifer": "jen jenny jenn",
    "jose": "pepe", "joseph": "joe joey", "katherine": "kate kathy katie kat kay", "kwame": "", "margaret": "maggie peggy meg marge", "michael": "mike mick mickey", "noor": "", "olena": "lena", "patricia": "pat patty trish tricia",
    "priya": "", "richard": "rick dick rich richie", "robert": "bob rob bobby robbie bert", "samantha": "sam sammy", "susan": "sue suzy susie suzie", "theodore": "ted teddy theo", "thomas": "tom tommy",
    "victoria": "vicky tori vic vicki", "william": "bill will billy willie liam", "zoe": "", "benjamin": "ben", "christopher": "chris", "jonathan": "jon", "matthew": "matt", "nicholas": "nick", "rebecca": "becky", "steven": "steve", "stephen": "steve",
}
_NICK: dict[str, set[str]] = {}
for _full, _short in NICKNAMES.items():
    for _w in [_full, *_short.split()]:
        _NICK.setdefault(_w, set()).add(_full)
TITLES = frozenset("mr mrs ms miss dr rev prof sir hon attn".split())
CREDENTIALS = frozenset("cpa dds esq mba pe md phd jd rn dvm od dc pt lpc cfp ea do aia np pa".split())
_SAID, _AFTER, _ATTN = re.compile(r"\([^()]*\)|\"[^\"]*\"|“[^”]*”"), re.compile(r"\s+-\s+.*$"), re.compile(r"^\s*attn\s*[:.]?\s*", re.I)
_OTHER = re.compile("[^a-z]")
GENERATIONS = {"sr": "sr", "senior": "sr", "jr": "jr", "junior": "jr", "ii": "ii", "iii": "iii", "iv": "iv"}


@lru_cache(maxsize=100_000)
def person(name: str) -> tuple[str, str, str] | None:
    """(first, last, generation) of a person's name; null where it has no two parts."""
    s = bare(name)
    # plain tests come before patterns
    s = _SAID.sub(" ", s) if "(" in s or '"' in s or "“" in s else s
    s = _AFTER.sub("", s) if "-" in s else s
    s = _ATTN.sub("", s) if "attn" in s.lower() else s
    parts = [p.split() for p in s.lower().replace(".", " ").split(",") if p.strip()]
    gen = ""
    kept = []
    for p in parts:
        p = [t for t in p if t.strip("'-")]
        for t in p:
            gen = GENERATIONS.get(t, gen) if t in GENERATIONS else gen
        p = [t for t in p if t not in GENERATIONS and t not in TITLES]
        if p and not all(t in CREDENTIALS for t in p):
            kept.append([t for t in p if t not in CREDENTIALS] or p)
    if len(kept) >= 2:
        last, first = kept[0][-1], kept[1][0]
    elif kept and len(kept[0]) >= 2:
        first, last = kept[0][0], kept[0][-1]
    else:
        return None
    letters = lambda t: t if t.isascii() and t.isalpha() else _OTHER.sub("", t)
    return (letters(first), letters(last), gen)


@lru_cache(maxsize=100_000)
def given(a: str, b: str) -> int:
    """0: different, 1: an initial of the other, 2: same name, nickname or slip."""
    if a == b:
        return 2
    if len(a) == 1 or len(b) == 1:
        return int(bool(a and b) and (a[0] == b[0] or any(x[0] == y[0] for x in _NICK.get(a, {a}) for y in _NICK.get(b, {b}))))
    if _NICK.get(a, {a}) & _NICK.get(b, {b}):
        return 2
    if a in _NICK and b in _NICK:
        return 0
    if within(a, b, 1) or (min(len(a), len(b)) >= 5 and within(a, b, 2)):
        return 2
    # a misspelt nickname or full name
    for x, y in ((a, b), (b, a)):
        for full in _NICK.get(x, ()):
            if within(full, y, 1) or any(len(n) >= 4 and within(n, y, 1) for n in NICKNAMES[full].split()):
                return 2
    return 0


def last_bound(last: str) -> int:
    """Edits allowed for a last name."""
    return 1 if len(last) < 8 else 2


def last_keys(last: str) -> list[str]:
    """Keys of a divided shard: last names within their bound share one."""
    return sorted(dropped(last[:REACH], last_bound(last)))


def near_lasts(lasts: list[str]) -> list[list[int]]:
    """The other items whose last names are within the bound of each item's. Each different last name is looked up once."""
    at: dict[str, list[int]] = {}
    for i, last in enumerate(lasts):
        at.setdefault(last, []).append(i)
    different, hits = list(at), {last: list(own) for last, own in at.items()}
    for i, j in near_words(different, last_bound):
        hits[different[i]] += at[different[j]]
    for own in hits.values():
        own.sort()
    return [[j for j in hits[last] if j != i] for i, last in enumerate(lasts)]


def link_persons(names: list[tuple[str, str, str]]) -> list[int]:
    """Cluster numbers of distinct (first, last, generation) in one shard (a business or a mailbox)."""
    n = len(names)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    if n == 1:
        return [0]
    near = near_lasts([last for _, last, _ in names])

    def gens(i: int) -> set[str]:
        r = find(i)
        return {g for j, (_, _, g) in enumerate(names) if g and find(j) == r}

    for i, (first, _, gen) in enumerate(names):
        for j in near[i]:
            if j < i and given(first, names[j][0]) == 2 and gen == names[j][2]:
                root[find(i)] = find(j)
    # a name without generation joins the one of its kin that has one, if there is only one
    for i, (first, _, gen) in enumerate(names):
        if not gen:
            kin = {find(j) for j in near[i] if names[j][2] and given(first, names[j][0]) == 2}
            if len(kin) == 1 and not gens(i):
                root[find(i)] = kin.pop()
    # initials join the one person they fit
    for i, (first, _, gen) in enumerate(names):
        if len(first) == 1:
            fits = {find(j) for j in near[i] if len(names[j][0]) > 1 and given(first, names[j][0]) and (not gen or not gens(j) or gen in gens(j))}
            if len(fits) == 1:
                root[find(i)] = fits.pop()
    # swapped order without a comma
    index = {k: i for i, k in enumerate(names)}
    for i, (first, last, gen) in enumerate(names):
        j = index.get((last, first, gen), i)
        if j < i and find(i) != find(j):
            root[find(i)] = find(j)
    return [find(i) for i in range(n)]
