"""Cards and detail pages without a learned layout: values by pattern, groups of like cards, panels, embedded entities.

Works on one page at a time, whole, in the batches of ``pages``; nothing is kept between pages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame

from rollbook.operators import pages
from rollbook.operators.pages import Node

# Patterns of values in cards, classes and words that speak for a card, hosts that are no member's site.
PHONE = re.compile(r"(?:\+?1[\s.\-]?)?(?:\(\d{3}\)[\s.\-]?|\d{3}[\s.\-])\d{3}[\s.\-]?\d{4}")
MAIL = re.compile(r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b")
HOST = re.compile(r"(?:https?:)?//([^/?#]*)")
WWW = re.compile(r"\bwww\.[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b")
STATE_ZIP = re.compile(r"\b[A-Z]{2}\s+\d{5}(?:-\d{4})?\b")
STREET = re.compile(r"\b\d+\s+[A-Za-z0-9 .'#\-]+?\s(?:St|Street|Ave|Avenue|Rd|Road|Blvd|Boulevard|Dr|Drive|Ln|Lane|Way|Ct|Court|Pl|Place|Pkwy|Parkway|Hwy|Highway|Cir|Circle|Ter|Terrace)\b[^\n]{0,60}?,\s*[A-Z]{2}\s+\d{5}(?:-\d{4})?\b")
CARD_WORDS = ("member", "listing", "card", "result", "company", "directory", "profile", "vendor", "supplier", "contractor", "provider", "business", "entry", "item")
CONTACT_WORDS = ("tel:", "mailto:", "phone", "email", "address", "fax", "website")
LAYOUT_CLASSES = frozenset("row col container wrapper grid flex clearfix odd even first last active inner outer content block".split())
ELSEWHERE = ("facebook.com", "twitter.com", "x.com", "linkedin.com", "instagram.com", "youtube.com", "google.com", "yelp.com", "pinterest.com", "tiktok.com")
BOILERPLATE = ("cookie", "all rights reserved", "privacy policy", "javascript", "copyright")
FIELDS = ("company_name", "phone", "fax", "email", "website", "street_address")


def _lines(node: Node) -> str:
    return "\n".join(x.strip() for x in node.texts() if x.strip())


def _hrefs(node: Node, found: list[Node]) -> list[str]:
    return [n.attrs["href"] for n in (node, *found) if n.tag == "a" and n.attrs.get("href")]


def _links(node: Node) -> list[Node]:
    return [n for n in ([node] if node.tag == "a" else []) + list(node.walk()) if n.tag == "a" and n.attrs.get("href")]


def phone_fax(text: str) -> tuple[str | None, str | None]:
    """The first phone number and the first that "fax" stands before within twenty characters."""
    phone = fax = None
    for m in PHONE.finditer(text):
        if "fax" in text[max(0, m.start() - 20) : m.start()].lower():
            fax = fax or m[0].strip()
        else:
            phone = phone or m[0].strip()
    return phone, fax


def address(node: Node) -> str | None:
    """A street with state and postcode; else the line that has these, with the short line before it."""
    return _address(node.text(), _lines(node))


def _address(text: str, lines: str) -> str | None:
    if not STATE_ZIP.search(text):  # part of a street with state and postcode, too
        return None
    m = STREET.search(text)
    if m:
        return m[0].strip()
    each = lines.split("\n")
    for i, line in enumerate(each):
        if STATE_ZIP.search(line):
            got = re.sub(r"\s+", " ", ", ".join([*(x for x in each[max(i - 1, 0) : i] if len(x) < 100), line]))
            if len(got) > 10:
                return got
    return None


def _mail_in(text: str) -> str | None:
    m = MAIL.search(text) if "@" in text else None
    return m[0] if m else None


def email(node: Node) -> str | None:
    """The first mail link that is an address, else the first address in the text."""
    return _email(_hrefs(node, list(node.walk())), _lines(node))


def _email(hrefs: list[str], lines: str) -> str | None:
    for href in hrefs:
        if href.startswith("mailto:"):
            got = href[7:].split("?")[0].strip()
            if MAIL.match(got):
                return got
    return _mail_in(lines)


def website(node: Node, own: str) -> str | None:
    """The first link to another site that is no platform or map, else an address in the text."""
    return _website(_hrefs(node, list(node.walk())), _lines(node), own)


def _website(hrefs: list[str], lines: str, own: str) -> str | None:
    for href in hrefs:
        m = HOST.match(href)
        host = m[1].lower() if m else ""
        if host and not (own and own in host) and not any(host == p or host.endswith("." + p) for p in ELSEWHERE) and "/maps/" not in href.lower() and "directions" not in href.lower():
            return href
    m = WWW.search(lines) if "www." in lines else None
    return "http://" + m[0] if m else None


def name(node: Node) -> str | None:
    """The first heading, bold text or link that is more than a letter and neither a mail nor a web address."""
    return _name(list(node.walk()))


def _name(found: list[Node]) -> str | None:
    def usable(s: str) -> bool:
        return len(s) > 1 and not ("@" in s and MAIL.fullmatch(s)) and not s.lower().startswith(("http://", "https://", "www."))

    first: dict[str, Node] = {}
    for n in found:
        first.setdefault(n.tag, n)
    for tag, most in (("h1", 0), ("h2", 0), ("h3", 0), ("h4", 0), ("h5", 0), ("strong", 200), ("b", 200)):
        if tag in first and usable(s := first[tag].text()) and (not most or len(s) < most):
            return s
    for a in [n for n in found if n.tag == "a"][:5] if "a" in first else ():
        if not a.attrs.get("href", "").startswith(("mailto:", "tel:")) and usable(s := a.text()) and len(s) < 200:
            return s
    return None


def description(root: Node) -> str | None:
    """The page's own summary, else the first paragraph long enough, of main parts before others; 500 characters."""
    return _description(list(root.walk()))


def _description(found: list[Node]) -> str | None:
    metas = [n for n in found if n.tag == "meta"]
    for key, value in (("name", "description"), ("property", "og:description")):
        for n in metas:
            s = n.attrs.get("content", "").strip()
            if n.attrs.get(key) == value and len(s) >= 30 and not any(b in s.lower() for b in BOILERPLATE):
                return s[:500]
    main = [p for tag in ("main", "article", "section") for n in found if n.tag == tag for p in n.walk() if p.tag == "p"]
    for group, least in ((main, 50), ([p for p in found if p.tag == "p"], 80)):
        for p in group:
            if len(s := p.text()) >= least and not any(b in s.lower() for b in BOILERPLATE):
                return s[:500]
    return None


def by_patterns(card: Node, own: str = "") -> dict:
    """A record of one card or page by patterns alone."""
    found, lines = list(card.walk()), _lines(card)
    phone, fax = phone_fax(lines)
    hrefs = _hrefs(card, found)
    return {"company_name": _name(found), "phone": phone, "fax": fax, "email": _email(hrefs, lines), "website": _website(hrefs, lines, own), "street_address": _address(card.text(), lines)}


def signature(card: Node) -> frozenset:
    """Which signals a card carries: mail, phone, link, image."""
    text, links = card.text(), [a.attrs["href"] for a in _links(card)]
    have = {"email": MAIL.search(text) or any(h.startswith("mailto:") for h in links), "phone": PHONE.search(text), "link": any(not h.startswith(("mailto:", "tel:", "#", "javascript:")) for h in links), "img": any(n.tag == "img" for n in card.walk())}
    return frozenset(k for k, v in have.items() if v)


def diverse(cards: list[Node], most: int = 5) -> list[int]:
    """Places of samples that show each signal: the first card, the richest, up to three that add one."""
    if not cards:
        return []
    sigs = [signature(c) for c in cards]
    rich = max(range(len(cards)), key=lambda i: (len(sigs[i]), -i))
    chosen, seen, added = {0, rich}, sigs[0] | sigs[rich], 0
    for i, s in enumerate(sigs):
        if len(chosen) >= most or added == 3:
            break
        if i not in chosen and s - seen:
            chosen.add(i)
            seen |= s
            added += 1
    return sorted(chosen)


def group_score(cls: str, cards: list[Node]) -> int:
    """How likely like elements are the listing: number, class, text, links and contact words of the first six."""
    few = cards[:6]
    texts, links = [len(c.text()) for c in few], [len(_links(c)) for c in few]
    contact = sum(w in (c.text() + " ".join(a.attrs["href"] for a in _links(c))).lower() for c in few for w in CONTACT_WORDS)
    mean = sum(texts) / len(few)
    score = 2 * min(len(cards), 50) + 50 * any(w in cls.lower() for w in CARD_WORDS) + min(int(mean / 10), 30) + 5 * sum(n > 0 for n in links) + 3 * contact
    return score - 40 * (mean < 50) - 30 * (sum(links) / len(few) > 10) - 100 * (cls.lower() in LAYOUT_CLASSES)


def shared_classes(cards: list[Node]) -> list[str]:
    """Classes of at least 95 % of the cards: those that speak for cards first, then longer ones, then by letter."""
    n = Counter(c for card in cards for c in set(card.classes))
    good = [c for c, k in n.items() if k >= 0.95 * len(cards) and re.fullmatch(r"-?[_a-zA-Z][\w-]*", c) and c.lower() not in LAYOUT_CLASSES]
    return sorted(good, key=lambda c: (not any(w in c.lower() for w in CARD_WORDS), -len(c), c))


def listing(root: Node) -> tuple[str | None, list[Node]]:
    """Selector and cards of the best group of like elements: marked entities first, then classes, then like siblings."""
    best: tuple[float, str | None, list[Node]] = (0, None, [])
    groups: dict[tuple[str, str], list[Node]] = {}
    kids: dict[int, tuple[Node, dict[str, list[Node]]]] = {}
    for n in root.walk():
        if n.tag in pages.JUNK or n.tag in ("a", "span", "p", "br", "option"):
            continue
        if re.search(r"(?i)localbusiness|organization|person|place", n.attrs.get("itemtype", "")):
            groups.setdefault((n.tag, "[itemtype]"), []).append(n)
        for c in n.classes:
            groups.setdefault((n.tag, "." + c), []).append(n)
        if not n.classes and n.up is not None and n.tag in ("li", "tr", "div", "article"):
            kids.setdefault(id(n.up), (n.up, {}))[1].setdefault(n.tag, []).append(n)
    for (tag, rest), cards in groups.items():
        if len(cards) >= 3:
            score = group_score(rest[1:], cards) + 100 * (rest == "[itemtype]")
            best = max(best, (score, f"{tag}{rest}", cards), key=lambda x: x[0])
    if best[0] < 20:
        for up, by in kids.values():
            at = up.tag + ("#" + up.attrs["id"] if up.attrs.get("id") else "." + up.classes[0] if up.classes else "")
            for tag, cards in by.items():
                if len(cards) >= 3:
                    best = max(best, (group_score("", cards), f"{at} > {tag}", cards), key=lambda x: x[0])
    return best[1], best[2]


def fallback(html: str, own: str = "") -> list[dict]:
    """Records without a layout: of the best group's cards, else of the deepest elements with enough contact signals."""
    root = pages.tree(html)
    got = [r for c in listing(root)[1] if (r := by_patterns(c, own))["company_name"]]
    if len(got) >= 3:
        return got
    hit: list[Node] = []
    for n in root.walk():
        if n.tag in ("div", "li", "tr", "article", "td", "section") and 20 <= len(text := _lines(n)) <= 2000:
            links = [a.attrs["href"] for a in _links(n)]
            points = 2 * bool(PHONE.search(text)) + 2 * bool(MAIL.search(text) or any(h.startswith("mailto:") for h in links)) + 2 * any(h.startswith("tel:") for h in links)
            if points + bool(STATE_ZIP.search(text)) + bool(name(n)) + 2 * any("itemprop" in k.attrs for k in n.walk()) >= 3:
                hit.append(n)
    above = set()
    for n in hit:
        up = n.up
        while up is not None and id(up) not in above:
            above.add(id(up))
            up = up.up
    got = [r for n in hit if id(n) not in above and (r := by_patterns(n, own))["company_name"]]
    return got if len(got) >= 3 else []


def panel(root: Node) -> Node:
    """The part of a detail page about its member: the smallest element around all contact signals, else the main part,
    else the largest table or division."""
    return _panel(root, list(root.walk()))


def _signals(node: Node) -> bool:
    """Whether a node is a phone or mail link or holds a phone number or mail address itself."""
    if node.attrs.get("href", "").startswith(("tel:", "mailto:")):
        return True
    for k in node.kids:
        if isinstance(k, str) and (len(k) > 10 and PHONE.search(k) or "@" in k and MAIL.search(k)):
            return True
    return False


def _panel(root: Node, found: list[Node]) -> Node:
    found = [n for n in found if n.tag not in pages.JUNK]
    signals = [n for n in found if _signals(n)]
    paths = []
    for n in signals:
        path = [n]
        while path[-1].up is not None:
            path.append(path[-1].up)
        if not any(p.tag in pages.JUNK for p in path):
            paths.append(path[::-1])
    if paths:
        common = [x[0] for x in zip(*paths) if all(y is x[0] for y in x)]
        if len(paths) == 1:
            common = common[:-1] or common
        if common[-1].tag not in ("#", "html", "body"):
            return common[-1]
    main = next((n for css in ("main", "article", "#content", ".content") for n in pages.select(root, css)), None)
    return main or max((n for n in found if n.tag in ("table", "div")), key=lambda n: len(n.text()), default=root)


def detail(html: str, fields: dict[str, str]) -> dict:
    """One record of a detail page under absolute selectors; ``@href`` takes a link's target."""
    root = pages.tree(html)
    out = {}
    for f, css in fields.items():
        sel, _, want = css.partition("@")
        hit = pages.select(root, sel)
        v = pages._value(hit[0], want == "href") if hit else None
        out[f] = re.sub(r"^(?:mailto:|tel:)", "", v).split("?")[0] if v and want == "href" and v.startswith(("mailto:", "tel:")) else v or None
    return out


def entity(html: str) -> dict | None:
    """The embedded entity with most fields, the first on a tie."""
    return _entity(list(pages.tree(html).walk()))


def _entity(found: list[Node]) -> dict | None:
    return max(pages.embedded(found), key=lambda r: sum(bool(v) for v in r.values()), default=None)


def page_bundle(html: str, own: str = "") -> dict:
    """What a page says of one business: patterns, with the embedded entity's values before them."""
    root = pages.tree(html)
    found = list(root.walk())
    out = by_patterns(_panel(root, found), own) | {"description": _description(found)}
    for f, v in (_entity(found) or {}).items():
        out[f] = v or out.get(f)
    for n in found:  # without cycles, nodes are freed at once and not by the garbage collector
        n.up = None
    return out


def pick_mode(samples: list[str], fields: dict[str, str] | None, valid: Callable[[list[dict]], bool]) -> str | None:
    """How to read detail pages: embedded entities of different names, a known layout, patterns, or both merged; the
    first whose records are valid. A known layout that does not fit ends the search."""
    ents = [e for h in samples if (e := entity(h))]
    if len({e["company_name"] for e in ents}) >= 2 and valid(ents):
        return "jsonld"
    if fields:
        return "layout" if valid([detail(h, fields) for h in samples]) else None
    return "patterns" if valid([by_patterns(panel(pages.tree(h))) for h in samples]) else None


def _rows(records: list[dict]) -> list[tuple]:
    return [tuple(r[f] for f in FIELDS) for r in records]


_SCHEMA = ", ".join(f"{f} string" for f in FIELDS)


def cards_by_patterns(df: DataFrame, css: str) -> DataFrame:
    """(page_id, pos, fields) of each element that ``css`` selects."""
    return pages._map(df, _SCHEMA, lambda h: _rows([by_patterns(c) for c in pages.select(pages.tree(h), css)]))


def records_without_layout(df: DataFrame) -> DataFrame:
    """(page_id, pos, fields): records of pages for which no layout is known."""
    return pages._map(df, _SCHEMA, lambda h: _rows(fallback(h)))


def listings(df: DataFrame) -> DataFrame:
    """(page_id, selector, cards, classes): the best group of each page."""

    def one(html: str) -> list[tuple]:
        css, cards = listing(pages.tree(html))
        return [(css, len(cards), " ".join(shared_classes(cards)))]

    return pages._map(df, "selector string, cards int, classes string", one).drop("pos")


def bundles(df: DataFrame) -> DataFrame:
    """(page_id, fields, description) of detail pages."""
    cols = (*FIELDS, "description")
    return pages._map(df, ", ".join(f"{c} string" for c in cols), lambda h: [tuple(map(page_bundle(h).get, cols))]).drop("pos")
