"""Scalar rules of records as column expressions; all run in whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollbook.functions import rules


def ws(c: Column) -> Column:
    """Runs of any white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9]", "")


def filled(c: Column) -> Column:
    """A string that is neither null nor empty."""
    return c.isNotNull() & (c != "")


def null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def any_word(c: Column, words: list[str]) -> Column:
    """True where one of the words occurs anywhere."""
    return c.rlike("|".join(r"\Q" + w + r"\E" for w in words))


def phone_format(c: Column) -> Column:
    """``(AAA) BBB-CCCC`` of ten digits, or eleven that begin with 1; else the trimmed text or null."""
    d = digits(c)
    ten = F.when(F.length(d) == 10, d).when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10))
    nice = F.concat(F.lit("("), F.substring(ten, 1, 3), F.lit(") "), F.substring(ten, 4, 3), F.lit("-"), F.substring(ten, 7, 4))
    return F.coalesce(nice, null_if_empty(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")))


def website_normalize(c: Column) -> Column:
    """http addresses stay, bare domains get ``https://``, anything else is null."""
    bare = c.rlike(r"(?U)^[\w.-]+\.[a-z]{2,}")
    return F.when(c == "", c).when(c.startswith("http"), c).when(bare, F.concat(F.lit("https://"), c))


def category_text(c: Column) -> Column:
    """Null where the category is a path or an address."""
    return F.when(~(c.startswith("/") | c.rlike(r"^https?://")), c)


def name_key(c: Column) -> Column:
    """Key under which spellings of one business name meet."""
    k = ws(F.regexp_replace(F.regexp_replace(ws(F.lower(c)), ",", " "), r"\.", ""))
    k = F.regexp_replace(k, r"[.,;:!?\-\s]+$", "")
    for full, short in rules.SUFFIXES.items():
        k = F.regexp_replace(k, rf"(^| ){full}$", f"$1{short}")
    return k


def export_key(c: Column) -> Column:
    """Key of the export merge: blanks collapsed, dots and commas off both ends, lower case."""
    return F.lower(F.regexp_replace(ws(F.coalesce(c, F.lit(""))), r"^[.,]+|[.,]+$", ""))


def is_label(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), "^:+|:+$", "")
    s = F.lower(F.regexp_replace(s, "^[ \\t\"'*•·\\-—]+|[ \\t\"'*•·\\-—]+$", ""))
    return c.isNull() | (s == "") | s.isin(*rules.LABEL_WORDS)


def is_false_name(c: Column) -> Column:
    s = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    prefix = s.rlike("^(?:" + "|".join(rules.FALSE_NAME_PREFIXES) + ")")
    return c.isNull() | (s == "") | s.contains("?") | s.isin(*rules.GENERIC_WORDS) | any_word(s, rules.FALSE_NAME_PHRASES) | prefix


def person_email(c: Column) -> Column:
    """Address without ``mailto:`` and query, lower case; salvaged from text around it; null if none."""
    s = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    s = F.when(F.lower(s).startswith("mailto:"), F.trim(F.regexp_replace(F.substring(s, 8, 10_000), r"\?.*$", ""))).otherwise(s)
    return null_if_empty(F.regexp_extract(F.lower(s), r"[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}", 0))


_NOISE = r"(?i)^(?:dr|mr|mrs|ms|prof|rev)\.?\s+|[,\s]+(?:md|dds|dmd|phd|cpa|esq|mba|pe|rn|do|dc)\.?$"


def person_parts(c: Column) -> Column:
    """``first|last`` of a name without titles and credentials; null if it has fewer than two parts."""
    s = F.trim(c)
    for _ in range(3):
        s = F.trim(F.regexp_replace(s, _NOISE, ""))
    p = F.split(F.trim(F.regexp_replace(s, r"[,.\s]+", " ")), " ")
    return F.when(F.size(p) >= 2, F.concat_ws("|", p[0], F.element_at(p, -1)))


def state_of(c: Column) -> Column:
    """Two capitals before five digits."""
    return null_if_empty(F.regexp_extract(c, r"\b([A-Z]{2})\s+\d{5}", 1))


def host_of(c: Column) -> Column:
    """Lower-case host without ``www.``."""
    return null_if_empty(F.regexp_replace(F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"www\.", ""))


def path_of(c: Column) -> Column:
    return F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def host_root(h: Column) -> Column:
    return F.when(F.length(F.regexp_replace(h, "[^.]", "")) >= 2, F.substring_index(h, ".", -2)).otherwise(h)


def in_domains(h: Column, domains: list[str]) -> Column:
    """The host or a parent domain of it is in the list."""
    return h.rlike(r"(?:^|\.)(?:" + "|".join(d.replace(".", r"\.") for d in domains) + ")$")


def url_clean(c: Column) -> Column:
    """A pasted address with wrapping signs off and a lower-case scheme; null where it is no web address."""
    s = F.trim(F.regexp_replace(F.trim(c), "^[<>\"']+|[<>\"']+$", ""))
    s = F.when(s.startswith("//"), F.concat(F.lit("https:"), s)).otherwise(s)
    scheme = F.lower(F.regexp_extract(s, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    s = F.when(scheme == "", F.concat(F.lit("https://"), s)).when(scheme.isin("http", "https"), F.concat(scheme, F.regexp_extract(s, r"^[^:]*(://.*)$", 1)))
    host = F.regexp_extract(s, r"^https?://(?:[^@/?#]*@)?([^/?#:]*)", 1)
    ok = (host != "") & ~F.regexp_extract(s, r"^https?://([^/?#]*)", 1).contains(" ") & (host.contains(".") | (host == "localhost"))
    return F.when(ok, s)


def url_template(c: Column) -> Column:
    """The address with its varying parts as ``{ID}``."""
    base = F.regexp_replace(F.regexp_replace(c, r"(?i)(?<=[?&])(?:n?page|pagenum(?:ber)?|pg|paging)=\d+&?", ""), r"[?&]+$", "")
    t = F.regexp_replace(base, r"(?i)([?&]\w*id\w*=)\d+", "$1{ID}")
    t = F.regexp_replace(t, r"([?&]\w+=)\d{4,}", "$1{ID}")
    t = F.regexp_replace(t, r"/\d{3,}(?=/|$|\?)", "/{ID}")
    t = F.regexp_replace(t, r"(?i)/[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "/{ID}")
    slug = F.regexp_replace(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^/?#]*)*?)/(?=[^/?#]{4,}/?(?:[?#]|$))[^/?#]*[-_][^/?#]*(/?(?:[?#].*)?)$", "$1/{ID}$2")
    return F.when(t == base, slug).otherwise(t)


def url_uid(c: Column) -> Column:
    return F.coalesce(
        null_if_empty(F.regexp_extract(c, r"[/#]([0-9a-f]{24})(?:/|$)", 1)),
        null_if_empty(F.regexp_extract(c, r"(?i)[?&]\w*id\w*=(\d+)", 1)),
        F.regexp_extract(c, r"/(\d{3,})(?:/|$|\?)", 1),
    )


def company_words(c: Column) -> Column:
    """Distinct weighty words of a name, sorted."""
    w = F.split(F.trim(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]|\s+", " ")), r"\s+")
    return F.array_sort(F.array_distinct(F.filter(w, lambda x: ~x.isin(*rules.BUSINESS_SUFFIXES) & ((F.length(x) >= 3) | x.rlike(r"^\d{2,}$")))))


def log_category(c: Column) -> Column:
    s = F.lower(F.trim(c))
    out = F.lit("LOG")
    for name, words in reversed(rules.LOG_CATEGORIES):
        out = F.when(any_word(s, words), name).otherwise(out)
    return out


def email_tier(prefix: Column) -> Column:
    """Rank of a mailbox by its local part; smaller is better."""
    out = F.when(prefix.isin(*rules.EMAIL_TIERS[0]), 0).when(prefix.isin(*rules.EMAIL_TIERS[1]), 1).when(prefix.isin(*rules.EMAIL_TIERS[2]), 2)
    return out.when(prefix.isin(*rules.EMAIL_LOW), 8).when(prefix.rlike("[._]"), 3).when(prefix.rlike("^[a-z]{3,}$"), 4).otherwise(9)


def layout_fingerprint(card: Column, keys: Column) -> Column:
    """Sixteen hex digits of the SHA-1 of the card selector and the sorted field names."""
    return F.substring(F.sha1(F.concat(card, F.lit("|"), F.array_join(F.array_sort(keys), ","))), 1, 16)
