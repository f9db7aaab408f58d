"""Template residue, filler, error-page and notice text in place of content.

Placeholders are found by one small grammar per delimiter (``{{x}}``, ``{x}``, ``${x}``, ``%x%`` and so
on) around one identifier, never around written words, so braces and brackets in real sentences do not
count. Code blocks are cut out first, and in a text that talks about template syntax a placeholder near such
words counts only where placeholders make up much of the text. All other kinds must make up the field: their patterns are anchored at
its start, after markup. Everything is a JVM-side regular expression in one pass over the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# possessive loops: any length, and no recursion in the JVM's matcher
_ID = r"[A-Za-z_][A-Za-z0-9_]*+(?:[.\-][A-Za-z_][A-Za-z0-9_]*+)*+"
_TAGS = r"(?:/?(?:p|br|b|i|u|em|strong|span|div|a|ul|ol|li|h[1-6]|hr|img|table|tr|td|th|code|pre|small|sup|sub)\b)"
#: One grammar per delimiter.
PLACEHOLDERS = [
    rf"\{{\{{\{{?\s*[#/^&>]?\s*{_ID}(?:\s*+\|\s*+\w++)*+\s*\}}\}}\}}?",
    rf"\{{%-?\s*{_ID}\s*-?%\}}",
    rf"[$#]\{{\s*{_ID}\s*\}}",
    rf"\{{!\s*{_ID}\s*!?\}}",
    rf"\{{\s*{_ID}\s*\}}",
    rf"\[\[\s*{_ID}\s*\]\]",
    rf"\[(?!sic\]){_ID}\]",
    rf"<[%?]=?\s*\$?{_ID}\s*[%?]>",
    rf"(?:<(?!{_TAGS})|&lt;(?!{_TAGS})){_ID}(?:>|&gt;)",
    r"(?:<|&lt;)(?:Your |Insert )?[A-Z][a-z]+ (?:Name|Here|Title|Phone|City|Address)(?:>|&gt;)",
    rf"%%\s*{_ID}\s*%%",
    rf"(?<![0-9%])%{_ID}%(?!\w)",
    rf"\*\|\s*{_ID}\s*\|\*",
    rf"@@{_ID}@@",
    r"(?<![A-Za-z0-9_])__[A-Za-z_][A-Za-z0-9_.\-]*?[A-Za-z0-9]__(?![A-Za-z0-9_])",
    rf"(?<![A-Za-z0-9~])~{_ID}~(?![A-Za-z0-9])",
    rf"(?<![A-Za-z0-9$])\$[A-Za-z_][A-Za-z0-9_.]*\$",
]
PLACEHOLDER = "|".join(f"(?:{p})" for p in PLACEHOLDERS)
_CODE = r"(?s)```.*?```|`[^`\n]+`|<(code|pre)\b.*?</\1>|&lt;(code|pre)\b.*?&lt;/\2&gt;"
_TUTORIAL = r"(?i:\b(?:syntax|tutorial|snippet|merge tags?|template (?:language|engine|variable|tag)s?|literally|placeholder (?:such as|like|looks))\b)"
#: A placeholder within this many characters of such words is one that the text talks about.
CONTEXT = 80
#: Share of a text from which on its placeholders count in spite of such words.
DENSE = 0.4
#: A placeholder that no such word is near. Signs come first, so that little is looked at twice.
_APART = rf"(?s)(?=[{{\[<%*@_~$#]|&lt;)(?<!{_TUTORIAL}.{{0,{CONTEXT}}})(?:{PLACEHOLDER})(?!.{{0,{CONTEXT}}}{_TUTORIAL})"

_JS = r"(?:java ?script|js|scripts?|scripting)"
_SEE = r"(?:page|listing|profile|directory|map|app|site|record|member|content|details)"
_STATUS = (
    r"(?:page not found|not found|(?:that|this) page can.?t be found|access denied|forbidden|bad gateway|bad request|gateway timed? ?out|gateway timeout"
    r"|internal server error|service (?:temporarily )?unavailable|too many requests|sign-?in needed|unauthori[sz]ed|this listing is gone|gone|request timed? ?out)"
)
#: Messages and filler, anchored at the start of the field.
MESSAGES = [
    # filler and sample text
    r"lorem ipsum\b",
    r"(?:this is )?sample text\b.*(?:replace|your own|\d)",
    r"your text (?:goes )?here",
    r"tell visitors what makes you",
    r"short bio coming",
    r"enter a short (?:summary|description|bio)",
    r"description (?:to be supplied|goes here|coming)",
    r"add (?:a|your) (?:short )?(?:description|bio|summary|text)\b.*\bhere\b",
    r"(?:click|double-click|tap) (?:here )?to (?:edit|add|change)\b",
    r"x{3,}+(?:\s++x{2,}+)*+(?:\s+todo.*)?$",
    r"todo\b.*\b(?:copy|text|client|write)",
    r"coming soon[.!…]*$",
    r"\[?(?:insert|enter|add|put) (?:your |the )?(?:business|company|member|firm|organi[sz]ation|display|listing)(?:'s)? (?:name|title)(?: here)?\]?$",
    r"your (?:business|company|firm|organi[sz]ation) name(?: here)?$",
    r"(?:sample|test|example|dummy) (?:company|business|listing|member|record|entry|firm)\s*(?:#?\(?\d+\)?)?$",
    r"test (?:listing|entry|record|member)\b.*\b(?:ignore|delete|test)",
    r"untitled(?: (?:listing|member|page|record|business|entry))?\s*(?:\(?#?\d+\)?)?$",
    r"(?:new|unnamed) (?:listing|member|entry) ?\(?#?\d+\)?$",
    # printed non-values
    r"(?:(?:undefined|null|nan|none|nil)[,;\s]*){1,50}(?:undef\w{0,4}|nul|non)?$",
    r"\[object \w+\]",
    r"object \{.*\}?$",
    r"function ?\w*\(.*\) ?\{",
    # program errors
    r"(?:uncaught )?(?:type|reference|syntax|range|key|value|attribute|name|index)error\b\s*[:(]",
    r"traceback\b.*(?:error|most recent)",
    r"(?:php )?(?:warning|notice|fatal error|parse error|deprecated)\s*:\s*(?:undefined|call to|uncaught|cannot|array|invalid|unexpected|division|trying|include|require|syntax|mysql|allowed)",
    r"error establishing a data\w*",
    r"(?:unhandled )?exception\b.*\bat line\b",
    rf"(?:http|error|status|code)[ #:]*[1-5]\d\d\b",
    rf"[1-5]\d\d\s*[-:|–]?\s*{_STATUS}\b",
    rf"(?:sorry|oops|whoops|uh[- ]oh)[,!.:\s]+.{{0,30}}{_STATUS}\b",
    rf"{_STATUS}\s*[|(:\-–]\s*(?:error )?[1-5]\d\d\b",
    rf"{_STATUS}[.!]*$",
    # waiting and browser checks
    r"(?:loading|please wait)\s*(?:…|\.\.\.|[.!]*$)",
    rf"loading (?:[a-z]+ )?(?:{_SEE}s?|reviews|members|data|results)\b.*please wait",
    r"just a moment\s*(?:…|\.\.\.|,? we\b|[.!]*$)",
    r"checking (?:your|if the site|the) (?:browser|connection)",
    rf"verify (?:that )?you are (?:a )?human\b",
    r"unusual traffic\b",
    r"(?:please )?(?:complete|solve) the (?:captcha|puzzle|security check)",
    # sign-in
    r"your session (?:has )?(?:expired|timed out)",
    rf"this {_SEE} is (?:for|only for|visible to|reserved for) members\b",
    r"(?:please )?(?:log|sign) in to (?:see|view|continue|read)\b",
    r"you must be (?:logged|signed) in\b",
    # consent
    r"we (?:and our partners )?use cookies\b",
    r"by (?:clicking|using|continuing)\b.*\bcookies\b",
    r"this (?:web ?site|site|page) uses cookies\b",
    # parked
    r"this (?:domain|web ?site|site)(?: name)? (?:is|may be|has been) (?:parked|for sale|available|expired|suspended)",
    r"(?:buy|purchase) this domain\b",
    # scripts
    rf"(?:please |you (?:need|have|must) (?:to )?)?(?:enable|turn on|activate|switch on|allow) {_JS}\b(?:$| (?:to|in|for|and|on)\b)",
    rf"you (?:need|have) to (?:enable|turn on|activate|switch on|allow) {_JS}\b",
    rf"{_JS} (?:must be|is|has to be|needs to be|are) (?:active|enabled|required|disabled|turned on|turned off|switched off|switched on|needed|off)\b",
    rf"this (?:content|{_SEE}) (?:needs|requires) {_JS}\b",
    rf"your browser (?:has {_JS} (?:switched|turned) off|does not (?:support|run) {_JS}|is not running {_JS})",
    rf"noscript\b\s*:",
]
#: A message cut off in the middle still counts; these starts are long enough to be certain.
_MESSAGE = r"(?is)^(?:" + "|".join(f"(?:{m})" for m in MESSAGES) + ")"


def _bare(c: Column) -> Column:
    """Without zero-width characters, markup tags and outer white space, quotes read as written."""
    s = F.regexp_replace(c, r"[\u200b\u200c\u200d\ufeff\u00ad]", "")
    s = F.regexp_replace(s, r"(?i)</?(?:p|br|b|i|em|strong|span|div|h[1-6])\b[^<>]*>|&nbsp;", " ")
    return F.regexp_replace(F.regexp_replace(s, r"(?U)\s+", " "), r"^[ >*#\-–]+| +$", "")


#: Signs without which there is no placeholder.
_SIGNS = r"[{}\[\]<>%*@_~$#]|&lt;"
#: What ``_bare`` changes; any other text is tidy.
_UNTIDY = r"[<\u200b\u200c\u200d\ufeff\u00ad\t-\r\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|(?i)&nbsp;|^[ >*#\-–]|  | $"


def is_residue(c: Column) -> Column:
    """True where the text is residue; null and blank texts give false.

    Cheap guards decide first, so clean texts cost one scan for signs and one anchored match.
    """
    s = F.coalesce(c, F.lit(""))
    plain = F.regexp_replace(s, _CODE, " ")
    left = F.length(F.regexp_replace(plain, PLACEHOLDER, ""))
    dense = (F.length(plain) - left) >= DENSE * F.length(plain)
    told = s.rlike(_TUTORIAL) & ~dense
    marked = F.when(s.rlike(_SIGNS), F.when(told, plain.rlike(_APART)).otherwise(plain.rlike(PLACEHOLDER))).otherwise(F.lit(False))
    tidy = F.when(s.rlike(_UNTIDY), _bare(s)).otherwise(s)
    return marked | tidy.rlike(_MESSAGE)


FIELDS = ("description", "company_name")


def find_residue(members: DataFrame) -> DataFrame:
    """(member_id, field): each field with residue. Rows without either field give nothing; equal rows repeat."""
    hits = F.array_compact(F.array(*[F.when(is_residue(F.col(f)), F.lit(f)) for f in FIELDS]))
    return members.select("member_id", F.explode(hits).alias("field"))


def without_residue(members: DataFrame) -> DataFrame:
    """The table with residue fields set to null."""
    return members.withColumns({f: F.when(~is_residue(F.col(f)), F.col(f)) for f in FIELDS})
