import pytest

from rollbook.llm import residue

BAD = [
    "{{company_name}} of Ironton", "Contact {LISTING.TITLE} today", "Need $TITLE$ now", "at %PHONE% for", "[city] firm", "[[owner]]", "<%= x %>", "<?= $listing.title ?>", "&lt;ORG&gt;", "<Company Name>",
    "__city__", "~OWNER_NAME~", "*|tagline|*", "@@x@@", "{!city!}", "#{city}", "${owner}", "{% town %}", "%%serviceArea%%", "<p>[[business.name]]</p>",
    "Lorem ipsum dolor sit", "This is sample text 18. Replace it with your own words.", "undefined, undefined undefined", "[object Object]", "NaN", "None None", "TypeError: cannot read properties of undefined",
    "Error 403: access denied", "404 Page Not Found", "TOO MANY REQUESTS | 429", "Sorry, sign-in needed (401)", "Oops! Service unavailable.", "Loading…", "Please enable JS to view this map.",
    "noscript: JavaScript is required", "Your session has expired. Sign in again", "We use cookies. Accept all / R", "This domain is parked. Ask the", "Test Listing - please ignore", "Your Business Name", "Untitled Listing (46)",
]
GOOD = [
    None, "", "  ", "Braces {clear or metal} fitted; [the first visit is free].", "Prices from $40 to $90, deposit $20 [cash or check].", "Save 10% in spring and 20% in fall; the #1 choice.", "<p>Framing and drawings.</p>",
    "Loading Dock Grill", "Null Island Travel", "Undefined Studio", "Error Theory Climbing", "Not Found Antiques", "Access Granted Locksmiths", "Sample Room Wines", "Error-free bookkeeping: if a page is not found, we fix it.",
    "We write JavaScript for small shops and enable online booking.", "Use `{{name}}` as it stands.", "In this template language, {{name}} prints a name, for example in letters to members of a club.", "A cut-off tex...",
]


@pytest.mark.parametrize("texts, want", [(BAD, True), (GOOD, False)])
def test_texts(spark, texts, want):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.t for r in df.select("t", residue.is_residue(df.t).alias("x")).collect() if r.x != want] == []


def test_table(spark):
    df = spark.createDataFrame([(1, "NaN", "{x}", "c"), (1, "NaN", "{x}", "c"), (2, None, "word " * 40_000, "c"), (3, "A", "B", "c"), (4, None, "undefined " * 50_000, "c"), (5, None, "{" + "a." * 50_000, "c"), (6, None, "{{ a" + " | b" * 50_000, "c"), (7, None, "<" * 50_000 + "`" * 50_001, "c")], "member_id long, company_name string, description string, field string")
    assert sorted(map(tuple, residue.find_residue(df).collect())) == [(1, "company_name")] * 2 + [(1, "description")] * 2
    assert residue.find_residue(df.limit(0)).count() == 0
    assert {r.company_name for r in residue.without_residue(df).collect()} == {None, "A"}
