from rollbook.operators import cards, pages

CARD = '<li><h4>Ann &amp; Co</h4><p>12 Oak St, Ironton, OH 10720</p><p>Ph 290-612-3456</p><p>Fax: (290) 612-9999</p><a href="mailto:a@ann.example?x">write</a><a href="https://maps.google.com/maps/x">map</a><a href="//ann.example/">site</a></li>'


def test_card():
    card = pages.tree(CARD).kids[0]
    assert cards.by_patterns(card, "guild.example") == {"company_name": "Ann & Co", "phone": "290-612-3456", "fax": "(290) 612-9999", "email": "a@ann.example", "website": "//ann.example/", "street_address": "12 Oak St, Ironton, OH 10720"}
    assert cards.by_patterns(pages.tree(""), "") == dict.fromkeys(cards.FIELDS)
    odd = pages.tree('<div><h2>x@y.example</h2><b>http://z</b><a href="tel:1">1234</a><a href="/p">Name</a><p>see www.q.example</p><p>Rear</p><p>Ironton OH 10720</p></div>')
    assert cards.name(odd) == "Name" and cards.website(odd, "") == "http://www.q.example" and cards.address(odd) == "Rear, Ironton OH 10720"


def test_listing_and_fallback():
    html = "<nav><ul>" + "<li><a href='/'>x</a></li>" * 9 + "</ul></nav><ul id='all'>" + CARD * 4 + "</ul>"
    css, found = cards.listing(pages.tree(html))
    assert css == "ul#all > li" and len(found) == 4
    assert [r["company_name"] for r in cards.fallback(html)] == ["Ann & Co"] * 4
    deep = "".join(f"<div><div><section><h3>Firm {i}</h3>290-612-34{i}0 Ironton OH 10720</section></div></div>" for i in range(3))
    assert [r["company_name"] for r in cards.fallback(deep)] == ["Firm 0", "Firm 1", "Firm 2"]
    assert cards.fallback("<p>nothing</p>") == [] and cards.listing(pages.tree(""))[1] == []


def test_samples_and_classes():
    few = pages.select(pages.tree("<i class='m'><a href='/a'>a</a></i>" + "<i class='m'>290-612-3456</i>" + "<i class='m x'><a href='/'>b</a> 290-612-3456 a@b.example<img></i>"), "i")
    assert cards.diverse(few) == [0, 2] and cards.diverse([]) == []
    some = pages.select(pages.tree("<p class='row longer-name card-a'></p><p class='card-a longer-name'></p>"), "p")
    assert cards.shared_classes(some) == ["card-a", "longer-name"]
    assert cards.group_score("odd", few) < cards.group_score("member", few)


def test_detail_pages():
    html = '<html><head><meta name="description" content="' + "d" * 600 + '"></head><body><header><a href="tel:1">1</a></header><main><div class="b"><h1>Ann</h1><p>Phone 290-612-3456</p><p><a href="mailto:a@ann.example">m</a></p></div><div>Other</div></main></body></html>'
    root = pages.tree(html)
    assert cards.panel(root).classes == ["b"] and len(cards.description(root)) == 500
    assert cards.detail(html, {"company_name": "h1", "email": ".b a@href", "phone": ".none"}) == {"company_name": "Ann", "email": "a@ann.example", "phone": None}
    ent = lambda n: f'<script type="application/ld+json">{{"name": "{n}", "telephone": "1"}}</script>'
    assert cards.entity(ent("A"))["company_name"] == "A" and cards.entity(html) is None
    assert cards.page_bundle(ent("A") + html)["company_name"] == "A" and cards.page_bundle(html)["email"] == "a@ann.example"
    ok = lambda rs: all(r.get("company_name") for r in rs)
    assert cards.pick_mode([ent("A"), ent("B")], None, ok) == "jsonld" and cards.pick_mode([ent("A"), ent("A")], None, ok) is None
    assert cards.pick_mode([html], {"company_name": "h1"}, ok) == "layout" and cards.pick_mode([html], {"company_name": "h9"}, ok) is None and cards.pick_mode([html], None, ok) == "patterns"
