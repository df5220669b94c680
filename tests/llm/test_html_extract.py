"""Extraction from pages of several hand-made templates, and vectors against a plain count."""

import collections
import html
import random

import pytest

from watchtide.llm import html_extract as H

TEMPLATES = {
    "article": '<html><head><title>{t}</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/x">{x}</a></ul></nav><div class="ad">{x}</div><article><h1>{t}</h1>{body}<div class="share">Share this</div></article><section id="comments"><p>{x}</p><p>{x}</p></section><footer>&copy; {x}</footer></body></html>',
    "plain": '<body><div class="top-menu"><a>one</a> {x}</div><div id="wrap"><div class="side-bar sidebar"><p>{x}</p></div><div class="txt"><h2>{t}</h2>{body}</div><form><label>{x}</label><input></form></div><div class="cookie-notice">We use cookies {x}</div></body>',
    "main": '<body><div role="banner">{x}</div><main><h1>{t}</h1>{body}<aside><p>{x}</p></aside><article class="comment"><p>{x}</p></article></main><script>var a = "<p>{x}</p>";</script></body>',
}


def page(rnd, make, template):
    blocks = [make(rnd.randint(5, 40)) + rnd.choice([" & co", " <b>", ' "q"', ""]) for _ in range(rnd.randint(2, 6))]
    title = make(4)
    body = "".join(rnd.choice(["<p>{}</p>", "<p><b>{}<br>", "<p>{}\n", "<blockquote>{}</blockquote>"]).format(html.escape(b)) for b in blocks)
    return TEMPLATES[template].format(t=title, body=body, x=make(rnd.randint(1, 6))), "\n".join([title, *blocks])


@pytest.fixture
def pages(prose):
    rnd, make = prose(10)
    rows = []
    for k, name in enumerate(TEMPLATES):
        for i in range(12):
            raw, text = page(rnd, make, name)
            rows.append((100 * k + i, f"https://{name}.example:80/{i}", raw, text))
    raw, text = page(rnd, make, "article")
    rows.append((900, "http://alone.example/", raw, text))  # a host with one page
    return rows


def extracted(spark, rows):
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, host string").repartition(3)
    out = H.extract(df)
    assert out.columns == [*df.columns, "_text"]
    return [(r["page_id"], r["_text"]) for r in out.collect()]


def test_main_text_of_each_template(spark, pages):
    got = dict(extracted(spark, [r[:3] for r in pages]))
    for i, _, _, text in pages:
        assert got[i] == text, i


def test_templates_are_joined_when_they_are_too_large_to_broadcast(spark, pages, monkeypatch):
    monkeypatch.setattr(H, "BROADCAST_BYTES", -1)
    got = dict(extracted(spark, [r[:3] for r in pages]))
    assert all(got[i] == text for i, _, _, text in pages)


def test_defined_cases(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "http://A.b/x", "<p>One &amp; two&nbsp; &#233;&eacute; &am &copy</p>"), (3, "http://a.b/x", "<p>One"), (4, "http://a.b/y", "just text < 5 > 3"), (5, "http://c/", "<div>ends in <a hre"), (6, "http://c/", "<!-- x <p>no"), (7, "http://c/", "<script>x</scr"), (8, "http://d/", "<p>" + "long " * 50000), (9, "http://e/", "<div>a<br>b<p>c<li>d<li>e</div></div></b>"), (10, "http://f/", '<div hidden>no</div><p title="a>b">yes <span style="display: none">no</span>!</p>'), (None, "http://g/", "<p>x<p>y")]
    got = sorted(extracted(spark, rows), key=str)
    want = [(1, ""), (2, ""), (3, "One & two éé &am ©"), (3, "One"), (4, "just text < 5 > 3"), (5, "ends in"), (6, ""), (7, ""), (8, ("long " * 50000).strip()), (9, "a b\nc\nd\ne"), (10, "yes !"), (None, "x\ny")]
    assert got == sorted(want, key=str)
    assert extracted(spark, []) == []


def test_equal_vectors_are_one_class(spark, prose):
    rnd, make = prose(11)
    rows, vectors = [], collections.defaultdict(dict)
    for i in range(20):
        parts = "".join(f"<div class='k{chr(97 + c)}'><p>{make(3)}</p></div>" * n for c, n in enumerate([1, i % 3, (i % 3) * 2, 1, i % 3]))
        rows.append((i, f"http://h/{i}", f"<body>{parts}</body>"))
        for e in H.parse(rows[-1][2]).elements[1:]:
            vectors[e.path][i] = vectors[e.path].get(i, 0) + 1
    got = H.tokens(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).where("path IS NOT NULL").collect()
    found, want = collections.defaultdict(set), collections.defaultdict(set)
    for r in got:
        assert (r["pages"], r["total"]) == (len(vectors[r["path"]]), sum(vectors[r["path"]].values()))
        found[r["pages"], r["low"], r["high"]].add(r["path"])
    for path, v in vectors.items():
        want[tuple(sorted(v.items()))].add(path)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def test_text_repeated_on_nearly_all_pages_is_template(spark, prose):
    rnd, make = prose(12)
    rows = [(i, f"http://h/{i}", f"<body><article><p>Sign up for more</p><p>{make(20)}</p></article></body>") for i in range(12)]
    got = dict(extracted(spark, rows))
    assert all("Sign up" not in got[i] and len(got[i].split()) == 20 for i in range(12))
    few = dict(extracted(spark, rows[:4]))
    assert all(t.startswith("Sign up") for t in few.values())


def test_copies_of_a_page_are_not_a_template(spark, prose):
    rnd, make = prose(13)

    def raw(x, y=""):
        return f"<body><nav>{make(2)}</nav><article><h1>{x[0]}</h1><p>{x[1]}</p></article><!-- {y} --></body>"

    a, b, c = [(make(3), make(30)) for _ in range(3)]
    one = raw(a)
    rows = [(i, f"http://h/{i}", one) for i in range(18)] + [(18, "http://h/18", raw(b)), (19, "http://h/19", raw(c))]  # equal pages, 90 % of the host
    rows += [(20 + i, f"http://i/{i}", raw(a, i)) for i in range(12)]  # different pages with the same article
    rows += [(40 + i, f"http://j/{i}", one) for i in range(7)] + [(50 + i, f"http://k/{i}", one) for i in range(8)]  # on both sides of PAGES
    got = dict(extracted(spark, rows))
    want = {r[0]: "\n".join(b if r[0] == 18 else c if r[0] == 19 else a) for r in rows}
    assert got == want
    counted = {r["host"]: r["pages"] for r in H.tokens(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).where("token = 0").collect()}
    assert counted == {"h": 3, "i": 12, "j": 1, "k": 1}
    assert {r["host"]: r["pages"] for r in H.tokens(spark.createDataFrame([(1, "http://l/", None), (2, "http://l/x", ""), (3, "http://l/y", "<p>z")], "page_id long, url string, html string")).where("token = 0").collect()} == {"l": 2}


def test_templates_that_only_some_pages_of_a_host_have(spark, prose):
    rnd, make = prose(14)
    forms = [
        '<body><div class="line">Welcome to the first part</div><div class="alpha"><h1>{t}</h1><p>{b}</p><p class="who">Written by our team</p></div><div class="low">All of it since 1999</div></body>',
        '<body><div class="line">The second part says hello</div><div class="beta"><div class="txt"><h1>{t}</h1><p>{b}</p><p>{b}</p></div></div><div class="low">Back to the start</div></body>',
        '<body><div class="line">Third</div><main><h1>{t}</h1><p>{b}</p></main></body>',
    ]
    rows, want = [], {}
    for i in range(36):
        t, b = make(3), make(30)
        rows.append((i, f"http://h/{i}", forms[i % 3].format(t=t, b=b)))
        want[i] = "\n".join([t, b, b] if i % 3 == 1 else [t, b])
    for i in range(100, 130):  # one template; an element on some pages is a part of its main element, also if it holds most
        t, b = make(3), make(4)
        part = make(40) if i % 3 == 0 else ""
        rows.append((i, f"http://i/{i}", f'<body><div class="all"><h1>{t}</h1><p>{b}</p>' + (f'<div class="long">{part}</div>' if part else "") + "</div></body>"))
        want[i] = "\n".join(x for x in (t, b, part) if x)
    t, b = make(3), make(30)
    for i in range(200, 230):  # ten pages are alike but for a date
        mine = (t, b) if i % 3 == 0 else (make(3), make(30))
        rows.append((i, f"http://j/{i}", f'<body><div class="all {"topic" if i % 3 == 0 else "rest"}"><h1>{mine[0]}</h1><p>{mine[1]}</p><p>{i}</p></div></body>'))
        want[i] = "\n".join([*mine, str(i)])
    got = dict(extracted(spark, rows))
    assert {i: got[i] for i in want if got[i] != want[i]} == {}


NAMES = {
    "body": ('<body class="right-sidebar has-header"><nav>{x}</nav><div class="txt">{b}</div><div class="sidebar">{x}</div></body>', ""),
    "state": ('<body><nav>{x}</nav><div class="post comments-open">{b}</div><div class="comments">{x}</div></body>', ""),
    "article": ('<body><article class="post has-related legal">{b}</article><div class="legal-notice">{x}</div></body>', ""),
    "form": ('<body><form id="all"><nav>{x}</nav><article>{b}</article><label>{x}</label></form></body>', ""),
    "only a form": ('<body><form id="all"><nav>{x}</nav><div>{b}</div><input></form></body>', ""),
    "layout": ('<body><div class="layout right-sidebar"><main><article class="post legal">{b}</article></main><div class="sidebar-box">{x}</div></div></body>', ""),
    "price": ('<body><article><div class="share-price">12.50</div>{b}<div class="share-buttons">{x}</div></article></body>', "12.50\n"),
    "holders": ('<body><div class="txt">{b}</div><div class="adSlot">{x}</div><div id="cookie-banner">{x}</div><div class="related-posts">{x}</div><div class="page-header">{x}</div></body>', ""),
}


@pytest.mark.parametrize("name", NAMES)
def test_names_that_hold_the_article(prose, name):
    _, make = prose(15)
    form, first = NAMES[name]
    a, b, x = make(30), make(20), make(4)
    page = H.parse(form.format(b=f"<p>{a}</p><p>{b}</p>", x=x))
    assert H.main_text(page, None) == f"{first}{a}\n{b}"


def test_names_stand_where_no_article_is_lost(prose):
    _, make = prose(16)
    a, long = make(6), make(200)
    for form in [
        '<body><article>{a}</article><section class="comments"><p>{long}</p></section></body>',
        '<body><article>{a}</article><div class="comment-list"><article>{long}</article></div></body>',
        '<body><div class="txt">{a}</div><div class="ad">{long}</div></body>',
        '<body><div class="txt">{a}</div><div class="sidebar"><p>{long}</p></div><form>{long}</form></body>',
        '<body><p>{a}</p><article class="comment">{long}</article></body>',
    ]:
        assert H.main_text(H.parse(form.format(a=a, long=long)), None) == a
    assert H.main_text(H.parse(f'<body><div class="ad">{long}</div><div class="cookies">{long}</div></body>'), None) == ""


def test_names_are_told_by_their_last_word():
    known = frozenset(["share", "related", "sidebar"])
    yes = ["share", "post share", "share-buttons", "shareBox", "right-sidebar", "x_related_posts_list", "Sidebar2"]
    no = ["share-price", "has-related", "no-sidebar", "related-to-nothing", "shared", "box", ""]
    assert [bool(H._named(n, known)) for n in yes + no] == [True] * len(yes) + [False] * len(no)


def test_columns_with_any_names(spark):
    df = spark.createDataFrame([(1, "http://a/", "<p>x", 5, "m", "old", 2.5)], "_host long, url string, html string, _main int, `a.b` string, _text string, _shared double")
    out = H.extract(df)
    assert out.columns == ["_host", "url", "html", "_main", "a.b", "_shared", "_text"]
    assert [tuple(r) for r in out.collect()] == [(1, "http://a/", "<p>x", 5, "m", 2.5, "x")]
