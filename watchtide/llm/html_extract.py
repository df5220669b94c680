"""Main text of web pages by equivalence-class template deduction.

A page's tokens are its structural elements, told apart by their path, and its text runs, by path and text. A token's
occurrence vector says how often each page of the host has it. Tokens of one host with the same vector are one equivalence
class. Tokens that nearly all pages share are the host's template; further classes that hold an element are templates
of the pages that carry them, so that a host can have several. A text run is template if it is in such a class, or on nearly
all pages that have its element; what else lies in a template's main element (an article, or else the deepest that
holds most of the text) are slots. Slots are extracted, without parts whose element, role, class or id says that
they are menus, adverts, comments and the like.

A class or id says so only by its last word, or by one that names of holders follow (`ad-slot`, not `share-price` or
`comments-open`), and not after a word of state (`has-related`); never on html, body or main. What classes, ids and
forms say is doubted where it would leave too little of the page: then an article that holds a fair share of the text
counts, whatever it and what lies around it are called, comments apart, and so does a form around nearly all.

Vectors are never collected: each page adds a number made from itself and its count, so equal sums mean
equal vectors, and hosts of any size are sums with partial aggregation. Pages are not shuffled, apart from those that a
host has more than once, unless the templates of all hosts, or the list of such pages, are too large to be broadcast.

Defined cases: a null or empty page has no text; a page without the template's main element, or of a host without
a template, is read by the same rules on its own; a null url is the host of its own name; equal
pages of one host count once towards its template, and each has its text; template text that would leave nothing of a
main element stays, and so does that of a class which holds more than `MOST` of it (pages alike, not a template); a tag that the page ends in is dropped; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from watchtide.llm.text import pick, steps
from watchtide.session import cut_lineage

#: Share of a host's pages that a template token is on.
SUPPORT = 0.9
#: Pages that a host needs before repeated text counts as template.
PAGES = 8
#: A class on fewer than one in so many pages of the host is no template of it.
TEMPLATES = 256
#: Share of a page's text that its main element holds; for an element that says it is an article.
MOST, SAID = 0.7, 0.4
#: Share of a page's text that a form must leave, unless an article is there.
LEFT = 0.1
#: Templates of all hosts are broadcast up to this size, and joined beyond it.
BROADCAST_BYTES = 32 << 20
#: Tokens that a counting task holds before it sends them on.
HELD = 200_000

#: Names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe plaintext".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = frozenset("html body table ul ol dl select article section div nav main aside footer header".split())
#: Elements, roles, and words of classes and ids that mark what is not main text.
ASIDE_TAGS = frozenset("head nav footer aside form button select option textarea input label noscript iframe object svg canvas dialog menu template script style audio video map".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ASIDE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar widget widgets related recommended share sharing social cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search comment comments commentlist reply replies respond disqus pagination pager toolbar hidden skip copyright legal disclaimer".split())
#: Words that may follow those: what holds such things is called by both.
HOLDERS = frozenset("area bar block body bottom box button buttons card container content group head header heading icon icons inner item items left link links list main outer panel placeholder post posts right row section slot text title top unit wrap wrapper zone".split())
#: Words that make a name one of state: the element has such a part, or has none.
STATES = frozenset("has have no not non with without is are show shows hide hides".split())
#: Names of reader comments; these stand, however much they hold.
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus".split())
UNNAMED_TAGS = frozenset("html body main".split())
PAGE_HEAD_WORDS = frozenset("header banner topbar".split())
MAIN_TAGS, MAIN_ROLES, MAIN_WORDS = frozenset(["article", "main"]), frozenset(["main", "article"]), frozenset("article articlebody".split())

_MARKUP = re.compile(r"<!--.*?-->|<!--.*|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>?)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


@dataclass(slots=True, frozen=True)
class Marks:
    label: str
    firm: bool = False  # not main text, beyond doubt
    doubtful: bool = False  # not main text by its name, or a form
    claims: bool = False  # says that it is the article
    head: bool = False  # a page header, unless an article is around it


@dataclass(slots=True)
class Element:
    tag: str
    path: str
    above: int  # its parent's place, -1: none
    marks: Marks
    firm: bool = False  # it or something around it is not main text, beyond doubt
    aside: bool = False  # it or something around it is not main text
    said: bool = False  # says that it is the article
    within: bool = False  # it or something around it says so
    chars: int = 0

    def place(self, above: Element, lifted: bool = False) -> None:
        """Take over what holds for the parent; what is doubtful does not count for a lifted element."""
        marks = self.marks
        aside = marks.firm or marks.doubtful and not lifted
        self.firm = above.firm or marks.firm
        self.said = marks.claims and not aside
        self.aside = above.aside or aside or marks.head and not above.within and not lifted
        self.within = above.within or self.said


@dataclass(slots=True)
class Block:
    at: int  # place of its element
    text: str
    linked: int  # characters in links


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


def _named(names: str, known: frozenset[str]) -> set[str]:
    """Those of the known words that a class or id is called by."""
    found = set()
    for name in names.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        while len(words) > 1 and words[-1] in HOLDERS and words[-1] not in known:
            words.pop()
        if words and words[-1] in known and not STATES.intersection(words[:-1]):
            found.add(words[-1])
    return found


def _marks(tag: str, attributes: str, known: dict) -> Marks:
    key = tag + attributes
    if key not in known:
        found = {a.lower(): unescape(x or y or z or "") for a, x, y, z in _ATTRIBUTE.findall(attributes)}
        name = " ".join([found.get("id", ""), found.get("class", "")])
        role = found.get("role", "").lower()
        label = tag + "".join("." + x for x in sorted(set(re.sub(r"\d+", "", name).split())))
        unseen = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", "").lower()) is not None
        names = set() if tag in UNNAMED_TAGS else _named(name, ASIDE_WORDS)
        firm = unseen or tag != "form" and tag in ASIDE_TAGS or role != "form" and role in ASIDE_ROLES or bool(names & COMMENT_WORDS)
        claims = tag in MAIN_TAGS or role in MAIN_ROLES or bool({w.lower() for w in _WORDS.findall(name)} & MAIN_WORDS) or found.get("itemprop", "").lower() == "articlebody"
        head = tag == "header" or tag not in UNNAMED_TAGS and bool(_named(name, PAGE_HEAD_WORDS))
        if len(known) > 50_000:
            known.clear()
        known[key] = Marks(label, firm, bool(names) or tag == "form" or role == "form", claims, head)
    return known[key]


def doubt(page: Page) -> None:
    """Names and forms that would leave too little of the page do not count for an article and what lies around it; without an article, forms do not."""
    sizes = [(page.elements[b.at], len(b.text) - min(b.linked, len(b.text))) for b in page.blocks]
    left = sum(n for e, n in sizes if not e.aside)
    if left >= (1 - MOST) * sum(n for e, n in sizes if not e.firm):
        return
    _count(page, "firm")
    most = page.elements[0].chars
    trusted = [k for k, e in enumerate(page.elements) if e.marks.claims and not e.firm and e.chars >= SAID * most]
    if trusted:
        trusted += [k for k, e in enumerate(page.elements) if not e.firm and e.chars >= MOST * most]
    lifted = set()
    for k in trusted:
        while k >= 0 and k not in lifted:
            lifted.add(k)
            k = page.elements[k].above
    if not trusted and left < LEFT * most:
        lifted = {k for k, e in enumerate(page.elements) if e.tag == "form" and not e.firm and e.chars >= MOST * most}
    for k, e in enumerate(page.elements):  # parents come before children
        if e.above >= 0:
            e.place(page.elements[e.above], k in lifted)


def _count(page: Page, but: str) -> None:
    """Characters outside links of each element, with all it holds, but what is `aside` or `firm`."""
    for e in page.elements:
        e.chars = 0
    for block in page.blocks:
        if not getattr(page.elements[block.at], but):
            k = block.at
            while k >= 0:
                page.elements[k].chars += len(block.text) - min(block.linked, len(block.text))
                k = page.elements[k].above


def parse(html: str, known: dict | None = None) -> Page:
    """Structural elements and text blocks of a page, in order."""
    known = {} if known is None else known
    page = Page([Element("", "", -1, Marks(""))])
    stack, parts, linked, in_link = [0], [], 0, False
    hidden: list[str] = []  # open inline elements that are not shown

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                page.blocks.append(Block(stack[-1], text, linked))
            parts, linked = [], 0

    def close(tags) -> None:
        """Pop up to the innermost of these elements, unless a scope lies between."""
        for k in range(len(stack) - 1, 0, -1):
            tag = page.elements[stack[k]].tag
            if tag in tags:
                flush()
                del stack[k:]
                return
            if tag in SCOPES:
                return

    at = 0
    while at < len(html):
        m = _MARKUP.search(html, at)
        piece = html[at : m.start()] if m else html[at:]
        if piece and not hidden:
            piece = unescape(piece)
            parts.append(piece)
            if in_link:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue  # a comment, a declaration
        if m[2] is None and not m[7]:
            break  # the page ends in a tag
        tag = tag.lower()
        if tag == "a":
            in_link = not end
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif end:
                if hidden and hidden[-1] == tag:
                    hidden.pop()
            elif tag not in VOID and attributes and (hidden or (marks := _marks(tag, attributes, known)).firm or marks.doubtful):
                hidden.append(tag)
            elif hidden and tag not in VOID and hidden[-1] == tag:
                hidden.append(tag)
            continue
        hidden.clear()
        in_link = False
        if end:
            flush()
            for k in range(len(stack) - 1, 0, -1):
                if page.elements[stack[k]].tag == tag:
                    del stack[k:]
                    break
            continue
        flush()
        if tag in CLOSES_P:
            close(("p",))
        if tag in CLOSED_BY:
            close(CLOSED_BY[tag])
        if tag in VOID:
            continue
        if tag in RAW:
            found = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
            if not found:
                break
            at = html.find(">", found.start()) + 1 or len(html)
            continue
        marks = _marks(tag, attributes, known)
        above = page.elements[stack[-1]]
        page.elements.append(Element(tag, f"{above.path}/{marks.label}", stack[-1], marks))
        page.elements[-1].place(above)
        stack.append(len(page.elements) - 1)
    flush()
    doubt(page)
    _count(page, "aside")
    return page


def main_of(elements: list[tuple[str, bool, int]]) -> str | None:
    """Path of the main element among (path, says so, characters): an article with a fair share of the text, or the deepest with most of it."""
    most = max((n for _, _, n in elements), default=0)
    if not most:
        return None
    said = [e for e in elements if e[1] and e[2] >= SAID * most]
    if said:
        return max(said, key=lambda e: (e[2], -e[0].count("/"), e[0]))[0]
    return max((e for e in elements if e[2] >= MOST * most), key=lambda e: (e[0].count("/"), e[2], e[0]))[0]


def alternatives(n_pages: int, found: list[tuple[str, bool, int, int]]) -> list[tuple[str, bool, int]]:
    """Main elements (path, says so, share of the text) of a host's several templates, from (path, says so, pages, sum of shares).

    Elements that do not say that they are articles count only if, with the others on their level, they cover nearly all pages
    of what they lie in: one on some pages only is a part of its main element.
    """
    below: dict[str, list] = {}
    above: list[str] = []  # paths that the current one lies in
    for e in sorted(found):
        above = [a for a in above if e[0].startswith(a + "/")]
        below.setdefault(above[-1] if above else "", []).append(e)
        above.append(e[0])
    out, left = [], [("", n_pages)]
    while left:
        path, pages = left.pop()
        tops = below.get(path, [])
        covered = sum(e[2] for e in tops) >= SUPPORT * pages
        out += [(e[0], e[1], e[3] // e[2]) for e in tops if covered or e[1]]
        left += [(e[0], e[2]) for e in tops]
    return out


def main_text(page: Page, main: str | None, repeated: frozenset[int] = frozenset(), others: dict[str, tuple] | None = None, shared: frozenset[int] = frozenset()) -> str:
    """Blocks of the main element, without those in parts that are aside and the template's.

    `others` are main elements of templates that not all pages of the host have, `shared` the texts of those templates.
    """
    if others and not any(e.path == main and e.said and e.chars for e in page.elements):
        main = main_of([others[x] for x in {e.path for e in page.elements if e.chars} if x in others]) or main
    if main is None or not any(e.path == main and e.chars for e in page.elements):
        by_path: dict[str, list] = {}
        for e in page.elements:
            if not e.aside:
                known = by_path.setdefault(e.path, [e.path, False, 0])
                known[1] |= e.said
                known[2] += e.chars
        main = main_of([tuple(x) for x in by_path.values()])
    inside = []
    for e in page.elements:  # parents come before children
        inside.append(e.path == main or e.above >= 0 and inside[e.above])
    shown = [b for b in page.blocks if inside[b.at] and not page.elements[b.at].aside]
    if repeated or shared:
        named = [(b, number(f"{page.elements[b.at].path}\n{b.text}")) for b in shown]
        own = [x for x in named if x[1] not in repeated]
        slots = [x for x in own if x[1] not in shared]
        size = lambda some: sum(len(b.text) for b, _ in some)
        if size(slots) >= (1 - MOST) * size(own):
            own = slots
        shown = [b for b, _ in own] or shown
    return "\n".join(b.text for b in shown)


def host_of(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def distinct(pages: DataFrame) -> DataFrame:
    """(host, html): the different pages of each host. Only pages that a host has more than once are shuffled, after each task has put its own together."""
    rows = pick(pages, url="string", html="string").select(host_of("url").alias("host"), F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.md5("html"))
    copied = cut_lineage(rows.groupBy("host", "digest").agg(F.count("*").alias("n")).where("n > 1").select("host", "digest"))
    size = copied.agg(F.sum(F.lit(96) + F.octet_length("host"))).first()[0]
    if size is None:
        return rows.select("host", "html")
    if size <= BROADCAST_BYTES:
        copied = F.broadcast(copied)
    once = rows.join(copied, ["host", "digest"], "left_semi").groupBy("host", "digest").agg(F.any_value("html").alias("html"))
    return rows.join(copied, ["host", "digest"], "left_anti").unionByName(once).select("host", "html")


SUMS = ("pages", "total", "low", "high", "chars", "share")
_TOKENS = pa.schema([("host", pa.string()), ("token", pa.int64()), ("path", pa.string()), ("said", pa.bool_()), ("within", pa.int64()), *[(c, pa.int64()) for c in SUMS]])


def tokens(pages: DataFrame) -> DataFrame:
    """(host, token, path, said, within, pages, total, low, high, chars, share): occurrence vectors over a host's different pages, summed up.

    `path` is null for text runs, `within` is the token of their element; `share` is the element's part of a page's text, in millionths. Equal (pages, low, high) mean the same vector. Token 0 counts the host's different pages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        held: dict[tuple[str, int], list] = {}

        def put() -> pa.RecordBatch:
            rows = [(h, t, *v) for (h, t), v in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_TOKENS)], schema=_TOKENS)

        for batch in steps(batches, "html"):
            for host, html in zip(*(batch.column(c).to_pylist() for c in ("host", "html"))):
                page = parse(html, known)
                own = number(html)
                counts: dict[int, list] = {0: [None, False, None, 1, 0, 0]}
                most = max((e.chars for e in page.elements[1:] if not e.aside), default=0) or 1
                at: dict[str, int] = {}
                for e in page.elements[1:]:
                    if not e.aside:
                        token = at[e.path] = at[e.path] if e.path in at else number(e.path)
                        entry = counts.setdefault(token, [e.path, e.said, None, 0, 0, 0])
                        entry[3] += 1
                        entry[4] += e.chars
                        entry[5] += 1_000_000 * e.chars // most
                for b in page.blocks:
                    e = page.elements[b.at]
                    if not e.aside:
                        counts.setdefault(number(f"{e.path}\n{b.text}"), [None, False, at.get(e.path), 0, 0, 0])[3] += 1
                for token, (path, said, within, n, chars, share) in counts.items():
                    mixed = (own ^ n * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 % 2**64
                    mixed ^= mixed >> 32
                    entry = held.setdefault((host, token), [path, said, within, *[0] * len(SUMS)])
                    for k, v in enumerate((1, n, mixed & 0xFFFFFFFF, mixed >> 32, chars, share), 3):
                        entry[k] += v
                if len(held) > HELD:
                    yield put()
        if held:
            yield put()

    found = distinct(pages).mapInArrow(run, "host string, token long, path string, said boolean, within long, " + ", ".join(f"{c} long" for c in SUMS))
    return found.groupBy("host", "token").agg(F.max("path").alias("path"), F.max("said").alias("said"), F.max("within").alias("within"), *[F.sum(c).alias(c) for c in SUMS])


def template_tokens(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(host, n_pages, token, path, said, chars, share, pages, total, wide): the tokens of templates; `wide` ones are on nearly all pages of the host."""
    found = cut_lineage(tokens(pages))  # read more than once; much smaller than the pages
    size = found.where("token = 0").select("host", F.col("pages").alias("n_pages"))
    often = F.greatest(F.lit(PAGES), F.col("n_pages") / TEMPLATES)
    rows = found.where("token != 0").join(size, "host").withColumns({"wide": F.col("pages") >= support * F.col("n_pages"), "class": F.xxhash64("pages", "low", "high")}).where(F.col("wide") | (F.col("pages") >= often))
    texts, elements = rows.where("path IS NULL AND NOT wide"), rows.where("path IS NOT NULL")
    around = elements.select("host", F.col("token").alias("within"), F.col("pages").alias("_pages"))  # an element is on as many pages as its texts, or more
    classes = elements.where("NOT wide").select("host", "class", F.lit(True).alias("_known")).distinct()
    shared = texts.join(around, ["host", "within"], "left").join(classes, ["host", "class"], "left").where(F.col("_known") | (F.col("pages") >= support * F.col("_pages")))
    columns = ["host", "n_pages", "token", "path", "said", "chars", "share", "pages", "total", "wide"]
    return rows.where("wide OR path IS NOT NULL").select(*columns).unionByName(shared.select(*columns))


def deduce(kept: DataFrame) -> DataFrame:
    """(host, n_pages, main, repeated, others, shared): the templates of each host.

    `main` and `repeated`, the main element and the texts of the template that nearly all pages share, are no more than
    a page has; `others` and `shared`, those of further templates, no more than `TEMPLATES` pages have.
    """
    once = kept.where("path IS NOT NULL AND total = pages")
    wide = once.where("wide").groupBy("host").agg(F.collect_list(F.struct("path", "said", "chars")).alias("elements"))
    some = once.where(~F.col("wide") & (F.col("share") >= F.when(F.col("said"), SAID).otherwise(MOST) * 1_000_000 * F.col("pages"))).groupBy("host").agg(F.collect_list(F.struct("path", "said", "pages", "share")).alias("some"))
    texts = kept.where((F.col("path").isNull()) & (F.col("n_pages") >= PAGES))
    text = texts.groupBy("host").agg(*[F.sort_array(F.collect_set(F.when(F.col("wide") == w, F.col("token")))).alias(c) for w, c in ((True, "repeated"), (False, "shared"))])
    main = F.udf(lambda rows: main_of([(r["path"], r["said"], r["chars"]) for r in rows or []]), "string")
    others = F.udf(lambda n, rows: alternatives(n, [tuple(r) for r in rows or []]), "array<struct<path:string,said:boolean,share:bigint>>")
    hosts = kept.groupBy("host").agg(F.max("n_pages").alias("n_pages"))
    out = hosts.join(wide, "host", "left").join(text, "host", "left").join(some, "host", "left")
    none = F.array().cast("array<bigint>")
    return out.select("host", "n_pages", main("elements").alias("main"), F.coalesce("repeated", none).alias("repeated"), others("n_pages", "some").alias("others"), F.coalesce("shared", none).alias("shared"))


def extract(pages: DataFrame) -> DataFrame:
    """The pages with all their columns, and `_text`, which replaces a column of that name."""
    fields = [f for f in pages.schema.fields if f.name.lower() != "_text"]
    names = [f.name if f.name in ("url", "html") else f"extra_{k}" for k, f in enumerate(fields)]  # others cannot clash with the parts
    pages = pages.select(*[F.col(f"`{f.name.replace('`', '``')}`").alias(n) for n, f in zip(names, fields)])
    parts = ["_host", "_main", "_repeated", "_others", "_shared"]
    templates = cut_lineage(deduce(cut_lineage(template_tokens(pages))).select(*[F.col(c[1:]).alias(c) for c in parts]))
    paths = F.aggregate("_others", F.lit(0), lambda n, e: n + 32 + F.octet_length(e["path"]))
    size = templates.agg(F.sum(F.lit(64) + F.octet_length("_host") + F.coalesce(F.octet_length("_main"), F.lit(0)) + 8 * F.size("_repeated") + 8 * F.size("_shared") + paths)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        templates = F.broadcast(templates)
    rows = pages.withColumn("_host", host_of("url")).join(templates, "_host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        held: dict[str, tuple] = {}  # templates of the hosts seen last
        for batch in steps(batches, "html"):
            host, main, repeated, others, shared, html = (batch.column(batch.schema.get_field_index(c)) for c in (*parts, "html"))
            texts = []
            for k, (name, text) in enumerate(zip(host.to_pylist(), html.to_pylist())):
                if name not in held:
                    if len(held) > 1000:
                        held.clear()
                    elements = {e["path"]: (e["path"], e["said"], e["share"]) for e in others[k].as_py() or ()}
                    held[name] = main[k].as_py(), frozenset(repeated[k].as_py() or ()), elements, frozenset(shared[k].as_py() or ())
                texts.append(main_text(parse(text or "", known), *held[name]))
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(texts, pa.string())], names=[*names, "_text"])

    found = rows.select(*names, *parts).mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField("_text", T.StringType())]))
    return found.toDF(*[f.name for f in fields], "_text")
