"""Main text of pages whose markup misleads: wrappers, slugs, forms."""

import random

import brute
import pyarrow.parquet as pq
import pytest

from driftline.llm import html
from driftline.llm.html import main_text

PARTS = [f"Part {i} of the story goes on for a good while, as stories do, and says little." for i in range(6)]
PROSE = "".join(f"<p>{p}</p>" for p in PARTS)
AROUND = "<nav><a href='/'>Home</a></nav>{}<div class='ad-banner'>Buy this now.</div><footer>Foot</footer>"


@pytest.mark.parametrize("start, end", [("<div class='layout has-sidebar'>", "</div>"), ("<div class='no-sidebar'>", "</div>"), ("<div class='page-with-header'>", "</div>"), ("<form id='aspnetForm'>", "</form>"), ("<div class='widget'>", "</div>")])
@pytest.mark.parametrize("name", ["article", "div"])
def test_wrappers(start, end, name):
    page = f"<html><body>{AROUND.format(f'{start}<{name}>{PROSE}</{name}>{end}')}</body></html>"
    assert main_text(page) == "\n".join(PARTS)


def test_slugs_and_captions():
    inner = f"<header><h1>Title</h1></header>{PROSE}<h2 id='related-work'>Related work</h2><section id='social-history'><p>Social.</p></section><h3 id='search'>Search</h3><p class='share-price'>Price.</p><figure><figcaption>Caption.</figcaption></figure><div class='share'>Share it</div>"
    page = f"<html><body>{AROUND.format(f'<article>{inner}</article>')}</body></html>"
    assert main_text(page).split("\n") == ["Title", *PARTS, "Related work", "Social.", "Search", "Price.", "Caption."]


def test_what_stays_out():
    comments = "<div id='comments'>" + "".join(f"<article><p>Comment {i} {PARTS[0]}</p></article>" for i in range(12)) + "</div>"
    page = f"<html><body>{AROUND.format(f'<article>{PROSE}</article>{comments}')}</body></html>"
    assert main_text(page) == "\n".join(PARTS)
    hidden = f"<html><body><div hidden><p>{PARTS[0] * 40}</p></div><article>{PROSE}</article></body></html>"
    assert main_text(hidden) == "\n".join(PARTS)
    assert main_text("<body><nav>Home page</nav><footer>Foot</footer></body>") == ""


def test_nothing_else_left():
    page = "<body><nav>Home</nav>" + "".join(f"<div class='widget'><p>{p}</p></div>" for p in PARTS) + "</body>"
    assert main_text(page) == "\n".join(PARTS)


def test_article_over_siblings():
    """A lead beside the body, and parts split by an advert: all that reach the threshold are kept, the rest is not."""
    more = [f"And then {p}" for p in PARTS]
    menu = "<nav><ul>" + "".join(f"<li><a href='/{i}'>Place {i}</a></li>" for i in range(12)) + "</ul></nav>"
    links = "<div><a href='/x'>Other</a> <a href='/y'>Others</a></div>"
    for start, end in (("", ""), ("<div>", "</div>"), ("<section><div>", "</div></section>")):
        for parts in ([PARTS, more + more], [PARTS[:1], more + more], [more + more, PARTS], [more, more, more]):
            divs = "<div class=ad>Buy</div>".join("<div>" + "".join(f"<p>{p}</p>" for p in part) + "</div>" for part in parts)
            page = f"<html><body>{menu}{start}{divs}{end}{links}<footer>Foot</footer></body></html>"
            assert main_text(page) == "\n".join(p for part in parts for p in part), page


def test_density_decides():
    """No article, no main, no mark: what is dense stays, lists of links and captions of pictures go; with the header of the article kept."""
    links = "".join(f"<li><a href='/{i}'>Something to read {i}</a></li>" for i in range(30))
    teasers = "".join(f"<div><a href='/t{i}'><span>Teaser {i}</span></a><span>now</span></div>" for i in range(20))
    for name in ("div", "section", "td"):
        page = f"<html><body><div><ul>{links}</ul></div><div>{teasers}</div><{name}><div><header><h1>Title of it</h1></header>{PROSE}{PROSE}</div></{name}><div><ul>{links}</ul></div></body></html>"
        text = main_text(page)
        assert text.split("\n")[-12:] == [*PARTS, *PARTS] and "Teaser" not in text and "Something" not in text, (name, text)


def test_linear_time():
    import time

    for junk in ("<a " * 60_000 + '"', "<svg>" * 60_000, "<b>" * 20_000 + "</i>" * 20_000, '<p class="' * 60_000, "<div>" * 30_000 + "</p>" * 30_000, "<!--" * 60_000, "&" * 60_000, "<div>" * 30_000 + "</section>" * 30_000, "<li><ul>" + "<div>" * 30_000 + "<li></li>" * 30_000, "<article>" + "<x><h1>a</h1>" * 30_000, "<p><table>" + "<a>" * 30_000 + "<div></div>" * 30_000):
        start = time.time()
        main_text(junk)
        assert time.time() - start < 6, junk[:8]


def test_rows(spark):
    from driftline.llm import html

    rows = [(1, None, "a", "n"), (2, "", "b", "n"), (3, f"<article>{PROSE}</article>", None, "n"), (3, f"<article>{PROSE}</article>", None, "n"), (None, "<p>" + "word " * 300_000 + "</p>", "c", None)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string, n_chars string")  # columns named like the new ones
    out = html.with_length(html.extract(df, keep=["page_id"])).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in out) == [(0, 1_499_999), (1, 0), (2, 0), (3, len("\n".join(PARTS))), (3, len("\n".join(PARTS)))]
    assert html.extract(df.limit(0)).count() == 0


def pages_of(sf_dir):
    return pq.read_table(f"{sf_dir}/pages.parquet", columns=["html"])["html"].to_pylist()


def test_random_densities_break_pages(monkeypatch):
    """Densities decide on the given pages: random ones lose articles or keep adverts on many."""
    pages = pages_of("/root/testdata/sf0.01")
    right = [main_text(p) for p in pages]
    dice = random.Random(5)
    monkeypatch.setattr(html, "density", lambda *counts: dice.random())
    assert sum(main_text(p) != r for p, r in zip(pages, right)) > len(pages) / 10


def made_page(dice):
    words = lambda n: " ".join(dice.choice("all these words make up stories of some length &amp; more".split()) for _ in range(n))
    links = lambda n: "<ul>" + "".join(f"<li><a href='/{i}'>{words(dice.randint(1, 4))}</a></li>" for i in range(n)) + "</ul>"
    paragraph = lambda: f"<p{dice.choice(['', '', '', ' class=share'])}>" + dice.choice(["{}", "<b>{}</b>", "<a href='/'>{}</a> {}", "{}<br>{}"]).replace("{}", words(dice.randint(1, 40))) + "</p>"
    name = dice.choice(["article", "div", "section"])
    parts = [f"<{name}><h1>{words(5)}</h1>" + "".join(paragraph() for _ in range(dice.randint(1, 9))) + dice.choice(["", links(3), f"<div class=ad>{words(9)}</div>"]) + f"</{name}>"]
    parts += dice.sample([f"<nav>{links(5)}</nav>", f"<div>{links(9)}</div>", f"<div class='x-y'>{words(dice.randint(2, 20))}</div>", f"<div class='ad-banner'>{words(dice.randint(2, 20))}</div>", f"<footer>{words(8)}</footer>", f"<aside><p>{words(30)}</p></aside>", f"<div><p>{words(30)}</p></div>"], dice.randint(0, 5))
    dice.shuffle(parts)
    return f"<html><head><title>T</title></head><body>{''.join(parts)}</body></html>"


def test_like_the_definition(monkeypatch):
    """The same texts as an implementation that counts everything anew for each node, on given and made pages."""
    monkeypatch.setattr(html, "spare", lambda root: None)  # what marks are not believed for is tested by itself
    monkeypatch.setattr(html, "unmark", lambda root: False)
    dice = random.Random(11)
    given = sorted((p for p in pages_of("/root/testdata/sf0.001") if p), key=len)[:12]
    for page in [*given, *(made_page(dice) for _ in range(150))]:
        assert main_text(page) == brute.main_text(page, html.MARKS, html.WEIGHT, html.P_WEIGHT), page


def test_classes_nobody_knows():
    """Blocks beside the article go, or stay, by their density: their classes say nothing."""
    links = "<section class='zx-1'><ul>" + "".join(f"<li><a href='/{i}'>More of it {i}</a></li>" for i in range(9)) + "</ul></section>"
    notice = "<div class='q7'>We use them.</div>"
    for page in (f"<body>{notice}<div class='k9'>{PROSE}</div>{links}</body>", f"<body><div>{links}<div class='k9'>{PROSE}</div></div></body>"):
        text = main_text(page)
        assert text.split("\n")[-6:] == PARTS and "More of it" not in text
    sections = f"<div><section>{PROSE}</section><section>{PROSE}</section><section class='rel-links'>{links}</section></div>"
    assert main_text(f"<body>{AROUND.format(sections)}</body>") == "\n".join(PARTS + PARTS)


def test_class_is_a_weight():
    """A long paragraph of the article outweighs its class; a short block with it does not."""
    long = " ".join(PARTS * 3)
    page = f"<body>{AROUND.format(f'<article>{PROSE}<p class=share>{long}</p><div class=share>Share it</div></article>')}</body>"
    assert main_text(page) == "\n".join([*PARTS, long])


def test_ties_and_depth():
    """Equal densities: all equal blocks stay, in page order. Nesting has no bound: what is deep inside is judged like anything else."""
    same = f"<div><p>{PARTS[0]}</p><p>{PARTS[1]}</p></div>"
    assert main_text(f"<body>{same * 4}</body>") == "\n".join(PARTS[:2] * 4)
    deep = "<div>" * 2000 + f"<nav>Menu</nav>{PROSE}<footer>Foot</footer>" + "</div>" * 2000
    assert main_text(f"<body>{deep}</body>") == "\n".join(PARTS)
