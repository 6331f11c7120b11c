import html
import random
import re
import time

import pyarrow.parquet as pq
import pytest

from fleetgauge.llm import html_text
from fleetgauge.llm.html_text import extract_text, main_text

PARAGRAPH = "A long and honest sentence, with commas, about the matter at hand. And one more, so that it counts."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a&nbsp;b<p>c", "a b c"),
        ("<script>x('<p>no</p>')</script><p>yes", "yes"),
        ("<!-- <p>no</p> --><p>yes</p><a href='" + "x" * 1000, "yes"),
        ("<p>in<b>line</b> and<br>break", "inline and break"),
        ("<p>" + "word " * 50_000 + "</p>", ("word " * 50_000).strip()),
    ],
)
def test_small_pages(page, text):
    assert main_text(page) == text


def test_parts_beside_the_article():
    beside = {
        "nav": "<nav><ul><li><a href=x>Menu</a></li></ul></nav>",
        "notice": f"<div class='cookie-notice'><p>{PARAGRAPH}</p></div>",
        "comments": f"<section id=comments><p>{PARAGRAPH} {PARAGRAPH}</p><p>{PARAGRAPH}</p></section>",
        "form": "<form><label>Name</label><input><button>Go</button></form>",
        "footer": "<footer>&copy; somebody, somewhere.</footer>",
    }
    page = (
        f"<html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header>{beside['nav']}"
        f"{beside['notice']}<div id=main><h1>Title</h1><p>{PARAGRAPH}</p><p>Short.</p><ul><li>One</li><li>Two</li></ul></div>"
        f"<div class=sidebar><p>{PARAGRAPH}</p></div>{beside['comments']}{beside['form']}{beside['footer']}</body></html>"
    )
    assert main_text(page) == f"Title {PARAGRAPH} Short. One Two"


WRAPPERS = [
    "<div class='content-sidebar-wrap'>{}</div>",
    "<div class='layout has-sidebar'>{}</div>",
    "<div id='post-with-comments'>{}</div>",
    "<form method=post action=x>{}</form>",
    "<div class=nav-page><form>{}</form></div>",
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("holder", ["article", "main", "div"])
def test_wrappers_do_not_take_the_article_away(wrapper, holder):
    aside = f"<div class=sidebar><p>{PARAGRAPH}</p></div><nav><a href=x>Menu</a></nav>"
    article = f"<{holder}><h1>Title</h1><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></{holder}>"
    expected = f"Title {PARAGRAPH} {PARAGRAPH} {PARAGRAPH}"
    assert main_text(f"<html><body>{wrapper.format(article + aside)}</body></html>") == expected
    assert main_text(f"<html><body><main>{wrapper.format(article + aside)}</main></body></html>") == expected


def test_headers_of_an_article_are_its_own():
    for header in ("<header><h1>Title</h1></header>", "<div class=entry-header><h1>Title</h1></div>"):
        page = f"<body><header><h1>Site</h1></header><article>{header}<p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></article></body>"
        assert main_text(page) == f"Title {PARAGRAPH} {PARAGRAPH}"


def test_long_comments_stay_beside_an_article():
    comments = "".join(f"<article class=comment><header>By x</header><p>{PARAGRAPH}</p></article>" for _ in range(9))
    page = f"<body><article><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></article><div id=comments>{comments}</div></body>"
    assert main_text(page) == f"{PARAGRAPH} {PARAGRAPH} {PARAGRAPH}"


def test_a_head_without_its_end_and_parts_beside_alone():
    assert main_text(f"<html><head><title>T</title><body><p>{PARAGRAPH}</p></body></html>") == PARAGRAPH
    half = "".join(f"<div class=promo><p>{PARAGRAPH}</p></div>" for _ in range(3))
    assert PARAGRAPH in main_text(f"<body>{half}</body>")


def test_given_pages_give_their_articles():
    """The tables' pages have one article element each; a plain reading of it must be found."""
    for page in given_pages():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.DOTALL)
        body = re.sub(r"<[^>]*\Z", "", article[1] if article else "")
        parts = re.split(r"</?(?:p|h1)>|<br>", body)
        plain = " ".join(html.unescape(re.sub(r"<[^>]*>", "", part)) for part in parts)
        assert main_text(page) == " ".join(plain.split())


def given_pages():
    return pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()


def test_the_scores_choose_the_text():
    """Other scores give other texts; without the lists of tags and words the scores still find most articles."""
    rng = random.Random(1)
    pages = given_pages()
    true = [main_text(page) for page in pages]
    chance = [main_text(page, lambda p: {b.path: rng.random() for b in p.blocks}) for page in pages]
    assert sum(a != b for a, b in zip(true, chance, strict=True)) > len(pages) / 2


def test_without_the_lists_the_scores_find_the_articles(monkeypatch):
    pages = given_pages()
    true = [main_text(page) for page in pages]
    monkeypatch.setattr(html_text, "BESIDE", frozenset())
    monkeypatch.setattr(html_text, "BESIDE_WORDS", frozenset())
    found = [main_text(page) for page in pages]
    assert sum(a == b for a, b in zip(true, found, strict=True)) >= 0.95 * len(pages)


@pytest.mark.parametrize(
    "part",
    [
        "<p title='a hidden gem'>{}</p>",
        "<section class='related-work'><p>{}</p></section>",
        "<p class=share-price>{}</p>",
        "<p>see <span class=notice>{}</span></p>",
        "<div data-id=comments><p>{}</p></div>",
        "<p><math>{}</math></p>",
        "<p data-style='display: none'>{}</p>",
    ],
)
def test_attributes_and_words_that_name_no_part(part):
    inner = "Inner words, one or two."
    page = f"<body><nav><a href=x>Menu</a></nav><article><h1>T</h1><p>{PARAGRAPH}</p>{part.format(inner)}<p>{PARAGRAPH}</p></article></body>"
    assert inner in main_text(page)


@pytest.mark.parametrize("attribute", ["hidden", "style='display:none'", "aria-hidden=true"])
def test_hidden_parts_have_no_text(attribute):
    assert main_text(f"<body><p>{PARAGRAPH}</p><p {attribute}>{PARAGRAPH}</p><p>End.</p></body>") == f"{PARAGRAPH} End."


@pytest.mark.parametrize(
    "page", ["<div>x" * 50_000, "<b>" * 50_000 + "<p>x" * 50_000, "<div>" * 50_000 + "</x>" * 50_000 + "<p>y", "<a>x" * 50_000]
)
def test_deep_pages_end_in_seconds(page):
    start = time.perf_counter()
    assert main_text(page)
    assert time.perf_counter() - start < 20


def test_odd_rows(spark):
    rows = [(1, "u", None, 1), (None, None, "<p>x</p>", 2), (1, "u", None, 1)]
    found = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int"))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(["(1, 'u', '', 0)"] * 2 + ["(None, None, 'x', 1)"])
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
