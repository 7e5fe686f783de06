"""Main text: names that are no noise, and the whole choice against a plain version on random pages."""

import random

from pagewright.llm import html_blocks
from pagewright.llm.html_blocks import main_text

LONG = ("many plain words in a row make a long line of the text " * 3).strip()
KEPT = ['<p class="share-price">', '<div class="search-engine">', '<section id="menu-of-the-day">', '<p class="alert">', '<p class="form-of-address">', '<h2 class="related-work">', '<blockquote class="reply">']
GONE = ['<div class="ad-box-2">', '<div id="siteHeader">', '<ul class="share-buttons">', '<div class="cookie-notice">', '<p class="advert">', '<section id="user-comments">', '<div class="x sponsored-post">', '<div role="navigation">', "<aside>", "<form>"]


def closed(tag: str, text: str) -> str:
    return f"{tag}{text}</{tag[1:].split()[0].rstrip('>')}>"


def test_names_inside_an_article():
    page = lambda tag: f"<body><article><h1>T</h1>{closed(tag, 'some words')}<p>{LONG}</p></article></body>"
    assert {t: main_text(page(t)) for t in KEPT} == {t: f"T some words {LONG}" for t in KEPT}
    for tag in set(GONE) - {'<div id="siteHeader">'}:  # an article's own header belongs to it
        assert main_text(page(tag)) == f"T {LONG}", tag


def test_names_outside_articles():
    for tag in GONE:
        assert main_text(f"<body><div><h1>T</h1>{closed(tag, 'some words')}<p>{LONG}</p></div></body>") == f"T {LONG}", tag


def test_marked_articles_that_no_region_reaches_go():
    assert main_text(f"<main><article><h1>T</h1><p>{LONG}</p><p>End.</p></article>{'<div class=ad>buy</div>' * 3}<article><p>Teaser</p></article></main>") == f"T {LONG} End."


def plain(blocks: list[list[tuple[str, bool]]], marked: set[int]) -> str:
    """The choice over ``blocks`` of lines (text, noise), each an element below the body, told line by line."""
    lines = [(b, text, noise) for b, block in enumerate(blocks) for text, noise in block]
    length = [0 if noise else len(text) for _, text, noise in lines]

    def regions(ns, least):
        inside, open_ = [], False
        for i in range(len(ns)):
            total = sum(ns[i : i + 3])
            open_ = total > 0 and (open_ or total > least and ns[i] > 0)
            inside.append(open_)
        return inside

    own = [n if b in marked else 0 for n, (b, _, _) in zip(length, lines, strict=True)]
    trusted = bool(marked) and (any(regions(own, 80)) or 2 * sum(own) >= sum(length))
    found = regions(own if trusted else length, 80)
    if not any(found):
        found = regions(length, 0)
    hit = {b for f, (b, _, noise) in zip(found, lines, strict=True) if f and not noise and (not trusted or b in marked)}
    return " ".join(text for b, text, noise in lines if b in hit and not noise)


def test_choice_against_a_plain_version():
    rng = random.Random(5)
    for _ in range(2000):
        blocks = [[("w" * rng.choice([1, 5, 20, 40, 90, 200]), rng.random() < 0.4) for _ in range(rng.randint(1, 6))] for _ in range(rng.randint(1, 4))]
        marked = {b for b in range(len(blocks)) if rng.random() < 0.3}
        body = ""
        for b, block in enumerate(blocks):
            tag = "article" if b in marked else "div"
            body += f"<{tag}>" + "".join(f'<div class="ad">{x}</div>' if noise else f"<p>{x}</p>" for x, noise in block) + f"</{tag}>"
        assert main_text(f"<html><body>{body}</body></html>") == plain(blocks, marked), body


def test_empty_table_and_a_clashing_name(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string, main_text string")
    assert html_blocks.extract(pages).columns == ["page_id", "url", "html", "main_text"] and html_blocks.extract(pages).count() == 0
