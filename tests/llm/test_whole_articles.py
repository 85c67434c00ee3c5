"""Articles lose none of their text to alignment or to names."""

import random
import time

import pytest

from barloom.llm.html_extract import blocks, extract, parse

SCHEMA = "page_id long, url string, html string"


def say(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(900)) for _ in range(n))


def run(spark, pages):
    """pages: (html, blocks wanted); all of one host."""
    rows = [(k, f"http://whole.example/{k}", html) for k, (html, _) in enumerate(pages)]
    got = [r.text for r in extract(spark.createDataFrame(rows, SCHEMA)).orderBy("page_id").collect()]
    assert got == ["\n\n".join(want) for _, want in pages]


def around(inner, rng):
    return f"<html><body><div class='q1'>{say(rng, 4)}</div>{inner}<div class='q9'>{say(rng, 5)}</div></body></html>"


@pytest.mark.parametrize("outer", ["<article>{}</article>", "<div class='z'>{}</div>", "{}"])
def test_a_lead_beside_the_text(spark, outer):
    """In an article element, in one div, and as plain siblings of the body."""
    rng = random.Random(1)
    pages = []
    for _ in range(20):
        lead, text = say(rng, 30), [say(rng, 50), say(rng, 50)]
        pages.append((around(outer.format(f"<div class='lead'>{lead}</div><div class='text'>" + "".join(f"<p>{x}</p>" for x in text) + "</div>"), rng), [lead, *text]))
    run(spark, pages)


@pytest.mark.parametrize("outer", ["<article>{}</article>", "<div class='z'>{}</div>"])
def test_headings_that_recur(spark, outer):
    rng = random.Random(2)
    pages = []
    for _ in range(20):
        a, b = say(rng, 40), say(rng, 40)
        body = f"<h2>Introduction</h2><p>{a}</p><h2><a href='#c'>Conclusion</a></h2><p>{b}</p><p>Read our <a href='/n'>newsletter</a>.</p>"
        pages.append((around(outer.format(body), rng), ["Introduction", a, "Conclusion", b]))
    run(spark, pages)


def test_names_that_articles_use_too():
    text = "a sentence of the article that goes on for a while and says what it has to say " * 2
    page = f"<article><section id='search'><p>{text}</p></section><section id='share'>{text}</section><div class='form'>{text}</div><section id='discussion'>{text}</section><section class='related'>{text}</section><label>Age</label></article>"
    assert blocks(parse(page)) == [text.strip()] * 5 + ["Age"]
    short = "<article><p>text</p><div class='share'><a href='/x'>Share</a></div><div class='related'>" + "<a href='/y'>a long title of another article, all of it a link</a> " * 5 + "</div><div class='comments'>" + text + "</div></article>"
    assert blocks(parse(short)) == ["text"]


def test_markup_and_alignment_that_differ(spark):
    """An article element around advice for readers, with the story in a plain div: alignment finds the story; where pages have no region, markup does."""
    rng = random.Random(4)
    pages = []
    for _ in range(20):
        text = [say(rng, 60), say(rng, 60)]
        pages.append((f"<body><article><p>Welcome to <a href='/'>our site</a>.</p></article><div class='s'>" + "".join(f"<p>{x}</p>" for x in text) + f"</div><div class='t'>{say(rng, 5)}</div></body>", text))
    run(spark, pages)


@pytest.mark.parametrize("tags", ["<b>", "<p><b>", "<li><div><b>", "<option><div><i>"])
def test_unclosed_tags_take_time_in_proportion(tags):
    began = time.process_time()
    nodes = parse(tags * 20_000 + "x" + "</u>" * 20_000 + "</i></b>" * 20_000 + "<li>y<p>z<option>" * 20_000)
    took = time.process_time() - began
    assert len(nodes) > 1 and took < 6
