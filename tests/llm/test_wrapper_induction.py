import random

import pytest

from barloom.llm import html_extract
from barloom.llm.html_extract import align, blocks, common, extract, parse

SCHEMA = "page_id long, url string, html string"


def brute_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("table", [1 << 26, 8])
def test_common_subsequences_are_longest(monkeypatch, table):
    monkeypatch.setattr(html_extract, "_TABLE", table)
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(14))] for _ in range(2))
        pairs = common(a, b)
        assert len(pairs) == brute_common(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_long_and_deep_pages_are_aligned_whole():
    body = lambda seed: "".join(f"<p>par {seed} {i}</p>" + "<h2>part</h2>" * (i % (5 + seed) == 0) for i in range(1500))
    a, b = (parse(f"<body><div>{body(k)}</div></body>") for k in (1, 2))
    assert len(align(a[0], b[0])) >= 1500
    a, b = (parse("<div>" * 2000 + f"deep {k}" + "</div>" * 2000) for k in (1, 2))
    assert [(x.text, y.text) for x, y in align(a[0], b[0])] == [("deep 1", "deep 2")]


def site(rng, k, host="http://plain.example"):
    """A page without any telling tag or name, and its article."""
    say = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(900)) for _ in range(n))
    parts = [say(4)] + [say(rng.randrange(8, 40)) for _ in range(rng.randrange(2, 9))]
    menu = "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in (say(1) for _ in range(rng.randrange(3, 7))))
    body = f"<h2>{parts[0]}</h2>" + "".join(f"<p>{x}</p>" for x in parts[1:])
    html = f"<html><body><div class='u1'><ul>{menu}</ul></div><div class='u2'>{say(5)}</div><div class='u3'><p>Read our <a href='/t'>weekly</a> <b>digest</b> today.</p>{body}</div><div class='u4'>{say(6)}</div></body></html>"
    return (k, f"{host}/{k}", html), "\n\n".join(parts)


def test_plain_divs_give_the_article_whatever_the_layout(spark):
    """Menus, adverts and footers that vary, in divs alone; a constant line with inline markup inside the article's own div."""
    rng = random.Random(8)
    rows, want = zip(*(site(rng, k) for k in range(150)), strict=True)
    df = spark.createDataFrame(rows, SCHEMA)
    for layout in (df.repartition(1), df.repartition(7)):
        assert [r.text for r in extract(layout).orderBy("page_id").collect()] == list(want)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
        assert [r.text for r in extract(df.repartition(3)).orderBy("page_id").collect()] == list(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_templates_beyond_the_broadcast_limit(spark, monkeypatch):
    rng = random.Random(9)
    rows, want = zip(*(site(rng, k, f"http://h{k % 3}.example") for k in range(90)), strict=True)
    monkeypatch.setattr(html_extract, "BROADCAST_LIMIT", 0)
    assert [r.text for r in extract(spark.createDataFrame(rows, SCHEMA)).orderBy("page_id").collect()] == list(want)


def test_a_line_on_some_pages_is_no_template(spark):
    rng = random.Random(10)
    rows, want = zip(*(site(rng, k) for k in range(40)), strict=True)
    shared = "<p>the same passage here</p></div><div class='u4'>"
    rows = [(k, u, h.replace("</div><div class='u4'>", shared)) if k % 4 == 0 else (k, u, h) for k, u, h in rows]
    want = [w + "\n\nthe same passage here" if k % 4 == 0 else w for k, w in enumerate(want)]
    assert [r.text for r in extract(spark.createDataFrame(rows, SCHEMA)).orderBy("page_id").collect()] == want


def test_near_copies_keep_their_text(spark):
    text = "".join(f"<p>paragraph number {i} of the copied article</p>" for i in range(30))
    rows = [(k, f"http://copy.example/{k}", f"<body><article><h1>Title</h1>{text}<p>v{k}</p></article></body>") for k in range(6)]
    got = [r.text for r in extract(spark.createDataFrame(rows, SCHEMA)).orderBy("page_id").collect()]
    assert all(x.count("\n\n") == 31 and x.endswith(f"v{k}") for k, x in enumerate(got))


def test_names_inside_an_article():
    keep = "<article><header><h1 class='post-header'>Title</h1></header><section class='related-work'><p>work</p></section><div id='side-effects'>effects</div><p class='alert'>mind this</p></article>"
    assert blocks(parse(keep)) == ["Title", "work", "effects", "mind this"]
    drop = "<header>site</header><article><p>text</p><div class='ad-box'>buy</div><ul class='comments'><li>nice</li></ul><div id='cookieNotice'>ok</div><p hidden>x</p><button>go</button></article>"
    assert blocks(parse(drop)) == ["text"]
