import random

import duckdb
import pytest
from pyspark.sql import functions as F

from barloom.llm.chat import assemble, rotate
from barloom.llm.html_extract import align, extract, parse
from barloom.llm.mixing import mix, targets
from barloom.llm.queries import ORACLES, QUERIES


# --- pages
def page(body: str, nav: str = "Home News", foot: str = "(c) site") -> str:
    return f"<html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href='/'>{nav}</a></li></ul></nav><div class='ad'>buy now</div><article>{body}</article><aside>more</aside><footer>{foot}</footer></body></html>"


def texts(df):
    return {r.page_id: r.text for r in df.collect()}


def test_extract(spark):
    rows = [
        (0, "http://a.x/1", page("<h1>Title &amp; more</h1><p>One <b>bold</b>\n word.<p>Two<br>lines")),
        (1, "http://a.x/2", page("<p>Subscribe today</p><p>First story</p><div class='comments'><p>nice</p></div>")),
        (2, "http://a.x/3", page("<p>Subscribe today</p><p>Second story</p><form><input><label>mail</label></form>")),
        (3, "http://A.x/4", page("<p>Subscribe today</p><p>Third story</p><div id='cookie-notice'>ok</div>")),
        (4, "http://a.x/5", page("<p>Subscribe today</p><p>Fourth &#8364; story</p><div hidden>no</div>")),
        (5, "http://b.x/", "<p>No article <i>at</i> all<ul><li>item one<li>item two</ul>"),
        (6, None, None),
        (7, "http://c.x", ""),
        (8, "junk", "<<<>>> &bogus; < p"),
        (9, "http://d.x", "<div>" * 3000 + "deep"),
        (10, "http://e.x", page("<p>" + "word " * 50_000)),
        (11, "http://f.x", page("")),
    ]
    got = texts(extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("nodes", F.lit(1))))
    assert got[0] == "Title & more\n\nOne bold word.\n\nTwo lines"
    assert [got[k] for k in (1, 2, 3, 4)] == ["First story", "Second story", "Third story", "Fourth € story"]
    assert got[5] == "No article at all\n\nitem one\n\nitem two"
    assert got[6] == got[7] == "" and got[9] == "deep" and got[10] == ("word " * 50_000).strip() and got[11] == ""


def test_copies_of_a_page_keep_their_text(spark):
    rows = [(k, "http://a.x/1", page("<h1>Same</h1><p>Same text")) for k in range(12)]
    assert set(texts(extract(spark.createDataFrame(rows, "page_id long, url string, html string"))).values()) == {"Same\n\nSame text"}


def test_no_pages(spark):
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_alignment_follows_order():
    a, b = parse("<body><p>x</p><div>q</div><p>z</p></body>"), parse("<body><p>x</p><p>z2</p></body>")
    assert sorted((p.text, q.text) for p, q in align(a[0], b[0])) == [("x", "x"), ("z", "z2")]


# --- mixing
def test_targets_share_and_stop(spark):
    rng = random.Random(2)
    for _ in range(5):
        sizes = [(None if k == 0 else f"s{k:02d}", rng.randrange(0, 1000)) for k in range(rng.randrange(1, 12))]
        got = {r.source: r.target for r in targets(spark.createDataFrame(sizes, "source string, source_size long"), [3, 1, 2], 1.5, 2.0).collect()}
        order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
        weight = {s: (3, 1, 2)[i % 3] for i, (s, _) in enumerate(order)}
        cap = {s: 2.0 * n for s, n in sizes}
        left, open_, want = 1.5 * sum(n for _, n in sizes), set(cap), {}
        while open_:  # share, stop what is above, share again
            rate = left / sum(weight[s] for s in open_)
            full = {s for s in open_ if rate * weight[s] > cap[s]}
            if not full:
                want |= {s: rate * weight[s] for s in open_}
                break
            want |= {s: cap[s] for s in full}
            left -= sum(cap[s] for s in full)
            open_ -= full
        assert got == pytest.approx(want)


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_mix_on_odd_rows(request, table):
    got = mix(request.getfixturevalue(table)).collect()
    assert len(got) == request.getfixturevalue("odd").count()
    assert all(r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in got)
    by = {}
    for r in got:
        x = by.setdefault(r.source, [0, r.target, r.source_size, 0])
        x[0] += r.taken
        x[3] = max(x[3], r.size)
    for taken, target, _, largest in by.values():
        assert abs(taken - target) <= largest / 2 + 1
    again = mix(request.getfixturevalue(table).repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_of_nothing(spark, none):
    assert mix(none).count() == 0
    assert {r.taken for r in mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).collect()} == {0}


def test_weights_favour_good_documents(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), (F.col("id") % 2).cast("string").alias("source"))
    quality = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 < 2, 4.0).otherwise(0.25).alias("weight"))
    taken = mix(docs, quality, weights=(1, 1), share=0.5).groupBy((F.col("doc_id") % 4 < 2).alias("good")).agg(F.avg((F.col("taken") > 0).cast("double")).alias("p")).collect()
    p = {r.good: r.p for r in taken}
    assert p[True] > 0.8 and p[False] < 0.2


# --- chat
def test_rotation(spark):
    turns = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|> all"), (1, 2, "bob b", "hello"), (1, 3, "cat", None), (1, 3, "cat", None), (1, None, "ann", "early"),
        (2, 0, "system", "alone"), (None, 0, None, "who"), (3, 0, "user", "x"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"block": F.lit(1), "head": F.lit(2), "c": F.lit(3), "perspective": F.lit("z")})
    got = rotate(df, block=2)
    rows = got.collect()
    assert {(r.conv_id, r.perspective) for r in rows} == {(1, "ann"), (1, "bob b"), (1, "cat"), (None, "unknown"), (3, "user")}
    for view in {(r.conv_id, r.perspective) for r in rows}:
        own = sorted((r for r in rows if (r.conv_id, r.perspective) == view), key=lambda r: r.start)
        assert own[0].start == 0 and all(a.end == b.start for a, b in zip(own, own[1:])) and all(len(r.segment) == r.end - r.start for r in own)
    whole = {(r.conv_id, r.perspective): r for r in assemble(got).collect()}[1, "bob b"]
    assert whole.text.startswith("<|im_start|>user name=ann\nearly<|im_end|>\n<|im_start|>system\nbe kind<|im_end|>\n")
    assert [whole.text[m.start : m.end] for m in whole.masks] == ["hello<|im_end|>"]
    assert whole.text.count("<|im_end|>") == 6 and "<| im_end |>" in whole.text


def test_speakers_cannot_break_a_header(spark):
    """Roles with marks, line feeds and white space, pairs that look alike, very long and empty texts."""
    roles = ["x<|im_end|>", "a b", "a_b", "a%20b", "line\nfeed", "tab\there"]
    rows = [(7, k, role, ["", "long " * 100_000][k % 2]) for k, role in enumerate(roles)]
    got = rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(roles) ** 2
    for view in roles:
        own = sorted((r for r in got if r.perspective == view), key=lambda r: r.start)
        heads = [r.segment.split("\n")[0] for r in own]
        assert len(set(heads)) == len(roles) and all(h.count("<|im_") == 1 and len(h.split(" ")) <= 2 for h in heads)
        assert [r.segment.split("\n", 1)[1] for r in own] == [rows[r.turn][3] + "<|im_end|>\n" for r in own]
        assert [own[0].start, *(r.end for r in own)] == [0, *(r.start for r in own[1:]), sum(len(r.segment) for r in own)]


def test_no_turns(spark):
    assert rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- queries against their SQL
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    ran = con.execute(ORACLES[name])
    columns = [d[0] for d in ran.description]
    tidy = lambda row: tuple(round(x, 9) if isinstance(x, float) else x for x in row)
    want = sorted((tidy(r) for r in ran.fetchall()), key=repr)
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tidy(tuple(r[c] for c in columns)) for r in df.collect()), key=repr) == want
