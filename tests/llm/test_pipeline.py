from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from barloom.llm.mixing import mix
from barloom.llm.queries import quality_weights

from . import brute
from .conftest import SCHEMA


@pytest.mark.parametrize("table", ["odd", "clashing", "none"])
def test_stages_on_odd_rows(request, spark, sf, table, tmp_path):
    docs = request.getfixturevalue(table)
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        assert out.columns == (docs.columns if k < 4 else ["doc_id", "start", "n_tokens", "ids_crc32"]), name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert (docs.count() == 0) == (table == "none")


def test_language_stage_keeps_clean_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "123 456 !!", "en", "s", 0)], SCHEMA)
    kept = {r.doc_id for r in cp.language_stage(spark, docs.unionByName(extra.select(docs.columns)), sf).collect()}
    assert not kept & {10**6, 10**6 + 1, 10**6 + 2} and len(kept) >= 0.99 * docs.count()


def test_one_document_of_each_group_stays(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {c for _, _, c, _ in brute.similar(rows)}
    got = [r.doc_id for r in cp.near_duplicate_stage(spark, docs, sf).collect()]
    assert sorted(got) == sorted(want)


def test_mixing_stage_repeats_whole_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    taken = {r.doc_id: r.taken // r["size"] for r in mix(docs, quality_weights(spark.read.parquet(f"{sf}/labels.parquet"))).collect() if r.taken}
    assert Counter(r.doc_id for r in cp.mixing_stage(spark, docs, sf).collect()) == taken


def test_language_stage_judges_rows_that_repeat_a_doc_id(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = docs.where("lang = 'en'").orderBy("doc_id").first()
    extra = spark.createDataFrame([(some.doc_id, "123 456 !!", "en", "s", 0), (some.doc_id, None, "en", "s", 0)], SCHEMA)
    kept = cp.language_stage(spark, docs.unionByName(extra.select(docs.columns)), sf).where(F.col("doc_id") == some.doc_id).collect()
    assert [r.text for r in kept] == [some.text]


def test_near_duplicates_among_rows_that_repeat_a_doc_id(spark, sf):
    say = lambda w: " ".join(f"{w}{k}" for k in range(40))
    rows = [(1, say("a")), (1, say("b")), (1, say("a") + " tail"), (5, say("a")), (6, say("b") + " end"), (6, say("c")), (None, say("a")), (None, say("d")), (None, None), (7, ""), (7, say("b"))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    kept = [(r.doc_id, r.text) for r in cp.near_duplicate_stage(spark, docs, sf).collect()]
    a = [x for x in kept if x in (rows[0], rows[2])]
    assert len(a) == 1 and sorted(map(str, kept)) == sorted(map(str, [*a, rows[1], rows[5], rows[7], rows[8], rows[9]]))


def test_mixing_stage_on_rows_that_repeat_a_doc_id(spark, sf, odd):
    docs = odd.unionByName(spark.createDataFrame([(3, f"again {'word ' * k}", "en", "s1", k) for k in range(1, 30)] + [(4, "equal rows here", "en", "s2", 1)] * 20, SCHEMA))
    labels = quality_weights(spark.read.parquet(f"{sf}/labels.parquet"))
    want = Counter()
    for r in mix(docs.withColumn("text_hash", F.xxhash64("text")), labels, more=("text_hash",)).collect():
        if r.taken:
            want[r.doc_id, r.text_hash] += r.taken // r["size"]
    got = Counter((r.doc_id, r.h) for r in cp.mixing_stage(spark, docs, sf).select("doc_id", F.xxhash64("text").alias("h")).collect())
    assert got == want


@pytest.mark.parametrize("name", ["times", "row", "time", "doc"])
def test_mixing_stage_keeps_columns_of_any_name(spark, sf, odd, name):
    out = cp.mixing_stage(spark, odd.withColumn(name, F.lit("mine")), sf)
    assert {r[0] for r in out.select(name).distinct().collect()} == {"mine"}


def test_run(spark, sf):
    out = cp.run(spark, sf)
    rows = out.orderBy("start").collect()
    assert rows[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    assert out.agg(F.max("doc_id")).first()[0] is not None and cp.ORACLE_SQL is None and len(cp.STAGES) == 5
