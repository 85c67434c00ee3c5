"""From raw documents to a token store: five stages, each applying one corpus operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the shared
folder and reads it again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.decontaminate import clean
from barloom.llm.jaccard_join import similar_groups
from barloom.llm.language_id import Model, held_out, identify
from barloom.llm.mixing import mix
from barloom.llm.queries import quality_weights
from barloom.llm.shared import bound_batches, shared_dir
from barloom.llm.token_store import TokenStore

#: A document whose share of its main language falls below this is rejected
LEAST_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without letters, or without a main language; the rest stays as it is.

    The model learns from the documents that carry a language, those of a fifth left out.  A null or empty text has no letter
    and is rejected.  Each row is judged by its own text, also where rows repeat a doc_id, which may be null; equal rows share
    their fate.  Texts are read whole, of any length; where none carries a language, all are rejected; an empty table stays empty.
    """
    bound_batches(spark)
    model = Model.train(docs.where(~held_out(F.col("doc_id"), 5, 0)))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    passed = identify(texts, model, more=("text_hash",)).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    good = passed.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(good, docs.doc_id.eqNullSafe(good._id) & (F.xxhash64(docs.text) == good._hash), "left_semi").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) one row stays, of the smallest doc_id.

    Where several rows of a group have that doc_id, the text of the smallest hash stays; of rows with the same doc_id and text, any one.
    A null or empty text, or one without words, has no near copies and stays.  A null doc_id is larger than any other.
    Texts are read whole, of any length; an empty table stays empty.
    """
    bound_batches(spark)
    heads = similar_groups(docs, width=5, similarity=0.8, detail=True).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    single = F.col("group_id").isNull()
    keep = heads.groupBy("group_id", F.when(single, F.col("doc_id")).alias("alone"), F.when(single, F.col("text_hash")).alias("alone_hash")).agg(F.min("doc_id").alias("_id"), F.min("text_hash").alias("_hash")).select("_id", "_hash")
    kept = docs.join(keep, docs.doc_id.eqNullSafe(keep._id) & (F.xxhash64(docs.text) == keep._hash), "left_semi").select(*docs.columns)
    return kept.dropDuplicates(["doc_id", "text"])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, as `leaks` finds them.

    Each row is judged by its own text, also where rows repeat a doc_id, which may be null; a null or empty text holds no item and
    stays.  Texts are read whole, of any length; without benchmark items all rows stay; an empty table stays empty.
    """
    bound_batches(spark)
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources meet their targets; a document taken twice is two rows.

    A document without words (null and empty texts too) weighs nothing in any target and is not taken.  A null source is a source.  Rows are numbered and
    written first, so those that repeat a doc_id, or are equal altogether, are each taken as often as the mix says.  Texts are counted
    whole, of any length; an empty table stays empty.
    """
    folder = f"{shared_dir(spark)}/numbered"
    # one struct, so that no name of docs meets a name used here
    docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")).write.parquet(folder)
    rows = spark.read.parquet(folder)
    mixed = mix(rows.select("doc.doc_id", "doc.source", "doc.text", "row"), quality_weights(spark.read.parquet(f"{sf_dir}/labels.parquet")), more=("row",))
    times = mixed.where("taken > 0").select("row", (F.col("taken") / F.col("size")).cast("int").alias("times"))
    return rows.join(times, "row").withColumn("time", F.explode(F.sequence(F.lit(1), "times"))).select("doc.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the mix as a token store, and return what each of its rows holds, read back through the index.

    A null or empty text holds the end id alone.  Rows that repeat a doc_id are stored and returned each; a null doc_id
    is a key like others.  Texts are read whole, of any length; an empty table gives an empty store and no rows.
    """
    import public_tokenizers

    bound_batches(spark)
    store = TokenStore.write(docs, shared_dir(spark), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return store.fetch(docs.select("doc_id")).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: Language ID and template windows are not expressible in SQL; tests/llm holds the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
