"""One query for each operator, over its whole table, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import rotate
from .collocations import mine
from .decontaminate import leaks
from .exact_dedup import exact_groups
from .filter_audit import audit, text_failures
from .html_extract import extract
from .jaccard_join import similar_groups
from .language_id import Model, held_out, identify
from .lm_score import score
from .mixing import mix
from .packing import pack, pieces
from .shared import bound_batches, shared_dir
from .substring_dedup import remove_repeats
from .token_store import TokenStore


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    store = TokenStore.write(docs, shared_dir(spark), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return store.fetch(docs.select("doc_id")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def quality_weights(labels: DataFrame) -> DataFrame:
    """Good documents weigh 2, poor ones 0.5; documents without a label weigh 1 in the mix."""
    return labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).select("doc_id", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0).alias("weight"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(_table(spark, sf_dir, "documents"), quality_weights(_table(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(_table(spark, sf_dir, "conversations"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = Model.train(docs.where(~held_out(F.col("doc_id"), 5, 0)))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(_table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 7, 2))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(_table(spark, sf_dir, "documents"), width=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(_table(spark, sf_dir, "documents"), width=5, similarity=0.8)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(text_failures(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")), "ABCDE", "part", ("good", "toxic"))


def op12_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return pieces(packed).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(_table(spark, sf_dir, "documents"), longest=5, least=100, top=2000)


QUERIES = {f.__name__: f for f in (op1_token_store, op2_html_extract, op3_mix_sources, op4_decontaminate, op5_language_id, op6_lm_score, op7_exact_dedup, op8_substring_dedup, op9_chat_rotation, op10_jaccard_join, op11_filter_audit, op12_pack_sequences, op13_collocations)}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"

ORACLES = {
    "op3_mix_sources": f"""
        WITH q AS (SELECT doc_id, CASE max(quality) WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS w FROM labels GROUP BY doc_id),
        d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORD}))::BIGINT AS size,
                -ln((('0x' || substr(sha256('17:' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / coalesce(w, 1.0) AS key
              FROM documents LEFT JOIN q USING (doc_id)),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        r AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, (source_size * 2)::DOUBLE AS cap FROM s),
        x AS (SELECT *, (sum(source_size) OVER () * 1.5 - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
              FROM r WINDOW w AS (ORDER BY cap / weight, source ASC NULLS LAST)),
        t AS (SELECT source, source_size, least(cap, coalesce(weight * (SELECT arg_min(rate, cap / weight) FROM x WHERE rate * weight <= cap), cap)) AS target FROM x),
        c AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs,
                sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, ((epochs + CASE WHEN target - epochs * source_size > 0 AND upto - size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM c""",
    "op9_chat_rotation": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '<| \1 |>', 'g') AS said FROM conversations),
        v AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM t WHERE speaker <> 'system'),
        s AS (SELECT conv_id, perspective, turn, speaker, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role, said
              FROM t JOIN v ON conv_id IS NOT DISTINCT FROM c),
        h AS (SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || replace(replace(replace(replace(replace(replace(replace(replace(speaker, '%', '%25'), ' ', '%20'), chr(9), '%09'), chr(10), '%0A'), chr(11), '%0B'), chr(12), '%0C'), chr(13), '%0D'), '<', '%3C') ELSE '' END || chr(10) AS head FROM s),
        g AS (SELECT *, head || said || '<|im_end|>' || chr(10) AS segment FROM h),
        e AS (SELECT *, (sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, segment ROWS UNBOUNDED PRECEDING))::BIGINT AS "end" FROM g)
        SELECT conv_id, perspective, turn, speaker, role, segment, "end" - length(segment) AS start, "end",
               CASE WHEN role = 'assistant' THEN "end" - length(segment) + length(head) ELSE "end" END AS mask_start,
               CASE WHEN role = 'assistant' THEN "end" - 1 ELSE "end" END AS mask_end FROM e""",
    "op7_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_FOLD} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d""",
    "op8_substring_dedup": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
        win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d)),
        rep AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
        gone AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest(generate_series(i, i + 34)) AS k FROM win SEMI JOIN rep USING (s))),
        word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM d),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY k) AS t FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op10_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD}, {_WORD}) AS w FROM documents),
        g AS (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0) GROUP BY ALL),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM both_ JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
        reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r),
        c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id),
        l AS (SELECT a AS doc_id, count(*) AS n_links FROM link GROUP BY a)
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, coalesce(n_links, 0)::BIGINT AS n_links
        FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN l USING (doc_id)""",
    # every order is walked, document by document
    "op11_filter_audit": f"""
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
        l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
        f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
                || (CASE WHEN 100 * len(regexp_extract_all(x, '[A-Z]')) > 3 * length(x) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END)
                || (CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY x) THEN 'E' ELSE '' END) AS fails FROM t LEFT JOIN l USING (doc_id)),
        c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
        o AS (SELECT a.c || b.c || d.c || e.c || g.c AS filter_order FROM c a, c b, c d, c e, c g WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
        w AS (SELECT part, good, toxic, fails, filter_order, list_min([instr(filter_order, y) FOR y IN string_split(fails, '')]) AS out_at FROM f, o),
        s AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter,
                count(*) FILTER (WHERE fails = '' OR out_at > step) AS kept, count(*) FILTER (WHERE fails <> '' AND out_at = step) AS removed,
                count(*) FILTER (WHERE contains(fails, substr(filter_order, step, 1)) AND out_at < step) AS redundant, count(*) FILTER (WHERE fails = substr(filter_order, step, 1)) AS unique_fails,
                count(*) FILTER (WHERE fails <> '' AND out_at = step AND good) AS good_lost, count(*) FILTER (WHERE fails <> '' AND out_at = step AND toxic) AS toxic_lost
              FROM w, (SELECT unnest(range(1, 6))::INT AS step) GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM s""",
    "op13_collocations": f"""
        WITH w AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(p, '[^\x20\x09]+') AS w
                   FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_FOLD}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
        g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m))),
        f AS (SELECT lang, m, phrase, count(*)::HUGEINT AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
        n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
        cuts AS (SELECT lang, m, phrase, a, unnest(range(1, m)) AS k FROM f WHERE m > 1),
        parts AS (SELECT *, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS x, array_to_string(string_split(phrase, ' ')[k + 1:m], ' ') AS y FROM cuts),
        scored AS (SELECT parts.*, p.a AS l, q.a AS r, n.n, (1000 * parts.a * n.n) // (p.a * q.a) AS score
                   FROM parts JOIN f p ON p.lang = parts.lang AND p.phrase = x JOIN f q ON q.lang = parts.lang AND q.phrase = y JOIN n ON n.lang = parts.lang),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = b.lang AND f.m > b.m AND 100 * f.a >= 100 * b.a AND contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' '))),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000""",
}
