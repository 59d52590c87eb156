"""The queries opN_<name> over the whole tables, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandgraph.llm.common import prepare, table


def op1_suffix_dedup(spark, sf_dir):
    from strandgraph.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(prepare(spark), sf_dir, "documents")).drop("spans")


def op2_html_extraction(spark, sf_dir):
    from strandgraph.llm.html_extract import extract

    return extract(table(prepare(spark), sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op3_secret_scan(spark, sf_dir):
    from strandgraph.llm.secret_scan import digest, scan_secrets

    return digest(scan_secrets(table(prepare(spark), sf_dir, "documents").select("doc_id", "text")).drop("text"))


def op4_decontamination(spark, sf_dir):
    from strandgraph.llm.decontaminate import leaks

    prepare(spark)
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_chat_format(spark, sf_dir):
    from strandgraph.llm.chat_format import rendered

    return rendered(table(prepare(spark), sf_dir, "conversations"))


def op6_license_scan(spark, sf_dir):
    from strandgraph.llm.license_scan import scan_licenses

    return scan_licenses(table(prepare(spark), sf_dir, "documents"))


def op7_telephony_audio(spark, sf_dir):
    from strandgraph.llm.telephony import describe, store

    d = describe(store(table(prepare(spark), sf_dir, "documents")))
    figures = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"]
    return d.select(*figures, F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")


def op8_best_fit_packing(spark, sf_dir):
    from strandgraph.llm.packing import packed, pieces

    return packed(pieces(table(prepare(spark), sf_dir, "documents")))


def op9_quality_classifier(spark, sf_dir):
    from strandgraph.llm.quality import ACCEPT, held_out, scored, train

    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    out = scored(docs, model).drop("text")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def op10_minhash_near_dedup(spark, sf_dir):
    from strandgraph.llm.near_dedup import near_duplicates

    return near_duplicates(table(prepare(spark), sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {name: f for name, f in globals().items() if (name.startswith("op") or name == "pipeline") and callable(f)}


CHAT_SQL = """
WITH t AS (
    SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
        md5(coalesce(role, '') || chr(10) || coalesce(text, '')) AS tie FROM conversations
), n AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, tie) AS k,
        count(*) OVER (PARTITION BY conv_id) AS n_turns,
        string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER (
            PARTITION BY conv_id ORDER BY turn, tie ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
    FROM t
), whole AS (SELECT conv_id, n_turns, upto FROM n WHERE k = n_turns),
prefix AS (SELECT DISTINCT k, upto FROM n WHERE k < n_turns),
kept AS (
    SELECT min(conv_id) AS conv_id FROM whole w
    WHERE NOT EXISTS (SELECT 1 FROM prefix p WHERE p.k = w.n_turns AND p.upto = w.upto) GROUP BY n_turns, upto
)
SELECT conv_id, CAST(floor(turn / 64) AS BIGINT) AS segment, CAST(any_value(n_turns) AS BIGINT) AS n_turns, CAST(min(k) - 1 AS BIGINT) AS first,
    string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn, tie) AS text
FROM n WHERE conv_id IN (SELECT conv_id FROM kept) GROUP BY conv_id, CAST(floor(turn / 64) AS BIGINT)
"""

def oracle_sql():
    return {"op5_chat_format": CHAT_SQL}
