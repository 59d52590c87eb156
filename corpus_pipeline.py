"""Corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept. The first four return the columns of ``documents``; other columns
are dropped, and clashing names of theirs do no harm.

A null text counts as an empty one: it is scored, has no near duplicates, leaks
and secrets, stays null and is packed as one token. Rows with a null doc_id are
kept like others. Rows that share a doc_id are told apart by their texts; repeated
rows stay until the near-duplicate stage keeps one of them, by least doc_id, then
by least hash of text. Very long texts are handled whole. Empty tables give empty
results; without labels every row scores 0.5 and is kept."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandgraph.llm import decontaminate as tiles
from strandgraph.llm import near_dedup, packing, quality, secret_scan
from strandgraph.llm.common import Scratch, prepare, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark, docs, sf_dir):
    """Rows that the classifier accepts; fitted on labelled rows out of the held-out fold."""
    prepare(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~quality.held_out()))
    return quality.scored(docs.select(COLUMNS), model).where(F.col("score") >= quality.ACCEPT).select(COLUMNS)


def near_duplicates(spark, docs, sf_dir):
    """One row of each class of near duplicates; its least doc_id, rows without one
    last. Rows are told apart by their texts, so shared and null doc_ids lose none."""
    prepare(spark)
    return near_dedup.one_of_each(docs.select(COLUMNS)).select(COLUMNS)


def decontaminate(spark, docs, sf_dir):
    """Rows that no benchmark item leaks into."""
    prepare(spark)
    return tiles.clean(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def redact_secrets(spark, docs, sf_dir):
    """All rows, secrets in their texts replaced, ``n_chars`` to match."""
    prepare(spark)
    out = secret_scan.scan_secrets(docs.select(COLUMNS), mask="[secret]")
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))).select(COLUMNS)


def pack(spark, docs, sf_dir):
    """The pieces of all texts with their sequences."""
    prepare(spark)
    return packing.packed(packing.pieces(docs))


STAGES = [("quality", quality_filter), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", redact_secrets), ("packing", pack)]

#: No SQL: the first stage is a fitted model, the last one a packing.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Applies the stages to ``documents``; each result is written to the shared
    checkpoint folder, read again, and deleted once the next one is written."""
    prepare(spark)
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    before = []
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        scratch.drop(*before)  # what follows from it is written
        before = [name]
    return docs
