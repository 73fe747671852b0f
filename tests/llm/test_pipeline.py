"""The stages one after the other: columns, effects and the round trip of the last."""

from __future__ import annotations

import corpus_pipeline
from edge_documents import frame, make
from hostwarden.llm import decontamination, simhash

FOLDER = "/root/testdata/sf0.001"


def test_every_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    columns, kept = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), name)
        assert docs.columns == columns
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert left and left <= kept
        kept = left
        if name == "simhash_near_dedup":
            groups = simhash.near_duplicates(docs, corpus_pipeline.SHINGLE, corpus_pipeline.RADIUS)
            assert groups.select("component_id").distinct().count() == len(left)
        if name == "substring_dedup":
            assert docs.filter("text IS NULL").count() == 0
        if name == "benchmark_decontamination":
            assert decontamination.contamination(docs, benchmark).filter("contaminated").count() == 0
    pieces = corpus_pipeline.pack(spark, docs, FOLDER)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == kept
    lengths = pieces.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in lengths)


def test_stages_take_odd_rows_and_empty_tables(spark):
    """Nulls, ties, repeated rows and clashing columns through all stages, then a table without rows."""
    for rows in (make(), []):
        docs = frame(spark, rows)
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.written(stage(spark, docs, FOLDER), name)
            assert docs.columns == columns
        pieces = corpus_pipeline.pack(spark, docs, FOLDER)
        assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
        assert (docs.count() > 0) == bool(rows)
        # No text without words passes the first stage.
        assert docs.filter("text IS NULL OR trim(text) = ''").count() == 0
