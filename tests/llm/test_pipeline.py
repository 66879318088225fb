"""The pipeline and the registered queries on the small tables."""

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from sitelens.llm import decontaminate, lines, queries, simhash

SF = Path("/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="test tables are not here")


def test_queries_are_registered():
    numbers = {int(m[1]) for n in entry.queries() if (m := re.match(r"op(\d+)_", n))}
    assert numbers == set(range(1, 11)) and "pipeline" in entry.queries()


def test_line_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cursor = con.execute(lines.ORACLE)
    names = [d[0] for d in cursor.description]
    got = queries.line_dedup(spark, str(SF)).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(cursor.fetchall())


def test_stages(spark):
    """Every stage against what its operator says about the rows it was given."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    model = queries.toxicity_model(spark, str(SF), docs)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece"]

    clean = stages["toxicity"](spark, docs, str(SF)).cache()
    scored = queries.toxicity_score(spark, str(SF))
    assert clean.columns == columns and model is not None
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in scored.filter("predicted = 0").collect()}

    cut = stages["line_dedup"](spark, clean, str(SF)).cache()
    assert cut.columns == columns
    assert {(r.doc_id, r.text) for r in cut.collect()} == {(r.doc_id, r.text) for r in lines.dedup_lines(clean).collect()}

    first = stages["simhash_near_dedup"](spark, cut, str(SF)).cache()
    found = simhash.near_duplicates(cut).collect()
    assert first.columns == columns
    assert sorted(r.doc_id for r in first.collect()) == sorted({r.component_id for r in found})

    kept = stages["benchmark_decontamination"](spark, first, str(SF)).cache()
    bad = {r.doc_id for r in decontaminate.find_items(first, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert kept.columns == columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in first.collect()} - bad

    texts = {r.doc_id: r.text for r in kept.collect()}
    out = stages["sentencepiece"](spark, kept, str(SF)).collect()
    assert {r.doc_id: r.decoded for r in out} == texts and all(r.n_tokens == len(r.ids) for r in out)
    ran = corpus_pipeline.run(spark, str(SF)).collect()
    assert sorted((r.doc_id, r.ids) for r in ran) == sorted((r.doc_id, r.ids) for r in out)


def test_stages_bear_odd_rows(spark, docs_of, tmp_path):
    from .conftest import ODD

    docs = docs_of(ODD)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark = spark.createDataFrame([(1, None), (2, "the same row twice is one document here")], "item_id bigint, text string")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    # One of the texts without words stays, and the item of the benchmark goes.
    assert sorted((r.doc_id for r in docs.collect()), key=repr) == sorted([None, 900, 903, 905], key=repr)
    empty = docs_of([])
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.collect() == []
