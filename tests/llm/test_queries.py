import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from crestline.llm import catalog, decontamination, packing, secret_scan, simhash, toxicity

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()
KEYS = {"op8_chat_formatting": ["conv_id", "call_id"]}


@pytest.mark.parametrize("name", list(ORACLE))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    result = db.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(result.fetchall())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_whole_table(spark, name):
    table, key = {"op10_html_extraction": ("pages", "page_id"), "op11_embedding_whitening": ("embeddings", "vec_id")}.get(name, ("documents", "doc_id"))
    there = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
    got = {r[0] for r in QUERIES[name](spark, SF).select(key).collect()}
    assert got <= there if "decontamination" in name else got == there


def test_pipeline(spark):
    """Each stage against what its operator says of its own input, and the last piece by piece."""
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns, sizes = docs.columns, []
    for name, function in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = function(spark, docs, SF).cache()
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert after.keys() <= before.keys()
        sizes.append(len(after))
        if name == "secrets":
            assert after.keys() == before.keys()
        else:
            assert all(after[k] == before[k] for k in after)
        if name == "near_dedup":
            found = simhash.near_duplicates(docs).collect()
            assert all(r.doc_id == r.component_id for r in found)
        if name == "decontamination":
            assert decontamination.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    pieces = Counter(r.doc_id for r in packing.pack(docs).collect())
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == pieces
