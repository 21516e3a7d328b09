import os

import corpus_pipeline
import duckdb
import pytest

from textloom.llm.queries import ORACLES, QUERIES
from textloom.llm.queries import table as read

from ..conftest import DATA
from . import data
from .test_scans import contaminated


def test_stages_work_on_what_is_left(spark, tmp_path):
    docs, left = read(spark, DATA, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert name == "tokens" or out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    rows = [(r["doc_id"], r["text"]) for r in read(spark, DATA, "documents").collect()]
    keep = [r for r in rows if r[0] in left["language"]]
    assert len(rows) - len(keep) <= len(rows) // 50
    best = {}
    for d, t in sorted(keep):
        best[t.translate(data.LOWER)] = d
    keep = [r for r in keep if best[r[1].translate(data.LOWER)] == r[0]]
    assert left["exact"] == {d for d, _ in keep}
    linked = data.components(keep, 5)
    keep = [r for r in keep if linked[r[0]] == r[0]]
    assert left["near"] == {d for d, _ in keep}
    items = [(r["item_id"], r["text"]) for r in read(spark, DATA, "benchmark").collect()]
    clean = {r[0] for r in contaminated(keep, items) if not r[-1]}
    assert left["benchmark"] == left["tokens"] == clean


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_contract_queries(spark, name):
    got = QUERIES[name](spark, DATA)
    found = got.collect()
    if name in ORACLES:
        con = duckdb.connect()
        for f in os.listdir(DATA):
            con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
        twin = con.execute(ORACLES[name])
        names = [c[0] for c in twin.description]
        order = lambda cols, rows: sorted(tuple(str(r[cols.index(c)]) for c in sorted(cols)) for r in rows)
        assert order(got.columns, found) == order(names, twin.fetchall())
