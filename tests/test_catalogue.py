"""A part of the catalogue against its SQL in DuckDB, on the smallest driver tables."""

import os

import duckdb
import pytest

import __spark_entry__
from marginalia.plans import catalogue, queries_more

FOLDER = "/root/testdata/sf0.001"
NAMES = ["bm25_batch", "trigram_cosine_topk", "hybrid_retrieve", "path_key_parse", "cite_precision_recall", "score_dashboard", "rescue_stats", "cohen_kappa_by_class", "stratified_split", "graph_expand_one_hop", "session_memory_batch", "manifest_verify", "build_hash", *sorted(set(queries_more.__dict__) & set(catalogue.ORACLES))]


def values(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: "null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are absent")
@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for file in os.listdir(FOLDER):
        if file.endswith(".parquet"):
            con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{FOLDER}/{file}'")
    ours = catalogue.QUERIES[name](spark, FOLDER)
    theirs = con.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    assert values(ours.collect(), ours.columns) == values(theirs.fetchall(), columns)


def test_head_markers_read_every_line(spark, tmp_path):
    lines = ["5.1. Purposes of Act", "(2.1) A landlord shall", "(a) in the case", "1. A tenant", "(iv) by mail", "Schedule 1 Useful life", "", "plain"]
    spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, lines[2])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    ours = catalogue.QUERIES["head_markers_of_lines"](spark, str(tmp_path))
    rows = values(ours.collect(), ours.columns)
    assert len(rows) == 9 and rows == values(con.execute(catalogue.ORACLES["head_markers_of_lines"]).fetchall(), ours.columns)
    assert [(r.section, r.subsection, r.clause, r.subparagraph) for r in ours.where("doc_id = 1").orderBy("pos").collect()][:3] == [("5.1", None, "5.1", None), (None, "2.1", None, None), (None, None, "a", None)]


def test_entry_registers_everything():
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
