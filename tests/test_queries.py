import duckdb
import pytest

import __spark_entry__ as entry
from quillgraph.plans import queries as graph

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(rows, columns):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(graph.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = graph.QUERIES[name](spark, DIR)
    rel = duck.sql(graph.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert plain(map(tuple, df.collect()), df.columns) == plain(rel.fetchall(), rel.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_source_lines_of_long_documents(spark, tmp_path):
    sizes = {1: 1, 2: 2, 3: 3, 4: 402, 5: 403, 6: 1001}
    rows = [(i, "\n".join(f"{i}:{k}" for k in range(1, n + 1))) for i, n in sizes.items()] + [(7, ""), (8, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, graph.get_source_lines(spark, str(tmp_path)).collect()))
    assert got == [(i, k, f"{i}:{k}") for i, n in sizes.items() for k in range(2, n)]
