import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quillgraph.llm import queries, quality

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df, rel = queries.QUERIES[name](spark, DIR), con.sql(queries.ORACLE_SQL[name])
    pick = lambda rows, columns: [tuple(r[columns.index(c)] for c in sorted(columns)) for r in rows]
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted(pick(map(tuple, df.collect()), df.columns), key=str) == sorted(pick(rel.fetchall(), rel.columns), key=str)


def test_all_are_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, seen = docs.columns, {"": {r["doc_id"]: r["text"] for r in docs.collect()}}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    last = ""
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            break
        assert docs.columns == columns
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(seen[name].items()) <= set(seen[last].items())
        last = name
    good = quality.quality_scores(spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")).where("predicted = 1")
    assert set(seen["quality"]) == {r[0] for r in good.select("doc_id").collect()}
    assert sorted(seen["exact_dedup"].values()) == sorted(set(seen["quality"].values()))
    sets = {i: (lambda w: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))))(t.lower().split()) for i, t in seen["exact_dedup"].items()}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    kept = sorted(seen["near_dedup"])
    assert not any(alike(a, b) for a in kept for b in kept if a < b)
    assert seen["mixing"] == seen["near_dedup"]
    assert {r[0] for r in docs.select("doc_id").distinct().collect()} == set(kept)
    total = docs.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in total) <= 2048


def test_run(spark):
    assert corpus_pipeline.run(spark, DIR).count() > 0
