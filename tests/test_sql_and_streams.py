import json

import pytest

from quillgraph.plans import build
from quillgraph.plans.sqlguard import Refused, answer, checked, query_sql
from quillgraph.sources import snapshot
from quillgraph.streaming.refresh import refresh_stream
from quillgraph.streaming.usage import residency_stream, windowed_counts
from trees import C_TREE, put


@pytest.mark.parametrize("text", ["", " ; ", "select 1; select 2", "select ';'", "drop table x", "update x set a = 1", "select replace('a', 'b', 'c')", "with q as (select 1) insert into t select * from q", "with q as (select 1) merge into t using q on true when matched then delete", "show tables", "set x = 1", "select 1 from a where b = 'DELETE'", "create view v as select 1", "explain select 1"])
def test_refused(spark, text):
    with pytest.raises(Refused):
        checked(spark, text)


def test_answered(spark):
    df = spark.range(300).withColumnRenamed("id", "n")
    tables = {"symbols": df}
    assert query_sql(spark, tables, " SELECT max(n) AS m FROM symbols ; ").first()["m"] == 299
    assert query_sql(spark, tables, "with q as (select n from symbols where n < :k) select count(*) c from q", {"k": 5}).first()["c"] == 5
    text = answer(spark, tables, "select n from symbols")
    assert len(json.loads(text.split("\n…")[0])) == 200 and "more rows omitted" in text
    assert answer(spark, tables, "select n from symbols where n < 0") == "(no rows)"
    assert answer(spark, tables, "select nope from symbols").startswith("Query error") and answer(spark, tables, "drop x").startswith("Query error")


def lines(folder, n, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows))


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_residency_stream(spark, tmp_path):
    row = lambda t, kind, saved=None, s="a": {"session": s, "t": t, "kind": kind, "saved": saved}
    src = tmp_path / "in"
    lines(src, 1, [row(100, "read", 1000.0), row(101, "turn"), row(102, "turn"), row(100, "read", 10.0, "b")])
    stream = spark.readStream.schema("session string, t long, kind string, saved double").option("maxFilesPerTrigger", 1).json(str(src))
    q = residency_stream(stream).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    assert spark.table("closed").count() == 0
    lines(src, 2, [row(103, "boundary"), row(104, "read", 500.0), row(105, "turn"), row(106, "boundary")])
    drain(q)
    assert sorted((r["t"], r["residency"], r["recurring"]) for r in spark.table("closed").collect()) == [(100, 2, 1200.0), (104, 1, 550.0)]


def test_residency_stream_of_sessions_without_a_boundary(spark, tmp_path):
    """A session that just stops is emitted once the watermark has passed its last event by the idle time, and its state goes."""
    row = lambda t, kind, saved=None, s="a": {"session": s, "t": t, "kind": kind, "saved": saved}
    src, minute = tmp_path / "in", 60_000
    lines(src, 1, [row(1 * minute, "read", 1000.0), row(2 * minute, "turn"), row(3 * minute, "read", 10.0)])
    stream = spark.readStream.schema("session string, t long, kind string, saved double").option("maxFilesPerTrigger", 1).json(str(src))
    q = residency_stream(stream, idle_ms=30 * minute).writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    assert spark.table("idle").count() == 0
    lines(src, 2, [row(90 * minute, "read", 5.0, "b")])
    q.processAllAvailable()
    lines(src, 3, [row(91 * minute, "turn", None, "b")])
    q.processAllAvailable()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    drain(q)
    assert sorted((r["session"], r["t"], r["residency"], r["recurring"]) for r in spark.table("idle").collect()) == [("a", minute, 1, 1100.0), ("a", 3 * minute, 0, 10.0)]
    assert rows[-1] == 1


def test_windows(spark, tmp_path):
    hour = 3_600_000
    lines(tmp_path / "in", 1, [{"t": 1, "kind": "use", "savedTokens": 5}, {"t": 2, "kind": "use", "savedTokens": 6}, {"t": hour + 1, "kind": "turn", "savedTokens": 0}])
    lines(tmp_path / "in", 2, [{"t": 9 * hour, "kind": "turn", "savedTokens": 0}])
    stream = spark.readStream.schema("t long, kind string, savedTokens long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    drain(q)
    assert sorted((r["kind"], r["n"], r["saved_tokens"]) for r in spark.table("counts").collect()) == [("turn", 1, 0), ("use", 2, 11)]


def test_refresh_stream(spark, tmp_path):
    root, folder = put(tmp_path / "prog", C_TREE), str(tmp_path / "g")
    snapshot.write(folder, build.build(spark, root, [root]))
    put(root, {"new.c": "int brand_new(void) { return leaf(1); }\n"})
    lines(tmp_path / "in", 1, [{"abs": f"{root}/new.c"}])
    stream = spark.readStream.schema("abs string").json(str(tmp_path / "in"))
    refresh_stream(stream, folder, root, [root], str(tmp_path / "c")).awaitTermination(120)
    assert snapshot.read(spark, folder)["symbols"].where("name = 'brand_new'").count() == 1
