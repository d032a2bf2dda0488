import pytest
from pyspark.sql import functions as F

from quillgraph.functions import predicates as P


def table(spark, rule, values):
    return {r["v"]: r["x"] for r in spark.createDataFrame([(v,) for v in values], "v string").select("v", rule(F.col("v")).alias("x")).collect()}


def test_distinctive(spark):
    keep = ["/api/register", "/orders/{id}/ship", "STRIPE_WEBHOOK_URL", "order.created", "device_heartbeat", "abcdefghij"]
    reject = ["/health", "/metrics/", "/status", "/api/v1", "/", "DATABASE_URL", "NODE_ENV", "REDIS_URL", "", "name", "a.b", "short", "x y.zzz", None]
    found = table(spark, P.is_distinctive, keep + reject)
    assert [v for v in keep if not found[v]] == [] and [v for v in reject if found[v]] == []


def test_addresses(spark):
    assert table(spark, P.normalize_address, ["/a/{id}/b", "/{id}", "topic.x", "a//b"]) == {"/a/{id}/b": "/a/b", "/{id}": None, "topic.x": "topic.x", "a//b": "/a/b"}
    assert table(spark, P.asyncapi_path, ["/u/:id", "/u/<id>//x", "/u/{id}/"]) == {"/u/:id": "/u/{id}", "/u/<id>//x": "/u/{id}/x", "/u/{id}/": "/u/{id}"}
    assert table(spark, P.route_path, ["https://h/a?b", "/x#y", "x", "http://h"]) == {"https://h/a?b": "/a", "/x#y": "/x", "x": None, "http://h": None}


def test_two_rules_for_tests(spark):
    paths = ["test/a.c", "src/test/a.c", "tests/a.c", "a_test.py", "test_a.py", "src/FooTest.kt", "latest/a.c", "spec/a.js", "a.spec.ts"]
    assert {k for k, v in table(spark, P.is_test, paths).items() if v} == {"src/test/a.c", "tests/a.c", "a_test.py"}
    assert {k for k, v in table(spark, P.is_test_segment, paths).items() if v} == set(paths) - {"latest/a.c"}


def test_tokens_count_utf16_units(spark):
    assert table(spark, P.est_tokens, ["", "abcd", "é😀"]) == {"": 0, "abcd": 2, "é😀": 1}
    assert table(spark, P.utf16_length, ["é😀"]) == {"é😀": 3}


@pytest.mark.parametrize(("n", "shown"), [(940, "940"), (1600, "1.6K"), (277_000, "277K"), (1_900_000, "1.9M")])
def test_compact(spark, n, shown):
    assert spark.range(1).select(P.compact(F.lit(n))).first()[0] == shown
