import json
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillgraph.llm import packing, sharding, topk
from quillgraph.llm.common import Written

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_fast_ids_are_proven_from_the_file(tmp_path):
    assert packing.provably_plain(PATH)
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["merges"][40], spec["model"]["merges"][41] = spec["model"]["merges"][41], spec["model"]["merges"][40]
    (tmp_path / "other.json").write_text(json.dumps(spec), encoding="utf-8")
    assert not packing.provably_plain(str(tmp_path / "other.json"))


@pytest.mark.parametrize("low", [20, 110])
def test_handing_on_all_bins_packs_no_better(spark, low, monkeypatch, tmp_path):
    """Very many bins of equal fill and few small ones."""
    rng = random.Random(4)
    rows = [(g, g * 10_000 + i, rng.choice([150, 151, 160]) if i else low + g) for g in range(30) for i in range(200)]
    items = spark.createDataFrame(rows, "g long, key long, length long").repartition(30, "g").sortWithinPartitions("g", "length", "key")
    count = lambda: packing.places(items, Written(spark, "t"), 30, capacity=300, slack=1, fan=2).select("sequence_id").distinct().count()
    bounded = count()
    monkeypatch.setattr(packing, "handed_on", lambda fan, rounds: 10**9)
    assert bounded == count() < 30 * 200


def test_hypergeometric_law():
    rng = np.random.default_rng(5)
    draws = np.array([sharding.hypergeometric(rng, 40, 60, 30) for _ in range(4000)])
    assert abs(draws.mean() - 12) < 0.2 and abs(draws.var() - 30 * 0.4 * 0.6 * 70 / 99) < 0.5
    assert [sharding.hypergeometric(rng, *x) for x in ((0, 5, 3), (5, 0, 3), (5, 5, 0), (5, 5, 10))] == [0, 3, 0, 5]
    big = sharding.hypergeometric(rng, 10**12, 10**12, 10**12)
    assert abs(big - 5 * 10**11) < 10**7


def test_matrix_has_its_margins():
    m = np.array(sharding.communication_matrix([7, 0, 30, 5], [11, 11, 10, 10], 1))
    assert m.sum(1).tolist() == [7, 0, 30, 5] and m.sum(0).tolist() == [11, 11, 10, 10] and m.min() >= 0


@pytest.mark.parametrize("shards", [1, 3, 200])
def test_shards(docs, rows, shards, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 10)
    got = sharding.shard_rows(docs, shards).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert [(r["doc_id"], r["shard"], r["slot"]) for r in got if r["doc_id"] == 5] == [(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard_rows(docs, shards).collect() if r["doc_id"] == 5]


def test_shuffle_is_uniform(spark):
    """Where a row ends does not depend on where it was."""
    n, hits = 24, Counter()
    df = spark.range(n, numPartitions=2).select(F.col("id").alias("doc_id"))
    for seed in range(40):
        hits.update((r["doc_id"] // 12, r["shard"]) for r in sharding.shard_rows(df, 2, seed, stable=True).collect())
    assert all(180 < hits[a, b] < 300 for a in (0, 1) for b in (0, 1))


def test_empty(none, spark):
    assert sharding.shard_rows(none, 4).count() == 0 and packing.pack(none, PATH).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 2 == 0, 3).count() == 0


@pytest.mark.parametrize("options", [{}, {"capacity": 64}, {"capacity": 300, "slack": 1, "fan": 2}])
def test_pack(spark, docs, rows, options):
    capacity = options.get("capacity", 2048)
    special = "plain <|endoftext|> text  \n\n  x"
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(999, special)], "doc_id long, text string")).repartition(5)
    got = packing.pack(df, PATH, **options).collect()
    t = Tokenizer.from_file(PATH)
    want = Counter()
    for i, x in [*rows, (999, special)]:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4")
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], zlib.crc32(bytes(r["ids"]))) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in bins.values():
        v.sort()
        assert [a for a, _ in v] == [sum(n for _, n in v[:i]) for i in range(len(v))] and sum(n for _, n in v) <= capacity
    least = math.ceil(sum(r["length"] for r in got) / capacity)
    assert len(bins) <= least * 1.05 + 1


def test_pack_sorted_by_length(spark):
    """Long texts in some partitions, short ones in others: packed nearly as by one best fit over all."""
    rng = np.random.default_rng(4)
    sizes = sorted([*rng.integers(35, 47, 1200).tolist(), *rng.integers(12, 25, 1300).tolist()])
    df = spark.createDataFrame(spark.sparkContext.parallelize([(i, "a " * n) for i, n in enumerate(sizes)], 16), "doc_id long, text string")
    got = packing.pack(df, PATH, capacity=64, slack=2).select("length", "sequence_id").collect()
    bins, _, _ = packing.best_fit(np.array([r["length"] for r in got]), 64)
    assert len({r["sequence_id"] for r in got}) <= 1.03 * len(set(bins.tolist()))


def test_best_fit():
    bins, offsets, fill = packing.best_fit(np.array([5, 7, 3, 10, 2, 3]), 10)
    assert len(set(bins.tolist())) == 3 and sorted(set(fill.tolist())) == [10] and offsets.tolist() == [0, 0, 7, 0, 8, 5]


def vectors(seed=1, n=300, dim=6):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)).astype("f4")
    v[50:150] = v[50]  # a third is one vector
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(1000, None), (1001, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (1002, [float("nan")] * dim), (1003, [float("inf")] * dim), (None, [9.0] * dim), (1004, [1.0, 2.0]), (1006, [3.0, 4.0]), (1008, []), (7, rows[3][1]), (10, rows[10][1]), (1010, [1e30] * dim)]
    return rows


@pytest.mark.parametrize("options", [{}, {"shard_rows": 40, "query_rows": 9}])
def test_top_k(spark, options):
    rows = vectors()[:-1]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("tag", F.lit(1)).repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 2 == 0, 5, **options).collect()
    ok = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = Counter()
    for i, q in ok:
        if i % 2 == 0:
            near = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ok if j != i and len(v) == len(q))[:5]
            want.update((i, r, j, -s) for r, (s, j) in enumerate(near, 1))
    assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want


def test_scores_stay_exact():
    big = np.array([[2**40, 1], [2**40, 2]], np.int64)
    assert topk.exact(big)[0].dtype == object
    i, ids, score = topk.search(topk.Tree(np.array([1, 2]), np.array([[2**28, 1], [2**28, 2]])), np.array([9]), np.array([[2**28, 3]]), np.array([np.iinfo(np.int64).min]), np.array([0]), 1)
    assert ids.tolist() == [2] and score.tolist() == [2**56 + 6]
