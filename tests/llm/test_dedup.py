import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import exact_dedup, near_dedup, substring_dedup
from quillgraph.llm.common import Written, components


def plain_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return Counter((i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), groups


@pytest.mark.parametrize("ident", [exact_dedup.identifier, lambda c: F.pmod(F.xxhash64(c), F.lit(7)), lambda c: F.length(c) % 2])
def test_exact(docs, rows, ident):
    want, groups = plain_exact(rows)
    got = exact_dedup.exact_groups(docs, ident=ident).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    kept = exact_dedup.exact_dedup(docs, ident=ident)
    assert kept.columns == docs.columns and sorted((r["text"] or "") for r in kept.collect()) == sorted(groups)


def test_exact_beyond_the_inline_bound(docs, rows, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_INLINE", 0)
    assert exact_dedup.exact_dedup(docs, ident=lambda c: F.length(c) % 2).count() == len(plain_exact(rows)[1])


def test_chunks_join_to_the_text(spark, rows):
    got = spark.createDataFrame([(t,) for _, t in rows if t], "t string").select("t", exact_dedup.chunks(F.col("t")).alias("c")).collect()
    assert all("".join(r["c"]) == r["t"] for r in got) and max(len(r["c"]) for r in got) > 20
    long = max((t for _, t in rows if t), key=len)
    a, b = (set(spark.createDataFrame([(x,)], "t string").select(exact_dedup.chunks(F.col("t"), 64, 1024)).first()[0]) for x in (long, "inserted " + long))
    assert len(a & b) > 0.8 * len(a)  # boundaries follow the content


def test_empty_tables(none):
    assert exact_dedup.exact_groups(none).count() == exact_dedup.exact_dedup(none).count() == near_dedup.near_groups(none).count() == near_dedup.near_dedup(none).count() == substring_dedup.substring_dedup(none).count() == 0


def shingles(t, n):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def plain_near(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    first = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        first[find(i)].append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in first.items()}
    return Counter((d, len(sets[i]), d if not sets[i] else least[find(i)]) for i, (d, _) in enumerate(rows)), len({find(i) for i in range(len(rows)) if sets[i]})


@pytest.mark.parametrize(("n", "num", "den"), [(3, 85, 100), (5, 80, 100)])
def test_near(docs, rows, n, num, den):
    want, groups = plain_near(rows, n, num, den)
    got = near_dedup.near_groups(docs, words=n, num=num, den=den).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    kept = near_dedup.near_dedup(docs, words=n, num=num, den=den)
    texts = [r["text"] for r in kept.collect()]
    assert kept.columns == docs.columns
    assert sum(bool(shingles(t, n)) for t in texts) == groups and sum(not shingles(t, n) for t in texts) == sum(not shingles(t, n) for _, t in rows)


def test_links_that_no_hub_makes(spark, monkeypatch):
    """A chain: neighbours are alike, others are not; the hub sees only some."""
    monkeypatch.setattr(near_dedup, "BLOCK", 100)
    monkeypatch.setattr(near_dedup, "SALT_ROWS", 2)
    words = [f"w{i}" for i in range(600)]
    rows = [(i, " ".join(words[i * 12 : i * 12 + 200])) for i in (7, 0, 3, 1, 9, 5, 2, 8, 4, 6, 30)]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), words=3, num=85, den=100).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_near(rows, 3, 85, 100)[0]
    assert {r["component_id"] for r in got} == {0, 30}


def test_overlap_bound():
    for k, t in ((64, 0.85), (64, 0.8), (128, 0.85)):
        m = near_dedup.least_overlap(k, t)
        rng = np.random.default_rng(1)
        assert 0.3 * k < m < t * k and (rng.binomial(k, t, 100_000) >= m).all()


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 1), (20, 21), (5, 5)] + [(100, i) for i in range(101, 130)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long"), Written(spark, "t")).collect()}
    assert got == {**{i: 1 for i in (1, 2, 3, 7, 8, 9)}, 20: 20, 21: 20, **{i: 100 for i in range(100, 130)}}


def plain_substring(rows, window):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    out = Counter()
    for i, t in rows:
        w = (t or "").encode().split()
        drop = [False] * len(w)
        for j in range(len(w) - window + 1):
            f = first.get(tuple(w[j : j + window]))
            if f is not None and (i is None or f < i):
                drop[j : j + window] = [True] * window
        out[i, len(w), sum(drop), b" ".join(a for a, d in zip(w, drop, strict=True) if not d).decode()] += 1
    return out


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 500, "buckets": 3}, {"chunk_bytes": 1 << 24, "buckets": 1}, {"window": 5, "block": 3}, {"window": 8, "block": 4}])
def test_substring(docs, rows, options):
    got = substring_dedup.substring_dedup(docs, **options).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == plain_substring(rows, options.get("window", 13))
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in got)


def test_substring_wants_blocks_that_fit(docs):
    with pytest.raises(ValueError, match="window"):
        substring_dedup.substring_dedup(docs, window=13, block=8)


def test_packets():
    a = np.sort(np.random.default_rng(1).integers(0, 2**63, 500, dtype=np.uint64))
    b = np.arange(500, dtype=np.int64) - 250
    got = substring_dedup.unpack(substring_dedup.pack(a, b), np.uint64, np.int64)
    assert (got[0] == a).all() and (got[1] == b).all()


def test_blocks_of_a_family_repeat_few_rows(spark):
    """A family that no hub has linked is compared in blocks; its rows are not repeated many times for them."""
    kept = Written(spark, "t")
    members = spark.range(1000).selectExpr("0L AS hub", "id AS cid", "10L AS n_shingles")
    both, family = near_dedup._families(members, spark.createDataFrame([], "node long, root long"), kept)
    (one,) = family.collect()
    assert one["u"] == 999
    sets = spark.range(1000).selectExpr("id AS cid", "unhex(lpad(hex(cid + 1), 16, '0')) AS values")
    assert one["u"] * one["rights"] + 1000 * one["lefts"] <= 2 * 1000
    assert near_dedup.rest(both, family, sets, 8, 10).count() == 0
