"""Mixing documents to target domain weights by soft membership (DataFrame functions and DataFrame-based ML only).

1. A multinomial naive Bayes classifier over hashed words learns domains from a labelled table: at most MAX_LABELLED rows, the first by a hash of
   their ids. It gives every document a posterior p over the domains; t is its number of tokens (words).
2. Rates r >= least are fitted by projected-gradient least squares so that sum(r * t * p) is the target of each domain. A step is
   r <- max(least, r - p . y) with y = H^-1 (sum(r t p) - target) and H = sum(t p p'): the gradient in the metric that gives
   equal documents of any length equal rates. Each step is one aggregation to a handful of numbers; rates are a fold of p over the
   steps so far, written out every FOLD steps. H is taken over the documents above `least`, which alone can give way; a step that
   makes things worse is taken back and taken again with H over all. Steps end when targets are met to TOLERANCE, or bring too little.
3. `copies` are the rate's whole part, and one more with a probability of its fraction, by a hash of the row.

Targets are weights times `total` tokens (by default those that there are); with total='cover' the total is COVER times the least for which no
domain need shrink, so with least=1 every document stays. (COVER leaves room for documents that belong to several domains.)

Defined results: null and empty texts have no tokens, the prior as posterior, and take part in no sum. Domains without any posterior mass can't be filled;
the others still reach their targets. Labels outside the weights are not read. Domains without labelled rows get no mass;
without any labelled row every posterior is uniform. Repeated rows get
equal rates and copies. An empty table gives an empty result. Added columns replace input columns of the same name.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, bounded_groups, numbered

MAX_LABELLED = 4_000
BUCKETS = 4_096
FOLD = 12
MAX_STEPS = 60
TOLERANCE = 1e-6
#: The shortest share of a step that is tried, and the relative miss from which the caller is warned.
SHORTEST = 0.25
MISSED = 1e-3
COVER = 1.1


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _hashed(docs: DataFrame, text_col: str) -> DataFrame:
    words = docs.withColumn("__words", _words(F.col(f"`{text_col}`")))
    return HashingTF(numFeatures=BUCKETS, inputCol="__words", outputCol="__tf").transform(words)


def fit(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text"):
    """A classifier from `labelled` (id, domain) and the domains it knows, of which there may be one only (without a classifier) or none."""
    index = F.coalesce(*[F.when(F.col("domain") == d, i) for i, d in enumerate(domains)])
    some = labelled.where(F.col("id").isNotNull()).select("id", index.alias("__label")).where("__label IS NOT NULL")
    some = some.groupBy("id").agg(F.min("__label").alias("__label")).orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(MAX_LABELLED)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id").select("text", "__label")
    known = sorted(r[0] for r in rows.select("__label").distinct().collect())
    if len(known) < 2:
        return None, known
    place = F.coalesce(*[F.when(F.col("__label") == k, float(i)) for i, k in enumerate(known)])
    rows = _hashed(rows, "text").select(place.alias("__label"), "__tf")
    return NaiveBayes(featuresCol="__tf", labelCol="__label", smoothing=0.5).fit(rows), known


def with_posteriors(docs: DataFrame, model, domains: list[str], text_col: str = "text", tokens: str = "tokens", posterior: str = "posterior") -> DataFrame:
    """`docs` with the number of tokens and the array of posteriors in the order of `domains`."""
    docs = docs.drop(tokens, posterior)
    n = len(domains)
    model, known = model
    keep = [F.col(f"`{c}`") for c in docs.columns]
    if model is None:
        flat = F.array(*[F.lit(float(i in known) if known else 1.0 / n) for i in range(n)])
        return docs.select(*keep, F.size(_words(F.col(f"`{text_col}`"))).cast("long").alias(tokens), flat.alias(posterior))
    model = model.copy().setProbabilityCol("__p").setRawPredictionCol("").setPredictionCol("")
    found = model.transform(_hashed(docs, text_col)).withColumn("__p", vector_to_array("__p"))
    at = lambda i: F.get("__p", F.lit(known.index(i))) if i in known else F.lit(0.0)
    return found.select(*keep, F.size("__words").cast("long").alias(tokens), F.array(*[at(i) for i in range(n)]).alias(posterior))


def rate(start: Column, steps: list[np.ndarray], posterior: str, least: float) -> Column:
    if not steps:
        return start
    moves = F.lit([[float(v) for v in y] for y in steps])
    dot = lambda y: F.aggregate(F.zip_with(y, F.col(posterior), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(moves, start, lambda r, y: F.greatest(F.lit(float(least)), r - dot(y)))


def fit_rates(table: DataFrame, weights: list[float], kept: Written, total: float | str | None = None, least: float = 0.0, tokens: str = "tokens", posterior: str = "posterior") -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The steps whose `rate` gives each row's rate, the totals reached, the targets."""
    n = len(weights)
    p = [F.get(posterior, F.lit(i)) for i in range(n)]
    pairs = [(i, j) for i in range(n) for j in range(i, n)]

    def sums(rows: DataFrame, r: Column) -> tuple[np.ndarray, np.ndarray]:
        """sum(r t p), and sum(t p p') of rows that can give way."""
        t = F.col(tokens)
        free = F.when(r > least, t).otherwise(0.0)
        total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
        got = rows.agg(*[total(t * p[i] * r) for i in range(n)], *[total(free * p[i] * p[j]) for i, j in pairs]).first()
        h = np.zeros((n, n))
        for (i, j), v in zip(pairs, got[n:], strict=True):
            h[i, j] = h[j, i] = v
        return np.array(got[:n], float), h

    one = F.lit(1.0)
    now, h = sums(table, one)
    _, whole = sums(table, F.lit(least + 1.0))
    inverse = lambda m: np.linalg.pinv(m, rcond=1e-9)
    w = np.array(weights, float) / sum(weights)
    some = now > 0
    if total == "cover":
        total = COVER * float(max([now.sum(), *(now[some & (w > 0)] / w[some & (w > 0)])]))
    target = w * (now.sum() if total is None else total)
    miss = lambda x: float(np.linalg.norm((x - target)[some]) / max(1.0, target.max(initial=1.0)))
    steps: list[np.ndarray] = []
    rows, folded, idle, safe, share = table.select(tokens, posterior, one.alias("__r")), 0, 0, False, 1.0
    for _ in range(MAX_STEPS):
        size = miss(now)
        if size < TOLERANCE or idle >= 4:
            break
        step = share * (inverse(whole if safe else h) @ (now - target))
        if len(steps) - folded >= FOLD:
            rows = kept.table(rows.withColumn("__r", rate(F.col("__r"), steps[folded:], posterior, least)))
            folded = len(steps)
        new, new_h = sums(rows, rate(F.col("__r"), [*steps[folded:], step], posterior, least))
        if miss(new) < size:
            idle = idle + 1 if miss(new) > 0.98 * size else 0
            steps.append(step)
            now, h, safe, share = new, new_h, False, 1.0
        elif not safe:
            safe = True
        elif share > SHORTEST:
            share /= 2
        else:
            break
    if miss(now) >= MISSED:
        warnings.warn(f"the targets can't be met within the bounds of the rates: totals {now.round(1).tolist()}, targets {target.round(1).tolist()}", stacklevel=3)
    return steps, now, target


def copies(r: Column, *key: Column) -> Column:
    share = (F.pmod(F.xxhash64(F.lit(23), *key), F.lit(1 << 40)) / F.lit(float(1 << 40)))
    return (F.floor(r) + (share < r - F.floor(r)).cast("long")).cast("long")


def mixing_rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], total: float | str | None = None, least: float = 0.0) -> DataFrame:
    """One row per row of `docs`: doc_id, tokens, posterior, rate, copies."""
    kept = Written(docs.sparkSession, "mixing")
    domains = sorted(weights)
    table = with_posteriors(docs.select("doc_id", "text"), fit(docs, labelled, domains), domains)
    table = kept.table(table.select("doc_id", "tokens", "posterior"))
    steps, _, _ = fit_rates(table, [weights[d] for d in domains], kept, total, least)
    return table.withColumn("rate", rate(F.lit(1.0), steps, "posterior", least)).withColumn("copies", copies(F.col("rate"), F.col("doc_id")))


def mixed(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], total: float | str | None = "cover", least: float = 1.0) -> DataFrame:
    """The rows of `docs`, each repeated as often as its rate says."""
    bounded_groups(docs.sparkSession)
    kept = Written(docs.sparkSession, "mixing")
    domains = sorted(weights)
    model = fit(docs, labelled, domains)
    table = kept.table(with_posteriors(docs.select("text"), model, domains).select("tokens", "posterior"))
    steps, _, _ = fit_rates(table, [weights[d] for d in domains], kept, total, least)
    docs, back, (id_col, text_col) = numbered(docs, "doc_id", "text")
    rows = with_posteriors(docs, model, domains, text_col).withColumn("rate", rate(F.lit(1.0), steps, "posterior", least))
    rows = rows.withColumn("n", copies(F.col("rate"), F.col(id_col)).cast("int"))
    return back(rows.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), F.col("n"))).alias("copy")))
