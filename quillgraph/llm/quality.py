"""Quality scores from positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are texts labelled good; everything else counts as unlabelled web text. With the
class prior p, the risk of a scorer g is p * E_pos[l(g)] + max(0, E_unl[l(-g)] - p * E_pos[l(-g)]): the
second part is the risk on bad texts, which can't be negative. The prior is estimated from the share of
unlabelled texts among the highest scores of a positive-against-unlabelled model (the smallest ratio
of the two tails, with a confidence margin); these tails are counted over all rows that are neither
held out nor among the at most MAX_UNLABELLED / 2 rows which that model learnt from. The scorer is logistic in features of the whole text:
how often each kind of byte follows each other kind, repetition of words and neighbouring words,
lengths of words, lines and text. No feature depends on id, source, language or label columns.

Weights are fitted on at most MAX_POSITIVE labelled and MAX_UNLABELLED unlabelled rows, the first in order of a hash of
their ids; of repeated ids one row. Counting the tails and scoring read every text once each, without a shuffle of texts.

Defined results: null and empty texts have the features of an empty text and get a score. A null doc_id is not held out and
never labelled. Labels of 0 or null are not read as negatives. Without a labelled positive every score is 1: nothing speaks
against any text. Repeated rows get equal scores. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, numbered

MAX_POSITIVE, MAX_UNLABELLED = 8_000, 12_000
THRESHOLD = 0.7
#: Kinds of bytes; those not named are kind 0 (other symbols and control bytes).
KINDS = (b" \t", b"\n\r\x0b\x0c", bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), b".,;:", b"!?", b"'\"()[]{}<>", b"-_/\\@", bytes(range(128, 192)), bytes(range(192, 256)))
N_KINDS = len(KINDS) + 1
N_FEATURES = N_KINDS * N_KINDS + 7


def _table() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for i, kind in enumerate(KINDS):
        out[np.frombuffer(kind, np.uint8)] = i + 1
    return out


def features(text: bytes | None, kinds: np.ndarray) -> np.ndarray:
    data = text or b""
    out = np.zeros(N_FEATURES)
    k = kinds[np.frombuffer(data, np.uint8)]
    n = len(k)
    if n > 1:
        out[: N_KINDS * N_KINDS] = np.sqrt(np.bincount(k[:-1] * np.uint8(N_KINDS) + k[1:], minlength=N_KINDS * N_KINDS) / (n - 1))
    words = data.split()
    m = len(words)
    if m:
        again = sum(map(eq, words, words[1:]))
        out[-7:] = [
            len(set(words)) / m, again / m, np.log1p(m) / 10, np.log1p(n / m), np.log1p(n / (1 + data.count(b"\n"))) / 5,
            np.sqrt(len(set(words)) / m) * np.log1p(m) / 10, 1.0 / m,
        ]
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -8, 8)


def _descend(pos: np.ndarray, unl: np.ndarray, prior: float | None, steps: int, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights (last: bias). prior None: positives against unlabelled; else the non-negative risk."""
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    pos, unl = (np.hstack([x, np.ones((len(x), 1))]) for x in (pos, unl))
    w, m, v = np.zeros(pos.shape[1]), np.zeros(pos.shape[1]), np.zeros(pos.shape[1])
    for t in range(1, steps + 1):
        gp, gu = sig(pos @ w), sig(unl @ w)
        up, down, rest = -pos.T @ (1 - gp) / len(pos), pos.T @ gp / len(pos), unl.T @ gu / len(unl)
        if prior is None:
            g = (up + rest) / 2
        else:
            loss = lambda s: -np.log(np.clip(1 - s, 1e-12, 1)).mean()
            bad = loss(gu) - prior * loss(gp)
            g = prior * up + rest - prior * down if bad >= 0 else prior * down - rest
        g = g + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _bins(cuts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """How many of `values` reach none, one, two, ... of the ascending `cuts`."""
    return np.bincount(np.searchsorted(cuts, values, "right"), minlength=len(cuts) + 1)


def _prior(pos: np.ndarray, cuts: np.ndarray, bins: np.ndarray, delta: float) -> float:
    n = bins.sum()
    qp = 1 - np.searchsorted(np.sort(pos), cuts, "left") / len(pos)
    qu = np.cumsum(bins[::-1])[::-1][1:] / n
    margin = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(pos)) + 1 / np.sqrt(n))
    best = np.argmin((qu + margin) / qp)  # no cut is beyond the highest positive, so qp > 0
    return float(np.clip(qu[best] / qp[best], 0.01, 0.99))


def class_prior(pos: np.ndarray, unl: np.ndarray, delta: float = 0.1) -> float:
    """The smallest ratio of the tails of the two score samples, with a margin for their sizes."""
    cuts = np.unique(pos)
    return _prior(pos, cuts, _bins(cuts, unl), delta)


class Linear:
    """A linear function of standardized features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, w: np.ndarray):
        self.mean, self.scale, self.w = mean, scale, w

    def value(self, x: np.ndarray) -> np.ndarray:
        return _design(x, self.mean, self.scale) @ self.w[:-1] + self.w[-1]


class Model(Linear):
    def __init__(self, pos: np.ndarray, unl: np.ndarray, count: Callable[[Linear, np.ndarray], np.ndarray], delta: float = 0.1):
        """`count` gives the `_bins` of the corpus' values under a function fitted on every second row of `unl`, for given cuts."""
        both = np.vstack([pos, unl])
        mean, scale = both.mean(0), both.std(0) + 0.01
        p, u = _design(pos, mean, scale), _design(unl, mean, scale)
        self.prior = 0.5
        if len(p) > 1 and len(u) > 1:
            first = Linear(mean, scale, _descend(p[::2], u[::2], None, 200))
            own = first.value(pos[1::2])
            cuts = np.unique(own)
            self.prior = _prior(own, cuts, count(first, cuts), delta)
        super().__init__(mean, scale, _descend(p, u, self.prior, 600))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.value(x), -40, 40)))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))


def _chosen(ids: DataFrame, n: int) -> DataFrame:
    return ids.where(F.col("id").isNotNull() & ~held_out(F.col("id"))).distinct().orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(n)


def _collect(rows: DataFrame, ids: DataFrame) -> tuple[list, np.ndarray]:
    """The ids found in `rows` (id, text), which are bounded in number, in order of a hash; and the features of one row of each."""
    kind = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _table()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t, kinds).astype("<f4").tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["id", "f"])

    found = rows.join(F.broadcast(ids), "id", "left_semi").mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("f", T.BinaryType())]))
    got = found.groupBy("id").agg(F.min("f").alias("f")).orderBy(F.xxhash64(F.lit(5), "id"), "id").collect()
    return [r[0] for r in got], np.array([np.frombuffer(r[1], "<f4") for r in got], np.float64).reshape(len(got), N_FEATURES)


def _counted(rows: DataFrame, learnt: list, first: Linear, cuts: np.ndarray) -> np.ndarray:
    """`_bins` over all of `rows` (id, text) but the held out ones and those with an id in `learnt`; one row per bin and task moves."""
    known = rows.sparkSession.createDataFrame([(i,) for i in learnt], T.StructType([T.StructField("id", rows.schema["id"].dataType)]))
    rest = rows.where(~held_out(F.col("id"))).join(F.broadcast(known), "id", "left_anti").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, sums = _table(), np.zeros(len(cuts) + 1, np.int64)
        for batch in batches:
            if batch.num_rows:
                sums += _bins(cuts, first.value(np.array([features(t, kinds) for t in batch.column(0).to_pylist()])))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], names=["bin", "n"])

    out = np.zeros(len(cuts) + 1, np.int64)
    for at, n in rest.mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n")).collect():
        out[at] = n
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """From rows that are not held out; None without a positive."""
    bounded_batches(docs.sparkSession)
    rows = _texts(docs, id_col, text_col)
    _, pos = _collect(rows, _chosen(labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("id")), MAX_POSITIVE))
    ids, unl = _collect(rows, _chosen(rows.select("id"), MAX_UNLABELLED))
    return Model(pos, unl, lambda first, cuts: _counted(rows, ids[::2], first, cuts)) if len(pos) and len(unl) else None


def scored(docs: DataFrame, model: Model | None, text_col: str = "text", name: str = "score") -> DataFrame:
    """`docs` with the score of each whole text as column `name`."""
    rest = [f for f in docs.schema.fields if f.name != name]
    at = [f.name for f in rest].index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _table()
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            value = np.ones(len(texts)) if model is None else model.score(np.array([features(t, kinds) for t in texts]).reshape(len(texts), N_FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value, pa.float64())], names=[*batch.schema.names, name])

    return docs.select(*[F.col(f"`{f.name}`") for f in rest]).mapInArrow(run, T.StructType([*rest, T.StructField(name, T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted."""
    out = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` whose score reaches the threshold, with all their columns."""
    model = fit(docs, labels)
    docs, back, (text,) = numbered(docs, "text")
    return back(scored(docs, model, text).where(F.col("score") >= THRESHOLD))
