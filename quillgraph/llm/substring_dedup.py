"""Exact substring deduplication by fixed-block anchors.

A passage is a repeat if it has at least `window` words and also stands in a document with a smaller id.

1. Texts are packed into chunks of a few MB, written once as compressed tables.
2. Index and probe. Every document's non-overlapping blocks of `block` words are the index; every rolling
   window of `block` words is a probe. Any `window` words of a document hold one whole block if
   window >= 2 * block - 1, so a repeat has an anchor: a block of the one text that is a rolling window of
   the other. Both sides go, as hash remainders packed per chunk and bucket (about 2 bytes a word), to the
   hash's bucket, which returns to each chunk the anchors that it shares.
3. Extension. A chunk looks at every window that overlaps an anchor by the whole block, i.e. it extends each anchor
   to both sides as far as a window reaches. Hashes of these windows (72 bits and the bucket) go to their buckets with the smallest
   doc_id of the chunk; a bucket returns the smallest doc_id of all chunks.
4. Windows that start in a smaller document are covered; adjoining covered windows form the maximal repeats.

Anchors only choose what is compared; step 3 decides. A passage that very many documents share costs each chunk
one entry, whatever its number of documents; no pairs are formed.

Defined results: a null text has no words. A null doc_id is larger than any other and never a reference. Rows with
equal ids don't remove each other's words. Other columns are not read. An empty table gives an empty result.
Ids are integers. Texts are read as bytes, so ill-formed UTF-8 passes through.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, bounded_batches
from .words import WordHashes, sequence_hashes

#: Stands for a null id.
LAST = np.iinfo(np.int64).max
#: The low bits of a window's hash choose its bucket; only the other 40 bits travel, with 32 of a second hash.
LOW, REST = np.uint64((1 << 24) - 1), np.uint64(24)
LEAST_CHUNK, MOST_CHUNK = 1 << 20, 64 << 20


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length, the first ascending: differences of the first, byte planes, zstd."""
    first = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in (first, *columns[1:])]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n, out, at = len(raw) // sum(np.dtype(k).itemsize for k in kinds), [], 0
    for k in kinds:
        size = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(k).ravel())
        at += n * size
    out[0] = np.cumsum(out[0], dtype=kinds[0])
    return out


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of a stream sorted by its first column, by that column."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[0] != key:
                yield key, held
                held = []
            key = row[0]
            held.append(row)
    if held:
        yield key, held


def chunked(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Rows of one column `blob`: documents up to about `size` bytes of text, as a compressed Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, n = [], [], 0

        def blob() -> pa.RecordBatch:
            rows = pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.large_binary())], names=["doc_id", "text"])
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_batch(rows)
            return pa.RecordBatch.from_arrays([pa.array([zstandard.ZstdCompressor(level=6).compress(sink.getbuffer())], pa.binary())], names=["blob"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                n += len(t or b"") + 16
                if n >= size:
                    yield blob()
                    ids, texts, n = [], [], 0
        if ids:
            yield blob()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "blob binary")


class Words:
    """The words of one chunk's documents in one array of hashes."""

    def __init__(self, blob: bytes, hashes: WordHashes, window: int, block: int):
        with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)) as source:
            rows = source.read_all()
        self.ids = rows.column(0).to_pylist()
        self.words = [(t or b"").split() for t in rows.column(1).to_pylist()]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.hashes = np.concatenate([*(hashes.of(w) for w in self.words), np.empty(0, np.uint64)])
        self.doc = np.repeat(np.arange(len(self.ids)), self.sizes)
        self.window, self.block = window, block

    def grams(self, salt: int = 0) -> np.ndarray:
        """The hash of the `block` words from each place on; there is one for every place but the last ones."""
        if len(self.hashes) < self.block:
            return np.empty(0, np.uint64)
        return sequence_hashes(self.hashes ^ np.uint64(salt), self.block)

    def within(self, length: int) -> np.ndarray:
        """Whether the `length` words from each place on are of one document."""
        n = max(0, len(self.doc) - length + 1)
        return self.doc[:n] == self.doc[length - 1 : length - 1 + n]

    def keys(self, buckets: int) -> np.ndarray:
        """bucket << 32 | remainder << 2 for each rolling window."""
        g = self.grams()
        return (g % np.uint64(buckets)) << np.uint64(32) | (g >> np.uint64(34)) << np.uint64(2)

    def long_hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes (64 and 32 bits) of the `window` words from each place in `at` on: their first and last blocks overlap or adjoin."""
        step = self.window - self.block
        a, b = self.grams(), self.grams(0x5851F42D4C957F2D)
        one = (a[at] ^ (a[at + step] >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + a[at + step] * np.uint64(0xC2B2AE3D27D4EB4F)
        two = (b[at] ^ (b[at + step] >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + b[at + step] * np.uint64(0xA0761D6478BD642F)
        return one ^ (one >> np.uint64(32)), (two >> np.uint64(32)).astype(np.uint32)


def _packets(at: np.ndarray) -> Iterator[tuple[int, slice]]:
    """bucket and slice of each run of equal values in `at`."""
    if len(at):
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield int(at[a]), slice(a, b)


def _rows(rows: list[tuple], *names: str) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "chunk": pa.int64(), "data": pa.binary(), "role": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[n]) for i, n in enumerate(names)], names=list(names))


PACKETS = "bucket int, chunk long, data binary"


def probes(chunks: DataFrame, window: int, block: int, buckets: int) -> DataFrame:
    """What each chunk sends to each bucket: its rolling windows' remainders, marked 1 for blocks of the index and 2 if not alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = Words(blob, hashes, window, block)
                keys, ok = own.keys(buckets), own.within(block)
                index = (np.arange(len(keys)) - own.starts[own.doc[: len(keys)]]) % block == 0
                keys = np.sort((keys | index.astype(np.uint64))[ok])
                _, first, n = np.unique(keys >> np.uint64(2), return_index=True, return_counts=True)
                last = first + n - 1  # the mark sorts last
                keys = keys[last] | (n > 1).astype(np.uint64) << np.uint64(1)
                yield _rows([(b, chunk, pack(keys[s].astype(np.uint32))) for b, s in _packets(keys >> np.uint64(32))], "bucket", "chunk", "data")

    return chunks.mapInArrow(run, PACKETS)


def anchors(sent: DataFrame) -> DataFrame:
    """For each chunk and bucket, the remainders of blocks that stand in another place too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in groups(batches):
            each = [unpack(data, np.uint32)[0] for _, _, data in rows]
            every = np.sort(np.concatenate(each))
            values, first, n = np.unique(every >> np.uint32(2), return_index=True, return_counts=True)
            marks = np.bitwise_or.reduceat(every, first)
            shared = values[((n > 1) | (marks & 2 > 0)) & (marks & 1 > 0)]
            out = []
            for (_, chunk, _), own in zip(rows, each, strict=True):
                own = own >> np.uint32(2)
                if len(hit := own[np.isin(own, shared, assume_unique=True)]):
                    out.append((bucket, chunk, pack(hit)))
            yield _rows(out, "bucket", "chunk", "data")

    return _by(sent, "bucket").mapInArrow(run, PACKETS)


def _by(rows: DataFrame, key: str, *then: str) -> DataFrame:
    return rows.repartition(key).sortWithinPartitions(key, *then)


def _with_chunks(chunks: DataFrame, packets: DataFrame) -> DataFrame:
    """chunk, role, bucket, data: each chunk's packets (role 0), then its blob (role 1)."""
    rows = packets.select("chunk", F.lit(0).alias("role"), "bucket", "data")
    return _by(rows.union(chunks.select("chunk", F.lit(1), F.lit(-1), "blob")), "chunk", "role")


def extensions(chunks: DataFrame, shared: DataFrame, window: int, block: int, buckets: int) -> DataFrame:
    """For each chunk and bucket: hashes of the windows around shared anchors, smallest doc_id, whether more than one document has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for chunk, rows in groups(batches):
            hits = [np.uint64(b) << np.uint64(32) | unpack(d, np.uint32)[0].astype(np.uint64) << np.uint64(2) for _, role, b, d in rows if not role]
            if not hits:
                continue
            own = Words(rows[-1][3], hashes, window, block)
            hit = np.isin(own.keys(buckets), np.concatenate(hits))
            hit &= own.within(block)
            if len(own.doc) < window:
                continue
            sums = np.concatenate([[0], np.cumsum(hit)])
            reach = window - block + 1
            near = (sums[reach:] - sums[:-reach] > 0) & own.within(window)
            at = np.flatnonzero(near)
            one, two = own.long_hashes(at)
            ids = np.array([LAST if i is None else i for i in own.ids], np.int64)[own.doc[at]]
            bucket, one = (one & LOW) % np.uint64(buckets), one >> REST
            order = np.lexsort((ids, two, one, bucket))
            one, two, ids, bucket = one[order], two[order], ids[order], bucket[order]
            new = np.ones(len(one), bool)
            new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            first = np.flatnonzero(new)
            most = np.maximum.reduceat(ids, first) if len(first) else ids
            more = (most != ids[first]).astype(np.uint8)
            one, two, ids = one[first], two[first], ids[first]
            yield _rows([(b, chunk, pack(one[s], two[s], ids[s], more[s])) for b, s in _packets(bucket[first])], "bucket", "chunk", "data")

    return _with_chunks(chunks, shared).mapInArrow(run, PACKETS)


def references(windows: DataFrame) -> DataFrame:
    """For each chunk and bucket: the windows of its documents that also start in a smaller one, and the smallest doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in groups(batches):
            each = [unpack(d, np.uint64, np.uint32, np.int64, np.uint8) for _, _, d in rows]
            one, two, ids, more = (np.concatenate(c) for c in zip(*each, strict=True))
            source = np.repeat(np.arange(len(each)), [len(c[0]) for c in each])
            order = np.lexsort((ids, two, one))
            one, two, ids, more, source = one[order], two[order], ids[order], more[order], source[order]
            new = np.ones(len(one), bool)
            new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            least = ids[new][np.cumsum(new) - 1]
            keep = (ids > least) | (more > 0)
            one, two, least, source = one[keep], two[keep], least[keep], source[keep]
            order = np.argsort(source, kind="stable")  # within a chunk, hashes stay in order
            one, two, least, source = one[order], two[order], least[order], source[order]
            yield _rows([(bucket, rows[k][1], pack(one[s], two[s], least[s])) for k, s in _packets(source)], "bucket", "chunk", "data")

    return _by(windows, "bucket").mapInArrow(run, PACKETS)


def removed(chunks: DataFrame, found: DataFrame, window: int, block: int) -> DataFrame:
    """doc_id, n_words, n_removed, spans of removed words (start, end), kept_text for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for _, rows in groups(batches):
            own = Words(rows[-1][3], hashes, window, block)
            drop = np.zeros(len(own.doc) + 1, np.int64)
            if packets := [unpack(d, np.uint64, np.uint32, np.int64) for _, role, _, d in rows if not role]:
                one, two, least = (np.concatenate(c) for c in zip(*packets, strict=True))
                order = np.lexsort((two, one))
                one, two, least = one[order], two[order], least[order]
                at = np.flatnonzero(own.within(window))
                a, b = own.long_hashes(at)
                a >>= REST
                some = np.isin(a, one)
                at, a, b = at[some], a[some], b[some]
                low, high = np.searchsorted(one, a, "left"), np.searchsorted(one, a, "right")
                ids = np.array([LAST if i is None else i for i in own.ids], np.int64)[own.doc[at]]
                covered = np.zeros(len(at), bool)
                for k in range(int((high - low).max(initial=0))):  # windows that share the first hash; nearly always one
                    j = np.minimum(low + k, high - 1)
                    covered |= (low + k < high) & (two[j] == b) & (least[j] < ids)
                drop += np.bincount(at[covered], minlength=len(drop))
                drop -= np.bincount(at[covered] + window, minlength=len(drop))
            gone = np.cumsum(drop)[:-1] > 0
            out = []
            for i, (doc, words) in enumerate(zip(own.ids, own.words, strict=True)):
                mask = gone[own.starts[i] : own.starts[i + 1]]
                if mask.any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                    spans = [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()]
                    kept = b" ".join([w for w, m in zip(words, mask.tolist(), strict=True) if not m])
                else:
                    spans, kept = [], b" ".join(words)
                out.append((doc, len(words), int(mask.sum()), spans, kept))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), span, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["doc_id", "n_words", "n_removed", "spans", "kept"])

    rows = _with_chunks(chunks, found).mapInArrow(run, "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
    return rows.withColumn("kept_text", F.col("kept").cast("string")).drop("kept")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, block: int = 7, chunk_bytes: int | None = None, buckets: int | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, spans (word ranges removed), kept_text (words joined by one space).

    Chunks grow with the square root of the corpus, so that a chunk's packet for a bucket stays worth sending;
    buckets hold about 64 MB of packed windows at most.
    """
    if window < 2 * block - 1 or window > 2 * block:
        raise ValueError("needs 2 * block - 1 <= window <= 2 * block")
    spark = docs.sparkSession
    bounded_batches(spark)
    kept = Written(spark, "substring")
    total = docs.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    size = chunk_bytes or int(min(MOST_CHUNK, max(LEAST_CHUNK, (total * 4096) ** 0.5)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or max(4 * parts, total // (128 << 20))
    chunks = chunked(docs, id_col, text_col, size).select(F.monotonically_increasing_id().alias("chunk"), "blob")
    chunks = kept.table(chunks, "uncompressed")
    shared = anchors(probes(chunks, window, block, buckets))
    windows = extensions(chunks, shared, window, block, buckets)
    return removed(chunks, references(windows), window, block)
