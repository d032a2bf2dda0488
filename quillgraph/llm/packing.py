"""Best-fit packing of token sequences by hierarchical residual packing.

1. Each text is encoded by the tokenizer file and ended by `end_id`. Texts longer than `capacity` are cut into
   pieces of `capacity` tokens, of which the first may be shorter; no other text is cut. Pieces and their ids are
   written once.
2. Pieces are dealt by a hash to as many groups as there are input partitions, so that each sees the corpus's mix of
   lengths, however the input is sorted. Each group packs its pieces best-fit, longest first: a piece goes to the
   fullest bin that still has room for it. Bins with less than `slack` tokens of room are done.
3. The other bins become items of their fill. `fan` groups merge, pack these items best-fit, and so
   on up a tree to one group. What is left then is done too. Best fit leaves at most one bin of a group half full
   or less, and fuller ones never meet; so at most `fan` items a round find a bin of this group, and of bins with equal
   fill only `fan` for each round to come are handed on. More could change nothing, and no task grows with the corpus.
4. A bin merged into another keeps its pieces' order at a common offset; the merges are composed from the last round
   back, and ids join their places once.

Defined results: a null or empty text is its end id alone. Repeated rows are packed one by one. Null ids stay null.
Only doc_id and text are read. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Written, bounded_batches

CAPACITY = 2048
SLACK = 32
FAN = 8


#: Byte-level files write printable bytes as themselves and the others, in order, as the characters from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _file(path: str):
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    slow = Tokenizer.from_file(path)
    return spec, [t["content"] for t in spec.get("added_tokens", [])], lambda texts: [e.ids for e in slow.encode_batch(texts, add_special_tokens=False)]


def _fast(spec: dict, special: list[str]):
    import tiktoken

    ranks = {bytes(_BYTE[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _merged(parts: list[bytes], rank: dict[bytes, int], below: int) -> list[bytes]:
    """`parts` after all merges to tokens of a smaller id, the smallest first, from the left."""
    while len(parts) > 1:
        least, i = min((rank.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if least >= below:
            break
        parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]
    return parts


@lru_cache(maxsize=4)
def provably_plain(path: str) -> bool:
    """Whether `tiktoken` gives the ids of `tokenizers` for all texts without special strings, by the file itself.

    The file must be byte-level BPE of the usual pattern without any option that changes ids, with all bytes. Then `tokenizers` merges pairs
    by their place among the merges, `tiktoken` pairs whose joint token has the smallest id. These agree if merges are in order of the id they
    make and every token, cut by the merges before its own, is left as the two parts of its merge: then no other pair that makes it can ever
    stand alone in a text. Character classes of the two pattern engines are compared over every assigned code point, next to a letter, a digit,
    a sign and spaces.
    """
    spec, special, exact = _file(path)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")) or spec.get("normalizer"):
        return False
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return False
    if any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", ())):
        return False
    if any(c not in _BYTE for t in model["vocab"] if t not in special for c in t):
        return False
    rank = {bytes(_BYTE[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    merges = [tuple(bytes(_BYTE[c] for c in t) for t in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    made = [rank.get(a + b) for a, b in merges]
    if None in made or any(a >= b for a, b in zip(made, made[1:], strict=False)) or len(made) + 256 != len(rank) or any(bytes([b]) not in rank for b in range(256)):
        return False
    if any(_merged([bytes([x]) for x in a + b], rank, n) != [a, b] for (a, b), n in zip(merges, made, strict=True)):
        return False
    fast, known = _fast(spec, special), [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) not in ("Cs", "Cn", "Co")]
    for i in range(0, len(known), 500):  # a few at a time: what `tokenizers` returns is large
        text = "".join(f"a{c}a1{c}1-{c}- {c} \n{c}{c}" for c in known[i : i + 500])
        if not any(x in text for x in special) and [fast.encode_ordinary(text)] != exact([text]):
            return False
    return True


def encoder(path: str, plain: bool) -> Callable[[list[str]], list[list[int]]]:
    """Ids of texts, without special tokens added, as the `tokenizers` library gives them for the file. `plain`, what `provably_plain` says of the
    file: texts without any of its special strings are left to `tiktoken`, which is several times faster."""
    spec, special, exact = _file(path)
    if not plain:
        return exact
    fast = _fast(spec, special)
    return lambda texts: [exact([t])[0] if any(s in t for s in special) else fast.encode_ordinary(t) for t in texts]


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, piece, start, length, ids (unsigned 16-bit, or 32-bit if an id needs it, little-endian), wide."""
    kind, plain = docs.schema[id_col].dataType, provably_plain(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, plain)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, piece, start, length, data, wide = [], [], [], [], [], []
                for i, ids in enumerate(encode([t or "" for t in part.column(1).to_pylist()])):
                    ids.append(end_id)
                    every = np.array(ids, "<u4")
                    big = bool(every.max() > 65_535)
                    cuts = [0, *range(len(every) % capacity or capacity, len(every) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        row.append(i), piece.append(k), start.append(a), length.append(b - a), wide.append(big)
                        data.append(every[a:b].astype("<u4" if big else "<u2").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(data, pa.binary()), pa.array(wide, pa.bool_())],
                    names=["doc_id", "piece", "start", "length", "ids", "wide"],
                )

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("wide", T.BooleanType())])
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For items of these sizes: each one's bin (the index of its first item) and offset there, and each item's bin's fill."""
    order = np.argsort(-sizes, kind="stable").tolist()
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by room
    open_, bins, offsets, fill = 0, [0] * len(sizes), [0] * len(sizes), {}
    for i, n in zip(order, sizes[order].tolist(), strict=True):
        fits = open_ >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_ &= ~(1 << room)
        else:
            b, room, fill[i] = i, capacity, 0
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if room > n:
            rooms[room - n].append(b)
            open_ |= 1 << (room - n)
    bins = np.array(bins, np.int64)
    return bins, np.array(offsets, np.int64), np.array([fill[b] for b in bins.tolist()], np.int64)


def _round(items: DataFrame, capacity: int, slack: int, alike: int) -> DataFrame:
    """key, bin, offset, fill, open, g for items (g, key, length), each group g packed by itself; rows come sorted by g. Of bins with equal fill
    `alike` stay open at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(g: int, keys: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
            bins, offsets, fill = best_fit(sizes, capacity)
            first = bins == np.arange(len(bins))
            live = first & (fill <= capacity - slack)
            at = np.flatnonzero(live)
            at = at[np.argsort(fill[at], kind="stable")]
            nth = np.arange(len(at)) - np.searchsorted(fill[at], fill[at])
            live[at[nth >= alike]] = False
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(keys[bins]), pa.array(offsets), pa.array(fill), pa.array(live[bins]), pa.array(np.full(len(keys), g, np.int64))], names=["key", "bin", "offset", "fill", "open", "g"])

        held, group = [], None
        for batch in batches:
            g = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    if held and g[a] != group:
                        yield packed(group, *(np.concatenate(c) for c in zip(*held, strict=True)))
                        held = []
                    group = int(g[a])
                    held.append((batch.column(1).to_numpy(zero_copy_only=False)[a:b], batch.column(2).to_numpy(zero_copy_only=False)[a:b]))
        if held:
            yield packed(group, *(np.concatenate(c) for c in zip(*held, strict=True)))

    return items.select("g", "key", "length").mapInArrow(run, "key long, bin long, offset long, fill long, open boolean, g long")


def handed_on(fan: int, rounds: int) -> int:
    """How many bins of one fill a group can need in so many rounds to come."""
    return fan * rounds


def places(items: DataFrame, kept: Written, groups: int, capacity: int = CAPACITY, slack: int = SLACK, fan: int = FAN) -> DataFrame:
    """key, sequence_id, offset for items (g, key, length); g, below `groups`, is the group that packs first and must come sorted."""
    tops = [groups - 1]
    while tops[-1] > 0:
        tops.append(tops[-1] // fan)
    rounds = [kept.table(_round(items, capacity, slack, handed_on(fan, len(tops) - 1)))]
    for i, top in enumerate(tops[1:], 1):
        last = rounds[-1].where("open AND key = bin")
        merged = last.select(F.expr(f"g div {fan}").alias("g"), F.col("bin").alias("key"), F.col("fill").alias("length"))
        merged = merged.repartition(min(top + 1, 10_000), "g").sortWithinPartitions("g", "length", "key")
        rounds.append(kept.table(_round(merged, capacity, slack, handed_on(fan, len(tops) - 1 - i))))
    final = None
    for own in reversed(rounds):
        at = own.select("key", "bin", "offset")
        if final is None:
            final = at.select("key", F.col("bin").alias("sequence_id"), "offset")
        else:
            up = final.select(F.col("key").alias("bin"), "sequence_id", F.col("offset").alias("base"))
            final = at.join(up, "bin", "left").select("key", F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"))
    return final


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", slack: int = SLACK, fan: int = FAN) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id, offset."""
    bounded_batches(docs.sparkSession)
    kept = Written(docs.sparkSession, "packing")
    own = pieces(docs, path, capacity, end_id, id_col, text_col).select(F.monotonically_increasing_id().alias("key"), "*")
    own = kept.table(own, "zstd")
    n = (own.agg(F.max(F.shiftright("key", 33))).first()[0] or 0) + 1  # partitions that wrote pieces
    group = F.pmod(F.xxhash64(F.lit(29), "key"), F.lit(n))
    items = own.select(group.alias("g"), "key", "length").repartition(min(n, 10_000), "g").sortWithinPartitions("g", "length", "key")
    out = own.join(places(items, kept, n, capacity, slack, fan), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [d if w else np.frombuffer(d, "<u2").astype("<u4").tobytes() for d, w in zip(batch.column(4).to_pylist(), batch.column(7).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, pa.binary()), *batch.columns[5:7]], names=batch.schema.names[:7])

    out = out.select("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset", "wide")
    return out.mapInArrow(run, T.StructType(out.schema.fields[:7]))
