"""Near-duplicate detection: bottom-k sketches, inverted lists, union-sketch estimates, exact Jaccard.

1. Each text becomes its set of distinct word shingles, hashed with one 64-bit hash. Texts with equal
   sets form a class. A class keeps the k smallest hashes, its sketch.
2. Two sets with a Jaccard similarity of t or more share at least `least_overlap(k, t)` retained values
   (for sets smaller than t * k, which are kept whole, at least t times their size). Ordered by rarity,
   such sketches meet in their first `size - overlap + 1` values, so only those enter inverted lists: the
   values of very common passages are passed over, and no list is cut.
3. A list is not expanded into pairs. Its earliest class is the hub, and every other member is compared
   with it: first by the union sketch (the k smallest values of both), then exactly on the full sets.
4. Members that their hub does not link may still be linked with each other. Where they are many, the family is dealt
   into small blocks, compared in these, and dealt anew, in rounds. What stays apart is then compared with all members of
   its family, in blocks of bounded size. A block returns a spanning forest of the components that it connects, never all
   its links, and after the rounds few components are left to connect.
5. Links are joined into components.

The only step that is not exact is 2: a pair at exactly t goes unseen with a probability below
`MISS`, one more similar far more rarely.

Defined results: a null or empty text has an empty set, no link, and stays. Repeated rows and ids are rows
like others. A null doc_id sorts after all others: it is a component's id only if there is no other. Only
doc_id and text are read, whatever other columns are called. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Written, bounded_batches, components, joined_components, numbered
from .words import WordHashes, sequence_hashes, split_words

MISS = 1e-9
TOP = np.uint64(1 << 63)
#: Set elements on one side of a block of step 4 (8 bytes each), at most; and rows on it, or twice the root of the family's size if that is more.
BLOCK = 1_000_000
BLOCK_ROWS = 1024
#: Members compared with one copy of their hub's set in one task.
SALT_ROWS = 100
#: A family with more unlinked members than this is first compared within small blocks, in so many rounds at most.
FEW = 32
ROUNDS = 3


def least_overlap(k: int, t: float) -> int:
    """The largest m so that fewer than m of k union values are shared with a probability below MISS, at similarity t."""
    tail, m = 0.0, 0
    for i in range(k + 1):
        tail += math.comb(k, i) * t**i * (1 - t) ** (k - i)
        if tail > MISS:
            break
        m = i + 1
    return max(1, m)


def _sets(words: int, lower: bool):
    hashes = WordHashes()
    return lambda text: np.unique(sequence_hashes(hashes.of(split_words(text, lower)), words))


def _digest(own: np.ndarray) -> bytes | None:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, k: int, lower: bool) -> DataFrame:
    """doc_id, th (the text's hash), n_shingles, digest (16 bytes that stand for the set; null if it is empty), sketch."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _sets(words, lower)
        for batch in batches:
            own = [of(t) for t in batch.column(2).to_pylist()]
            low = [(s[:k] ^ TOP).view(np.int64) for s in own]  # as signed numbers in the same order
            ends = np.concatenate([[0], np.cumsum([len(s) for s in low])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in own], pa.int64()), pa.array(map(_digest, own), pa.binary()), pa.ListArray.from_arrays(ends, np.concatenate([*low, np.empty(0, np.int64)]))],
                names=["doc_id", "th", "n_shingles", "digest", "sketch"],
            )

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("th", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sketch", T.ArrayType(T.LongType()))])
    return docs.select(F.col(id_col), text_hash(text_col), F.col(text_col)).mapInArrow(run, schema)


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def full_sets(docs: DataFrame, need: DataFrame, id_col: str, text_col: str, words: int, lower: bool) -> DataFrame:
    """cid, values (the sorted set, 8 bytes each) for the classes in `need` (cid, digest, first, th).

    A class's text is found by its id and hash, which need no shingles; only texts found are shingled, and one whose set is another (a
    chance agreement of hashes) is left out. Each text moves once.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), text_hash(text_col).alias("own"), F.col(text_col).alias("text"))
    found = own.join(need, (own["own"] == need["th"]) & own["doc_id"].eqNullSafe(need["first"])).select("cid", "digest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, seen = _sets(words, lower), set()
        for batch in batches:
            rows = []
            for c, d, t in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c not in seen and _digest(own := of(t)) == d:
                    seen.add(c)
                    rows.append((c, own.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.binary())], names=["cid", "values"])

    return found.mapInArrow(run, "cid long, values binary")


def estimated(pairs: DataFrame, one: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (hub, cid) whose union sketch does not rule them out; `one` has the sketches (cid, s)."""
    o = least_overlap(k, num / den)
    near = pairs.join(one, "cid").join(one.select(F.col("cid").alias("hub"), F.col("s").alias("h")), "hub")
    union = F.slice(F.array_sort(F.array_union("s", "h")), 1, k)
    near = near.select("hub", "cid", F.size(union).alias("n"), F.size(F.array_intersect(F.array_intersect(union, F.col("s")), F.col("h"))).alias("hits"))
    return near.where(F.when(F.col("n") < k, F.col("hits") * den >= F.col("n") * num).otherwise(F.col("hits") >= o)).select("hub", "cid")


def verified(pairs: DataFrame, sets: DataFrame, kept: Written, num: int, den: int) -> DataFrame:
    """The pairs (hub, cid) whose full sets are similar enough, as (a, b). A hub's set is repeated once for SALT_ROWS members."""
    many = kept.table(pairs.groupBy("hub").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts")))
    hubs = many.join(sets.withColumnRenamed("cid", "hub"), "hub").select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("hub").alias("cid"), "values")
    salt = F.expr("int(pmod(xxhash64(cid), coalesce(salts, 1)))")
    members = pairs.join(many.where("salts > 1"), "hub", "left").select("hub", "cid", salt.alias("salt")).join(sets, "cid").select("hub", "salt", F.lit(1).alias("role"), "cid", "values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hub = None, np.empty(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for h, s, role, c, v in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                own = np.frombuffer(v, np.uint64)
                if not role:
                    key, hub = (h, s), own
                elif (h, s) == key:
                    both = len(np.intersect1d(hub, own, assume_unique=True))
                    if den * both >= num * (len(hub) + len(own) - both):
                        a.append(h), b.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = hubs.unionByName(members).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role")
    return dealt.mapInArrow(run, "a long, b long")


def _cross(num: int, den: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """A spanning forest of what the links between the left and the right rows of one block connect: components met already, within
        the block or before, need no further link."""
        rows = rows.sort_values("cid")  # families that share members mostly find the same links
        left, right = rows[rows.side == 0], rows[rows.side == 1]
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            labels, codes = np.unique(np.concatenate([left.comp, right.comp]), return_inverse=True)
            group = np.arange(len(labels))  # the least label known to be connected, for each label
            mine_at, their_at = codes[: len(left)], codes[len(left) :]
            own = [np.frombuffer(v, np.uint64) for v in right["values"]]
            sizes = np.array([len(v) for v in own])
            values, ids = np.unique(np.concatenate(own), return_inverse=True)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            cids, mark = right.cid.to_numpy(), np.zeros(len(values) + 1, np.int32)
            for c, at_label, v in zip(left.cid, mine_at, left["values"], strict=True):
                theirs = group[their_at]
                if (theirs == group[at_label]).all():
                    continue
                mine = np.frombuffer(v, np.uint64)
                at = np.searchsorted(values, mine)
                at = at[np.append(values, 0)[at] == mine]
                mark[at] = 1
                both = np.add.reduceat(mark[ids], starts)
                mark[at] = 0
                hit = np.flatnonzero((den * both >= num * (len(mine) + sizes - both)) & (theirs != group[at_label]))
                met, one = np.unique(theirs[hit], return_index=True)
                if len(met):
                    out += [(c, x) for x in cids[hit[one]]]
                    met = np.append(met, group[at_label])
                    group[np.isin(group, met)] = met.min()
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _families(members: DataFrame, comp: DataFrame, kept: Written) -> tuple[DataFrame, DataFrame]:
    """hub, cid, n_shingles, comp, apart (not yet connected with the hub) of `members` (hub, cid, n_shingles), the hubs included; and of each hub with
    unlinked members: their number u, lefts and rights (blocks for these and for all members)."""
    label = lambda key: comp.select(F.col("node").alias(key), F.col("root").alias(f"{key}_root"))
    both = members.join(label("cid"), "cid", "left").join(label("hub"), "hub", "left")
    both = both.select("hub", "cid", "n_shingles", F.coalesce("cid_root", "cid").alias("comp"), F.coalesce("hub_root", "hub").alias("own"))
    both = kept.table(both.select("hub", "cid", "n_shingles", "comp", (F.col("comp") != F.col("own")).alias("apart")))
    side = F.greatest(F.lit(BLOCK_ROWS), F.ceil(2 * F.sqrt(F.col("n"))))
    parts = lambda n, total: F.greatest(F.ceil(F.col(n) / side), F.ceil(F.col(total) / BLOCK)).cast("int")
    elements = F.sum(F.when(F.col("apart"), F.col("n_shingles")).otherwise(0))
    family = both.groupBy("hub").agg(F.count("*").alias("n"), F.sum(F.col("apart").cast("int")).alias("u"), elements.alias("ue"), F.sum("n_shingles").alias("ne")).where("n >= 3 AND u >= 1")
    return both, kept.table(family.select("hub", "u", parts("u", "ue").alias("lefts"), parts("n", "ne").alias("rights")))


def near_by(both: DataFrame, family: DataFrame, sets: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """Links within blocks into which a hash, another at each turn, deals the members of a family with more than FEW unlinked ones."""
    rows = both.join(family.where(F.col("u") > FEW), "hub").withColumn("l", F.expr(f"int(pmod(xxhash64(cid, {turn}), rights))"))
    sides = F.explode(F.when(F.col("apart"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1))))
    return rows.select("hub", "l", sides.alias("side"), "cid", "comp").join(sets, "cid").groupBy("hub", "l").applyInPandas(_cross(num, den), "a long, b long")


def rest(both: DataFrame, family: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links between the members of a family that are still apart and all others of it; for each block fewer than it has components."""
    rows = both.join(family, "hub")
    left = rows.where("apart").select("hub", F.expr("int(pmod(xxhash64(cid), lefts))").alias("l"), F.explode(F.expr("sequence(0, rights - 1)")).alias("r"), F.lit(0).alias("side"), "cid", "comp")
    right = rows.select("hub", F.explode(F.expr("sequence(0, lefts - 1)")).alias("l"), F.expr("int(pmod(xxhash64(cid, -1), rights))").alias("r"), F.lit(1).alias("side"), "cid", "comp")
    return left.unionByName(right).join(sets, "cid").groupBy("hub", "l", "r").applyInPandas(_cross(num, den), "a long, b long")


def classes_and_links(docs: DataFrame, kept: Written, id_col: str, text_col: str, words: int, num: int, den: int, k: int, lower: bool) -> tuple[DataFrame, DataFrame]:
    """own: doc_id, n_shingles, digest; classes: digest, first (smallest doc_id) and th (its text's hash), component (smallest doc_id reached), keep (the component's first class)."""
    bounded_batches(docs.sparkSession)
    result, kept = kept, Written(docs.sparkSession, "near-steps")
    t = num / den
    o = least_overlap(k, t)
    own = result.table(sketches(docs, id_col, text_col, words, k, lower))
    classes = own.where("n_shingles > 0").groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")).alias("one"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    classes = classes.select("digest", F.col("one.doc_id").alias("first"), F.col("one.th").alias("th"), "n_shingles", "sketch", F.monotonically_increasing_id().alias("cid"))
    classes = kept.table(classes)
    own = own.drop("sketch", "th")

    # What a hot key joins is written first: then Spark can send it to all tasks, or split the key's rows.
    values = classes.select("cid", F.explode("sketch").alias("v"))
    shared = kept.table(values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"))
    lists = values.join(shared, "v").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("shared"))
    need = F.when(F.col("n_shingles") < t * k, F.ceil((F.col("n_shingles") * num) / den)).otherwise(o)
    rank = F.struct(F.col("first").isNull().alias("no"), "first", "cid")
    room = (F.size("shared") - need + 1).cast("int")  # the values that no other class has come first
    prefix = lists.join(classes.select("cid", "first", "n_shingles", F.size("sketch").alias("kept")), "cid").where(room > 0)
    prefix = kept.table(prefix.select("cid", rank.alias("rank"), F.explode(F.slice("shared", 1, room)).alias("p")).select("cid", "rank", F.col("p.v").alias("v")))
    hubs = kept.table(prefix.groupBy("v").agg(F.min("rank").alias("hub"), F.count("*").alias("n")).where("n > 1").select("v", F.col("hub.cid").alias("hub")))
    star = kept.table(prefix.select("cid", "v").join(hubs, "v").where("cid <> hub").select("hub", "cid").distinct())

    one = classes.select("cid", F.col("sketch").alias("s"))
    near = kept.table(estimated(star, one, k, num, den))
    wide = kept.table(star.groupBy("hub").count().where("count > 1").select("hub"))
    star = kept.table(star.join(wide, "hub", "left_semi"))
    wanted = star.union(near).select(F.explode(F.array("hub", "cid")).alias("cid")).distinct()
    sets = kept.table(full_sets(docs, classes.join(wanted, "cid", "left_semi").select("cid", "digest", "first", "th"), id_col, text_col, words, lower))

    comp = components(verified(near, sets, kept, num, den), kept)
    members = star.select("hub", "cid").union(star.select("hub", F.col("hub").alias("cid")).distinct())
    members = kept.table(members.join(classes.select("cid", "n_shingles"), "cid"))
    for turn in range(ROUNDS):
        both, family = _families(members, comp, kept)
        found = kept.table(near_by(both, family, sets, turn, num, den))
        if found.isEmpty():
            break
        comp = joined_components(comp, found, kept)
    else:
        both, family = _families(members, comp, kept)
    more = kept.table(rest(both, family, sets, num, den))
    if not more.isEmpty():
        comp = joined_components(comp, more, kept)
    ranked = comp.join(classes.select(F.col("cid").alias("node"), rank.alias("rank")), "node")
    top = kept.table(ranked.groupBy("root").agg(F.min("rank").alias("top")))
    labelled = classes.select("digest", "cid", "first", "th").join(comp.withColumnRenamed("node", "cid"), "cid", "left").join(top, "root", "left")
    alone = F.col("top").isNull()
    labelled = labelled.select("digest", "first", "th", F.when(alone, F.col("first")).otherwise(F.col("top.first")).alias("component"), (alone | (F.col("cid") == F.col("top.cid"))).alias("keep"))
    labelled = result.table(labelled)
    kept.clear()
    return own, labelled


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100, k: int = 64, lower: bool = True) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id (the smallest doc_id reached), kept."""
    kept = Written(docs.sparkSession, "near")
    own, classes = classes_and_links(docs, kept, id_col, text_col, words, num, den, k, lower)
    out = own.join(classes.select("digest", "component"), "digest", "left")
    found = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", found.alias("component_id"), F.col("doc_id").eqNullSafe(found).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100, k: int = 64, lower: bool = True) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: one of each group, and all without words."""
    kept = Written(docs.sparkSession, "near")
    docs, back, (id_col, text_col) = numbered(docs, id_col, text_col)
    _, classes = classes_and_links(docs, kept, id_col, text_col, words, num, den, k, lower)
    first = classes.where("keep").select(F.col("th").alias("__t"), F.col("first").alias("__first"))
    rows = docs.withColumns({"__th": text_hash(text_col), "__none": ~F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")})
    rows = rows.join(first, (rows["__th"] == first["__t"]) & rows[id_col].eqNullSafe(first["__first"]), "left").where("__none OR __t IS NOT NULL")
    again = rows.where("NOT __none").groupBy(id_col, "__th").count().where("count > 1")
    if again.isEmpty():
        return back(rows)
    packed = F.struct(*docs.columns)
    alone = rows.where("__none").select(packed.alias("row"))
    one = rows.where("NOT __none").groupBy(id_col, text_col).agg(F.first(packed).alias("row")).select("row")
    return back(alone.union(one).select("row.*"))
