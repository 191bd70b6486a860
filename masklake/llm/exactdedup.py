"""Exact dedup over an extendible-hash index that lies on shared files.

A text's key is a 64-bit hash of its normalised form. Owners are equal ranges of keys (the key's top bits). Before the shuffle
each task folds the copies it holds into one row, so a hot group costs one row a batch. The owner's task then reads its
rows in key order and inserts each key into its part of the directory: a bucket holds at most `capacity` keys; one that
overflows is split by the next bit of the key, and the directory doubles when that bucket was as deep as the directory. Keys
whose texts differ form a chain; a text joins the member of the chain whose bytes are equal, or extends the chain. A task
holds the texts of one key and the keys of its range, never more.

The buckets' entries are written to the shared checkpoint folder as the index (`write_index`), bucket after bucket, with one row for each distinct text:
key, bucket (depth and prefix), place in the chain, digest, kept id, size. The directory (`directory`) is a table that leads from each slot, the
key's top bits up to the greatest depth, to a bucket. A document is looked up through it: its slot gives its bucket, and the bucket's chain for its key
holds the member of its digest. The directory is about as long as there are buckets; its join is left to the measured sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from masklake.llm.common import bound_batches, id_and_text, pieces, slots
from masklake.session import materialize

CAPACITY = 512
#: Stands for a missing id inside the index, so that any other is smaller.
NO_ID = (1 << 63) - 1


def normalised(text: Column) -> Column:
    """Every run of ASCII white space as one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


class Directory:
    """An owner's part of the extendible-hash directory, over the key bits below its own range."""

    def __init__(self, owner_bits: int, capacity: int):
        self.owner_bits, self.capacity, self.depth = owner_bits, capacity, 0
        self.slots: list[list] = [[0, []]]  # slot -> bucket [local depth, keys]; several slots may share a bucket

    def _slot(self, key: int, depth: int) -> int:
        return (key << self.owner_bits & 0xFFFFFFFFFFFFFFFF) >> 64 - depth if depth else 0

    def insert(self, key: int) -> None:
        bucket = self.slots[self._slot(key, self.depth)]
        bucket[1].append(key)
        while len(bucket[1]) > self.capacity and self.owner_bits + bucket[0] < 64:
            if bucket[0] == self.depth:
                self.slots = [b for b in self.slots for _ in (0, 1)]
                self.depth += 1
            local = bucket[0] + 1
            halves = [[local, []], [local, []]]
            for k in bucket[1]:
                halves[self._slot(k, local) & 1][1].append(k)
            first = self._slot(key, bucket[0]) << self.depth - bucket[0]
            width = 1 << self.depth - local
            self.slots[first:first + 2 * width] = [halves[0]] * width + [halves[1]] * width
            bucket = halves[self._slot(key, local) & 1]

    def bucket_of(self, key: int) -> tuple[int, int]:
        """(depth, prefix) of the key's bucket, counted from the key's top bit."""
        depth = self.owner_bits + self.slots[self._slot(key, self.depth)][0]
        return depth, key >> 64 - depth if depth else 0


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for the copies of a text within a batch; texts are compared, not only keys."""
    for batch in pieces(batches, "text", 16 << 20):
        key = np.asarray(batch.column("key"))
        order = np.argsort(key, kind="stable")
        again = np.flatnonzero(key[order][1:] == key[order][:-1])
        if not len(again):
            yield _entries(*(batch.column(c) for c in ("key", "text", "keep_id", "group_size")))
            continue
        ids, n = np.asarray(batch.column("keep_id")), np.asarray(batch.column("group_size")).copy()
        ids, gone = ids.copy(), np.zeros(len(batch), bool)
        shared, first = set(key[order][again].tolist()), {}
        texts = batch.column("text")
        for row in np.flatnonzero(np.isin(key, list(shared))).tolist():
            at = first.setdefault((int(key[row]), texts[row].as_py()), row)
            if at != row:
                ids[at], gone[row] = min(ids[at], ids[row]), True
                n[at] += n[row]
        stay = pa.array(~gone)
        yield _entries(batch.column("key").filter(stay), texts.filter(stay), pa.array(ids[~gone]), pa.array(n[~gone]))


def _entries(key, text, keep_id, group_size) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([key, text, keep_id, group_size], ["key", "text", "keep_id", "group_size"])


def _own(owner_bits: int, capacity: int):
    """The owner's work on its rows, which arrive sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory, owner, entries, chain, now = None, None, [], [], None

        def close() -> None:
            entries.extend((now, place, *member[1:]) for place, member in enumerate(chain))

        def out() -> pa.RecordBatch:
            depth, prefix = zip(*(directory.bucket_of(e[0]) for e in entries), strict=True)
            columns = [np.array([e[0] for e in entries], np.uint64).astype(np.int64), np.array(depth, np.int32),
                       np.array(prefix, np.uint64).astype(np.int64)]
            return pa.RecordBatch.from_arrays(
                [*map(pa.array, columns), pa.array([e[1] for e in entries], pa.int32()), pa.array([e[2] for e in entries], pa.string()),
                 pa.array([e[3] for e in entries], pa.int64()), pa.array([e[4] for e in entries], pa.int64())],
                ["key", "depth", "prefix", "place", "text_sha256", "keep_id", "group_size"])

        for batch in batches:
            keys = np.asarray(batch.column("key")).astype(np.uint64).tolist()
            texts, shas = batch.column("text"), batch.column("text_sha256")
            ids, sizes = batch.column("keep_id").to_pylist(), batch.column("group_size").to_pylist()
            for row, key in enumerate(keys):
                if key != now:
                    if now is not None:
                        close()
                    mine = key >> 64 - owner_bits
                    if mine != owner:
                        if entries:
                            yield out()
                        directory, owner, entries = Directory(owner_bits, capacity), mine, []
                    now, chain = key, []
                    directory.insert(key)
                text = texts[row].as_buffer()
                for member in chain:
                    if member[0] == text:
                        member[2] = min(member[2], ids[row])
                        member[3] += sizes[row]
                        break
                else:
                    # bytes of its own: a slice would keep the whole batch in memory
                    chain.append([pa.py_buffer(text.to_pybytes()), shas[row].as_py(), ids[row], sizes[row]])
        if now is not None:
            close()
            yield out()

    return run


def write_index(docs: DataFrame, key: Column | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The index of the column text: key, depth, prefix (of the bucket), place (in the chain), text_sha256, keep_id, group_size.

    `docs` has doc_id (a whole number) and text. `key` replaces the hash of the normalised text, which tests use to force collisions.
    """
    bound_batches(docs.sparkSession)
    owner_bits = max(4, (4 * slots(docs) - 1).bit_length())
    rows = id_and_text(docs).select(normalised(F.col("text")).alias("text"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("keep_id"))
    rows = rows.select(*[(F.xxhash64("text") if key is None else key).alias("key"), "text", "keep_id",
                         F.lit(1).cast("bigint").alias("group_size")])
    folded = rows.mapInArrow(_fold, rows.schema)
    folded = folded.select("*", F.sha2("text", 256).alias("text_sha256"),
                           F.expr(f"shiftrightunsigned(key, {64 - owner_bits})").alias("owner"))
    owned = folded.repartition(slots(docs), "owner").sortWithinPartitions("owner", "key")
    index = owned.select("key", "text", "text_sha256", "keep_id", "group_size").mapInArrow(
        _own(owner_bits, capacity),
        "key bigint, depth int, prefix bigint, place int, text_sha256 string, keep_id bigint, group_size bigint")
    return materialize(index, "exact-index")


def buckets(index: DataFrame) -> DataFrame:
    """The directory as a table: depth and prefix of each bucket, its keys and entries, and the directory slots that lead to it."""
    out = index.groupBy("depth", "prefix").agg(F.countDistinct("key").alias("keys"), F.count("*").alias("entries"))
    return out.crossJoin(F.broadcast(out.agg(F.max("depth").alias("global_depth")))).withColumn(
        "directory_slots", F.expr("shiftleft(1L, global_depth - depth)"))


def directory(index: DataFrame) -> DataFrame:
    """The directory: slot (the top `global_depth` bits of a key), depth and prefix of the bucket it leads to, global_depth."""
    table = index.select("depth", "prefix").distinct()
    deepest = table.agg(F.max("depth")).first()[0] or 0
    # a bucket less deep than the directory is shared by neighbouring slots
    first = F.expr(f"shiftleft(prefix, {deepest} - depth)")
    slots_ = F.sequence(first, first + F.expr(f"shiftleft(1L, {deepest} - depth) - 1"))
    return table.select(F.explode(slots_).alias("slot"), "depth", "prefix", F.lit(deepest).alias("global_depth"))


def look_up(rows: DataFrame, directory: DataFrame, entries: DataFrame) -> DataFrame:
    """`rows` (key, text_sha256, ...) with keep_id and group_size of their index entry, null where the bucket's chain has none.

    A row whose slot the directory lacks belongs to no bucket and is refused.
    """
    deepest = directory.agg(F.max("global_depth")).first()[0] or 0
    slot = F.shiftrightunsigned("key", 64 - deepest) if deepest else F.lit(0).cast("bigint")
    placed = rows.withColumn("slot", slot).join(directory.drop("global_depth"), "slot", "left")
    placed = placed.withColumn("depth", F.when(F.col("depth").isNull(), F.raise_error(F.lit("the directory has no bucket for a key")))
                               .otherwise(F.col("depth")))
    chain = entries.select("depth", "prefix", "key", "text_sha256", "keep_id", "group_size")
    return placed.join(chain, ["depth", "prefix", "key", "text_sha256"], "left").drop("depth", "prefix", "slot")


def dedup(docs: DataFrame, capacity: int = CAPACITY, key: Column | None = None) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text, in UTF-8).

    Of equal normalised texts the smallest doc_id stays; a null id is larger than any other. A null text counts as empty, and empty texts are equal to each other. doc_id is a whole number and
    unique; rows that repeat a doc_id together with its text are all counted and all marked kept if that id is. Other columns
    are not read. An empty table gives an empty result. Texts of any length are compared whole. `key` is that of `write_index`.
    """
    index = write_index(docs, key, capacity)
    rows = id_and_text(docs).select("doc_id", normalised(F.col("text")).alias("text"))
    rows = rows.select("doc_id", (F.xxhash64("text") if key is None else key).alias("key"), F.sha2("text", 256).alias("text_sha256"))
    joined = look_up(rows, directory(index), index.where("group_size > 1"))
    keep = F.when(F.col("keep_id").isNull(), F.col("doc_id").cast("bigint")).otherwise(F.nullif("keep_id", F.lit(NO_ID)))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
                         F.col("doc_id").cast("bigint").eqNullSafe(keep).alias("kept"), "text_sha256")
