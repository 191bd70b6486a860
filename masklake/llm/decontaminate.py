"""Benchmark decontamination: Wu-Manber search for every window of the benchmark, over words.

The benchmark items become windows of `window` consecutive words (shorter items are one window of their own length). Windows
of one length form a pattern set. A table over hashed blocks of three words (fewer for shorter windows) says how far a
search may move when the block under its end occurs in no window, or where it occurs last; blocks that end a window move
nothing, and their bucket lists the windows to compare with. A candidate is confirmed by comparing the words themselves.

The search runs on the documents where they lie: no shuffle, one pass for each block of the benchmark that fits `block_bytes`.
A benchmark beyond that bound takes several passes over the written documents, whose hits are united by row number. All texts of a batch are searched at
once: each text, cut into stretches, has a cursor, and the cursors move together in numpy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from masklake.llm.common import ALNUM, Words, bound_batches, id_and_text, pieces
from masklake.session import materialize

WINDOW = 10
BLOCK_WORDS = 3
BLOCK_BYTES = 32 << 20
_TABLE_BITS = 20
_STRETCH = 256


def _block_slot(hashes: np.ndarray, at: np.ndarray, block: int) -> np.ndarray:
    """Table slot of the block of words that ends at `at`."""
    h = hashes[at]
    for back in range(1, block):
        h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[at - back]
    return ((h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


class PatternSet:
    """Windows of one length with their shift table and suffix buckets."""

    def __init__(self, length: int, windows: dict[bytes, tuple[list[int], np.ndarray]]):
        self.length, self.block = length, min(BLOCK_WORDS, length)
        self.bytes = list(windows)
        self.items = [windows[w][0] for w in self.bytes]
        hashes = np.concatenate([windows[w][1] for w in self.bytes])
        ends = np.arange(len(self.bytes)) * length
        self.shift = np.full(1 << _TABLE_BITS, length - self.block + 1, np.int16 if length < 30000 else np.int32)
        for j in range(self.block - 1, length):
            np.minimum.at(self.shift, _block_slot(hashes, ends + j, self.block), length - 1 - j)
        last = _block_slot(hashes, ends + length - 1, self.block)
        self.order = np.argsort(last, kind="stable")
        self.bucket = last[self.order]
        # the whole window's fingerprint spares most direct comparisons inside a bucket
        self.prints = self._prints(hashes, ends)[self.order]
        self.known = np.sort(self.prints)

    def _prints(self, hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
        out = np.zeros(len(begin), np.uint64)
        for j in range(self.length):
            out = out * np.uint64(0x100000001B3) + hashes[begin + j]
        return out

    def search(self, words: Words) -> Iterator[tuple[int, int]]:
        """(first word, window number) of every occurrence; a window never spans two texts."""
        m = self.length
        lo, hi = words.first[:-1] + m - 1, words.first[1:]
        cut = np.maximum(0, -(-(hi - lo) // _STRETCH))
        if not cut.sum():
            return
        base = np.repeat(lo, cut) + _STRETCH * (np.arange(cut.sum()) - np.repeat(np.cumsum(cut) - cut, cut))
        stop = np.minimum(base + _STRETCH, np.repeat(hi, cut))
        at = base
        while len(at):
            slot = _block_slot(words.hash, at, self.block)
            move = self.shift[slot].astype(np.int64)
            hit = np.flatnonzero(move == 0)
            if len(hit):
                where, key = at[hit], slot[hit]
                print_ = self._prints(words.hash, where - m + 1)
                likely = self.known[np.minimum(np.searchsorted(self.known, print_), len(self.known) - 1)] == print_
                where, key, print_ = where[likely], key[likely], print_[likely]
                left, right = np.searchsorted(self.bucket, key, "left"), np.searchsorted(self.bucket, key, "right")
                for begin, a, b, p in zip((where - m + 1).tolist(), left.tolist(), right.tolist(), print_, strict=True):
                    for k in self.order[a:b][self.prints[a:b] == p].tolist():
                        if self._same(words, begin, k):
                            yield begin, k
                move[hit] = 1
            at = at + move
            live = at < stop
            at, stop = at[live], stop[live]

    def _same(self, words: Words, begin: int, k: int) -> bool:
        return b" ".join(words.word(i) for i in range(begin, begin + self.length)) == self.bytes[k]


def build_patterns(items: list[tuple[str | None, str]], window: int = WINDOW) -> tuple[list[PatternSet], list[str]]:
    """Pattern sets of (item id as text, text) rows, by length, and the distinct item ids that their numbers mean; rows without id have none."""
    ids = {k: n for n, k in enumerate(dict.fromkeys(k for k, _ in items if k is not None))}
    words = Words(pa.array([t for _, t in items], pa.large_string()), ALNUM)
    by_length: dict[int, dict[bytes, tuple[list[int], np.ndarray]]] = {}
    for i in range(len(items)):
        a, b = int(words.first[i]), int(words.first[i + 1])
        m = min(window, b - a)
        for s in range(a, b - m + 1) if m else ():
            key = b" ".join(words.word(j) for j in range(s, s + m))
            known = by_length.setdefault(m, {}).setdefault(key, ([], words.hash[s:s + m]))[0]
            number = ids.get(items[i][0])
            if number is not None and number not in known[-1:]:
                known.append(number)
    return [PatternSet(m, w) for m, w in sorted(by_length.items())], list(ids)


def _hits(docs: DataFrame, items: list[tuple[str, str]], window: int) -> DataFrame:
    """The columns of `docs` but text, n_words, spans of hit words (begin, end), item ids with an occurrence."""
    names = [c for c in docs.columns if c != "text"]
    sets, ids = build_patterns(items, window)
    shared = docs.sparkSession.sparkContext.broadcast((sets, ids))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, ids = shared.value
        for batch in pieces(batches, "text"):
            words = Words(batch.column("text"), ALNUM)
            spans: list[set] = [set() for _ in range(len(batch))]
            found: list[set] = [set() for _ in range(len(batch))]
            for patterns in sets:
                for begin, k in patterns.search(words):
                    r = int(words.row[begin])
                    low = begin - int(words.first[r])
                    spans[r].add((low, low + patterns.length))
                    found[r].update(patterns.items[k])
            yield pa.record_batch({
                **{c: batch.column(c) for c in names},
                "n_words": pa.array(np.diff(words.first), pa.int64()),
                "spans": pa.array([_union(s) for s in spans], pa.list_(pa.list_(pa.int64()))),
                "items": pa.array([sorted(ids[k] for k in f) for f in found], pa.list_(pa.string())),
            })

    kept = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.mapInArrow(search, f"{kept}, n_words bigint, spans array<array<bigint>>, items array<string>")


def _union(spans) -> list[list[int]]:
    """Sorted, disjoint spans that cover the same words."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, spans [first word, end) that occurrences cover, items (sorted ids as text).

    Null or empty texts have no words and no hits. Rows are kept one for one at every size of the benchmark, repeated rows and those
    without a doc_id too. Items without words are never found; items of the same text are all reported. Rows that repeat an item_id are one
    item with the windows of all their texts; windows of a row without item_id are hits that name no item. Other columns of either table are
    not read.
    """
    bound_batches(docs.sparkSession)
    docs = id_and_text(docs)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-total // block_bytes) or 1
    if n == 1:
        return _hits(docs, [tuple(r) for r in items.collect()], window)
    docs = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "numbered-documents")
    every = None
    for b in range(n):
        part = _hits(docs, [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()], window)
        # the first pass has a row for each document, the others need those with hits only
        part = materialize(part if every is None else part.where(F.size("spans") > 0), "benchmark-hits")
        every = part if every is None else every.unionByName(part)
    merged = every.groupBy("row", "doc_id", "n_words").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    join = lambda out, s: (
        F.when((F.size(out) > 0) & (F.element_at(out, -1)[1] >= s[0]),
               F.concat(F.slice(out, F.lit(1), F.size(out) - 1),
                        F.array(F.array(F.element_at(out, -1)[0], F.greatest(F.element_at(out, -1)[1], s[1])))))
        .otherwise(F.concat(out, F.array(s))))
    return merged.drop("row").withColumn("spans", F.aggregate("spans", F.array().cast("array<array<bigint>>"), join))


def report(hits: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated from `find_benchmark`."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x[1] - x[0])
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                       F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def sha_of_items(ids: list[str]) -> str:
    """The digest that `report` gives for these ids."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
