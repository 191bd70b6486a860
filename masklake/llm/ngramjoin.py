"""N-gram Jaccard self-join with Bayesian pruning of candidates.

A document is the set of its runs of `width` words (one run of all words if it has fewer). Documents of equal sets are one class
member from the start. Every set gets `HASHES` MinHash values; two sets are candidates if they agree in all values of one of `BANDS`
bands, which pairs at the threshold 0.8 miss with probability 5e-8. Candidates are compared value by value, a step at a time: given m
agreements in n values and a uniform prior, the similarity reaches the threshold with probability P(Binomial(n + 1, t) <= m); a pair
whose probability falls below `TOLERANCE` is dropped. The pairs that last are verified on the n-gram sets themselves.

No pair is ever a row. A bucket is compared inside tasks, and a task hands on, for each document, only the smallest document that
it hangs together with. The connected parts of that graph are small groups of likely near copies; in each, all pairs of
documents are verified exactly, and a task gives each document its number of links and again one representative. Large
buckets and groups are cut into blocks and tasks take pairs of blocks, so that memory is bounded; no row or link is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from masklake.llm.common import WHITE, Words, bound_batches, components, id_and_text, mix, pieces, runs, slots
from masklake.session import discard, materialize

WIDTH = 5
THRESHOLD = 0.8
HASHES, BANDS = 128, 32
STEP = 16
TOLERANCE = 1e-7
BLOCK = 384
BLOCK_BYTES = 1 << 20
PIECE_BYTES = 1 << 20
_DENSE = 4096
_seeds = np.random.RandomState(7)
_FACTORS = _seeds.randint(0, 1 << 31, HASHES).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _seeds.randint(0, 1 << 31, HASHES).astype(np.uint32)


def shingles(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(distinct 64-bit n-grams of all texts, bounds): text r has those from bounds[r] up to bounds[r + 1], ascending."""
    words = Words(texts, WHITE, nul_is_word=True)
    n = np.diff(words.first)
    size = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    bounds = np.concatenate([[0], np.cumsum(size)])
    row = np.repeat(np.arange(len(n)), size)
    begin = words.first[row] + np.arange(bounds[-1]) - bounds[row]
    key = np.zeros(len(begin), np.uint64)
    length = np.minimum(n, width)[row]
    for k in range(width):
        has = k < length
        at = np.minimum(begin + k, max(0, len(words) - 1))
        if len(words):
            key = np.where(has, key * np.uint64(0x9E3779B97F4A7C15) + words.hash[at] + np.uint64(1), key)
    key = mix(key)
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return key[new], np.searchsorted(row[new], np.arange(len(n) + 1))


def signatures(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash values of each set, as rows; an empty set has the largest value throughout."""
    out = np.full((len(bounds) - 1, HASHES), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(bounds))
    x = (keys >> np.uint64(32)).astype(np.uint32)
    at = 0
    while at < len(some):  # a stretch that stays in the processor's cache
        upto = max(at + 1, int(np.searchsorted(bounds[some], bounds[some[at]] + (1 << 16))))
        low, high = bounds[some[at]], bounds[some[upto - 1] + 1]
        part, starts = x[low:high], bounds[some[at:upto]] - low
        for k in range(HASHES):
            out[some[at:upto], k] = np.minimum.reduceat(part * _FACTORS[k] + _SHIFTS[k], starts)
        at = upto
    return out


def least_agreements(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For n = STEP, 2 STEP ...: the fewest agreements with which the threshold is reached with the tolerated probability."""
    out, t = [], Fraction(threshold)
    for n in range(STEP, HASHES + 1, STEP):
        total, m = Fraction(0), -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def survivors(values: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float,
              least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (left, right) that sizes allow and whose posterior never fell below the tolerance."""
    small, large = np.minimum(size[left], size[right]), np.maximum(size[left], size[right])
    keep = small >= threshold * large - 1e-9
    left, right = left[keep], right[keep]
    agreed = np.zeros(len(left), np.int64)
    for k, fewest in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        agreed = agreed + (values[left, part] == values[right, part]).sum(1)
        keep = agreed >= fewest
        left, right, agreed = left[keep], right[keep], agreed[keep]
        if not len(left):
            break
    return left, right


def _pairs_of(block: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of a block with itself or of two blocks."""
    if low == high:
        return np.triu_indices(len(block), 1)
    a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
    return np.repeat(a, len(b)), np.tile(b, len(a))


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest row that each row hangs together with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _in_blocks(rows: DataFrame, key: str, blocks) -> DataFrame:
    """Rows dealt to the pairs of blocks of their group, sorted within tasks by (key, low, high)."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    rows = rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other")
    return rows.repartition(slots(rows), key, "low", "high").sortWithinPartitions(key, "low", "high")


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE_BYTES):
            keys, bounds = shingles(batch.column("text"), width)
            values = signatures(keys, bounds)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(keys)])
            twice = np.concatenate([[np.uint64(0)], np.cumsum(mix(keys * np.uint64(0xD6E8FEB86659FD93)))])
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "size": pa.array(np.diff(bounds), pa.int64()),
                "d1": pa.array((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64)),
                "d2": pa.array((twice[bounds[1:]] - twice[bounds[:-1]]).view(np.int64)),
                "values": pa.array([v.tobytes() for v in values], pa.binary())})

    return run


def _prune(threshold: float, least: list[int]):
    """Inside each pair of blocks of a bucket: (u, v) for each document that survives with a smaller one, v the root of its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = [], []
        for (_, low, high), part in runs(batches, ["key", "low", "high"]):
            if len(part) < 2:
                continue
            ids, size = np.asarray(part.column("rep")), np.asarray(part.column("size"))
            values = np.frombuffer(b"".join(part.column("values").to_pylist()), np.uint32).reshape(len(part), HASHES)
            left, right = survivors(values, size, *_pairs_of(np.asarray(part.column("block")), low, high), threshold, least)
            if len(left):
                root = _roots(len(part), left, right)
                moved = np.flatnonzero(root != np.arange(len(part)))
                u += ids[moved].tolist()
                v += ids[root[moved]].tolist()
            if len(u) > 50_000:
                yield pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})
                u, v = [], []
        if u:
            yield pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def shared_counts(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of common n-grams of any two sets, exactly."""
    n = len(bounds) - 1
    _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
    common = count[number] > 1
    row = np.repeat(np.arange(n), np.diff(bounds))[common]
    _, column = np.unique(number[common], return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((n, n), np.float64)
    last = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, last, _DENSE):
        low, high = np.searchsorted(column, [a, a + _DENSE])
        dense = np.zeros((n, min(_DENSE, last - a)), np.float32)  # sums of at most 4096 ones are exact
        dense[row[low:high], column[low:high] - a] = 1
        out += dense @ dense.T
    return out


def _verify(width: int, threshold: float):
    """Inside each pair of blocks of a group: rep, links (exact), root (the smallest document that it hangs together with)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, low, high), part in runs(batches, ["part", "low", "high"]):
            if len(part) < 2:
                continue
            ids, block = np.asarray(part.column("rep")), np.asarray(part.column("block"))
            keys, bounds = shingles(part.column("text"), width)
            size, common = np.diff(bounds), shared_counts(keys, bounds)
            linked = common * (1 + threshold) >= threshold * (size[:, None] + size[None, :]) - 1e-9
            linked &= (size[:, None] > 0) & (size[None, :] > 0)
            if low != high:
                linked &= block[:, None] != block[None, :]
            np.fill_diagonal(linked, False)
            degree = linked.sum(1)
            left, right = np.nonzero(np.triu(linked))
            root = _roots(len(part), left, right)
            some = np.flatnonzero(degree)
            yield pa.record_batch({"rep": pa.array(ids[some], pa.int64()), "links": pa.array(degree[some], pa.int64()),
                                   "root": pa.array(ids[root[some]], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row for each document: doc_id, rep_id, class_id, class_size, n_links.

    rep_id is the smallest doc_id with the same set of n-grams, class_id the smallest of all that links connect to it, class_size the number
    of documents in the class, n_links the number of other sets with a Jaccard similarity of the threshold or more. Words are runs of anything but
    ASCII white space, A-Z in lower case. Documents without words (null, empty) are alone in their class. doc_id is a whole number; rows
    that repeat it with the same text count as copies, rows without one are alone in a class without id. An empty table gives an empty result; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    least = least_agreements(threshold, tolerance)
    every = id_and_text(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows, none = every.where("doc_id is not null"), F.lit(None).cast("bigint")
    signed = materialize(rows.mapInArrow(_sign(width), "doc_id bigint, size bigint, d1 bigint, d2 bigint, values binary"), "signed")
    sets = materialize(signed.where("size > 0").groupBy("size", "d1", "d2").agg(F.min("doc_id").alias("rep")), "sets")
    reps = signed.where("size > 0").join(sets.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    reps = materialize(reps.select(F.col("doc_id").alias("rep"), "size", "values"), "reps")
    wide = 4 * HASHES // BANDS
    bands = reps.select("rep", F.explode(F.array(*[F.xxhash64(F.lit(b), F.substring("values", 1 + b * wide, wide))
                                                   for b in range(BANDS)])).alias("key"))
    full = bands.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    held = bands.join(full, "key").join(reps, "rep").select("key", "m", "rep", "size", "values")
    edges = _in_blocks(held, "key", F.ceil(F.col("m") / BLOCK)).select("key", "low", "high", "block", "rep", "size", "values")
    edges = edges.mapInArrow(_prune(threshold, least), "u bigint, v bigint")
    parts = materialize(components(edges, "candidates").select(F.col("node").alias("rep"), F.col("label").alias("part")), "parts")
    discard(reps)
    texts = rows.withColumnRenamed("doc_id", "rep").join(parts, "rep")
    texts = materialize(texts.dropDuplicates(["rep"]), "part-texts")
    size = texts.groupBy("part").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES)).alias("blocks"))
    dealt = _in_blocks(texts.join(size, "part"), "part", F.col("blocks")).select("part", "low", "high", "block", "rep", "text")
    found = materialize(dealt.mapInArrow(_verify(width, threshold), "rep bigint, links bigint, root bigint"), "links")
    discard(texts)
    links = found.groupBy("rep").agg(F.sum("links").alias("n_links"))
    classes = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")), "classes")
    answer = sets.join(links, "rep", "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left").select(
        "size", "d1", "d2", F.col("rep").alias("rep_id"), F.coalesce("label", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))
    answer = materialize(answer, "answer")
    named = signed.select("doc_id", "size", "d1", "d2").join(answer, ["size", "d1", "d2"], "left").select(
        "doc_id", F.coalesce("rep_id", "doc_id").alias("rep_id"), F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))
    named = materialize(named, "named")
    discard(signed, sets, found, answer)
    sizes = named.groupBy("class_id").agg(F.count("*").alias("class_size"))
    alone = every.where("doc_id is null").select(none.alias("doc_id"), none.alias("rep_id"), none.alias("class_id"),
                                                 F.lit(1).cast("bigint").alias("class_size"), F.lit(0).cast("bigint").alias("n_links"))
    return named.join(sizes, "class_id").select("doc_id", "rep_id", "class_id", "class_size", "n_links").unionByName(alone)
