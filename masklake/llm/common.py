"""Helpers of the corpus operators: lean projections, Arrow batches of bounded size, vectorised word hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from masklake.session import discard, materialize

BATCH_BYTES = 4 << 20
_CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers = {_BASE: np.ones(1, np.uint64), _BASE_INV: np.ones(1, np.uint64)}


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Let Arrow batches end by bytes, so that a task's memory does not follow the length of texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > most or int(now) <= 0:
        spark.conf.set(key, str(most))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator reads, under names of its own; a null text counts as empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slots(df: DataFrame) -> int:
    """Number of shuffle partitions that the session asks for."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def byte_classes(separators: bytes) -> np.ndarray:
    """For each byte: 0 if it separates words, else the byte itself with A-Z lower-cased."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(separators)] = 0
    return table


#: Words end at ASCII white space. The null byte maps to 0 like a separator; `Words(nul_is_word=True)` keeps it inside words.
WHITE = byte_classes(b" \t\n\v\f\r")
#: Words are runs of ASCII letters, digits and anything beyond ASCII.
ALNUM = byte_classes(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit keys."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers[base]
    if len(have) < n:
        steps = np.full(max(n, _CHUNK), np.uint64(base))
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have


class Words:
    """The words of a column of texts as flat arrays.

    `start` and `end` are byte positions in `raw`, `first[r]:first[r + 1]` are the words of row r, `hash` holds 64-bit
    fingerprints of the mapped bytes.
    """

    def __init__(self, texts: pa.Array, table: np.ndarray, nul_is_word: bool = False, hashed: bool = True):
        texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.raw = body[off[0]:off[-1]]
        self.offsets = off - off[0]
        self.mapped = table[self.raw]
        inside = self.mapped != 0
        if nul_is_word:
            inside |= self.raw == 0
        n = len(inside)
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = self.offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        begins[cut] = inside[cut]
        ends[cut - 1] = inside[cut - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hash = self._hashes() if hashed else None

    def __len__(self) -> int:
        return len(self.start)

    def _hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(self.start):
            low = self.start[at]
            upto = max(at + 1, int(np.searchsorted(self.end, low + _CHUNK, side="right")))
            part = self.mapped[low:self.end[upto - 1]].astype(np.uint64) + np.uint64(1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * _power(_BASE, len(part))[:len(part)], out=sums[1:])
            s, e = self.start[at:upto] - low, self.end[at:upto] - low
            out[at:upto] = (sums[e] - sums[s]) * _power(_BASE_INV, len(part))[s]
            at = upto
        return mix(out + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def word(self, i: int) -> bytes:
        return self.mapped[self.start[i]:self.end[i]].tobytes()


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that one piece holds about `most` bytes of `column`, or one row."""
    for batch in batches:
        texts = batch.column(column)
        if not len(batch):
            continue
        size = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0), dtype=np.int64))
        at = 0
        while at < len(batch):
            done = size[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(size, done + most, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Consecutive rows of equal keys, each as one batch; rows must arrive sorted or grouped by the keys."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        change = np.zeros(len(batch) - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(batch)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a].item() for c in columns)
            if key != now and held:
                yield now, held[0] if len(held) == 1 else pa.concat_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, z - a))
    if held:
        yield now, held[0] if len(held) == 1 else pa.concat_batches(held)


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, label): the smallest node of each node's connected component, for the undirected edges (u, v).

    Each round every node takes the smallest label around it and then the label of that label, so the number of rounds grows with the
    logarithm of a component's diameter. Rounds are written tables; nothing but a count reaches the driver.
    """
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    # the smaller neighbours of a node are linked to the smallest of them instead, which leaves few different edges
    least = F.min("v").over(Window.partitionBy("u"))
    star = down.select("u", "v", least.alias("w")).select(F.when(F.col("v") == F.col("w"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("w").alias("v"))
    star = materialize(star.distinct(), f"{label}-star")
    both = materialize(star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{label}-edges")
    discard(star)
    labels = old = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label"))
                         .select(F.col("u").alias("node"), "label"), f"{label}-labels")
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["u"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        new = materialize(step.join(jump, "mid").select("node", F.least("mid", "far").alias("label"), "old"), f"{label}-labels")
        done = new.where("label != old").isEmpty()
        discard(old, *([both] if done else []))
        old, labels = new, new.select("node", "label")
        if done:
            return labels
