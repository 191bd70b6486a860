"""Language identification by n-gram filters whose cells are bit masks over languages.

Training counts the n-grams (six bytes) of every labelled text by language, and every n-gram goes into the filter of each language that
has it. The filters of all languages lie bit-sliced in one Bloom table: a cell is a mask with a bit for each language, and the AND of an
n-gram's cells holds all languages that contain it, found by one look-up. A text's hits are counted bit by bit and corrected by each
filter's false-positive rate; the largest corrected share decides.

The table is sized by the counted n-grams of the largest filter, so that about half of its cells are filled, up to `table_bytes` for all
languages together; beyond that no n-gram is left out, but the false-positive rates grow, which the correction knows. A table is packed by
pages in tasks, and only its bytes reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from masklake.llm.common import bound_batches, pieces
from masklake.session import discard, materialize

GRAM = 6
#: Bound of the table of all languages.
TABLE_BYTES = 64 << 20
_SLICE = 63
#: Odd multipliers of the table's hash functions.
_MULTIPLIERS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93]
#: Cells for each n-gram that fill half of the table.
_CELLS = len(_MULTIPLIERS) / np.log(2)
_PAGE_BITS = 14
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(97, 123), *range(128, 256)]
_FLUSH = 1_000_000


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of all texts as numbers, bounds: text r has those from bounds[r] up to bounds[r + 1]).

    Anything but letters counts as one space, and each text begins and ends with one.
    """
    texts = texts.cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0]:off[-1]]
    off = off - off[0]
    space = np.full(len(raw) + len(texts) + 1, 32, np.uint8)
    space[np.arange(len(raw)) + 1 + np.repeat(np.arange(len(texts)), np.diff(off))] = _LETTERS[raw]
    begin = off + np.arange(len(texts) + 1)  # of each text's leading space
    keep = space != 32
    keep[1:] |= space[:-1] != 32
    keep[begin] = True  # the space before a text stays even where the text before ended with one
    kept = np.cumsum(keep) - keep
    begin, space = kept[begin], space[keep].astype(np.uint64)
    codes = np.zeros(max(0, len(space) - GRAM + 1), np.uint64)
    for k in range(GRAM):
        codes = (codes << np.uint64(8)) | space[k:k + len(codes)]
    row = np.repeat(np.arange(len(texts)), np.diff(begin))
    valid = np.zeros(len(codes), bool)
    inside = min(len(codes), len(row))
    valid[:inside] = np.arange(inside) + GRAM <= begin[row[:inside] + 1] + 1
    count = np.concatenate([[0], np.cumsum(valid)])
    return codes[valid], count[np.minimum(begin, len(codes))]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n), summed within the task as far as memory of fixed size holds it."""
    held: dict[str, list] = {}
    size = 0

    def merged(found: list) -> tuple[np.ndarray, np.ndarray]:
        key, where = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        return key, np.bincount(where, np.concatenate([n for _, n in found])).astype(np.int64)

    def out() -> Iterator[pa.RecordBatch]:
        for lang, found in held.items():
            key, n = merged(found)
            for a in range(0, len(key), 50_000):
                yield pa.record_batch({"lang": pa.array([lang] * len(key[a:a + 50_000]), pa.string()),
                                       "gram": pa.array(key[a:a + 50_000].astype(np.int64)), "n": pa.array(n[a:a + 50_000])})

    for batch in pieces(batches, "text"):
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for lang in dict.fromkeys(langs):
            codes, _ = grams(batch.column("text").filter(pa.array(langs == lang)))
            key, n = np.unique(codes, return_counts=True)
            held.setdefault(lang, []).append((key, n))
            size += len(key)
        if size > _FLUSH:
            held = {lang: [merged(found)] for lang, found in held.items()}
            size = sum(len(found[0][0]) for found in held.values())
            if size > _FLUSH / 2:
                yield from out()
                held, size = {}, 0
    yield from out()


def _slot(codes: np.ndarray, multiplier: int, bits: int) -> np.ndarray:
    return (codes * np.uint64(multiplier)) >> np.uint64(64 - bits)


def _width(languages: int) -> type:
    """Type of a cell: one byte for up to eight languages."""
    return np.uint8 if languages <= 8 else np.uint64


def _table_bits(grams_: int, languages: int, table_bytes: int) -> int:
    """Bits of a slot's number for so many n-grams in the largest filter."""
    slices = -(-languages // _SLICE)
    most = int(np.log2(max(table_bytes // (np.dtype(_width(languages)).itemsize * slices), 1 << _PAGE_BITS)))
    return max(_PAGE_BITS, min(most, int(np.ceil(np.log2(max(1, grams_) * _CELLS)))))


def _cells(bits: int):
    """(slice, page, slot within the page, bit) of each (gram, number of its language), masks of a slot merged within the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.asarray(batch.column("gram")).astype(np.uint64)
            number = np.asarray(batch.column("number")).astype(np.int64)
            part = number // _SLICE
            for k in np.unique(part).tolist():
                here = part == k
                slot = np.concatenate([_slot(codes[here], m, bits) for m in _MULTIPLIERS]).astype(np.int64)
                bit = np.tile(np.int64(1) << number[here] % _SLICE, len(_MULTIPLIERS))
                order = np.argsort(slot, kind="stable")
                first = np.flatnonzero(np.r_[True, slot[order][1:] != slot[order][:-1]]) if len(order) else order
                if not len(first):
                    continue
                slot, bit = slot[order][first], np.bitwise_or.reduceat(bit[order], first)
                yield pa.record_batch({"slice": pa.array(np.full(len(slot), k, np.int32)), "page": pa.array((slot >> _PAGE_BITS).astype(np.int32)),
                                       "slot": pa.array((slot & (1 << _PAGE_BITS) - 1).astype(np.int32)), "bit": pa.array(bit)})

    return run


def _pack(width: type):
    """The bytes of one page of cells; a page has at most `1 << _PAGE_BITS` different slots."""

    def run(page: pa.Table) -> pa.Table:
        cells = np.zeros(1 << _PAGE_BITS, np.uint64)
        cells[np.asarray(page.column("slot"))] = np.asarray(page.column("mask")).astype(np.uint64)
        return pa.table({"slice": page.column("slice").slice(0, 1), "page": page.column("page").slice(0, 1),
                         "cells": pa.array([cells.astype(width).tobytes()], pa.binary())})

    return run


class Filters:
    """Bit-sliced Bloom table of all languages; `languages` in the order that breaks ties."""

    def __init__(self, languages: list[str], cells: list[np.ndarray], bits: int):
        self.languages, self.bits, self.cells = languages, bits, cells
        fill = [np.count_nonzero(cells[k // _SLICE] & cells[k // _SLICE].dtype.type(1 << k % _SLICE)) / (1 << bits)
                for k in range(len(languages))]
        self.false_rate = np.minimum(np.array(fill) ** len(_MULTIPLIERS), 0.99)

    def contained(self, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Corrected share of each text's n-grams that each language contains; rows are texts."""
        out = np.zeros((len(bounds) - 1, len(self.languages)))
        total = np.diff(bounds)
        some = np.maximum(total, 1)
        for s, cells in enumerate(self.cells):
            mask = None
            for multiplier in _MULTIPLIERS:
                slot = _slot(codes, multiplier, self.bits)
                mask = cells[slot] if mask is None else mask & cells[slot]
            for k in range(s * _SLICE, min(len(self.languages), (s + 1) * _SLICE)):
                bit = (mask >> mask.dtype.type(k % _SLICE)) & mask.dtype.type(1)
                hits = np.diff(np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])[bounds])
                out[:, k] = np.maximum(0, (hits / some - self.false_rate[k]) / (1 - self.false_rate[k]))
        return out


def train(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> Filters | None:
    """Filters from the columns text and lang; rows with a null in either teach nothing. None if nothing can be learned.

    Languages stand in the order of their counted n-grams, the most first; a tie goes by name. A language whose texts have no n-gram has no filter.
    """
    bound_batches(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.lower("text").alias("text"), "lang")
    counts = materialize(rows.mapInArrow(_count_grams, "lang string, gram bigint, n bigint")
                         .groupBy("gram", "lang").agg(F.sum("n").alias("n")), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("grams")).orderBy(F.desc("total"), "lang").collect()
    if not totals:
        discard(counts)
        return None
    languages = [r.lang for r in totals]
    bits, width = _table_bits(max(r.grams for r in totals), len(languages), table_bytes), _width(len(languages))
    numbered = docs.sparkSession.createDataFrame([(k, lang) for k, lang in enumerate(languages)], "number int, lang string")
    cells = (counts.join(F.broadcast(numbered), "lang").select("gram", "number")
             .mapInArrow(_cells(bits), "slice int, page int, slot int, bit bigint")
             .groupBy("slice", "page", "slot").agg(F.bit_or("bit").alias("mask")))
    found = cells.groupBy("slice", "page").applyInArrow(_pack(width), "slice int, page int, cells binary").toLocalIterator()
    tables = [np.zeros(1 << bits, width) for _ in range(-(-len(languages) // _SLICE))]
    for r in found:
        tables[r.slice][r.page << _PAGE_BITS:r.page + 1 << _PAGE_BITS] = np.frombuffer(r.cells, width)
    discard(counts)
    return Filters(languages, tables, bits)


def identify(docs: DataFrame, filters: Filters | None) -> DataFrame:
    """All columns of `docs` with lang_pred and lang_score.

    lang_pred is `und` (score 0) for a null text, a text without any letter, or without filters. Otherwise the language with the largest corrected
    share of contained n-grams; ties, and texts without a single n-gram (of fewer than four letters), go to the language with most training text.
    The score is that share, from 0 to 1. Empty tables give empty results; texts of any length are read whole.
    """
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    names = docs.columns
    low, has = _fresh(names, "lower"), _fresh(names, "letter")
    rows = docs.withColumns({low: F.lower(F.coalesce("text", F.lit(""))),
                             has: F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))})
    if filters is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "lang_score": F.lit(0.0)})
    shared = spark.sparkContext.broadcast(filters)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        names_ = np.array([*filters.languages, "und"], dtype=object)
        for batch in pieces(batches, low):
            share = filters.contained(*grams(batch.column(low)))
            letter = np.asarray(batch.column(has), dtype=bool)
            best = np.where(letter, share.argmax(1), len(filters.languages))
            score = np.where(letter, share.max(1), 0.0)
            kept = [batch.column(c) for c in names if c not in ("lang_pred", "lang_score")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names_[best], pa.string()), pa.array(score)],
                                             [c for c in names if c not in ("lang_pred", "lang_score")] + ["lang_pred", "lang_score"])

    from pyspark.sql import types as T

    fields = [f for f in docs.schema.fields if f.name not in ("lang_pred", "lang_score")]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    return rows.mapInArrow(predict, schema)


def _fresh(names: list[str], stem: str) -> str:
    """A column name that the table does not have."""
    name = f"_{stem}"
    while name.lower() in {n.lower() for n in names}:
        name += "_"
    return name
