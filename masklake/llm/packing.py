"""Packing by power-of-two decomposition: every sequence is one binary-length piece of one document.

A document of n tokens is cut into n // most pieces of `most` tokens and, for the rest, one piece for each binary digit of its length,
longest first. A piece is a sequence of its own: no sequence crosses documents, none is padded, and equal lengths form a bucket, from
which a trainer takes batches of one shape. The number of a sequence starts with its bucket, so that a bucket is one range of numbers.

The work is one map over the documents where they lie: no shuffle, no table in between, nothing that grows at the driver. A lost task is
done again with the same numbers, as these come from the scan's own split and the place in it.

Tokens are those of the library, found for all distinct words of a batch side by side (`wordbpe`).
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from masklake.llm.common import BATCH_BYTES, bound_batches, id_and_text, pieces
from masklake.llm.wordbpe import WordBpe, encoder

LONGEST = 4096
END = 2
#: Sequence numbers carry the bucket above this bit; below it are the split (33 bits up) and the place in it.
BUCKET_BIT = 58


def binary_lengths(n: int, most: int = LONGEST) -> list[int]:
    """Lengths of the pieces of n tokens: whole ones of `most`, a power of two, and the binary digits of the rest, longest first."""
    rest = n % most
    return [most] * (n // most) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer_path: str, most: int = LONGEST, end: int = END) -> DataFrame:
    """One row for each piece: doc_id, start, length, bucket (its binary logarithm), ids, doc_tokens, sequence_id, offset (0).

    `ids` are the piece's token ids as little-endian unsigned 32-bit numbers; a document's are those of its whole text and then `end`. Null and
    empty texts are the end token alone. Rows are documents of their own, repeated ones and those without doc_id too. An empty table gives
    an empty result; columns other than doc_id and text are not read. Reruns over the same files give the same sequence numbers.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("the longest piece is a power of two")
    bound_batches(docs.sparkSession)
    spec = Path(tokenizer_path).read_text(encoding="utf-8")
    WordBpe(spec)  # refuses other tokenizers before any task starts
    shared = docs.sparkSession.sparkContext.broadcast(spec)  # the tokenizer's file, of fixed size

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(shared.value)
        for batch in pieces(batches, "text", BATCH_BYTES):
            every, bounds = words.encode(batch.column("text").to_pylist())
            rows, start, length, tokens, ids = [], [], [], [], []
            for row in range(len(batch)):
                found = np.append(every[bounds[row]:bounds[row + 1]], np.uint32(end)).astype("<u4")
                at = 0
                for n in binary_lengths(len(found), most):
                    rows.append(row)
                    start.append(at)
                    length.append(n)
                    ids.append(found[at:at + n].tobytes())
                    at += n
                tokens += [at] * (len(rows) - len(tokens))
            yield pa.record_batch({"doc_id": batch.column("doc_id").take(pa.array(rows, pa.int64())), "start": pa.array(start, pa.int64()),
                                   "length": pa.array(length, pa.int64()), "ids": pa.array(ids, pa.binary()), "doc_tokens": pa.array(tokens, pa.int64())})

    rows = id_and_text(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    cuts = rows.mapInArrow(cut, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint")
    bucket = F.round(F.log2("length")).cast("int")
    return cuts.select("doc_id", "start", "length", bucket.alias("bucket"), "ids", "doc_tokens",
                       (F.shiftleft(bucket.cast("bigint"), BUCKET_BIT) + F.monotonically_increasing_id()).alias("sequence_id"),
                       F.lit(0).cast("bigint").alias("offset"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Writes sequences in one folder for each length, as `bucket=<logarithm>`."""
    packed.write.partitionBy("bucket").parquet(path)


def report(packed: DataFrame) -> DataFrame:
    """The pieces with ids_crc32 in place of their ids."""
    return packed.withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
