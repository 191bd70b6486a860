"""Digest trees of tables: rows, buckets of keys, one root. Two trees tell not only that tables differ, but where.

A row belongs to the bucket of its key, so a changed row stays in its bucket, and tables that agree in a bucket need not be
compared there. Hashes are summed per bucket before the shuffle: no task holds the rows of a bucket, and order plays no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096


def _hex_word(hashed: str, i: int) -> Column:
    return F.conv(F.substring(hashed, 1 + 8 * i, 8), 16, 10)


def bucket_of(keys: list[str], buckets: int = BUCKETS) -> Column:
    """Bucket of a key, from the SHA-256 of its values joined by `|`; a NULL counts as empty."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def group_digests(df: DataFrame, groups: list[str], columns: list[str]) -> DataFrame:
    """`(groups, rows, digest)`: one digest of the `columns` of all rows of a group, repeated rows included."""
    row = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    words = [f"_w{i}" for i in range(8)]
    summed = df.withColumn("_h", row).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(_hex_word("_h", i).cast("decimal(38,0)")).alias(w) for i, w in enumerate(words)])
    return summed.select(*groups, "rows", F.sha2(F.concat_ws("|", "rows", *words), 256).alias("digest"))


def bucket_digests(df: DataFrame, keys: list[str], by: list[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """`(by, bucket, rows, digest)`; at most `buckets` rows for each value of `by`, however long the table."""
    return group_digests(df.withColumn("bucket", bucket_of(keys, buckets)), [*by, "bucket"], df.columns)


def root(tree: DataFrame, by: list[str] = ()) -> DataFrame:
    """`(by, rows, digest)` from the buckets of a tree. Equal roots mean equal tables."""
    leaves = F.transform(F.array_sort(F.collect_list(F.struct("bucket", "digest"))), lambda s: s["digest"])
    return tree.groupBy(*by).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.sha2(F.array_join(leaves, ""), 256).alias("digest"))


def differing(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """Groups of two digest tables that differ, as `(on, rows_before, rows_after, change)`; change is added, removed or changed.

    A NULL in `on` is a value like any other.
    """
    both = old.select(*on, "rows", "digest", F.lit(0).alias("_side")).unionByName(new.select(*on, "rows", "digest", F.lit(1).alias("_side")))
    of = lambda side, value: F.max(F.when(F.col("_side") == side, F.col(value)))
    found = both.groupBy(*on).agg(of(0, "rows").alias("rows_before"), of(1, "rows").alias("rows_after"), of(0, "digest").alias("_a"), of(1, "digest").alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    return (found.where(~F.col("_a").eqNullSafe(F.col("_b")))
            .select(*on, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rows_before", "rows_after")], change.alias("change")))


WORDS = [f"_w{i}" for i in range(4)]


def _signed(old: DataFrame, new: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """The rows of both tables as `(keys, _bucket, _side, _w0 ... _w3)`: 128 bits of a row's SHA-256 in four words, negative on the new side."""
    def side(df: DataFrame, number: int, sign: int) -> DataFrame:
        digest = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
        bucket = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).alias("_bucket")
        halves = df.select(*keys, bucket, digest.alias("_h")).select(*keys, "_bucket", *[F.xxhash64(F.lit(i), "_h").alias(f"_x{i}") for i in range(2)])
        words = [half * sign for i in range(2) for half in (F.shiftrightunsigned(f"_x{i}", 32), F.col(f"_x{i}").bitwiseAND(F.lit((1 << 32) - 1)))]
        return halves.select(*keys, "_bucket", F.lit(number).alias("_side"), *[word.alias(w) for w, word in zip(WORDS, words, strict=True)])

    return side(old, 0, 1).unionByName(side(new, 1, -1))


def _unbalanced(both: DataFrame, on: list[str]) -> DataFrame:
    """Groups in which the two sides are not the same bag of rows, with the numbers of rows of each. A sum is exact for 2 ** 31 rows of a group."""
    sums = [F.sum(w).alias(w) for w in WORDS]
    found = both.groupBy(*on).agg(F.count_if(F.col("_side") == 0).alias("rows_before"), F.count_if(F.col("_side") == 1).alias("rows_after"), *sums)
    return found.where(" OR ".join(["rows_before <> rows_after", *[f"{w} <> 0" for w in WORDS]]))


def drifted_rows(old: DataFrame, new: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Keys whose rows differ between two tables of the same columns, as `(keys, rows_before, rows_after, change)`.

    Buckets are compared first; only rows of differing buckets are grouped by key. Keys may repeat, a key's rows are then compared as a bag.
    Both tables go through one aggregation, in which equal rows cancel out: a row is shuffled once, as the words of its hash.
    """
    both = _signed(old, new, keys, buckets)
    apart = _unbalanced(both, ["_bucket"]).select("_bucket")
    # At most `buckets` numbers.
    found = _unbalanced(both.join(apart.hint("broadcast"), "_bucket", "left_semi"), keys)
    change = F.when(F.col("rows_before") == 0, "added").when(F.col("rows_after") == 0, "removed").otherwise("changed")
    return found.select(*keys, "rows_before", "rows_after", change.alias("change"))
