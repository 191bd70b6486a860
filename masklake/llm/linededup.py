"""Line dedup by an exact set-similarity self-join, in DataFrame operations only.

A line's tokens are its runs of five words in lower case; a line of one to four words has one token, all its words. Only lines without
words are left alone. A line is removed if an earlier line, by (doc_id, line number), has a token set with a Jaccard similarity of the
threshold or more, itself removed or not.

1. Screen. Two sets of similarity t share a token among the first n - ceil(t n) + 1 of each in any common order. In the order of the
   token hashes, which needs no statistics, only lines that share such a token with a different set can have a partner
   at all. Their number is small; everything later works on them. Equal sets are found by one aggregation of their digests. Sets of n
   tokens with n / (n + 1) below t (at 0.8 those of up to three, all short lines among them) reach t with equal sets only and skip the rest.
2. Order. Token frequencies are counted exactly over the distinct screened sets, and each set's tokens are ordered by rarity.
3. Groups. Sets that share a token of their rarity-ordered prefixes are linked to the smallest set with that token; the connected parts are
   the groups in which partners lie.
4. Verification. A group is cut into blocks of about `BLOCK` sets, and pairs of blocks meet in one row each. Inside, a set looks for an
   earlier one that passes the length filter, shares a prefix token, passes the positional filter at the first such token, and has
   enough common tokens. No pair of sets is ever a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from masklake.llm.common import components
from masklake.session import discard, forget, materialize, written_bytes

WIDTH = 5
THRESHOLD = 0.8
BLOCK = 64
#: A screening table whose files have at most so many bytes is sent to all tasks; a larger one is joined by shuffle, with the same rows.
SMALL_BYTES = 8 << 20


def _small(df: DataFrame) -> DataFrame:
    """`df`, a written table, with a broadcast hint if the measured size of its files is within the bound."""
    return F.broadcast(df) if written_bytes(df) <= SMALL_BYTES else df


def _need(n: Column, other: Column, threshold: float) -> Column:
    """The fewest common tokens with which sets of these sizes reach the threshold."""
    return F.ceil((n + other) * (threshold / (1 + threshold)) - 1e-9)


def _prefix_length(n: Column, threshold: float) -> Column:
    return (n - F.ceil(n * threshold - 1e-9) + 1).cast("int")


def token_sets(lines: DataFrame, width: int) -> DataFrame:
    """`lines` that have words, with `tokens` (distinct hashes of runs of words, ascending; one of all words for a line of fewer) in place of `line`."""
    lines = lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    words = F.array_remove(F.split(F.regexp_replace(F.lower("line"), r"[\x09-\x0D]", " "), " "), "")
    out = lines.withColumn("w", F.transform(words, lambda w: F.xxhash64(w))).drop("line")  # a column of its own is computed once
    count = F.greatest(F.size("w") - (width - 1), F.lit(0))
    runs = F.transform(F.slice("w", F.lit(1), count), lambda x, i: F.xxhash64(x, *[F.get("w", i + k) for k in range(1, width)]))
    out = out.withColumn("whole", F.when(F.size("w") < width, F.array(F.xxhash64(F.lit(width), "w")))).withColumn("runs", runs)
    return out.select("doc_id", "line_no", F.coalesce("whole", F.sort_array(F.array_distinct("runs"))).alias("tokens"))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def removed_lines(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, line_no (from 0) of every line that an earlier line removes.

    Lines end at line feeds. Null and empty texts have no lines that could go. doc_id is a unique number; rows that repeat it with the same text
    are the same lines and stay or go together; rows without one keep all lines. An empty table gives an empty result. Other columns are not read.
    """
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = F.size("tokens")
    front = F.when(n >= (n + 1) * threshold - 1e-9, F.slice("tokens", F.lit(1), _prefix_length(n, threshold))).otherwise(F.array().cast("array<bigint>"))
    written = materialize(token_sets(_lines(docs), width).select(
        "doc_id", "line_no", F.xxhash64("tokens").alias("d1"), F.xxhash64("tokens", F.lit(width)).alias("d2"),
        front.alias("prefix"), F.monotonically_increasing_id().alias("line")),
        "line-prefixes")
    screened = written
    place = F.struct("doc_id", "line_no")
    firsts = screened.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "line_no", "line")).alias("first"), F.count("*").alias("copies"))
    repeated = materialize(firsts.where("copies > 1").drop("copies"), "repeated-lines")
    # of equal lines only the first goes on, so that a token met twice is met in two sets
    single = screened.where(F.size("prefix") > 0).join(_small(repeated), ["d1", "d2"], "left").where("first IS NULL OR first.line = line")
    tokens = single.select("line", F.explode("prefix").alias("token"))
    shared = materialize(tokens.groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select("token"), "shared-tokens")
    held = materialize(tokens.join(shared, "token", "left_semi").select("line").distinct(), "held-lines")
    # the prefixes are used up; what is needed of them is a fraction of their size
    screened = materialize(screened.select("doc_id", "line_no", "line", "d1", "d2"), "line-digests")
    discard(shared, written)
    likely = screened.join(held, "line", "left_semi").select("doc_id", "line_no")
    wanted = materialize(likely.groupBy("doc_id").agg(F.collect_set("line_no").alias("wanted")), "likely-documents")
    discard(held)
    again = docs.join(_small(wanted), "doc_id").select(
        "doc_id", F.explode(F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line_no"), x.alias("line"))),
                                     lambda x: F.array_contains("wanted", x["line_no"]))).alias("x")).select("doc_id", "x.*")
    sets = token_sets(again, width).dropDuplicates(["doc_id", "line_no"])
    sets = materialize(sets.withColumn("id", F.monotonically_increasing_id()), "likely-sets")
    discard(wanted)

    each = sets.select("id", F.explode("tokens").alias("token"))
    rarity = materialize(each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "token-rarity")
    forget(docs.sparkSession)
    # tokens of one set alone come first in its order and are in no intersection: their number says all
    common = each.join(rarity, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    ordered = common.join(sets.select("id", "doc_id", "line_no", F.size("tokens").alias("n")), "id")
    ordered = ordered.where(F.size("t") >= _need(F.col("n"), F.col("n") * threshold, threshold)).withColumn("lone", F.col("n") - F.size("t"))
    front = F.greatest(_prefix_length(F.col("n"), threshold) - F.col("lone"), F.lit(0))
    ordered = ordered.select("id", "doc_id", "line_no", "n", "lone", F.transform("t", lambda t: t["token"]).alias("tokens"),
                             F.transform(F.slice("t", F.lit(1), front), lambda t: t["token"]).alias("prefix"))
    ordered = materialize(ordered.where(F.size("prefix") > 0), "ordered-sets")
    discard(sets, rarity)

    posted = ordered.select("id", F.explode("prefix").alias("token"))
    lead = posted.groupBy("token").agg(F.min("id").alias("lead"), F.count("*").alias("m")).where("m > 1")
    edges = posted.join(lead, "token").select(F.col("id").alias("u"), F.col("lead").alias("v")).where("u != v")
    groups = components(edges, "line-groups").withColumnsRenamed({"node": "id", "label": "part"})
    members = ordered.join(groups, "id")
    sizes = groups.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    members = members.join(sizes, "part").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    item = F.struct(place.alias("place"), "n", "lone", "prefix", "tokens")
    blocks = materialize(members.groupBy("part", "block").agg(F.collect_list(item).alias("items")), "line-blocks")
    left = blocks.withColumnsRenamed({"block": "b", "items": "a_items"})
    right = blocks.withColumnsRenamed({"block": "c", "items": "c_items"})
    pairs = left.join(right, "part").where("b <= c")

    def similar(x: Column, y: Column) -> Column:
        need = _need(x["n"], y["n"], threshold)
        first = F.get(F.array_intersect(x["prefix"], y["prefix"]), F.lit(0))
        left = lambda z: z["n"] - z["lone"] - F.array_position(z["prefix"], first)  # noqa: E731  tokens after that one
        reach = 1 + F.least(left(x), left(y))
        return ((F.least(x["n"], y["n"]) >= F.greatest(x["n"], y["n"]) * threshold - 1e-9)
                & F.coalesce(reach >= need, F.lit(False)) & (F.size(F.array_intersect(x["tokens"], y["tokens"])) >= need))

    def matched(these: str, those: str) -> Column:
        return F.transform(F.filter(these, lambda x: F.exists(those, lambda y: (y["place"] < x["place"]) & similar(x, y))), lambda x: x["place"])

    gone = pairs.select("part", F.explode(F.array(
        F.struct(F.col("b").alias("block"), matched("a_items", "c_items").alias("gone")),
        F.struct(F.col("c").alias("block"), F.when(F.col("b") != F.col("c"), matched("c_items", "a_items")).otherwise(F.array().cast("array<struct<doc_id:bigint,line_no:int>>")).alias("gone"))))
        .alias("x")).select("part", "x.*").where(F.size("gone") > 0)
    gone = gone.groupBy("part", "block").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    gone = materialize(gone.select(F.explode("gone").alias("g")).select("g.*", F.lit(True).alias("similar")), "similar-lines")

    discard(blocks, ordered)
    # the first of equal lines goes if an earlier set is similar, the others go anyway
    similar_ = screened.join(_small(gone), ["doc_id", "line_no"]).select("d1", "d2", "similar")
    answer = materialize(repeated.select("d1", "d2", F.struct("first.doc_id", "first.line_no").alias("first")).join(similar_, ["d1", "d2"], "full"),
                         "removed-sets")
    return (screened.select("doc_id", "line_no", "d1", "d2").join(_small(answer), ["d1", "d2"])
            .where(F.col("similar") | (place != F.col("first"))).select("doc_id", "line_no"))


def dedup_lines(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """All columns and rows of `docs`, with the removed lines cut out of text, and lines_removed, the numbers of those lines.

    A text that loses no line is unchanged, null included.
    """
    gone = _fresh(docs.columns, "lines_removed")
    lines = removed_lines(docs, width, threshold).groupBy(F.col("doc_id").alias("_gone_id")).agg(F.array_sort(F.collect_set("line_no")).alias(gone))
    joined = docs.join(lines, F.col("doc_id").cast("bigint") == F.col("_gone_id"), "left").drop("_gone_id")
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(gone, i))
    return joined.withColumns({"text": F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")),
                               gone: F.coalesce(gone, F.array().cast("array<int>"))})


def _fresh(names: list[str], stem: str) -> str:
    while stem.lower() in {n.lower() for n in names}:
        stem += "_"
    return stem


def report(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """For each row of `docs`: doc_id, n_lines (0 for an empty text), n_removed, removed (line numbers from 0, comma-joined)."""
    lines = removed.groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("gone"))
    text = F.coalesce("text", F.lit(""))
    counted = docs.select("doc_id", F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, "\n"))).cast("bigint").alias("n_lines"))
    joined = counted.join(lines, "doc_id", "left")
    return joined.select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
                         F.coalesce(F.concat_ws(",", F.transform("gone", lambda x: x.cast("string"))), F.lit("")).alias("removed"))
