"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source should be taken target / source size times. The whole part is certain; the fractional part is rounded
dependently. Two documents meet, and words (probability times size) move from one to the other at random until one
of them is taken or left for certain; their expected words stay as they were and so does every document's own expectation. The other goes on with
what is left. So a source ends within one document of its target.

The pairing runs as a reduction tree: a hash deals a source's documents to leaves of about `FAN` documents, a leaf folds its
documents into decided ones and one residual, and residuals fold again by `FAN` leaves, until each source has one left,
which a last draw decides. A hot source has more leaves, not larger ones. Levels carry ids and sizes only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from masklake.operators.prefix import row_numbers, running_sums
from masklake.session import materialize

FAN = 32
SHARE = 1.5
MOST_COPIES = 2
WEIGHTS = (3, 1, 2)
SEED = 20177
_WORDS = r"[^\x20\x09-\x0D]+"
_CARRY = "struct<doc_id:bigint,size:bigint,p:double>"
_OUT = "array<struct<doc_id:bigint,size:bigint,up:int>>"


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """For each source: key, source, source_size, docs, target.

    Sources by code point, null last, take the weights in turn and share `share` times all words by weight; a source takes at most
    `most` times its own, and what it leaves is shared anew. That is the level at which the capped shares sum to the whole,
    found by one running sum over the sources in the order in which they reach their caps.
    """
    sources = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    ranked = row_numbers(sources, [F.col("source").isNull(), F.col("source"), F.col("key")], "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.select("*", weight.alias("weight"), (most * F.col("source_size")).cast("double").alias("cap"))
    summed = materialize(running_sums(ranked.withColumn("_all", F.lit(0)), ["_all"],
                                      [F.col("cap") / F.col("weight"), F.col("rank")],
                                      {"caps": F.col("cap"), "weights": F.col("weight")}), "source-sums")
    whole = summed.agg((share * F.sum("source_size")).alias("whole"), F.sum("weight").alias("all_weights"))
    rows = summed.crossJoin(F.broadcast(whole))
    left = F.col("whole") - F.col("caps") + F.col("cap")
    capped = left * F.col("weight") >= F.col("cap") * (F.col("all_weights") - F.col("weights") + F.col("weight"))
    rows = rows.withColumn("capped", capped)
    level = rows.agg(((F.max("whole") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))), F.lit(0.0)))
                      / F.nullif(F.sum(F.when(~F.col("capped"), F.col("weight"))), F.lit(0.0))).alias("level"))
    return rows.crossJoin(F.broadcast(level)).select(
        "key", "source", "source_size", "docs",
        F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def _draw(*of: Column) -> Column:
    """A number in [0, 1) that is the same in every run."""
    return F.pmod(F.xxhash64(*of, F.lit(SEED)), F.lit(1 << 53)) / float(1 << 53)


def _meet(acc: Column, b: Column) -> Column:
    """Lets the carried document and `b` meet: one of them is decided, the other is carried on."""
    a = acc["carry"]
    has_a, room_a = a["p"] * a["size"], (1 - a["p"]) * a["size"]
    has_b, room_b = b["p"] * b["size"], (1 - b["p"]) * b["size"]
    to_a, to_b = F.least(room_a, has_b), F.least(has_a, room_b)
    gives_a = _draw(a["doc_id"], b["doc_id"]) * (to_a + to_b) < to_b
    ends_a = F.when(gives_a, room_a <= has_b).otherwise(has_a <= room_b)  # a is the one decided
    up = F.when(ends_a, gives_a.cast("int")).otherwise((~gives_a).cast("int"))
    p = (F.when(ends_a & gives_a, b["p"] - room_a / b["size"]).when(ends_a, b["p"] + has_a / b["size"])
         .when(gives_a, a["p"] + has_b / a["size"]).otherwise(a["p"] - room_b / a["size"]))
    pick = lambda name, first: F.when(first, a[name]).otherwise(b[name])
    met = F.struct(
        F.struct(pick("doc_id", ~ends_a).alias("doc_id"), pick("size", ~ends_a).alias("size"),
                 F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p")).alias("carry"),
        F.concat(acc["out"], F.array(F.struct(pick("doc_id", ends_a).alias("doc_id"), pick("size", ends_a).alias("size"),
                                              up.alias("up")))).alias("out"))
    first = F.struct(F.struct(b["doc_id"].alias("doc_id"), b["size"].alias("size"), b["p"].alias("p")).alias("carry"),
                     acc["out"].alias("out"))
    return F.when(a.isNull(), first).otherwise(met)


def _fold(rows: DataFrame) -> DataFrame:
    """(key, node, carry, out): every node's documents folded into decided ones and one residual."""
    order = F.xxhash64("doc_id", F.lit(SEED + 1))
    grouped = rows.groupBy("key", "node").agg(
        F.array_sort(F.collect_list(F.struct(order.alias("h"), "doc_id", "size", "p"))).alias("docs"))
    empty = F.struct(F.lit(None).cast(_CARRY).alias("carry"), F.array().cast(_OUT).alias("out"))
    return grouped.select("key", "node", F.aggregate("docs", empty, _meet).alias("f")).select("key", "node", "f.carry", "f.out")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """One row for each document: doc_id, size (words), source_size, target (its source's), copies, taken (copies * size).

    A null text has no words; a null source is a source of its own. A source's taken words differ from its target by less than
    one document; no document is taken more than `most` times; reruns agree. doc_id is a whole number and unique; repeated rows are
    documents of their own. An empty table gives an empty result. Other columns are not read.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    sizes = materialize(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source"), key.alias("key"),
                                    F.coalesce(F.regexp_count("text", F.lit(_WORDS)), F.lit(0)).cast("bigint").alias("size")), "mix-sizes")
    targets = materialize(source_targets(sizes, weights, share, most), "mix-targets")
    times = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    rows = sizes.select("doc_id", "key", "size").join(
        targets.select("key", times.alias("times"), F.ceil(F.col("docs") / FAN).alias("leaves")), "key")
    fraction = F.col("times") - F.floor("times")
    rounded = (F.col("size") > 0) & (fraction > 0)
    open_ = rows.where(rounded).select("key", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), "leaves").alias("node"), "doc_id", "size",
                                       fraction.alias("p"))
    decided = [rows.where(~rounded).select("key", "doc_id", "size", F.lit(0).alias("up"))]
    nodes = targets.agg(F.max(F.ceil(F.col("docs") / FAN))).first()[0] or 1
    while True:
        level = materialize(_fold(open_), "mix-level")
        decided.append(level.select("key", F.inline("out")))
        residual = level.where("carry is not null").select(
            "key", F.floor(F.col("node") / FAN).alias("node"), "carry.*")
        if nodes <= 1:
            last = (_draw(F.col("doc_id"), F.lit(-1)) < F.col("p")).cast("int")
            decided.append(residual.select("key", "doc_id", "size", last.alias("up")))
            break
        nodes, open_ = -(-nodes // FAN), residual
    every = decided[0]
    for part in decided[1:]:
        every = every.unionByName(part)
    copies = (F.floor("times") + F.col("up")).cast("bigint")
    return (every.join(targets.select("key", "source_size", "target", times.alias("times")), "key")
            .select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")))
