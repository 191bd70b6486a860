"""Greedy selection over candidate pairs, exact at any group size.

Both selections are defined by one sequential pass over pairs in a total order. Groups with a
bounded number of pairs take that pass literally, as an array fold inside one task. Larger groups
go through rounds, which provably give the same answer, until what is left of them fits the fold.
A round of matching settles every locally first pair. A round of suppression cuts the order into
blocks and passes over each of them at once, so its rounds follow the blocks, not the longest chain.

Where the overlap join says (in the column `CUT`) that a group was joined whole, and so has at most `pairs.WHOLE` pairs, the pass goes over the
pairs in the partition in which they were found: they are neither written nor counted nor shuffled again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from masklake.operators import prefix
from masklake.session import discard, materialize

FOLD_LIMIT = 4096
#: Column of pairs that tells whether their group was cut by the overlap join.
CUT = "_cut"
#: Nodes and conflicts of a block; the task that passes over a block holds at most six times as many rows.
BLOCK = 65_536


def _sorted_pairs(edges: DataFrame, group: list[str], order: list[Column], cols: list[str]) -> DataFrame:
    key = [c.alias(f"o{i}") for i, c in enumerate(order)]
    return edges.groupBy(*group).agg(
        F.sort_array(F.collect_list(F.struct(*key, *cols))).alias("_es"))


def _taken(first: list, x: list, y: list, reuse: list | None, used: tuple[set, set]) -> list[int]:
    """Places of the pairs that a pass takes. With `reuse`, a pair takes both of its ends; without, its `y` is gone and no gone node counts. A NULL is never used."""
    keep = []
    used_x, used_y = used
    for i, (begins, a, b) in enumerate(zip(first, x, y)):
        if begins:
            used_x.clear()
            used_y.clear()
        if reuse is None:
            if a in used_y or b in used_y:
                continue
        else:
            if a in used_x or (b in used_y and not reuse[i]):
                continue
            if a is not None:
                used_x.add(a)
        if b is not None:
            used_y.add(b)
        keep.append(i)
    return keep


def _pass_batches(batches: Iterator[pa.RecordBatch], x: str, y: str, reuse: str | None, out: list[str]) -> Iterator[pa.RecordBatch]:
    used: tuple[set, set] = (set(), set())  # of the group that is still open
    for batch in batches:
        first, a, b = (batch.column(c).to_pylist() for c in ("_first", x, y))
        keep = _taken(first, a, b, None if reuse is None else batch.column(reuse).to_pylist(), used)
        yield batch.select(out).take(pa.array(np.array(keep, np.int64)))


def _pass_whole(edges: DataFrame, group: list[str], order: list[Column], x: str, y: str, reuse: str | None, out: list[str]) -> DataFrame:
    """The sequential pass over all groups, each in the partition that holds its pairs."""
    place = Window.partitionBy(*group).orderBy(*order, x, y, *([reuse] if reuse else []))
    ordered = edges.withColumn("_first", F.row_number().over(place) == 1).select(*group, x, y, *([reuse] if reuse else []), "_first")
    columns = [*group, *out]
    schema = StructType([ordered.schema[c] for c in columns])
    return ordered.mapInArrow(lambda batches: _pass_batches(batches, x, y, reuse, columns), schema)


def _split(edges: DataFrame, group: list[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Pairs of groups within `limit`, and those of larger groups (None when there are none)."""
    big = edges.groupBy(*group).count().where(F.col("count") > limit).select(*group)
    if big.isEmpty():
        return edges, None
    return edges.join(big, group, "left_anti"), edges.join(big, group, "left_semi")


def fold_drop(edges: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Sequential pass: a pair whose `hi` is still alive removes its `lo`."""
    folded = _sorted_pairs(edges, group, order, ["hi", "lo"]).select(*group, F.expr("""
        aggregate(_es, cast(array() as array<bigint>),
                  (gone, e) -> if(array_contains(gone, e.hi) OR array_contains(gone, e.lo),
                                  gone, array_append(gone, e.lo)))""").alias("gone"))
    return folded.select(*group, F.explode("gone").alias("lo"))


def _pass_block(rows: pd.DataFrame, group: list[str], order: list[str]) -> pd.DataFrame:
    """Nodes of one block that surely survive: a sequential pass in which a node's fate may stay open.

    A row without `lo` is a node, one without `hi` says that a node of an earlier block beats `lo`, the others are conflicts
    inside the block. A node goes when a survivor beats it, else it stays open while anything open or earlier beats it.
    """
    nodes = rows[rows["lo"].isna()].sort_values(order)
    place = pd.Index(nodes["hi"].astype("int64"))
    beaten = place.get_indexer(rows.loc[rows["hi"].isna(), "lo"].astype("int64"))
    met = rows[rows["hi"].notna() & rows["lo"].notna()]
    pairs = sorted(zip(place.get_indexer(met["hi"].astype("int64")).tolist(), place.get_indexer(met["lo"].astype("int64")).tolist()))
    alive, is_open, gone = 0, 1, 2
    state = bytearray(len(nodes))
    for k in beaten.tolist():
        state[k] = is_open
    for better, worse in pairs:
        if state[better] == alive:
            state[worse] = gone
        elif state[better] == is_open and state[worse] == alive:
            state[worse] = is_open
    return nodes.loc[[s == alive for s in state], [*group, "hi"]]


def _block_survivors(todo: DataFrame, group: list[str], order: list[Column], block: int) -> DataFrame:
    """Nodes `(group, hi)` that survive for certain: all of each group's first block, and those settled within later ones.

    Only nodes that beat another one are in blocks. A node weighs one and the conflicts it may lose, up to `block`, and blocks
    are cut at multiples of `block` of the running weight, which bounds a block's nodes and the conflicts inside it.
    """
    keys = [f"o{i}" for i in range(len(order))]
    heads = todo.groupBy(*group, "hi").agg(*[F.min(c).alias(k) for k, c in zip(keys, order)])
    losses = todo.groupBy(*group, F.col("lo").alias("hi")).agg(F.count(F.lit(1)).alias("_losses"))
    weight = F.least(F.coalesce("_losses", F.lit(0)), F.lit(block)) + 1
    summed = prefix.running_sums(heads.join(losses, [*group, "hi"], "left"), group, [F.col(k) for k in keys], {"_weight": weight})
    placed = materialize(summed.select(*group, "hi", *keys, F.floor(F.col("_weight") / block).alias("_block")), "blocks")
    met = (todo.select(*group, "hi", "lo")
           .join(placed.select(*group, "hi", F.col("_block").alias("_from")), [*group, "hi"])
           .join(placed.select(*group, F.col("hi").alias("lo"), "_block"), [*group, "lo"]))
    # All conflicts from earlier blocks say the same of a node: one row is left of them before the shuffle.
    inside = met.select(*group, "_block", F.when(F.col("_from") == F.col("_block"), F.col("hi")).alias("hi"), "lo").distinct()
    rows = placed.withColumn("lo", F.lit(None).cast("bigint")).unionByName(inside, allowMissingColumns=True)
    schema = StructType([todo.schema[c] for c in (*group, "hi")])
    return rows.groupBy(*group, "_block").applyInPandas(lambda pdf: _pass_block(pdf, group, keys), schema)


def greedy_drop(edges: DataFrame, group: list[str], order: list[Column], limit: int = FOLD_LIMIT, block: int = BLOCK) -> DataFrame:
    """Nodes removed by greedy suppression: `(group, lo)`.

    `edges(group, hi, lo, ...)` are conflicts directed from the better to the worse node, and `order`
    sorts them by the better node. In each round the order is cut into blocks, each block is passed over for itself, and all that
    its certain survivors beat go, in whichever block. A group's first open block is always settled, so `n` conflicts
    among nodes that beat others take at most about `2 n / block` rounds, however long their chains are; what blocks settle among
    themselves makes it fewer.
    """
    if CUT in edges.columns:
        whole = _pass_whole(edges.where(~F.col(CUT)), group, order, "hi", "lo", None, ["lo"])
        rest = edges.where(CUT).drop(CUT)
        return whole if rest.isEmpty() else whole.unionByName(greedy_drop(rest, group, order, limit, block))
    todo = materialize(edges, "conflicts")
    removed: list[DataFrame] = []
    while True:
        small, todo = _split(todo, group, limit)
        removed.append(fold_drop(small, group, order))
        if todo is None:
            break
        settled = materialize(_block_survivors(todo, group, order, block), "survivors")
        gone = materialize(todo.join(settled, [*group, "hi"], "left_semi").select(*group, "lo").distinct(), "suppressed")
        discard(settled)
        removed.append(gone)
        rest = (todo.join(gone, [*group, "lo"], "left_anti")
                .join(gone.withColumnRenamed("lo", "hi"), [*group, "hi"], "left_anti"))
        todo = materialize(rest, "conflicts")
    out = removed[0].select(*group, "lo")
    for part in removed[1:]:
        out = out.unionByName(part.select(*group, "lo"))
    return out


MATCH_FOLD = """
    aggregate({pairs}, named_struct('a', cast(array() as array<bigint>), 'b', cast(array() as array<bigint>)),
              (s, e) -> if(array_contains(s.a, e.a) OR (NOT e.reuse AND array_contains(s.b, e.b)), s,
                           named_struct('a', array_append(s.a, e.a), 'b', array_append(s.b, e.b))),
              s -> arrays_zip(s.a, s.b))"""


def fold_match(edges: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Sequential pass: a pair is taken when neither end is taken yet."""
    folded = _sorted_pairs(edges, group, order, ["a", "b", "reuse"]).select(
        *group, F.expr(MATCH_FOLD.format(pairs="_es")).alias("_m"))
    return folded.select(*group, F.inline("_m"))


def greedy_match(edges: DataFrame, group: list[str], order: list[Column], limit: int = FOLD_LIMIT) -> DataFrame:
    """One-to-one pairs `(group, a, b)` chosen greedily in `order`.

    `edges(group, a, b, reuse, ...)`; a `b` whose pairs are marked `reuse` may be taken repeatedly.
    In each round a pair that comes first both among the pairs of its `a` and among those of its `b`
    is taken, because nothing earlier in the order can block it.
    """
    if CUT in edges.columns:
        whole = _pass_whole(edges.where(~F.col(CUT)), group, order, "a", "b", "reuse", ["a", "b"])
        rest = edges.where(CUT).drop(CUT)
        return whole if rest.isEmpty() else whole.unionByName(greedy_match(rest, group, order, limit))
    todo = materialize(edges, "candidates")
    taken: list[DataFrame] = []
    while True:
        small, todo = _split(todo, group, limit)
        taken.append(fold_match(small, group, order))
        if todo is None:
            break
        rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col("a"), F.col("b"))
        ranked = todo.withColumn("_rank", rank)
        first_a = ranked.groupBy(*group, "a").agg(F.min("_rank").alias("_best_a"))
        first_b = ranked.where("NOT reuse").groupBy(*group, "b").agg(F.min("_rank").alias("_best_b"))
        won = (first_a.withColumn("b", F.col("_best_a.b"))
               .join(first_b, [*group, "b"], "left")
               .where("_best_b IS NULL OR _best_a = _best_b")
               .select(*group, "a", "b"))
        reusable = todo.where("reuse").select(*group, "b").distinct().withColumn("_reuse", F.lit(True))
        won = materialize(won.join(reusable, [*group, "b"], "left")
                          .select(*group, "a", "b", F.coalesce("_reuse", F.lit(False)).alias("_reuse")), "taken")
        taken.append(won.select(*group, "a", "b"))
        rest = (todo.join(won.select(*group, "a"), [*group, "a"], "left_anti")
                .join(won.where("NOT _reuse").select(*group, "b"), [*group, "b"], "left_anti"))
        todo = materialize(rest, "candidates")
    out = taken[0]
    for part in taken[1:]:
        out = out.unionByName(part)
    return out
