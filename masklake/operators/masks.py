"""Mask algebra on slab tables.

A mask is a set of rows `(keys..., c0, c1, r0, r1)`: half-open pixel rectangles, disjoint within one
mask. A column span is a slab one column wide. Union, intersection depth and erosion are line
sweeps over the stretches between distinct borders (`sweep`): a slab is shuffled once, by its mask, and a
task passes over the slabs in order, holding only those that reach the current line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from masklake.functions import rle
from masklake.operators import sweep

SLAB = ["c0", "c1", "r0", "r1"]


def box_slabs(df: DataFrame, x: str = "x", y: str = "y", w: str = "w", h: str = "h") -> DataFrame:
    """One slab per box row; the box columns are replaced by `c0, c1, r0, r1`."""
    return (df.withColumns({"c0": F.col(x), "c1": F.col(x) + F.col(w),
                            "r0": F.col(y), "r1": F.col(y) + F.col(h)})
            .drop(x, y, w, h).where("c1 > c0 AND r1 > r0"))


def slab_pixels() -> Column:
    return (F.col("c1") - F.col("c0")) * (F.col("r1") - F.col("r0"))


def mask_stats(slabs: DataFrame, keys: list[str]) -> DataFrame:
    """Pixel area, tight box and slab count of every mask."""
    return slabs.groupBy(*keys).agg(
        F.sum(slab_pixels()).alias("area"),
        F.min("c0").alias("x"), F.min("r0").alias("y"),
        (F.max("c1") - F.min("c0")).alias("w"), (F.max("r1") - F.min("r0")).alias("h"),
        F.count(F.lit(1)).alias("n_slabs"))


def _exploded(df: DataFrame, runs: str, height: str, stack: bool) -> DataFrame:
    return (df.withColumn("_slab", F.explode(rle.run_slabs(F.col(runs), F.col(height).cast("bigint"), stack)))
            .select(*[c for c in df.columns if c != runs], "_slab.*"))


def runs_to_slabs(df: DataFrame, runs: str, height: str) -> DataFrame:
    """Explode run lengths into slabs; a run over several columns gives at most three slabs."""
    return _exploded(df, runs, height, False)


def runs_to_stacks(df: DataFrame, runs: str, height: str) -> DataFrame:
    """Explode run lengths into as few slabs as equal runs on neighbouring columns allow: a rectangle is one row at any width."""
    return _exploded(df, runs, height, True)


def column_spans(slabs: DataFrame) -> DataFrame:
    """One row per pixel column of every slab."""
    return (slabs.withColumn("col", F.explode(F.sequence(F.col("c0"), F.col("c1") - 1)))
            .drop("c0", "c1"))


def _in_order(slabs: DataFrame, keys: list[str], line: tuple[str, str], pos: tuple[str, str], depth: int | Column,
              more: list[Column] = ()) -> tuple[DataFrame, list[T.StructField]]:
    """Slabs mask by mask as `sweep.runs` takes them, with `more` columns that depend on the keys alone, and the fields of the keys."""
    need = depth if isinstance(depth, Column) else F.lit(depth)
    numbers = [F.col(c).cast("bigint").alias(n) for c, n in zip((*line, *pos), ("l0", "l1", "p0", "p1"))]
    wanted = slabs.where((F.col(line[1]) > F.col(line[0])) & (F.col(pos[1]) > F.col(pos[0])))
    # The window brings a mask's slabs into one partition and in order, and tells where a mask begins.
    order = Window.partitionBy(*keys).orderBy("l0")
    rows = (wanted.select(*keys, *more, *numbers, need.cast("bigint").alias("_need"))
            .withColumn("_first", F.row_number().over(order) == 1))
    return rows, [rows.schema[k] for k in keys]


def _sweep(slabs: DataFrame, keys: list[str], line: tuple[str, str], pos: tuple[str, str],
           depth: int | Column) -> DataFrame:
    """Maximal stretches of equal runs `(keys, l0, l1, p0, p1)` where at least `depth` slabs cover the lines [l0, l1)."""
    rows, own = _in_order(slabs, keys, line, pos, depth)
    schema = T.StructType([*own, *[T.StructField(c, T.LongType()) for c in sweep.RUN]])
    return rows.mapInArrow(lambda batches: sweep.runs(batches, keys), schema)


def _as_slabs(stacked: DataFrame, keys: list[str], by_column: bool) -> DataFrame:
    lines, runs = (("c0", "c1"), ("r0", "r1")) if by_column else (("r0", "r1"), ("c0", "c1"))
    named = {lines[0]: "l0", lines[1]: "l1", runs[0]: "p0", runs[1]: "p1"}
    return stacked.select(*keys, *[F.col(named[c]).cast("bigint").alias(c) for c in SLAB])


def _by_line(stretches: DataFrame, keys: list[str]) -> DataFrame:
    return stretches.select(*keys, F.explode(F.sequence("l0", F.col("l1") - 1)).alias("line"), "p0", "p1")


def column_runs(slabs: DataFrame, keys: list[str], depth: int | Column = 1) -> DataFrame:
    """Disjoint maximal vertical runs covered at least `depth` times."""
    return _by_line(_sweep(slabs, keys, ("c0", "c1"), ("r0", "r1"), depth), keys)


def row_runs(slabs: DataFrame, keys: list[str], depth: int | Column = 1) -> DataFrame:
    """Disjoint maximal horizontal runs covered at least `depth` times."""
    return _by_line(_sweep(slabs, keys, ("r0", "r1"), ("c0", "c1"), depth), keys)


def union(slabs: DataFrame, keys: list[str]) -> DataFrame:
    """OR of all slabs sharing `keys`, as disjoint slabs."""
    return _as_slabs(_sweep(slabs, keys, ("c0", "c1"), ("r0", "r1"), 1), keys, by_column=True)


def covered_by(slabs: DataFrame, keys: list[str], depth: Column) -> DataFrame:
    """AND-merge: the pixels covered by `depth` of the (individually disjoint) layers of a key.

    `depth` may use the key columns only.
    """
    return _as_slabs(_sweep(slabs, keys, ("c0", "c1"), ("r0", "r1"), depth), keys, by_column=True)


def erode_general(slabs: DataFrame, keys: list[str], width: str = "d") -> DataFrame:
    """Erosion by a square of side 2d+1, outside the mask being background.

    The square is separable: shorten the vertical runs by `d` at both ends, then the horizontal
    runs of what is left.
    """
    ks, d = [*keys, width], F.col(width)
    shorter = lambda df: df.withColumns({"p0": F.col("p0") + d, "p1": F.col("p1") - d}).where("p1 > p0")
    tall = _as_slabs(shorter(_sweep(slabs, ks, ("c0", "c1"), ("r0", "r1"), 1)), ks, by_column=True)
    return _as_slabs(shorter(_sweep(tall, ks, ("r0", "r1"), ("c0", "c1"), 1)), ks, by_column=False)


def erode_rectangles(slabs: DataFrame, width: str = "d") -> DataFrame:
    """Erosion of masks that consist of a single slab."""
    d = F.col(width)
    return (slabs.withColumns({"c0": F.col("c0") + d, "c1": F.col("c1") - d,
                               "r0": F.col("r0") + d, "r1": F.col("r1") - d})
            .where("c1 > c0 AND r1 > r0"))


def erode(slabs: DataFrame, keys: list[str], width: str = "d") -> DataFrame:
    """Erosion, in closed form where `n_slabs` says that the mask is one rectangle."""
    if "n_slabs" not in slabs.columns:
        return erode_general(slabs, keys, width)
    cols = [*keys, width, *SLAB]
    simple = erode_rectangles(slabs.where("n_slabs = 1").select(*cols), width)
    rest = erode_general(slabs.where("n_slabs > 1").select(*cols), keys, width)
    return simple.unionByName(rest.select(*cols))


def boundary_band(slabs: DataFrame, keys: list[str], width: str = "d", carry: list[str] | None = None) -> DataFrame:
    """The inner band `M minus erode(M, d)` as signed slabs.

    `wt` is +1 on the slabs of the mask and -1 on those of its eroded core. Pixel counts of bands and
    of band intersections are sums of `wt` products, so no set difference is ever materialised.
    """
    carry = carry or []
    cols = [*keys, width, *carry, *SLAB, "wt"]
    core = erode(slabs, [*keys, *carry], width)
    return (slabs.withColumn("wt", F.lit(1)).select(*cols)
            .unionByName(core.withColumn("wt", F.lit(-1)).select(*cols)))


def crop(slabs: DataFrame, x0: Column, y0: Column, w: Column, h: Column, shift: bool = True) -> DataFrame:
    """Keep the part inside a window, in window coordinates when `shift`."""
    sx, sy = (x0, y0) if shift else (F.lit(0), F.lit(0))
    return (slabs.withColumns({
        "c0": F.greatest(F.col("c0"), x0) - sx, "c1": F.least(F.col("c1"), x0 + w) - sx,
        "r0": F.greatest(F.col("r0"), y0) - sy, "r1": F.least(F.col("r1"), y0 + h) - sy})
        .where("c1 > c0 AND r1 > r0"))


def slabs_to_runs(slabs: DataFrame, keys: list[str], height: str) -> DataFrame:
    """Run lengths (`runs`) of every mask on its canvas of `height` rows and `width` columns.

    `keys` must contain `height` and a `width` column. The array of one mask is bounded by its canvas.
    """
    size = [F.col(height).cast("bigint").alias("_h"), F.col("width").cast("bigint").alias("_w")]
    rows, own = _in_order(slabs, keys, ("c0", "c1"), ("r0", "r1"), 1, size)
    schema = T.StructType([*own, T.StructField("runs", T.ArrayType(T.LongType()))])
    # The runs of a mask come out of the sweep one after the other, so its lengths are taken in the same task.
    return rows.mapInArrow(lambda batches: sweep.lengths(sweep.runs(batches, [*keys, "_h", "_w"], "_mask"), keys), schema)


def rescale(slabs: DataFrame, keys: list[str], src_w: Column, src_h: Column, dst_w: Column, dst_h: Column) -> DataFrame:
    """Shrink a mask to a display grid: source interval [a, b) covers floor(a*s) up to ceil(b*s)."""
    def low(v: str, src: Column, dst: Column) -> Column:
        return F.least(F.floor(F.col(v) * dst / src), dst - 1)

    def high(v: str, src: Column, dst: Column) -> Column:
        return F.least(F.ceil(F.col(v) * dst / src), dst)

    scaled = slabs.withColumns({
        "c0": low("c0", src_w, dst_w).cast("bigint"), "c1": high("c1", src_w, dst_w).cast("bigint"),
        "r0": low("r0", src_h, dst_h).cast("bigint"), "r1": high("r1", src_h, dst_h).cast("bigint")})
    return union(scaled, keys)


def nearest_resize(slabs: DataFrame, src_w: Column, src_h: Column, dst_w: Column, dst_h: Column) -> DataFrame:
    """Nearest-neighbour resize of slabs from a `src` grid to a `dst` grid.

    Target pixel i reads source pixel floor((i + 0.5) * src / dst), so source interval [a, b) becomes
    [ceil(a*dst/src - 0.5), ceil(b*dst/src - 0.5)): a slab stays a slab.
    """
    def move(v: str, src: Column, dst: Column) -> Column:
        # ceil((2*a*dst - src) / (2*src)) in whole numbers
        num = F.col(v) * dst * 2 - src
        return F.ceil(num / (src * 2)).cast("bigint")

    return (slabs.withColumns({
        "c0": move("c0", src_w, dst_w), "c1": move("c1", src_w, dst_w),
        "r0": move("r0", src_h, dst_h), "r1": move("r1", src_h, dst_h)})
        .where("c1 > c0 AND r1 > r0"))


def flip_vertical(slabs: DataFrame, height: Column) -> DataFrame:
    return slabs.withColumns({"r0": height - F.col("r1"), "r1": height - F.col("r0")})


def flip_horizontal(slabs: DataFrame, width: Column) -> DataFrame:
    return slabs.withColumns({"c0": width - F.col("c1"), "c1": width - F.col("c0")})


def rotate_quarter(slabs: DataFrame, turns: int, width: Column, height: Column) -> DataFrame:
    """Counter-clockwise quarter turns; the canvas swaps sides for odd `turns`."""
    c0, c1, r0, r1 = (F.col(c) for c in SLAB)
    turns = turns % 4
    if turns == 0:
        return slabs
    new = {1: (r0, r1, width - c1, width - c0),
           2: (width - c1, width - c0, height - r1, height - r0),
           3: (height - r1, height - r0, c0, c1)}[turns]
    return slabs.withColumns(dict(zip(SLAB, new)))
