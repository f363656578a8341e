"""Pictures as rows (picture, r, c, v): stencils by shifting cells, sums by windows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.errors import InvalidParameter

#: Gradient kernels for the x direction (fixed values); y is the transpose.
KERNELS = {"sobel": [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], "prewitt": [[-1, 0, 1], [-1, 0, 1], [-1, 0, 1]], "scharr": [[-3, 0, 3], [-10, 0, 10], [-3, 0, 3]]}


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def correlate(grid: DataFrame, weights: Sequence[Sequence[float]], edge: str = "extend") -> DataFrame:
    """Each cell gives its value to the cells whose stencil covers it; sums by cell.

    edge: extend (a cell beyond the border has the nearest one's value), wrap (the one at the opposite
    border's side), zero or valid (inner cells only).
    """
    if edge not in ("extend", "wrap", "zero", "valid"):
        raise InvalidParameter(f"edge: {edge}")
    h, w = len(weights), len(weights[0])
    size = grid.groupBy("picture").agg(F.max("r").alias("hr"), F.max("c").alias("wc"))
    taps = F.array(*[F.struct(F.lit(i - h // 2).alias("dr"), F.lit(j - w // 2).alias("dc"), F.lit(float(weights[i][j])).alias("k")) for i in range(h) for j in range(w)])
    cells = grid.select("picture", "r", "c").join(size, "picture").select("picture", "r", "c", "hr", "wc", F.explode(taps).alias("t"))
    row, col = F.col("r") + F.col("t.dr"), F.col("c") + F.col("t.dc")
    inside = (row >= 0) & (row <= F.col("hr")) & (col >= 0) & (col <= F.col("wc"))
    if edge == "extend":
        row, col = F.least(F.greatest(row, F.lit(0)), F.col("hr")), F.least(F.greatest(col, F.lit(0)), F.col("wc"))
    elif edge == "wrap":
        row, col = F.pmod(row, F.col("hr") + 1), F.pmod(col, F.col("wc") + 1)
    wanted = cells.select("picture", "r", "c", row.alias("sr"), col.alias("sc"), F.col("t.k").alias("k"), inside.alias("inside"))
    if edge in ("zero", "valid"):
        wanted = wanted.where("inside")
    values = grid.select("picture", F.col("r").alias("sr"), F.col("c").alias("sc"), "v")
    out = wanted.join(values, ["picture", "sr", "sc"]).groupBy("picture", "r", "c").agg(F.sum(F.col("k") * F.col("v")).alias("v"), F.count("*").alias("n"))
    return (out.where(F.col("n") == h * w) if edge == "valid" else out).drop("n")


def gradients(grid: DataFrame, operator: str = "sobel", edge: str = "extend") -> DataFrame:
    """(picture, r, c, gx, gy, magnitude, direction)."""
    k = np.array(KERNELS[operator], float)
    x = correlate(grid, k.tolist(), edge).withColumnRenamed("v", "gx")
    y = correlate(grid, k.T.tolist(), edge).withColumnRenamed("v", "gy")
    return x.join(y, ["picture", "r", "c"]).withColumn("magnitude", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))).withColumn("direction", F.atan2("gy", "gx"))


def corner_response(grid: DataFrame, side: int = 3, k: float = 0.04, measure: str = "harris") -> DataFrame:
    """(picture, r, c, strength) from the window sums of gradient products."""
    g = gradients(grid)
    box = [[1.0] * side for _ in range(side)]
    out = None
    for name, value in (("xx", F.col("gx") * F.col("gx")), ("yy", F.col("gy") * F.col("gy")), ("xy", F.col("gx") * F.col("gy"))):
        part = correlate(g.select("picture", "r", "c", value.alias("v")), box, "zero").withColumnRenamed("v", name)
        out = part if out is None else out.join(part, ["picture", "r", "c"])
    det, trace = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy"), F.col("xx") + F.col("yy")
    least = trace / 2 - F.sqrt(F.greatest(trace * trace / 4 - det, F.lit(0.0)))
    return out.select("picture", "r", "c", (det - k * trace * trace if measure == "harris" else least).alias("strength"))


def integral(grid: DataFrame) -> DataFrame:
    """(picture, r, c, s): the sum of all cells up to and with (r, c)."""
    across = Window.partitionBy("picture", "r").orderBy("c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("picture", "c").orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return grid.withColumn("s", F.sum("v").over(across)).withColumn("s", F.sum("s").over(down)).drop("v")


def rectangle_sums(sums: DataFrame, top: int, left: int, bottom: int, right: int) -> DataFrame:
    """(picture, total) of the rows top..bottom and columns left..right, from four cells of ``integral``."""
    at = lambda r, c: (F.col("r") == r) & (F.col("c") == c)
    sign = F.when(at(bottom, right) | at(top - 1, left - 1), 1).when(at(top - 1, right) | at(bottom, left - 1), -1)
    return sums.where(sign.isNotNull()).groupBy("picture").agg(F.sum(sign * F.col("s")).alias("total"))


def match_template(grid: DataFrame, template: Sequence[Sequence[float]], rule: str = "difference") -> DataFrame:
    """(picture, r, c, score) at each top left corner: squared difference, correlation or centred cosine (0 / 0 is 0)."""
    h, w = len(template), len(template[0])
    t = np.array(template, float)
    taps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(float(t[i, j])).alias("t")) for i in range(h) for j in range(w)])
    size = grid.groupBy("picture").agg(F.max("r").alias("hr"), F.max("c").alias("wc"))
    placed = grid.join(size, "picture").select("picture", "v", "hr", "wc", "r", "c", F.explode(taps).alias("x"))
    at = placed.select("picture", (F.col("r") - F.col("x.i")).alias("r"), (F.col("c") - F.col("x.j")).alias("c"), "v", F.col("x.t").alias("t"), "hr", "wc").where((F.col("r") >= 0) & (F.col("c") >= 0) & (F.col("r") <= F.col("hr") - h + 1) & (F.col("c") <= F.col("wc") - w + 1))
    v, x = F.col("v"), F.col("t")
    if rule == "difference":
        score = F.sum((v - x) * (v - x))
    elif rule == "correlation":
        score = F.sum(v * x)
    else:
        top = F.sum(v * x) - F.sum(v) * F.sum(x) / (h * w)
        bottom = F.sqrt(F.greatest((F.sum(v * v) - F.sum(v) * F.sum(v) / (h * w)) * (F.sum(x * x) - F.sum(x) * F.sum(x) / (h * w)), F.lit(0.0)))
        score = F.when(bottom < 1e-12, 0.0).otherwise(top / bottom)
    return at.groupBy("picture", "r", "c").agg(score.alias("score"))


def pooled(grid: DataFrame, side: int, how: str = "max") -> DataFrame:
    """Non-overlapping windows of side x side; the cells that fill none at the border are left out."""
    size = grid.groupBy("picture").agg(F.max("r").alias("hr"), F.max("c").alias("wc"))
    cells = grid.join(size, "picture").withColumn("pr", F.floor(F.col("r") / side)).withColumn("pc", F.floor(F.col("c") / side)).where(((F.col("pr") + 1) * side <= F.col("hr") + 1) & ((F.col("pc") + 1) * side <= F.col("wc") + 1))
    return cells.groupBy("picture", F.col("pr").alias("r"), F.col("pc").alias("c")).agg((F.max("v") if how == "max" else F.avg("v")).alias("v"))


def similarity_transform(pairs: DataFrame) -> DataFrame:
    """(scale, turn, shift_x, shift_y) that bring (x, y) nearest to (u, v), least squares, one pass."""
    s = pairs.agg(*[F.avg(c).alias(c) for c in ("x", "y", "u", "v")], F.covar_pop("x", "u").alias("xu"), F.covar_pop("y", "v").alias("yv"), F.covar_pop("x", "v").alias("xv"), F.covar_pop("y", "u").alias("yu"), (F.var_pop("x") + F.var_pop("y")).alias("var"))
    a, b = (F.col("xu") + F.col("yv")) / F.col("var"), (F.col("xv") - F.col("yu")) / F.col("var")
    return s.select(F.sqrt(a * a + b * b).alias("scale"), F.atan2(b, a).alias("turn"), (F.col("u") - (a * F.col("x") - b * F.col("y"))).alias("shift_x"), (F.col("v") - (b * F.col("x") + a * F.col("y"))).alias("shift_y"))


def _size(grid: DataFrame) -> DataFrame:
    return grid.groupBy("picture").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))


def scaled_up(grid: DataFrame, factor: int) -> DataFrame:
    """Every cell becomes a square of factor x factor cells."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(factor) for j in range(factor)])
    return grid.select("picture", "r", "c", "v", F.explode(steps).alias("x")).select("picture", (F.col("r") * factor + F.col("x.i")).alias("r"), (F.col("c") * factor + F.col("x.j")).alias("c"), "v")


def turned(grid: DataFrame) -> DataFrame:
    """By a right angle, clockwise."""
    return grid.join(_size(grid), "picture").select("picture", F.col("c").alias("r"), (F.col("h") - 1 - F.col("r")).alias("c"), "v")


def placed(grid: DataFrame, top: int, left: int, height: int, width: int, background: float = 0.0) -> DataFrame:
    """On a larger background; what lies outside of it is cut off."""
    cells = F.array(*[F.struct(F.lit(i).cast("long").alias("r"), F.lit(j).cast("long").alias("c")) for i in range(height) for j in range(width)])
    canvas = grid.select("picture").distinct().select("picture", F.explode(cells).alias("x")).select("picture", "x.r", "x.c")
    at = grid.select("picture", (F.col("r") + top).alias("r"), (F.col("c") + left).alias("c"), "v")
    return canvas.join(at, ["picture", "r", "c"], "left").withColumn("v", F.coalesce("v", F.lit(float(background))))


def mean_absolute_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(picture, difference) over the cells that both have."""
    both = a.join(b.select("picture", "r", "c", F.col("v").alias("_o")), ["picture", "r", "c"])
    return both.groupBy("picture").agg(F.avg(F.abs(F.col("v") - F.col("_o"))).alias("difference"))


def separation_ratio(scores: DataFrame, rule: str = "difference") -> DataFrame:
    """(picture, ratio) of a match table: the best score over the next one; a difference's is turned round,
    and a next score of zero gives null."""
    order = Window.partitionBy("picture").orderBy("score" if rule == "difference" else F.desc("score"), "r", "c")
    two = scores.withColumn("_k", F.row_number().over(order)).where("_k <= 2").groupBy("picture").agg(F.max(F.when(F.col("_k") == 1, F.col("score"))).alias("first"), F.max(F.when(F.col("_k") == 2, F.col("score"))).alias("second"))
    top, bottom = (F.col("second"), F.col("first")) if rule == "difference" else (F.col("first"), F.col("second"))
    return two.select("picture", F.when(bottom != 0, top / bottom).alias("ratio"))
