"""Neighbourhood operators on dense rasters (keys, y, x, v) as separable windows.

All of them read one exchange by tile: windows over (tile, y) and (tile, x) are both satisfied by it. Where a pixel needs
more of its line than a window's sums give, the line is made one row, worked on as an array, and taken apart again, so
each pixel is held once.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def axes(keys: list[str], y: str = "y", x: str = "x") -> tuple[WindowSpec, WindowSpec]:
    """Windows along a row (ordered by x) and down a column (ordered by y)."""
    return Window.partitionBy(*keys, y).orderBy(x), Window.partitionBy(*keys, x).orderBy(y)


def _next(c: str | Column, w: WindowSpec) -> Column:
    """The next value along the axis, mirrored at the end without repeating the edge."""
    return F.coalesce(F.lead(c).over(w), F.lag(c).over(w))


def _last(c: str | Column, w: WindowSpec) -> Column:
    return F.coalesce(F.lag(c).over(w), F.lead(c).over(w))


def laplacian(df: DataFrame, keys: list[str], value: str = "v", out: str = "lap") -> DataFrame:
    along, down = axes(keys)
    return df.withColumn(out, _next(value, along) + _last(value, along) + _next(value, down) + _last(value, down) - 4 * F.col(value))


def sobel(df: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """sx and sy: smoothed by 1, 2, 1 across, differenced along."""
    along, down = axes(keys)
    smooth = df.withColumn("_sv", _last(value, down) + 2 * F.col(value) + _next(value, down)).withColumn("_sh", _last(value, along) + 2 * F.col(value) + _next(value, along))
    return smooth.withColumn("sx", _next("_sv", along) - _last("_sv", along)).withColumn("sy", _next("_sh", down) - _last("_sh", down)).drop("_sv", "_sh")


def kernel(sigma: float) -> list[float]:
    """Gaussian weights out to 4 sigma, summing to 1."""
    r = int(4 * sigma + 0.5)
    w = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-r, r + 1)]
    return [v / sum(w) for v in w]


def along_lines(df: DataFrame, keys: list[str], line: str, place: str, out: str, value: Callable[[Column, Column], Column]) -> DataFrame:
    """df with a column made of whole lines: value(pixels, i) gets a line's pixels in order as an array of rows, and the
    index of one of them. df must be dealt by keys, so no exchange is needed."""
    others = [c for c in df.columns if c not in (*keys, line, place)]
    lines = df.groupBy(*keys, line).agg(F.array_sort(F.collect_list(F.struct(place, *others))).alias("_line"))
    made = F.transform(F.sequence(F.lit(0), F.size("_line") - 1), lambda i: F.struct(F.get("_line", i).alias("px"), value(F.col("_line"), i).alias("out")))
    return lines.select(*keys, line, F.explode(made).alias("_p")).select(*[F.col(f"_p.px.{c}").alias(c) if c not in (*keys, line) else c for c in df.columns], F.col("_p.out").alias(out))


def gaussian(df: DataFrame, keys: list[str], sigma_y: float, sigma_x: float, value: str = "v", out: str = "blur") -> DataFrame:
    """Separable blur; beyond the border the edge-including mirror image (d c b a | a b c d | d c b a) is taken, folded
    as often as the kernel needs."""

    def blurred(d: DataFrame, sigma: float, line: str, place: str, src: str, dst: str) -> DataFrame:
        w = kernel(sigma)
        r = len(w) // 2

        def pixel(line_: Column, i: Column) -> Column:
            n = F.size(line_)
            at = lambda t: F.pmod(i + t, 2 * n)
            taps = F.zip_with(F.sequence(F.lit(-r), F.lit(r)), F.lit(w), lambda t, k: k * F.get(line_, F.least(at(t), 2 * n - 1 - at(t)).cast("int"))[src])
            return F.aggregate(taps, F.lit(0.0), lambda a, t: a + t)

        return along_lines(d, keys, line, place, dst, pixel)

    d = df.repartition(*keys)
    d = blurred(d, sigma_y, "x", "y", value, "_half") if sigma_y else d.withColumn("_half", F.col(value))
    return (blurred(d, sigma_x, "y", "x", "_half", out) if sigma_x else d.withColumn(out, F.col("_half"))).drop("_half")


def closing(df: DataFrame, keys: list[str], k: int, value: str = "v", out: str = "closed") -> DataFrame:
    """Grey closing by a square of 2k + 1: maxima along both axes, then minima."""
    along, down = (w.rangeBetween(-k, k) for w in axes(keys))
    d = df
    for f in (F.max, F.min):
        for w in (along, down):
            d = d.withColumn(out, f(out if out in d.columns else value).over(w))
    return d


def offsets_join(df: DataFrame, keys: list[str], offsets: list[tuple[int, int]], condition: Column) -> DataFrame:
    """(keys, y, x, hits): how many pixels at the offsets fulfil the condition; only those are sent."""
    around = F.explode(F.lit([list(o) for o in offsets])).alias("o")
    hits = df.where(condition).select(*keys, "y", "x", around).groupBy(*keys, (F.col("y") - F.col("o")[0]).alias("y"), (F.col("x") - F.col("o")[1]).alias("x")).agg(F.count("*").alias("hits"))
    return df.join(hits, [*keys, "y", "x"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def diamond(r: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if abs(dy) + abs(dx) <= r]


def ellipse5() -> list[tuple[int, int]]:
    """The 5 x 5 ellipse: rows of 1, 5, 5, 5 and 1 pixels."""
    return [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3) if abs(dy) < 2 or dx == 0]


def erode(df: DataFrame, keys: list[str], times: int, valid: Column) -> DataFrame:
    """eroded: whether all pixels within `times` steps are there and valid (erosions by a cross).

    These are the pixels whose city-block distance to what is not valid or not there is more than `times`: the nearest such
    place in the row, then the least of those distances plus rows apart, both as running windows.
    """
    along, down = axes(keys)
    d = df.withColumn("_ok", F.coalesce(valid, F.lit(False)))
    for step, w in ((-1, along), (1, along)):
        beside = F.lag("x").over(w) if step < 0 else F.lead("x").over(w)
        frame = w.rowsBetween(Window.unboundedPreceding, 0) if step < 0 else w.rowsBetween(0, Window.unboundedFollowing)
        bad = F.when(~F.col("_ok"), F.col("x")).when(beside.isNull() | (beside != F.col("x") + step), F.col("x") + step)
        near = F.last("_bad", ignorenulls=True) if step < 0 else F.first("_bad", ignorenulls=True)
        d = d.withColumn("_bad", bad).withColumn("_left" if step < 0 else "_right", near.over(frame))
    d = d.withColumn("_row", F.least(F.col("x") - F.col("_left"), F.col("_right") - F.col("x")))
    far = []
    for step in (-1, 1):
        beside = F.lag("y").over(down) if step < 0 else F.lead("y").over(down)
        frame = down.rowsBetween(Window.unboundedPreceding, 0) if step < 0 else down.rowsBetween(0, Window.unboundedFollowing)
        gap = F.when(beside.isNull() | (beside != F.col("y") + step), step * F.col("y") + 1)
        d = d.withColumn(f"_b{step + 1}", F.least(F.col("_row") + step * F.col("y"), gap))
        far.append(F.min(f"_b{step + 1}").over(frame) - step * F.col("y"))
    return d.withColumn("eroded", F.least(*far) > times).drop("_ok", "_bad", "_left", "_right", "_row", "_b0", "_b2")


def dilate(df: DataFrame, keys: list[str], shape: list[tuple[int, int]], mask: Column) -> DataFrame:
    return offsets_join(df, keys, shape, mask).withColumn("dilated", F.col("hits") > 0).drop("hits")


def distance(df: DataFrame, keys: list[str], inside: Column, reach: int) -> DataFrame:
    """Exact Euclidean distance from each inside pixel to the nearest outside one within reach, else null.

    Two passes: the nearest outside pixel in the row, then the least of row distances squared plus rows apart squared over
    `reach` pixels either way of the column.
    """
    along, _ = axes(keys)
    d = df.repartition(*keys).withColumn("_in", inside).withColumn("_out", F.when(~F.col("_in"), F.col("x")))
    left = F.last("_out", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first("_out", ignorenulls=True).over(along.rowsBetween(0, Window.unboundedFollowing))
    d = d.withColumn("_row", F.least(F.col("x") - left, right - F.col("x"))).drop("_out")

    def nearest(line: Column, i: Column) -> Column:
        y = F.get(line, i)["y"]
        first = F.greatest(i - reach, F.lit(0))
        around = F.slice(line, first + 1, i - first + reach + 1)
        return F.array_min(F.transform(around, lambda s: s["_row"] * s["_row"] + (s["y"] - y) * (s["y"] - y)))

    d = along_lines(d, keys, "x", "y", "_d2", nearest)
    return d.withColumn("distance", F.when(~F.col("_in"), F.lit(0.0)).when(F.col("_d2") <= reach * reach, F.sqrt("_d2"))).drop("_row", "_d2", "_in")


def feather(d: str | Column, fade: float, power: float) -> Column:
    """Blend weight from a distance to the edge; null is farther than the fade."""
    c = F.coalesce(F.col(d) if isinstance(d, str) else d, F.lit(float(fade)))
    return F.pow(F.least(F.greatest(c / fade, F.lit(0.0)), F.lit(1.0)), power)


def fill_gaps(df: DataFrame, width: int, value: str = "v", line: str = "y", place: str = "x") -> DataFrame:
    """Null values on a periodic line of `width` places, linear between the neighbours that have one."""
    wide = df.select("*", F.explode(F.array(*[F.lit(k * width) for k in (-1, 0, 1)])).alias("_shift")).withColumn("_p", F.col(place) + F.col("_shift"))
    w = Window.partitionBy(line).orderBy("_p")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_p").alias("p"), F.col(value).alias("v")))
    d = wide.withColumn("_a", F.last(known, ignorenulls=True).over(back)).withColumn("_b", F.first(known, ignorenulls=True).over(ahead)).where("_shift = 0")
    line_value = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col("_p") - F.col("_a.p")) / (F.col("_b.p") - F.col("_a.p"))
    return d.withColumn("filled", F.when(F.col(value).isNotNull(), F.col(value)).otherwise(line_value)).drop("_shift", "_p", "_a", "_b")


def wrap_pad(df: DataFrame, width: int, pad: int) -> DataFrame:
    """Copies of the outer columns beyond either side."""
    shift = F.explode(F.filter(F.array(F.lit(0), F.lit(width), F.lit(-width)), lambda s: (F.col("x") + s).between(-pad, width + pad - 1)))
    return df.select("*", shift.alias("_s")).withColumn("x", F.col("x") + F.col("_s")).drop("_s")


def edge_smooth(df: DataFrame, keys: list[str], sigma: float = 3, share: float = 0.2) -> DataFrame:
    """Blurred where the gradient is steep against the raster's steepest, as it is elsewhere."""
    d = sobel(gaussian(df, keys, sigma, sigma), keys).withColumn("_g", F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy")))
    most = F.max("_g").over(Window.partitionBy(*keys))
    m = F.when(most > 0, F.least(F.greatest(F.col("_g") / most / share, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    return d.withColumn("smooth", F.col("v") * (1 - m) + F.col("blur") * m).drop("_g", "sx", "sy")
