"""Per-pixel operators over ``pixels(scene, row, col, px, bands, ...)``: masks, rescaling, change, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import distance2_col

KEY = ["scene", "row", "col"]


def is_nodata(value: float, any_band: bool = False, bands: str = "bands") -> Column:
    """Whether all bands (or any) are exactly ``value``."""
    test = F.exists if any_band else F.forall
    return test(F.col(bands), lambda x: x == F.lit(value))


def valid_mask(pixels: DataFrame, nodata: float | None = None, any_band: bool = False, mask: DataFrame | None = None) -> DataFrame:
    """``pixels`` with ``valid``: not masked out, not nodata.

    ``mask`` is an image of one band on the same grid; any nonzero sample is valid, a missing pixel is not masked.
    """
    ok = F.lit(True) if nodata is None else ~is_nodata(nodata, any_band)
    if mask is None:
        return pixels.withColumn("valid", ok)
    on = mask.select(*KEY, (F.element_at("bands", 1) != 0).alias("_on"))
    return pixels.join(on, KEY, "left").withColumn("valid", F.coalesce("_on", F.lit(True)) & ok).drop("_on")


def check_nodata(value: float | None, low: int, high: int, from_file: bool) -> int | None:
    """A nodata value as an integer of the sample type; a file's that doesn't fit is ignored, a caller's refused."""
    if value is None:
        return None
    near = round(value)
    if abs(value - near) <= 1e-9 and low <= near <= high:
        return near
    if from_file:
        return None
    raise ValueError(f"nodata {value} isn't a sample value of {low} to {high}")


def band_range(pixels: DataFrame, where: Column | None = None) -> DataFrame:
    """``scene, band, lo, hi`` over valid samples."""
    rows = (pixels if where is None else pixels.filter(where)).select("scene", F.posexplode("bands").alias("band", "x"))
    return rows.groupBy("scene", "band").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))


def normalized(pixels: DataFrame, nodata: int | None = None) -> DataFrame:
    """Integer bands rescaled to 1 .. 254 + 1 by each band's range over valid samples, truncated; nodata becomes 0.

    Two passes: one small row per band, joined back by scene.  A band of one value has no range and is refused.
    """
    rows = pixels.select("scene", F.posexplode("bands").alias("band", "x"))
    rows = rows if nodata is None else rows.filter(F.col("x") != nodata)
    span = rows.groupBy("scene", "band").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    flat = span.withColumn("hi", F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.raise_error(F.lit("a band has one value only"))))
    lists = flat.groupBy("scene").agg(F.array_sort(F.collect_list(F.struct("band", "lo", "hi"))).alias("_span"))
    scaled = "cast((cast(b as double) - cast(s.lo as double)) / (cast(s.hi as double) - cast(s.lo as double)) * 254D + 1D as int)"
    body = scaled if nodata is None else f"case when b = {int(nodata)} then 0 else {scaled} end"
    return pixels.join(lists, "scene").withColumn("bands", F.expr(f"zip_with(bands, _span, (b, s) -> {body})")).drop("_span")


def changed(previous: DataFrame, current: DataFrame) -> DataFrame:
    """``scene, row, col, px, changed``: any band differs.  Floats are compared by their text, which tells what bits tell: NaN equals NaN, 0.0 isn't -0.0."""
    kinds = {dict(d.dtypes)["bands"] for d in (previous, current)}
    if len(kinds) > 1:
        raise ValueError(f"the sample types differ: {sorted(kinds)}")
    bits = "transform(bands, x -> cast(x as string))" if "float" in kinds.pop() else "bands"
    p = previous.select(*KEY, F.expr(bits).alias("_was"))
    return current.withColumn("_is", F.expr(bits)).join(p, KEY).select(*KEY, "px", (F.col("_is") != F.col("_was")).alias("changed"))


def neighbours(pixels: DataFrame, columns: list[str], eight_way: bool = False) -> DataFrame:
    """Rows of ``pixels`` with ``n_<direction>`` structs of ``columns`` of the adjacent pixel, null where there is none.

    Each pair of opposite directions is one window along rows, columns or diagonals: no pixel is copied, and what
    is shuffled doesn't grow with the number of directions of a pair.
    """
    lines = [("row", "col", 0, 1, "e", "w"), ("col", "row", 1, 0, "s", "n")]
    if eight_way:
        lines += [("row - col", "row", 1, 1, "se", "nw"), ("row + col", "row", 1, -1, "sw", "ne")]
    value = F.struct(*[F.col(c) for c in ["row", "col", *columns]])
    out = pixels.withColumn("_v", value)
    for line, along, dr, dc, ahead, behind in lines:
        over = f"over (partition by scene, {line} order by {along})"
        out = out.withColumns({"_a": F.expr(f"lead(_v) {over}"), "_b": F.expr(f"lag(_v) {over}")})
        near = lambda c, s: F.expr(f"case when {c}.row = row + {s * dr} and {c}.col = col + {s * dc} then {c} end")  # noqa: E731, B023
        out = out.withColumns({f"n_{ahead}": near("_a", 1), f"n_{behind}": near("_b", -1)})
    return out.drop("_v", "_a", "_b")


#: Direction names in the order of ``config.FOUR_WAY`` and ``config.EIGHT_WAY``.
FOUR = ["n", "e", "s", "w"]
EIGHT = ["n", "ne", "e", "se", "s", "sw", "w", "nw"]


def nearest_flags(pixels: DataFrame, tolerance: float, eight_way: bool = False) -> DataFrame:
    """``scene, row, col, px, d2, directions``: least squared distance to a neighbour, and where it is reached.

    ``directions`` (0 north, clockwise) is empty if the least distance is over the tolerance or there is no neighbour.
    Only valid pixels should be passed.
    """
    names = EIGHT if eight_way else FOUR
    near = neighbours(pixels, ["bands"], eight_way)
    for n in names:
        near = near.withColumn(f"d_{n}", F.when(F.col(f"n_{n}").isNotNull(), distance2_col("bands", f"n_{n}.bands", "bigint")))
    least = F.least(*[F.col(f"d_{n}") for n in names])
    t2 = float(tolerance) * float(tolerance)
    hits = F.array_compact(F.array(*[F.when((F.col(f"d_{n}") == F.col("d2")) & (F.col("d2") <= F.lit(t2)), F.lit(k)) for k, n in enumerate(names)]))
    return near.withColumn("d2", least).select(*KEY, "px", "d2", hits.alias("directions"))


def mutual_pairs(flags: DataFrame, eight_way: bool = False) -> DataFrame:
    """``scene, px, direction``: forward directions in which a pixel and its neighbour flag each other."""
    m = 8 if eight_way else 4
    names = EIGHT if eight_way else FOUR
    near = neighbours(flags, ["directions"], eight_way)
    forward = [k for k, n in enumerate(names) if n in ("e", "s", "se", "sw")]
    tests = [F.when(F.array_contains("directions", k) & F.array_contains(f"n_{names[k]}.directions", (k + m // 2) % m), F.lit(k)) for k in forward]
    return near.select("scene", "px", F.explode(F.array_compact(F.array(*tests))).alias("direction"))
