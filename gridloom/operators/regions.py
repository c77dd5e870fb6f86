"""Operators over region maps ``labels(scene, row, col, px, region_id)`` and the tables derived from them.

``rag(scene, src, dst, first_key)``: directed adjacency; ``regions(scene, region_id, npix, ..., ctr)``.
Region 0 is nodata.  Everything here is a plan of joins, windows and aggregates (float means: grouped numpy); nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import FLOAT_EPSILON, distance2_col, float_mean, ordered_sum32, pairwise_sum32
from .graph import dense_ids, exclusive_sum
from .pixels import EIGHT, FOUR, neighbours
from .streams import by_group

BINS = 1000


def adjacency(labels: DataFrame, eight_way: bool = False) -> DataFrame:
    """``scene, src, dst, first_key``: neighbouring regions; the key orders first contact, px * 8 + direction."""
    names = EIGHT if eight_way else FOUR
    near = neighbours(labels.filter("region_id <> 0"), ["region_id"], eight_way)
    sides = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"n_{n}.region_id").alias("dst")) for k, n in enumerate(names)])
    edges = near.select("scene", F.col("region_id").alias("src"), "px", F.explode(sides).alias("s")).filter("s.dst is not null and s.dst <> src")
    return edges.groupBy("scene", "src", F.col("s.dst").alias("dst")).agg(F.min(F.col("px") * 8 + F.col("s.k")).cast("long").alias("first_key"))


def stats(labels: DataFrame) -> DataFrame:
    """Size, bounding box and raster-first pixel of each region."""
    rows = labels.filter("region_id <> 0").groupBy("scene", "region_id")
    return rows.agg(F.count(F.lit(1)).alias("npix"), F.min("col").alias("ulx"), F.min("row").alias("uly"), F.max("col").alias("lrx"), F.max("row").alias("lry"), F.min("px").alias("first_px"))


def integer_means(labels: DataFrame, layer: DataFrame, bands: int) -> DataFrame:
    """``scene, region_id, npix, zeros, ctr``: exact sums of integer bands, one division in double."""
    rows = labels.filter("region_id <> 0").join(layer.select("scene", "px", "bands"), ["scene", "px"])
    sums = [F.sum(F.element_at("bands", b + 1).cast("long")).alias(f"_s{b}") for b in range(bands)]
    zero = F.sum(F.forall("bands", lambda x: x == 0).cast("long")).alias("zeros")
    out = rows.groupBy("scene", "region_id").agg(F.count(F.lit(1)).alias("npix"), zero, *sums)
    ctr = F.array(*[F.col(f"_s{b}").cast("double") / F.col("npix").cast("double") for b in range(bands)])
    return out.withColumn("ctr", ctr).select("scene", "region_id", "npix", "zeros", "ctr")


def float_means(labels: DataFrame, layer: DataFrame, bands: int) -> DataFrame:
    """``scene, region_id, npix, zeros, ctr`` of single-precision layers.

    The sums depend on their order, which is by pixel (pairwise if there is one band), so a region's samples are
    added by one task, which passes many regions by as a stream; regions spread over tasks.
    """
    rows = labels.filter("region_id <> 0").join(layer.select("scene", "px", "bands"), ["scene", "px"]).select("scene", "region_id", "px", "bands")

    def mean(part: pa.Table) -> dict:
        x = np.asarray(part.column("bands").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float32).reshape(part.num_rows, bands)
        add = pairwise_sum32 if bands == 1 else ordered_sum32
        ctr = [float_mean(add(x[:, b]), len(x)) for b in range(bands)]
        return {"scene": part.column("scene")[0].as_py(), "region_id": part.column("region_id")[0].as_py(), "npix": len(x), "zeros": int((x == 0).all(axis=1).sum()), "ctr": ctr}

    arrow = pa.schema([("scene", pa.string()), ("region_id", pa.int64()), ("npix", pa.int64()), ("zeros", pa.int64()), ("ctr", pa.list_(pa.float64()))])
    return by_group(rows, ["scene", "region_id"], ["px"], mean, "scene string, region_id long, npix long, zeros long, ctr array<double>", arrow)


def mostly_nodata(means: DataFrame) -> DataFrame:
    """The regions of which more than half the pixels are zero in all bands."""
    return means.filter("2 * zeros > npix").select("scene", "region_id")


def drop_regions(labels: DataFrame, dropped: DataFrame) -> DataFrame:
    """``labels`` with the dropped regions' pixels set to 0."""
    gone = dropped.select("scene", "region_id", F.lit(True).alias("_gone"))
    return labels.join(gone, ["scene", "region_id"], "left").withColumn("region_id", F.when(F.col("_gone"), F.lit(0).cast("long")).otherwise(F.col("region_id"))).drop("_gone")


def edges_with_distance(rag: DataFrame, regions: DataFrame, kind: str = "double") -> DataFrame:
    """``rag`` with both ends' sizes and the squared distance of their centres, in ``kind`` throughout."""
    side = lambda s: regions.select("scene", F.col("region_id").alias(s), F.col("npix").alias(f"n_{s}"), F.col("ctr").alias(f"c_{s}"))
    both = rag.join(side("src"), ["scene", "src"]).join(side("dst"), ["scene", "dst"])
    return both.withColumn("d2", distance2_col("c_src", "c_dst", kind)).drop("c_src", "c_dst")


def nearest_by_id(edges: DataFrame) -> DataFrame:
    """``scene, region_id, nnbr_id, d2``: the nearest neighbour, of equals the smallest id."""
    best = edges.groupBy("scene", F.col("src").alias("region_id")).agg(F.min(F.struct("d2", "dst")).alias("m"))
    return best.select("scene", "region_id", F.col("m.dst").alias("nnbr_id"), F.col("m.d2").alias("d2"))


def nearest_near_ties(edges: DataFrame, rel: float) -> DataFrame:
    """As the second stage chooses: by ascending id, one nearly as near as the incumbent doesn't replace it."""
    lists = edges.groupBy("scene", F.col("src").alias("region_id")).agg(F.array_sort(F.collect_list(F.struct("dst", "d2"))).alias("c"))
    fold = f"aggregate(c, named_struct('dst', 0L, 'd2', double('infinity')), (s, x) -> if(not (x.d2 = s.d2 or (s.d2 < double('infinity') and x.d2 < double('infinity') and (abs(s.d2 - x.d2) <= {rel!r} * abs(s.d2) or abs(s.d2 - x.d2) <= {rel!r} * abs(x.d2)))) and x.d2 < s.d2, named_struct('dst', x.dst, 'd2', x.d2), s))"
    return lists.withColumn("m", F.expr(fold)).select("scene", "region_id", F.col("m.dst").alias("nnbr_id"), F.col("m.d2").alias("d2")).filter("nnbr_id <> 0")


def draws(edges: DataFrame) -> DataFrame:
    """``scene, region_id, n_draws, draw_offset``: coin flips each region takes, and how many come before its own.

    A candidate takes a flip if, in order of first contact, it equals the least distance before it; that number
    depends on the distances alone, so offsets are prefix sums and every region's choice is made independently.
    """
    run = edges.selectExpr("scene", "src", "d2", "min(d2) over (partition by scene, src order by first_key rows between unbounded preceding and 1 preceding) low")
    per = run.groupBy("scene", F.col("src").alias("region_id")).agg(F.sum((F.col("d2") == F.coalesce(F.col("low"), F.lit(-1).cast("float"))).cast("long")).alias("n_draws"))
    return exclusive_sum(per, "region_id", "n_draws", "draw_offset")


def nearest_with_flips(edges: DataFrame, flips: DataFrame | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``scene, region_id, nnbr_id, d2, n_draws``: nearest neighbours as the normal pass chooses them.

    ``flips(position, bit)`` is the stream from this pass's first flip on, of each scene if it has the column ``scene``;
    or it adds ``bit`` to rows with ``position``.  The winner is the last candidate at the least distance whose flip came
    up 1, else the first at it.
    """
    run = edges.selectExpr("scene", "src", "dst", "d2", "first_key", "min(d2) over (partition by scene, src order by first_key rows between unbounded preceding and 1 preceding) low")
    run = run.withColumn("drew", F.coalesce(F.col("d2") == F.col("low"), F.lit(False)).cast("long"))
    run = run.selectExpr("*", "sum(drew) over (partition by scene, src order by first_key rows between unbounded preceding and current row) nth", "min(d2) over (partition by scene, src) least")
    counts = run.groupBy("scene", F.col("src").alias("region_id")).agg(F.sum("drew").alias("n_draws"))
    offsets = exclusive_sum(counts, "region_id", "n_draws", "draw_offset").select("scene", F.col("region_id").alias("src"), "n_draws", "draw_offset")
    at = run.filter("d2 = least").join(offsets, ["scene", "src"]).withColumn("position", F.when(F.col("drew") == 1, F.col("draw_offset") + F.col("nth") - 1))
    tied = flips(at) if callable(flips) else at.join(flips, [c for c in ("scene", "position") if c in flips.columns], "left")
    heads = F.when(F.coalesce(F.col("bit"), F.lit(0)) == 1, F.struct("first_key", "dst"))
    best = tied.groupBy("scene", F.col("src").alias("region_id")).agg(F.max(heads).alias("last"), F.min(F.struct("first_key", "dst")).alias("first"), F.first("d2").alias("d2"), F.first("n_draws").alias("n_draws"))
    return best.select("scene", "region_id", F.coalesce("last.dst", "first.dst").alias("nnbr_id"), "d2", "n_draws")


def mutual(nn: DataFrame, epsilon: float = FLOAT_EPSILON) -> DataFrame:
    """``nn`` with ``nnbr_d2`` and ``mutual``: the partner's own least distance is the same (ids aren't compared)."""
    other = nn.select("scene", F.col("region_id").alias("nnbr_id"), F.col("d2").alias("nnbr_d2"))
    return nn.join(other, ["scene", "nnbr_id"]).withColumn("mutual", F.abs((F.col("nnbr_d2") - F.col("d2")).cast("double")) <= epsilon)


def histogram(nn: DataFrame, tolerance: float) -> DataFrame:
    """``scene, bin, n`` of single-precision nearest distances, in 1000 bins of tolerance**2 / 1000; bin 1000 is the rest."""
    width = f"cast(cast({tolerance!r} as float) * cast({tolerance!r} as float) / cast({BINS} as float) as float)"
    x = f"cast(d2 / {width} as float)"
    return nn.withColumn("bin", F.expr(f"case when d2 is null or {x} >= {BINS} then {BINS} else cast({x} as int) end")).groupBy("scene", "bin").agg(F.count(F.lit(1)).alias("n"))


def pass_tolerance(bins: DataFrame, tolerance: float, fraction: float) -> DataFrame:
    """``scene, tp2, use_hist``: the squared tolerance below which a fraction of a scene's regions may merge this pass."""
    t2 = f"cast(cast({tolerance!r} as float) * cast({tolerance!r} as float) as float)"
    width = f"cast({t2} / cast({BINS} as float) as float)"
    cum = bins.selectExpr("scene", "bin", "sum(n) over (partition by scene order by bin) c", "sum(n) over (partition by scene) total")
    most = f"cast(floor(cast(cast(total as float) * cast({fraction!r} as float) as float)) as long)"
    used = cum.groupBy("scene").agg((F.min(F.expr(f"case when c > {most} then bin end")) + 1).alias("used"))
    return used.select("scene", F.expr(f"case when coalesce(used, {BINS} + 1) > {BINS} then {t2} else cast({width} * cast(used as float) as float) end").alias("tp2"), F.expr(f"coalesce(used, {BINS} + 1) <= {BINS}").alias("use_hist"))


def is_special(band: int, low: float, high: float, ctr: str = "ctr") -> Column:
    """Whether a region's centre lies outside the normality interval, in single precision."""
    v = F.element_at(ctr, band + 1).cast("float")
    return (v < F.lit(low).cast("float")) | (v > F.lit(high).cast("float"))


def undersized(regions: DataFrame, absolute: int, normal: int) -> DataFrame:
    """The regions (with ``special``) below their floor: the absolute minimum if special, else the normal one."""
    return regions.filter(F.col("npix") < F.when(F.col("special"), F.lit(absolute)).otherwise(F.lit(normal)))


def claims(nn: DataFrame) -> DataFrame:
    """``scene, region_id, claim``: the distance at which a region is held in an auxiliary pass.

    ``nn`` has the undersized regions only: their own least distance counts, for others the least claim on them.
    """
    own = nn.select("scene", "region_id", F.col("d2").alias("own"))
    on = nn.groupBy("scene", F.col("nnbr_id").alias("region_id")).agg(F.min("d2").alias("on_it"))
    return own.join(on, ["scene", "region_id"], "full").select("scene", "region_id", F.coalesce("own", "on_it").alias("claim"))


def rejection(tp2: Column, viable: int, nmax: int) -> Column:
    """Why an edge may not merge in a normal pass, the first reason that holds; ``eligible`` if none does."""
    return (
        F.when(F.col("d2") > tp2, "nnbr_d2_big")
        .when(F.abs((F.col("nnbr_d2") - F.col("d2")).cast("double")) > FLOAT_EPSILON, "wrong_partner")
        .when((F.col("n_src") >= viable) & (F.col("n_dst") >= viable), "both_viable")
        .when(F.col("n_src") + F.col("n_dst") > nmax, "npix_big")
        .otherwise("eligible")
    )


def merged_centre_col(n1: str, c1: str, n2: str, c2: str, kind: str = "float") -> Column:
    """(n1 c1 + n2 c2) / (n1 + n2), every operation in ``kind``; sizes are added as integers first."""
    body = f"cast((cast({n1} as {kind}) * x + cast({n2} as {kind}) * y) / cast({n1} + {n2} as {kind}) as {kind})"
    return F.expr(f"zip_with({c1}, {c2}, (x, y) -> {body})")


def reranked(labels: DataFrame) -> DataFrame:
    """``labels`` with each scene's ids renumbered 1, 2, ... in their order; 0 stays."""
    ids = dense_ids(labels.filter("region_id <> 0"), "region_id").withColumnRenamed("id", "region_id")
    return labels.join(ids, ["scene", "region_id"], "left").withColumn("region_id", F.coalesce("new_id", F.lit(0).cast("long"))).drop("new_id")


def paste(previous: DataFrame, update: DataFrame) -> DataFrame:
    """``update`` over ``previous``: its ids, raised by the largest previous one, where it isn't 0."""
    top = previous.groupBy("scene").agg(F.max("region_id").alias("_top"))
    new = update.select("scene", "px", F.col("region_id").alias("_new"))
    both = previous.join(new, ["scene", "px"], "left").join(top, "scene")
    return both.withColumn("region_id", F.when(F.coalesce("_new", F.lit(0)) != 0, F.col("_new") + F.col("_top")).otherwise(F.col("region_id"))).drop("_new", "_top")


def row_runs(labels: DataFrame) -> DataFrame:
    """``scene, row, col, px, region_id, run``: maximal runs of one id along a row, named by their first pixel."""
    line = "over (partition by scene, row order by col)"
    starts = labels.filter("region_id <> 0").selectExpr("*", f"coalesce(lag(region_id) {line} <> region_id or lag(col) {line} <> col - 1, true) _new")
    return starts.withColumn("run", F.expr("max(case when _new then px end) over (partition by scene, row order by col)")).drop("_new")


def pieces(labels: DataFrame, components) -> DataFrame:  # noqa: ANN001
    """``labels`` with ``piece``: the first pixel of the 4-connected component of equal ids that a pixel is in.

    Runs along rows are the nodes, touching runs of neighbouring rows the edges, so uniform areas stay cheap.
    """
    runs = row_runs(labels)
    below = neighbours(runs, ["region_id", "run"]).filter("n_s.region_id = region_id")
    edges = below.select(F.struct("scene", "run").alias("a"), F.struct("scene", F.col("n_s.run").alias("run")).alias("b")).distinct()
    found = components(edges).select(F.col("id.scene").alias("scene"), F.col("id.run").alias("run"), F.col("component.run").alias("piece"))
    return runs.join(found, ["scene", "run"], "left").withColumn("piece", F.coalesce("piece", "run")).drop("run")


def combined(previous: DataFrame, update: DataFrame, components) -> DataFrame:  # noqa: ANN001
    """Paste, split into pieces, and number those by (pasted id, first pixel); pixels of 0 are left out."""
    cut = pieces(paste(previous, update), components)
    order = cut.groupBy("scene", "region_id", "piece").agg(F.min("px").alias("_first"))
    # two levels: pieces are numbered within an id, and ids by the pieces before them
    per = order.groupBy("scene", "region_id").agg(F.count(F.lit(1)).alias("_n"))
    before = exclusive_sum(per, "region_id", "_n", "_under").select("scene", "region_id", "_under")
    inside = order.withColumn("_at", F.expr("row_number() over (partition by scene, region_id order by _first)"))
    numbered = inside.join(before, ["scene", "region_id"]).select("scene", "piece", (F.col("_under") + F.col("_at")).cast("long").alias("new_id"))
    return cut.join(numbered, ["scene", "piece"]).select("scene", "row", "col", "px", F.col("new_id").alias("region_id"))


def boundary_edges(labels: DataFrame) -> DataFrame:
    """``scene, region_id, x0, y0, x1, y1``: pixel sides whose neighbour differs, directed with the region on the left."""
    near = neighbours(labels, ["region_id"])
    corner = {"n": (1, 0, 0, 0), "e": (1, 1, 1, 0), "s": (0, 1, 1, 1), "w": (0, 0, 0, 1)}
    sides = []
    for d, (x0, y0, x1, y1) in corner.items():
        at = F.struct((F.col("col") + x0).alias("x0"), (F.col("row") + y0).alias("y0"), (F.col("col") + x1).alias("x1"), (F.col("row") + y1).alias("y1"))
        sides.append(F.when(~F.col(f"n_{d}.region_id").eqNullSafe(F.col("region_id")), at))
    return near.select("scene", "region_id", F.explode(F.array_compact(F.array(*sides))).alias("e")).select("scene", "region_id", "e.*")


def id_width(count: Column) -> Column:
    """Bytes of an id on disk, by the bit width of the number of regions."""
    return F.when(count < 256, 1).when(count < 65536, 2).otherwise(4)
