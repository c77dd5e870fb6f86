"""Registered queries of the raster operators over the derived scene, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import graph, pixels, regions, vector
from . import passes, scene, strips

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_SCENE = """
scene AS (
  SELECT *, CASE WHEN lake THEN 0 ELSE 1 + 40 * ((r // 8 + c // 8) % 5) + u END AS b0,
    CASE WHEN lake THEN 0 ELSE 1 + 30 * ((r // 16 + 2 * (c // 16)) % 7) + v % 5 END AS b1,
    CASE WHEN c >= 90 THEN 0 ELSE 1 + 25 * ((r // 12 + c // 20) % 9) + v % 7 END AS s0,
    (1 + (r // 5) * 20 + c // 5)::BIGINT AS block, (r // 10 + c // 10) % 4 AS class0,
    (r // 10 + c // 10) % 4 + CASE WHEN r BETWEEN 3 AND 6 AND c BETWEEN 10 AND 19 THEN 10 ELSE 0 END AS class1,
    (r // 10 + c // 10) % 4 + CASE WHEN r BETWEEN 3 AND 6 AND c BETWEEN 20 AND 29 THEN 20 ELSE 0 END AS class2
  FROM (SELECT event_id AS px, (event_id // 100)::INT AS r, (event_id % 100)::INT AS c, (user_id % 4)::INT AS u, floor(value)::INT AS v,
      (event_id // 100) % 10 >= 8 AND event_id % 100 BETWEEN 40 AND 55 AS lake FROM events))"""

_RAG = """
steps(k, dr, dc) AS (VALUES (0, -1, 0), (1, 0, 1), (2, 1, 0), (3, 0, -1)),
rag AS (
  SELECT a.block AS src, b.block AS dst, min(a.px * 8 + k)::BIGINT AS first_key
  FROM scene a, steps, scene b WHERE b.r = a.r + dr AND b.c = a.c + dc AND a.block <> b.block GROUP BY ALL)"""

_MEANS = """
means AS (
  SELECT block AS id, count(*) AS n, sum(b0)::DOUBLE / count(*)::DOUBLE AS m0, sum(b1)::DOUBLE / count(*)::DOUBLE AS m1 FROM scene GROUP BY block)"""

_F32 = """
centres AS (SELECT id, n, m0::FLOAT AS f0, m1::FLOAT AS f1 FROM means),
dist AS (
  SELECT src, dst, first_key, a.n AS n_src, b.n AS n_dst, (a.f0 - b.f0) * (a.f0 - b.f0) + (a.f1 - b.f1) * (a.f1 - b.f1) AS d2
  FROM rag JOIN centres a ON a.id = src JOIN centres b ON b.id = dst),
nn AS (SELECT src AS id, min({'d': d2, 'i': dst}) AS m FROM dist GROUP BY src)"""

_COARSE = """
dist AS (
  SELECT src, dst, first_key, (floor(a.m0 / 40)::FLOAT - floor(b.m0 / 40)::FLOAT) * (floor(a.m0 / 40)::FLOAT - floor(b.m0 / 40)::FLOAT) AS d2
  FROM rag JOIN means a ON a.id = src JOIN means b ON b.id = dst)"""

#: Tolerance of the histogram queries, in the derived scene's units.
TOLERANCE, FRACTION = 60.0, 0.2


def query(sql: str | None = None, *parts: str, recursive: bool = False) -> Callable:
    """Register a function under its name, with its SQL below the named parts."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            head = "WITH RECURSIVE " if recursive else "WITH "
            ORACLE_SQL[f.__name__] = head + ",".join([_SCENE, *parts]) + ("," if sql.lstrip().startswith("+") else "\n") + sql.lstrip().removeprefix("+")
        return f

    return put


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene.blocks(scene.scene(spark, sf_dir))


def _layer(p: DataFrame, column: str = "layer") -> DataFrame:
    return p.select("scene", "row", "col", "px", F.col(column).alias("bands"))


def _regions(spark: SparkSession, sf_dir: str, kind: str = "double") -> DataFrame:
    p = scene.scene(spark, sf_dir)
    return regions.integer_means(scene.blocks(p), p, 2).withColumn("ctr", F.col("ctr").cast(f"array<{kind}>"))


def _edges(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return regions.edges_with_distance(regions.adjacency(_labels(spark, sf_dir)), _regions(spark, sf_dir, kind), kind)


def _coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres rounded down to steps of 40, so that equal distances are common."""
    rough = _regions(spark, sf_dir).withColumn("ctr", F.expr("array(cast(floor(ctr[0] / 40) as float))"))
    return regions.edges_with_distance(regions.adjacency(_labels(spark, sf_dir)), rough, "float")


@query("SELECT px, b0 = 0 AND b1 = 0 AS nodata FROM scene")
def nodata_mask_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene.scene(spark, sf_dir).select("px", pixels.is_nodata(0).alias("nodata"))


@query("SELECT px, b0 = 1 OR b1 = 1 AS nodata FROM scene")
def nodata_mask_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene.scene(spark, sf_dir).select("px", pixels.is_nodata(1, any_band=True).alias("nodata"))


@query("SELECT px, s0 <> 0 AND NOT (b0 = 0 AND b1 = 0) AS valid FROM scene")
def effective_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scene.scene(spark, sf_dir)
    return pixels.valid_mask(p, 0, mask=_layer(p)).select("px", "valid")


@query("""
+ lim AS (SELECT min(b0) FILTER (b0 <> 0) AS l0, max(b0) FILTER (b0 <> 0) AS h0, min(b1) FILTER (b1 <> 0) AS l1, max(b1) FILTER (b1 <> 0) AS h1 FROM scene)
SELECT px, CASE WHEN b0 = 0 THEN 0 ELSE trunc((b0::DOUBLE - l0::DOUBLE) / (h0::DOUBLE - l0::DOUBLE) * 254 + 1)::INT END AS n0,
  CASE WHEN b1 = 0 THEN 0 ELSE trunc((b1::DOUBLE - l1::DOUBLE) / (h1::DOUBLE - l1::DOUBLE) * 254 + 1)::INT END AS n1 FROM scene, lim""")
def normalize_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = pixels.normalized(scene.scene(spark, sf_dir), 0)
    return n.select("px", F.col("bands")[0].alias("n0"), F.col("bands")[1].alias("n1"))


@query("SELECT px, class0 <> class1 AS changed FROM scene")
def change_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scene.scene(spark, sf_dir)
    was, now = (p.select("scene", "row", "col", "px", F.array(f"class{t}").alias("bands")) for t in (0, 1))
    return pixels.changed(was, now).select("px", "changed")


@query("SELECT 0 AS band, min(b0) AS lo, max(b0) AS hi FROM scene UNION ALL SELECT 1, min(b1), max(b1) FROM scene")
def band_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.band_range(scene.scene(spark, sf_dir)).select("band", "lo", "hi")


_FLAGS = """
steps(k, dr, dc) AS (VALUES (0, -1, 0), (1, 0, 1), (2, 1, 0), (3, 0, -1)),
near AS (
  SELECT a.px, k, ((a.b0 - b.b0) * (a.b0 - b.b0) + (a.b1 - b.b1) * (a.b1 - b.b1))::BIGINT AS d2
  FROM scene a, steps, scene b WHERE b.r = a.r + dr AND b.c = a.c + dc AND NOT a.lake AND NOT b.lake),
best AS (SELECT px, min(d2) AS least FROM near GROUP BY px)"""


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.nearest_flags(scene.scene(spark, sf_dir).filter(~pixels.is_nodata(0)), 10.0)


@query("SELECT s.px, least AS d2, CASE WHEN least <= 100 THEN (SELECT string_agg(k, ',' ORDER BY k) FROM near n WHERE n.px = s.px AND n.d2 = least) END AS directions FROM scene s LEFT JOIN best USING (px) WHERE NOT lake", _FLAGS)
def pixel_nn_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _flags(spark, sf_dir)
    return f.select("px", "d2", F.when(F.size("directions") > 0, F.array_join(F.col("directions").cast("array<string>"), ",")).alias("directions"))


@query("""
+ flag AS (SELECT px, k FROM near JOIN best USING (px) WHERE d2 = least AND least <= 100)
SELECT a.px, a.k AS direction FROM flag a JOIN flag b ON (a.k = 1 AND b.k = 3 AND b.px = a.px + 1) OR (a.k = 2 AND b.k = 0 AND b.px = a.px + 100)""", _FLAGS)
def mutual_pixel_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.mutual_pairs(_flags(spark, sf_dir)).select("px", "direction")


@query("SELECT src, dst FROM rag", _RAG)
def region_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.adjacency(_labels(spark, sf_dir)).select("src", "dst")


@query("SELECT src, dst, first_key FROM rag", _RAG)
def region_first_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.adjacency(_labels(spark, sf_dir)).select("src", "dst", "first_key")


@query("SELECT block AS region_id, count(*) AS npix, min(c) AS ulx, min(r) AS uly, max(c) AS lrx, max(r) AS lry, min(px) AS first_px FROM scene GROUP BY block")
def region_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.stats(_labels(spark, sf_dir)).drop("scene")


@query("SELECT id AS region_id, n AS npix, m0, m1 FROM means", _MEANS)
def region_mean_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regions(spark, sf_dir).select("region_id", "npix", F.col("ctr")[0].alias("m0"), F.col("ctr")[1].alias("m1"))


@query("+ gone AS (SELECT block FROM scene GROUP BY block HAVING 2 * count(*) FILTER (s0 = 0) > count(*))\nSELECT px, CASE WHEN block IN (SELECT block FROM gone) THEN 0 ELSE block END AS region_id FROM scene")
def majority_nodata_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scene.scene(spark, sf_dir)
    gone = regions.mostly_nodata(regions.integer_means(scene.blocks(p), _layer(p), 1))
    return regions.drop_regions(scene.blocks(p), gone).select("px", "region_id")


@query("SELECT src, dst, d2::DOUBLE AS d2 FROM dist", _RAG, _MEANS, _F32)
def centroid_distance_f32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir, "float").select("src", "dst", F.col("d2").cast("double").alias("d2"))


@query("SELECT src, dst, (a.m0 - b.m0) * (a.m0 - b.m0) + (a.m1 - b.m1) * (a.m1 - b.m1) AS d2 FROM rag JOIN means a ON a.id = src JOIN means b ON b.id = dst", _RAG, _MEANS)
def centroid_distance_f64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir, "double").select("src", "dst", "d2")


@query("SELECT id AS region_id, m.i AS nnbr_id, m.d::DOUBLE AS d2 FROM nn", _RAG, _MEANS, _F32)
def nearest_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.nearest_by_id(_edges(spark, sf_dir, "float")).select("region_id", "nnbr_id", F.col("d2").cast("double").alias("d2"))


@query("SELECT a.id AS region_id, a.m.i AS nnbr_id, abs((b.m.d - a.m.d)::DOUBLE) <= 1.1920928955078125e-7 AS mutual FROM nn a JOIN nn b ON b.id = a.m.i", _RAG, _MEANS, _F32)
def mutual_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.mutual(regions.nearest_by_id(_edges(spark, sf_dir, "float"))).select("region_id", "nnbr_id", "mutual")


_BINS = """
bins AS (
  SELECT CASE WHEN x >= 1000 THEN 1000 ELSE floor(x)::INT END AS bin, count(*) AS n
  FROM (SELECT m.d / (60::FLOAT * 60::FLOAT / 1000::FLOAT) AS x FROM nn) GROUP BY 1)"""


@query("SELECT bin, n FROM bins", _RAG, _MEANS, _F32, _BINS)
def distance_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.histogram(regions.nearest_by_id(_edges(spark, sf_dir, "float")), TOLERANCE).drop("scene")


@query("""
+ cum AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS c, sum(n) OVER () AS total FROM bins),
used AS (SELECT coalesce(min(bin) + 1, 1001) AS k FROM cum WHERE c > floor(total::FLOAT * 0.2::FLOAT)::BIGINT)
SELECT (CASE WHEN k > 1000 THEN 3600::FLOAT ELSE (60::FLOAT * 60::FLOAT / 1000::FLOAT) * k::FLOAT END)::DOUBLE AS tp2, k <= 1000 AS use_hist FROM used""", _RAG, _MEANS, _F32, _BINS)
def pass_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = regions.histogram(regions.nearest_by_id(_edges(spark, sf_dir, "float")), TOLERANCE)
    return regions.pass_tolerance(bins, TOLERANCE, FRACTION).select(F.col("tp2").cast("double").alias("tp2"), "use_hist")


@query("""
+ run AS (SELECT src, d2, min(d2) OVER (PARTITION BY src ORDER BY first_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM dist),
per AS (SELECT src, count(*) FILTER (d2 = low) AS n FROM run GROUP BY src)
SELECT src AS region_id, n AS n_draws, coalesce(sum(n) OVER (ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS draw_offset FROM per""", _RAG, _MEANS, _COARSE)
def draw_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.draws(_coarse(spark, sf_dir)).select("region_id", "n_draws", "draw_offset")


@query("SELECT id AS region_id, f0 < 40::FLOAT OR f0 > 120::FLOAT AS special FROM centres", _RAG, _MEANS, _F32)
def special_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regions(spark, sf_dir, "float").select("region_id", regions.is_special(0, 40.0, 120.0).alias("special"))


@query("+ z AS (SELECT block AS id, count(*) AS n, avg(s0) < 50 AS special FROM scene WHERE s0 <> 0 AND NOT lake GROUP BY block)\nSELECT id AS region_id, n AS npix FROM z WHERE n < CASE WHEN special THEN 10 ELSE 25 END")
def undersized_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scene.scene(spark, sf_dir).filter("layer[0] <> 0").filter(~pixels.is_nodata(0))
    sized = regions.integer_means(scene.blocks(p), _layer(p), 1).withColumn("special", F.col("ctr")[0] < 50)
    return regions.undersized(sized, 10, 25).select("region_id", "npix")


@query("""
+ e AS (SELECT a.id, a.m.i AS j, a.m.d AS d, b.m.d AS dj, x.n AS n, y.n AS nj FROM nn a JOIN nn b ON b.id = a.m.i JOIN means x ON x.id = a.id JOIN means y ON y.id = a.m.i)
SELECT CASE WHEN d > 900::FLOAT THEN 'nnbr_d2_big' WHEN abs((dj - d)::DOUBLE) > 1.1920928955078125e-7 THEN 'wrong_partner'
  WHEN n >= 30 AND nj >= 30 THEN 'both_viable' WHEN n + nj > 40 THEN 'npix_big' ELSE 'eligible' END AS reason, count(*) AS n FROM e GROUP BY 1""", _RAG, _MEANS, _F32)
def merge_rejections_pass1(spark: SparkSession, sf_dir: str) -> DataFrame:
    nn = regions.mutual(regions.nearest_by_id(_edges(spark, sf_dir, "float")))
    size = _regions(spark, sf_dir).select("scene", "region_id", "npix")
    e = nn.join(size.withColumnRenamed("npix", "n_src"), ["scene", "region_id"]).join(size.withColumnsRenamed({"region_id": "nnbr_id", "npix": "n_dst"}), ["scene", "nnbr_id"])
    return e.groupBy(regions.rejection(F.lit(900.0).cast("float"), 30, 40).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT a.id AS region_id, a.n + b.n AS npix, ((a.n::FLOAT * a.f0 + b.n::FLOAT * b.f0) / (a.n + b.n)::FLOAT)::DOUBLE AS m0,
  ((a.n::FLOAT * a.f1 + b.n::FLOAT * b.f1) / (a.n + b.n)::FLOAT)::DOUBLE AS m1
FROM centres a JOIN centres b ON b.id = a.id + 1 WHERE a.id % 2 = 1""", _RAG, _MEANS, _F32)
def centroid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each odd block merged with the next one."""
    r = _regions(spark, sf_dir, "float")
    other = r.select("scene", (F.col("region_id") - 1).alias("region_id"), F.col("npix").alias("n2"), F.col("ctr").alias("c2"))
    both = r.filter("region_id % 2 = 1").join(other, ["scene", "region_id"]).withColumn("c", regions.merged_centre_col("npix", "ctr", "n2", "c2"))
    return both.select("region_id", (F.col("npix") + F.col("n2")).alias("npix"), F.col("c")[0].cast("double").alias("m0"), F.col("c")[1].cast("double").alias("m1"))


@query("SELECT px, CASE WHEN s0 = 0 THEN 0 ELSE dense_rank() OVER (ORDER BY s0 = 0, block * 7) END AS region_id FROM scene")
def dense_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    sparse = scene.scene(spark, sf_dir).selectExpr("scene", "row", "col", "px", "if(layer[0] = 0, 0L, block_id * 7) region_id")
    return regions.reranked(sparse).select("px", "region_id")


@query("+ top AS (SELECT max(block) AS t FROM scene)\nSELECT px, CASE WHEN class0 <> class1 THEN t + 1 + c // 5 ELSE block END AS region_id FROM scene, top")
def paste_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scene.scene(spark, sf_dir)
    update = p.selectExpr("scene", "px", "if(class0 <> class1, cast(1 + col div 5 as long), 0L) region_id")
    return regions.paste(scene.blocks(p), update).select("px", "region_id")


_SIDES = """
sides(dr, dc, x0, y0, x1, y1) AS (VALUES (-1, 0, 1, 0, 0, 0), (0, 1, 1, 1, 1, 0), (1, 0, 0, 1, 1, 1), (0, -1, 0, 0, 0, 1)),
edges AS (
  SELECT a.block AS region_id, a.c + x0 AS x0, a.r + y0 AS y0, a.c + x1 AS x1, a.r + y1 AS y1
  FROM scene a CROSS JOIN sides LEFT JOIN scene b ON b.r = a.r + dr AND b.c = a.c + dc WHERE b.block IS DISTINCT FROM a.block)"""


@query("SELECT * FROM edges", _SIDES)
def boundary_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.boundary_edges(_labels(spark, sf_dir)).drop("scene")


@query("SELECT region_id, count(*) AS perimeter FROM edges GROUP BY region_id", _SIDES)
def region_perimeter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.boundary_edges(_labels(spark, sf_dir)).groupBy("region_id").agg(F.count(F.lit(1)).alias("perimeter"))


#: A north-up grid of 30 m cells, as an affine transform.
AFFINE = (462405.0, 30.0, 0.0, 1741815.0, 0.0, -30.0)


@query("SELECT block AS region_id, count(*) * 900.0::DOUBLE AS area FROM scene GROUP BY block")
def region_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.stats(_labels(spark, sf_dir)).select("region_id", (F.col("npix") * F.lit(geo.pixel_area(AFFINE))).alias("area"))


@query("SELECT block AS region_id, 462405.0::DOUBLE + 30 * min(c) AS minx, 462405.0::DOUBLE + 30 * (max(c) + 1) AS maxx, 1741815.0::DOUBLE - 30 * (max(r) + 1) AS miny, 1741815.0::DOUBLE - 30 * min(r) AS maxy FROM scene GROUP BY block")
def region_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = regions.stats(_labels(spark, sf_dir))
    x0, y0 = geo.apply_col(AFFINE, F.col("ulx"), F.col("uly"))
    x1, y1 = geo.apply_col(AFFINE, F.col("lrx") + 1, F.col("lry") + 1)
    return s.select("region_id", F.least(x0, x1).alias("minx"), F.greatest(x0, x1).alias("maxx"), F.least(y0, y1).alias("miny"), F.greatest(y0, y1).alias("maxy"))


@query("SELECT block AS region_id, count(*) AS n_pixels FROM scene WHERE NOT lake GROUP BY block ORDER BY n_pixels DESC, region_id LIMIT 10")
def top_k_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    land = scene.blocks(scene.scene(spark, sf_dir).filter(~pixels.is_nodata(0)))
    return land.groupBy("region_id").agg(F.count(F.lit(1)).alias("n_pixels")).orderBy(F.desc("n_pixels"), "region_id").limit(10)


@query("SELECT 1 AS step, count(*) FILTER (class0 <> class1) AS changed FROM scene UNION ALL SELECT 2, count(*) FILTER (class1 <> class2) FROM scene")
def series_changed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scene.scene(spark, sf_dir)
    steps = p.select("px", F.explode(F.expr("array(named_struct('step', 0, 'c', class0), named_struct('step', 1, 'c', class1), named_struct('step', 2, 'c', class2))")).alias("s")).select("px", "s.*")
    moved = steps.selectExpr("step", "c <> lag(c) over (partition by px order by step) moved")
    return moved.filter("step > 0").groupBy("step").agg(F.sum(F.col("moved").cast("long")).alias("changed"))


@query("SELECT count(DISTINCT block) AS n, CASE WHEN count(DISTINCT block) < 256 THEN 1 WHEN count(DISTINCT block) < 65536 THEN 2 ELSE 4 END AS width FROM scene")
def map_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _labels(spark, sf_dir).filter("region_id <> 0").agg(F.countDistinct("region_id").alias("n"))
    return n.select("n", regions.id_width(F.col("n")).alias("width"))


@query("SELECT count(DISTINCT block) AS nreg, count(*) AS npix, count(DISTINCT block) > 0.98 * count(*) AS mostly_unmerged FROM scene")
def unmerged_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _labels(spark, sf_dir).agg(F.countDistinct("region_id").alias("nreg"), F.count(F.lit(1)).alias("npix"))
    return n.withColumn("mostly_unmerged", F.col("nreg") > 0.98 * F.col("npix"))


@query("""
+ reach(px, r, c, k, y) AS (
  SELECT px, r, c, class0, px FROM scene
  UNION SELECT s.px, s.r, s.c, s.class0, reach.y FROM reach JOIN scene s ON abs(s.r - reach.r) + abs(s.c - reach.c) = 1 AND s.px IN (reach.px - 1, reach.px + 1, reach.px - 100, reach.px + 100) AND s.class0 = reach.k)
SELECT px, min(y) AS piece FROM reach GROUP BY px""", recursive=True)
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scene.scene(spark, sf_dir).selectExpr("scene", "row", "col", "px", "cast(class0 + 1 as long) region_id")
    return regions.pieces(p, graph.components).select("px", "piece")


@query("""
+ keyed AS (SELECT px, r, c, CASE WHEN class0 <> class1 THEN 5 ELSE class0 + 1 END AS k FROM scene),
reach(px, r, c, k, y) AS (
  SELECT px, r, c, k, px FROM keyed
  UNION SELECT s.px, s.r, s.c, s.k, reach.y FROM reach JOIN keyed s ON abs(s.r - reach.r) + abs(s.c - reach.c) = 1 AND s.px IN (reach.px - 1, reach.px + 1, reach.px - 100, reach.px + 100) AND s.k = reach.k),
piece AS (SELECT px, k, min(y) AS first FROM reach GROUP BY px, k)
SELECT px, dense_rank() OVER (ORDER BY k, first) AS region_id FROM piece""", recursive=True)
def combine_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scene.scene(spark, sf_dir)
    previous = p.selectExpr("scene", "row", "col", "px", "cast(class0 + 1 as long) region_id")
    update = p.selectExpr("scene", "px", "if(class0 <> class1, 1L, 0L) region_id")
    return regions.combined(previous, update, graph.components).select("px", "region_id")


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.valid_mask(scene.scene(spark, sf_dir), 0)


@query()
def segment_one_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene.segment(_masked(spark, sf_dir), scene.CONFIG, "normal")


@query()
def aux_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene.segment(_masked(spark, sf_dir), scene.CONFIG)


@query()
def segment_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal passes over strips of the scene while the graph is larger than a task; the same map as ``segment_one_image``."""
    return strips.segment(_masked(spark, sf_dir), scene.CONFIG, task_edges=passes.TASK_EDGES)


@query()
def absorbed_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene.absorbed_mask(_masked(spark, sf_dir), scene.CONFIG)


@query()
def segment_two_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene.segment_two(_masked(spark, sf_dir), scene.CONFIG, scene.STAGE2)


@query()
def segment_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps, the class layers giving what changed; all step maps."""
    p = _masked(spark, sf_dir)
    classes = [p.select("scene", "row", "col", "px", F.array(f"class{t}").alias("bands")) for t in range(3)]
    change = [None, *[pixels.changed(a, b) for a, b in zip(classes, classes[1:])]]
    maps = scene.segment_series([(p, _layer(p), c) for c in change], scene.CONFIG, scene.STAGE2)
    out = maps[0].withColumn("step", F.lit(1))
    for t, m in enumerate(maps[1:], 2):
        out = out.unionByName(m.withColumn("step", F.lit(t)))
    return out


@query()
def pass_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene.pass_stats(_masked(spark, sf_dir), scene.CONFIG, scene.STAGE2)


@query()
def polygonize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scene, region_id, npix, parts, rings, wkb`` of every block."""
    return vector.polygons(_labels(spark, sf_dir), AFFINE).drop("geometry")


@query()
def segment_top_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: segment the scene and list its three largest regions."""
    labels = scene.segment(_masked(spark, sf_dir), scene.CONFIG).filter("region_id <> 0")
    return labels.groupBy("region_id").agg(F.count(F.lit(1)).alias("n_pixels")).orderBy(F.desc("n_pixels"), "region_id").limit(3)
