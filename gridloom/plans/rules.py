"""Registered queries of single passes and scalar rules over the derived scene, with SQL that states each rule from scratch.

The SQL walks candidates, claims, matchings, pixel pairs and coin flips one at a time, where the operators use closed forms.
Land is what has samples in image and layer; blocks there have sizes of 1 to 25 pixels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SegConfig, Stage2Config
from ..functions import geo
from ..functions.numeric import TIE, is_close_col
from ..functions.rng import Flips
from ..operators import pixels, regions, vector
from ..sources import provenance
from . import passes, scene
from .catalog import _COARSE, _FLAGS, _MEANS, _RAG, AFFINE, _coarse, _masked, _regions, query

AUX = SegConfig((1.0,), 1.0, (10, 25, 25, 45, 45), norm_band=0, norm_low=40.0, norm_high=120.0)
STAGE2 = Stage2Config(25, 45)

_LAND = """
steps(k, dr, dc) AS (VALUES (0, -1, 0), (1, 0, 1), (2, 1, 0), (3, 0, -1)),
land AS MATERIALIZED (SELECT * FROM scene WHERE s0 <> 0 AND NOT lake),
lrag AS MATERIALIZED (
  SELECT a.block AS src, b.block AS dst, min(a.px * 8 + k)::BIGINT AS first_key
  FROM land a, steps, land b WHERE b.r = a.r + dr AND b.c = a.c + dc AND a.block <> b.block GROUP BY ALL),
sized AS MATERIALIZED (
  SELECT block AS id, count(*) AS n, sum(b0)::DOUBLE / count(*)::DOUBLE AS m0, sum(b1)::DOUBLE / count(*)::DOUBLE AS m1, min(px) AS first_px
  FROM land GROUP BY block),
f32 AS (SELECT id, n, m0::FLOAT AS f0, m1::FLOAT AS f1, n < CASE WHEN m0::FLOAT < 40 OR m0::FLOAT > 120 THEN 10 ELSE 25 END AS small FROM sized),
near32 AS MATERIALIZED (
  SELECT src AS id, min({'d': (a.f0 - b.f0) * (a.f0 - b.f0) + (a.f1 - b.f1) * (a.f1 - b.f1), 'i': dst}) AS m, any_value(a.n) AS n, any_value(a.small) AS small
  FROM lrag JOIN f32 a ON a.id = src JOIN f32 b ON b.id = dst GROUP BY src)"""

_CLAIMS = """
own AS (SELECT id, m.d AS d, m.i AS j, n FROM near32 WHERE small),
held AS (SELECT j AS id, min(d) AS d FROM own GROUP BY 1),
claims AS (SELECT coalesce(own.id, held.id) AS id, coalesce(own.d, held.d) AS d FROM own FULL JOIN held USING (id))"""

#: The first matching of edges ``ok(k, a, b)`` in order of k: one edge a step, ``taken`` holding the regions of those taken.
_WALK = """
walk(k, taken, a, b, hit) AS (
  SELECT 0::BIGINT, []::BIGINT[], 0::BIGINT, 0::BIGINT, false
  UNION ALL
  SELECT k, CASE WHEN free THEN list_concat(taken, [a, b]) ELSE taken END, a, b, free
  FROM (SELECT ok.k, ok.a, ok.b, w.taken, NOT list_contains(w.taken, ok.a) AND NOT list_contains(w.taken, ok.b) AS free FROM walk w JOIN ok ON ok.k = w.k + 1))"""

_NEAR64 = """
cand AS MATERIALIZED (
  SELECT src, dst, (a.m0 - b.m0) * (a.m0 - b.m0) + (a.m1 - b.m1) * (a.m1 - b.m1) AS d2, row_number() OVER (PARTITION BY src ORDER BY dst) AS k
  FROM lrag JOIN sized a ON a.id = src JOIN sized b ON b.id = dst WHERE a.n < 25),
fold(src, k, dst, d2) AS (
  SELECT src, k, dst, d2 FROM cand WHERE k = 1
  UNION ALL
  SELECT c.src, c.k, CASE WHEN less THEN c.dst ELSE c.old END, CASE WHEN less THEN c.d2 ELSE c.low END
  FROM (SELECT x.*, f.dst AS old, f.d2 AS low,
      x.d2 < f.d2 AND NOT (abs(f.d2 - x.d2) <= 1e-6 * abs(f.d2) OR abs(f.d2 - x.d2) <= 1e-6 * abs(x.d2)) AS less
    FROM fold f JOIN cand x ON x.src = f.src AND x.k = f.k + 1) c),
near64 AS (SELECT src AS id, arg_max(dst, k) AS j, arg_max(d2, k) AS d FROM fold GROUP BY src)"""

_HELD = """
place AS (SELECT id, row_number() OVER (ORDER BY id) AS pos FROM sized),
turn AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY first_px) AS t, p.pos AS i, q.pos AS j, d
  FROM near64 JOIN sized USING (id) JOIN place p USING (id) JOIN place q ON q.id = j),
claim(t, who, dist) AS (
  SELECT 0::BIGINT, list_transform(range(count(*)), lambda x: 0::BIGINT), list_transform(range(count(*)), lambda x: 'infinity'::DOUBLE) FROM sized
  UNION ALL
  SELECT n.t, list_transform(c.who, lambda x, k: CASE WHEN k = n.i THEN n.j WHEN k = n.j AND n.d < c.dist[n.j] THEN n.i ELSE x END),
    list_transform(c.dist, lambda x, k: CASE WHEN k = n.i THEN n.d WHEN k = n.j AND n.d < x THEN n.d ELSE x END)
  FROM claim c JOIN turn n ON n.t = c.t + 1),
last AS (SELECT who, dist FROM claim ORDER BY t DESC LIMIT 1),
held AS (
  SELECT p.id, q.id AS j, d FROM (SELECT unnest(range(1, len(who) + 1)) AS pos, unnest(who) AS w, unnest(dist) AS d FROM last) JOIN place p USING (pos) JOIN place q ON q.pos = w)"""


def _land(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = scene.scene(spark, sf_dir).filter("layer[0] <> 0").filter(~pixels.is_nodata(0))
    return scene.blocks(p), p


def _land32(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions of the land with centres in single precision, and their graph."""
    labels, p = _land(spark, sf_dir)
    return regions.integer_means(labels, p, 2).withColumn("ctr", F.col("ctr").cast("array<float>")), regions.adjacency(labels)


def _pairs(won: DataFrame, kept: str = "least(src, dst)", other: str = "greatest(src, dst)") -> DataFrame:
    return won.selectExpr(f"{kept} region_id", f"{other} other")


@query("SELECT id AS region_id, d::DOUBLE AS claim FROM claims", _LAND, _CLAIMS)
def claims_aux(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At what distance each region is held, the undersized regions of the land claiming their nearest neighbours."""
    table, rag = _land32(spark, sf_dir)
    _, edges = passes.auxiliary_edges(table, rag, AUX)
    return regions.claims(regions.nearest_by_id(edges)).select("region_id", F.col("claim").cast("double").alias("claim"))


@query(f"""
+ ok AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY o.id) AS k, o.id AS a, o.j AS b
  FROM own o JOIN claims c ON c.id = o.j JOIN f32 y ON y.id = o.j
  WHERE abs((c.d - o.d)::DOUBLE) <= 1.1920928955078125e-7 AND o.n + y.n <= 45),{_WALK}
SELECT least(a, b) AS region_id, greatest(a, b) AS other FROM walk WHERE hit""", _LAND, _CLAIMS, recursive=True)
def aux_pass_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one auxiliary pass merges on the land, ties between neighbours going to the smaller id."""
    table, rag = _land32(spark, sf_dir)
    small, edges = passes.auxiliary_edges(table, rag, AUX)
    nn = regions.nearest_by_id(edges)
    return _pairs(passes._matched(passes.auxiliary_eligible(nn, small, table, AUX.resolved[4])))


@query(f"""
+ ok AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY x.id) AS k, x.id AS a, y.id AS b FROM near32 x JOIN near32 y ON y.id = x.m.i
  WHERE x.m.d <= 900::FLOAT AND abs((y.m.d - x.m.d)::DOUBLE) <= 1.1920928955078125e-7 AND NOT (x.n >= 20 AND y.n >= 20) AND x.n + y.n <= 45),{_WALK}
SELECT least(a, b) AS region_id, greatest(a, b) AS other FROM walk WHERE hit""", _LAND, recursive=True)
def normal_pass_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one normal pass merges on the land, ties between neighbours going to the smaller id."""
    table, rag = _land32(spark, sf_dir)
    nn = regions.mutual(regions.nearest_by_id(regions.edges_with_distance(rag, table, "float")))
    return _pairs(passes._matched(passes._ends(nn, table).filter(regions.rejection(F.lit(900.0).cast("float"), 20, 45) == "eligible")))


def _stage2(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    labels, p = _land(spark, sf_dir)
    return passes.stage2_table(labels, p, 2), regions.adjacency(labels)


@query("SELECT id AS region_id, n AS npix, m0, m1, first_px FROM sized", _LAND)
def stage2_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, _ = _stage2(spark, sf_dir)
    return table.select("region_id", "npix", F.col("ctr")[0].alias("m0"), F.col("ctr")[1].alias("m1"), F.col("prio").alias("first_px"))


def _nearest64(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    table, rag = _stage2(spark, sf_dir)
    small = table.filter(F.col("npix") < STAGE2.nmin).select("scene", F.col("region_id").alias("src"))
    return regions.nearest_near_ties(regions.edges_with_distance(rag.join(small, ["scene", "src"], "left_semi"), table, "double"), TIE), table, rag


@query("SELECT id AS region_id, j AS nnbr_id, d AS d2 FROM near64", _LAND, _NEAR64, recursive=True)
def stage2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest64(spark, sf_dir)[0].select("region_id", "nnbr_id", "d2")


@query("SELECT id AS region_id, j AS nnbr_id, d AS d2 FROM held", _LAND, _NEAR64, _HELD, recursive=True)
def stage2_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    nn, table, _ = _nearest64(spark, sf_dir)
    return passes.stage2_claims(nn, table).select("region_id", "nnbr_id", "d2")


@query(f"""
+ ok AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY x.first_px) AS k, h.id AS a, h.j AS b
  FROM held h JOIN held g ON g.id = h.j JOIN sized x ON x.id = h.id JOIN sized y ON y.id = h.j
  WHERE x.n < 25 AND h.d < 'infinity'::DOUBLE AND x.n + y.n <= 45
    AND (h.d = g.d OR (g.d < 'infinity'::DOUBLE AND (abs(g.d - h.d) <= abs(1e-9 * g.d) OR abs(g.d - h.d) <= abs(1e-9 * h.d))))),{_WALK}
SELECT a AS region_id, b AS other FROM walk WHERE hit""", _LAND, _NEAR64, _HELD, recursive=True)
def stage2_pass_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one second-stage pass merges on the land; ``other`` becomes part of ``region_id``."""
    table, rag = _stage2(spark, sf_dir)
    return _pairs(passes._matched(passes.stage2_eligible(table, rag, STAGE2), "prio"), "src", "dst")


#: Pixel pairs one by one in raster order: direction 1 is east, 2 south; the search begins after the last direction and never tries it.
_PAIRED = """
flag AS (SELECT px, k FROM near JOIN best USING (px) WHERE d2 = least AND least <= 100),
opts AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY a.px) AS k, a.px, bool_or(a.k = 1) AS e, bool_or(a.k = 2) AS s
  FROM flag a JOIN flag b ON (a.k = 1 AND b.k = 3 AND b.px = a.px + 1) OR (a.k = 2 AND b.k = 0 AND b.px = a.px + 100) GROUP BY a.px),
pair(k, last, claimed, px, partner) AS (
  SELECT 0::BIGINT, 0, []::BIGINT[], -1::BIGINT, NULL::BIGINT
  UNION ALL
  SELECT k, coalesce(d, last), CASE WHEN d IS NULL THEN list_filter(claimed, lambda x: x > px) ELSE list_append(list_filter(claimed, lambda x: x > px), px + CASE d WHEN 1 THEN 1 ELSE 100 END) END,
    px, CASE d WHEN 1 THEN px + 1 WHEN 2 THEN px + 100 END
  FROM (SELECT k, last, claimed, px, CASE WHEN list_contains(claimed, px) OR least(oe, os) = 9 THEN NULL WHEN oe < os THEN 1 ELSE 2 END AS d
    FROM (SELECT o.k, p.last, p.claimed, o.px,
        CASE WHEN o.e AND p.last <> 1 AND NOT list_contains(p.claimed, o.px + 1) THEN (5 - p.last) % 4 ELSE 9 END AS oe,
        CASE WHEN o.s AND p.last <> 2 AND NOT list_contains(p.claimed, o.px + 100) THEN (6 - p.last) % 4 ELSE 9 END AS os
      FROM pair p JOIN opts o ON o.k = p.k + 1))),
tails AS (SELECT px AS head, partner AS px FROM pair WHERE partner IS NOT NULL),
heads AS (SELECT px, row_number() OVER (ORDER BY px) AS id FROM scene WHERE NOT lake AND px NOT IN (SELECT px FROM tails)),
begun AS (SELECT px, id FROM heads UNION ALL SELECT t.px, h.id FROM tails t JOIN heads h ON h.px = t.head)"""


@query("SELECT s.px, coalesce(id, 0) AS region_id FROM scene s LEFT JOIN begun USING (px)", _FLAGS, _PAIRED, recursive=True)
def initial_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passes.initial_labels(_masked(spark, sf_dir), scene.CONFIG).select("px", "region_id")


@query("""
SELECT id AS region_id, count(*) AS npix,
  (CASE count(*) WHEN 1 THEN any_value(b0)::FLOAT ELSE (arg_min(b0, px)::FLOAT + arg_max(b0, px)::FLOAT) / 2::FLOAT END)::DOUBLE AS m0,
  (CASE count(*) WHEN 1 THEN any_value(b1)::FLOAT ELSE (arg_min(b1, px)::FLOAT + arg_max(b1, px)::FLOAT) / 2::FLOAT END)::DOUBLE AS m1
FROM begun JOIN scene USING (px) GROUP BY id""", _FLAGS, _PAIRED, recursive=True)
def initial_region_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _masked(spark, sf_dir)
    table = passes.initial_table(passes.initial_labels(p, scene.CONFIG), p, 2)
    return table.select("region_id", "npix", F.col("ctr")[0].cast("double").alias("m0"), F.col("ctr")[1].cast("double").alias("m1"))


#: The generator: 31 seeds, then x[n] = x[n - 3] + x[n - 31]; outputs begin at n = 344, less their low bit.
_RANDOM = """
seed(i, v) AS (SELECT 0, 1::BIGINT UNION ALL SELECT i + 1, 16807 * v % 2147483647 FROM seed WHERE i < 30),
begin AS (SELECT list_concat(list(v ORDER BY i) FILTER (i >= 3), list(v ORDER BY i) FILTER (i < 3)) AS l FROM seed),
gen(n, l) AS (
  SELECT 33, l FROM begin
  UNION ALL SELECT n + 1, list_append(l[2:], (l[29] + l[1]) % 4294967296) FROM gen WHERE n < 343 + {}),
output AS (SELECT n - 344 AS position, l[31] // 2 AS value FROM gen WHERE n >= 344)"""


@query("SELECT position::BIGINT AS position, value FROM output", _RANDOM.format(1000), recursive=True)
def random_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = Flips().values(1000)
    return spark.createDataFrame([(k, int(v)) for k, v in enumerate(values)], "position long, value long")


@query(f"""
+ ranked AS MATERIALIZED (SELECT src, dst, d2, row_number() OVER (PARTITION BY src ORDER BY first_key) AS k, min(d2) OVER (PARTITION BY src ORDER BY first_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM dist),
per AS (SELECT src, count(*) FILTER (d2 = low) AS n FROM ranked GROUP BY src),
first AS MATERIALIZED (SELECT src, coalesce(sum(n) OVER (ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM per),{_RANDOM.format("(SELECT sum(n) FROM per)")},
fold(src, k, dst, d2, drawn) AS (
  SELECT src, k, dst, d2, 0 FROM ranked WHERE k = 1
  UNION ALL
  SELECT c.src, c.k, CASE WHEN c.d2 < f.d2 OR (c.d2 = f.d2 AND o.value % 2 = 1) THEN c.dst ELSE f.dst END, least(c.d2, f.d2), f.drawn + CASE WHEN c.d2 = f.d2 THEN 1 ELSE 0 END
  FROM fold f JOIN ranked c ON c.src = f.src AND c.k = f.k + 1 JOIN first ON first.src = f.src LEFT JOIN output o ON o.position = first.at + f.drawn)
SELECT src AS region_id, arg_max(dst, k) AS nnbr_id, arg_max(d2, k)::DOUBLE AS d2, max(drawn)::BIGINT AS n_draws FROM fold GROUP BY src""", _RAG, _MEANS, _COARSE, recursive=True)
def nearest_with_coins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest neighbours where equal distances are common: each tie takes the next coin flip of its region's stretch."""
    nn = passes._nearest(_coarse(spark, sf_dir), Flips())
    return nn.select("region_id", "nnbr_id", F.col("d2").cast("double").alias("d2"), "n_draws")


@query("SELECT src, dst, first_key FROM rag", """
steps(k, dr, dc) AS (VALUES (0, -1, 0), (1, -1, 1), (2, 0, 1), (3, 1, 1), (4, 1, 0), (5, 1, -1), (6, 0, -1), (7, -1, -1)),
rag AS (
  SELECT a.block AS src, b.block AS dst, min(a.px * 8 + k)::BIGINT AS first_key
  FROM scene a, steps, scene b WHERE b.r = a.r + dr AND b.c = a.c + dc AND a.block <> b.block GROUP BY ALL)""")
def region_adjacency_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.adjacency(scene.blocks(scene.scene(spark, sf_dir)), eight_way=True).select("src", "dst", "first_key")


@query("SELECT src AS region_id, list_aggregate(list_sort(list(DISTINCT dst)), 'string_agg', ',') AS candidates FROM rag GROUP BY src", _RAG)
def sorted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = pixels.neighbours(scene.blocks(scene.scene(spark, sf_dir)), ["region_id"])
    sides = near.select("scene", "region_id", F.explode(F.array(*[F.col(f"n_{d}.region_id") for d in pixels.FOUR])).alias("dst")).filter("dst is not null and dst <> region_id")
    lists = sides.groupBy("scene", "region_id").agg(F.array_sort(F.collect_set("dst")).alias("c"))
    return lists.select("region_id", F.array_join(F.col("c").cast("array<string>"), ",").alias("candidates"))


@query("""
SELECT a.id AS region_id, a.n + b.n AS npix, (a.n::DOUBLE * a.m0 + b.n::DOUBLE * b.m0) / (a.n + b.n)::DOUBLE AS m0,
  (a.n::DOUBLE * a.m1 + b.n::DOUBLE * b.m1) / (a.n + b.n)::DOUBLE AS m1
FROM means a JOIN means b ON b.id = a.id + 1 WHERE a.id % 2 = 1""", _MEANS)
def centroid_merge_f64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each odd block merged with the next one, in double precision."""
    r = _regions(spark, sf_dir)
    other = r.select("scene", (F.col("region_id") - 1).alias("region_id"), F.col("npix").alias("n2"), F.col("ctr").alias("c2"))
    both = r.filter("region_id % 2 = 1").join(other, ["scene", "region_id"]).withColumn("c", regions.merged_centre_col("npix", "ctr", "n2", "c2", "double"))
    return both.select("region_id", (F.col("npix") + F.col("n2")).alias("npix"), F.col("c")[0].alias("m0"), F.col("c")[1].alias("m1"))


@query("""
+ reach(px, r, c, block, y) AS (
  SELECT px, r, c, block, px FROM land
  UNION SELECT s.px, s.r, s.c, s.block, reach.y FROM reach JOIN land s ON s.block = reach.block AND abs(s.r - reach.r) + abs(s.c - reach.c) = 1),
piece AS (SELECT px, block, min(y) AS first FROM reach GROUP BY px, block)
SELECT block AS region_id, count(*) AS npix, count(*) * 900.0::DOUBLE AS area, count(DISTINCT first)::INT AS parts, count(DISTINCT first)::INT AS rings FROM piece GROUP BY block""", _LAND, recursive=True)
def polygon_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area and parts of the land's blocks as polygons; no block goes around another, so there are no holes."""
    return vector.polygons(_land(spark, sf_dir)[0], AFFINE).select("region_id", "npix", "area", "parts", "rings").orderBy("region_id")


_TEXTS = """
texts AS (SELECT px, CASE px % 8 WHEN 0 THEN 'plain' || px WHEN 1 THEN 'b ' || px WHEN 2 THEN 'it''s' || px WHEN 3 THEN '{' || px || '}' WHEN 4 THEN '' WHEN 5 THEN '*.tif;$x' WHEN 6 THEN 'a' || chr(10) || px ELSE 'say "' || px || '"' END AS arg FROM scene)"""


@query("+ fit AS (SELECT px, translate(arg, '{}' || chr(10) || chr(13), '()  ') AS a FROM texts)\nSELECT px, CASE WHEN a = '' OR contains(a, ' ') OR contains(a, '''') OR contains(a, '\"') THEN '''' || replace(a, '''', '''\\''''') || '''' ELSE a END AS quoted FROM fit", _TEXTS)
def quoted_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["concat('plain', px)", "concat('b ', px)", "concat('it\\'s', px)", "concat('{', px, '}')", "''", "'*.tif;$x'", "concat('a\\n', px)", "concat('say \"', px, '\"')"]
    texts = scene.scene(spark, sf_dir).selectExpr("px", "case px % 8 " + " ".join(f"when {k} then {e}" for k, e in enumerate(kinds)) + " end arg")
    return texts.select("px", provenance.quoted_col(F.col("arg")).alias("quoted"))


@query("+ ab AS (SELECT px, CASE px % 6 WHEN 5 THEN 'infinity'::DOUBLE ELSE px::DOUBLE END AS a, CASE px % 7 WHEN 6 THEN 'infinity'::DOUBLE WHEN 5 THEN -px::DOUBLE ELSE px::DOUBLE * (1 + (px % 7)::DOUBLE / 2000000) END AS b FROM scene)\nSELECT px, a = b OR (a < 'infinity'::DOUBLE AND b < 'infinity'::DOUBLE AND (abs(b - a) <= abs(1e-6 * b) OR abs(b - a) <= abs(1e-6 * a))) AS near FROM ab")
def close_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    ab = scene.scene(spark, sf_dir).selectExpr("px", "case px % 6 when 5 then double('infinity') else double(px) end a", "case px % 7 when 6 then double('infinity') when 5 then -double(px) else double(px) * (1 + double(px % 7) / 2000000) end b")
    return ab.select("px", is_close_col(F.col("a"), F.col("b"), TIE).alias("near"))


_GRIDS = """
grids AS (SELECT px, 500.0::DOUBLE + CASE px % 5 WHEN 1 THEN 0.02 WHEN 2 THEN 1 ELSE 0 END AS x, 30.0::DOUBLE + CASE px % 7 WHEN 3 THEN 0.001 ELSE 0 END AS w, CASE px % 11 WHEN 4 THEN 0.1 ELSE 0 END::DOUBLE AS rot, CASE WHEN px % 13 = 5 THEN NULL WHEN px % 3 = 0 THEN 32610 ELSE 32611 END AS epsg, px % 17 = 6 AS gone FROM scene)"""


@query("SELECT px, CASE WHEN gone THEN 'unknown' WHEN epsg <> 32610 THEN 'coordinate system' WHEN abs(w - 30) > 30e-6 THEN 'pixel width' WHEN abs(rot) > 30e-6 THEN 'rotation' WHEN abs(x - 500) > 30e-3 THEN 'origin' ELSE 'same' END AS difference FROM grids", _GRIDS)
def grid_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = "if(px % 17 = 6, null, array(500D + case px % 5 when 1 then 0.02D when 2 then 1D else 0D end, 30D + if(px % 7 = 3, 0.001D, 0D), 0D, 900D, if(px % 11 = 4, 0.1D, 0D), -30D)) b"
    rows = scene.scene(spark, sf_dir).selectExpr("px", "array(500D, 30D, 0D, 900D, 0D, -30D) a", other, "32610 epsg_a", "case when px % 13 = 5 then null when px % 3 = 0 then 32610 else 32611 end epsg_b")
    return rows.select("px", geo.grid_difference("a", "b", "epsg_a", "epsg_b").alias("difference"))


@query("""
+ z AS (SELECT DISTINCT (px % 62)::INT AS z FROM scene),
i AS (SELECT p || ', 1, 1, 500000, 0, 30, 30, ' || CASE WHEN p ILIKE '%geo%' THEN d ELSE z || ', ' || h || ', ' || d END AS map_info, p, z, h, d
  FROM z, (VALUES ('UTM'), ('utm'), ('Geographic Lat/Lon'), ('Albers')) a(p), (VALUES ('North'), ('N'), ('South'), ('s'), ('x')) b(h), (VALUES ('WGS-84'), ('WGS 1984'), ('wgs84'), ('NAD-83')) c(d))
SELECT DISTINCT map_info, CASE WHEN NOT (upper(d) LIKE '%WGS%' AND d LIKE '%84%') THEN NULL
  WHEN upper(p) = 'UTM' AND z BETWEEN 1 AND 60 THEN CASE WHEN upper(h) LIKE 'S%' THEN 32700 ELSE 32600 END + z
  WHEN lower(p) LIKE '%geographic%' THEN 4326 END AS epsg FROM i""")
def epsg_from_map_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = [("p", ["UTM", "utm", "Geographic Lat/Lon", "Albers"]), ("h", ["North", "N", "South", "s", "x"]), ("d", ["WGS-84", "WGS 1984", "wgs84", "NAD-83"])]
    rows = scene.scene(spark, sf_dir).selectExpr("cast(px % 62 as int) z").distinct()
    for name, values in lists:
        rows = rows.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    rows = rows.withColumn("map_info", F.expr("concat(p, ', 1, 1, 500000, 0, 30, 30, ', if(lower(p) like '%geo%', d, concat(z, ', ', h, ', ', d)))"))
    return rows.select("map_info", geo.epsg_col("map_info").alias("epsg")).distinct()
