"""Every registered raster query against its SQL, or for its schema and invariants where SQL can't express it."""

import numpy as np
import pytest

from gridloom.config import SegConfig
from gridloom.operators import kernel, regions
from gridloom.plans import catalog, passes, rules, scene  # noqa: F401 - rules registers its queries

from .conftest import rows_of


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, small, name):
    got = rows_of(catalog.QUERIES[name](spark, small).toPandas())
    want = rows_of(duck.sql(catalog.ORACLE_SQL[name]).df())
    assert got == want


def test_every_sql_belongs_to_a_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


@pytest.mark.parametrize("cfg", [SegConfig((3.0, 8.0)), SegConfig((25.0,), 0.5, (1, 1, 6, 12), eight_way=True)])
def test_distributed_passes_give_the_kernels_map(spark, cfg):
    rng = np.random.default_rng(12)
    rows = [("s", r, c, r * 9 + c, rng.integers(0, 20, 2).tolist(), bool(rng.random() > 0.1)) for r in range(9) for c in range(9)]
    p = spark.createDataFrame(rows, "scene string, row int, col int, px long, bands array<int>, valid boolean")
    one = scene.segment(p, cfg, "normal").toPandas().sort_values("px")["region_id"].tolist()
    assert passes.segment(p, cfg).toPandas().sort_values("px")["region_id"].tolist() == one
    assert len(set(one)) > 5


def test_results_do_not_depend_on_partitions(spark, small):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    maps = []
    for n in ("1", "7", "23"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        maps.append(rows_of(catalog.QUERIES["combine_maps"](spark, small).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert maps[0] == maps[1] == maps[2]


def test_series_has_a_map_for_each_step(spark, small):
    out = catalog.QUERIES["segment_series"](spark, small)
    counts = {r["step"]: r["count"] for r in out.groupBy("step").count().collect()}
    assert counts == {1: 1000, 2: 1000, 3: 1000}


def test_float_samples_are_refused_by_the_first_stage(spark, small):
    p = scene.scene(spark, small).selectExpr("scene", "row", "col", "px", "cast(bands as array<float>) bands")
    with pytest.raises(TypeError):
        scene.segment(p, scene.CONFIG)


def test_polygons_cover_their_pixels(spark, small):
    got = catalog.QUERIES["polygonize"](spark, small).toPandas()
    sizes = catalog.QUERIES["region_stats"](spark, small).toPandas()
    assert dict(zip(got["region_id"], got["npix"])) == dict(zip(sizes["region_id"], sizes["npix"]))
    assert (got["area"] == got["npix"] * 900.0).all()


@pytest.mark.parametrize("bands", [1, 2])
def test_float_means_and_near_ties_equal_the_kernels(spark, bands):
    rng = np.random.default_rng(3)
    ids, layer = np.repeat(np.arange(6), 60), rng.standard_normal((360, bands)).astype(np.float32)
    labels = spark.createDataFrame([("s", i // 20, i % 20, i, int(g)) for i, g in enumerate(ids)], "scene string, row int, col int, px long, region_id long")
    table = spark.createDataFrame([("s", i, x.tolist()) for i, x in enumerate(layer)], "scene string, px long, bands array<float>")
    means = regions.float_means(labels, table, bands)
    got = {r.region_id: list(r.ctr) for r in means.collect()}
    want = kernel.region_means(ids, layer, np.arange(1, 6))
    assert got == {k + 1: row.tolist() for k, row in enumerate(want)}
    edges = regions.edges_with_distance(regions.adjacency(labels), means)
    near = {r.region_id: r.nnbr_id for r in regions.nearest_near_ties(edges, 1e-6).collect()}
    g = kernel.Graph.from_labels(ids, (18, 20), ((0, -1), (1, 0), (0, 1), (-1, 0)))
    best, _ = kernel._candidates(g, np.concatenate((np.zeros((1, bands)), want)), np.arange(6) > 0)
    assert near == {k: int(best[k]) for k in range(1, 6)}
