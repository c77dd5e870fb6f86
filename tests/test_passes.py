"""Distributed passes against the kernel, and scenes that share a table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.config import SegConfig, Stage2Config
from gridloom.operators import graph, kernel, regions
from gridloom.plans import passes, scene


def table(spark, image, layer=None, valid=None, name="a"):
    rows, cols, _ = image.shape
    kind = "float" if layer is not None and layer.dtype.kind == "f" else "int"
    flat = [(name, r, c, r * cols + c, image[r, c].tolist(), None if layer is None else layer[r, c].tolist(), True if valid is None else bool(valid[r, c])) for r in range(rows) for c in range(cols)]
    return spark.createDataFrame(flat, f"scene string, row int, col int, px long, bands array<int>, layer array<{kind}>, valid boolean").coalesce(2)


def maps(labels, shape, column="region_id"):
    out = np.full(shape[0] * shape[1], -1, np.int64)
    for r in labels.collect():
        out[r["px"]] = r[column]
    return out


RNG = np.random.default_rng(5)
SHAPE = (6, 9)
BASE = (np.add.outer(np.arange(6) // 2, np.arange(9) // 3) % 3)[..., None]
IMAGE = np.concatenate((20 + 30 * BASE + RNG.integers(0, 6, (*SHAPE, 1)), 40 + 25 * BASE + RNG.integers(0, 3, (*SHAPE, 1))), axis=2)
LAYER = 1 + 20 * (np.add.outer(np.arange(6) // 3, np.arange(9) // 2) % 4)[..., None] + RNG.integers(0, 4, (*SHAPE, 1))
LAYER[:, 8:] = 0
VALID = RNG.random(SHAPE) > 0.08

CONFIG = SegConfig((4.0,), 0.7, (2, 5, 8, 20, 30), norm_band=0, norm_low=30.0, norm_high=70.0, absorbed_mask=True)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)


def test_normal_and_auxiliary_passes_equal_the_kernel(spark):
    want = kernel.segment(IMAGE.reshape(-1, 2), SHAPE, VALID.ravel(), CONFIG)
    state = passes.grow(table(spark, IMAGE, valid=VALID), CONFIG)
    mask = passes._absorbed(state, CONFIG)
    assert (maps(state.relabelled(), SHAPE) == want.labels).all()
    assert [(p["phase"], p["merging"], p["nreg"]) for p in state.passes] == [(s["phase"], s["merging"], s["nreg"]) for s in want.stats]
    assert want.aux_passes > 2
    assert (maps(mask, SHAPE, "kept") == want.maps[f"armask.{want.aux_passes}"]).all()
    assert 0 < maps(mask, SHAPE, "kept").mean() < 1


@pytest.mark.parametrize("drop", [0, 1, 3])
def test_one_task_may_make_the_passes_left(spark, drop):
    """From the first pass, or from where ``drop`` distributed ones have come to; the auxiliary passes go on with its flips."""
    cfg = SegConfig((2.0, 4.0), 0.7, (2, 5, 8, 20, 30), norm_band=0, norm_low=30.0, norm_high=70.0)
    want = kernel.segment(IMAGE.reshape(-1, 2), SHAPE, VALID.ravel(), cfg)
    pixels = table(spark, IMAGE, valid=VALID)
    at = passes.begin(pixels, cfg)
    tol = kernel.Tolerance(np.float32(4), 0.7, True)
    for _ in range(drop):
        passes.normal_pass(at, cfg, tol, 2.0)
    state = passes.grow(pixels, cfg, task_edges=at.rag.count())
    assert len(state.merges) <= drop + 1
    assert [(p["phase"], p["merging"], p["nreg"]) for p in state.passes] == [(s["phase"], s["merging"], s["nreg"]) for s in want.stats if s["phase"] == "normal"]
    passes._auxiliary(state, cfg)
    assert (maps(state.relabelled(), SHAPE) == want.labels).all()


@pytest.mark.parametrize("kind", ["int", "float1"])
def test_second_stage_equals_the_kernel(spark, kind):
    layer = {"int": LAYER, "float1": (LAYER / np.float32(3)).astype(np.float32), "float2": np.concatenate((LAYER / np.float32(3), LAYER % 7 + np.float32(0.5)), axis=2).astype(np.float32)}[kind]
    stage2 = Stage2Config(7, 30)
    grown = kernel.grow(IMAGE.reshape(-1, 2), SHAPE, VALID.ravel(), CONFIG)[0].labels
    want = kernel.develop(grown, SHAPE, layer.reshape(-1, layer.shape[2]), stage2).labels
    pixels = table(spark, IMAGE, layer, VALID)
    rows = [("a", p // SHAPE[1], p % SHAPE[1], p, int(g)) for p, g in enumerate(grown)]
    labels = spark.createDataFrame(rows, "scene string, row int, col int, px long, region_id long")
    got = passes.develop(labels, pixels.select("scene", "px", F.col("layer").alias("bands")), stage2)
    assert (maps(got, SHAPE) == want).all()
    assert len(np.unique(want)) < len(np.unique(grown))


def test_series_equals_the_kernel(spark):
    cfg, stage2 = SegConfig((1.0,), 1.0, (1, 1, 4, 9, 9)), Stage2Config(3, 30)
    image = IMAGE.copy()
    image[2:5, 3:7] = 99 + RNG.integers(0, 3, (3, 4, 2))
    change = (image != IMAGE).any(axis=2)
    steps = [(table(spark, IMAGE, LAYER, VALID), None), (table(spark, image, LAYER, VALID), change)]
    as_table = lambda c: None if c is None else spark.createDataFrame([("a", int(p), bool(x)) for p, x in enumerate(c.ravel())], "scene string, px long, changed boolean")
    given = [(p, p.select("scene", "px", F.col("layer").alias("bands")), as_table(c)) for p, c in steps]
    got, want = passes.segment_series(given, cfg, stage2), scene.segment_series(given, cfg, stage2)
    for a, b in zip(got, want):
        assert (maps(a, SHAPE) == maps(b, SHAPE)).all()
    with pytest.raises(ValueError):
        passes.segment_series(given[1:], cfg, stage2)


def test_scenes_do_not_mix(spark):
    """Two scenes in one table give what each gives alone."""
    a = table(spark, IMAGE, valid=VALID, name="a")
    b = table(spark, IMAGE[:, ::-1].copy(), valid=VALID, name="b")
    labels = {n: scene.segment(p, CONFIG, "normal").withColumn("region_id", F.col("region_id") * 3) for n, p in (("a", a), ("b", b))}
    both = labels["a"].unionByName(labels["b"])
    pixels = a.unionByName(b)

    def alone(f):
        return {(n, *r) for n in "ab" for r in map(tuple, f(labels[n], pixels.filter(F.col("scene") == n)).drop("scene").collect())}

    def together(f):
        out = f(both, pixels)
        return {tuple(r) for r in out.select("scene", *[c for c in out.columns if c != "scene"]).collect()}

    def edges(lab, pix):
        means = regions.integer_means(lab, pix, 2).withColumn("ctr", F.expr("array(cast(floor(ctr[0] / 20) as float))"))
        return regions.edges_with_distance(regions.adjacency(lab), means, "float")

    for f in (
        lambda lab, pix: regions.reranked(lab).select("scene", "px", "region_id"),
        lambda lab, pix: regions.draws(edges(lab, pix)).select("scene", "region_id", "n_draws", "draw_offset"),
        lambda lab, pix: regions.histogram(regions.nearest_by_id(edges(lab, pix)), 60.0).select("scene", "bin", "n"),
        lambda lab, pix: regions.pass_tolerance(regions.histogram(regions.nearest_by_id(edges(lab, pix)), 60.0), 60.0, 0.2).select("scene", "tp2", "use_hist"),
        lambda lab, pix: regions.nearest_with_flips(edges(lab, pix), lambda at: passes.coins(at, passes.Flips(), 500)).select("scene", "region_id", "nnbr_id"),
        lambda lab, pix: graph.first_matching(edges(lab, pix).select("scene", "src", "dst", F.col("first_key").alias("prio"))).select("scene", "src", "dst"),
        lambda lab, pix: graph.first_matching(edges(lab, pix).select("scene", "src", "dst", F.col("first_key").alias("prio")), limit=3).select("scene", "src", "dst"),
        lambda lab, pix: regions.combined(lab, lab.withColumn("region_id", F.expr("if(row between 2 and 3, region_id, 0L)")), graph.components).select("scene", "px", "region_id"),
    ):
        assert together(f) == alone(f)
    with pytest.raises(ValueError, match="one scene"):
        passes.segment(pixels, CONFIG)
    with pytest.raises(ValueError, match="one scene"):
        passes.develop(both, pixels.select("scene", "px", "bands"), Stage2Config(2, 9))


def test_roots(spark):
    chain = [("a", k, k + 1) for k in range(20)] + [("b", 5, 2), ("b", 7, 5), ("b", 9, 5)]
    got = {(r.scene, r.id): r.root for r in graph.roots(spark.createDataFrame(chain, "scene string, id long, parent long")).collect()}
    assert got == {**{("a", k): 20 for k in range(20)}, ("b", 5): 2, ("b", 7): 2, ("b", 9): 2}


def test_coins(spark):
    rows = spark.createDataFrame([(None,), (0,), (9,), (70_000,), (99_999,)], "position long")
    bits = passes.Flips().take(100_000)
    got = {r.position: r.bit for r in passes.coins(rows, passes.Flips(), 100_000).collect()}
    assert got == {None: None, **{p: int(bits[p]) for p in (0, 9, 70_000, 99_999)}}
