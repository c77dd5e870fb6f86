"""A raster scene derived from the ``events`` table, and segmentation of scenes as DataFrames.

Events are numbered densely from 0; 100 of them make a row of pixels.  Two bands, a second layer, ready-made block
labels and three class layers are integer functions of position and event, so any engine derives the same scene.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SegConfig, Stage2Config
from ..operators import kernel

WIDTH = 100
#: The production parameters of the registered queries.
CONFIG = SegConfig((10.0,), 0.2, (4, 8, 20, 400, 400))
STAGE2 = Stage2Config(30, 800)


def scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scene, row, col, px, bands, layer, block_id, class0, class1, class2``."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "user_id", "value")
    p = e.selectExpr("'events' scene", f"cast(event_id div {WIDTH} as int) row", f"cast(event_id % {WIDTH} as int) col", "event_id px", "cast(user_id % 4 as int) u", "cast(floor(value) as int) v")
    lake = "row % 10 >= 8 and col between 40 and 55"
    b0 = f"if({lake}, 0, cast(1 + 40 * ((row div 8 + col div 8) % 5) + u as int))"
    b1 = f"if({lake}, 0, cast(1 + 30 * ((row div 16 + 2 * (col div 16)) % 7) + v % 5 as int))"
    classes = [f"cast((row div 10 + col div 10) % 4{f' + if(row between 3 and 6 and col between {10 * t} and {10 * t + 9}, {10 * t}, 0)' if t else ''} as int) class{t}" for t in range(3)]
    layer = "array(if(col >= 90, 0, cast(1 + 25 * ((row div 12 + col div 20) % 9) + v % 7 as int))) layer"
    return p.selectExpr("scene", "row", "col", "px", f"array({b0}, {b1}) bands", layer, "cast(1 + (row div 5) * 20 + col div 5 as long) block_id", *classes)


def blocks(pixels: DataFrame) -> DataFrame:
    return pixels.select("scene", "row", "col", "px", F.col("block_id").alias("region_id"))


def grid(rows: pd.DataFrame) -> tuple[pd.DataFrame, tuple[int, int]]:
    """A scene's rows in raster order, and its shape; every pixel must be there once."""
    rows = rows.sort_values(["row", "col"], kind="stable")
    shape = (int(rows["row"].max()) + 1, int(rows["col"].max()) + 1)
    if len(rows) != shape[0] * shape[1] or not (rows["row"].to_numpy() * shape[1] + rows["col"].to_numpy() == np.arange(len(rows))).all():
        raise ValueError(f"scene {rows['scene'].iloc[0]} isn't a full grid of {shape[0]} x {shape[1]} pixels")
    return rows, shape


LABELS = "scene string, row int, col int, px long, region_id long"


def _per_scene(pixels: DataFrame, run: Callable[[pd.DataFrame, tuple[int, int]], np.ndarray]) -> DataFrame:
    """One task a scene: pixel pairing is a fold in raster order, which can't be split within a scene."""

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        rows, shape = grid(rows)
        return rows[["scene", "row", "col", "px"]].assign(region_id=run(rows, shape))

    return pixels.groupBy("scene").applyInPandas(each, LABELS)


def _image(rows: pd.DataFrame, column: str) -> np.ndarray:
    return np.stack(rows[column].to_numpy())


def _valid(rows: pd.DataFrame) -> np.ndarray:
    return rows["valid"].to_numpy(bool) if "valid" in rows else np.ones(len(rows), bool)


def segment(pixels: DataFrame, cfg: SegConfig, phase: str = "auxiliary") -> DataFrame:
    """``labels`` of one image per scene, after the normal passes or after the auxiliary ones as well.

    ``pixels`` has ``scene, row, col, px, bands`` and maybe ``valid``; bands must be integers.
    """
    if "float" in dict(pixels.dtypes)["bands"] or "double" in dict(pixels.dtypes)["bands"]:
        raise TypeError("the first stage takes integer samples; floats are for the second stage")
    columns = ["scene", "row", "col", "px", "bands", *(["valid"] if "valid" in pixels.columns else [])]

    def run(rows: pd.DataFrame, shape: tuple[int, int]) -> np.ndarray:
        image = _image(rows, "bands")
        if phase == "normal":
            return kernel.grow(image, shape, _valid(rows), cfg)[0].labels
        return kernel.segment(image, shape, _valid(rows), cfg).labels

    return _per_scene(pixels.select(*columns), run)


def absorbed_mask(pixels: DataFrame, cfg: SegConfig) -> DataFrame:
    """``scene, row, col, px, kept``: 0 where a pixel's region was once the smaller party of an auxiliary merge."""
    import dataclasses

    cfg = dataclasses.replace(cfg, absorbed_mask=True)

    def run(rows: pd.DataFrame, shape: tuple[int, int]) -> np.ndarray:
        out = kernel.segment(_image(rows, "bands"), shape, _valid(rows), cfg)
        return out.maps[f"armask.{out.aux_passes}"].astype(np.int64)

    return _per_scene(pixels, run).withColumnRenamed("region_id", "kept")


def pass_stats(pixels: DataFrame, cfg: SegConfig, stage2: Stage2Config | None = None) -> DataFrame:
    """``scene, phase, pass, reason, n``: each pass's counters, one row for each."""

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        rows, shape = grid(rows)
        image = _image(rows, "bands")
        out = kernel.segment(image, shape, _valid(rows), cfg) if stage2 is None else kernel.grow(image, shape, _valid(rows), cfg)[0]
        stats = out.stats + (kernel.develop(out.labels, shape, _image(rows, "layer"), stage2).stats if stage2 else [])
        flat = [(rows["scene"].iloc[0], s["phase"], s["pass"], k, float(v)) for s in stats for k, v in s.items() if k not in ("phase", "pass") and v is not None]
        return pd.DataFrame(flat, columns=["scene", "phase", "pass", "reason", "n"])

    return pixels.groupBy("scene").applyInPandas(each, "scene string, phase string, pass int, reason string, n double")


def develop(labels: DataFrame, layer: DataFrame, cfg: Stage2Config) -> DataFrame:
    """The second stage: ``labels`` developed by ``layer`` (``scene, px, bands``) on the same grid."""
    both = labels.join(layer.select("scene", "px", F.col("bands").alias("layer")), ["scene", "px"])
    if "float" in dict(layer.dtypes)["bands"]:
        cast = np.float32
    else:
        cast = np.int64

    def run(rows: pd.DataFrame, shape: tuple[int, int]) -> np.ndarray:
        return kernel.develop(rows["region_id"].to_numpy(np.int64), shape, _image(rows, "layer").astype(cast), cfg).labels

    return _per_scene(both, run)


def segment_two(pixels: DataFrame, cfg: SegConfig, stage2: Stage2Config) -> DataFrame:
    """Both stages of one scene in one task; ``pixels`` also has ``layer``."""

    def run(rows: pd.DataFrame, shape: tuple[int, int]) -> np.ndarray:
        grown = kernel.grow(_image(rows, "bands"), shape, _valid(rows), cfg)[0].labels
        return kernel.develop(grown, shape, _image(rows, "layer"), stage2).labels

    return _per_scene(pixels, run)


def segment_series(steps: list[tuple[DataFrame, DataFrame, DataFrame | None]], cfg: SegConfig, stage2: Stage2Config) -> list[DataFrame]:
    """A series of (pixels, layer, change): the first step whole, later ones where ``change`` (scene, px, changed) says.

    Each later step's new regions are pasted over the previous map, cut into connected pieces and developed.  A
    change mask on the first step, or none on a later one, is an error.  Step maps are written, so lineage is short.
    """
    from ..storage import written

    out: list[DataFrame] = []
    for t, (pixels, layer, change) in enumerate(steps):
        if (change is None) != (t == 0):
            raise ValueError(f"step {t + 1} {'takes no' if t == 0 else 'needs a'} change mask")
        if t == 0:
            labels = segment(pixels, cfg, "normal")
            out.append(written(develop(labels, layer, stage2), "step"))
            continue
        masked = pixels.drop("valid").join(change.select("scene", "px", F.col("changed").alias("valid")), ["scene", "px"])
        update = segment(masked, cfg, "normal").withColumnRenamed("region_id", "update")
        both = out[-1].join(update.select("scene", "px", "update"), ["scene", "px"]).join(layer.select("scene", "px", F.col("bands").alias("layer")), ["scene", "px"])

        def run(rows: pd.DataFrame, shape: tuple[int, int]) -> np.ndarray:
            pasted = kernel.combine(rows["region_id"].to_numpy(np.int64), rows["update"].to_numpy(np.int64), shape)
            return kernel.develop(pasted, shape, _image(rows, "layer"), stage2).labels

        out.append(written(_per_scene(both, run), "step"))
    return out
