"""A series as a stream: manifest rows arrive in files, each step continues from the map of the step before.

``foreachBatch`` runs the steps of a micro-batch in order of ``step``.  The state is the last finished step and its
map, both in the shared folder: a map is written first, then a marker names it, so a batch that is replayed after a
failure does nothing twice.  Steps must come in order; the rule has no room for late ones, so these are refused.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SegConfig, Stage2Config
from ..operators import kernel
from ..plans.scene import _image, _per_scene, develop, segment
from ..sources.raster import width_of

#: Columns of a manifest stream: step number from 0, label, and names of the tables that ``load`` opens.
SCHEMA = "step long, label string, image string, stage2 string, change string"


@dataclass
class SeriesState:
    """The last finished step and its map, in a folder that driver and executors share."""

    spark: SparkSession
    path: str
    done: int = -1
    width: int = 0
    _map: str | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        jvm = self.spark._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("steps"))
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path("steps")) if s.getPath().getName().endswith(".json"))
        if names:
            stream = self._fs.open(self._path(f"steps/{names[-1]}"))
            state = json.loads(bytes(stream.readAllBytes()).decode())
            stream.close()
            self.done, self.width, self._map = state["step"], state["width"], state["map"]

    @property
    def labels(self) -> DataFrame | None:
        return None if self._map is None else self.spark.read.parquet(f"{self.path}/{self._map}")

    def finish(self, step: int, labels: DataFrame) -> None:
        """Write a step's map, then its marker.  Ids never get narrower than an earlier step needed."""
        name = f"maps/{step:08d}"
        labels.write.mode("overwrite").parquet(f"{self.path}/{name}")
        count = self.spark.read.parquet(f"{self.path}/{name}").filter("region_id <> 0").agg(F.countDistinct("region_id")).first()[0]
        self.done, self._map, self.width = step, name, max(self.width, width_of(count))
        stream = self._fs.create(self._path(f"steps/.{step:08d}"), True)
        stream.write(bytearray(json.dumps({"step": step, "map": name, "width": self.width}).encode()))
        stream.close()
        self._fs.delete(self._path(f"steps/{step:08d}.json"), False)
        self._fs.rename(self._path(f"steps/.{step:08d}"), self._path(f"steps/{step:08d}.json"))


def next_map(previous: DataFrame | None, pixels: DataFrame, layer: DataFrame, change: DataFrame | None, cfg: SegConfig, stage2: Stage2Config) -> DataFrame:
    """One step: the whole image at first; later only what changed, pasted, cut into pieces and developed."""
    if previous is None:
        return develop(segment(pixels, cfg, "normal"), layer, stage2)
    masked = pixels.drop("valid").join(change.select("scene", "px", F.col("changed").alias("valid")), ["scene", "px"])
    update = segment(masked, cfg, "normal").select("scene", "px", F.col("region_id").alias("update"))
    both = previous.join(update, ["scene", "px"]).join(layer.select("scene", "px", F.col("bands").alias("layer")), ["scene", "px"])

    def run(rows: pd.DataFrame, shape: tuple[int, int]) -> np.ndarray:
        pasted = kernel.combine(rows["region_id"].to_numpy(np.int64), rows["update"].to_numpy(np.int64), shape)
        return kernel.develop(pasted, shape, _image(rows, "layer"), stage2).labels

    return _per_scene(both, run)


def sink(state: SeriesState, load: Callable[[str], DataFrame], cfg: SegConfig, stage2: Stage2Config) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over rows of ``SCHEMA``; ``load`` opens what a row names."""

    def run(batch: DataFrame, _: int) -> None:
        for r in batch.orderBy("step").collect():  # names of files, one row a step
            if r.step <= state.done:
                continue  # finished before: a replayed batch
            if r.step != state.done + 1:
                raise ValueError(f"step {r.step} came after step {state.done}")
            if (r.change is None) != (r.step == 0):
                raise ValueError("the first step takes no change mask, later ones need one")
            change = None if r.change is None else load(r.change)
            state.finish(r.step, next_map(state.labels, load(r.image), load(r.stage2), change, cfg, stage2))

    return run


def start(spark: SparkSession, manifests: str, state: SeriesState, load: Callable[[str], DataFrame], cfg: SegConfig, stage2: Stage2Config, checkpoint: str):  # noqa: ANN201
    """Follow a folder of JSON manifest files, one file a micro-batch."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(manifests)
    return rows.writeStream.foreachBatch(sink(state, load, cfg, stage2)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
