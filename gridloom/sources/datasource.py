"""Spark data sources: ``raster`` reads images and region maps by blocks of rows, ``regionmap`` writes ENVI maps.

    register(spark)
    spark.read.format("raster").option("scene", "a").load("/shared/image.tif")
    labels.write.format("regionmap").mode("overwrite").option("rows", 250).option("cols", 250).save("/shared/out")

Paths must be visible to driver and executors alike.  Raw ENVI samples are read by offset, so a task reads only its
rows; compressed formats are decoded by each task that needs them.

``regionmap`` takes the map's place as options: ``like`` (an image whose header says it), or ``mapinfo`` and
``coordinatesystem``; ``masked`` says whether 0 is nodata (by default, whether some pixel is 0).
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from . import detect, envi
from .raster import Meta, RasterError, width_of

BLOCK_ROWS = 256


@dataclass
class Block(InputPartition):
    first: int
    last: int


class RasterReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.path = options["path"]
        self.scene = options.get("scene", Path(self.path).name)
        self.map = options.get("kind", "image") == "map"
        self.meta = detect.probe(self.path)
        if self.map and detect.detect(self.path) != "envi":
            raise RasterError(f"{self.path}: region maps are read from ENVI files")
        self.step = max(1, int(options.get("blockrows", BLOCK_ROWS)))

    def partitions(self) -> list[Block]:
        return [Block(r, min(r + self.step, self.meta.rows)) for r in range(0, self.meta.rows, self.step)]

    def rows(self, first: int, last: int) -> np.ndarray:
        """Samples of some rows by pixel; of raw files by pixel or with one band only those rows are read."""
        if self.meta.format == "envi":
            meta, fields = envi.read_header(self.path)
            kind = (envi.MAP_TYPES if self.map else envi.IMAGE_TYPES).get(int(fields.get("data type", "0")))
            if kind:
                how = "bip" if meta.bands == 1 else fields["interleave"].lower()
                parts = meta.bands if how == "bsq" else 1  # a band after the other, or all of a row together
                order, line = ">" if fields["byte order"].strip() == "1" else "<", meta.cols * meta.bands // parts
                flat = []
                for b in range(parts):
                    at = int(fields["header offset"]) + (b * meta.rows + first) * line * int(kind[1])
                    flat.append(np.fromfile(self.path, order + kind, (last - first) * line, offset=at).astype(kind))
                    if len(flat[-1]) < (last - first) * line:
                        raise RasterError(f"{self.path}: the samples are cut short")
                return envi.by_pixel(np.concatenate(flat), last - first, meta.cols, meta.bands, how)
        r = detect.read_region_map(self.path) if self.map else detect.read(self.path)
        return r.data.reshape(r.meta.rows, r.meta.cols, -1)[first:last].reshape(-1, r.meta.bands)

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        data, cols = self.rows(partition.first, partition.last), self.meta.cols
        n = len(data)
        px = np.arange(n, dtype=np.int64) + partition.first * cols
        fields = [pa.array([self.scene] * n), pa.array((px // cols).astype(np.int32)), pa.array((px % cols).astype(np.int32)), pa.array(px)]
        if self.map:
            yield pa.RecordBatch.from_arrays([*fields, pa.array(data[:, 0].astype(np.int64))], names=["scene", "row", "col", "px", "region_id"])
            return
        kind = np.float32 if data.dtype.kind == "f" else np.int32
        flat = pa.array(np.ascontiguousarray(data, dtype=kind).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * data.shape[1] + 1, data.shape[1], dtype=np.int32)), flat)
        yield pa.RecordBatch.from_arrays([*fields, lists], names=["scene", "row", "col", "px", "bands"])


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        if self.options.get("kind", "image") == "map":
            return "scene string, row int, col int, px long, region_id long"
        kind = "float" if detect.probe(self.options["path"]).dtype == "float32" else "int"
        return f"scene string, row int, col int, px long, bands array<{kind}>"

    def reader(self, schema: StructType) -> RasterReader:
        return RasterReader(schema, self.options)


@dataclass
class Written(WriterCommitMessage):
    highest: int
    zeros: bool


class RegionMapWriter(DataSourceWriter):
    """Tasks write ids at their pixels' offsets, four bytes each; the driver narrows the ids and adds the header."""

    def __init__(self, schema: StructType, options: dict):
        self.path, self.columns = options["path"], schema.fieldNames()
        self.shape = int(options["rows"]), int(options["cols"])
        self.software, self.command = options.get("software", ""), options.get("history", "")
        self.meta = detect.probe(options["like"]) if options.get("like") else None
        if options.get("mapinfo") or options.get("coordinatesystem"):
            self.meta = Meta(*self.shape, 1, "uint8", "envi", map_info=options.get("mapinfo"), wkt=options.get("coordinatesystem"))
        self.masked = options.get("masked")
        self.part = self.path + ".part"
        with open(self.part, "wb") as f:
            f.truncate(self.shape[0] * self.shape[1] * 4)

    def write(self, rows: Iterator) -> Written:
        px, ids = self.columns.index("px"), self.columns.index("region_id")
        pairs = np.fromiter((v for r in rows for v in (r[px], r[ids])), np.int64).reshape(-1, 2)  # 16 bytes a row
        pairs = pairs[np.argsort(pairs[:, 0])]
        cuts = np.flatnonzero(np.diff(pairs[:, 0]) != 1) + 1
        with open(self.part, "r+b") as f:
            for run in np.split(pairs, cuts):
                if len(run):
                    f.seek(int(run[0, 0]) * 4)
                    f.write(run[:, 1].astype("<u4").tobytes())
        return Written(int(pairs[:, 1].max(initial=0)), bool((pairs[:, 1] == 0).any()))

    def commit(self, messages: list[Written]) -> None:
        count = max((m.highest for m in messages if m), default=0)
        width = width_of(count)
        labels = np.fromfile(self.part, "<u4")
        masked = any(m.zeros for m in messages if m) if self.masked is None else self.masked.lower() == "true"
        envi.write_region_map(self.path, labels, self.shape, width, masked, self.meta, self.software, self.command)
        os.remove(self.part)

    def abort(self, messages: list) -> None:
        if os.path.exists(self.part):
            os.remove(self.part)


class RegionMapSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "regionmap"

    def schema(self) -> str:
        return "px long, region_id long"

    def writer(self, schema: StructType, overwrite: bool) -> RegionMapWriter:
        return RegionMapWriter(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RasterSource)
    spark.dataSource.register(RegionMapSink)
