"""Token counts as a delta-maintained rollup by source, language and tokenizer version.

The store keeps no totals that are rewritten: it keeps, for each committed batch, the batch's signed sums by
(source, lang, tokenizer), and totals are the sums of those.  A change has a before image, an after image or both
(insert: after; delete: before; revision: both); before images count negatively under their own group, so a
revised count, or a document that moves between groups, needs no look-up of old state.

Commits are idempotent.  A batch's sums are written first, under a name of their own; then one marker file, created
only if absent, names them.  Repeating a batch id is a no-op, whether it succeeded before or a concurrent writer
won; sums without a marker (a failed attempt) are never read.  ``compact`` folds committed batches into one table: it
lists the markers once, sums what they name and names just those, so a batch committed meanwhile counts once, later.
Readers too take one list of markers; those of folded batches aren't opened again.

Rows: null source, language or tokenizer are groups of their own; a null or empty text has 0 tokens and is still a
document.  Repeated change rows count as often as they occur.  Groups whose documents and tokens are both 0 are
left out of totals.  An empty batch commits and adds nothing.  Columns other than those named are not read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import utf8
from .packing import tokenizer as load_tokenizer

GROUP = ["source", "lang", "tokenizer"]
SUMS = "source string, lang string, tokenizer string, docs long, tokens long"
_SIDE = "struct<source: string, lang: string, tokenizer: string, tokens: long>"


def whitespace_tokens(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def subword_tokens(docs: DataFrame, columns: list[str], vocabulary: str, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with each text column in ``columns`` replaced by its number of ids; null and empty texts have 0."""
    schema = docs.schema
    kept = [f for f in schema.fields if f.name not in columns]
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{c}` long" for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_tokenizer(vocabulary, ranks, pattern)
        for batch in batches:
            counts = []
            for c in columns:
                n = np.zeros(batch.num_rows, np.int64)
                for at in range(0, batch.num_rows, 256):
                    for k, t in enumerate(utf8(batch.column(c).slice(at, 256))):
                        n[at + k] = len(bpe.ids(t.decode("utf-8", "replace"))) if t else 0
                counts.append(pa.array(n, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + counts, names=[f.name for f in kept] + columns)

    return docs.mapInArrow(run, out)


def change(before: Column | None, after: Column | None) -> list[Column]:
    """The two image columns of a change row; each is None or :func:`image`."""
    none = F.lit(None).cast(_SIDE)
    return [(none if before is None else before).alias("before"), (none if after is None else after).alias("after")]


def image(source: Column, lang: Column, tokenizer: Column, tokens: Column) -> Column:
    return F.struct(source.cast("string").alias("source"), lang.cast("string").alias("lang"), tokenizer.cast("string").alias("tokenizer"), tokens.cast("long").alias("tokens"))


def signed_sums(changes: DataFrame) -> DataFrame:
    """Changes (``before``, ``after``) as signed sums by group: one explode, one aggregate combined map-side."""
    sides = F.array(F.struct(F.lit(-1).cast("long").alias("sign"), F.col("before").alias("x")), F.struct(F.lit(1).cast("long").alias("sign"), F.col("after").alias("x")))
    rows = changes.select(F.explode(sides).alias("s")).filter("s.x is not null").select("s.sign", "s.x.*")
    return rows.groupBy(*GROUP).agg(F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.coalesce("tokens", F.lit(0))).alias("tokens"))


class RollupStore:
    """Committed batches of signed sums under ``path``, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._p("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._p("commits"))

    def _p(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _marker(self, batch: str) -> str:
        return f"commits/{batch.encode().hex()}.json"

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._p(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _create(self, name: str, content: dict) -> bool:
        """Write a file that isn't there yet, in one rename; False if it is."""
        part = self._p(f"commits/.{uuid.uuid4().hex}")
        stream = self._fs.create(part, True)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        if self._fs.exists(self._p(name)) or not self._fs.rename(part, self._p(name)):
            self._fs.delete(part, False)
            return False
        return True

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._p(self._marker(batch)))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of changes; False, and nothing done, if this batch id was committed before."""
        if self.committed(batch):
            return False
        part = f"sums/{uuid.uuid4().hex}"
        signed_sums(changes).coalesce(1).write.parquet(f"{self.path}/{part}")
        return self._create(self._marker(batch), {"batch": batch, "sums": part})

    def _state(self) -> tuple[list[str], list[str]]:
        """The sums that count now, and the ids of the batches in them: the newest fold, and every marker beyond it."""
        folded = self._folded()
        known = {self._marker(b) for b in folded["batches"]}
        names = sorted(f"commits/{s.getPath().getName()}" for s in self._fs.listStatus(self._p("commits")) if s.getPath().getName().endswith(".json"))
        new = [self._read(n) for n in names if n not in known]
        return folded["sums"] + [m["sums"] for m in new], sorted([*folded["batches"], *[m["batch"] for m in new]])

    def _sum(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], SUMS)
        rows = self.spark.read.schema(SUMS).parquet(*[f"{self.path}/{p}" for p in parts])
        return rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, docs, tokens`` over all committed batches."""
        return self._sum(self._state()[0])

    def _folded(self) -> dict:
        """The compaction that holds most batches: its sums, and the batches they hold.

        Each fold names all batches in its own sums, so concurrent compactions and any one of them are right.
        """
        if not self._fs.exists(self._p("folds")):
            return {"batches": [], "sums": []}
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._p("folds")) if s.getPath().getName().endswith(".json"))
        return self._read(f"folds/{names[-1]}") if names else {"batches": [], "sums": []}

    def compact(self) -> None:
        """Fold all committed batches into one table of sums; batch ids stay known, so commits stay idempotent."""
        parts, batches = self._state()
        part = f"sums/{uuid.uuid4().hex}"
        self._sum(parts).coalesce(1).write.parquet(f"{self.path}/{part}")
        self._fs.mkdirs(self._p("folds"))
        self._create(f"folds/{len(batches):012d}-{uuid.uuid4().hex}.json", {"batches": batches, "sums": [part]})
