"""Series manifests as a scan: one row a step, comma-separated, with a header."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a scanned manifest, in the order of :class:`Step`; label, classes and change may be missing in the file.
COLUMNS = ("label", "image", "stage2", "classes", "change")


@dataclass(frozen=True)
class Step:
    """Files of one step.  ``classes`` of every step, or ``change`` of every step but the first."""

    label: str
    image: str
    stage2: str
    classes: str | None = None
    change: str | None = None


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _rows(text: DataFrame) -> DataFrame:
    """``at, f``: lines with something on them that aren't comments, as trimmed fields, numbered from 0 (the header)."""
    lines = text.select(F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("line", "raw")).select("line", _bare(F.col("raw")).alias("raw"))
    kept = lines.filter("raw <> '' and raw not like '#%'")
    return kept.select(F.expr("row_number() over (order by line) - 1").alias("at"), F.transform(F.split("raw", ",", -1), _bare).alias("f"))


def scan(text: DataFrame, folder: str = ".") -> DataFrame:
    """``at`` and ``COLUMNS`` of a manifest given as one row, ``value``; ValueError says what is wrong with it.

    Blank lines and lines that begin with # are passed over; columns go by name, in any case and order.
    Relative paths are relative to ``folder``.  The first step's change file, if any, isn't used.
    """
    rows = _rows(text)
    head = rows.filter("at = 0").select(F.transform("f", F.lower).alias("f")).first()
    if head is None:
        raise ValueError("the manifest is empty")
    names: list[str] = head.f
    if lacking := [n for n in ("image", "stage2") if n not in names]:
        raise ValueError(f"the manifest has no {' and no '.join(lacking)} column")
    if {"classes", "change"} <= set(names):
        raise ValueError("the manifest has both classes and change columns")
    field = lambda n: F.try_element_at("f", F.lit(names.index(n) + 1)) if n in names else F.lit(None).cast("string")
    path = lambda n: F.when(field(n).startswith("/"), field(n)).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), field(n)))
    number = F.col("at").cast("string")
    lacks = lambda n: F.when(field(n) == "", F.concat(F.lit("row "), number, F.lit(f" of the manifest has no {n}")))
    later = F.when(F.col("at") > 1, F.lit(True))
    steps = rows.filter("at > 0").select(
        (F.col("at") - 1).alias("at"),
        F.coalesce(field("label"), (F.col("at") - 1).cast("string")).alias("label"),
        path("image").alias("image"),
        path("stage2").alias("stage2"),
        path("classes").alias("classes"),
        F.when(later, path("change")).alias("change"),
        F.when(F.size("f") != len(names), F.concat(F.lit("row "), number, F.lit(" of the manifest has "), F.size("f").cast("string"), F.lit(f" fields, its header {len(names)}"))).otherwise(F.coalesce(lacks("classes"), F.when(later, lacks("change")))).alias("wrong"),
    )
    wrong = steps.filter("wrong is not null").orderBy("at").first()
    if wrong is not None:
        raise ValueError(wrong.wrong)
    return steps.drop("wrong")


def _steps(text: DataFrame, folder: str) -> list[Step]:
    return [Step(*[r[c] for c in COLUMNS]) for r in scan(text, folder).orderBy("at").collect()]


def parse(text: str, folder: str = ".") -> list[Step]:
    spark = SparkSession.builder.getOrCreate()
    return _steps(spark.createDataFrame([(text,)], "value string"), folder)


def read(path: str | Path) -> list[Step]:
    """The steps of a manifest on any file system that Spark reads."""
    spark = SparkSession.builder.getOrCreate()
    return _steps(spark.read.text(str(path), wholetext=True), str(Path(path).parent))
