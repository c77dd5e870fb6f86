"""Graphs as tables: connected components, ordered matching, prefix sums without a single-task window."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written

#: Edges that may be matched on the driver (three long columns); more go through distributed rounds first.
DRIVER_EDGES = 2_000_000
#: Ids of one bucket of a two-level prefix sum.
BUCKET = 4096


def checksum(df: DataFrame) -> tuple:
    """A row count and an order-free hash of all rows."""
    h = F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(38,0)")
    return tuple(df.agg(F.count(F.lit(1)), F.sum(h)).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every node of ``edges(a, b)``; component is the least id reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each is one min-aggregate, combined
    before the shuffle, and one equi-join.  Each round is written to the shared folder, which keeps lineage short.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    e = written(edges.select(a.alias("a"), b.alias("b")).filter("a <> b").distinct(), "edges")
    seen = checksum(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(low, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = written(down.unionAll(low.select("a", F.col("m").alias("b"))).distinct(), "small")
        now = checksum(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(roots)


def exclusive_sum(df: DataFrame, order: str, value: str, name: str, bucket: int = BUCKET, within: str = "scene") -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of its scene (the column ``within``) that have a smaller ``order``.

    ``order`` is a non-negative id, distinct in the scene.  Two levels: sums of id ranges are added up over the ranges,
    which are few, and rows within their range only.
    """
    rows = df.withColumn("_range", F.expr(f"{order} div {bucket}"))
    parts = rows.groupBy(within, "_range").agg(F.sum(value).alias("_sum"))
    before = parts.selectExpr(within, "_range", f"coalesce(sum(_sum) over (partition by {within} order by _range rows between unbounded preceding and 1 preceding), 0) _before")
    inside = f"coalesce(sum({value}) over (partition by {within}, _range order by {order} rows between unbounded preceding and 1 preceding), 0)"
    return rows.join(before, [within, "_range"]).withColumn("_inside", F.expr(inside)).withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_range", "_before", "_inside")


def dense_ids(ids: DataFrame, name: str = "id", bucket: int = BUCKET, within: str = "scene") -> DataFrame:
    """``scene, id, new_id``: each scene's distinct ids numbered 1, 2, ... in their order."""
    one = ids.select(within, F.col(name).alias("id")).distinct().withColumn("_one", F.lit(1).cast("long"))
    return exclusive_sum(one, "id", "_one", "_before_", bucket, within).select(within, "id", (F.col("_before_") + 1).alias("new_id"))


def roots(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``scene, id, root`` of a forest of ``scene, id, parent`` edges (one parent an id): pointer doubling, written each round."""
    at = written(edges.select("scene", "id", F.col("parent").alias("root")), "roots")
    for _ in range(max_rounds):
        up = at.select("scene", F.col("id").alias("root"), F.col("root").alias("above"))
        both = at.join(up, ["scene", "root"], "left")
        if both.filter("above is not null").isEmpty():
            return at
        at = written(both.select("scene", "id", F.coalesce("above", "root").alias("root")), "roots")
    raise RuntimeError(f"the forest is deeper than 2**{max_rounds}")


def greedy(src: np.ndarray, dst: np.ndarray, prio: np.ndarray, scene: np.ndarray | None = None) -> np.ndarray:
    """Indices of the edges of the first matching in order of ``prio``, in each scene (a code) for itself."""
    scene = np.zeros(len(src), np.int64) if scene is None else scene
    order = np.lexsort((prio, scene))
    _, code = np.unique(np.stack((np.tile(scene, 2), np.concatenate((src, dst)))), axis=1, return_inverse=True)
    code = code.ravel()
    a, b = code[: len(src)], code[len(src) :]
    taken, out = bytearray(int(code.max()) + 1 if len(code) else 0), []
    for i, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist()):
        if not taken[x] and not taken[y]:
            taken[x] = taken[y] = 1
            out.append(i)
    return np.array(sorted(out), np.int64)


def first_matching(edges: DataFrame, limit: int = DRIVER_EDGES) -> DataFrame:
    """The lexicographically first matching of ``edges(scene, src, dst, prio)`` in each scene, prio being distinct there.

    Up to ``limit`` edges are matched on the driver.  Above that, rounds take every edge that has the least prio at
    both its ends and remove what those ends touch; the same matching results (Blelloch, Fineman and Shun, 2012).
    """
    spark = edges.sparkSession
    columns = ["scene", "src", "dst", "prio"]
    edges = written(edges.select(*columns), "eligible")
    taken = []
    ends_of = lambda e, *more: e.select("scene", F.col("src").alias("node"), *more).unionAll(e.select("scene", F.col("dst").alias("node"), *more))
    while edges.count() > limit:
        least = ends_of(edges, "prio").groupBy("scene", "node").agg(F.min("prio").alias("least"))
        side = lambda c, name: least.select("scene", F.col("node").alias(c), F.col("least").alias(name))  # noqa: E731, B023
        with_least = edges.join(side("src", "l1"), ["scene", "src"]).join(side("dst", "l2"), ["scene", "dst"])
        won = written(with_least.filter("prio = l1 and prio = l2").select(*columns), "won")
        taken.append(won)
        gone = ends_of(won).distinct()
        rest = edges.join(gone.withColumnRenamed("node", "src"), ["scene", "src"], "left_anti").join(gone.withColumnRenamed("node", "dst"), ["scene", "dst"], "left_anti")
        edges = written(rest.select(*columns), "eligible")
    table = edges.toPandas()
    if len(table):
        keep = greedy(*(table[c].to_numpy() for c in ("src", "dst", "prio")), pd.factorize(table["scene"])[0])
        taken.append(spark.createDataFrame(table.iloc[keep], edges.schema))
    out = spark.createDataFrame([], edges.schema)
    for t in taken:
        out = out.unionByName(t)
    return out
