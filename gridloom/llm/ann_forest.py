"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm, which makes the largest inner product the
smallest angle.  A tree is a full binary tree of hyperplanes, each across the line between two sample vectors, at
the median of the node's sample.  A query walks all trees through one shared priority queue: the branch likeliest to
hold a neighbour comes next, whichever tree it is in, until a budget of leaves is gathered and those of one tree hold
k + 1 vectors (the query's own among them).  A margin m to a hyperplane gives the query's side the logistic probability
of m / ``spread``, a neighbour's typical deviation along a line; a branch has the product over its path.  The members of
those leaves are ranked by exact inner products in double precision, leaf by leaf as matrix products.

The queue runs for many queries at once.  As probabilities only fall down a tree, it yields leaves in the order of their
probabilities over all trees; so these are computed level by level and the first leaves taken.

The trees are fitted on a bounded sample (``sample`` vectors or SAMPLE_BYTES, those with the least hash), and so are
``spread`` and the budget: the leaves that ``target`` of the true neighbours within the sample take, of PROBES vectors
of it.  Clustered vectors need few leaves, vectors without structure many.  Every vector is indexed, in one leaf of each
tree; leaves per tree follow the number of vectors until the sample bounds them (8 of its vectors a leaf).

Leaves are dealt to cells, neighbouring ones to the same; a leaf of more than ``cell_rows`` members has several.  A query
goes to the cells that hold its leaves.  A task holds the members of one cell and passes its queries by them as a stream,
so no member is copied for queries and memory doesn't grow with their number.

Copies of a vector are indexed once, with the k + 1 least ids that have it; no other copy can be among the k
nearest of anything, ties going to the smaller id.

Rows: vectors that are null, zero, not of the table's most frequent dimension, or have null or non-finite
components take no part, nor do rows without id.  Rows equal in id and vector count once.  With fewer than k other
vectors all are returned; an empty table, or one without queries, gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: Bytes of the sample on the driver, as doubles, and sample vectors whose neighbours set the budget.
SAMPLE_BYTES, PROBES = 64 << 20, 256
#: Slope of the logistic curve that is closest to the normal one.
LOGISTIC = 1.702
#: Queries that walk the trees together, and scores of a cell that are held at once.
WALK, SCORES = 64, 4_000_000


@dataclass
class Forest:
    depth: int
    trees: int
    normals: list[np.ndarray]  # per level (trees * 2**level, dim + 1): the nodes of all trees, tree by tree
    offsets: list[np.ndarray]
    norm: float  # the largest norm of any vector
    spread: float  # how far a neighbour lies from a query along a line, the query having norm ``norm``

    @property
    def leaves(self) -> int:
        """Leaves of one tree; those of tree t are numbered from t * leaves."""
        return 1 << self.depth

    def extended(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.norm**2 - (x**2).sum(axis=1)))
        return np.concatenate((x, rest[:, None]), axis=1)

    def route(self, x: np.ndarray) -> np.ndarray:
        """(vectors, trees): the leaf of each vector in each tree, numbered over the whole forest."""
        x = self.extended(x)
        node = np.tile(np.arange(self.trees), (len(x), 1))
        for w, b in zip(self.normals, self.offsets):
            for t in range(self.trees):
                node[:, t] = 2 * node[:, t] + (np.einsum("ij,ij->i", x, w[node[:, t]]) > b[node[:, t]])
        return node

    def queue(self, x: np.ndarray, visit: int) -> np.ndarray:
        """(queries, at most ``visit``): the leaves that the shared queue yields first, in its order."""
        length = np.linalg.norm(x, axis=1)[:, None] / max(self.norm, 1e-300)
        x = np.concatenate((x, np.zeros((len(x), 1))), axis=1) / length
        cost = np.zeros((len(x), self.trees))  # -log of the probability
        for w, b in zip(self.normals, self.offsets):
            m = (x @ w.T - b) * (LOGISTIC / self.spread)
            right = np.logaddexp(0, -m)
            cost = np.stack((cost + right + m, cost + right), axis=2).reshape(len(x), -1)
        best = np.argpartition(cost, visit - 1, axis=1)[:, :visit]
        return np.take_along_axis(best, np.argsort(np.take_along_axis(cost, best, axis=1), axis=1, kind="stable"), axis=1)

    def leaves_of(self, x: np.ndarray, visit: int, sizes: np.ndarray | None = None, least: int = 0) -> list[np.ndarray]:
        """For each query the first ``visit`` leaves of the queue, or all if there are fewer.

        With ``sizes``, the members of each leaf, more leaves until those of some tree hold ``least``: a tree's leaves
        share no member, so as many distinct ones are found, or all leaves are visited.
        """
        all_ = self.trees * self.leaves
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(x)
        todo, visit = np.arange(len(x)), min(visit, all_)
        while len(todo):
            found = self.queue(x[todo], visit)
            enough = np.ones(len(todo), bool)
            if sizes is not None and visit < all_:
                held = np.stack([np.where(found // self.leaves == t, sizes[found], 0).sum(axis=1) for t in range(self.trees)])
                enough = held.max(axis=0) >= least
            for i in np.flatnonzero(enough):
                out[todo[i]] = found[i]
            todo, visit = todo[~enough], min(2 * visit, all_)
        return out


def grow(sample: np.ndarray, norm: float, trees: int, depth: int, seed: int = 3) -> Forest:
    f = Forest(depth, trees, [], [], norm, max(norm, 1e-300) / math.sqrt(sample.shape[1] + 1))
    x = f.extended(sample)
    rngs = [np.random.default_rng((seed, t)) for t in range(trees)]
    nodes = [np.arange(len(x))] * trees
    for _ in range(depth):
        w, b = np.zeros((len(nodes), x.shape[1])), np.zeros(len(nodes))
        children = []
        for k, at in enumerate(nodes):
            rng = rngs[k * trees // len(nodes)]
            d = np.subtract(*x[rng.choice(at, 2, replace=False)]) if len(at) >= 2 else rng.standard_normal(x.shape[1])
            w[k] = d / max(np.linalg.norm(d), 1e-300)
            p = x[at] @ w[k]
            b[k] = np.median(p) if len(at) else 0.0
            children += [at[p <= b[k]], at[p > b[k]]]
        nodes = children
        f.normals.append(w)
        f.offsets.append(b)
    return f


def tune(forest: Forest, sample: np.ndarray, k: int, target: float) -> int:
    """Set ``spread``; the leaves after which ``target`` of the k nearest within the sample are found, over PROBES of it."""
    every = forest.trees * forest.leaves
    n = min(PROBES, len(sample))
    if len(sample) <= k + 1:
        return every
    s = sample[:n] @ sample.T
    s[np.arange(n), np.arange(n)] = -np.inf
    near = np.argpartition(-s, k, axis=1)[:, :k]
    cosine = np.take_along_axis(s, near, axis=1) / np.maximum(np.linalg.norm(sample[:n], axis=1)[:, None] * forest.norm, 1e-300)
    apart = np.maximum(0.0, 2 - 2 * cosine).mean()  # squared distance of neighbours, in units of norm**2
    forest.spread = forest.norm * math.sqrt(max(apart, 1e-6) / (sample.shape[1] + 1))
    leaf = forest.route(sample)
    ranks = []
    for at in range(0, n, 64):
        place = np.argsort(forest.queue(sample[at : min(n, at + 64)], every), axis=1)  # when the queue yields each leaf
        own = near[at : at + 64]
        ranks.append(np.take_along_axis(place, leaf[own].reshape(len(own), -1), axis=1).reshape(len(own), k, -1).min(axis=2))
    ranks = np.sort(np.concatenate(ranks), axis=None)
    return int(ranks[math.ceil(target * len(ranks)) - 1]) + 1


def usable(embeddings: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, v`` of the rows that take part; single-precision components stay so, others become double."""
    kind = "float" if dict(embeddings.dtypes)[vector] == "array<float>" else "double"
    v = F.col(vector).cast(f"array<{kind}>")
    rows = embeddings.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null and size(v) > 0")
    return rows.filter("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x <> 0)")


def _merge(q: np.ndarray, c: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k distinct candidates of each query; equal scores go to the smaller candidate."""
    order = np.lexsort((c, -s, q))
    q, c, s = q[order], c[order], s[order]
    new = np.concatenate(([True], (q[1:] != q[:-1]) | (c[1:] != c[:-1])))[: len(q)]
    q, c, s = q[new], c[new], s[new]
    start = np.concatenate(([True], q[1:] != q[:-1]))[: len(q)]
    rank = np.arange(len(q)) - np.flatnonzero(start)[np.cumsum(start) - 1] if len(q) else np.zeros(0, int)
    keep = rank < k
    return q[keep], c[keep], s[keep]


class Cell:
    """The members of one cell, ordered by leaf, and the search among them."""

    def __init__(self, vectors: np.ndarray, leaf: np.ndarray, rep: np.ndarray):
        order = np.lexsort((rep, leaf))
        self.order, self.vectors, self.leaf, self.rep = order, vectors[order], leaf[order], rep[order]
        self.place = np.argsort(self.rep, kind="stable")  # members by id, and each one's number among them
        self.rank = np.empty(len(rep), np.int64)
        self.rank[self.place] = np.arange(len(rep))
        self.products = 0  # inner products made so far

    def nearest(self, queries: np.ndarray, visits: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, member's place, inner product): each query's best k among the members of the leaves it visits.

        Equal scores go to the smaller id.
        """
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        step = max(1, SCORES // max(1, len(self.leaf)))
        for at in range(0, len(queries), step):
            q, c, s = self._block(queries[at : at + step], visits[at : at + step], k)
            parts.append((q + at, c, s))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _block(self, queries: np.ndarray, visits: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(self.leaf)
        who, what = np.repeat(np.arange(len(queries)), [len(v) for v in visits]), np.concatenate(visits)
        order = np.argsort(what, kind="stable")
        who, what = who[order], what[order]
        scores = np.full((len(queries), -(-n // 64), 64), -np.inf)
        flat = scores.reshape(len(queries), -1)
        cuts = np.flatnonzero(np.concatenate(([True], what[1:] != what[:-1], [True]))) if len(what) else np.zeros(1, int)
        los, his = (np.searchsorted(self.leaf, what[cuts[:-1]], side).tolist() for side in ("left", "right"))
        for a, b, lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), los, his):
            if lo < hi:
                flat[who[a:b], lo:hi] = queries[who[a:b]] @ self.vectors[lo:hi].T
                self.products += (b - a) * (hi - lo)
        # the k-th best of the maxima of groups of 64 is a bound for the k-th best score; only groups that reach it are looked into
        top = scores.max(axis=2)
        least = np.partition(top, top.shape[1] - k, axis=1)[:, -k] if top.shape[1] > k else np.full(len(queries), -np.inf)
        least = np.where(np.isfinite(least), least - 1e-9 * (1 + np.abs(least)), -np.finfo(float).max)  # less rounding: ties are settled below
        of, group = np.nonzero(top >= least[:, None])
        row, c = np.nonzero(scores[of, group] >= least[of, None])
        q, c = of[row], group[row] * 64 + c
        s = np.einsum("ij,ij->i", queries[q], self.vectors[c])  # one fixed order of summation
        q, r, s = _merge(q, self.rank[c], s, k)
        return q, self.place[r], s


def _matrix(column: pa.ListArray) -> np.ndarray:
    """A column of equally long lists as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _split(column: pa.ListArray) -> list[np.ndarray]:
    return np.split(column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))[:-1]) if len(column) else []


def rank_stream(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """``q, c, score, ids`` from rows ``cell, kind, id, ids, v, leaf`` sorted by cell and kind: members (0), then queries (1)."""
    held: list[pa.RecordBatch] = []
    cell: Cell | None = None
    at = ids = None
    for batch in batches:
        code = batch.column("cell").to_numpy().astype(np.int64) * 2 + batch.column("kind").to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1], [True]))) if len(code) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = batch.slice(a, b - a)
            if code[a] // 2 != at:
                at, held, cell = code[a] // 2, [], None
            if code[a] % 2 == 0:
                held.append(part)
                continue
            if cell is None and held:
                whole = pa.Table.from_batches(held).combine_chunks()
                column = lambda name: whole.column(name).combine_chunks()  # noqa: E731, B023
                cell = Cell(_matrix(column("v")), column("leaf").flatten().to_numpy(), column("id").to_numpy())
                ids, held = column("ids").take(pa.array(cell.order)), []
            for lo in range(0, part.num_rows if cell else 0, 1024):
                some = part.slice(lo, 1024)
                q, c, s = cell.nearest(_matrix(some.column("v")), _split(some.column("leaf")), k)
                yield pa.RecordBatch.from_arrays([some.column("id").take(pa.array(q)), pa.array(cell.rep[c]), pa.array(s), ids.take(pa.array(c))], names=["q", "c", "score", "ids"])


def deal(sizes: np.ndarray, trees: int, cell_rows: int) -> tuple[np.ndarray, np.ndarray, int]:
    """First cell and number of cells of each leaf, and the number of all cells; no cell holds leaves of two trees."""
    first, spread, cells = np.zeros(len(sizes), np.int32), np.ones(len(sizes), np.int32), 0
    for own in np.split(np.arange(len(sizes)), trees):
        room = 0
        for leaf in own.tolist():
            n = int(sizes[leaf])
            if n > cell_rows:
                first[leaf], spread[leaf], room = cells, math.ceil(n / cell_rows), 0
                cells += int(spread[leaf])
                continue
            if n > room:
                room, cells = cell_rows, cells + 1
            first[leaf], room = max(0, cells - 1), room - n
    return first, spread, max(1, cells)


def search(embeddings: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", trees: int = 4, target: float = 0.93, visit: float | None = None, leaf_size: int = 12, sample: int = 32_768, cell_rows: int = 65_536) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row with ``is_query``, its k nearest other rows found, nearest first.

    ``target`` is the recall that sets the budget of leaves; ``visit``, if given, is that budget, as a share of all leaves.
    """
    spark = embeddings.sparkSession
    schema = T.StructType.fromDDL("query_id long, rank int, vec_id long, score double")
    rows = usable(embeddings, key, vector)
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if width is None:
        return spark.createDataFrame([], schema)
    dim = width.n
    ranked = rows.filter(F.size("v") == dim).selectExpr("id", "v", "dense_rank() over (partition by v order by id) r").filter(F.col("r") <= k + 1)
    vectors = ranked.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    vectors = written(vectors.select(F.element_at("ids", 1).alias("rep"), "ids", "v", norm.alias("norm")), "vectors")
    count, longest = vectors.agg(F.count(F.lit(1)), F.max("norm")).first()

    sample = max(1, min(sample, SAMPLE_BYTES // (8 * dim)))
    picked = vectors.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(sample).select("v").toArrow().column("v").combine_chunks()
    x = _matrix(picked)
    depth = max(0, min(max(4, round(math.log2(max(1.0, count / leaf_size)))), int(math.log2(max(1, len(x) // 8)))))
    forest = grow(x, longest, trees, depth)
    every = trees * forest.leaves
    wanted = tune(forest, x, k, target) if visit is None else max(1, math.ceil(visit * every))
    given = spark.sparkContext.broadcast(forest)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                leaf = given.value.route(_matrix(b.column("v"))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, leaf.size + 1, trees), pa.int32()), pa.array(leaf.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("ids"), b.column("v"), lists], names=["rep", "ids", "v", "leaf"])

    kind = dict(vectors.dtypes)["v"]
    routed = written(vectors.select("rep", "ids", "v").mapInArrow(route, f"rep long, ids array<long>, v {kind}, leaf array<int>"), "routed")
    sizes = np.zeros(every, np.int64)
    for r in routed.select(F.explode("leaf").alias("leaf")).groupBy("leaf").count().collect():  # trees * leaves rows at most
        sizes[r.leaf] = r["count"]
    # few vectors get smaller cells, so that there are tasks enough
    first, spread, cells = deal(sizes, trees, min(cell_rows, max(4096, count * trees // 16)))

    owners = written(rows_of(embeddings, is_query, key, vector, dim).join(vectors.select("v", "rep"), "v").select(F.col("id").alias("query_id"), "rep").distinct(), "owners")
    q = vectors.select("rep", "v").join(owners.select("rep").distinct(), "rep", "left_semi")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, WALK):
                b = batch.slice(at, WALK)
                found = given.value.leaves_of(_matrix(b.column("v")), wanted, sizes, k + 1)
                leaf = np.concatenate(found)
                who = np.repeat(np.arange(len(found)), [len(f) for f in found])
                n = spread[leaf]
                part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                leaf, who, cell = np.repeat(leaf, n), np.repeat(who, n), np.repeat(first[leaf], n) + part
                order = np.argsort(who * np.int64(cells) + cell, kind="stable")  # a query's leaves stay in the queue's order
                leaf, who, cell = leaf[order], who[order], cell[order]
                cuts = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (cell[1:] != cell[:-1]), [True])))
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(leaf.astype(np.int32)))
                own = pa.array(who[cuts[:-1]])
                names = ["cell", "id", "v", "leaf"]
                yield pa.RecordBatch.from_arrays([pa.array(cell[cuts[:-1]].astype(np.int32)), b.column("rep").take(own), b.column("v").take(own), lists], names=names)

    asks = q.mapInArrow(walk, f"cell int, id long, v {kind}, leaf array<int>")
    places = spark.createDataFrame(list(zip(range(every), first.tolist(), spread.tolist())), "at int, first int, spread int")
    member = routed.select("rep", "ids", "v", F.explode("leaf").alias("at")).join(F.broadcast(places), "at")
    member = member.select((F.col("first") + F.pmod(F.xxhash64("rep"), F.col("spread"))).cast("int").alias("cell"), F.lit(0).alias("kind"), F.col("rep").alias("id"), "ids", "v", F.array("at").alias("leaf"))
    asks = asks.select("cell", F.lit(1).alias("kind"), "id", F.array().cast("array<long>").alias("ids"), "v", "leaf")
    stream = member.unionAll(asks).repartitionById(cells, "cell").sortWithinPartitions("cell", "kind")
    found = stream.mapInArrow(lambda batches: rank_stream(batches, k + 1), "q long, c long, score double, ids array<long>")

    best = found.selectExpr("q", "c", "score", "ids", "dense_rank() over (partition by q order by score desc, c) r").filter(F.col("r") <= k + 1)
    lists = best.dropDuplicates(["q", "c"]).groupBy(F.col("q").alias("rep")).agg(F.collect_list(F.struct("score", "ids")).alias("near"))
    each = F.flatten(F.transform("near", lambda n: F.transform(n["ids"], lambda i: F.struct((-n["score"]).alias("less"), i.alias("id")))))
    out = owners.join(lists.withColumn("near", F.array_sort(each)), "rep")
    out = out.select("query_id", F.posexplode(F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.less")).alias("score"))


def rows_of(embeddings: DataFrame, is_query: Column, key: str, vector: str, dim: int) -> DataFrame:
    """The queries among the usable rows."""
    return usable(embeddings.filter(is_query), key, vector).filter(F.size("v") == dim)
