"""MinHash near-duplicates by tensored banding.

Two collections of ``tables`` half-keys, each made of ``rows`` minhashes, are combined pairwise: table (i, j) is
keyed by half i of the first collection and half j of the second.  So tables**2 tables need only
2 * tables * rows minhashes, roughly the square root of what independent bands take.  A pair of Jaccard
similarity s meets in some table unless it misses every half-key of one collection:
1 - (1 - (1 - s**rows)**tables)**2, which is below 1e-5 at s = 0.8 for 2 rows and 12 half-keys.

A document is a ``doc_id``; it has the sets of all rows with that id.  Equal sets are collapsed to one node first, held
by the least document that has the set, so groups of copies of any size cost one row.  Then

1. every member of a bucket is compared with the bucket's most central member, the one that meets most others
   over all tables (a star, linear in the bucket), and linked members are joined to components;
2. the same with the next LEADERS members, for buckets that still hold several components;
3. members of larger buckets that hold several components even then are compared in full, across components only:
   cells of equal half-keys of the first collection are compared as blocks of sketches, each pair in the first
   cell that it shares, and only pairs that may be alike leave a cell.

Candidates must have sizes that allow the similarity, pass estimates (five standard deviations of slack) from one bit
of each minhash and then from all of them, or in the third step from the least shingle hashes, which for small sets are
all there are; they are then confirmed on their full shingle sets, JVM-side.  No pair inside a component already found
is made again.

Keys and sets that many rows share are salted: they are dealt to SALTS tasks, and what is joined to them is copied to
each.  Which keys are hot is counted on a sample, and at most one key in HOT_SHARE of a table's rows can be, so their list
is bounded; it decides where rows go, never what comes out.

Rows: a null or wordless text has an empty set and is linked with nothing; so is a row without ``doc_id``
(component null, kept).  A text of fewer words than a shingle has one shingle, its whole word sequence.
Repeated rows are copies of each other.  Rows with the same ``doc_id`` and other texts are one document: it is linked
through each of its texts, and its rows share a component.
Columns other than ``doc_id`` and ``text`` are not read, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, likely, mix, utf8, word_hashes, written

#: Members of a bucket that all others are compared with before a bucket is compared in full.
LEADERS = 6
#: Shingle hashes of a sketch, and members of a block, in the comparison of cells.
SKETCH, BLOCK = 256, 512
#: Minhashes of a signature; tables use the first 2 * rows * tables of them, estimates use all.
SIGNATURE = 64
#: A key is hot if it has more than HOT rows and more than one in HOT_SHARE; a hot key goes to SALTS tasks.
HOT, HOT_SHARE, SALTS = 1024, 4096, 32

LOWER = bytes(range(256)).lower()
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_SHORT = np.uint64(0xA24BAED4963EE407)


def shingle_sets(texts: list[bytes | None], words: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles as sorted 64-bit hashes; they stand for the shingles themselves."""
    h, first = word_hashes([t or b"" for t in texts], LOWER, WORD_BYTE)
    for i in range(len(texts)):
        w = h[first[i] : first[i + 1]]
        if len(w) >= words:
            x = w[: len(w) - words + 1].copy()
            for k in range(1, words):
                x = mix(x * np.uint64(0x9FB21C651E98DF25) + w[k : len(w) - words + 1 + k])
        elif len(w):
            x = np.full(1, _SHORT + np.uint64(len(w)), np.uint64)
            for v in w:
                x = mix(x * np.uint64(0x9FB21C651E98DF25) + v)
        else:
            x = w
        x = np.sort(x)
        yield x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) > 1 else x


def minhash_multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhashes(s: np.ndarray, mult: np.ndarray) -> np.ndarray:
    out = np.full(len(mult), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        np.minimum(out, (mult[:, None] * s[None, at : at + 2048]).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame, words: int, rows: int, tables: int, seed: int) -> DataFrame:
    """``doc_id, n_shingles, set_a, set_b`` (a 128-bit digest of the set) and ``sig``, null for empty sets."""
    mult = minhash_multipliers(max(SIGNATURE, 2 * rows * tables), seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            n, digests, sig = [], [], []
            for s in shingle_sets(utf8(batch.column("text")), words):
                n.append(len(s))
                digests.append(digest(s) if len(s) else (None, None))
                sig.append(minhashes(s, mult) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array(sig, pa.list_(pa.int32()))],
                names=["doc_id", "n_shingles", "set_a", "set_b", "sig"],
            )

    schema = "doc_id long, n_shingles long, set_a long, set_b long, sig array<int>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """``id, set_a, shingles``: the full sets, as sorted arrays of 64-bit hashes; of repeated rows a task passes on one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for i, t in zip(part.column("doc_id").to_pylist(), utf8(part.column("text"))):
                    key = (i, hash(t))
                    if key not in seen:
                        seen.add(key)
                        rows.append((i, t))
                if rows:
                    sets = list(shingle_sets([t for _, t in rows], words))
                    cols = [pa.array(x, pa.int64()) for x in ([i for i, _ in rows], [digest(s)[0] for s in sets])]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "set_a", "shingles"])

    return docs.mapInArrow(run, "id long, set_a long, shingles array<long>")


def digest(s: np.ndarray) -> np.ndarray:
    """128 bits that stand for a set, as two integers."""
    import xxhash

    return np.frombuffer(xxhash.xxh128_digest(s.tobytes()), np.int64)


def sketches_of(docs: DataFrame, words: int) -> DataFrame:
    """``id, set_a, set_b, sketch``: the least ``SKETCH`` shingle hashes, by their upper 32 bits, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            sets = [(digest(s), np.unique((s[:SKETCH] >> np.uint64(32)).astype(np.int64))) for s in shingle_sets(utf8(batch.column("text")), words)]
            cols = [pa.array([d[k] for d, _ in sets], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols, pa.array([x for _, x in sets], pa.list_(pa.int64()))], names=["id", "set_a", "set_b", "sketch"])

    found = docs.mapInArrow(run, "id long, set_a long, set_b long, sketch array<long>")
    return found.withColumn("sketch", F.transform("sketch", lambda x: (x - 2**31).cast("int")))


def compare_cell(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Pairs of one cell, one member marked ``frag``, that may be alike: other components, sizes, sketches.

    ``place`` is the cell's number in the first collection; a pair belongs to the first cell that it shares, and
    must share some half-key of the second collection.
    """
    none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    frag = rows[rows["frag"]]
    other = rows[~rows["frag"]]
    if not len(frag) or not len(other):
        return none
    place, need = int(rows["place"].iloc[0]), percent / 100
    code, unique = pd.factorize(np.concatenate([*frag["sketch"], *other["sketch"]]))
    fs, os_ = (part["sketch"].map(len).to_numpy() for part in (frag, other))
    cut = int(fs.sum())
    # only hashes on both sides count; they are numbered anew
    common = np.zeros(len(unique), np.int8)
    common[code[:cut]] |= 1
    common[code[cut:]] |= 2
    number = np.where(common == 3, np.cumsum(common == 3) - 1, -1)[code]
    width = int((common == 3).sum())
    sides = [(np.repeat(np.arange(len(n)), n), part) for n, part in ((fs, number[:cut]), (os_, number[cut:]))]

    def overlap(k: slice) -> np.ndarray:
        """Common hashes of some of ``frag`` with all of ``other``, by blocks of columns."""
        out = np.zeros((len(fs[k]), len(os_)), np.float32)
        for lo in range(0, width, 4096):
            block = []
            for (row, col), (first, n) in zip(sides, ((k.start, len(fs[k])), (0, len(os_)))):
                here = (col >= lo) & (col < lo + 4096) & (row >= first) & (row < first + n)
                m = np.zeros((n, min(4096, width - lo)), np.float32)
                m[row[here] - first, col[here] - lo] = 1
                block.append(m)
            out += block[0] @ block[1].T
        return out

    fx, fy, ox, oy = (np.stack(p[c].to_numpy()) for p in (frag, other) for c in ("x", "y"))
    fn, on = frag["n"].to_numpy(), other["n"].to_numpy()
    a, b = [], []
    for lo in range(0, len(frag), 256):
        k = slice(lo, lo + 256)
        both = overlap(k)
        ok = frag["c"].to_numpy()[k, None] != other["c"].to_numpy()[None]
        ok &= need * np.maximum(fn[k, None], on[None]) <= np.minimum(fn[k, None], on[None])
        for i in range(place):
            ok &= fx[k, None, i] != ox[None, :, i]
        shared = np.zeros_like(ok)
        for j in range(fy.shape[1]):
            shared |= fy[k, None, j] == oy[None, :, j]
        ok &= shared
        whole = (fn[k, None] <= SKETCH) & (on[None] <= SKETCH)
        # whole sets: the similarity itself, but for equal upper halves of hashes; else what a union's sketch holds
        enough = np.where(whole, need / (1 + need) * (fs[k, None] + os_[None]) - 2, need * SKETCH - slack(SKETCH, need))
        r, c = np.nonzero(ok & (both >= enough))
        a.append(lo + r)
        b.append(c)
    a, b = np.concatenate(a), np.concatenate(b)
    if not len(a):
        return none
    keep = np.ones(len(a), bool)
    xs, ys = frag["sketch"].to_numpy(), other["sketch"].to_numpy()
    for i in np.flatnonzero(np.maximum(fn[a], on[b]) > SKETCH):  # an estimate from the least hashes of the union
        x, y = xs[a[i]], ys[b[i]]
        least = np.union1d(x, y)[:SKETCH]
        hits = np.isin(least, x, assume_unique=True) & np.isin(least, y, assume_unique=True)
        keep[i] = hits.sum() >= need * len(least) - slack(len(least), need)
    a, b = frag["node"].to_numpy()[a], other["node"].to_numpy()[b]
    return pd.DataFrame({"a": np.maximum(a, b)[keep], "b": np.minimum(a, b)[keep]})


class Salt:
    """Which values of ``on`` are hot, and how rows are dealt by them."""

    def __init__(self, on: list[str], hot: DataFrame | None):
        self.on = on
        self.hot = None if hot is None or hot.isEmpty() else hot.select(*on, F.lit(True).alias("_hot"))

    def _flagged(self, rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(self.hot), self.on, "left") if self.hot is not None else rows.withColumn("_hot", F.lit(None).cast("boolean"))

    def salted(self, rows: DataFrame, by: str) -> DataFrame:
        """``rows`` with ``salt``: rows of a hot value are dealt by a hash of the column ``by``, others have 0."""
        return self._flagged(rows).withColumn("salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")

    def spread(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``salt``: one copy for each that rows of its value can have."""
        every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        return self._flagged(rows).withColumn("salt", F.explode(every)).drop("_hot")


def _mixed(rows: DataFrame, salt: Salt) -> DataFrame:
    """The rows (``key, salt, c``) of keys with several components: their bounds by an aggregate combined before the shuffle."""
    bounds = rows.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 <> c1").select("key")
    return rows.join(salt.spread(bounds), ["key", "salt"])


def across(members: DataFrame, salt: Salt, found: DataFrame, reps: DataFrame, docs: DataFrame, words: int, percent: int, rows: int, tables: int) -> DataFrame:
    """Pairs (a, b) that may be alike among members of larger buckets, across components."""
    label = lambda df: df.join(found, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    # buckets of up to 2 + LEADERS members have been compared in full with their leaders
    wanted = _mixed(label(members.filter(F.col("met") > 2 + LEADERS).select("node", "id", "key", "salt")), salt).select("node").distinct()
    halves = [F.array(*[half_key(side, i, rows, tables) for i in range(tables)]) for side in (0, 1)]
    own = written(label(reps.join(wanted, "node")).select("node", "id", "set_a", "set_b", "c", "n", halves[0].alias("x"), halves[1].alias("y")), "wanted")
    if own.isEmpty():
        return own.selectExpr("node a", "node b").limit(0)
    cells = own.select("node", "c", F.posexplode("x").alias("place", "key"))
    per = cells.groupBy("place", "key", "c").agg(F.count(F.lit(1)).alias("size"))
    per = per.groupBy("place", "key").agg(F.max(F.struct("size", "c")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("size").alias("total")).filter("parts > 1")
    per = per.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # cells of any size go to as many tasks
    cells = cells.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(per, ["place", "key", "salt"]).withColumn("frag", F.col("c") != F.col("main.c"))
    texts = likely(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), own.select(F.col("id").alias("doc_id")), "doc_id")
    key = ["id", "set_a", "set_b"]
    sketched = own.select("node", *key, "n", "x", "y").join(sketches_of(texts, words).dropDuplicates(key), key).drop(*key)
    sketched = written(sketched, "sketches")
    # blocks of all members against blocks of those outside the cell's main component
    count = F.ceil(F.col("total") / BLOCK).cast("int")
    few = F.ceil((F.col("total") - F.col("main.size")) / BLOCK).cast("int")
    block = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    as_other = cells.select("node", "c", "place", "key", F.lit(False).alias("frag"), block(count).alias("ob"), F.explode(F.sequence(F.lit(0), few - 1)).alias("fb"))
    as_frag = cells.filter("frag").select("node", "c", "place", "key", F.lit(True).alias("frag"), F.explode(F.sequence(F.lit(0), count - 1)).alias("ob"), block(few).alias("fb"))
    rows_ = as_other.unionByName(as_frag).join(sketched, "node")
    pairs = rows_.groupBy("place", "key", "ob", "fb").applyInPandas(lambda pdf: compare_cell(pdf, percent), "a long, b long")
    return pairs.distinct()


def half_key(side: int, i: int, rows: int, tables: int) -> Column:
    return F.xxhash64(F.lit(side), F.lit(i), *[F.element_at("sig", 1 + (side * tables + i) * rows + r) for r in range(rows)])


def table_keys(reps: DataFrame, rows: int, tables: int) -> DataFrame:
    """``node, key``: one row for each of the tables**2 tables."""
    halves = reps.select("node", *[F.array(*[half_key(side, i, rows, tables) for i in range(tables)]).alias(name) for side, name in enumerate("xy")])
    return halves.select("node", F.explode("x").alias("x"), "y").select("node", "x", F.explode("y").alias("y")).select("node", F.xxhash64("x", "y").alias("key"))


def slack(n: int, p: float) -> float:
    """Five standard deviations of a count of ``n`` trials."""
    return 5 * (n * p * (1 - p)) ** 0.5


def _alike(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs of nodes whose signatures leave ``percent`` possible."""
    left = reps.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
    right = reps.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
    same = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v)
    k, p = F.size("sig_a"), percent / 100
    return pairs.join(left, "a").join(right, "b").filter(same >= k * p - 5 * F.sqrt(k * p * (1 - p))).select("a", "b")


def _confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The documents (a, b) of the pairs of nodes with 100 * intersection >= percent * union, on full sets."""
    end = lambda c: reps.select(F.col("node").alias(c), F.col("id").alias(f"id_{c}"), F.col("set_a").alias(f"h_{c}"))
    ends = written(pairs.join(end("a"), "a").join(end("b"), "b").drop("a", "b"), "ends")
    ids = ends.select(F.col("id_a").alias("doc_id")).unionAll(ends.select(F.col("id_b").alias("doc_id"))).distinct()
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sets = written(sets_of(likely(texts, ids, "doc_id"), words), "sets")
    side = lambda c: sets.select(F.col("id").alias(f"id_{c}"), F.col("set_a").alias(f"h_{c}"), F.col("shingles").alias(f"s_{c}"))
    both = ends.join(side("a"), ["id_a", "h_a"]).join(side("b"), ["id_b", "h_b"])
    inter = F.size(F.array_intersect("s_a", "s_b"))
    return both.filter(100 * inter >= percent * (F.size("s_a") + F.size("s_b") - inter)).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def _extended(found: DataFrame, pairs: DataFrame, reps: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Components ``found``, joined along those ``pairs`` that are confirmed."""
    if pairs.isEmpty():
        return found
    edges = found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(_confirmed(pairs, reps, docs, words, percent))
    return written(components(edges), "found")


def _hot_keys(reps: DataFrame, count: int, rows: int, tables: int) -> DataFrame:
    """Table keys with more than HOT of ``count`` sets and more than one in HOT_SHARE, by a sample of one set in 16."""
    some = table_keys(reps.filter(F.pmod(F.xxhash64("node"), F.lit(16)) == 0), rows, tables)
    return some.groupBy("key").count().filter(F.col("count") > max(HOT, count / HOT_SHARE) / 16).select("key")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, rows: int = 2, tables: int = 12, seed: int = 11) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Texts are linked at Jaccard similarity >= ``percent`` / 100 of their distinct ``words``-word shingles.
    """
    signed = written(signatures(docs, words, rows, tables, seed), "signed")
    sets = ["set_a", "set_b"]
    linkable = signed.filter("sig is not null and doc_id is not null")
    classes = linkable.groupBy(*sets).agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("size"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    bits = F.aggregate("sig", F.lit(0).cast("long"), lambda s, v: F.shiftleft(s, 1).bitwiseXOR(v.bitwiseAND(1)))
    reps = written(classes.withColumns({"bits": bits, "node": F.monotonically_increasing_id()}), "reps")  # written, so nodes stay
    count, copies = reps.agg(F.count(F.lit(1)), F.sum("size")).first()

    salt = Salt(["key"], written(_hot_keys(reps, count, rows, tables), "hot"))
    members = salt.salted(table_keys(reps, rows, tables), "node").selectExpr("node", "key", "salt", "count(1) over (partition by key, salt) met")
    if salt.hot is None:
        members = written(members.filter("met > 1"), "members")
    else:  # a hot key's count is the sum of its salts'
        members = written(members.join(F.broadcast(salt.hot), "key", "left").filter("met > 1 or _hot"), "members")
        total = members.filter("_hot").groupBy("key").agg(F.count(F.lit(1)).alias("total"))
        members = members.join(F.broadcast(total), "key", "left").select("node", "key", "salt", F.coalesce("total", "met").alias("met"))
    central = members.groupBy("node").agg(F.sum("met").alias("central"))
    known = written(members.join(central, "node").join(reps.select("node", "id", "n", "bits"), "node"), "known")
    ranked = known.selectExpr("node b", "id id_b", "key", "n n_b", "bits bits_b", "row_number() over (partition by key order by central desc, id, node) rank")
    leaders = written(ranked.filter(F.col("rank") <= 1 + LEADERS), "leaders")
    far = 0.5 * (1 - percent / 100)
    near = F.expr(f"node <> b and 100 * least(n, n_b) >= {percent} * greatest(n, n_b) and bit_count(bits ^ bits_b) <= {SIGNATURE * far + slack(SIGNATURE, far)}")
    pair = [F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")]

    star = known.join(salt.spread(leaders.filter("rank = 1")), ["key", "salt"]).filter(near)
    star = written(_alike(star.select(*pair).distinct(), reps, percent), "star")
    found = written(components(_confirmed(star, reps, docs, words, percent)), "found")
    label = lambda df, id_, c: df.join(found.select(F.col("id").alias(id_), "component"), id_, "left").withColumn(c, F.coalesce("component", id_)).drop("component")
    at = _mixed(label(known.filter("met > 2"), "id", "c"), salt)
    led = salt.spread(label(leaders.filter("rank > 1"), "id_b", "c_b"))
    pairs = at.join(led, ["key", "salt"]).filter(near).filter("c <> c_b").select(*pair).distinct()
    led = written(_alike(pairs.join(star, ["a", "b"], "left_anti"), reps, percent), "led")
    found = _extended(found, led, reps, docs, words, percent)
    cross = written(across(known, salt, found, reps, docs, words, percent, rows, tables), "cross")
    found = _extended(found, cross, reps, docs, words, percent)

    # documents with several sets join what those are in
    several = linkable.groupBy("doc_id").agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in sets]).filter("min_set_a <> max_set_a or min_set_b <> max_set_b").select("doc_id")
    same = written(linkable.select("doc_id", *sets).join(several, "doc_id").join(reps.select(*sets, "id"), sets).filter("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b")).distinct(), "same")
    if not same.isEmpty():
        found = written(components(same.unionAll(found.select(F.col("id").alias("a"), F.col("component").alias("b")))), "found")

    groups = reps.select(*sets, "size", "id").join(found, "id", "left").select(*sets, "size", F.coalesce("component", "id").alias("root"))
    hot = Salt(sets, reps.filter(F.col("size") > max(HOT, (copies or 0) / HOT_SHARE)).select(*sets))
    out = hot.salted(signed.select("doc_id", "n_shingles", *sets, F.monotonically_increasing_id().alias("row")), "row").join(hot.spread(groups), [*sets, "salt"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
