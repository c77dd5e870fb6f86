"""What the corpus operators share: row filters by id, samples, word hashes, small statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..storage import scratch, shared_dir, written

__all__ = ["auc", "bounded_sample", "components", "kept", "likely", "logistic", "marked", "mix", "scratch", "shared_dir", "utf8", "word_hashes", "written"]

#: Bits of the largest filter that :func:`likely` makes: 32 MB, whatever the number of ids.
FILTER_BITS = 1 << 28


def marked(rows: DataFrame, ids: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with ``name``: true where ``key`` is among ``ids`` (a column of that name), and in a few other rows.

    A bitmap of hashed ids, of bounded size, is broadcast: nothing is shuffled.  Rows without key may be true too.
    """
    bits = min(FILTER_BITS, 1 << max(15, (16 * ids.count()).bit_length()))
    at = lambda: F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    marks = ids.select(at().alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumns({"_bucket": F.bitmap_bucket_number(at()), "_bit": F.bitmap_bit_position(at())}).join(F.broadcast(marks), "_bucket", "left")
    bit = F.pmod(F.floor(byte / F.pow(F.lit(2), F.col("_bit") % 8)), F.lit(2)) == 1
    return found.select(*[F.col(c) for c in rows.columns], F.coalesce(bit, F.lit(False)).alias(name))


def likely(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The ``rows`` whose ``key`` is among ``ids``, and a few others; callers join the result by id."""
    return marked(rows, ids, key, "_likely").filter("_likely").select(*rows.columns)


def kept(docs: DataFrame, decide: Callable[[pa.Array], np.ndarray], column: str = "text", size: int = 512) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose ``column`` is decided for; ``size`` rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                yield part.filter(pa.array(decide(part.column(column)), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def utf8(column) -> list[bytes | None]:
    """The values of an Arrow string column as UTF-8 bytes."""
    return column.cast(pa.large_binary()).to_pylist()


_RNG = np.random.default_rng(20240607)
#: One random odd-ish 64-bit value for each byte; the hash of a word is a polynomial in them.
BYTE_HASH = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes], lower: bytes, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of ``texts`` in order, and for each text the index of its first word (n + 1 values).

    ``lower`` translates bytes first; ``word_byte`` tells for each byte whether it belongs to words.
    """
    hashes, firsts, base = [], [0], 0
    block: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal base
        if not block:
            return
        buf = np.frombuffer(b"\x00".join(block).translate(lower) + b"\x00", np.uint8)
        inside = word_byte[buf]
        cuts = np.cumsum([len(x) + 1 for x in block]) - 1
        inside[cuts] = False
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).view(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        n = len(buf)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_HASH[buf] * powers(_P, n)[:n], out=total[1:])
        h = (total[ends] - total[starts]) * powers(_P_INV, n)[starts]
        hashes.append(mix(h + (ends - starts).astype(np.uint64)))
        firsts.extend((base + np.searchsorted(starts, cuts)).tolist())
        base += len(starts)
        block.clear()

    for t in texts:
        block.append(t)
        size += len(t)
        if size >= 2_000_000:
            flush()
            size = 0
    flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.asarray(firsts, np.int64)


def bounded_sample(docs: DataFrame, labels: DataFrame | None, label: str, per_class: int, max_bytes: int) -> list[tuple]:
    """(label, text) of at most ``per_class`` distinct texts of each class, those with the least hash.

    ``docs`` has doc_id and text, and the label column itself if ``labels`` (doc_id, label) is None.  Texts over
    ``max_bytes`` bytes, empty texts and null labels are passed over; ids with several labels are too.  What
    reaches the driver is bounded by per_class * classes * max_bytes.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", *([label] if labels is None else []), F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"))
    if labels is not None:
        one = labels.filter(F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias(label), F.max(label).alias("other")).filter(f"{label} = other").drop("other")
        rows = rows.join(one, "doc_id")
    rows = rows.filter(F.col(label).isNotNull() & F.col("n").between(1, max_bytes)).groupBy(label, "h").agg(F.min("doc_id").alias("doc_id"))
    rows = written(rows, "hashes")
    classes = sorted(r[0] for r in rows.select(label).distinct().collect())
    chosen = []
    for c in classes:
        chosen += [(c, r.h, r.doc_id) for r in rows.filter(F.col(label) == F.lit(c)).filter("doc_id is not null").orderBy("h").limit(per_class).collect()]
    if not chosen:
        return []
    kind = dict(rows.dtypes)[label]
    wanted = F.broadcast(spark.createDataFrame(chosen, f"label {kind}, h long, doc_id long"))
    texts = docs.select("doc_id", "text").withColumn("h", F.xxhash64("text")).join(wanted, ["doc_id", "h"]).select("label", "h", "text").collect()
    return [(r.label, r.text) for r in sorted({(r.label, r.h, r.text): r for r in texts}.values(), key=lambda r: (r.label, r.h))]


def auc(score: np.ndarray, positive: np.ndarray) -> float:
    """Area under the ROC curve; ties count half."""
    values, at, count = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[at]
    p, n = int(positive.sum()), int((~positive).sum())
    return float((rank[positive].sum() - p * (p + 1) / 2) / (p * n)) if p and n else float("nan")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50, weight: np.ndarray | float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression (Newton's method); a column of ones belongs in ``x``, ``weight`` is the rows'."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) / len(y) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w
