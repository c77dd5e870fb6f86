"""Packing of tokenised documents into fixed-length sequences.

Each document is its token ids and an end id.  It is cut into full sequences and one remainder; remainders are
packed first-fit decreasing, the first bin with room being found in a tournament tree of bin capacities, within
randomised groups of documents.  Groups are independent, so packing spreads over any number of tasks, and a group
holds ``group_docs`` documents however many there are.

Rows: a null or empty text is just the end id.  A long text is cut into as many pieces as it takes; its ids are
held by one task while it is tokenised.  Repeated rows are packed each for itself.  Other columns are not read.
An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import json
import math
import struct
from collections import Counter
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8


class ByteBPE:
    """Ids of a byte-level BPE file of the ``tokenizers`` library, with ``add_special_tokens=False``.

    ``ranks`` names the same vocabulary as ranks; with it the ids, which are the same, come several times faster.
    Texts that hold a special token's string go through ``tokenizers`` itself, which gives that token's id.
    """

    def __init__(self, vocabulary: str, ranks: str | None = None, pattern: str | None = None):
        self.vocabulary, self.fast = vocabulary, None
        with open(vocabulary, encoding="utf-8") as f:
            whole = f.read()
        at = whole.find('"added_tokens"')  # only that list is decoded
        added = json.JSONDecoder().raw_decode(whole, whole.index("[", at))[0] if at >= 0 else []
        self.special = [t["content"] for t in added]
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    @cached_property
    def exact(self):  # noqa: ANN201
        """The library's own tokenizer, loaded when it is first needed."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.vocabulary)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


@cache
def tokenizer(vocabulary: str, ranks: str | None, pattern: str | None) -> ByteBPE:
    return ByteBPE(vocabulary, ranks, pattern)


def cut(docs: DataFrame, vocabulary: str, ranks: str | None = None, pattern: str | None = None, length: int = 1024, end_id: int = 0) -> DataFrame:
    """``doc_id, deal, start, length, doc_tokens, ids``: the pieces; ids are little-endian unsigned 32-bit, as bytes.

    ``deal``, by which :func:`pack` deals documents into groups, is a hash of the document's id and text, its partition
    and its number among equal rows there: copies are spread, and a partition that is computed again, in whatever
    order, deals its documents the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        bpe = tokenizer(vocabulary, ranks, pattern)
        copies: Counter[int] = Counter()
        names = ["doc_id", "deal", "start", "length", "doc_tokens", "ids"]
        types = [pa.int64()] * 5 + [pa.binary()]
        rows: list[tuple] = []
        size = 0

        def part() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                for doc, place, text in zip(some.column("doc_id").to_pylist(), some.column("place").to_pylist(), utf8(some.column("text"))):
                    row = xxhash.xxh64_intdigest(text or b"", seed=(doc or 0) & 0xFFFFFFFFFFFFFFFF)
                    copies[row] += 1
                    deal = xxhash.xxh64_intdigest(struct.pack("<QQQ", row, place, copies[row])) - 2**63
                    ids = np.append(bpe.ids((text or b"").decode("utf-8", "replace")), np.uint32(end_id)).astype("<u4")
                    for at in range(0, len(ids), length):
                        piece = ids[at : at + length].tobytes()
                        rows.append((doc, deal, at, len(piece) // 4, len(ids), piece))
                        size += len(piece)
                if size >= 4_000_000:
                    yield part()
                    rows, size = [], 0
        if rows:
            yield part()

    return docs.select(F.col("doc_id").cast("long"), F.spark_partition_id().alias("place"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, deal long, start long, length long, doc_tokens long, ids binary")


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins.  ``lengths`` must be in decreasing order."""
    n = len(lengths)
    size = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * size)  # tree[k]: the most room in any bin below node k; leaves are the bins in order
    bins, offsets, used = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    for i, need in enumerate(lengths.tolist()):
        k = 1
        while k < size:
            k *= 2
            if tree[k] < need:
                k += 1
        bins[i], offsets[i] = k - size, capacity - tree[k]
        used = max(used, k - size + 1)
        tree[k] -= need
        while k > 1:
            k //= 2
            best = max(tree[2 * k], tree[2 * k + 1])
            if tree[k] == best:
                break
            tree[k] = best
    return bins, offsets, used


def pack(pieces: DataFrame, documents: int, length: int = 1024, group_docs: int = 8192) -> DataFrame:
    """``pieces`` of ``documents`` documents with ``sequence_id`` and ``offset``; their other columns are carried along.

    A task holds one group at a time: with ids among the columns, groups should be smaller.
    """
    groups = max(1, math.ceil(documents / group_docs))
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "doc_tokens"], ascending=[False, True, True, True], kind="stable")
        n = rows["length"].to_numpy()
        full = int((n >= length).sum())
        bins, offsets, _ = first_fit_decreasing(n[full:], length)
        base = int(rows["deal"].iloc[0]) << 40
        return rows.assign(sequence_id=base + np.concatenate((np.arange(full), full + bins)), offset=np.concatenate((np.zeros(full, np.int64), offsets)))

    return pieces.withColumn("deal", F.pmod("deal", F.lit(groups))).groupBy("deal").applyInPandas(place, schema).drop("deal")
