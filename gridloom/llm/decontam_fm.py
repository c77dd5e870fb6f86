"""Benchmark decontamination with an FM-index per training shard.

A shard is what one task has read of the documents, as a sequence of benchmark word ids.  Words that occur in no
benchmark item can't be part of a match; runs of benchmark words shorter than the shortest window can't hold one.
Only the other runs are indexed, separated by symbol 0.  Each shard's index is a suffix array's
Burrows-Wheeler transform in a wavelet matrix; all windows are backward-searched at once; occurrences are located
by LF steps to sampled suffix positions and merged into removal spans.

Tasks are given the benchmark's windows as a broadcast of at most about ``BLOCK_BYTES`` bytes of benchmark text.  A
larger benchmark is searched in blocks of that size, each in a pass of its own over the documents, and the spans and items
of a document are united over the passes; items are dealt to blocks by hash, long ones in pieces that overlap by a
window less one word.

Words: A-Z lower-cased, then maximal runs of characters other than ASCII non-alphanumerics.  A window is
``window`` consecutive words of an item; an item of fewer words, but not none, is one window.

Rows: a null or wordless text has no words, hits or items.  Texts of any length are read whole, one at a time.
Repeated rows are judged each by itself.  Benchmark rows without item_id or words take no part, items that share
an id count once.  An empty benchmark hits nothing.  Other columns are not read.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8, written

_WORDS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in bytes(range(256)).lower())
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Symbols or bytes of text after which a shard is closed and indexed.
SHARD_SYMBOLS, SHARD_BYTES = 1 << 20, 64 << 20
#: Bytes of benchmark text that one pass searches for, and of a piece of a long item.
BLOCK_BYTES, PIECE_BYTES = 8 << 20, 256 << 10


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


class WaveletMatrix:
    """rank of any symbol at any position, for arrays of both at once."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        cur = seq
        for level in range(self.bits - 1, -1, -1):
            b = (cur >> level) & 1
            ones = np.zeros(len(cur) + 1, np.int32)
            np.cumsum(b, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(cur) - int(ones[-1]))
            cur = np.concatenate((cur[b == 0], cur[b == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before position ``at``."""
        at, start = at.astype(np.int64), np.zeros(len(at), np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            b = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            a1, s1 = ones[at], ones[start]
            at = np.where(b, zeros + a1, at - a1)
            start = np.where(b, zeros + s1, start - s1)
        return at - start


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; each 0 counts as a symbol of its own, the earlier the smaller."""
    n = len(seq)
    cuts = np.flatnonzero(seq == 0)
    rank = seq.astype(np.int64) + len(cuts)
    rank[cuts] = np.arange(len(cuts))
    width = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - width] = rank[width:]
        key = rank * (n + int(rank.max()) + 2) + after + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        step = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        new[order] = step
        if step[-1] == n - 1:
            return order
        rank, width = new, 2 * width


class FMIndex:
    """Backward search and location over a sequence whose runs of positive symbols are each led by a 0."""

    def __init__(self, seq: np.ndarray, symbols: int, sample: int = 16):
        order = suffix_order(seq)
        self.bwt = seq[order - 1]
        self.tree = WaveletMatrix(self.bwt, symbols)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=symbols))))
        keep = (order % sample == 0) | (self.bwt == 0)  # all beginnings of runs are sampled: no step crosses a 0
        self.sampled, self.index = keep, np.cumsum(keep) - 1
        self.position = order[keep]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and row past the last of each phrase (right-aligned in ``phrases``)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        width = phrases.shape[1]
        for k in range(width - 1, -1, -1):
            live = np.flatnonzero((lo < hi) & (width - k <= lengths))
            if not len(live):
                break
            c = phrases[live, k]
            base = self.first[c]
            lo[live], hi[live] = base + self.tree.rank(c, lo[live]), base + self.tree.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.sampled[rows])
        while len(live):
            c = self.bwt[rows[live]]
            rows[live] = self.first[c] + self.tree.rank(c, rows[live])
            steps[live] += 1
            live = live[~self.sampled[rows[live]]]
        return self.position[self.index[rows]] + steps


class Windows:
    """The distinct windows of a benchmark, as word ids, with the items that each belongs to."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in items})
        number = {item: k for k, item in enumerate(self.names)}
        rows, owner = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int32)]
        for item, words in items:
            if not words:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int32)
            short = max(0, window - len(ids))  # right-aligned, zeros before
            rows.append(np.lib.stride_tricks.sliding_window_view(np.concatenate((np.zeros(short, np.int32), ids)), window))
            owner.append(np.full(len(rows[-1]), number[item], np.int32))
        self.phrases, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.lengths = (self.phrases > 0).sum(axis=1)
        self.shortest = int(self.lengths.min()) if len(self.phrases) else 0
        pairs = np.unique(which.ravel().astype(np.int64) * max(1, len(self.names)) + np.concatenate(owner))
        of, self.owner = np.divmod(pairs, max(1, len(self.names)))
        self.first = np.searchsorted(of, np.arange(len(self.phrases) + 1))

    def owners(self, phrase: int) -> list[str]:
        return [self.names[k] for k in self.owner[self.first[phrase] : self.first[phrase + 1]]]


def _runs(ids: np.ndarray, least: int) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0]))))
    return [(s, e) for s, e in zip(edge[0::2].tolist(), edge[1::2].tolist()) if e - s >= least]


def search_shard(runs: list[tuple[int, int, np.ndarray]], windows: Windows) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
    """``runs``: (document, offset of its first word, word ids).  For each document hit: merged spans and items."""
    if not runs:
        return {}
    seq = np.concatenate([x for _, _, ids in runs for x in (np.zeros(1, np.int64), ids)])
    starts = np.cumsum([0] + [len(ids) + 1 for _, _, ids in runs])[:-1]
    index = FMIndex(seq, len(windows.vocabulary) + 1)
    lo, hi = index.search(windows.phrases, windows.lengths)
    found = np.flatnonzero(hi > lo)
    counts = (hi - lo)[found]
    phrase = np.repeat(found, counts)
    rows = np.repeat(lo[found], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = index.locate(rows)
    run = np.searchsorted(starts, at, side="right") - 1
    doc = np.array([r[0] for r in runs])[run]
    begin = np.array([r[1] for r in runs])[run] + at - starts[run] - 1
    out: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
    order = np.lexsort((begin, doc))
    for d, b, p in zip(doc[order].tolist(), begin[order].tolist(), phrase[order].tolist()):
        spans, items = out.setdefault(d, ([], set()))
        end = b + int(windows.lengths[p])
        if spans and b <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
        else:
            spans.append((b, end))
        items.update(windows.owners(p))
    return out


def pieces_of(words: list[bytes], window: int, size: int) -> list[list[bytes]]:
    """``words`` in runs of up to ``size`` bytes that overlap by ``window`` - 1 words, so that each window is in one."""
    ends = np.cumsum([len(w) + 1 for w in words])
    out, at = [], 0
    while at == 0 or at < len(words) - window + 1:
        end = max(at + window, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        out.append(words[at:end])
        at = end - window + 1
    return out


def benchmark_blocks(benchmark: DataFrame, window: int, limit: int = BLOCK_BYTES) -> Iterator[Windows]:
    """The windows of a whole benchmark, in blocks of about ``limit`` bytes of text; one block, maybe empty, at least."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).filter("item is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    if size <= limit:
        yield Windows([(r.item, words_of(r.text.encode())) for r in rows.collect()], window)
        return
    piece = max(1, min(PIECE_BYTES, limit // 16))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), utf8(batch.column("text"))):
                parts = [b" ".join(p).decode() for p in pieces_of(words_of(text), window, piece)]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(parts), pa.string()), pa.array(parts, pa.string())], names=["item", "text"])

    blocks = math.ceil(2 * size / limit)
    dealt = written(rows.mapInArrow(cut, "item string, text string").withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))), "benchmark")
    for k in range(blocks):
        yield Windows([(r.item, words_of(r.text.encode())) for r in dealt.filter(F.col("block") == k).collect()], window)


class Shard:
    """Documents of one task, until enough are gathered to index."""

    def __init__(self, windows: Windows):
        self.windows = windows
        self.clear()

    def clear(self) -> None:
        self.counts: list[int] = []
        self.runs: list[tuple[int, int, np.ndarray]] = []
        self.symbols = self.size = 0

    def add(self, text: bytes | None) -> None:
        words, get, least = words_of(text), self.windows.vocabulary.get, self.windows.shortest
        if least and len(words) >= least:
            symbol = np.array([get(w, 0) for w in words], np.int64)
            for s, e in _runs(symbol, least):
                self.runs.append((len(self.counts), s, symbol[s:e]))
                self.symbols += e - s + 1
        self.counts.append(len(words))
        self.size += len(text or b"")

    @property
    def full(self) -> bool:
        return self.symbols >= SHARD_SYMBOLS or self.size >= SHARD_BYTES

    def close(self) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each document: its words, merged spans and items."""
        hit = search_shard(self.runs, self.windows)
        out = [(n, *((hit[k][0], sorted(hit[k][1])) if k in hit else ([], []))) for k, n in enumerate(self.counts)]
        self.clear()
        return out


_PAIR = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"


def _search(rows: DataFrame, key: str, windows: Windows, hits_only: bool = False) -> DataFrame:
    """``key, n_words, n_hit, items, spans`` of the rows (``key``, ``text``) for one block of windows."""
    types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(_PAIR))
    given = rows.sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids = Shard(given.value), []

        def close() -> Iterator[pa.RecordBatch]:
            found = [(d, n, sum(e - b for b, e in s), items, [{"start": b, "end": e} for b, e in s]) for d, (n, s, items) in zip(ids, shard.close()) if s or not hits_only]
            ids.clear()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=[key, "n_words", "n_hit", "items", "spans"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids += part.column(key).to_pylist()
                for text in utf8(part.column("text")):
                    shard.add(text)
                if shard.full:
                    yield from close()
        if ids:
            yield from close()

    return rows.select(key, "text").mapInArrow(run, f"`{key}` long, {_FOUND}")


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans [start, end) in order, those that meet or overlap as one."""
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def _search_blocks(rows: DataFrame, key: str, first: Windows, others: Iterator[Windows]) -> DataFrame:
    """As :func:`_search`, for several blocks; ``key`` must tell the rows apart."""
    found = written(_search(rows, key, first), "block")
    for windows in others:
        found = found.unionAll(written(_search(rows, key, windows, hits_only=True), "block"))
    lists = found.groupBy(key).agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [united([(s["start"], s["end"]) for s in row]) for row in batch.column("spans").to_pylist()]
            hits = pa.array([sum(e - b for b, e in s) for s in spans], pa.int64())
            merged = pa.array([[{"start": b, "end": e} for b, e in s] for s in spans], pa.list_(_PAIR))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("n_words"), hits, batch.column("items"), merged], names=[key, "n_words", "n_hit", "items", "spans"])

    return lists.mapInArrow(merge, f"`{key}` long, {_FOUND}")


def _free_name(columns: list[str]) -> str:
    name = "_row"
    while name in (c.lower() for c in columns):
        name += "_"
    return name


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 13, limit: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_words, n_hit, items, spans``: spans are word intervals [start, end) to remove, merged and in order."""
    blocks = benchmark_blocks(benchmark, window, limit)
    first, rows = next(blocks), docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    second = next(blocks, None)
    if second is None:
        return _search(rows, "doc_id", first)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "rows")  # written, so rows keep their numbers
    found = _search_blocks(rows, "row", first, itertools.chain([second], blocks))
    return rows.select("row", "doc_id").join(found, "row").drop("row")


def is_contaminated(n_hit: int, n_words: int, percent: int) -> bool:
    return n_hit > 0 and 100 * n_hit >= percent * n_words


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 5, limit: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that aren't contaminated; nothing is shuffled if the benchmark is one block."""
    blocks = benchmark_blocks(benchmark, window, limit)
    first, second = next(blocks), next(blocks, None)
    if second is not None:
        row = _free_name(docs.columns)
        rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
        found = _search_blocks(rows.select(F.col(row).alias("row"), F.col("text").cast("string")), "row", first, itertools.chain([second], blocks))
        bad = judged(found, percent).filter("contaminated").select(F.col("row").alias(row))
        return rows.join(bad, row, "left_anti").select(*docs.columns)
    given = docs.sparkSession.sparkContext.broadcast(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = Shard(given.value), []

        def close() -> Iterator[pa.RecordBatch]:
            keep = [not is_contaminated(sum(e - b for b, e in s), n, percent) for n, s, _ in shard.close()]
            for part in held:
                mine, keep = keep[: part.num_rows], keep[part.num_rows :]
                yield part.filter(pa.array(mine, pa.bool_()))
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                held.append(part)
                for text in utf8(part.column("text")):
                    shard.add(text)
                if shard.full:
                    yield from close()
        yield from close()

    return docs.mapInArrow(run, docs.schema)


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    at, out, places = 0, [], [m.span() for m in WORD.finditer(text)]
    for b, e in spans:
        out.append(text[at : places[b][0]])
        at = places[e - 1][1]
    return "".join([*out, text[at:]])


def judged(overlaps: DataFrame, percent: int = 5) -> DataFrame:
    """``overlaps`` with ``contaminated``: some word is hit, and at least ``percent`` in a hundred are."""
    return overlaps.withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))
