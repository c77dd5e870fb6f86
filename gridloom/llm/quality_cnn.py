"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks of ``CHUNK`` bytes that overlap by the filter width less one stride.  Bytes
are embedded (learned), convolved with learned filters (``WIDTH`` bytes) at a stride of ``STRIDE`` bytes and rectified.
The windows begin at every ``STRIDE``-th byte from the text's beginning to its end, across chunks too, and overlap by
half, so every byte of the whole text is seen by each filter at two places (the first ``STRIDE`` and the last few bytes
at one); windows that begin in between aren't.  Each filter is max-pooled over a chunk; the document's features are
the means of its chunks' maxima.  A hidden layer and one logistic unit combine them into the probability.

Fitted by Adam on a bounded sample: at most ``per_class`` labelled texts of each class, those with the least hash,
of at most ``max_bytes`` bytes; classes are weighted to their share.  Fitting is seeded and repeatable.

Rows: null and empty texts are scored as a text of no bytes (one chunk of padding).  Long texts take as many chunks
as they need, a bounded number at a time.  Repeated rows and copies get equal scores up to the order of float32
sums in a batch (scores are rounded to 6 places, which hides it).  If a class has no text every score is 0.5.
Ids with contradicting labels are not learned from.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, kept, utf8

CHUNK, WIDTH, STRIDE, DIM, FILTERS, HIDDEN = 512, 8, 4, 6, 40, 24
STEP = CHUNK - WIDTH + STRIDE
POSITIONS = (CHUNK - WIDTH) // STRIDE + 1
#: Chunks that are convolved at once.
BLOCK = 256


@dataclass
class QualityModel:
    embed: np.ndarray  # (256, DIM); byte 0 is also the padding
    filters: np.ndarray  # (WIDTH * DIM, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    hidden: np.ndarray  # (FILTERS + 1, HIDDEN); the last row is the bias
    out: np.ndarray  # (HIDDEN + 1,)
    fitted: bool = True

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """(chunks * positions, WIDTH * DIM): every window's embedded bytes."""
        e = self.embed[chunks]
        shape, s = (len(chunks), POSITIONS, WIDTH * DIM), e.strides
        return np.lib.stride_tricks.as_strided(e, shape, (s[0], s[1] * STRIDE, s[2])).reshape(-1, WIDTH * DIM)

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        """(chunks, FILTERS): rectified maxima."""
        out = np.empty((len(chunks), FILTERS), np.float32)
        for at in range(0, len(chunks), BLOCK):
            part = chunks[at : at + BLOCK]
            y = (self.windows(part) @ self.filters).reshape(len(part), POSITIONS, FILTERS)
            out[at : at + BLOCK] = np.maximum(y.max(axis=1) + self.bias, 0)
        return out

    def logits(self, chunks: np.ndarray, counts: np.ndarray) -> np.ndarray:
        sums = np.add.reduceat(self.pooled(chunks).astype(np.float64), np.cumsum(counts) - counts, axis=0)
        f = np.concatenate((sums / counts[:, None], np.ones((len(counts), 1))), axis=1)
        return np.maximum(f @ self.hidden, 0) @ self.out[:-1] + float(self.out[-1])

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if not self.fitted:
            return np.full(len(texts), 0.5)
        parts = [np.zeros(0, np.float64)]
        at = 0
        while at < len(texts):
            block, size = [], 0
            while at < len(texts) and len(block) < 512 and (not block or size < 1_000_000):
                block.append(texts[at] or b"")
                size += len(block[-1])
                at += 1
            chunks, counts = chunked(block)
            parts.append(1 / (1 + np.exp(-np.clip(self.logits(chunks, counts), -30, 30))))
        return np.round(np.concatenate(parts), 6)


def chunked(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(chunks, CHUNK) of all texts, the last of each padded with zeros, and the number of each text's chunks."""
    lengths = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(1, -(-(lengths - (CHUNK - STEP)) // STEP))
    out = np.zeros((int(counts.sum()), CHUNK), np.uint8)
    k = 0
    for t, n in zip(texts, counts.tolist()):
        b = np.frombuffer(t, np.uint8)
        for c in range(n):
            part = b[c * STEP : c * STEP + CHUNK]
            out[k, : len(part)] = part
            k += 1
    return out, counts


def fit(texts: list[bytes], labels: np.ndarray, share: float | None = None, steps: int = 1000, batch: int = 64, rate: float = 0.004, seed: int = 5) -> QualityModel:
    """``labels`` are 0 or 1; ``share`` is that of label 1 where the sample was drawn (None: as in the sample).  A document takes part in a step with at most 4 of its chunks, spread over all of it."""
    rng = np.random.default_rng(seed)
    init = lambda *s: rng.standard_normal(s).astype(np.float32)
    m = QualityModel(init(256, DIM) * 0.5, init(WIDTH * DIM, FILTERS) / np.float32(np.sqrt(WIDTH * DIM)), np.zeros(FILTERS, np.float32), init(FILTERS + 1, HIDDEN) / np.float32(np.sqrt(FILTERS)), init(HIDDEN + 1) * 0.2)
    if len(set(labels.tolist())) < 2:
        m.fitted = False
        return m
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    chunks, counts = chunked(texts)
    first = np.cumsum(counts) - counts
    params = [m.embed, m.filters, m.bias, m.hidden, m.out]
    moment, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    done = 0
    while done < steps:
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            docs = order[at : at + batch]
            picked = [first[d] + (np.arange(min(4, counts[d])) * counts[d] + rng.integers(counts[d])) // min(4, counts[d]) % counts[d] for d in docs]
            owner = np.repeat(np.arange(len(docs)), [len(p) for p in picked])
            part = chunks[np.concatenate(picked)]
            part_of = (1 / np.bincount(owner, minlength=len(docs))).astype(np.float32)[owner]
            x = m.windows(part)
            y = (x @ m.filters).reshape(len(part), POSITIONS, FILTERS)
            top = y.argmax(axis=1)
            h = np.take_along_axis(y, top[:, None, :], axis=1)[:, 0] + m.bias
            live = h > 0
            h = h * live
            f = np.zeros((len(docs), FILTERS + 1), np.float32)
            np.add.at(f[:, :FILTERS], owner, h * part_of[:, None])
            f[:, -1] = 1
            z = np.maximum(f @ m.hidden, 0)
            p = 1 / (1 + np.exp(-np.clip(z @ m.out[:-1] + m.out[-1], -30, 30)))
            g = ((p - labels[docs]) * weight[docs] / len(docs)).astype(np.float32)
            g_out = np.append(z.T @ g, g.sum()).astype(np.float32)
            g_z = g[:, None] * m.out[:-1] * (z > 0)
            g_hidden = f.T @ g_z
            g_h = (g_z @ m.hidden[:FILTERS].T)[owner] * part_of[:, None] * live
            # only each filter's best window has a gradient
            rows = (np.arange(len(part))[:, None] * POSITIONS + top).ravel()
            cols = np.tile(np.arange(FILTERS), len(part))
            flat = g_h.ravel()
            g_filters = np.zeros_like(m.filters)
            best = x[rows].reshape(len(part), FILTERS, WIDTH * DIM)
            g_filters[:] = np.einsum("cfk,cf->kf", best, g_h)
            back = (m.filters.T[cols] * flat[:, None]).reshape(-1, DIM)
            where = (np.arange(len(part))[:, None] * CHUNK + top * STRIDE).ravel()[:, None] + np.arange(WIDTH)
            g_embed = np.zeros_like(m.embed)
            symbols = part.reshape(-1)[where.ravel()]
            for d in range(DIM):
                g_embed[:, d] = np.bincount(symbols, back[:, d], 256)
            done += 1
            lr = rate * max(0.1, 1 - 0.9 * done / steps)
            for k, (p_, g_) in enumerate(zip(params, (g_embed, g_filters, g_h.sum(axis=0), g_hidden, g_out))):
                moment[k] = 0.9 * moment[k] + 0.1 * g_
                square[k] = 0.99 * square[k] + 0.01 * g_ * g_
                p_ -= (lr * (moment[k] / (1 - 0.9**done)) / (np.sqrt(square[k] / (1 - 0.99**done)) + 1e-8)).astype(np.float32)
    # one shift of the logit sets the mean probability to the classes' true share
    share = labels.mean() if share is None else share
    mass = np.where(labels == 1, share / (labels == 1).sum(), (1 - share) / (labels == 0).sum())
    logit = m.logits(chunks, counts)
    lo, hi = -10.0, 10.0
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (mass / (1 + np.exp(-(logit + mid)))).sum() < share else (lo, mid)
    m.out[-1] += np.float32(lo)
    return m


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 2000, max_bytes: int = 16_384) -> QualityModel:
    """``labels`` (doc_id, ``label``) names the rows that may be learned from."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sample = bounded_sample(rows, labels, label, per_class, max_bytes)
    share = labels.agg(F.avg(F.col(label).cast("double"))).first()[0]
    return fit([t.encode() for _, t in sample], np.array([c for c, _ in sample], np.float64), share)


def score_documents(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, score`` for every row."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = given.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(m.scores(utf8(part.column("text"))), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def good_documents(docs: DataFrame, model: QualityModel, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score of ``least`` or more, all columns unchanged."""
    given = docs.sparkSession.sparkContext.broadcast(model)
    return kept(docs, lambda text: given.value.scores(utf8(text)) >= least)
