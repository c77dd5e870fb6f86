"""Language identification by a string kernel, with Nystroem landmarks and kernel ridge regression.

Kernel: the blended spectrum of byte n-grams, n = 1 .. ``order``, by presence.  For each n, the n-grams that two
texts share, over the geometric mean of how many each has; the blend is the mean over n.  N-grams are those of the
landmarks (all others are shared with no landmark), so a text's count is of those too.

Model: ``landmarks`` windows of training texts, the same number per language; features k(x, landmark); one ridge
regression per language against the rest, in the Nystroem form alpha = (K'K + ridge * K_LL)^-1 K'Y.  Texts are
scored whole, in batches: a presence matrix times the landmark matrix times alpha.

Presence is found by a chain of tables, (id of an n-1-gram) * 256 + byte -> id of the n-gram, exact for any order.

The model is fitted on a bounded sample: ``per_lang`` texts of each language, those with the least hash, of at
most ``max_bytes`` bytes.  Predictions read whole texts.

Rows: text that is null or has no letter is ``und`` with score 0; so is every text if there is nothing to learn
from.  Equal scores go to the language first by name.  Repeated rows and copies get equal predictions.  Training
rows with a null language or null text are passed over.  Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, kept

LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def normal(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


class Spectrum:
    """The distinct n-grams of some texts, n = 1 .. order, numbered, and the presence of them in other texts."""

    def __init__(self, texts: list[bytes], order: int):
        self.order, self.steps, self.bounds = order, [], [0]
        ids = [np.zeros(len(t) + 1, np.int64) for t in texts]  # the empty gram is number 0 of its level
        parents = 1
        for n in range(1, order + 1):
            keys = [i[: len(t) - n + 1] * 256 + np.frombuffer(t, np.uint8)[n - 1 :] if len(t) >= n else np.zeros(0, np.int64) for i, t in zip(ids, texts)]
            distinct = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
            # one past the last parent stands for "no such gram": its row stays absent
            table = np.full((parents + 1) * 256, len(distinct), np.int32)
            table[distinct] = np.arange(len(distinct), dtype=np.int32)
            self.steps.append(table)
            ids = [table[k].astype(np.int64) for k in keys]
            parents = len(distinct)
            self.bounds.append(self.bounds[-1] + parents)
        self.size = self.bounds[-1]

    def presence(self, texts: list[bytes]) -> np.ndarray:
        """float32 (texts, grams): each n's grams have unit norm over sqrt(order), so dot products are the kernel."""
        rows = len(texts)
        buf = np.frombuffer(b"".join(texts), np.uint8)
        lengths = np.array([len(t) for t in texts], np.int64)
        row = np.repeat(np.arange(rows, dtype=np.int32), lengths)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(buf))  # bytes of the own text from here on
        out = np.zeros((rows, self.size), np.float32)
        gram = np.zeros(len(buf), np.int32)
        parents = 1
        for n in range(1, self.order + 1):
            m = len(buf) - n + 1
            if m <= 0:
                break
            gram = self.steps[n - 1][gram[:m] * np.int32(256) + buf[n - 1 :]]
            count = self.bounds[n] - self.bounds[n - 1]
            here = (gram < count) & (left[:m] >= n)
            mark = np.zeros((rows, count), bool)
            mark.reshape(-1)[row[:m][here].astype(np.int64) * count + gram[here]] = True
            norm = np.sqrt(mark.sum(axis=1) * self.order)
            out[:, self.bounds[n - 1] : self.bounds[n]] = mark / np.maximum(norm, 1e-9)[:, None]
            parents = count
        return out


@dataclass
class LanguageModel:
    names: list[str]
    spectrum: Spectrum | None
    landmarks: np.ndarray  # (grams, landmarks)
    alpha: np.ndarray  # (landmarks, languages)

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        out, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t is not None and self.names and LETTER.search(t)]
        at = 0
        while at < len(known):  # blocks of bounded size: at most 128 texts, or about a megabyte
            block, size = [], 0
            while at < len(known) and len(block) < 128 and (not block or size < 1_000_000):
                block.append(known[at])
                size += len(texts[known[at]])
                at += 1
            f = self.spectrum.presence([normal(texts[i]) for i in block]) @ self.landmarks @ self.alpha
            e = np.exp(6 * (f - f.max(axis=1, keepdims=True)).astype(np.float64))
            best = f.argmax(axis=1)
            for i, b, p in zip(block, best, e / e.sum(axis=1, keepdims=True)):
                out[i], score[i] = self.names[b], p[b]
        return out, score


def windows(text: bytes, length: int) -> bytes:
    """``length`` bytes from the middle of a text."""
    at = max(0, (len(text) - length) // 2)
    return text[at : at + length]


def fit(rows: list[tuple[str, str]], order: int = 4, landmarks: int = 48, landmark_bytes: int = 400, ridge: float = 0.05) -> LanguageModel:
    """``rows``: (language, text); the first ``landmarks`` of each language also give the landmarks."""
    names = sorted({lang for lang, text in rows if LETTER.search(text)})
    texts = [(names.index(lang), normal(text)) for lang, text in rows if lang in names and LETTER.search(text)]
    if not texts:
        return LanguageModel([], None, np.zeros((0, 0)), np.zeros((0, 0)))
    chosen: list[bytes] = []
    for k in range(len(names)):
        chosen += [windows(t, landmark_bytes) for lang, t in texts if lang == k][:landmarks]
    spectrum = Spectrum(chosen, order)
    mark = spectrum.presence(chosen).T
    k_ll = (mark.T @ mark).astype(np.float64)
    ktk, kty = np.zeros_like(k_ll), np.zeros((len(chosen), len(names)))
    for at in range(0, len(texts), 64):
        block = texts[at : at + 64]
        f = (spectrum.presence([t for _, t in block]) @ mark).astype(np.float64)
        y = np.where(np.arange(len(names))[None, :] == np.array([lang for lang, _ in block])[:, None], 1.0, -1.0)
        ktk += f.T @ f
        kty += f.T @ y
    alpha = np.linalg.solve(ktk + ridge * k_ll * len(texts) / len(chosen) + 1e-6 * np.eye(len(chosen)) * np.trace(ktk) / len(chosen), kty)
    return LanguageModel(names, spectrum, np.ascontiguousarray(mark), alpha.astype(np.float32))


def training_rows(docs: DataFrame, held_out: Column, per_lang: int = 400, max_bytes: int = 16_384) -> list[tuple[str, str]]:
    """The bounded sample: per language, ``per_lang`` distinct texts with the least hash."""
    rows = docs.filter(~held_out).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    return bounded_sample(rows, None, "lang", per_lang, max_bytes)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lang, score = m.decide(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identified_documents(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that have a language with a score of ``least`` or more, all columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return kept(docs, lambda text: shared.value.decide(text.to_pylist())[1] >= least)
