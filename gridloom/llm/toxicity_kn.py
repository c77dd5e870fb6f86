"""Toxicity by class-conditional Kneser-Ney models.

Two Kneser-Ney bigram models over words, one of toxic and one of ordinary texts.  Each counts its own class: how often
a bigram occurs, and in how many contexts a word does (continuation counts).  Both orders are discounted by the class's
own D = n1 / (n1 + 2 n2), n1 and n2 being the expressions counted once and twice.

Shared backoff counts are those of all documents: how often each word occurs, each bigram that a class may keep, and
that bigram's first word.  A class keeps an expression if it uses it clearly more than the shared counts say: the
weighted difference of Seymore and Rosenfeld (1996), K log(P / P_shared) with K the discounted count, is over
``EVIDENCE`` (more than chance makes) and, per word of the class, over ``THRESHOLD`` (what it adds to the relative
entropy of the model and the shared counts, by which Stolcke (1998) prunes).
All others, rare ones among them, back off: a bigram that either class keeps to its shared relative frequency, any other
to the class's words, and a word to its shared relative frequency, each times a backoff weight: the mass that the kept
expressions leave to the others, over what they leave in the shared counts (the backing-off form of Kneser and Ney,
1995).  So expressions that neither class keeps are worth their weights alone, whatever their frequency, and a language
that one class has more of isn't evidence.

Score: the difference of the two length-normalised log-likelihoods (mean per word), turned into a probability by a
logistic regression fitted on texts that the models it scores haven't seen (two halves, crossed), the classes weighted
to their share of all labels, whatever part of each the sample holds.

Bounds: each class is fitted on at most ``per_class`` labelled texts of at most ``max_bytes`` bytes, those with the
least hash; candidates are its bigrams that occur ``LEAST`` times and its words, so the model's size is bounded.  Shared
counts cover every word of every document.

Rows: a null, empty or wordless text gets the calibrated probability of a difference of 0.  If either class has no
text, every score is 0.  Words are maximal runs of ASCII alphanumerics (A-Z lower-cased) and non-ASCII characters.
Repeated rows get equal scores.  Ids with contradicting labels are not learned from.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import auc, bounded_sample, logistic, utf8
from .decontam_fm import words_of

__all__ = ["ToxicityModel", "auc", "fit", "score_documents", "shared_counts", "train"]

#: Occurrences that a bigram must have in a class to be a candidate; what a weighted difference must be over, whole and per word of the class.
LEAST, EVIDENCE, THRESHOLD = 3, 8.0, 5e-5


def discount(counts: np.ndarray) -> float:
    """n1 / (n1 + 2 n2); a half if the counts don't tell."""
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return once / (once + 2 * twice) if once and twice else 0.5


def lookup(codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted code in the sorted ``codes``, or -1."""
    if not len(codes):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
    return np.where(codes[at] == wanted, at, -1)


def bigrams(ids: np.ndarray, size: int) -> np.ndarray:
    """Codes left * size + right of a text's bigrams; 0 stands left of its first word."""
    return np.concatenate(([0], ids[:-1])) * size + ids


@dataclass
class Shared:
    """Counts over all documents: ``words`` by id (entry 0: words outside the vocabulary), ``pairs`` of the sorted ``codes``, ``lefts`` by id of the left word (entry 0: beginnings)."""

    words: np.ndarray
    codes: np.ndarray
    pairs: np.ndarray
    lefts: np.ndarray

    @staticmethod
    def count(texts: list[np.ndarray], size: int, codes: np.ndarray) -> Shared:
        s = Shared(np.zeros(size, np.int64), codes, np.zeros(len(codes), np.int64), np.zeros(size, np.int64))
        s.add(texts)
        return s

    def add(self, texts: list[np.ndarray]) -> None:
        """Word ids of texts; 0 is a word outside the vocabulary."""
        texts = [t for t in texts if len(t)]
        if not texts:
            return
        size, ids = len(self.words), np.concatenate(texts)
        begins = np.zeros(len(ids), bool)
        begins[np.cumsum([0, *map(len, texts)])[:-1]] = True
        left = np.where(begins, 0, np.concatenate(([0], ids[:-1])))
        known = begins | (left > 0)
        self.words += np.bincount(ids, minlength=size)
        self.lefts += np.bincount(left[known], minlength=size)
        at = lookup(self.codes, (left * size + ids)[known & (ids > 0)])
        self.pairs += np.bincount(at[at >= 0], minlength=len(self.codes))


class ClassModel:
    """The Kneser-Ney model of one class; words are ids from 1."""

    def __init__(self, texts: list[np.ndarray], size: int):
        own = [bigrams(t, size) for t in texts if len(t)]
        self.size = size
        self.codes, self.counts = np.unique(np.concatenate(own) if own else np.zeros(0, np.int64), return_counts=True)
        self.lefts = np.bincount(self.codes // size, self.counts, size)  # c(v .)
        self.contexts = np.bincount(self.codes % size, minlength=size)  # N1+(. w)
        self.candidates = self.codes[self.counts >= LEAST]

    def keep(self, shared: Shared, threshold: float) -> None:
        """Choose the expressions kept: ``word`` (their probabilities, 0: not kept) with ``word_weight``, and ``pairs``, ``pair`` likewise."""
        total = max(1, int(self.contexts.sum()))
        k = self.contexts - discount(self.contexts[self.contexts > 0])
        p, q = np.maximum(k, 0) / total, shared.words / max(1, int(shared.words.sum()))
        kept = (self.contexts > 0) & gains(k, p, q, total, threshold)
        kept[0] = False
        self.word = np.where(kept, p, 0.0)
        self.word_weight = weight(self.word.sum(), q[kept].sum())

        d = discount(self.counts)
        at = lookup(shared.codes, self.candidates)
        left = self.candidates // self.size
        k = self.counts[self.counts >= LEAST] - d
        p, q = k / self.lefts[left], shared.pairs[at] / np.maximum(shared.lefts[left], 1)
        kept = gains(k, p, q, max(1, int(self.counts.sum())), threshold)
        self.pairs, self.pair = self.candidates[kept], p[kept]
        own, other = (np.bincount(left[kept], x[kept], self.size) for x in (p, q))
        self.pair_weight = weight(own, other)

    def log_word(self, shared: Shared) -> np.ndarray:
        """Of every id; entry 0 and all words not kept: less their shared probability."""
        total = int(shared.words.sum())
        q = np.where(shared.words > 0, shared.words / max(1, total), 1.0)
        return np.where(self.word > 0, np.log(np.where(self.word > 0, self.word, 1.0) / q), np.log(self.word_weight))

    def log_pair(self, codes: np.ndarray, shared: Shared) -> np.ndarray:
        """Of ``codes``, less their shared probabilities."""
        at, left = lookup(self.pairs, codes), codes // self.size
        q = shared.pairs[lookup(shared.codes, codes)] / np.maximum(shared.lefts[left], 1)
        own = self.pair[at] / q if len(self.pair) else q
        return np.log(np.where(at >= 0, own, self.pair_weight[left]))


def gains(k: np.ndarray, p: np.ndarray, q: np.ndarray, total: int, threshold: float) -> np.ndarray:
    """Whether discounted counts ``k`` of ``total`` with probabilities ``p`` tell enough more than the shared ones ``q``."""
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = k * np.log(p / q)
    return (gain > EVIDENCE) & (gain > threshold * total)


def weight(own, shared):  # noqa: ANN001, ANN201
    """What the shared probabilities of the expressions not kept are multiplied by: the mass left over that left there."""
    return np.maximum(1 - own, 1e-2) / np.maximum(1 - shared, 1e-2)


@dataclass
class ToxicityModel:
    """Log-likelihood ratios: of bigrams that either class keeps, of words, and of contexts' backoff weights."""

    vocabulary: dict[bytes, int]
    codes: np.ndarray
    pair: np.ndarray
    word: np.ndarray  # by id; entry 0: words outside the vocabulary
    context: np.ndarray  # by id; entry 0: beginnings
    weights: np.ndarray  # calibration

    def ids(self, text: bytes | None) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words_of(text)], np.int64)

    def difference(self, ids: np.ndarray) -> float:
        """Toxic less ordinary log-likelihood, per word."""
        if not len(ids):
            return 0.0
        left = np.concatenate(([0], ids[:-1]))
        known = left > 0
        known[0] = True  # a beginning
        at = np.where(known & (ids > 0), lookup(self.codes, bigrams(ids, len(self.word))), -1)
        backed = self.word[ids] + np.where(known, self.context[left], 0.0)
        return float(np.where(at >= 0, self.pair[at] if len(self.pair) else 0.0, backed).mean())

    def probability(self, difference: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.zeros(len(difference))
        return 1 / (1 + np.exp(-np.clip(self.weights[0] * difference + self.weights[1], -30, 30)))


def _model(classes: list[ClassModel], vocabulary: dict[bytes, int], shared: Shared, threshold: float = THRESHOLD) -> ToxicityModel:
    for c in classes:
        c.keep(shared, threshold)
    toxic, ordinary = classes
    codes = np.union1d(toxic.pairs, ordinary.pairs)
    pair = toxic.log_pair(codes, shared) - ordinary.log_pair(codes, shared)
    word = toxic.log_word(shared) - ordinary.log_word(shared)
    return ToxicityModel(vocabulary, codes, pair, word, np.log(toxic.pair_weight) - np.log(ordinary.pair_weight), np.zeros(0))


def candidates(classes: list[list[np.ndarray]], size: int) -> np.ndarray:
    """Codes of the bigrams that a model of these texts, or of part of them, may keep."""
    return np.unique(np.concatenate([ClassModel(texts, size).candidates for texts in classes]))


def fit(toxic: list[np.ndarray], ordinary: list[np.ndarray], vocabulary: dict[bytes, int], shared: Shared, share: float | None = None) -> ToxicityModel:
    """Both models and their calibration; ``shared`` must hold the counts of all :func:`candidates`.

    ``share`` is that of toxic texts where the sample was drawn (None: as in the sample).
    """
    size = len(vocabulary) + 1
    none = np.zeros(0)
    if not toxic or not ordinary:
        return ToxicityModel(vocabulary, np.zeros(0, np.int64), none, np.zeros(size), np.zeros(size), none)
    y = np.array([label for half in (0, 1) for texts, label in ((toxic, 1.0), (ordinary, 0.0)) for _ in texts[1 - half :: 2]])
    halves = [[ClassModel(texts[h::2], size) for texts in (toxic, ordinary)] for h in (0, 1)]
    models = [_model(half, vocabulary, shared) for half in halves]
    x = np.array([models[h].difference(t) for h in (0, 1) for texts in (toxic, ordinary) for t in texts[1 - h :: 2]])
    model = _model([ClassModel(texts, size) for texts in (toxic, ordinary)], vocabulary, shared)
    scale = float(x.std()) or 1.0
    share = y.mean() if share is None else share
    w = logistic(np.stack([x / scale, np.ones(len(x))], axis=1), y, 1e-6, weight=np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean())))
    model.weights = np.array([max(w[0], 0.0) / scale, w[1]])
    return model


def shared_counts(docs: DataFrame, vocabulary: dict[bytes, int], codes: np.ndarray) -> Shared:
    """The shared counts over every word of all of ``docs``; each task returns what it counted, summed by key."""
    size = len(vocabulary) + 1
    given = docs.sparkSession.sparkContext.broadcast((vocabulary, codes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own = given.value
        get, found = words.get, Shared.count([], len(words) + 1, own)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found.add([np.array([get(w, 0) for w in words_of(text)], np.int64) for text in utf8(batch.column("text").slice(at, 256))])
        for kind, counts in enumerate((found.words, found.pairs, found.lefts)):
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["kind", "key", "n"])

    table = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "kind int, key int, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).toArrow()
    kind, key, n = (table.column(c).to_numpy() for c in ("kind", "key", "n"))
    out = Shared.count([], size, codes)
    for k, counts in enumerate((out.words, out.pairs, out.lefts)):
        counts[key[kind == k]] = n[kind == k]
    return out


def toxic_share(labels: DataFrame, label: str) -> float | None:
    """The share of 1 among the ids labelled 0 or 1 without contradiction; None if there are none."""
    one = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("other"))
    return one.filter("y = other and y in (0, 1)").agg(F.avg(F.col("y").cast("double"))).first()[0]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 2500, max_bytes: int = 16_384) -> ToxicityModel:
    """``labels`` (doc_id, ``label``) names the rows that may be learned from; shared counts are of all ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sample = [(c, words_of(t.encode())) for c, t in bounded_sample(rows, labels, label, per_class, max_bytes)]
    vocabulary: dict[bytes, int] = {}
    for _, words in sample:
        for w in words:
            vocabulary.setdefault(w, len(vocabulary) + 1)
    texts = [(c, np.array([vocabulary[w] for w in words], np.int64)) for c, words in sample if words]
    toxic, ordinary = ([t for c, t in texts if c == y] for y in (1, 0))
    shared = shared_counts(rows, vocabulary, candidates([toxic, ordinary], len(vocabulary) + 1))
    return fit(toxic, ordinary, vocabulary, shared, toxic_share(labels, label))


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score`` for every row."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = given.value
        for batch in batches:
            diffs = [m.difference(m.ids(t)) for at in range(0, batch.num_rows, 256) for t in utf8(batch.column("text").slice(at, 256))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(m.probability(np.array(diffs)), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
