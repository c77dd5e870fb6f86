"""The corpus operators' algorithms against brute force, without Spark."""

import heapq
import math
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import ann_forest, common, decontam_fm, lang_kernel, near_dup, packing, quality_cnn, toxicity_kn, url_automaton, warc
from gridloom.llm.queries import RULES, tokenizer_files

TEXT = st.text(alphabet="abAB é\n\t.zß0", max_size=60)


# --- shingles and minhashes -----------------------------------------------------------------------------------

def plain_shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


@given(st.lists(TEXT, max_size=8), st.sampled_from([2, 5]))
@settings(max_examples=80, deadline=None)
def test_shingle_sets_stand_for_the_shingles(texts, words):
    got = list(near_dup.shingle_sets([t.encode() for t in texts], words))
    want = [plain_shingles(t, words) for t in texts]
    assert [len(s) for s in got] == [len(s) for s in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


def test_null_and_long_texts_have_sets():
    long = b"one two three " * 200_000
    a, b, c = near_dup.shingle_sets([None, long, b"ONE two"], 2)
    assert len(a) == 0 and len(b) == 3 and len(np.intersect1d(b, c)) == 1


def test_minhashes_estimate_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    other = np.concatenate((base[:800], rng.integers(0, 2**63, 200, dtype=np.uint64)))
    mult = near_dup.minhash_multipliers(400, 3)
    share = (near_dup.minhashes(np.sort(base), mult) == near_dup.minhashes(np.sort(other), mult)).mean()
    assert abs(share - 800 / 1200) < 0.1


def test_cells_find_what_sketches_allow():
    import pandas as pd

    rng = np.random.default_rng(2)
    base = rng.choice(2**31, 150, replace=False)
    sets = [np.sort(np.concatenate((base[k:], rng.choice(2**31, k, replace=False)))) for k in (0, 5, 60, 10)]
    rows = [{"node": i, "c": c, "n": len(s), "x": [1, 2], "y": [3, 4], "sketch": s.tolist(), "place": 0, "frag": f} for i, (s, c) in enumerate(zip(sets, (9, 7, 7, 9))) for f in (False, True) if not f or c == 7]
    got = near_dup.compare_cell(pd.DataFrame(rows), 80)
    assert set(zip(got["a"], got["b"])) == {(1, 0), (3, 1)}


# --- FM-index ------------------------------------------------------------------------------------------------

@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=12), min_size=1, max_size=8), st.lists(st.integers(1, 4), min_size=1, max_size=4))
@settings(max_examples=120, deadline=None)
def test_fm_index_finds_every_occurrence(runs, phrase):
    seq = np.concatenate([np.array([0, *r], np.int64) for r in runs])
    index = decontam_fm.FMIndex(seq, 5, sample=4)
    lo, hi = index.search(np.array([phrase], np.int64), np.array([len(phrase)]))
    got = sorted(index.locate(np.arange(lo[0], max(lo[0], hi[0]))).tolist())
    want = [i for i in range(len(seq)) if seq[i : i + len(phrase)].tolist() == phrase]
    assert got == want


def plain_overlaps(text, items, window):
    words = decontam_fm.WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    hit, found = set(), set()
    for name, item in items:
        iw = decontam_fm.WORD.findall("".join(c.lower() if c.isascii() else c for c in item))
        m = min(window, len(iw))
        for i in range(len(iw) - m + 1) if m else ():
            for p in range(len(words) - m + 1):
                if words[p : p + m] == iw[i : i + m]:
                    hit.update(range(p, p + m))
                    found.add(name)
    return len(words), len(hit), sorted(found)


@given(st.lists(TEXT, min_size=1, max_size=6), st.lists(TEXT, max_size=3))
@settings(max_examples=80, deadline=None)
def test_overlaps_equal_brute_force(texts, items):
    named = [(f"i{k}", t) for k, t in enumerate(items)]
    shard = decontam_fm.Shard(decontam_fm.Windows([(n, decontam_fm.words_of(t.encode())) for n, t in named], 3))
    for t in texts:
        shard.add(t.encode())
    got = [(n, sum(e - b for b, e in spans), found) for n, spans, found in shard.close()]
    assert got == [plain_overlaps(t, named, 3) for t in texts]


@given(st.lists(st.binary(min_size=1, max_size=4), min_size=1, max_size=40), st.integers(1, 6), st.integers(1, 30))
@settings(max_examples=100, deadline=None)
def test_pieces_hold_each_window_once(words, window, size):
    pieces = decontam_fm.pieces_of(words, window, size)
    inside = [tuple(p[i : i + window]) for p in pieces for i in range(max(1, len(p) - window + 1))]
    assert inside == [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


def test_spans_are_removed():
    assert decontam_fm.remove_spans("a b, c d e", [(1, 3)]) == "a  d e"


# --- packing --------------------------------------------------------------------------------------------------

@given(st.lists(st.integers(1, 1024), max_size=200))
@settings(max_examples=60, deadline=None)
def test_first_fit_decreasing(lengths):
    lengths = np.array(sorted(lengths, reverse=True), np.int64)
    bins, offsets, used = packing.first_fit_decreasing(lengths, 1024)
    room = []
    for n, b, o in zip(lengths, bins, offsets):
        first = next((k for k, r in enumerate(room) if r >= n), len(room))
        if first == len(room):
            room.append(1024)
        assert (b, o) == (first, 1024 - room[first])
        room[first] -= n
    assert used == len(room)


@given(st.text(max_size=80))
@settings(max_examples=150, deadline=None)
def test_fast_ids_are_the_tokenizers_ids(text):
    bpe = packing.tokenizer(*tokenizer_files())
    for t in (text, text + "<|endoftext|>x", "a" * 300 + text, text.upper()):
        assert bpe.ids(t).tolist() == bpe.exact.encode(t, add_special_tokens=False).ids


# --- URL automaton --------------------------------------------------------------------------------------------

def plain_glob(glob):
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i):
            out, i = out + ".*", i + 1
        elif c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return re.compile(out, re.S)


@given(st.lists(st.text("ab/.*?\\", max_size=9), min_size=1, max_size=14), st.lists(st.text("ab/.*?", max_size=12), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_automaton_equals_regular_expressions(globs, subjects):
    got = url_automaton.Automaton(globs).run([s.encode() for s in subjects])
    assert got.tolist() == [[bool(plain_glob(g).fullmatch(s)) for g in globs] for s in subjects]


def test_masks_span_words():
    a = url_automaton.Automaton(["x" * 70 + "*", "y" * 200])
    assert a.words == 5
    assert a.run([b"x" * 70, b"x" * 69, b"y" * 200, b"x" * 90 + b"/"]).tolist() == [[True, False], [False, False], [False, True], [False, False]]
    assert url_automaton.Automaton([r.glob for r in RULES]).run([b".a.net/x", b".net", b".example.net/en/1"]).any(axis=1).tolist() == [True, False, True]


# --- WARC -----------------------------------------------------------------------------------------------------

@given(st.lists(st.binary(max_size=300), max_size=30), st.integers(1, 9))
@settings(max_examples=40, deadline=None)
def test_archives_round_trip(payloads, limit):
    records = [warc.record_bytes(f"urn:page:{k}", "http://x/", "response", p, None) for k, p in enumerate(payloads)]
    frames = list(warc.archive_frames(iter(records), limit))
    archives, rest = [], frames
    while rest:  # limit records and one dictionary frame each
        archives.append(b"".join(f + warc.SEPARATOR.encode() for f in rest[: limit + 1]))
        rest = rest[limit + 1 :]
    back = [warc.parse_record(r) for a in archives for r in warc.read_archive(a)]
    assert [r["payload"] for r in back] == payloads


def test_dictionary_leads_the_archive():
    records = [warc.record_bytes(f"urn:page:{k}", f"http://x/{k}", "response", b"<html><body>page %d of many</body></html>" % k * 9, None) for k in range(60)]
    data = b"".join(warc.archive_frames(records, 100))
    magic, size = struct.unpack_from("<II", data)
    assert magic == warc.DICTIONARY_MAGIC and size > 0
    assert list(warc.read_archive(data)) == records
    with pytest.raises(Exception):
        list(warc.read_archive(struct.pack("<II", magic, 0) + data[8 + size :]))  # without the dictionary nothing decodes


@pytest.mark.parametrize("old, new", [(b"WARC/1.1", b"WORC/1.1"), (b"WARC-Date: ", b"X-Date: "), (b"Content-Type: application/http", b"nonsense"), (b"<b>", b"<i>"), (b"\r\n\r\n<b>", b"\r\n\r\n<b")])
def test_broken_records_are_refused(old, new):
    good = warc.record_bytes("urn:page:1", "http://x/", "response", b"<b>hello</b>", None)
    warc.parse_record(good)
    with pytest.raises(warc.WarcError):
        warc.parse_record(good.replace(old, new, 1))


def test_truncated_archives_are_refused():
    data = b"".join(warc.archive_frames([warc.record_bytes("urn:page:1", "", "response", b"x" * 500, None)], 5))
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(data[:-3]))


# --- nearest neighbours ---------------------------------------------------------------------------------------

def popped(forest, x, visit):
    """The leaves that a heap shared by all trees yields, one branch at a time."""
    x = np.append(x, 0.0) * forest.norm / np.linalg.norm(x)
    queue, out = [(0.0, 0, t) for t in range(forest.trees)], []
    while queue and len(out) < visit:
        cost, level, node = heapq.heappop(queue)
        if level == forest.depth:
            out.append(node)
            continue
        m = 1.702 * (x @ forest.normals[level][node] - forest.offsets[level][node]) / forest.spread
        heapq.heappush(queue, (cost + math.log1p(math.exp(m)), level + 1, 2 * node))
        heapq.heappush(queue, (cost + math.log1p(math.exp(-m)), level + 1, 2 * node + 1))
    return out


def test_forest_routes_and_walks():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 16))
    forest = ann_forest.grow(x, float(np.linalg.norm(x, axis=1).max()), 3, 4)
    leaf = forest.route(x)
    assert leaf.shape == (600, 3) and (leaf // 16 == np.arange(3)).all()
    every = forest.leaves_of(x[:5], 99)
    assert all(sorted(v) == list(range(48)) for v in every)
    for visit in (1, 3, 7, 20, 48):
        assert [v.tolist() for v in forest.leaves_of(x[:9], visit)] == [popped(forest, q, visit) for q in x[:9]]
    sizes = np.bincount(leaf.ravel(), minlength=48)
    for v in forest.leaves_of(x[:9], 2, sizes, 200):
        assert max(sizes[v[v // 16 == t]].sum() for t in range(3)) >= 200


def test_cell_search_equals_brute_force():
    rng = np.random.default_rng(1)
    members, queries = rng.integers(-2, 3, (80, 6)).astype(float), rng.integers(-2, 3, (9, 6)).astype(float)
    leaf, rep = rng.integers(0, 9, 80), rng.permutation(80)
    for k in (3, 7, 100):
        visits = [rng.choice(9, n, replace=False) for n in (0, 1, 2, 3, 5, 9, 9, 4, 2)]
        cell = ann_forest.Cell(members, leaf, rep)
        q, c, s = cell.nearest(queries, visits, k)
        for i in range(9):
            own = np.flatnonzero(np.isin(leaf, visits[i]))
            score = members[own] @ queries[i]
            best = own[np.lexsort((rep[own], -score))[:k]]
            assert cell.rep[c[q == i]].tolist() == rep[best].tolist() and np.allclose(s[q == i], np.sort(score)[::-1][:k])
        assert cell.products == sum(np.isin(leaf, v).sum() for v in visits)


def test_leaves_are_dealt_to_cells():
    rng = np.random.default_rng(2)
    sizes = np.concatenate((rng.integers(0, 40, 32), [0, 500, 3, 90, *[1] * 28]))
    first, spread, cells = ann_forest.deal(sizes, 2, 100)
    held = np.zeros(cells)
    for leaf, (f, n) in enumerate(zip(first, spread)):
        assert n == max(1, -(-sizes[leaf] // 100)) and f + n <= cells
        held[f : f + n] += sizes[leaf] / n
    assert held.max() <= 100
    assert not {*first[:32]} & {f for f, z in zip(first[32:], sizes[32:]) if z}


@pytest.mark.parametrize("clustered", [False, True])
def test_forest_saves_work_and_finds_neighbours(clustered):
    """51 282 vectors, the size of the check tool's larger table: without any structure, and in clusters."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((51_282, 64))
    if clustered:
        x = rng.standard_normal((300, 64))[rng.integers(0, 300, len(x))] + 0.4 * x
    x /= np.linalg.norm(x, axis=1)[:, None]
    sample = x[rng.permutation(len(x))[:32_768]]
    forest = ann_forest.grow(sample, 1.0, 4, 12)
    visit = ann_forest.tune(forest, sample, 20, 0.93)
    leaf = forest.route(x)
    asked = rng.choice(len(x), 100, replace=False)
    found = forest.leaves_of(x[asked], visit, np.bincount(leaf.ravel(), minlength=4 * 4096), 21)
    recall, products = [], []
    for i, own in zip(asked, found):
        on = np.zeros(4 * 4096, bool)
        on[own] = True
        times = on[leaf].sum(axis=1)
        score = x @ x[i]
        score[i] = -np.inf
        best = np.argpartition(-score, 20)[:20]
        recall.append((times[best] > 0).mean())
        products.append(times.sum() / len(x))
    assert np.mean(recall) >= 0.9 and np.mean(products) < (0.05 if clustered else 0.5), (np.mean(recall), np.mean(products))


# --- classifiers ----------------------------------------------------------------------------------------------

def made_up(seed, n, syllables):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60))) for _ in range(n)]


def test_language_kernel_tells_languages_apart():
    a, b = made_up(1, 80, ["th", "er", "ing", "on"]), made_up(2, 80, ["sch", "ein", "ü", "keit"])
    model = lang_kernel.fit([("a", t) for t in a[:40]] + [("b", t) for t in b[:40]], landmarks=10)
    lang, score = model.decide(a[40:] + b[40:] + [None, "", "12 !!", "é"])
    assert lang[:80] == ["a"] * 40 + ["b"] * 40 and lang[80:83] == ["und"] * 3 and lang[83] in ("a", "b")
    assert ((score >= 0) & (score <= 1)).all() and (score[80:83] == 0).all()


@given(st.lists(st.text("abcé", min_size=1, max_size=20), min_size=1, max_size=4), st.lists(st.text("abcdé", max_size=30), min_size=1, max_size=4))
@settings(max_examples=60, deadline=None)
def test_presence_is_the_blended_spectrum_kernel(landmarks, texts):
    lm, ts = [lang_kernel.normal(t) for t in landmarks], [lang_kernel.normal(t) for t in texts]
    s = lang_kernel.Spectrum(lm, 3)
    grams = lambda t, n: {t[i : i + n] for i in range(len(t) - n + 1)}
    known = {n: set().union(*(grams(t, n) for t in lm)) for n in (1, 2, 3)}
    got = s.presence(ts) @ s.presence(lm).T
    for i, t in enumerate(ts):
        for j, u in enumerate(lm):
            want = 0.0
            for n in (1, 2, 3):
                x, y = grams(t, n) & known[n], grams(u, n)
                want += len(x & y) / max(1e-9, (len(x) * len(y)) ** 0.5) / 3 if x and y else 0
            assert abs(got[i, j] - want) < 1e-5


def test_quality_network_learns_and_sees_the_whole_text():
    clean, junk = made_up(3, 120, ["th", "er", "ing", "on"]), [t.upper().replace(" ", "!! ") for t in made_up(4, 120, ["th", "er", "ing", "on"])]
    texts = [t.encode() for t in clean[:80] + junk[:80]]
    model = quality_cnn.fit(texts, np.array([1.0] * 80 + [0.0] * 80), steps=200)
    p = model.scores([t.encode() for t in clean[80:] + junk[80:]])
    assert (p[:40] > 0.5).mean() > 0.9 and (p[40:] < 0.5).mean() > 0.9
    assert 0 <= model.scores([None, b""])[0] <= 1
    chunks, counts = quality_cnn.chunked([b"x" * n for n in (0, 1, 512, 513, 5000)])
    assert counts.tolist()[:4] == [1, 1, 1, 2] and (chunks != 0).any(axis=1).tolist()[0] is False
    # every window of the text lies whole in some chunk
    text = bytes(range(1, 251)) * 20
    rows, _ = quality_cnn.chunked([text])
    joined = {r.tobytes()[i : i + quality_cnn.WIDTH] for r in rows for i in range(0, quality_cnn.CHUNK - quality_cnn.WIDTH + 1, quality_cnn.STRIDE)}
    assert all(text[i : i + quality_cnn.WIDTH] in joined for i in range(0, len(text) - quality_cnn.WIDTH, quality_cnn.STRIDE))


def test_quality_without_labels_is_undecided():
    assert quality_cnn.fit([b"x"], np.array([1.0])).scores([b"x", None]).tolist() == [0.5, 0.5]


def test_toxicity_models_tell_classes_apart():
    rng = random.Random(5)
    common_words = [w.encode() for t in made_up(6, 30, ["th", "er", "ing", "on"]) for w in t.split()]
    make = lambda bad: [w for _ in range(60) for w in ([b"nasty"] if bad and rng.random() < 0.05 else [rng.choice(common_words)])]
    toxic, plain = [make(True) for _ in range(80)], [make(False) for _ in range(80)]
    vocabulary = {}
    for t in toxic[:50] + plain[:50]:
        for w in t:
            vocabulary.setdefault(w, len(vocabulary) + 1)
    ids = lambda texts: [np.array([vocabulary.get(w, 0) for w in t]) for t in texts]
    size = len(vocabulary) + 1
    shared = toxicity_kn.Shared.count(ids(toxic + plain + [make(False) for _ in range(700)]), size, toxicity_kn.candidates([ids(toxic[:50]), ids(plain[:50])], size))
    model = toxicity_kn.fit(ids(toxic[:50]), ids(plain[:50]), vocabulary, shared)
    d = np.array([model.difference(x) for x in ids(toxic[50:] + plain[50:])])
    assert common.auc(d, np.arange(60) < 30) > 0.9
    p = model.probability(np.array([model.difference(model.ids(None)), model.difference(model.ids(b"..."))]))
    assert ((p >= 0) & (p <= 1)).all()
    assert toxicity_kn.fit([], ids(plain), vocabulary, shared).probability(np.zeros(2)).tolist() == [0, 0]


def plain_difference(classes, everything, evidence, threshold, text):
    """The mean log-likelihood ratio of ``text`` (words, None: outside the vocabulary) by the module's definition, in dicts."""
    pairs = lambda t: list(zip([""] + t[:-1], t))
    words, both, lefts = Counter(w for t in everything for w in t), Counter(g for t in everything for g in pairs(t)), Counter(a for t in everything for a, _ in pairs(t))
    total, models = sum(words.values()), []

    def own_discount(counts):
        n = Counter(counts)
        return n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5

    for texts in classes:
        c = Counter(g for t in texts for g in pairs(t))
        begin, contexts = Counter(), Counter(b for _, b in c)
        for (x, _), k in c.items():
            begin[x] += k
        d1, d2, n = own_discount(contexts.values()), own_discount(c.values()), sum(contexts.values())
        enough = lambda k, p, q, size: k * math.log(p / q) > max(evidence, threshold * size)
        kept1 = {w: (k - d1) / n for w, k in contexts.items() if k > d1 and enough(k - d1, (k - d1) / n, words[w] / total, n)}
        kept2 = {g: (k - d2) / begin[g[0]] for g, k in c.items() if k >= 3 and enough(k - d2, (k - d2) / begin[g[0]], both[g] / lefts[g[0]], sum(c.values()))}
        w1 = (1 - sum(kept1.values())) / (1 - sum(words[w] / total for w in kept1))
        w2 = {x: (1 - sum(p for g, p in kept2.items() if g[0] == x)) / (1 - sum(both[g] / lefts[x] for g in kept2 if g[0] == x)) for x in [*lefts]}
        models.append((kept1, kept2, w1, w2))
    any2 = {g for m in models for g in m[1]}

    def log(m, a, b):
        kept1, kept2, w1, w2 = m
        if (a, b) in any2:
            return math.log(kept2[a, b] if (a, b) in kept2 else w2[a] * both[a, b] / lefts[a])
        return math.log(w2.get(a, 1.0) if a is not None else 1.0) + math.log(kept1[b] if b in kept1 else w1 * (words[b] / total if b else 1.0))

    return sum(log(models[0], a, b) - log(models[1], a, b) for a, b in pairs(text)) / len(text)


@pytest.mark.parametrize(("evidence", "threshold"), [(0.5, 0.0), (0.2, 0.02)])
def test_kneser_ney_equals_its_definition(evidence, threshold, monkeypatch):
    monkeypatch.setattr(toxicity_kn, "EVIDENCE", evidence)
    rng = random.Random(11)
    draw = lambda weights, n: rng.choices("abcdefgh", weights, k=n)
    toxic, plain = [draw((9, 6, 5, 3, 2, 4, 1, 0), 25) for _ in range(6)], [draw((8, 6, 5, 3, 0.2, 0.1, 0, 2), 25) for _ in range(30)]
    other = [draw((8, 6, 5, 3, 0.3, 0.3, 0.3, 2), 30) + ["x"] for _ in range(9)]
    vocabulary = {w.encode(): k for k, w in enumerate("abcdefgh", 1)}
    ids = lambda texts: [np.array([vocabulary.get(w.encode() if w else b"", 0) for w in t]) for t in texts]
    classes = [ids(toxic), ids(plain)]
    shared = toxicity_kn.Shared.count(ids(toxic + plain + other), 9, toxicity_kn.candidates(classes, 9))
    model = toxicity_kn._model([toxicity_kn.ClassModel(t, 9) for t in classes], vocabulary, shared, threshold)
    assert len(model.codes) and (model.word != model.word[0]).any()
    everything = [[w if w != "x" else None for w in t] for t in toxic + plain + other]
    for text in (*toxic[:3], *plain[:3], ["a", None, "e", "f", "f"], [None], ["h"]):
        assert model.difference(ids([text])[0]) == pytest.approx(plain_difference([toxic, plain], everything, evidence, threshold, text), abs=1e-9)


def test_discounts_are_the_class_own():
    assert toxicity_kn.discount(np.array([1, 1, 1, 2, 5])) == pytest.approx(3 / 5)
    assert toxicity_kn.discount(np.array([4, 1])) == 0.5 == toxicity_kn.discount(np.zeros(0))


def test_auc_counts_ties_half():
    assert common.auc(np.array([1.0, 1.0, 0.0, 2.0]), np.array([True, False, False, True])) == pytest.approx(0.875)


def test_network_equals_a_naive_convolution():
    rng = np.random.default_rng(4)
    q = quality_cnn
    init = lambda *s: rng.standard_normal(s).astype(np.float32)
    model = q.QualityModel(init(256, q.DIM), init(q.WIDTH * q.DIM, q.FILTERS) / 7, init(q.FILTERS), init(q.FILTERS + 1, q.HIDDEN), init(q.HIDDEN + 1))
    texts = [None, b"", b"a", bytes(rng.integers(1, 256, 511, dtype=np.uint8)), bytes(rng.integers(1, 256, 5000, dtype=np.uint8)), ("é" * 700).encode()]
    want = []
    for text in texts:
        text = text or b""
        step = q.CHUNK - q.WIDTH + q.STRIDE
        begins = range(0, max(1, len(text) - (q.CHUNK - step)), step)
        maxima, seen = [], set()
        for begin in begins:
            chunk = text[begin : begin + q.CHUNK].ljust(q.CHUNK, b"\0")
            offsets = range(0, q.CHUNK - q.WIDTH + 1, q.STRIDE)
            seen |= {begin + at for at in offsets}
            maxima.append([max(0.0, max(sum(float(model.embed[chunk[at + j], d]) * float(model.filters[j * q.DIM + d, f]) for j in range(q.WIDTH) for d in range(q.DIM)) for at in offsets) + float(model.bias[f])) for f in (0, 7)])
        assert seen >= set(range(0, max(1, len(text) - q.WIDTH + 1), q.STRIDE))  # windows begin at every STRIDE-th byte, across chunks
        want.append(np.mean(maxima, axis=0))
    chunks, counts = q.chunked([t or b"" for t in texts])
    pooled = np.add.reduceat(model.pooled(chunks), np.cumsum(counts) - counts, axis=0) / counts[:, None]
    assert np.allclose(pooled[:, [0, 7]], want, atol=1e-3)
    whole = np.maximum(np.concatenate((pooled, np.ones((len(texts), 1))), axis=1) @ model.hidden, 0) @ model.out[:-1] + model.out[-1]
    assert np.allclose(model.scores(texts), 1 / (1 + np.exp(-whole)), atol=1e-4)
    assert model.scores(texts[:2]).tolist() == [model.scores([b""])[0]] * 2
