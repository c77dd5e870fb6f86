"""The corpus operators on Spark: odd rows, clashing columns, brute force, and the registered queries."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import ann_forest, decontam_fm, lang_kernel, near_dup, packing, quality_cnn, queries, token_rollup, toxicity_kn, url_automaton, warc
from gridloom.llm.common import auc, components, likely, scratch

from ..conftest import rows_of

LONG = "tail word " * 30_000
ODD = [(1, None), (2, ""), (3, "one"), (4, "a b c d e f"), (4, "a b c d e f"), (5, "A B c d e f"), (None, "a b c d e f"), (6, " \n\t"), (7, LONG), (8, "héé ß 12")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names operators use themselves."""
    rows = [(i, t, None, None, "x", 1, "n", [0]) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, key string, id int, n string, sig array<int>")


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, small, name):
    assert rows_of(queries.QUERIES[name](spark, small).toPandas()) == rows_of(duck.sql(queries.ORACLE_SQL[name]).df())


# --- near-duplicates ------------------------------------------------------------------------------------------

def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 9), (9, 1), (7, 8), (8, 7), (3, 3)], "a long, b long")
    assert {(r.id, r.component) for r in components(e).collect()} == {(1, 1), (4, 1), (5, 1), (9, 1), (7, 7), (8, 7)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r.component for r in components(chain).collect()} == {0}
    assert components(e.limit(0)).count() == 0


def test_likely_rows_hold_all_that_are_asked_for(spark):
    rows = spark.range(5000).selectExpr("id doc_id", "id _at", "id * 2 _bit")
    ids = rows.filter("doc_id % 41 = 3").select("doc_id")
    got = likely(rows.drop("_at", "_bit"), ids, "doc_id")
    assert ids.join(got, "doc_id", "left_anti").count() == 0 and got.count() < 1000
    assert likely(rows.select("doc_id"), ids.limit(0), "doc_id").count() == 0


def test_near_duplicates_of_odd_rows(odd, no_docs):
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(odd, words=2).collect())
    assert got == [(0, 5, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 5, 4, True), (4, 5, 4, True), (5, 5, 4, False), (6, 0, 6, True), (7, 2, 7, True), (8, 2, 8, True)]
    assert near_dup.near_duplicates(no_docs).count() == 0


def test_documents_with_several_texts_equal_the_sql(spark, monkeypatch):
    import duckdb

    text = lambda x, n=40, changed=(): " ".join(f"{x}{k}" if k not in changed else f"other{x}{k}" for k in range(n))
    a, b, c, d = map(text, "abcd")
    near = lambda x: text(x, changed=(39,))
    rows = [(1, a), (1, b), (3, near("b")), (4, near("a")), (0, c), (5, c), (5, d), (7, near("d")), (2, d), (8, a), (9, text("e")), (9, text("e")), (10, ""), (10, text("f")), (11, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = rows_of(con.sql(queries.ORACLE_SQL["op7_near_dup"]).df())
    for hot in (near_dup.HOT, 1):  # the second: nearly every key and set is salted
        monkeypatch.setattr(near_dup, "HOT", hot)
        monkeypatch.setattr(near_dup, "HOT_SHARE", 1e9)
        got = near_dup.near_duplicates(docs, words=2)
        assert rows_of(got.toPandas()) == want
    component = {r.doc_id: r.component_id for r in got.collect()}
    assert component[1] == component[3] == component[4] == component[8] == 1 and component[0] == component[5] == component[7] == component[2] == 0


def test_salted_keys_give_the_same_groups(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = rows_of(near_dup.near_duplicates(docs, words=2).toPandas())
    monkeypatch.setattr(near_dup, "HOT", 4)
    monkeypatch.setattr(near_dup, "HOT_SHARE", 1e9)
    assert rows_of(near_dup.near_duplicates(docs, words=2).toPandas()) == want


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(400)]
    docs = []
    for _ in range(12):  # groups around one text, from barely to almost alike, so buckets hold several components
        base = rng.choice(words, 60).tolist()
        for _ in range(14):
            t = list(base)
            for p in rng.choice(60, rng.integers(0, 9), replace=False):
                t[p] = rng.choice(words)
            docs.append(" ".join(t))
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    sets = [set(zip(d.split(), d.split()[1:])) for d in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(table, words=2).collect()}
    assert got == {i: find(i) for i in range(len(docs))}


# --- packing --------------------------------------------------------------------------------------------------

def test_packing_holds_every_id_once(spark, odd, no_docs):
    files = queries.tokenizer_files()
    cut = packing.cut(odd, *files, length=64)
    got = packing.pack(cut, odd.count(), length=64, group_docs=4).toPandas()
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(files[0])
    want = sorted([*exact.encode(t or "", add_special_tokens=False).ids, 0] for _, t in ODD)
    by_doc = []
    for doc, t in {(i, t) for i, t in ODD}:
        own = got[got["doc_id"].isna()] if doc is None else got[got["doc_id"] == doc]
        copies = sum(1 for x in ODD if x == (doc, t))
        for _, part in own.groupby(own.groupby("start").cumcount()):
            ids = np.frombuffer(b"".join(part.sort_values("start")["ids"]), "<u4")
            by_doc.append(ids.tolist())
        assert len(own.groupby("start").get_group(0)) == copies
    assert sorted(by_doc) == want
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part["offset"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]] and part["length"].sum() <= 64
    assert packing.pack(packing.cut(no_docs, *files), 0).count() == 0


def test_documents_are_dealt_alike_in_any_order(spark):
    docs = spark.createDataFrame([(k % 40, f"text {k % 40}") for k in range(120)], "doc_id long, text string").coalesce(1)
    files = queries.tokenizer_files()
    deals = [sorted((r.doc_id, r.deal) for r in packing.cut(docs.orderBy(order), *files).collect()) for order in (F.col("doc_id"), F.rand(3))]
    assert [len(set(d)) for d in deals] == [120, 120]
    one = [sorted((r.doc_id, r.deal) for r in packing.cut(docs.sortWithinPartitions(order), *files).collect()) for order in (F.col("doc_id"), F.desc("doc_id"), F.rand(3))]
    assert one[0] == one[1] == one[2]


def test_packing_query(spark, small):
    got = queries.op8_packing(spark, small).toPandas()
    docs = spark.read.parquet(f"{small}/documents.parquet").toPandas()
    exact = packing.tokenizer(*queries.tokenizer_files()).exact
    for d in docs.itertuples():
        ids = np.array([*exact.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        own = got[got["doc_id"] == d.doc_id].sort_values("start")
        assert own["length"].sum() == len(ids) == own["doc_tokens"].iloc[0]
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own["start"], own["length"])] == own["ids_crc32"].tolist()
    used = got.groupby("sequence_id")["length"].sum()
    padding = sum(1024 - u for u in used if u & (u - 1))
    assert used.max() <= 1024 and padding < 0.02 * used.sum()


# --- decontamination ------------------------------------------------------------------------------------------

def test_overlaps_of_odd_rows(spark, odd, no_docs):
    bench = spark.createDataFrame([("i1", "b c d", 1), ("i1", "b c d", 1), ("i2", "tail word tail", 2), (None, "a b c", 3), ("i3", None, 4), ("i4", "...", 5), ("i5", "héé ß", 6)], "item_id string, text string, n_hit int")
    found = decontam_fm.judged(decontam_fm.find_overlaps(odd, bench, window=3))
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r["items"], r.contaminated) for r in found.collect())
    hit = (6, 3, ["i1"], True)
    assert got == [(0, *hit), (1, 0, 0, [], False), (2, 0, 0, [], False), (3, 1, 0, [], False), (4, *hit), (4, *hit), (5, *hit), (6, 0, 0, [], False), (7, 60_000, 59_999, ["i2"], True), (8, 3, 2, ["i5"], True)]
    kept = decontam_fm.without_contaminated(odd, bench, window=3)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 6]
    assert decontam_fm.find_overlaps(no_docs, bench).count() == 0
    assert decontam_fm.find_overlaps(odd, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_a_large_benchmark_is_searched_in_blocks(spark, odd):
    rng = np.random.default_rng(12)
    words = [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(rng.choice(words, n))
    items = [(f"i{k}", text(int(rng.integers(1, 9)))) for k in range(30)] + [("long", text(900)), ("i3", text(7)), (None, "w1 w2 w3"), ("none", None), ("blank", "..")]
    docs = [(k % 50, text(int(rng.integers(0, 80)))) for k in range(60)] + [(99, None), (None, items[2][1])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    table = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, _row int")
    got = {}
    for limit in (decontam_fm.BLOCK_BYTES, 600):
        found = decontam_fm.find_overlaps(table, bench, window=3, limit=limit).collect()
        got[limit] = sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"], [tuple(s) for s in r.spans]) for r in found)
        kept = decontam_fm.without_contaminated(table, bench, window=3, percent=30, limit=limit)
        assert kept.columns == table.columns
        got[limit, "kept"] = sorted(map(str, kept.collect()))
    assert len(list(decontam_fm.benchmark_blocks(bench, 3, 600))) > 5
    assert got[600] == got[decontam_fm.BLOCK_BYTES] and got[600, "kept"] == got[decontam_fm.BLOCK_BYTES, "kept"]
    assert 0 < len(got[600, "kept"]) < len(docs)


def test_shards_are_closed_and_judged_alike(spark, odd, monkeypatch):
    bench = spark.createDataFrame([("i1", "b c d"), ("i2", "tail word tail")], "item_id string, text string")
    shard = decontam_fm.Shard(decontam_fm.Windows([("i1", [b"b", b"c", b"d"]), ("i2", [b"tail", b"word", b"tail"])], 3))
    texts = [t.encode() if t is not None else None for _, t in ODD] * 3
    for t in texts:
        shard.add(t)
    want = shard.close()
    monkeypatch.setattr(decontam_fm, "SHARD_SYMBOLS", 8)  # a shard ends after every few words, between documents
    got = []
    for t in texts:
        shard.add(t)
        if shard.full:
            got += shard.close()
    assert got + shard.close() == want
    assert decontam_fm.find_overlaps(odd, bench, window=3).count() == len(ODD)


# --- URLs -----------------------------------------------------------------------------------------------------

def plain_verdict(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")
    fits = [r for r in queries.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


URLS = [None, "", "net/", "http://net/", "http://NET", "https://a.Example.NET/en/x?y#z", "https://example.net?en/", "http://xexample.net/en/", "http://example.com/de/", "http://a.b.example.com/de/1", "http://org/fr/", "http://w.org/fr", "x://y://z.net/", "http://exämple.net/é", "http://a.net/" + "q" * 200_000, "http://a.net:80/", "://net/", "http://evil.com/a.net/"]


def test_urls(spark):
    pages = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(URLS + URLS)], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_automaton.judge_urls(pages, queries.RULES).collect()}
    assert got == {k: plain_verdict(u) for k, u in enumerate(URLS + URLS)}
    assert url_automaton.judge_urls(pages.limit(0), queries.RULES).count() == 0
    assert {r.verdict for r in url_automaton.judge_urls(pages, [], default="block").collect()} == {"block"}


# --- WARC -----------------------------------------------------------------------------------------------------

def test_warc_of_odd_pages(spark):
    rows = [(1, "http://a", None), (2, None, ""), (3, "http://c", "<b>x</b>"), (7, "http://d", "<b>x</b>"), (5, "http://e\r\nX: y", "<b>x</b>"), (9, "u", "ä" * 400_000), (None, "n", "alone")]
    pages = spark.createDataFrame([(*r, "frame") for r in rows], "page_id long, url string, html string, key string")
    path = scratch(spark, "warc")
    warc.write_warc(pages.repartition(2), path, records=2)
    got = {r.record_id.removeprefix("urn:page:"): r for r in warc.read_warc(spark, path).collect()}
    assert set(got) == {"1", "2", "3", "5", "7", "9", ""}
    assert {k: r.warc_type for k, r in got.items() if r.warc_type == "revisit"} == {"1": "revisit", "3": "revisit", "5": "revisit"}
    assert got["3"].refers_to == "urn:page:7" and got["1"].refers_to == "urn:page:2"
    assert bytes(got["9"].payload) == ("ä" * 400_000).encode() and got["9"].payload_bytes == 800_000
    assert got["5"].payload_digest == got["7"].payload_digest and bytes(got["5"].payload) == b"" and got["5"].payload_bytes == 8
    files = spark.read.format("binaryFile").load(path).filter("length > 0").count()
    assert files >= 3
    path = scratch(spark, "warc")
    warc.write_warc(pages, path, min_bytes=100)
    assert {r.warc_type for r in warc.read_warc(spark, path).collect()} == {"response"}
    path = scratch(spark, "warc")
    warc.write_warc(pages.limit(0), path)
    assert warc.read_warc(spark, path).count() == 0


def test_warc_of_rows_that_share_an_id(spark):
    rows = [(7, "http://a", "<b>x</b>"), (7, "http://b", "<b>x</b>"), (3, "http://c", "<b>x</b>"), (3, "http://c", "<b>x</b>"), (4, "http://d", "only"), (4, "http://d", "only"), (4, "http://d", "other")]
    path = scratch(spark, "warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = sorted((r.record_id, r.target_uri, r.warc_type, r.refers_to, r.payload_bytes) for r in warc.read_warc(spark, path).collect())
    page = lambda k: f"urn:page:{k}"
    assert got == sorted([(page(7), "http://a", "response", None, 8), (page(7), "http://b", "response", None, 8), *[(page(3), "http://c", "revisit", page(7), 8)] * 2, *[(page(4), "http://d", "response", None, 4)] * 2, (page(4), "http://d", "response", None, 5)], key=lambda r: tuple(map(str, r)))


def test_archives_are_bounded_in_bytes(spark):
    rng = np.random.default_rng(3)
    pages = spark.createDataFrame([(k, "u", rng.bytes(30_000).hex()) for k in range(40)], "page_id long, url string, html string").coalesce(1)
    path = scratch(spark, "warc")
    warc.write_warc(pages, path, max_bytes=200_000)
    sizes = [r.length for r in spark.read.format("binaryFile").load(path).select("length").collect()]
    assert len(sizes) > 4 and max(sizes) < 300_000
    assert sorted(r.record_id for r in warc.read_warc(spark, path).collect()) == sorted(f"urn:page:{k}" for k in range(40))


# --- nearest neighbours ---------------------------------------------------------------------------------------

def test_search_with_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.standard_normal(8).round(3).tolist(), "x") for k in range(200)]
    rows += [(200 + k, [1.0] * 8, "x") for k in range(60)]  # copies, more than k of them
    rows += [(300, None, "x"), (301, [0.0] * 8, "x"), (302, [float("nan")] + [1.0] * 7, "x"), (303, [None] + [1.0] * 7, "x"), (304, [float("inf")] * 8, "x"), (305, [1.0] * 3, "x"), (None, [1.0] * 8, "x"), (7, rows[7][1], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = ann_forest.search(table, F.col("vec_id") % 20 == 0, k=5, visit=1.0, cell_rows=100).toPandas()
    good = {k: np.array(v) for k, v, _ in rows if k is not None and k < 300}
    ids = np.array(sorted(good))
    x = np.stack([good[i] for i in ids])
    want = {}
    for q in ids[ids % 20 == 0]:
        s = (x * good[q]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:5]
        want[q] = ids[order].tolist()
    assert {q: g.sort_values("rank")["vec_id"].tolist() for q, g in got.groupby("query_id")} == want
    assert got.groupby("query_id")["rank"].apply(lambda r: sorted(r) == [1, 2, 3, 4, 5]).all()
    one = ann_forest.search(table.filter("vec_id in (0, 1, 2)"), F.col("vec_id") % 20 == 0, k=5)
    assert one.count() == 2
    assert ann_forest.search(table.limit(0), F.lit(True)).count() == 0


def test_small_tables_give_all_that_there_are(spark):
    rng = np.random.default_rng(4)
    for n, k in ((18, 20), (26, 20)):
        table = spark.createDataFrame([(i, rng.standard_normal(6).tolist()) for i in range(n)], "vec_id long, embedding array<double>")
        got = ann_forest.search(table, F.lit(True), k=k).groupBy("query_id").count().collect()
        assert len(got) == n and {r["count"] for r in got} == {min(k, n - 1)}


def test_ties_of_binary_vectors(spark):
    x = (np.arange(1, 2048)[:, None] >> np.arange(11)) & 1  # a query's best may be tied with a thousand others
    ids = np.random.default_rng(6).permutation(len(x))
    table = spark.createDataFrame([(int(i), v.astype(float).tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = ann_forest.search(table, F.lit(True), k=5, visit=1.0).toPandas()
    score = x @ x.T
    np.fill_diagonal(score, -1)
    want = {int(ids[q]): ids[np.lexsort((ids, -score[q]))[:5]].tolist() for q in range(len(x))}
    assert {q: g.sort_values("rank")["vec_id"].tolist() for q, g in got.groupby("query_id")} == want


def test_recall(spark, small):
    got = queries.op3_ann_forest(spark, small).toPandas()
    e = spark.read.parquet(f"{small}/embeddings.parquet").toPandas()
    x, ids = np.stack(e["embedding"]).astype(float), e["vec_id"].to_numpy()
    found = []
    for q, g in got.groupby("query_id"):
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        found.append(len(set(best) & set(g["vec_id"])) / 20)
        assert np.allclose(g.set_index("vec_id")["score"], {i: v for i, v in zip(ids, s)} and [s[ids == i][0] for i in g["vec_id"]])
    assert np.mean(found) >= 0.9


# --- classifiers ----------------------------------------------------------------------------------------------

def test_classifiers_on_odd_rows(spark, odd, no_docs):
    labels = spark.createDataFrame([(4, 1), (7, 0), (8, 0), (3, 1), (3, 0), (None, 1), (99, 1)], "doc_id long, y int")
    quality = quality_cnn.train(odd, labels, "y")
    got = quality_cnn.score_documents(odd, quality).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    toxic = toxicity_kn.train(odd, labels, "y")
    assert len([r for r in toxicity_kn.score_documents(odd, toxic).collect() if 0 <= r.score <= 1]) == len(ODD)
    none = lang_kernel.fit(lang_kernel.training_rows(odd, F.lit(False)))  # no language is known
    assert {r.lang_pred for r in lang_kernel.identify(odd, none).collect()} == {"und"}
    assert quality_cnn.score_documents(no_docs, quality_cnn.train(no_docs, labels, "y")).count() == 0
    assert toxicity_kn.score_documents(no_docs, toxicity_kn.train(no_docs, labels, "y")).count() == 0


def test_scores_of_odd_rows(spark, odd, no_docs):
    """Null, empty and wordless texts have one score, copies have one, unlearned and contradicting labels change nothing."""
    extra = spark.createDataFrame([(20 + k, f"good plain text number {k} of many") for k in range(12)] + [(40 + k, f"bad nasty words {k} nasty bad") for k in range(12)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(extra)
    labels = spark.createDataFrame([(20 + k, 1) for k in range(12)] + [(40 + k, 0) for k in range(12)] + [(3, 1), (3, 0)], "doc_id long, y int")
    for op in (quality_cnn, toxicity_kn):
        model = op.train(docs, labels, "y")
        got = docs.select("doc_id").distinct().count(), [(r.doc_id, r.score) for r in op.score_documents(odd, model).collect()]
        score = dict(got[1])
        assert len(got[1]) == len(ODD) and all(0 <= s <= 1 for _, s in got[1])
        assert score[1] == score[2] and len({s for i, s in got[1] if i == 4}) == 1 and score[None] == score[4]
        other = op.train(docs, labels.filter("doc_id <> 3"), "y")
        assert dict((r.doc_id, r.score) for r in op.score_documents(odd, other).collect()) == score
        told = {r.doc_id: r.score for r in op.score_documents(extra, model).collect()}
        assert np.mean([told[20 + k] for k in range(12)]) > np.mean([told[40 + k] for k in range(12)]) + 0.2
        one = op.train(docs, labels.filter("y = 1"), "y")
        assert {r.score for r in op.score_documents(odd, one).collect()} == ({0.5} if op is quality_cnn else {0.0})
        assert op.score_documents(no_docs, model).count() == 0
    blank = toxicity_kn.train(docs, labels, "y")
    assert len({r.score for r in toxicity_kn.score_documents(docs.filter("doc_id in (1, 2, 6)"), blank).collect()}) == 1


def test_languages_of_odd_rows(spark, odd, no_docs):
    learned = spark.createDataFrame([(k, f"the cat and the dog {k} went there", "en") for k in range(20)] + [(k, f"der hund und die katze {k} gingen dort", "de") for k in range(20, 40)], "doc_id long, text string, lang string")
    model = lang_kernel.fit(lang_kernel.training_rows(learned, F.lit(False)))
    got = [(r.doc_id, r.lang_pred, r.score) for r in lang_kernel.identify(odd, model).collect()]
    assert len(got) == len(ODD) and {(i, s) for i, p, s in got if p == "und"} == {(1, 0.0), (2, 0.0), (6, 0.0)}
    assert len({(p, s) for i, p, s in got if i == 4}) == 1 and all(0 <= s <= 1 for *_, s in got)
    kept = lang_kernel.identified_documents(odd, model, 0.01)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 4, 4, 5, 7, 8]
    assert lang_kernel.identify(no_docs, model).count() == 0


def test_quality_query(spark, small):
    small = small.replace("sf0.001", "sf0.1")
    got = queries.op4_quality(spark, small).toPandas()
    y = spark.read.parquet(f"{small}/labels.parquet").toPandas()
    m = got.merge(y, on="doc_id")
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]).all()
    assert (got["predicted"] == (got["score"] >= 0.5)).all()
    held = m[m["held_out"]]
    assert auc(held["score"].to_numpy(), held["quality"].to_numpy() == 1) > 0.98
    assert held[held["quality"] == 1]["predicted"].mean() > 0.98


def test_language_query(spark, small):
    got = queries.op5_language(spark, small).toPandas()
    d = spark.read.parquet(f"{small}/documents.parquet").toPandas()
    m = got.merge(d, on="doc_id")
    assert (m[m["held_out"]]["lang_pred"] == m[m["held_out"]]["lang"]).mean() > 0.95


def test_toxicity_query(spark, small):
    got = queries.op6_toxicity(spark, small.replace("sf0.001", "sf0.1")).toPandas()
    y = spark.read.parquet(f"{small.replace('sf0.001', 'sf0.1')}/labels.parquet").toPandas()
    m = got.merge(y, on="doc_id")
    held = m[m["held_out"]]
    assert auc(held["score"].to_numpy(), held["toxic"].to_numpy() == 1) > 0.9
    assert held[held["toxic"] == 0]["predicted"].mean() < 0.02


def test_toxicity_threshold_does_not_depend_on_the_sample(spark):
    rng = np.random.default_rng(9)

    def text(toxic):  # the classes overlap
        return " ".join(np.where(rng.random(60) < (0.1 if toxic else 0.03), rng.integers(1, 9, 60), rng.integers(9, 1000, 60)).astype(str))

    rows = [(k, text(k % 10 == 0), int(k % 10 == 0)) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity_kn.train(docs, docs.select("doc_id", "toxic"), per_class=150)  # 150 of 150 and of 1350
    got = docs.join(toxicity_kn.score_documents(docs, model), "doc_id").selectExpr("toxic", "score", "score >= 0.5 p").toPandas()
    assert abs(got["score"].mean() - 0.1) < 0.05
    assert got[got["toxic"] == 0]["p"].mean() < 0.03 and got[got["toxic"] == 1]["p"].mean() > 0.4


# --- rollups --------------------------------------------------------------------------------------------------

def test_rollup_commits_once(spark):
    store = token_rollup.RollupStore(spark, scratch(spark, "rollup"))
    assert store.totals().count() == 0
    side = "struct<source: string, lang: string, tokenizer: string, tokens: long>"
    schema = f"before {side}, after {side}, tokens long"
    load = spark.createDataFrame([(None, ("s", "en", "v1", 5), 0), (None, ("s", "en", "v1", 7), 0), (None, (None, None, "v1", 2), 0), (None, None, 0), (None, ("t", "en", "v1", None), 0)], schema)
    assert store.commit("a", load) and not store.commit("a", load) and store.committed("a")
    edit = spark.createDataFrame([(("s", "en", "v1", 5), None, 0), (("s", "en", "v1", 7), ("s", "fr", "v2", 9), 0)], schema)
    assert store.commit("b", edit)
    want = {("s", "fr", "v2", 1, 9), (None, None, "v1", 1, 2), ("t", "en", "v1", 1, 0)}
    assert {tuple(r) for r in store.totals().collect()} == want
    signed = token_rollup.signed_sums(edit)
    signed.write.parquet(f"{store.path}/sums/unfinished")  # an attempt that failed before its marker
    assert {tuple(r) for r in store.totals().collect()} == want
    store.compact()
    assert not store.commit("a", load) and store.commit("c", load.limit(0))
    assert {tuple(r) for r in store.totals().collect()} == want


def test_commits_during_compaction_count_once(spark):
    side = token_rollup._SIDE
    batch = lambda n: spark.createDataFrame([(None, ("s", "en", "v1", n))], f"before {side}, after {side}")
    store = token_rollup.RollupStore(spark, scratch(spark, "rollup"))
    store.commit("a", batch(5))
    other = token_rollup.RollupStore(spark, store.path)
    summed = store._sum

    def late(parts):  # another writer commits while the fold is written
        other.commit("b", batch(7))
        return summed(parts)

    store._sum = late
    store.compact()
    assert [tuple(r) for r in other.totals().collect()] == [("s", "en", "v1", 2, 12)]
    other.compact()
    other.commit("c", batch(1))
    assert [tuple(r) for r in other.totals().collect()] == [("s", "en", "v1", 3, 13)]
    assert not other.commit("a", batch(5)) and not other.commit("b", batch(7))


def test_white_space_tokens(spark):
    texts = [None, "", " ", "a", " a  b\tc\n", "\x0b\x0cé\r\u00a0x y", "x" * 100_000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in rows.select(token_rollup.whitespace_tokens(F.col("t"))).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_subword_counts(spark, odd):
    docs = odd.select("doc_id", "text")
    got = token_rollup.subword_tokens(docs, ["text"], *queries.tokenizer_files()).collect()
    exact = packing.tokenizer(*queries.tokenizer_files()).exact
    assert sorted(r.text for r in got) == sorted(len(exact.encode(t or "", add_special_tokens=False).ids) for _, t in ODD)


def test_rollup_query_with_subwords(spark, small):
    got = queries.op1_token_counts(spark, small).toPandas()
    d = spark.read.parquet(f"{small}/documents.parquet").toPandas().merge(spark.read.parquet(f"{small}/labels.parquet").toPandas(), on="doc_id", how="left")
    d = d[d["toxic"] != 1]
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(queries.tokenizer_files()[0])
    d["n"] = [len(exact.encode(t.replace("|", " ") if q == 0 else t, add_special_tokens=False).ids) for t, q in zip(d["text"], d["quality"])]
    want = d.groupby(["source", "lang"])["n"].agg(["count", "sum"])
    own = got[got["tokenizer"] == "byte_bpe_50k@1"].set_index(["source", "lang"])
    assert own["tokens"].to_dict() == want["sum"].to_dict() and own["docs"].to_dict() == want["count"].to_dict()


# --- pipeline -------------------------------------------------------------------------------------------------

def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "dedup", "decontaminate", "pack"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, small).cache()
        assert after.columns == docs.columns
        was, now = {tuple(r) for r in before.collect()}, {tuple(r) for r in after.collect()}
        assert now and now <= was
        before = after
    # what the rules of each stage keep, by brute force
    sets = [set(zip(*[t.split()[k:] for k in range(5)])) for (t,) in before.select(F.lower("text")).collect()]
    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            assert not n or n < 0.8 * (len(sets[i]) + len(sets[j]) - n)
    packed = corpus_pipeline.pack(spark, before, small).toPandas()
    assert set(packed["doc_id"]) == {r.doc_id for r in before.collect()}
    digest = hashlib.sha256(b"".join(packed.sort_values(["doc_id", "start"])["ids"])).hexdigest()
    again = corpus_pipeline.run(spark, small).toPandas()
    assert hashlib.sha256(b"".join(again.sort_values(["doc_id", "start"])["ids"])).hexdigest() == digest


def test_pipeline_with_odd_rows(spark, odd, small):
    docs = odd.select("doc_id", "text", "lang", "source").withColumn("n_chars", F.length("text").cast("long"))
    rows = sorted(map(str, docs.collect()))
    stages = dict(corpus_pipeline.STAGES)
    assert set(map(str, stages["quality"](spark, docs, small).collect())) <= set(rows)
    assert sorted(map(str, stages["language"](spark, docs, small).collect())) == rows  # none is labelled: none can be learned
    assert sorted(map(str, stages["decontaminate"](spark, docs, small).collect())) == rows  # no benchmark passage among them
    left = sorted((r.doc_id or 0, r.text) for r in stages["dedup"](spark, docs, small).collect() if r.text is not None)
    assert left == [(2, ""), (3, "one"), (4, "a b c d e f"), (6, " \n\t"), (7, LONG), (8, "héé ß 12")]
    packed = stages["pack"](spark, docs, small).toPandas()
    assert len(packed[packed["start"] == 0]) == len(ODD) and packed["length"].sum() == packed[packed["start"] == 0]["doc_tokens"].sum()
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, small).count() == 0, name


def test_pipeline_dedup_tells_rows_apart(spark, small):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a), (1, b), (2, b), (3, a), (None, a), (None, c), (None, c), (5, ""), (5, ""), (5, " "), (6, ""), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_row", F.lit(7))
    got = corpus_pipeline.dedup(spark, docs, small)
    assert got.columns == docs.columns
    want = [(1, a), (1, b), (None, c), (5, ""), (5, " "), (6, ""), (None, "")]
    assert sorted(((r.doc_id or 0, r.text) for r in got.collect())) == sorted((i or 0, t) for i, t in want)
