"""One query for each corpus operator, over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_forest, decontam_fm, lang_kernel, near_dup, packing, quality_cnn, token_rollup, toxicity_kn, url_automaton, warc
from .common import scratch, written

RULES = [
    url_automaton.Rule("block", "net", "/"),
    url_automaton.Rule("allow", "example.net", "/en/"),
    url_automaton.Rule("block", "example.com", "/de/"),
    url_automaton.Rule("allow", "org", "/fr/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_files(folder: str | None = None) -> tuple[str, str, str]:
    """Vocabulary, ranks and pattern of the byte-level BPE; ``folder`` overrides where the files are."""
    import public_tokenizers

    at = (lambda name: f"{folder}/{name}") if folder else public_tokenizers.path
    return at("byte_bpe_50k.json"), at("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def fold(key: str, parts: int, held: int) -> Column:
    """Whether a row is held out: crc32 of its id as text, modulo ``parts``; rows without id aren't."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts == held, F.lit(False))


def _rollup(spark: SparkSession, sf_dir: str, subwords: bool) -> DataFrame:
    """Load all documents, take the toxic ones down, revise the low-quality ones, and replay both earlier batches."""
    text = F.col("text").cast("string")
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), text.alias("text"))
    clean = F.replace("text", F.lit("|"), F.lit(" "))
    docs = docs.withColumns({"n_words": token_rollup.whitespace_tokens(F.col("text")).cast("long"), "n_words_clean": token_rollup.whitespace_tokens(clean).cast("long")})
    versions = {"words@1": ("n_words", "n_words_clean")}
    if subwords:
        docs = docs.withColumn("other", F.when(F.contains("text", F.lit("|")), clean))
        docs = token_rollup.subword_tokens(docs, ["text", "other"], *tokenizer_files())
        docs = docs.withColumnRenamed("text", "n_ids").withColumn("n_ids_clean", F.when(F.col("other") > 0, F.col("other")).otherwise(F.col("n_ids"))).drop("other")
        versions["byte_bpe_50k@1"] = ("n_ids", "n_ids_clean")
    else:
        docs = docs.drop("text")
    flags = _table(spark, sf_dir, "labels").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"), F.max((F.col("quality") == 0).cast("int")).alias("poor"))
    counts = written(docs, "counts").join(flags, "doc_id", "left").withColumns({"toxic": F.coalesce("toxic", F.lit(0)), "poor": F.coalesce("poor", F.lit(0))})
    counts = written(counts, "flagged")

    def images(rows: DataFrame, before: int | None, after: int | None) -> DataFrame:
        each = [F.struct(*token_rollup.change(*[None if side is None else token_rollup.image(F.col("source"), F.col("lang"), F.lit(name), F.col(cols[side])) for side in (before, after)])) for name, cols in versions.items()]
        return rows.select(F.explode(F.array(*each)).alias("c")).select("c.*")

    store = token_rollup.RollupStore(spark, scratch(spark, "rollup"))
    takedown = images(counts.filter("toxic = 1"), 0, None)
    store.commit("load", images(counts, None, 0))
    store.commit("takedown", takedown)
    store.commit("revise", images(counts.filter("toxic = 0 and poor = 1"), 0, 1))
    store.commit("load", images(counts, None, 0))
    store.commit("takedown", takedown)
    return store.totals()


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir, subwords=True)


def op1_token_counts_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir, subwords=False)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    number = lambda c: F.substring_index(c, ":", -1).try_cast("long")
    records = warc.read_warc(spark, path)
    return records.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), number(F.col("refers_to")).alias("refers_to"))


def op3_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _table(spark, sf_dir, "documents"), fold("doc_id", 3, 1)
    model = quality_cnn.train(docs, _table(spark, sf_dir, "labels").filter(~held).select("doc_id", "quality"))
    scored = quality_cnn.score_documents(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _table(spark, sf_dir, "documents"), fold("doc_id", 4, 2)
    model = lang_kernel.fit(lang_kernel.training_rows(docs, held))
    return lang_kernel.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _table(spark, sf_dir, "documents"), fold("doc_id", 5, 0)
    model = toxicity_kn.train(docs, _table(spark, sf_dir, "labels").filter(~held).select("doc_id", "toxic"))
    scored = toxicity_kn.score_documents(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), words=2, percent=80)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    pieces = packing.cut(docs, *tokenizer_files()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    packed = packing.pack(pieces, docs.count())
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam_fm.judged(decontam_fm.find_overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=13), percent=5)
    digest = F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_automaton.judge_urls(_table(spark, sf_dir, "pages"), RULES, default="allow")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op1_token_counts_words, op2_warc, op3_ann_forest, op4_quality, op5_language, op6_toxicity, op7_near_dup, op8_packing, op9_decontamination, op10_url_filter)
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_COUNT = r"len(regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+'))"

ORACLE_SQL: dict[str, str] = {
    "op1_token_counts_words": f"""
WITH flags AS (
  SELECT doc_id, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS poor
  FROM labels GROUP BY doc_id)
SELECT source, lang, 'words@1' AS tokenizer, count(*) AS docs,
  sum(CASE WHEN coalesce(poor, 0) = 1 THEN {_COUNT.format("replace(text, '|', ' ')")} ELSE {_COUNT.format("text")} END)::BIGINT AS tokens
FROM documents LEFT JOIN flags USING (doc_id)
WHERE coalesce(toxic, 0) = 0
GROUP BY source, lang""",
    "op2_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top, count(*) OVER (PARTITION BY h) AS n FROM p)
SELECT page_id, octet_length(body)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + 10 * (i // 8)::BIGINT, 10))::BIGINT >> (35 - 5 * (i % 8))::BIGINT) & 31)::BIGINT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN n > 1 AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM k""",
    "op7_near_dup": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) = 1 THEN [words[1]]
    ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END)) AS shingles FROM w),
c AS (SELECT shingles, min(doc_id) AS rep, len(shingles) AS n FROM s WHERE len(shingles) > 0 GROUP BY shingles),
u AS (SELECT rep, n, unnest(shingles) AS shingle FROM c),
pairs AS (
  SELECT a.rep AS x, b.rep AS y, a.n AS na, b.n AS nb, count(*) AS both
  FROM u a JOIN u b ON a.shingle = b.shingle AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY ALL HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
several AS (SELECT doc_id FROM s WHERE len(shingles) > 0 GROUP BY doc_id HAVING count(DISTINCT shingles) > 1),
same AS (SELECT DISTINCT s.doc_id AS x, c.rep AS y FROM s JOIN several USING (doc_id) JOIN c ON s.shingles = c.shingles WHERE s.doc_id <> c.rep),
links AS (SELECT x, y FROM pairs UNION ALL SELECT x, y FROM same),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT rep, rep FROM c UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
root AS (SELECT x AS rep, min(y) AS component FROM reach GROUP BY x)
SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, coalesce(root.component, s.doc_id) AS component_id,
  s.doc_id = coalesce(root.component, s.doc_id) AS kept
FROM s LEFT JOIN c ON s.shingles = c.shingles LEFT JOIN root USING (rep)""",
    "op9_decontamination": rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item, m, array_to_string(words[i : i + m - 1], ' ') AS win
  FROM (SELECT item, words, least(13, len(words)) AS m, unnest(range(1, greatest(len(words) - 13, 0) + 2)) AS i FROM b WHERE len(words) > 0)),
dw AS (
  SELECT rid, i, m, array_to_string(words[i : i + m - 1], ' ') AS win
  FROM (SELECT rid, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(words) >= m)),
hit AS (SELECT dw.rid, dw.i, dw.m, bw.item FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win),
n AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + m)) AS k FROM hit) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN it USING (rid)""",
    "op10_url_filter": rf"""
WITH p AS (
  SELECT page_id, {_LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")} AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r AS (
  SELECT *, CASE
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r""",
}
