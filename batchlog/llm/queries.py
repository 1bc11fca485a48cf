"""The queries opN_<name> of these operators, with their contracts' parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as decontamination
from . import automaton, minhash, neighbours, packing, quality, suffixes, toxicity, urls, warc

#: The listed rules of op2: verdict, and host with path.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=13)
    return found.drop("items")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A page bears the number of the document made from it; a document of low quality marks its page as bad.
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    return urls.judge(_table(spark, sf_dir, "pages"), labels, URL_RULES)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = automaton.remove_substrings(_table(spark, sf_dir, "documents").select("doc_id", "text"), length=20)
    return kept.select("doc_id", "removal.n_words", "removal.n_removed", "removal.kept_sha256")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), percent=75)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_pages(_table(spark, sf_dir, "pages"), least_bytes=0)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, _table(spark, sf_dir, "labels")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), length=2048, eos=1).drop("ids", "padding")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.remove_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"), length=50)
    return kept.select("doc_id", "removal.n_words", "removal.n_removed", "removal.kept_sha256")


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_url_filters, op3_substring_dedup, op4_near_duplicates, op5_warc, op6_toxicity, op7_packing, op8_quality, op9_neighbours, op10_suffix_dedup)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"



def _repeats_sql(length: int) -> str:
    return f"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + {length}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, len(w) - {length} + 1)) AS i FROM docs WHERE len(w) >= {length})),
later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(0, {length})) AS j FROM later)),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM docs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM docs LEFT JOIN kept ON docs.doc_id = kept.doc_id"""


ORACLE = {
    "op3_substring_dedup": _repeats_sql(20),
    "op10_suffix_dedup": _repeats_sql(50),
    "op4_near_duplicates": f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + least(5, len(w))], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, len(w) - least(5, len(w)) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * met >= 75 * (x.n + y.n - met)),
reach AS (SELECT doc_id AS node, doc_id AS other FROM docs UNION SELECT node, b FROM reach JOIN links ON other = a)
SELECT docs.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, docs.doc_id = min(other) AS kept
FROM docs JOIN reach ON node = docs.doc_id LEFT JOIN sizes ON sizes.doc_id = docs.doc_id GROUP BY docs.doc_id""",
    "op1_decontamination": f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark WHERE item_id IS NOT NULL),
wins AS (SELECT DISTINCT item, least(13, len(w)) AS k, array_to_string(w[i + 1 : i + least(13, len(w))], ' ') AS win
         FROM (SELECT item, w, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
starts AS (SELECT doc_id, k, i, array_to_string(w[i + 1 : i + k], ' ') AS win
           FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM docs, (SELECT DISTINCT k FROM wins) WHERE len(w) >= k)),
found AS (SELECT DISTINCT doc_id, i, starts.k, item FROM starts JOIN wins ON starts.k = wins.k AND starts.win = wins.win),
hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, k)) AS j FROM found) GROUP BY doc_id),
own AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY doc_id)
SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit ON docs.doc_id = hit.doc_id LEFT JOIN own ON docs.doc_id = own.doc_id""",
    "op5_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, h,
             list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INTEGER) + 1, 1) FOR i IN range(32)], 'string_agg', '') AS payload_digest,
             min(page_id) OVER (PARTITION BY h) AS original FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to FROM d""",
    "op9_neighbours": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
           AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_cosine_similarity(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5""",
}
