"""The registered queries of this package: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import read

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.topk import top_k

    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256.0 * CAST(x AS DOUBLE))::BIGINT) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s) WHERE n <= 5
"""


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import quality

    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(~quality.held_out()))
    scored = quality.classify(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted with their tokens in one vocabulary and revised to
    another, whose batch is sent twice, as after a lost acknowledgement; those that labels
    mark as toxic are deleted; a compaction follows. Texts are read once, for both counts."""
    import uuid

    from tessera.llm import token_rollup as t
    from tessera.llm.shared import materialize

    old, new = t.TOKENIZERS
    counted = materialize(t.count_tokens(read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")), "counted")
    before, after = (counted.where(F.col("tokenizer") == v) for v in (old, new))
    toxic = read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    rollup = t.open_rollup(spark, f"token-rollup-{uuid.uuid4().hex}")
    rollup.commit("1-insert", t.inserts(before))
    revised = t.revisions(t.inserts(before), t.inserts(after))
    rollup.commit("2-revise", revised)
    rollup.commit("2-revise", revised)
    rollup.commit("3-delete", t.deletes(t.inserts(after.join(toxic, "doc_id", "left_semi"))))
    rollup.compact()
    return rollup.totals()


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontaminate import benchmark_hits, digest

    return digest(benchmark_hits(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark")))


_WORDS4 = "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS4} AS w FROM documents),
b AS (SELECT item_id, {_WORDS4} AS w FROM benchmark),
items AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0),
places AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM d, (SELECT DISTINCT n FROM items), unnest(range(1, greatest(len(w) - n + 2, 1))) AS t(i)),
hits AS (SELECT DISTINCT r, i, n, item_id FROM places JOIN items USING (n, win)),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(p) GROUP BY r),
hit_items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.jaccard_join import jaccard_components

    return jaccard_components(read(spark, sf_dir, "documents"))


OP5_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM words, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT words.doc_id, count(s) AS n FROM words LEFT JOIN shingles USING (doc_id) GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS d, doc_id AS c FROM sizes UNION SELECT d, b FROM reach JOIN links ON c = a)
SELECT d AS doc_id, any_value(n) AS n_shingles, min(c) AS component_id FROM reach JOIN sizes ON d = doc_id GROUP BY 1
"""


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import secrets

    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import language_id as l

    docs = read(spark, sf_dir, "documents")
    model = l.train(docs.where(l.learnable()))
    return l.identify(docs.select("doc_id", "text"), model).select("doc_id", l.held_out().alias("held_out"), "lang_pred", "score")


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import licenses

    return licenses.report(licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text")))


RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.url_rules import judge_urls

    return judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
OP9_SQL = f"""
WITH parts AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT r, page_id, {LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(h, p, v) AS (VALUES {_VALUES}),
fits AS (SELECT r, h || p AS rule, v FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
         QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM split LEFT JOIN fits USING (r)
"""


def op10_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sentencepiece_codec import encode

    return encode(read(spark, sf_dir, "documents").select("doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_exact_top_k, op2_quality_classifier, op3_token_counts, op4_benchmark_decontamination, op5_ngram_jaccard_join, op6_secret_scans, op7_language_id, op8_license_scans, op9_url_filters, op10_sentencepiece_codec, pipeline)
}
SQL: dict[str, str] = {
    "op1_exact_top_k": OP1_SQL,
    "op4_benchmark_decontamination": OP4_SQL,
    "op5_ngram_jaccard_join": OP5_SQL,
    "op9_url_filters": OP9_SQL,
}
