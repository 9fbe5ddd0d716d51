"""The registered queries of the operators, one for each, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers as vocabularies
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, workdir
from . import bpe, clusters, decontaminate, html_text, passages, pii, quality, ranked, simhash, token_counts, token_files, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_text.main_text(pages)
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: (host, path, verdict)
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@register
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES) + " AS rules(host, path, verdict)")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op2_url_filter"] = """
WITH cut AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), parsed AS (
    SELECT page_id,
        translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
    FROM cut
), rules(rule_host, rule_path, verdict) AS (
    VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), urls AS (
    SELECT DISTINCT host, path FROM parsed
), best AS (
    SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
    FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY host, path
)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
"""


@register
def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


#: The query runs alone, so its workers may keep more than those of the pipeline.
KEPT_WORDS = 220_000


@register
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = vocabularies.path("byte_bpe_50k.tiktoken")
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(texts, ranks, vocabularies.PATTERN, kept=KEPT_WORDS).select("doc_id", "ids")
    both = bpe.decode(ids, ranks)
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return both.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@register
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workdir(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), folder, vocabularies.path("word_bpe_49k.json"), end_id=2)
    rows = token_files.read_tokens(spark, folder)
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return rows.select(F.col("key").alias("doc_id"), "start", n_tokens.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@register
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@register
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rid"), "text")
    found = decontaminate.contamination(rows, table(spark, sf_dir, "benchmark"))
    hit = F.array_distinct(F.flatten(F.transform("matches", lambda m: F.sequence(m["start"], m["start"] + m["n_words"] - 1))))
    return found.select(F.col("rid").alias("doc_id"), "n_words", F.size(hit).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.col("matches.item_id"))).alias("items")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op7_decontamination"] = f"""
WITH items AS (
    SELECT item_id, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
    SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, len(x) AS n, array_to_string(x, ' ') AS k
    FROM (SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda i: list_slice(w, i, i + 9))) AS x FROM items WHERE len(w) > 0) AS cut
), docs AS (
    SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents
), places AS (
    SELECT rid, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {{'i': i, 'k': array_to_string(list_slice(w, i, i + n - 1), ' ')}})) AS p
    FROM docs, (SELECT DISTINCT n FROM windows) AS lengths
), hits AS (
    SELECT rid, item, p.i AS i, places.n AS n FROM places JOIN windows ON windows.n = places.n AND windows.k = p.k
), covered AS (
    SELECT rid, count(DISTINCT word) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS word FROM hits) AS spread GROUP BY rid
), found AS (
    SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT rid, item FROM hits) AS pairs GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (rid) LEFT JOIN found USING (rid)
"""


def _is_kind(kind, span):
    return span["kind"] == kind


@register
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(texts, pii.train(pii.labelled(spark))).select("doc_id", "spans")
    written = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, partial(_is_kind, kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(F.array_join(F.transform(base, written), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", written), ",").alias("spans"),
    )


@register
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    verdicts = quality.judge(cut_lineage(quality.measure(texts).drop("text")))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(texts, vocabularies.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@register
def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_vectors(table(spark, sf_dir, "embeddings"))


def _clusters_sql(k: int, rounds: int) -> str:
    """Every round as two steps: the nearest centroid of each vector, and the centroids that follow."""
    steps = [f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = 64
), cells AS MATERIALIZED (
    SELECT vec_id, unnest(v) AS x, unnest(range(64)) AS i FROM kept
), seeds AS (
    SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k FROM kept
), c0 AS MATERIALIZED (
    SELECT k, i, x AS c FROM seeds JOIN cells USING (vec_id) WHERE k < {k}
)"""]
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS (
    SELECT vec_id, k, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM cells JOIN c{r} USING (i) GROUP BY ALL
), a{r} AS MATERIALIZED (
    SELECT vec_id, CAST(arg_min(k, d * {k} + k) AS INTEGER) AS k, min(d) AS d FROM d{r} GROUP BY vec_id
)""")
        steps.append(f"""s{r} AS (
    SELECT k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM cells JOIN a{r} USING (vec_id) GROUP BY k, i
), c{r + 1} AS MATERIALIZED (
    SELECT o.k, o.i, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM c{r} o LEFT JOIN s{r} ON s{r}.k = o.k AND s{r}.i = o.i
)""")
    return ",\n".join(steps[:-1]) + f""", names AS (
    SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k
)
SELECT vec_id, k AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
    CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN names USING (k)
"""


ORACLES["op11_clusters"] = _clusters_sql(clusters.CENTROIDS, clusters.ROUNDS)


@register
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLES["op12_ranked_search"] = f"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, {TERMS} AS w FROM documents
), whole AS (
    SELECT count_if(len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM docs
), tfs AS (
    SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM docs) AS places GROUP BY ALL
), weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM tfs, whole GROUP BY term, n_docs
), lengths AS (
    SELECT rid, doc_id, 100 - 90 + (90 * len(w) * n_docs) // n_terms AS m FROM docs, whole
), asked AS (
    SELECT item, item_id, unnest(list_distinct({TERMS})) AS term FROM (SELECT row_number() OVER () AS item, * FROM benchmark) AS items
), scored AS (
    SELECT item, item_id, rid, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
    FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN lengths USING (rid) GROUP BY item, item_id, rid, doc_id
), best AS (
    SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0
)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM best WHERE place <= 10
"""


@register
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.train(texts, table(spark, sf_dir, "labels").filter(~held_out))
    scored = toxicity.score(texts, machine)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
