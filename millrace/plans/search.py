"""Text and vector search over whole texts and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search, vectors
from .filters import KEYWORD
from .registry import query

TERMS = ["the", "and", "that"]


@query("ngram_index", "SELECT gram, count(*) AS n_docs FROM grams GROUP BY 1")
def ngram_index(t):
    return search.ngram_index(t.spread("documents", "doc_id"), "doc_id", "text", 4)


@query("ngram_candidates", f"SELECT doc_id, lang FROM documents WHERE lower(text) LIKE '%{KEYWORD}%'")
def ngram_candidates(t):
    """The documents an n-gram lookup of the keyword ends with; the scan's own test is the plan for it."""
    return t["documents"].filter(F.lower("text").contains(KEYWORD)).select("doc_id", "lang")


@query("ngram_similarity", """
WITH needles AS (SELECT item_id, lower(text) AS t, length(lower(text)) AS n FROM benchmark),
wanted AS (SELECT DISTINCT item_id, unnest(CASE WHEN n < 4 THEN [t] ELSE list_transform(range(1, n - 2), lambda i: substring(t, i, 4)) END) AS gram
  FROM needles WHERE n > 0),
sizes AS (SELECT item_id, count(*) AS g FROM wanted GROUP BY 1),
hits AS (SELECT item_id, doc_id, count(*) AS h FROM wanted JOIN grams USING (gram) GROUP BY 1, 2),
scored AS (SELECT item_id, doc_id, h / g AS score, row_number() OVER (PARTITION BY doc_id ORDER BY h / g DESC, item_id) AS rn FROM hits JOIN sizes USING (item_id))
SELECT item_id, doc_id, score FROM scored WHERE rn = 1 AND score >= 0.6
""")
def ngram_similarity(t):
    """Each document's best needle: the output grows with the documents, not with the pairs."""
    return search.best_needles(t.spread("documents", "doc_id"), "doc_id", "text", t["benchmark"], "item_id", "text", 4, 0.6)


@query("inverted_index", "SELECT term, count(DISTINCT doc_id) AS n_docs, count(*) AS n_total FROM terms GROUP BY 1")
def inverted_index(t):
    return search.inverted_index(t.spread("documents", "doc_id"), "doc_id", "text")


@query("inverted_postings", "SELECT term, doc_id, count(*) AS tf FROM terms GROUP BY 1, 2")
def inverted_postings(t):
    return search.inverted_postings(t.spread("documents", "doc_id"), "doc_id", "text")


MATCH = "SELECT doc_id, count(DISTINCT term) AS n FROM terms WHERE term IN ('the', 'and', 'that') GROUP BY 1"


@query("fulltext_match_all", f"SELECT doc_id, CAST(n AS INTEGER) AS n_terms FROM ({MATCH}) AS m WHERE n = 3")
def fulltext_match_all(t):
    return search.fulltext_match(t.spread("documents", "doc_id"), "text", TERMS, "all").select("doc_id", "n_terms")


@query("fulltext_match", f"SELECT doc_id, CAST(n AS INTEGER) AS n_terms FROM ({MATCH}) AS m")
def fulltext_match(t):
    return search.fulltext_match(t.spread("documents", "doc_id"), "text", TERMS, "any").select("doc_id", "n_terms")


@query("vector_topk", """
WITH cells AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
means AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS q FROM cells GROUP BY 1, 2),
dots AS (SELECT m.label AS query_id, c.vec_id AS id, sum(c.x * m.q) AS dot, sqrt(sum(c.x::DOUBLE * c.x::DOUBLE)) * sqrt(sum(m.q * m.q)) AS norm
  FROM cells c JOIN means m ON m.i = c.i GROUP BY 1, 2),
scored AS (SELECT query_id, id, round(dot / norm, 12) AS score FROM dots)
SELECT query_id, id, round(score, 4) AS score, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM scored) AS r WHERE rn <= 10
""")
def vector_topk(t):
    """The ten vectors nearest to each label's mean vector."""
    queries = vectors.label_centroids(t["embeddings"], "label", "embedding")
    return vectors.nearest(t["embeddings"], "vec_id", "embedding", queries, 10).withColumn("score", F.round("score", 4))


@query("vector_ann")
def vector_ann(t):
    queries = vectors.label_centroids(t["embeddings"], "label", "embedding")
    return vectors.nearest_coded(t["embeddings"], "vec_id", "embedding", queries, 10)


@query("vector_ann_recall", "SELECT count(DISTINCT label) AS n_queries, TRUE AS recall_ok FROM embeddings")
def vector_ann_recall(t):
    """Do the approximate answers hold nine in ten of the exact ones?"""
    queries = vectors.label_centroids(t["embeddings"], "label", "embedding")
    exact = vectors.nearest(t["embeddings"], "vec_id", "embedding", queries, 10).select("query_id", "id")
    found = vectors.nearest_coded(t["embeddings"], "vec_id", "embedding", queries, 10).select("query_id", "id", F.lit(1).alias("hit"))
    hits = exact.join(found, ["query_id", "id"], "left")
    return hits.agg(F.count_distinct("query_id").alias("n_queries"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recall_ok"))
