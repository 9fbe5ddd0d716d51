"""The pipeline's stages on the given tables, and the registration of all queries."""

import re

import pytest
from compare import connect
from conftest import SF_DIR
from samples import same_rows

import __spark_entry__ as contract
import corpus_pipeline
from millrace.llm import bpe, pii
from millrace.llm.queries import ORACLES, QUERIES
from millrace.session import cut_lineage
from test_llm_duplicates import slow_fingerprint, slow_matches
from test_llm_filters import slow_base, slow_measures


def test_every_operator_has_a_query():
    names = contract.queries()
    assert [k for n in range(1, 14) if len(k := [q for q in names if re.match(rf"op{n}_", q)]) != 1] == []
    assert "pipeline" in names and set(ORACLES) <= set(QUERIES)


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut_lineage(stage(spark, out[-1], SF_DIR)))
    return out


def test_stages(spark, steps):
    docs, good, apart, clean, masked, encoded = steps
    for df in steps[:-1]:
        assert df.columns == docs.columns
    base_failed = lambda m: m[0] < 20 or 100 * m[4] > 30 * m[0]
    kept = {r.doc_id for r in good.collect()}
    assert kept <= {r.doc_id for r in docs.collect() if not base_failed(slow_measures(r.text))}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    fair = {r.doc_id for r in docs.collect() if labels.get(r.doc_id) == 1 and not base_failed(slow_measures(r.text))}
    assert fair <= kept
    prints = [(r.doc_id, slow_fingerprint(r.text)) for r in good.collect()]
    assert {r.doc_id for r in apart.collect()} == {d for d, p in prints if not any(e < d and (p ^ q).bit_count() <= 2 for e, q in prints)}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in apart.collect() if not slow_matches(r.text, items)[1]}
    before = {r.doc_id: r.text for r in clean.collect()}
    for r in masked.collect():
        spans = list(slow_base(before[r.doc_id]))
        assert r.n_chars == len(r.text)
        assert spans or r.text == before[r.doc_id] or "<" in r.text
        assert not [k for k in spans if before[r.doc_id][k[1] : k[2]] in r.text]
    import public_tokenizers as vocabularies

    back = bpe.decode(encoded, vocabularies.path("byte_bpe_50k.tiktoken"))
    assert all(bytes(r.decoded).decode() == r.text for r in back.collect())


def test_run_equals_the_stages(spark, steps):
    assert corpus_pipeline.run(spark, SF_DIR).exceptAll(steps[-1]).count() == 0
    assert pii.labelled(spark).count() > 40


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_oracle(spark, key):
    con = connect(SF_DIR)
    df = QUERIES[key](spark, SF_DIR)
    result = con.execute(ORACLES[key])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert same_rows(df.select(*names).collect(), result.fetchall())


def test_queries_run_over_all_rows(spark):
    for key, source in {"op1_html_text": "pages", "op2_url_filter": "pages", "op6_simhash": "documents", "op7_decontamination": "documents", "op8_pii": "documents", "op9_quality": "documents"}.items():
        assert QUERIES[key](spark, SF_DIR).count() == spark.read.parquet(f"{SF_DIR}/{source}.parquet").count(), key
