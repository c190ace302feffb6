"""The registered queries on the smallest tables: contract columns, all rows, and SQL where there is some."""

import duckdb
import pytest

from lumatlas.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_suffix_array_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op2_quality_classifier": "doc_id lang perplexity kept",
    "op3_near_duplicates": "doc_id n_shingles component_id kept",
    "op4_token_files": "doc_id start n_tokens ids_crc32",
    "op5_licence_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op6_toxicity": "doc_id held_out score predicted",
    "op7_top_k_search": "query_id rank vec_id score",
    "op8_document_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op9_source_mixing": "doc_id size source_size target taken",
    "op10_bpe_round_trip": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op11_spelling_variants": "word form root n n_near form_n",
    "op12_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op13_periodic_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        c.sql(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    rows = df.collect()
    if "doc_id" in df.columns:
        assert sorted(r.doc_id for r in rows) == [x[0] for x in duck.sql("select doc_id from documents order by 1").fetchall()]
    if name in ORACLE:
        own = duck.sql(ORACLE[name])
        assert sorted(own.columns) == sorted(df.columns)
        assert sorted(tuple(r[c] for c in own.columns) for r in rows) == sorted(own.fetchall())


def test_every_query_is_listed():
    assert list(sorted(QUERIES)) == sorted(COLUMNS) and set(ORACLE) <= set(QUERIES)
