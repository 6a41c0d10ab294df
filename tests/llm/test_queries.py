"""The registered queries against their SQL, or their contracts, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from weftline.llm import queries

FOLDER = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no sample tables")

#: The columns each query must return.
COLUMNS = {
    "op1": "doc_id held_out score predicted",
    "op2": "doc_id n_shingles component_id kept",
    "op3": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op4": "doc_id held_out score predicted",
    "op5": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op6": "doc_id held_out lang_pred score",
    "op7": "doc_id keep_id group_size kept text_sha256",
    "op8": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op9": "doc_id size text_crc32 law shard slot grown_shard",
    "op10": "doc_id kept",
    "op11": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op12": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op13": "doc_id leaf subroot root proof_sha256 folded_root verified",
}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(columns)
    got = sorted(str(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name not in queries.SQL:
        assert len(got) == duck.sql("SELECT count(*) FROM documents").fetchall()[0][0]
        return
    rel = duck.sql(queries.SQL[name])
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(str(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())
