"""The registered queries of the subpackage against their SQL, and the shape of the others."""

import zlib
from collections import Counter

import pytest

from corpusforge.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    "op1": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op2": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op3": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op4": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op6": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op8": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op10": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op11": "page_id bigint, host string, path string, rule string, verdict string",
    "op12": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint",
    "op13": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    want = COLUMNS.get(name.split("_")[0])
    if want:
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == want
    rows = df.collect()
    if name.startswith(("op2", "op4")):
        by, hit = (3, 1) if name.startswith("op2") else (5, 0)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % by == hit) for r in rows)
    if name not in ORACLE_SQL:
        assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
        return
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = con.sql(ORACLE_SQL[name]).df()
    cols = sorted(df.columns)
    assert cols == sorted(got.columns)
    text = lambda v: "" if v is None or v != v else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    none = lambda v: None if str(v) == "<NA>" else v
    assert sorted(tuple(text(r[c]) for c in cols) for r in rows) == sorted(tuple(text(none(v)) for v in r) for r in got[cols].itertuples(index=False))


@pytest.mark.parametrize("name", ["op8_exact_top_k", "op13_hard_negatives"])
def test_searches_with_repeated_ids_equal_their_sql(spark, sf, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    x = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 300")
    again = x.where("vec_id % 3 = 0").selectExpr("vec_id - vec_id % 100 AS vec_id", "embedding", "label")
    x.unionByName(again).unionByName(x.where("vec_id < 120")).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(ORACLE_SQL[name])
    assert Counter(tuple(r[c] for c in want.columns) for r in got.collect()) == Counter(want.fetchall())
