"""The registered queries of the training-data operators on the smallest tables: SQL where there is one, else an invariant."""

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.oracle_check import TABLES, rows_of

QUERIES = {n: q for n, q in E.queries().items() if n == "pipeline" or n.startswith("op") and n[2].isdigit()}
ORACLES = {n: s for n, s in E.oracle_sql().items() if n in QUERIES}

INVARIANTS = {
    "op3_jaccard_join": lambda rows: all(r["class_id"] <= r["doc_id"] for r in rows),
    "op4_language_id": lambda rows: all(0 <= r["score"] <= 1 for r in rows),
    "op7_token_blocks": lambda rows: min(r["start"] for r in rows) == 0
    and max(r["start"] + r["n_tokens"] for r in rows) == sum(r["n_tokens"] for r in rows),
    "op8_bpe": lambda rows: all(r["n_tokens"] >= 0 and len(r["ids_sha256"]) == 64 for r in rows),
    "op10_quality": lambda rows: {r["kept"] for r in rows} == {True, False},
    "op11_whitening": lambda rows: all(r["identity_error"] < 1e-4 for r in rows) and {r["component"] for r in rows} == set(range(1, 17)),
    "op12_pii": lambda rows: any(r["spans"] for r in rows) and not all(r["spans"] for r in rows),
    "op13_periodic_runs": lambda rows: all((r["n_runs"] > 0) == (r["length"] is not None and r["length"] >= 12) for r in rows),
    "pipeline": lambda rows: all(r["n_tokens"] >= 0 for r in rows),
}


def test_thirteen_operators_and_the_pipeline_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline") == list(range(1, 14)) and "pipeline" in QUERIES
    assert set(QUERIES) == set(ORACLES) | set(INVARIANTS)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = QUERIES[name](spark, SF_SMALL)
    res = con.execute(ORACLES[name])
    columns = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, res.fetchall())


@pytest.mark.parametrize("name", sorted(INVARIANTS))
def test_query_keeps_its_invariant(spark, name):
    rows = QUERIES[name](spark, SF_SMALL).collect()
    assert rows and INVARIANTS[name](rows)
