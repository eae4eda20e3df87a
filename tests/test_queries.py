"""Every query against its SQL twin at the smallest size; those without one by what must hold."""

import duckdb
import pandas as pd
import pytest

from pathloom.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cell(x) -> str:
    if x is None or x != x:
        return ""
    if isinstance(x, float):
        x = round(x, 6)
        return str(int(x)) if x == int(x) else repr(x)
    return str(x)


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(cell).astype(object)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, con, name):
    got = normal(QUERIES[name](spark, SF).toPandas())
    want = normal(con.execute(ORACLES[name]).fetchdf())
    assert list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_chunks_hold_all_sentences(spark):
    rows = QUERIES["E06_sentence_chunks"](spark, SF).toPandas()
    for _, g in rows.sort_values("chunk_no").groupby(["doc_id", "section_no"]):
        a, b, n = g.first_sentence.tolist(), g.end_sentence.tolist(), g.word_count.tolist()
        assert a[0] == 0
        for i in range(1, len(g)):
            assert a[i - 1] < a[i] <= b[i - 1] <= b[i]
        assert all(w <= 120 or e - s == 1 for w, s, e in zip(n, a, b))
    best = QUERIES["E07_ordered_chunks"](spark, SF).toPandas()
    for _, g in best.sort_values("chunk_id").groupby("doc_id"):
        assert g.chunk_id.tolist() == list(range(1, len(g) + 1))
        assert g.relevance.is_monotonic_decreasing


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
