"""Every registered query of the library against its SQL, on the smallest tables."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from verdictmill.oracles import SQL
from verdictmill.plans import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


def _text(x):
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and x != x:
        return "null"
    if isinstance(x, list | np.ndarray):
        return str(list(map(str, x)))
    return f"{x + 0.0:.5f}" if isinstance(x, float | np.floating) else str(x)


def _rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(_text, row)) for row in df.itertuples(index=False))


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, small, oracle):
    got, want = _rows(QUERIES[name](spark, small).toPandas()), _rows(oracle.sql(SQL[name]).df())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    close = [a == b or all(x == y or _near(x, y) for x, y in zip(a, b, strict=True)) for a, b in zip(got[1], want[1], strict=True)]
    assert all(close)


def _near(x, y):
    try:
        return abs(float(x) - float(y)) <= 2e-5
    except ValueError:
        return False


def test_inert_clusters_to_the_last_digit(spark, small, tmp_path):
    """Supplier 1 has the mean 0.0521875 but for the order of its sum; the second table has suppliers without a key, an order or a discount, in three files."""

    def both(folder, files):
        want = duckdb.sql(SQL["inert_clusters"].replace("FROM lineitem", f"FROM read_parquet('{files}')")).fetchall()
        return [sorted(map(tuple, x), key=str) for x in (QUERIES["inert_clusters"](spark, folder).collect(), want)]

    got, want = both(small, f"{small}/lineitem.parquet")
    assert got == want
    rows = [(k if k < 4 else None, i if i % 9 else None, (i * 37 % 11) / 100 if k else None) for k in range(5) for i in range(60)] + [(5, 1, -0.0), (5, 2, None), (6, 1, 0.05)]
    (tmp_path / "lineitem.parquet").mkdir()
    for n in range(3):
        pd.DataFrame(rows[n::3], columns=["l_suppkey", "l_orderkey", "l_discount"]).astype({"l_suppkey": "Int64", "l_orderkey": "Int64"}).to_parquet(tmp_path / "lineitem.parquet" / f"{n}.parquet")
    got, want = both(str(tmp_path), f"{tmp_path}/lineitem.parquet/*.parquet")
    assert got == want and len(got) == 7


def test_text_features_beside_letters_outside_ascii(spark, tmp_path):
    """What ends a word, and what a letter is where case is ignored, is the same in the queries as in their SQL."""
    rng = random.Random(5)
    marks = [*"\u00e9\u00f1_7 .,-'", "\u0301", "\u017f", "\u212a", "\u0130", "\u0131", "\u00df", "\u0416"]
    hits = "loses LOST lo\u017ft exclude void penalty lapse requires must submit document 2024-01-02 1,200.5 should i here's below thread don't need lin\u212aed no advice a\u212a".split(" ")
    rows = [(k, 0, "".join(rng.choice(marks if rng.random() < 0.6 else hits) for _ in range(12))) for k in range(3000)]
    pd.DataFrame(rows, columns=["conv_id", "turn", "text"]).to_parquet(tmp_path / "conversations.parquet")
    pd.DataFrame(rows, columns=["doc_id", "n", "text"]).to_parquet(tmp_path / "documents.parquet")
    names = {"delta_features": ("conversations", "conv_id", ["delta_word_count", "numeral_count", "has_date", "penalty_lexicon_gap"]), "text_features": ("documents", "doc_id", ["says_should_i", "paste_cues", "declines_advice"])}
    for name, (table, key, columns) in names.items():
        got = QUERIES[name](spark, str(tmp_path)).toPandas().sort_values(key)
        want = duckdb.sql(SQL[name].replace(f"FROM {table}", f"FROM '{tmp_path}/{table}.parquet'")).df().sort_values(key)
        for c in columns:
            assert got[c].tolist() == want[c].tolist(), c


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
