"""Queries against their own SQL in DuckDB, over rows that the given tables lack."""

from decimal import Decimal

import pytest

from factloom.registry import QUERIES, SQL

TEXTS = [
    None, "", " ", "\t\n", "plain words here", "plain words here", "  two  spaces \n and lines ", " no break  spaces ", "a\x0bb c", "a\x85b", "a\x00b\x00c d", "\x00", "é\x00ü x", "ΟΔΟΣ ΟΔΟΣ",
    "İstanbul and Σ", "-a/b- c", "___", "-", "more on src 1 here", "1 of src", "SRC0 said", "αß straße", "　x ", "👩‍🚀 flies", "a b", "x" * 9, "a b c src\x001",
]
SOURCES = ["src0", None, "", "src 1", "1 src", " ", "Σ", "σ", "İ", "a-b"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    rows = [(i, t, [None, "en", ""][i % 3], SOURCES[(i // 3) % len(SOURCES)], len(t or "")) for i, t in enumerate(t for t in TEXTS for _ in range(len(SOURCES)))]
    rows += [(None, "only without an id", "en", "src0", 3), (None, "plain words here", "en", "src0", 3), (2, "another text", "en", "src0", 3), (2, "another text", "en", "src0", 3)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def both(spark, folder, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    want, got = con.execute(SQL[name]).fetchall(), QUERIES[name](spark, folder)
    assert [c[0] for c in con.description] == got.columns
    plain = lambda rows: sorted((tuple(float(x) if isinstance(x, Decimal) else x for x in r) for r in rows), key=repr)
    return plain(got.collect()), plain(want)


def test_dedup_first_keeps_what_null_and_empty_texts_have(spark, odd):
    got, want = both(spark, odd, "dedup_first")
    assert got == want


def test_keyword_match_score_of_blank_texts_and_sources(spark, odd):
    got, want = both(spark, odd, "keyword_match_score")
    assert got == want


def test_text_keys_of_null_and_blank_texts(spark, odd):
    got, want = both(spark, odd, "text_keys")
    assert got == want
