"""Text and answer functions on small rows, nulls and empty text among them."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import answers as A
from factloom.functions import text as T


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("make", "value", "want"),
    [
        (T.normalize_text, " a\x00b  c\n", "a b c"), (T.normalize_text, None, ""), (T.normalize_keyword, "  Big  Name ", "big name"),
        (T.entity_key, "Größe", "grösse"), (T.relation_key, "Part Of", "part_of"), (T.snake_case, "Up-regulated by/the (x)", "up_regulated_by_the_x"),
        (T.clean_entity, ' "IL - 6 (human". ', "IL-6"), (T.clean_entity, "IL - 6 (human cells", "IL-6"), (T.strip_markup, "<b>a</b><i>b</i>", "a b"),
        (T.html_text, "<SCRIPT>x\ny</script>a<style>b</style>c", "a c"), (T.doi_norm, " DOI:10.1/X ", "10.1/x"), (T.doi_norm, "N/A", ""),
        (T.host, "https://WWW.a.org/b", "www.a.org"), (T.host, "a.org/b", "a.org"), (T.url_clean, "http://a/b?utm_source=x&q=1&ref=y#z", "http://a/b?q=1"), (T.url_clean, "http://a/b?ref=y", "http://a/b"),
        (T.iso_date, "2024/3/5", "2024-03-05"), (T.iso_date, "2024-3", "2024-03"), (T.iso_date, "soon", ""), (T.split_authors, "A; B;A", ["A", "B"]), (T.split_authors, "A, B", ["A", "B"]),
        (T.token_set, "A a-B1", ["a", "b1"]), (T.token_estimate, "abcdefghi", 2), (T.token_estimate, None, 1), (T.safe_name, "a b/c", "a_b_c"),
        (T.confidence_number, "Strong", 0.9), (T.confidence_number, "0.3", 0.3), (T.confidence_number, "odd", 0.0), (T.hedge_score, "May be linked", pytest.approx(2 / 3)), (T.hedge_score, "", 0.0),
        (T.relation_strength, "Part Of", "weak"), (T.relation_strength, "inhibits", "strong"), (T.relation_strength, None, "medium"),
        (T.looks_like_sentence, "Binding of a to b", True), (T.looks_like_sentence, "a b c and d e", True), (T.looks_like_sentence, "a and b", False), (T.looks_like_sentence, "a b c d e f g h i", True),
        (lambda x: T.truncate(x, 10), "abcdefghijk", "abcdefg..."), (lambda x: T.truncate(x, 11), "abcdefghijk", "abcdefghijk"),
        (A.truth, "Supported. It is.", True), (A.truth, "not_supported", False), (A.truth, "perhaps", None), (lambda x: A.last_tag(x, r"<answer>(.*?)</answer>"), "<answer>a</answer><answer> b</answer>", "b"),
        (lambda x: A.option_name(x, 4), "C", "option3"), (lambda x: A.option_name(x, 4), "option 4", "option4"), (lambda x: A.option_name(x, 4), "9", ""), (A.verdict_score, "Refuted", 1.0), (A.verdict_score, None, 0.5),
    ],
)
def test_scalar(spark, make, value, want):
    assert one(spark, value, make) == want


@pytest.mark.parametrize(
    ("answer", "want"),
    [("B", 1), ("(b)", 1), ("A protein", 0), ("C: x", 2), ("Gene Two", 1), ("three", 2), ("gene", -1), ("E", -1), ("", -1), (None, -1), ("nothing", -1)],
)
def test_choice(spark, answer, want):
    options = F.array(F.lit("gene one"), F.lit("gene two"), F.lit("part three"))
    assert one(spark, answer, lambda x: A.choice_index(x, options)) == want


def test_similarity(spark):
    row = spark.createDataFrame([("big name", "a name", [1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "k string, t string, a array<float>, b array<float>, z array<float>")
    got = row.select(T.keyword_similarity("k", "t"), T.keyword_similarity("t", "t"), T.cosine("a", "b"), T.cosine("a", "z"), T.title_overlap("k", "t")).first()
    assert list(got) == [0.5, 1.0, pytest.approx(0.70710678), 0.0, 0.5]


def test_keys(spark):
    row = spark.createDataFrame([("", None, " 12 ", "T")], "d string, c string, p string, t string")
    assert row.select(T.cache_key("d", "c", "p", "t")).first()[0] == "pmid::12"
    assert row.select(T.cache_key("d", "c", F.lit(""), "d")).first()[0] is None
    assert row.select(T.markdown("t", "d", "p")).first()[0] == "# T\n\n## Body\n\n12\n"


@pytest.mark.parametrize("n", [0, 1, 49, 250, 251, 460, 461, 1000])
def test_windows(spark, n):
    words = [f"w{i}" for i in range(n)]
    got = one(spark, " ".join(words), T.word_windows)
    want, start = [], 0
    while n and (not want or want[-1][1] < n):
        want.append((start, min(start + 250, n)))
        start += 210
    assert [(w.start, w.end) for w in got] == want
    assert all(w.text == " ".join(words[w.start : w.end]) for w in got)


def test_strength_of_evidence(spark):
    rows = spark.createDataFrame([(["strong", "strong"], [2, 3], 0.3), (["strong"], [1], 0.0), (["strong", "weak"], [5, 5], 0.0), (["medium"], [2], 0.7), (["medium"], [0], 0.0)], "s array<string>, n array<int>, h double")
    got = [r[0] for r in rows.select(T.evidence_strength(F.col("s"), F.col("n"), F.col("h"))).collect()]
    assert got == ["strong", "medium", "weak", "weak", "weak"]
