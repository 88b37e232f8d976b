"""Packing and token files against the tokenizer itself."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest_llm import rows_of

from factloom.llm import packing, token_files, token_ids

tokenizers = pytest.importorskip("tokenizers")
TEXTS = ["Hello, World!", "the. of's 12 <|endoftext|> <|ENDOFTEXT|> foo<|endoftext|>bar", "É́ é İ ΑΣ ß ÷ à á b c\x1cd", "a\x00b don't ###.,;: x.y.z 3.14", "ǅ ﬁ 日本語 🙂", ""]


@pytest.fixture(scope="module")
def plain():
    t = tokenizers.Tokenizer.from_file(token_ids.default_path())
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_words_one_by_one_give_the_texts_ids(plain):
    words = token_ids.encoder(token_ids.default_path())
    for x in TEXTS:
        assert np.frombuffer(words.text(x.encode()), "<u4").tolist() == plain(x), x


@pytest.mark.parametrize("table", ["hard", "clashing"])
def test_token_files(spark, table, request, plain, tmp_path):
    docs = request.getfixturevalue(table)
    path = str(tmp_path / "ids")
    token_files.write_ids(docs, path)
    got = sorted(token_files.digests(spark, path).collect(), key=lambda r: r.start)
    want = sorted(zlib.crc32(np.array([*plain(t), 2], "<u4").tobytes()) for _, t in rows_of(docs))
    assert sorted(r.ids_crc32 for r in got) == want
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    assert token_files.lookup(spark, path, 8).first()["ids"] == [*plain(dict(rows_of(docs))[8]), 2]


@pytest.mark.parametrize("table", ["hard", "clashing"])
def test_packing(table, request, plain):
    docs = request.getfixturevalue(table)
    packed = packing.pack(docs, length=64)
    rows = packed.collect()
    by_place, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length <= 256
        sequences[r.sequence_id].append(r)
        by_place[r.doc_id, r.doc_tokens].append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1].tolist()]
        assert sum(r.length for r in pieces) <= 64
    assert sum(r.length for r in rows) == sum(len(plain(t)) + 1 for _, t in rows_of(docs))
    one = sorted((r.start, r.ids) for r in by_place[8, len(plain(dict(rows_of(docs))[8])) + 1])
    assert np.frombuffer(b"".join(i for _, i in one), "<u4").tolist() == [*plain(dict(rows_of(docs))[8]), 1]
    built = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    assert built == {k: b"".join(bytes(r.ids) for r in v) for k, v in sequences.items()}


def test_patterns_place_everything_with_little_padding():
    draw = np.random.default_rng(1)
    histogram = dict(zip(*np.unique(draw.integers(1, 2049, 20000), return_counts=True), strict=True))
    histogram = {int(k): int(v) for k, v in histogram.items()}
    out, placed = packing.patterns(histogram), defaultdict(int)
    for count, pack in out:
        assert count > 0 and sum(pack) <= 2048
        for size in pack:
            placed[size] += count
    assert placed == histogram
    total = sum(k * v for k, v in histogram.items())
    assert sum(c for c, _ in out) * 2048 / total < 1.02
    assert sum(c for c, _ in packing.patterns({10: 1_000_000})) == -(-1_000_000 // 204)


def test_empty_tables(frame):
    assert packing.pack_digests(frame([])).count() == 0
    assert token_files.token_files(frame([])).count() == 0
