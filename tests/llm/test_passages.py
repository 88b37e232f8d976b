"""Line dedup of short passages between other lines."""

import random

import pytest
from conftest_llm import kept_lines

from factloom.llm import line_chunks


@pytest.mark.parametrize("n_lines", [2, 3, 4, 5])
def test_short_passages_go_whole(frame, n_lines):
    """Passages of over 50 words on lines of 11 to 30 words, in two documents each, between lines of their own."""
    passages = ["\n".join(" ".join(f"p{k}l{i}w{j}" for j in range(60 // n_lines)) for i in range(n_lines)) for k in range(12)]
    texts = [f"start {c} of {k}\nand {c} more {k}\n{p}\nafter {c} {k}\nend {c} of {k}" for c in "ab" for k, p in enumerate(passages)]
    got = {r.doc_id: r.text for r in line_chunks.dedup_rows(frame(texts)).collect()}
    assert [got[k] for k in range(12)] == texts[:12]
    assert [got[12 + k] for k in range(12)] == [f"start b of {k}\nand b more {k}\nafter b {k}\nend b of {k}" for k in range(12)]


def test_runs_against_brute_force(frame):
    draw = random.Random(5)
    lines = ["", "a", "one two three", *(" ".join(f"w{i}x{j}" for j in range(n)) for i, n in enumerate((4, 4, 7, 9, 12, 55)))]
    texts = ["\n".join(draw.choice(lines) if draw.random() < 0.6 else f"own {i} {j}" for j in range(draw.randrange(1, 14))) for i in range(80)]
    rows = line_chunks.deduped(frame(texts)).select("row.doc_id", "text", "n_lines", "n_removed_lines").collect()
    want = kept_lines(texts)
    assert {r.doc_id: r.text for r in rows} == dict(enumerate(want))
    assert sum(r.n_removed_lines for r in rows) > 100


def test_different_bytes_under_one_hash(frame, monkeypatch):
    """As if all first windows had one pair of hashes: only where their bytes are equal do they go."""
    one = lambda rows: rows.selectExpr("doc_id", "h", "0L at", "7L hash", "7L check", "doc_id = 0 is_first")
    monkeypatch.setattr(line_chunks, "repeated", one)
    words = " ".join(f"w{j}" for j in range(12))
    apart = [f"{words}\nline {i}\nend" for i in range(3)]
    alike = [f"{words}\nline\nend {i}" for i in range(2)]
    mixed = [f"{words}\nline {i % 2}\nend {i}" for i in range(4)]
    for texts, want in ((apart, apart), (alike, [alike[0], "end 1"]), (mixed, [*mixed[:2], "end 2", "end 3"])):
        assert {r.doc_id: r.text for r in line_chunks.dedup_rows(frame(texts)).collect()} == dict(enumerate(want))
