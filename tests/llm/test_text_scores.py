"""Byte scores with contexts that cross words, against plain counting."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from conftest_llm import rows_of

from factloom.llm import ppm, queries


def stream(text, order):
    past = [0] * (order - 1) + [32]
    for symbol in b"".join(w + b" " for w in (text or "").encode().lower().split()) + b"\n":
        yield tuple(past[-order:]), symbol
        past.append(symbol)


def scores(train, texts, order=ppm.ORDER):
    """PPM with exclusion over whole texts."""
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for text in train:
        for context, symbol in stream(text, order):
            for j in range(order + 1):
                counts[j][context[order - j :]][symbol] += 1
    out = []
    for text in texts:
        total = 0.0
        for context, symbol in stream(text, order):
            p, excluded = 1.0, set()
            for j in range(order, -1, -1):
                c = {s: n for s, n in counts[j].get(context[order - j :], {}).items() if s not in excluded}
                if symbol in c:
                    p *= (2 * c[symbol] - 1) / (2 * sum(c.values()))
                    break
                if c:
                    p *= len(c) / (2 * sum(c.values()))
                    excluded |= {*c}
            else:
                p /= max(1, 256 - len(excluded))
            total += math.log10(p)
        out.append(total)
    return out


@pytest.mark.parametrize("sent", [ppm.SENT_ROWS, 2000])
def test_whole_texts(clashing, sent):
    rows = rows_of(clashing)
    train = [t for i, t in rows if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2]
    want = sorted((str(i), round(x, 6)) for (i, _), x in zip(rows, scores(train, [t for _, t in rows]), strict=True))
    got = ppm.score_texts(clashing, sent_rows=sent).drop("score").collect(), ppm.score_texts(clashing, sent_rows=sent).collect()
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got[1]) == want
    same = Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in ppm.score(clashing).collect())
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got[0]) == same


def test_the_order_of_words_counts(spark, frame, tmp_path):
    """The query itself: a shuffled text scores less than the text."""
    frame(["one two three four five six seven eight"] * 20 + ["six three one eight two seven five four"]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.score for r in queries.op2_ppm_score(spark, str(tmp_path)).collect()}
    assert got[20] < got[0] - 1
