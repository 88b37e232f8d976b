"""Near-duplicates, line dedup, mixing, scoring, fingerprints and the pipeline against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest_llm import kept_lines, rows_of

from factloom.llm import chroma, line_chunks, mixing, ppm, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(values, near):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(values))]


@pytest.mark.parametrize("crowd", [64, 0])
def test_links_of_planted_prints(spark, crowd):
    """Prints at exact distances, both ways of linking against all pairs."""
    draw = np.random.default_rng(3)
    prints = [int(x) for x in draw.integers(0, 1 << 64, 12, dtype=np.uint64)]
    for distance in (1, 2, 3, 4, 5):
        for base in prints[:6]:
            prints.append(base ^ sum(1 << int(b) for b in draw.choice(64, distance, replace=False)))
    prints = sorted(set(prints) | {0, 7, 1 << 63})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    rows = spark.createDataFrame([(p,) for p in signed], "fingerprint bigint")
    got = {r.fingerprint: r.component for r in simhash.labelled(rows, crowd).collect()}
    want = grouped(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    assert len({(got[s], w) for s, w in zip(signed, want, strict=True)}) == len(set(want)) == len(set(got.values()))


@pytest.mark.parametrize("table", ["hard", "clashing"])
def test_near_duplicates_of_hard_rows(table, request):
    docs = request.getfixturevalue(table)
    rows = rows_of(docs)
    got = simhash.near_duplicates(docs).collect()
    prints = [fingerprint(t) for _, t in rows]
    label = grouped(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    least = defaultdict(list)
    for (i, _), g in zip(rows, label, strict=True):
        if i is not None:
            least[g].append(i)
    want = sorted((str(i), f, min(least[g]) if least[g] else None) for (i, _), f, g in zip(rows, prints, label, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint & (1 << 64) - 1, r.component_id) for r in got) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(label))


def test_line_dedup(frame):
    passage = "\n".join(f"this passage line number {i} is shared by several documents of the table" for i in range(12))
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"own {i} start\n" * (i % 3) + passage + f"\nown end of {i}, which nothing repeats", "s") for i in range(6)]
    rows += [(10, f"a\n{long}\nb", "s"), (11, f"c\nd\n{long}", "s"), (12, long, "s"), (13, None, "s"), (14, "", "s"), (15, "clean text\nof two lines with enough words to count as one", "s")]
    got = {r.doc_id: r.text for r in line_chunks.dedup_rows(frame(rows)).collect()}
    want = kept_lines([t or "" for _, t, _ in rows])
    assert {i: t or "" for i, t in got.items()} == dict(zip([i for i, *_ in rows], want, strict=True))
    assert got[13] is None and got[12] == "" and got[15] == rows[-1][1] and got[10] == rows[6][1] and got[11] == "c\nd"
    assert all(len(got[i]) < len(rows[i][1]) * 0.8 for i in range(1, 6))


def test_line_dedup_of_hard_rows(clashing, frame):
    out = line_chunks.dedup_rows(clashing)
    assert out.columns == clashing.columns and out.count() == clashing.count()
    assert line_chunks.dedup_rows(frame([])).count() == 0
    assert all(r.n_chars == len(r.text or "") for r in out.select("text", "n_chars").collect())


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in stopped)
        share = sum(weight[s] for s in names if s not in stopped)
        out = {s: 3 * sizes[s] if s in stopped else left * weight[s] / share for s in names}
        over = {s for s in names if s not in stopped and out[s] >= 3 * sizes[s]}
        if not over:
            return out
        stopped |= over


@pytest.mark.parametrize("table", ["hard", "clashing", "skewed"])
def test_mixing(table, request, frame):
    docs = frame([(i, " ".join(["w"] * (i * 37 % 900)), "big" if i % 3 else f"s{i % 7}") for i in range(120)]) if table == "skewed" else request.getfixturevalue(table)
    rows = [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = targets(sizes)
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs).collect()
    assert Counter(got) == Counter(again) and len(got) == len(rows)
    source = {(i, len(WORD.findall(t or ""))): s for i, t, s in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id, r.size]
        assert r.source_size == sizes[s] and math.isclose(r.target, want[s], abs_tol=1e-6) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    mixed = mixing.mix_rows(docs)
    assert mixed.columns == docs.columns
    words = defaultdict(int)
    texts = defaultdict(set)
    for i, t, _ in rows:
        texts[i].add(" ".join(WORD.findall(t or "")))
    for r in mixed.select("doc_id", "text", "source", "n_chars").collect():
        words[r.source] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert all(words[s] == taken[s] for s in sizes)


def test_permutations_reach_all(spark):
    rows = spark.createDataFrame([(n, k) for n in (1, 2, 3, 10, 97, 256, 1000) for k in (1, 2)], "n bigint, k int").selectExpr("n", "k", "explode(sequence(0L, n - 1)) x")
    got = defaultdict(list)
    for r in rows.withColumn("y", mixing.permuted(rows.x, rows.n, rows.k)).orderBy("n", "k", "x").collect():
        got[r.n, r.k].append(r.y)
    assert all(sorted(ys) == [*range(n)] for (n, _), ys in got.items())
    assert got[1000, 1] != got[1000, 2]
    steps = Counter((b - a) % 1000 for a, b in zip(got[1000, 1], got[1000, 1][1:], strict=False))
    assert steps.most_common(1)[0][1] < 12  # no fixed stride


def test_counts_of_shards_are_multinomial(spark, monkeypatch):
    """Each shard's counts add up to its slots and vary as draws with replacement do; numbers and blocks leave no gap."""
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 64)
    rows = [(1, "a", 5000, 10, 5, 9000.0), (2, "b", 3001, 10, 2, 3600.4), (3, "c", 10, 1, 1, 25.0), (4, "d", 0, 1, 5, 0.0)]
    known = spark.createDataFrame(rows, "sid bigint, source string, source_size bigint, n_docs bigint, weight int, target double")
    ranges = [(1, 0, 2250), (2, 2250, 901), (3, 3151, 8)]
    counts = mixing.draws(spark.createDataFrame(ranges, "sid bigint, first bigint, n_slots bigint"), 3159).collect()
    shards = defaultdict(Counter)
    for r in counts:
        shards[r.shard][r.sid] += r["count"]
    assert [sum(shards[s].values()) for s in range(50)] == [64] * 49 + [3159 - 49 * 64]
    share = 2250 / 3159
    spread = np.mean([(shards[s][1] - 64 * share) ** 2 for s in range(49)]) / (64 * share * (1 - share))
    assert 0.5 < spread < 1.7
    before = {(r.shard, r.sid): r.before for r in mixing.numbered(spark.createDataFrame(counts)).collect()}
    assert all(before[s, i] == sum(shards[t][i] for t in range(s)) for s, i in before)
    found = mixing.slots(known, block=4).collect()
    taken, blocks = Counter(), defaultdict(list)
    for r in found:
        taken[r.sid] += min(r.words, {1: 5000, 2: 3001, 3: 10}[r.sid] - 4 * r.block)  # a source's last block is short
        blocks[r.sid, r.epoch].append(r.block)
    assert taken == {1: 9000, 2: 3600, 3: 25} and len(found) == 1250 + 1000 + 751 + 150 + 3 + 3 + 2
    assert all(len(set(b)) == len(b) for b in blocks.values())
    assert sorted(blocks[1, 0]) == [*range(1250)] and sorted(blocks[2, 0]) == [*range(751)] and sorted(blocks[3, 1]) == [0, 1, 2]
    assert {s for s, in {(r.shard,) for r in found}} == {*range(50)}


def test_empty_tables(frame):
    none = frame([])
    assert mixing.mix(none).count() == mixing.mix_rows(none).count() == 0
    assert simhash.near_duplicates(none).count() == simhash.keep_one(none).count() == 0
    assert ppm.score(none).count() == chroma.search(none).count() == 0


def ppm_score(trained, tokens, order=ppm.ORDER):
    """PPM with exclusion by plain counting."""
    counts = [defaultdict(Counter) for _ in range(order + 1)]

    def stream(token):
        body = [*token] if token == ppm.END else [*token, 32]
        past = [0] * (order - 1) + [32]
        for symbol in body:
            yield tuple(past[-order:]), symbol
            past.append(symbol)

    for token, n in trained.items():
        for context, symbol in stream(token):
            for j in range(order + 1):
                counts[j][context[order - j :]][symbol] += n
    total = 0.0
    for token in tokens:
        for context, symbol in stream(token):
            p, excluded = 1.0, {}
            for j in range(order, -1, -1):
                c = {s: n for s, n in counts[j].get(context[order - j :], {}).items() if n and s not in excluded}
                if not c:
                    continue
                t = 2 * sum(c.values())
                if symbol in c:
                    p *= (2 * c[symbol] - 1) / t
                    break
                p *= len(c) / t
                excluded |= c
            else:
                p /= max(1, 256 - len(excluded))
            total += math.log10(p)
    return total


@pytest.mark.parametrize(("heavy", "sent"), [(ppm.HEAVY, ppm.SENT_ROWS), (5, 3)])
def test_scoring(clashing, heavy, sent):
    rows = rows_of(clashing)
    tokens = [[*(t or "").encode().lower().split(), ppm.END] for _, t in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in rows]
    trained = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(trained.values()), len(trained)
    want = []
    for (i, _), t, h in zip(rows, tokens, held, strict=True):
        base = sum(math.log10((trained[w] + 1) / (n + v + 1)) for w in t)
        want.append((str(i), h, len(t), sum(trained[w] > 0 for w in t), n, round(base, 6), round(ppm_score(trained, t), 6)))
    got = ppm.score(clashing, heavy=heavy, sent_rows=sent).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == sorted(want)
    assert any(held) and not all(held)


def test_probabilities_of_a_context_sum_to_one_at_most(spark):
    words = [b"banana", b"bandana", b"ananas", b"cabana", b"nab"]
    every = {k: 1 for w in words for k in ppm.keys_of([w])[0].tolist()}
    contexts = {k >> 8 for k in every}
    table = [(c << 8 | s, every.get(c << 8 | s, 0)) for c in contexts for s in range(256)]
    probs = ppm.probabilities(spark.createDataFrame(table, "key bigint, n bigint")).collect()
    sums = Counter()
    for r in probs:
        sums[r.key >> 8] += 10**r.lp
    assert all(0.5 < s <= 1 + 1e-9 for s in sums.values())


def test_longer_contexts_help_held_out_words(spark):
    stems = [f"{a}{b}" for a in ("st", "pr", "un") for b in ("ation", "ingly", "ement", "able")]
    trained, held = Counter({s.encode(): 5 for i, s in enumerate(stems) if i % 4}), [s.encode() for s in stems[::4]]
    assert ppm_score(trained, held, 3) > ppm_score(trained, held, 0)


def test_pipeline(spark, frame, tmp_path):
    import corpus_pipeline

    passage = " ".join(f"shared{i}" for i in range(70))
    rows = [(i, f"{passage}\n" * (i % 5 == 0) + " ".join(f"own{i}x{j}" for j in range(80)), f"s{i % 4}") for i in range(40)]
    rows += [(50, rows[1][1], "s0"), (51, "too short", "s1"), (52, "same words again " * 40, "s2")]
    frame(rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        columns, docs = docs.columns, spark.read.parquet(str(tmp_path / name))
        seen.append(docs.count())
        if name != "pack_sequences":
            assert docs.columns == columns
        if name == "quality_rules":
            assert {r.doc_id for r in docs.collect()} == {*range(40), 50}
        if name == "line_dedup":
            assert sum(passage in r.text for r in docs.collect()) == 1
        if name == "near_dedup":
            assert {r.doc_id for r in docs.collect()} >= {*range(40)}  # the copy lost its text to line dedup and may stay, empty
    assert "sequence_id" in docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[-1]
