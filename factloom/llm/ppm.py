"""Prediction by partial matching over the bytes of texts (operator 2).

A text is a sequence of tokens, its words and one end, in lower case (A-Z). The
model codes a word byte by byte and then a space, the end as one line feed.
The context of a byte is up to ORDER bytes before it; an unseen byte escapes to
the next shorter context, whose counts leave out all that the longer one had
(symbol exclusion), down to equal shares of what is left of the 256 bytes.
Escapes are estimated as half a count for each distinct symbol.

``score_texts`` lets contexts cross words: the trie is a table of (context,
byte) counts over whole training documents, summed in each task before they are
shuffled; each context has at most 256 rows, and each order is joined to the one
below it on its key. The most frequent keys go to the tasks with their
probabilities, SENT_ROWS at most; a text sends out its other keys with their
counts, and these are joined to the table. One pass over the texts does it.

``score`` starts the context anew at each word, so that a word's code length is
the same wherever it stands: it is worked out once for each distinct word of
the corpus and joined to the documents.

Tokens are joined by the word. The most frequent words, HEAVY at most, are
looked up in the tasks instead, so that no frequent word gathers its
occurrences in one task.

Defined cases: a null or empty text is its end alone; a null doc_id counts as
the text '' when documents are divided; rows that share doc_id and text each
get a row; an empty table gives an empty result; only the key and text columns
are read, so other columns may have any names.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, whole_text

ORDER = 5
#: The most words to look up in tasks rather than join.
HEAVY = 1 << 18
#: The most bytes of such a word.
HEAVY_BYTES = 256
#: Rows of the table of probabilities that are sent to the tasks (16 bytes a row); the others are joined.
SENT_ROWS = 4_000_000
#: Bytes of texts, texts, and rows of counts, that a task holds at once.
CHUNK_BYTES, CHUNK_TEXTS, HELD_ROWS = 2_000_000, 1 << 15, 2_000_000
#: Distinct words a task counts before it passes its counts on.
COUNT_WORDS = 200_000
FOLDS, HELD_OUT_FOLD = 7, 2
END = b"\n"

#: A worker's table of frequent words, by run.
_tables: dict[str, tuple] = {}


def is_held_out(doc_id: int | None) -> bool:
    import zlib

    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT_FOLD


def _count(batches):
    from collections import Counter

    import pyarrow as pa

    known: Counter = Counter()
    other: set = set()

    def counts():
        rows = [*known.items(), *((w, 0) for w in other if w not in known)]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int64())], ["word", "n"])
        known.clear()
        other.clear()

    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            tokens = [*text.lower().split(), END]
            (other if is_held_out(doc) else known).update(tokens)
            if len(known) + len(other) > COUNT_WORDS:
                yield from counts()
    yield from counts()


def _rows(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), whole_text().alias("text"))


def count_words(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """word and n, its count in training documents, for each distinct token; 0 for those of other documents alone."""
    return _rows(docs, key).mapInArrow(_count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def keys_of(tokens: list[bytes], order: int = ORDER):
    """Each symbol of each token with its context, packed into an integer, and how many symbols each token has."""
    head = b"\0" * (order - 1) + b" "
    return _keys([head + t if t == END else head + t + b" " for t in tokens], order)


def text_keys(texts: list[bytes], order: int = ORDER):
    """Each symbol of each text with its context, which crosses words, and how many symbols each text has."""
    head = b"\0" * (order - 1) + b" "
    return _keys([head + b"".join(w + b" " for w in t.lower().split()) + END for t in texts], order)


def _keys(coded: list[bytes], order: int):
    import numpy as np

    lengths = np.array([len(c) for c in coded], dtype=np.int64)
    raw = np.frombuffer(b"".join(coded), np.uint8).astype(np.int64)
    key = np.zeros(max(0, len(raw) - order), np.int64)
    for i in range(order + 1):
        key = (key << 8) | raw[i : len(raw) - order + i]
    within = np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return key[np.flatnonzero(within >= order) - order], lengths - order


def _grams(order: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        keys, weights, held = [], [], 0

        def summed():
            distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(distinct), np.int64)
            np.add.at(total, at, np.concatenate(weights))
            keys.clear()
            weights.clear()
            return pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(total)], ["key", "n"])

        for batch in batches:
            key, sizes = keys_of(batch.column("word").to_pylist(), order)
            keys.append(key)
            weights.append(np.repeat(batch.column("n").to_numpy(), sizes))
            held += len(key)
            if held > 4_000_000:
                yield summed()
                held = 0
        if keys:
            yield summed()

    return run


def count_grams(words: DataFrame, order: int = ORDER) -> DataFrame:
    """key (context and symbol) and n, its count in training documents, for every key that any document has."""
    return words.mapInArrow(_grams(order), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def _text_chunks(batches):
    """Lists of doc_id and of text, by CHUNK_BYTES."""
    import pyarrow as pa

    ids, texts, held = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            ids.append(doc)
            texts.append(text)
            held += len(text)
            if held > CHUNK_BYTES or len(ids) == CHUNK_TEXTS:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _text_grams(order: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        keys, counts = [], []

        def summed():
            distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(at, np.concatenate(counts), len(distinct)).astype(np.int64)
            keys[:], counts[:] = [distinct], [total]

        def rows():
            batch = pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(counts[0])], ["key", "n"])
            keys.clear()
            counts.clear()
            return batch

        for ids, texts in _text_chunks(batches):
            key, sizes = text_keys(texts, order)
            other = np.repeat([is_held_out(i) for i in ids], sizes)
            distinct, n = np.unique(key[~other], return_counts=True)
            unseen = np.unique(key[other])
            keys += [distinct, unseen]
            counts += [n, np.zeros(len(unseen), np.int64)]
            if sum(map(len, keys)) > HELD_ROWS:
                summed()
                if len(keys[0]) > HELD_ROWS // 2:
                    yield rows()
        if keys:
            summed()
            yield rows()

    return run


def count_text_grams(docs: DataFrame, key: str = "doc_id", order: int = ORDER) -> DataFrame:
    """key (context and symbol, over whole texts) and n, its count in training documents, for every key that any document has."""
    return _rows(docs, key).mapInArrow(_text_grams(order), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def _least_frequent(grams: DataFrame, most: int) -> int:
    """The least count from which on there are at most ``most`` rows, by steps of a twelfth of an octave, of which there are at most 800."""
    step = F.floor(F.log2("n") * 12)
    rows = grams.filter("n > 0").groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("n")).orderBy(F.desc("step")).collect()
    least, total = 1 << 62, 0
    for row in rows:
        total += row["rows"]
        if total > most:
            break
        least = row["n"]
    return least


def _score_keys(sent, order: int):
    """For each text a row with the sum over the keys that were sent, and a row for each other key with its count in the text."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        keys, logs = sent.value
        names = ["doc_id", "h", "key", "count", "lp"]
        for ids, texts in _text_chunks(batches):
            key, sizes = text_keys(texts, order)
            # keys have 48 bits and CHUNK_TEXTS is 2 ** 15 at most: one sort brings equal keys, and their texts, together
            both = np.sort((key << 15) | np.repeat(np.arange(len(ids)), sizes))
            key, text = both >> 15, both & (1 << 15) - 1
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            distinct, times = key[first], np.diff(np.append(first, len(key)))
            place = np.minimum(np.searchsorted(keys, distinct), max(0, len(keys) - 1))
            known = keys[place] == distinct if len(keys) else np.zeros(len(distinct), bool)
            each = np.where(known, logs[place] if len(keys) else 0.0, 0.0)
            lp = np.bincount(text, np.repeat(each, times), len(ids))
            rare, count = np.unique(both[~np.repeat(known, times)], return_counts=True)
            hashes = np.array([xxhash.xxh64_intdigest(t) - (1 << 63) for t in texts], np.int64)
            docs, of = pa.array(ids, pa.int64()), rare & (1 << 15) - 1
            # a text's own row has a key that no byte has, another one in each text
            columns = [docs, pa.array(hashes), pa.array(-1 - np.abs(hashes >> 1)), pa.array(np.ones(len(ids), np.int64)), pa.array(lp)]
            yield pa.RecordBatch.from_arrays(columns, names)
            columns = [docs.take(pa.array(of)), pa.array(hashes[of]), pa.array(rare >> 15), pa.array(count), pa.array(np.zeros(len(rare)))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def text_scores(docs: DataFrame, grams: DataFrame, probs: DataFrame, key: str = "doc_id", order: int = ORDER, sent_rows: int = SENT_ROWS) -> DataFrame:
    """doc_id, h and lp, rows that add up to log10 of the probability of each text.

    The most frequent keys, ``sent_rows`` at most, go to the tasks; the others
    are joined, so that no key of the join is frequent.
    """
    import numpy as np

    least = _least_frequent(grams, sent_rows)
    got = probs.filter(F.col("n") >= least).select("key", "lp").toArrow()
    keys, logs = got.column("key").to_numpy(), got.column("lp").to_numpy()
    by = np.argsort(keys)
    sent = docs.sparkSession.sparkContext.broadcast((keys[by], logs[by]))
    rows = _rows(docs, key).mapInArrow(_score_keys(sent, order), "doc_id bigint, h bigint, key bigint, count bigint, lp double")
    rare = probs.filter(F.col("n") < least).select("key", F.col("lp").alias("rare"))
    lp = F.col("lp") + F.coalesce(F.col("count") * F.col("rare"), F.lit(0.0))
    return rows.join(rare, "key", "left").select("doc_id", "h", lp.alias("lp"))


def probabilities(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """key, its count, and log10 of its symbol's probability in its context."""

    def level(j: int) -> DataFrame:
        return grams.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * (j + 1)) - 1)).alias("key")).agg(F.sum("n").alias("n"))

    context = Window.partitionBy(F.shiftright("key", 8))  # at most 256 rows
    total, distinct = F.sum("n").over(context), F.count_if(F.col("n") > 0).over(context)
    below = level(0).select("key", "n", total.alias("t"), distinct.alias("d"))
    below = below.withColumn("escaped", F.lit(1.0) / F.greatest(F.lit(256) - F.col("d"), F.lit(1)))
    for j in range(1, order + 1):
        low = below.select(F.col("key").alias("low"), F.col("n").alias("n0"), F.col("t").alias("t0"), F.col("d").alias("d0"), F.col("escaped").alias("escaped0"))
        rows = level(j).withColumn("low", F.col("key").bitwiseAND(F.lit((1 << 8 * j) - 1))).join(low, "low")
        excluded = F.sum(F.when(F.col("n") > 0, F.col("n0")).otherwise(0)).over(context)
        rows = rows.select("*", total.alias("t"), distinct.alias("d"), excluded.alias("e"))
        left, new = 2 * (F.col("t0") - F.col("e")), F.col("d0") - F.col("d")
        escaped = (
            F.when((new <= 0) | (left <= 0), F.col("escaped0"))
            .when(F.col("n0") > 0, (2 * F.col("n0") - 1) / left)
            .otherwise(new / left * F.col("escaped0"))
        )
        below = rows.select("key", "n", "t", "d", escaped.alias("escaped"))
    seen = (2 * F.col("n") - 1) / (2 * F.col("t"))
    p = F.when(F.col("n") > 0, seen).when(F.col("t") > 0, F.col("d") / (2 * F.col("t")) * F.col("escaped")).otherwise(F.col("escaped"))
    return below.select("key", "n", F.log10(p).alias("lp"))


def _score_sent(sent, order: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        keys, logs = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            key, sizes = keys_of(batch.column("word").to_pylist(), order)
            lp = np.add.reduceat(logs[np.searchsorted(keys, key)], np.cumsum(sizes) - sizes)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(lp)], ["word", "n", "lp"])

    return run


def _explode_keys(order: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            key, sizes = keys_of(batch.column("word").to_pylist(), order)
            at = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            yield pa.RecordBatch.from_arrays([batch.column("word").take(at), batch.column("n").take(at), pa.array(key)], ["word", "n", "key"])

    return run


def score_words(words: DataFrame, probs: DataFrame, order: int = ORDER, sent_rows: int = SENT_ROWS) -> DataFrame:
    """word, n and lp, log10 of its probability. Sends a small table of probabilities to the tasks, joins a larger one; results are the same."""
    import numpy as np

    if probs.limit(sent_rows + 1).count() <= sent_rows:
        got = probs.select("key", "lp").toArrow()
        keys, logs = got.column("key").to_numpy(), got.column("lp").to_numpy()
        by = np.argsort(keys)
        sent = words.sparkSession.sparkContext.broadcast((keys[by], logs[by]))
        return words.mapInArrow(_score_sent(sent, order), "word binary, n bigint, lp double")
    each = words.mapInArrow(_explode_keys(order), "word binary, n bigint, key bigint")
    return each.join(probs.select("key", "lp"), "key").groupBy("word").agg(F.first("n").alias("n"), F.sum("lp").alias("lp"))


def _tokens(heavy, run_id: str):
    def run(batches):
        from collections import Counter

        import numpy as np
        import pyarrow as pa
        import xxhash

        if run_id not in _tables:
            _tables.clear()
            names, logs, known, lp = heavy.value
            # one more entry, which adds nothing, for words that aren't here
            _tables[run_id] = ({w: i for i, w in enumerate(names)}, *(np.append(x, 0) for x in (logs, known, lp)))
        index, logs, known, lp = _tables[run_id]
        none = len(index)
        names = ["doc_id", "h", "word", "count", "n_tokens", "n_known", "base", "lp"]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        out: list[list] = [[] for _ in names]

        def rows():
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names)
            for x in out:
                x.clear()
            return batch

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                h = xxhash.xxh64_intdigest(text) - (1 << 63)
                tokens = [*text.lower().split(), END]
                at = np.fromiter((index.get(w, none) for w in tokens), np.int64, len(tokens))
                rare = Counter(tokens[i] for i in np.flatnonzero(at == none))
                # the document's own row has a word that no text has and so finds no partner
                sums = (len(tokens), int(known[at].sum()), float(logs[at].sum()), float(lp[at].sum()))
                out[2].append(b" %d %d" % (doc or 0, h))
                out[2].extend(rare)
                out[3].append(1)
                out[3].extend(rare.values())
                for x, value in zip((out[0], out[1]), (doc, h), strict=True):
                    x.extend([value] * (1 + len(rare)))
                for x, value in zip(out[4:], sums, strict=True):
                    x.append(value)
                    x.extend([None] * len(rare))
                if len(out[0]) > 100_000:
                    yield rows()
        yield rows()

    return run


def score(docs: DataFrame, key: str = "doc_id", order: int = ORDER, heavy: int = HEAVY, sent_rows: int = SENT_ROWS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row, with contexts that end at words."""
    words = stored(count_words(docs, key), "words")
    grams = stored(count_grams(words, order), "grams")
    probs = stored(probabilities(grams, order), "probabilities")
    return _by_row(docs, key, stored(score_words(words, probs, order, sent_rows), "scored"), heavy)


def score_texts(docs: DataFrame, key: str = "doc_id", order: int = ORDER, heavy: int = HEAVY, sent_rows: int = SENT_ROWS) -> DataFrame:
    """The columns of ``score`` of every row, with contexts that cross words."""
    words = stored(count_words(docs, key), "words").withColumn("lp", F.lit(0.0))
    grams = stored(count_text_grams(docs, key, order), "grams")
    probs = stored(probabilities(grams, order), "probabilities")
    return _by_row(docs, key, words, heavy, text_scores(docs, grams, probs, key, order, sent_rows))


def _by_row(docs: DataFrame, key: str, scored: DataFrame, heavy: int, more: DataFrame | None = None) -> DataFrame:
    """Sums over each row's words by ``scored`` (word, n, lp), and of ``more`` (doc_id, h, lp)."""
    import numpy as np

    sums = scored.filter("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = scored.filter((F.col("n") >= _least_frequent(scored, heavy)) & (F.length("word") <= HEAVY_BYTES)).toArrow()
    counts = top.column("n").to_numpy()
    table = (top.column("word").to_pylist(), np.log10(counts + 1.0), (counts > 0).astype(np.int64), top.column("lp").to_numpy())
    sent = docs.sparkSession.sparkContext.broadcast(table)
    schema = "doc_id bigint, h bigint, word binary, count bigint, n_tokens bigint, n_known bigint, base double, lp double"
    tokens = _rows(docs, key).mapInArrow(_tokens(sent, uuid.uuid4().hex), schema)
    rare = scored.select(F.col("word"), F.col("n").alias("c"), F.col("lp").alias("word_lp"))
    found = tokens.join(rare, "word", "left")
    if more is not None:
        found = found.unionByName(more, allowMissingColumns=True)
    plus = lambda own, more: F.sum(F.coalesce(F.col(own), F.lit(0)) + F.coalesce(more, F.lit(0)))
    by_doc = found.groupBy("doc_id", "h").agg(
        F.count("n_tokens").alias("rows"),
        F.sum("n_tokens").alias("n_tokens"),
        plus("n_known", F.when(F.col("c") > 0, F.col("count"))).alias("n_known"),
        plus("base", F.col("count") * F.log10(F.col("c") + 1.0)).alias("base"),
        plus("lp", F.col("count") * F.col("word_lp")).alias("lp"),
    )
    each = by_doc.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD_OUT_FOLD
    n_tokens = F.floor(F.col("n_tokens") / F.col("rows"))
    per_token = math.log10(sums["n"] + sums["v"] + 1)
    return each.select(
        "doc_id",
        held.alias("held_out"),
        n_tokens.alias("n_tokens"),
        F.floor(F.col("n_known") / F.col("rows")).alias("n_known"),
        F.lit(sums["n"]).cast("bigint").alias("train_tokens"),
        (F.col("base") / F.col("rows") - n_tokens * per_token).alias("base_score"),
        (F.col("lp") / F.col("rows")).alias("score"),
    )
