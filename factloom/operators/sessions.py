"""Sessions that stand still, and sessions that go back to earlier ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.plans.storage import drop_stored, stored


def signature_stalls(polls: DataFrame, key: str, ts: str, signature: str, seconds: int) -> DataFrame:
    """key, signature and since of every time that a key's signature stayed the same for more than ``seconds``.

    ``polls`` says what a key's signature was at a time. It stays the same until
    a poll that differs, or until the last poll of any key. Polls at one time
    are ordered by signature; null keys, times and signatures are left out.
    """
    rows = polls.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(signature).alias("signature")).dropna()
    by = Window.partitionBy("key").orderBy("ts", "signature")
    starts = rows.withColumn("_before", F.lag("signature").over(by)).filter(~F.col("signature").eqNullSafe(F.col("_before"))).drop("_before")
    end = rows.agg(F.max("ts").alias("_end"))  # one row
    runs = starts.withColumn("_next", F.lead("ts").over(by)).join(F.broadcast(end))
    stayed = F.unix_micros(F.coalesce("_next", "_end")) - F.unix_micros("ts")
    return runs.filter(stayed > seconds * 1_000_000).select(F.col("key").alias(key), F.col("signature").alias(signature), F.col("ts").alias("since"))


def lineage(resets: DataFrame) -> DataFrame:
    """session, ancestor and cutoff: which sessions each one goes back to, directly or over others, and before what time it keeps their rows.

    ``resets`` has session, parent and cutoff, one row a session. The cutoff of
    an ancestor is the least on the way to it. Ways double in length with each
    round, so rounds grow with the logarithm of the longest one.
    """
    one = resets.select("session", F.col("parent").alias("ancestor"), "cutoff").dropna(subset=["session", "ancestor"])
    ways = stored(one.groupBy("session", "ancestor").agg(F.min("cutoff").alias("cutoff")), "ways")
    n = ways.count()
    while True:
        on = ways.select(F.col("session").alias("ancestor"), F.col("ancestor").alias("_far"), F.col("cutoff").alias("_cut"))
        longer = ways.join(on, "ancestor").select("session", F.col("_far").alias("ancestor"), F.least("cutoff", "_cut").alias("cutoff"))
        both = stored(ways.union(longer).filter("session <> ancestor").groupBy("session", "ancestor").agg(F.min("cutoff").alias("cutoff")), "ways")
        if (m := both.count()) == n:
            drop_stored(both)
            return ways
        drop_stored(ways)
        ways, n = both, m


def visible(history: DataFrame, resets: DataFrame, session: str, ts: str) -> DataFrame:
    """``history`` as every session sees it, in ``viewer``: its own rows, and those of its ancestors before their cutoffs."""
    rows = history.withColumn("_own", F.col(session))
    known = lineage(resets).select(F.col("session").alias("viewer"), F.col("ancestor").alias("_own"), "cutoff")
    inherited = rows.join(known, "_own").filter(F.col("cutoff").isNull() | (F.col(ts) < F.col("cutoff"))).drop("cutoff", "_own")
    return inherited.unionByName(history.withColumn("viewer", F.col(session)))
