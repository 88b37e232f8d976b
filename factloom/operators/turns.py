"""Conversations, spans and event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T


def without_repeats(turns: DataFrame, session: str, order: str, role: str, text: str) -> DataFrame:
    """Turns whose signature (role and text) differs from the turn before; empty ones go first."""
    kept = turns.filter(T.normalize_text(text) != "").withColumn("_sig", F.concat_ws("\x1f", role, T.normalize_text(text)))
    before = F.lag("_sig").over(Window.partitionBy(session).orderBy(order))
    return kept.withColumn("_before", before).filter(~F.col("_sig").eqNullSafe(F.col("_before"))).drop("_sig", "_before")


def says_nothing(text) -> Column:
    """Whether a turn only ends a session or gives up: very short, a short farewell or bare answer, or a failed look-up. Fixed values throughout."""
    body = F.trim(F.coalesce(T.col(text), F.lit("")))
    low, n = F.lower(body), F.length(body)
    head = F.substring(low, 1, 400)
    failed = F.contains(head, F.lit("could not fetch")) | F.contains(head, F.lit("could not retrieve"))
    return (n < 40) | (F.contains(low, F.lit("terminate")) & (n < 200)) | failed | (F.contains(low, F.lit("<answer>")) & (n < 400))


def last_assistant(turns: DataFrame, session: str, order: str, role: str, text: str) -> DataFrame:
    """Per session the last assistant turn that says something, else the last assistant turn, else the last turn."""
    said = F.col(role) == "assistant"
    rank = F.when(said & ~says_nothing(text), 2).when(said, 1).otherwise(0)
    row = F.struct(F.col(order).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    return turns.groupBy(session).agg(F.max_by(row, F.struct(rank, F.col(order))).alias("_t")).select(session, "_t.*")


def numbered(turns: DataFrame, session: str, order: str, role: str) -> DataFrame:
    """``assistant_turn``: how many assistant turns there are up to each turn."""
    so_far = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return turns.withColumn("assistant_turn", F.count_if(F.col(role) == "assistant").over(so_far))


def sentence_claims(turns: DataFrame, session: str, order: str, text: str, most: int = 50) -> DataFrame:
    """Sentences of 20 to 400 characters as claims, numbered by turn and place, at most ``most`` a session."""
    parts = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"[.!?]+\s+"), lambda s: F.trim(s))
    rows = turns.select(session, order, F.posexplode(parts).alias("pos", "claim")).filter(F.length("claim").between(20, 400))
    first = rows.groupBy(session, "claim").agg(F.min(F.struct(order, "pos")).alias("_at")).select(session, "claim", "_at.*")
    return first.withColumn("claim_no", F.row_number().over(Window.partitionBy(session).orderBy(order, "pos"))).filter(F.col("claim_no") <= most)


def merged_spans(spans: DataFrame, key: str, start: str, end: str, max_gap: float = 0) -> DataFrame:
    """Spans of a key fused where the next begins at most ``max_gap`` after all before it end."""
    by = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) - reach > max_gap), 1).otherwise(0)
    islands = spans.withColumn("_new", new).withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return islands.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n_spans")).drop("_island")


def outermost_spans(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Spans that no span before them (earlier start, or same start and longer) contains."""
    by = Window.partitionBy(key).orderBy(F.col(start), F.desc(end)).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_reach", F.max(end).over(by)).filter(F.col("_reach").isNull() | (F.col(end) > F.col("_reach"))).drop("_reach")


def pivoted(events: DataFrame, key: str, event: str, kinds: tuple[str, ...]) -> DataFrame:
    """Per key the count of each kind of event."""
    return events.groupBy(key).agg(*(F.count_if(F.col(event) == k).alias(f"n_{k}") for k in kinds))


def rate_windows(events: DataFrame, key: str, ts: str, cost: str, seconds: int = 60) -> DataFrame:
    """For each event the events and their cost in the ``seconds`` up to it, those at the same time included."""
    width = seconds * 1_000_000
    rows = events.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))
    # a key's time is cut into stretches of many windows; an event also goes to the next stretch if a window there reaches back to it
    stretch = F.floor(F.col("_at") / (64 * width))
    later = F.floor((F.col("_at") + width) / (64 * width))
    rows = rows.withColumn("_own", stretch).withColumn("_part", F.explode(F.when(later > stretch, F.array(stretch, later)).otherwise(F.array(stretch))))
    by = Window.partitionBy(key, "_part").orderBy("_at").rangeBetween(-width, Window.currentRow)
    counted = rows.withColumns({"n_recent": F.count(F.lit(1)).over(by), "cost_recent": F.sum(cost).over(by)})
    return counted.filter("_part = _own").drop("_at", "_own", "_part")


def stalls(events: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Sessions of a key, parted by gaps above ``gap_seconds``: first and last event, and their number."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = events.select(key, F.col(ts).cast("timestamp").alias("_ts"), at.alias("_at"))
    by = Window.partitionBy(key).orderBy("_at")
    new = F.when(F.col("_at") - F.lag("_at").over(by) <= gap_seconds * 1_000_000, 0).otherwise(1)
    numbered_ = rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered_.groupBy(key, "session").agg(F.min("_ts").alias("first_ts"), F.max("_ts").alias("last_ts"), F.count(F.lit(1)).alias("n_events"))


def running_accuracy(rows: DataFrame, key: str, order: str, correct: str) -> DataFrame:
    by = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("accuracy_so_far", F.avg(F.col(correct).cast("double")).over(by))


def reverted(history: DataFrame, session: str, ts: str, cutoffs: DataFrame) -> DataFrame:
    """What a session keeps when it goes back: its rows before its cutoff, under the next session's number."""
    return history.join(cutoffs, session).filter(F.col(ts) < F.col("cutoff")).withColumn("new_session", F.col(session) + 1).drop("cutoff")


def redacted_options(x) -> Column:
    """Mentions of an option by letter or number made neutral."""
    return F.regexp_replace(T.col(x), r"(?i)\b(?:option|choice|answer)\s*(?:\(?[A-H]\)?|\d+)\b", "the option")
