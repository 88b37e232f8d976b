"""Agent trajectories: nested messages to steps and turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T

#: A message as trajectories hold it.
MESSAGE = "struct<source:string,type:string,text:string,calls:array<struct<tool_name:string,tool_args:string>>>"


def calls_text(calls: Column, limit: int = 400) -> Column:
    """Tool calls as text, arguments cut to ``limit`` characters."""
    return F.array_join(F.transform(calls, lambda c: F.concat(c["tool_name"], F.lit("("), F.substring(F.coalesce(c["tool_args"], F.lit("")), 1, limit), F.lit(")"))), "\n")


def steps(trajectories: DataFrame, key: str, messages: str, agents: tuple[str, ...] = ("assistant",), limit: int = 400) -> DataFrame:
    """What agents said and called, in order: tool results and other speakers' messages are left out, empty steps too."""
    rows = trajectories.select(key, F.posexplode(messages).alias("idx", "m"))
    said = F.when(F.size(F.coalesce("m.calls", F.array().cast("array<struct<tool_name:string,tool_args:string>>"))) > 0, calls_text(F.col("m.calls"), limit)).otherwise(T.normalize_text("m.text"))
    kept = rows.filter(F.col("m.source").isin(*agents) & (F.coalesce("m.type", F.lit("")) != "tool_result"))
    return kept.select(key, "idx", said.alias("step")).filter("step <> ''")


def session_turns(states: DataFrame, key: str, history: str, session: str | None = None) -> DataFrame:
    """The messages of a session (the current one unless named) out of a map of histories, in order of their timestamps."""
    chosen = F.lit(session) if session is not None else F.col("current_session").cast("string")
    rows = states.select(key, F.posexplode(F.array_sort(F.coalesce(F.try_element_at(F.col(history), chosen)["messages"], F.array().cast("array<struct<timestamp:int,type:string,sender:string,content:string>>")))).alias("place", "m"))
    return rows.select(key, "place", "m.*")


def role(sender: Column, kind: Column) -> Column:
    """assistant for a model's answer or an agent's message, system for control messages, else user."""
    low = F.lower(F.coalesce(sender, F.lit("")))
    return F.when(F.coalesce(kind, F.lit("")).isin("response", "thought", "tool_call"), "assistant").when(low.contains("assistant") | low.contains("agent"), "assistant").when(low == "system", "system").otherwise("user")


def after(messages: Column, cutoff: Column) -> Column:
    return F.filter(messages, lambda m: m["timestamp"] > cutoff)
