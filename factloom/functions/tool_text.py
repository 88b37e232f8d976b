"""Texts that tools answer with, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col

#: The labels of a record's lines, what says that there is none, and the lines around snippets.
LABELS = {"Authors:": "authors", "Year:": "year", "DOI:": "doi", "Venue:": "venue", "Snippet:": "snippet"}
NOTHING, NO_PAGES = "No literature results found", "No results found"
SNIPPETS, SNIPPETS_END, MAX_SNIPPETS = "Snippets:", "If the snippets above", 500


def _lines(x) -> Column:
    """The text with one kind of line end."""
    return F.regexp_replace(F.coalesce(col(x), F.lit("")), r"\r\n|[\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]", "\n")


def records(df: DataFrame, text: str, keys: list[str], labels: dict[str, str] | None = None, nothing: str = NOTHING) -> DataFrame:
    """keys, n (from 0), title and the labelled fields of each numbered block of ``text``.

    A block begins with a line ``[...] title`` and goes to the next one; of
    lines with one label the last counts, a label that is missing gives null. Blocks
    without a title are left out, and so are texts that say ``nothing``.
    """
    labels = LABELS if labels is None else labels
    body = F.when(F.contains(F.coalesce(col(text), F.lit("")), F.lit(nothing)), "").otherwise(_lines(text))
    blocks = F.split(body, r"(?m)^[ \t]*\[[^\]\n]*\]", -1)
    each = df.select(*keys, F.posexplode(F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0)))).alias("_at", "_block"))
    value = lambda label: F.trim(F.try_element_at(F.regexp_extract_all("_block", F.lit(rf"(?m)^[ \t]*\Q{label}\E([^\n]*)$"), F.lit(1)), F.lit(-1)))
    rows = each.select(*keys, "_at", F.trim(F.split_part("_block", F.lit("\n"), F.lit(1))).alias("title"), *(value(label).alias(name) for label, name in labels.items())).filter("title <> ''")
    return rows.withColumnRenamed("_at", "n")


def pages(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, n, url and snippet of each line ``[...] http...`` of a search's answer; the snippets of all are told with each."""
    body = F.when(F.startswith(F.coalesce(col(text), F.lit("")), F.lit(NO_PAGES)), "").otherwise(_lines(text))
    urls = F.regexp_extract_all(body, F.lit(r"(?m)^[ \t]*\[(?=[^\n]*\] http)[^\]\n]*\]([^\n]*)$"), F.lit(1))
    below = F.get(F.split(body, rf"(?m)^[ \t]*\Q{SNIPPETS}\E[^\n]*\n?", 2), F.lit(1))
    told = F.get(F.split(below, rf"(?m)^[ \t]*\Q{SNIPPETS_END}\E", 2), F.lit(0))
    told = F.regexp_replace(told, rf"(?m)^[ \t]*\Q{SNIPPETS}\E[^\n]*\n?", "")
    ended = F.when(told.isNull() | (told == "") | F.endswith(told, F.lit("\n")), F.coalesce(told, F.lit(""))).otherwise(F.concat(told, F.lit("\n")))
    return df.select(*keys, F.substring(ended, 1, MAX_SNIPPETS).alias("snippet"), F.posexplode(urls).alias("n", "url")).select(*keys, "n", F.trim("url").alias("url"), "snippet")
