"""Values nested to any depth, as JSON texts or variants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.plans.storage import stored

#: Stand for an escaped backslash and an escaped quote; JSON texts can't hold them as they are.
BACKSLASH, QUOTE = "\x01", "\x02"


def walked(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """keys, path and text of every string in ``value`` (a JSON text), level by level.

    A path has ``.name`` for a member and ``[i]`` for an element; a name that
    isn't letters, digits and underscores is quoted. Each round opens what the
    one before found, so that rounds are as many as the deepest value has
    levels. Null and malformed values have no strings.
    """
    spark = df.sparkSession
    level = df.select(*keys, F.lit("$").alias("path"), F.try_parse_json(F.col(value)).alias("v")).filter(F.col("v").isNotNull())
    out = None
    while True:
        known = stored(level.select(*keys, "path", "v", F.substring(F.to_json("v"), 1, 1).alias("kind")), "level")
        texts = known.filter("kind = '\"'").select(*keys, "path", F.variant_get("v", "$", "string").alias("text"))
        out = texts if out is None else out.union(texts)
        inner = known.filter("kind IN ('{', '[')")
        if not inner.limit(1).count():
            return out
        opened = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("pos", "name", "member"))
        name = F.when(F.col("name").rlike(r"^\w+$"), F.concat(F.lit("."), F.col("name"))).otherwise(F.concat(F.lit("['"), F.col("name"), F.lit("']")))
        step = F.when(F.col("kind") == "{", name).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = opened.select(*keys, F.concat("path", step).alias("path"), F.col("member").alias("v")).filter(F.col("v").isNotNull())


def rewritten(value, change: Callable[[Column], Column]) -> Column:
    """The JSON text with ``change`` made to every string that isn't a name; all else, spaces too, stays as it is.

    Between quotes that aren't escaped, every other piece is a string, and a
    name if a colon follows. A null text stays null.
    """
    x = F.col(value) if isinstance(value, str) else value
    plain = F.replace(F.replace(x, F.lit("\\\\"), F.lit(BACKSLASH)), F.lit('\\"'), F.lit(QUOTE))
    back = lambda v: F.replace(F.replace(v, F.lit(QUOTE), F.lit('\\"')), F.lit(BACKSLASH), F.lit("\\\\"))

    def changed(piece: Column) -> Column:
        held = F.from_json(F.concat(F.lit('{"a":"'), back(piece), F.lit('"}')), "a string")["a"]
        new = F.to_json(F.struct(F.coalesce(change(held), F.lit("")).alias("a")))
        return F.substring(new, F.lit(7), F.length(new) - 8)

    def all_of(pieces: Column) -> Column:
        is_value = lambda i: (i % 2 == 1) & ~F.coalesce(F.get(pieces, i + 1).rlike(r"^\s*:"), F.lit(False))
        return F.array_join(F.transform(pieces, lambda p, i: F.when(is_value(i), changed(p)).otherwise(back(p))), '"')

    return F.get(F.transform(F.array(F.split(plain, '"', -1)), all_of), F.lit(0))

