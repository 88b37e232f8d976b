"""Reading and scoring answers, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, entity_key, let

#: What counts as yes and as no.
TRUE_TOKENS = ("supported", "support", "yes", "true", "1", "y", "t")
FALSE_TOKENS = ("not supported", "unsupported", "no", "false", "0", "n", "f", "notsupported", "not")
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: The same and spaces, in a pattern.
_AROUND = r"[!-/:-@\[-`{-~ ]*"


def _bare(x) -> Column:
    return F.translate(F.trim(F.coalesce(col(x), F.lit(""))), _PUNCTUATION, "")


def choice_index(answer, options: Column) -> Column:
    """The 0-based option an answer means, or -1.

    In turn: a letter alone, a letter as its first word, an option's text, or
    a text that just one option holds.
    """
    n = F.size(options)
    body = F.coalesce(col(answer), F.lit(""))

    def lettered(pattern: str) -> Column:
        letter = F.regexp_extract(body, pattern, 1)
        i = F.when(letter != "", F.ascii(F.upper(letter)) - 65)
        return F.when(i < n, i)

    def by_text(target: Column, keys: Column) -> Column:
        exact = F.array_position(keys, target) - 1
        holding = F.filter(F.transform(keys, lambda k, i: F.when(F.contains(k, target), i)), lambda i: i.isNotNull())
        return F.when(target == "", -1).when(exact >= 0, exact).when(F.size(holding) == 1, F.get(holding, F.lit(0))).otherwise(-1)

    # letters are read off the text as it is; only texts without one are brought to a key, once
    said = body.rlike(r"(?U)[^\s\x00]")
    other = let(entity_key(body), lambda target: let(F.transform(options, entity_key), lambda keys: by_text(target, keys)))
    found = F.coalesce(lettered(rf"^{_AROUND}([A-La-l]){_AROUND}\z"), lettered(r"^\s*([A-Ha-h])\b"), other)
    return F.when((n > 0) & said, found).otherwise(F.lit(-1)).cast("int")


def truth(answer) -> Column:
    """true, false, or null where an answer is neither: by the whole text, then by its first word."""
    flat = F.lower(_bare(answer))
    joined, first = F.regexp_replace(flat, " ", ""), F.regexp_extract(flat, r"^\s*(\S+)", 1)
    yes, no = (lambda x: x.isin(*TRUE_TOKENS)), (lambda x: x.isin(*FALSE_TOKENS))
    return F.when(yes(flat) | yes(joined), True).when(no(flat) | no(joined), False).when(yes(first), True).when(no(first), False)


def last_tag(text, pattern: str) -> Column:
    """The first group of the last match, trimmed; null where there is none."""
    return F.trim(F.try_element_at(F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(pattern), F.lit(1)), F.lit(-1)))


def option_name(raw, count: int) -> Column:
    """option1 .. optionN for a number, a letter or a name of that kind; '' for anything else."""
    body = F.lower(F.trim(F.coalesce(col(raw), F.lit(""))))
    number = F.regexp_extract(body, r"^(?:option)?\s*(\d+)$", 1).try_cast("int")
    letter = F.when(body.rlike("^[a-h]$"), F.ascii(body) - 96)
    i = F.coalesce(number, letter)
    return F.when((i >= 1) & (i <= count), F.concat(F.lit("option"), i)).otherwise("")


def near(a, b, tolerance: float = 1e-2) -> Column:
    """Equal within the tolerance, relative or absolute."""
    x, y = col(a), col(b)
    return F.abs(x - y) <= F.greatest(F.greatest(F.abs(x), F.abs(y)) * tolerance, F.lit(tolerance))


def clamp(score) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(col(score), F.lit(0.0))))


def verdict_score(verdict) -> Column:
    """refuted 1, unverifiable a half, supported 0."""
    word = F.lower(F.trim(F.coalesce(col(verdict), F.lit(""))))
    return F.when(word == "refuted", 1.0).when(word == "supported", 0.0).otherwise(0.5)
