"""Seeds: names in texts from which a search can start. Cleaning, compounds to their parts, and why a candidate is none.

The words of a language and a field are parameters (``SeedRules``), in lower case.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

_PUNCTUATION = " ,.;:!?()[]{}\"'"


@dataclass(frozen=True)
class SeedRules:
    openings: tuple[str, ...] = ()  #: how a question begins, which is cut
    tails: tuple[str, ...] = ()  #: words that end a name, with all that follows
    determiners: tuple[str, ...] = ("the", "a", "an")
    kinds: dict[str, str] = field(default_factory=dict)  #: what things are called, plural to singular
    generic: tuple[str, ...] = ()  #: names that say nothing
    bad_starts: tuple[str, ...] = ()
    light: tuple[str, ...] = ()  #: words of which a sentence has many
    aspects: tuple[str, ...] = ()  #: sides of a thing, which aren't names behind another word
    phrases: tuple[str, ...] = ()  #: what only sentences hold
    max_words: int = 6
    light_share: float = 0.45

    @property
    def kind_words(self) -> str:
        return _any(tuple(self.kinds) + tuple(self.kinds.values()))


def _any(words: tuple[str, ...]) -> str:
    """A pattern of any of the words, longer ones first; of none, one that never matches."""
    return "|".join(re.escape(w).replace(r"\ ", " ") for w in sorted(set(words), key=lambda w: (-len(w), w))) or r"[^\s\S]"


def has_signal(x) -> Column:
    """A digit, a capital behind the first letter, or one of / : - + inside."""
    return F.btrim(T.col(x), F.lit(_PUNCTUATION)).rlike(r"(?s)[0-9/:+-]|.\p{Lu}")


def stripped(v: SeedRules, x) -> Column:
    """A candidate without question words, tails and determiners; '' for null."""
    bare = F.btrim(T.normalize_text(x), F.lit(_PUNCTUATION))
    body = F.regexp_replace(bare, rf"(?i)^(?:(?:{_any(v.openings)})\s+)+", "")
    body = F.regexp_replace(body, rf"(?i)\s+(?:{_any(v.tails)})\b.*$", "")
    return F.trim(F.regexp_replace(body, rf"(?i)^(.*?)\b(?:{_any(v.determiners)})\s+", "$1"))


def of_kind(v: SeedRules, b: Column) -> Column:
    """The longest part of a stripped candidate that ends in a kind, or all of it. Most have no kind, which one look tells."""
    word = "[A-Za-z0-9][A-Za-z0-9/:+-]*+"
    found = F.regexp_extract_all(b, F.lit(rf"(?i)\b({word}(?:\s+{word}){{0,4}}\s+(?:{v.kind_words}))\b"), F.lit(1))
    weighed = F.transform(found, lambda p, i: F.struct(F.size(F.split(p, r"\s+")).alias("words"), F.regexp_count(p, F.lit("[A-Z]")).alias("capitals"), F.length(p).alias("chars"), (-i).alias("back"), p.alias("p")))
    return F.when(b.rlike(rf"(?i)\s(?:{v.kind_words})\b"), F.coalesce(F.array_max(weighed)["p"], b)).otherwise(b)


def from_sign(b: Column) -> Column:
    """What is left, from the second word with a sign on, if any. Most have no sign."""

    def cut(words: Column) -> Column:
        first = F.array_min(F.filter(F.transform(words, lambda w, i: F.when((i > 0) & has_signal(w), i)), lambda i: i.isNotNull()))
        return F.array_join(F.slice(words, F.coalesce(first, F.lit(0)) + 1, F.greatest(F.size(words), F.lit(1))), " ")

    return F.btrim(F.when(b.rlike(r"[0-9/:+-]|\S\p{Lu}"), T.let(F.split(b, r"\s+"), cut)).otherwise(b), F.lit(_PUNCTUATION))


def cleaned(v: SeedRules, x) -> Column:
    """A candidate without question words, tails and determiners: the longest part that ends in a kind, from the second word with a sign on, if any. '' for null."""
    return T.let(T.let(stripped(v, x), lambda b: of_kind(v, b)), from_sign)


def with_cleaned(v: SeedRules, rows: DataFrame, *names: str) -> DataFrame:
    """``rows`` with the columns ``names`` cleaned, a step a projection: Spark compiles these, but walks through what stands in a lambda."""
    for step in (lambda c: stripped(v, c), lambda c: of_kind(v, F.col(c)), lambda c: from_sign(F.col(c))):
        rows = rows.withColumns({c: step(c) for c in names})
    return rows


def compounds(v: SeedRules, name) -> Column:
    """A cleaned name and, where two are joined by and, each of both, with the kind that they share; distinct, without empty ones."""
    shared = rf"(?i)^(.+?)\s+and\s+(?:the\s+)?(.+?)\s+({v.kind_words})$"
    pair = r"^([A-Za-z0-9/:+_.-]+)\s+and\s+([A-Za-z0-9/:+_.-]+)$"

    def parts(n: Column) -> Column:
        side = lambda pattern, i: F.regexp_extract(n, pattern, i)
        kind = T.let(F.lower(side(shared, 3)), lambda k: F.coalesce(F.try_element_at(_map(v.kinds), k), k))
        both = T.let(kind, lambda k: F.array(F.concat_ws(" ", side(shared, 1), k), F.concat_ws(" ", side(shared, 2), k)))
        found = F.when(n.rlike(rf"(?i)\s(?:{v.kind_words})$") & n.rlike(shared), both).when(n.rlike(pair), F.array(side(pair, 1), side(pair, 2))).otherwise(F.array().cast("array<string>"))
        several = F.array_distinct(F.filter(F.concat(F.array(n), found), lambda p: p != ""))
        alone = F.when(n != "", F.array(n)).otherwise(F.array().cast("array<string>"))
        return F.when(n.rlike(r"(?i)\sand\s"), several).otherwise(alone)

    return parts(F.col(name)) if isinstance(name, str) else T.let(name, parts)


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv)) if pairs else F.create_map().cast("map<string,string>")


def canonical(v: SeedRules, name) -> Column:
    """Kinds in the singular, whatever their case."""
    singular = lambda n: T.let(_map(v.kinds), lambda m: F.array_join(F.transform(F.split(n, r"\s+"), lambda w: F.coalesce(F.try_element_at(m, F.lower(w)), w)), " "))
    # without a plural and with single spaces, a name stays as it is
    some = lambda n: F.when(n.rlike(rf"(?iu)(?:^|\s)(?:{_any(tuple(v.kinds))})(?:\s|$)|\s\s|[^\S ]"), singular(n)).otherwise(n)
    return some(F.col(name)) if isinstance(name, str) else T.let(name, some)


def broken(v: SeedRules, n: Column, key: Column, words: Column) -> Column:
    """The first rule that a canonical name ``n`` with its ``key`` of these words breaks, or null for a seed."""
    light = F.regexp_count(key, F.lit(rf"(?<![^ ])(?:{_any(tuple(w for w in v.light if ' ' not in w))})(?![^ ])"))
    aspect = F.element_at(words, -1).isin(*v.aspects) if v.aspects else F.lit(False)
    kind = F.element_at(words, -1).isin(*v.kinds.values()) if v.kinds else F.lit(False)
    lone = (F.size(words) == 1) & (F.length(key) >= 6) & ~key.endswith("s")
    rules = (
        ("empty", key == ""),
        ("generic", key.isin(*v.generic) if v.generic else F.lit(False)),
        ("short", F.length(key) < 3),
        ("number", key.rlike("^[0-9]+$")),
        ("start", F.get(words, F.lit(0)).isin(*v.bad_starts) if v.bad_starts else F.lit(False)),
        ("long", F.size(words) > v.max_words),
        ("sentence", light >= v.light_share * F.size(words)),
        ("aspect", aspect & (F.size(words) >= 2)),
        ("phrase", F.concat(F.lit(" "), key, F.lit(" ")).rlike(rf" (?:{_any(v.phrases)}) ")),
        ("no_sign", ~(has_signal(n) | kind | lone)),
    )
    return F.coalesce(*(F.when(fails, F.lit(why)) for why, fails in rules))


def useless(v: SeedRules, name) -> Column:
    """``broken`` of a canonical name alone."""
    return T.let(T.col(name), lambda n: T.let(T.normalize_keyword(n), lambda key: T.let(F.split(key, " "), lambda words: broken(v, n, key, words))))
