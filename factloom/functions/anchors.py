"""Where a quotation lies in a text, by its words whatever white space is between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let

#: White space of any kind.
WHITE = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"

#: How a claim names an option, or leads up to what it says.
OPTION_LEAD = r"(?i)^option\s*[a-z0-9]+\s*(?:is|:)?\s*"
CLAIM_LEAD = r"(?i)^(the agent (?:connects|claims|states|argues) that|the previous claim(?: about)?|it (?:suggests|claims|argues) that)\s+"
#: What ends a leading clause, and how long that must be.
CLAUSE_ENDS, MIN_CLAUSE = (",", ".", ";"), 24


def stripped(x) -> Column:
    return F.regexp_replace(F.coalesce(col(x), F.lit("")), f"^{WHITE}+|{WHITE}+$", "")


def one_spaced(x) -> Column:
    return F.regexp_replace(stripped(x), f"{WHITE}+", " ")


def _literally(x: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(x, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _found(text: Column, pattern: Column, base: Column) -> Column:
    """(start, end) of all matches one after another, ``base`` characters further."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    zero = F.struct(base.cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(a: Column, hit: Column) -> Column:
        start = a["at"] + F.length(hit["gap"])
        end = start + F.length(hit["text"])
        return F.struct(end.alias("at"), F.concat(a["spans"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("spans"))

    pairs = let(gaps, lambda g: F.transform(hits, lambda h, i: F.struct(F.get(g, i).alias("gap"), h.alias("text"))))
    return F.aggregate(pairs, zero, step, lambda a: a["spans"])


def anchor_spans(text, anchor) -> Column:
    """(start, end) of all places of ``anchor`` in ``text``, in characters.

    All places that are equal letter by letter come first, one after another;
    behind the last of these, places whose words are equal with any white space
    between them. A null or blank text or anchor has none.
    """

    def by_letters(whole: Column, wanted: Column) -> Column:
        tail = F.element_at(F.split(whole, _literally(wanted), -1), -1)
        base = F.length(whole) - F.length(tail)
        spaced = F.replace(_literally(F.regexp_replace(wanted, f"{WHITE}+", " ")), F.lit(" "), F.lit(rf"\E{WHITE}+\Q"))
        return F.concat(_found(F.substring(whole, F.lit(1), base), _literally(wanted), F.lit(0)), let(tail, lambda t: _found(t, spaced, base)))

    none = F.array().cast("array<struct<start:int,end:int>>")
    inner = lambda whole, wanted: F.when((whole != "") & (wanted != ""), by_letters(whole, wanted)).otherwise(none)
    return let(F.coalesce(col(text), F.lit("")), lambda whole: let(stripped(anchor), lambda wanted: inner(whole, wanted)))


def anchor_span(text, anchor) -> Column:
    """The first of ``anchor_spans``, null where there is none."""
    return F.get(anchor_spans(text, anchor), F.lit(0))


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, "^[ .:-]+|[ .:-]+$", "")


def anchor_variants(*values) -> Column:
    """All forms under which a text may quote one of ``values``: whole, without the option or the lead, and its first clauses; each once, in this order."""

    def of_text(text: Column) -> Column:
        def forms(bare: Column) -> Column:
            base = F.when(bare != "", bare).otherwise(text)

            def with_clauses(claim: Column) -> Column:
                whole = F.when(claim != "", claim).otherwise(base)
                heads = [_trimmed(F.split_part(whole, F.lit(end), F.lit(1))) for end in CLAUSE_ENDS]
                return F.array(text, bare, claim, *(F.when(F.length(h) >= MIN_CLAUSE, h).otherwise("") for h in heads))

            return let(_trimmed(F.regexp_replace(base, CLAIM_LEAD, "")), with_clauses)

        return F.when(text == "", F.array().cast("array<string>")).otherwise(let(_trimmed(F.regexp_replace(text, OPTION_LEAD, "")), forms))

    every = F.flatten(F.array(*(let(one_spaced(v), of_text) for v in values)))
    return F.array_distinct(F.filter(F.transform(every, one_spaced), lambda x: x != ""))


def looks_like_code(x) -> Column:
    """Whether a text begins like a printed list or mapping, which no turn holds word by word."""
    return F.ltrim(F.coalesce(col(x), F.lit(""))).rlike(r"""^[\[({][\s\[({]*['"]?\w+['"]?\s*:""")


def best_anchor(claim, snippet, statement, reason) -> Column:
    """What to look for in a turn: the snippet, else the statement, else its sentence that holds the claim, the claim, or the reason; never printed structures."""
    clean = lambda x: let(one_spaced(x), lambda v: F.when(looks_like_code(v), "").otherwise(v))
    raw = F.when(F.coalesce(col(snippet), F.lit("")) != "", col(snippet)).otherwise(col(statement))
    whole, said = clean(statement), clean(claim)
    sentences = F.transform(F.split(whole, r"(?<=[.!?])\s+"), clean)
    holding = let(said, lambda c: F.get(F.filter(sentences, lambda s: (c != "") & (s != "") & F.contains(s, c)), F.lit(0)))
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in (clean(raw), holding, said, whole, clean(reason))), F.lit(""))
