"""Texts that models wrote: what to cut, keep and read out of them, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_entity, col, normalize_keyword

#: Phrases that mark a paragraph as an apology or a change of mind.
APOLOGIES = (
    "i apologize", "i'?m sorry", "let me re-?evaluate", "let me reconsider", "you'?re absolutely right", "you'?re right to question", "on second thought", "looking at this again",
    "i was (?:wrong|incorrect|mistaken)", "my previous (?:answer|response|conclusion|analysis|reasoning)", "thank you for pointing",
)

#: How a line begins that concludes or picks an answer.
CONCLUSIONS = (
    "(?:Therefore|Thus|Hence|So|In conclusion|Based on (?:this|the above|my|our|the) (?:analysis|reasoning|evidence|information))[,;:\\s]",
    "(?:The (?:correct|best|final|most (?:appropriate|likely|plausible)) (?:answer|option|choice))",
    "(?:(?:My|Our|The) (?:final )?answer)",
    "(?:After (?:careful )?(?:analysis|consideration|review))",
    "(?:Given (?:all )?(?:the|this) (?:above|evidence|information|analysis))",
)

#: Words whose full stop ends no sentence.
ABBREVIATIONS = (
    "e.g", "i.e", "etc", "vs", "cf", "al", "et al", "approx", "no", "fig", "figs", "eq", "eqs", "ref", "refs", "ca", "viz", "dr", "mr", "mrs", "ms", "prof", "st", "mt",
    "a", "b", "c", "d", "e", "h", "l", "m", "n", "p", "s", "t", "spp", "sp", "subsp", "var",
)

#: What output of a search tool looks like, and logs of errors. Signatures of further tools are given as a parameter.
TOOL_OUTPUT = (r"literature\s+results\s+for:", r"\bDOI:\s*(?:N/?A|10\.)", r"\bVenue:\s*N/?A", r"\bAuthors:\s*[A-Z][a-z]", "use this tool for scholarly papers", r"^\s*\[\{['\"]content['\"]", r"^\s*\{['\"]content['\"]\s*:")
ERROR_WORDS = ("Traceback", "Exception", "ERROR", "[WARN]")

#: Reasons that speak for a repair, and those that speak against reading them so.
FAULTS = r"(?i)\b(incorrect|unsupported|wrong|mismatch|not supported|contradict(?:ed|s)?|inconsistent|does not support|insufficient evidence)\b"
NO_FAULTS = r"(?i)\b(not\s+(?:incorrect|unsupported|wrong|inconsistent)|no\s+(?:mismatch|contradiction)|correct|consistent|supported|matches|supports the claim|aligns with)\b"

#: Names of cell types that don't end in cell or cells.
CELL_TYPES = ("pbmcs", "escs", "embryonic stem cells", "definitive endoderm", "definitive endoderm cells", "mesendoderm", "mesendoderm cells")


def without_apologies(x) -> Column:
    """A text without paragraphs that apologize; the whole text where nothing else is left."""
    body = F.coalesce(col(x), F.lit(""))
    kept = F.filter(F.split(body, r"\n{2,}"), lambda p: ~p.rlike(r"(?i)\b(?:" + "|".join(APOLOGIES) + r")\b"))
    left = F.regexp_replace(F.array_join(kept, "\n\n"), r"^\s+|\s+$", "")
    return F.when(left != "", left).otherwise(body)


def _last(body: Column, end: Column, mark: str) -> Column:
    """Where ``mark`` begins last among the first ``end`` characters, from 0; -1 where it doesn't."""
    head = F.substring(body, F.lit(1), end.cast("int"))
    tail = F.substring_index(head, mark, -1)
    return F.when(F.contains(head, F.lit(mark)), F.length(head) - F.length(tail) - len(mark)).otherwise(-1)


def before_conclusion(x) -> Column:
    """What comes before a text's conclusion, if a fifth of it or more does; else about three fifths, up to the end of a paragraph or sentence."""
    body = F.coalesce(col(x), F.lit(""))
    n = F.length(body)
    cut = F.regexp_instr(body, F.lit(r"(?i)(?:^|\n)\s*(?:" + "|".join(CONCLUSIONS) + ")")) - 1
    target = F.floor(n * 0.6)
    paragraph = _last(body, target + 200, "\n\n")
    sentence = F.greatest(_last(body, target + 100, ". "), _last(body, target + 100, ".\n"))
    end = F.when((cut >= 0) & (cut >= n * 0.2), cut).when(paragraph > n * 0.2, paragraph).when(sentence > n * 0.2, sentence + 1).otherwise(target)
    return F.regexp_replace(F.substring(body, F.lit(1), end.cast("int")), r"\s+$", "")


def first_sentence(x) -> Column:
    """A text up to its first full stop before a capital, a quote or a bracket that isn't an abbreviation's."""
    body = F.coalesce(col(x), F.lit(""))
    known = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS if " " not in a)
    # the letters and stops before the mark, as one word
    end = rf"(?<!(?:^|[^\p{{L}}.])(?i:{known})\.{{0,2}})[.!?](?= *[\p{{Lu}}\"'(\[])"
    found = F.regexp_extract(body, r"(?s)^(.*?" + end + ")", 1)
    return F.trim(F.when(found != "", found).otherwise(body))


def is_tool_output(x, more: tuple[str, ...] = ()) -> Column:
    """Whether a claim is what a tool printed, by its signatures and ``more`` of them."""
    body = F.coalesce(col(x), F.lit(""))
    return (F.length(body) >= 40) & body.rlike("(?i)(?:" + "|".join((*TOOL_OUTPUT, *more)) + ")")


def is_error_log(level, message) -> Column:
    body = F.coalesce(col(message), F.lit(""))
    named = F.upper(F.coalesce(col(level), F.lit(""))).isin("ERROR", "CRITICAL")
    return named | F.exists(F.array(*map(F.lit, ERROR_WORDS)), lambda w: F.contains(body, w))


def leak(x, option_pattern: str = r"(?i)\b(?:option|choice)\s*\(?[A-H0-9]+\)?\b", answer_pattern: str = r"(?i)\bthe (?:correct )?answer is\b") -> Column:
    """Why a rewritten text gives too much away: empty, leak_guard, or null."""
    body = F.coalesce(col(x), F.lit(""))
    told = F.contains(F.lower(body), F.lit("<answer>")) | F.contains(F.lower(body), F.lit("</answer>")) | body.rlike(r"(?i)\bterminate\b") | body.rlike(option_pattern) | body.rlike(answer_pattern)
    return F.when(F.trim(body) == "", "empty").when(told, "leak_guard")


def yes_no(x) -> Column:
    """Yes or No for what means it, else the text as it is."""
    low = F.lower(F.trim(F.coalesce(col(x), F.lit(""))))
    return F.when(low.isin("yes", "true", "1"), "Yes").when(low.isin("no", "false", "0"), "No").otherwise(F.coalesce(col(x), F.lit("")))


def elevated(verification_error, hallucination, reason) -> Column:
    """The verification error in canonical form, Yes where only the reason speaks of a fault."""
    error, made, why = yes_no(verification_error), yes_no(hallucination), F.trim(F.coalesce(col(reason), F.lit("")))
    return F.when(why.rlike(FAULTS) & ~why.rlike(NO_FAULTS) & (error != "Yes") & (made != "Yes"), "Yes").otherwise(error)


def question_answer(x) -> Column:
    """A struct (question, answer) of "Q: ... A: ..." over two lines; null where either is missing."""
    parts = F.split(F.coalesce(col(x), F.lit("")), r"(?i)\n\s*A\s*:\s*", 2)
    strip = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    q, a = strip(F.regexp_replace(F.get(parts, F.lit(0)), r"(?i)^\s*Q\s*:\s*", "")), strip(F.get(parts, F.lit(1)))
    return F.when((q != "") & (a != ""), F.struct(q.alias("question"), a.alias("answer")))


def answer_format(x) -> Column:
    return F.when(F.rtrim(F.regexp_replace(F.lower(F.trim(F.coalesce(col(x), F.lit("")))), "[.!?]+$", "")).isin("yes", "no"), "yesno").otherwise("open")


def published_year(x) -> Column:
    """The first year among the dates of a bibliographic record, given as JSON: issued, online, in print, published."""
    def part(name: str) -> Column:
        year = F.trim(F.get_json_object(col(x), f"$['{name}']['date-parts'][0][0]"))
        return F.when(~year.isin("", "null"), year)

    return F.coalesce(*map(part, ("issued", "published-online", "published-print", "published")))


def is_cell_type(x) -> Column:
    low = normalize_keyword(x)
    return (low != "") & ~F.contains(low, F.lit("cell line")) & (low.endswith(" cells") | low.endswith(" cell") | low.isin(*CELL_TYPES))


def interaction(x) -> Column:
    """ "Interaction between A and B" and its like as "A-B interaction"; other names cleaned alone."""
    name = clean_entity(x)
    out = name
    for pattern in (
        r"(?i)^(.+?)\s+interaction\s+with\s+(.+)$",
        r"(?i)^(?:physical\s+)?interaction\s+between\s+(.+?)\s+and\s+(.+)$",
        r"(?i)^(?:physical\s+)?binding\s+of\s+(.+?)\s+to\s+(.+)$",
        r"(?i)^(?:physical\s+)?association\s+between\s+(.+?)\s+and\s+(.+)$",
    ):
        a, b = (clean_entity(F.regexp_extract(name, pattern, i)) for i in (1, 2))
        out = F.when(name.rlike(pattern) & (a != "") & (b != ""), F.concat(a, F.lit("-"), b, F.lit(" interaction"))).otherwise(out)
    return out


def rewrite_mode(x) -> Column:
    low = F.lower(F.trim(F.coalesce(col(x), F.lit(""))))
    return F.when(low.isin("1", "true", "yes", "on"), "cross_claim_only").when(low.isin("cross_claim_only", "on_fused", "always"), low).otherwise("off")


def rewritable(claim_ids: Column, mode, cross_claim: Column) -> Column:
    """Whether a fused span may be rewritten: by mode, if it is of several claims, or of several spans."""
    ids, m = F.array_compact(F.coalesce(claim_ids, F.array().cast("array<string>"))), col(mode)
    several = F.size(F.array_distinct(ids)) >= 2
    return F.when(m == "cross_claim_only", cross_claim & several).when(m == "on_fused", F.size(ids) >= 2).otherwise(m == "always")
