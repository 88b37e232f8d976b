"""What an agent commits to, what of its texts is worth analysing, how a correction is worded and how a claim is searched, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .repair import first_sentence, is_tool_output
from .text import col, let, normalize_text

#: Phrases in whose line an agent commits itself.
COMMITMENTS = (
    r"final\s+answer",
    r"the\s+(?:most|best)\s+(?:likely|plausible|appropriate|scientifically)\s+(?:answer|option|choice|explanation)",
    r"therefore[, ].{0,80}(?:answer|option|choice)",
    r"thus[, ].{0,80}(?:answer|option|choice)",
    r"the\s+(?:correct|best)\s+(?:answer|option|choice)",
    r"i\s+(?:choose|select|pick|conclude)",
    r"my\s+(?:answer|choice|selection)\s+is",
)

#: What is no part of an agent's reasoning, and what stands in its place. Headings of further tools are a parameter.
TOOL_HEADINGS = ("Literature results for",)
SCRUBS = (
    (r'\{"status"\s*:\s*"(?:success|error)"[^}]*\}', "[tool result omitted]"),
    (r'\[\s*\{"(?:title|url|rank|snippet)"[^\]]*\]', "[search results omitted]"),
    (r"\[\s*\{['\"]id['\"]\s*:\s*['\"]chatcmpl-[^\]]*\]", "[tool call omitted]"),
    (r"\[\s*\{['\"]content['\"]\s*:\s*['\"][\s\S]*?['\"]\s*,\s*['\"]name['\"]\s*:\s*['\"][a-zA-Z0-9_]+['\"][^\]]*\]", "[tool result omitted]"),
    (r"\{\s*['\"]content['\"]\s*:\s*['\"][\s\S]*?['\"]\s*,\s*['\"]name['\"]\s*:\s*['\"][a-zA-Z0-9_]+['\"][^}]*\}", "[tool result omitted]"),
    (r'\{\s*"total_tools"\s*:\s*\d+[^}]*"tools"\s*:\s*\[[^\]]*\]\s*\}', "[tool list omitted]"),
    (r'"\w+_\w+"(?:\s*,\s*"\w+_\w+"){5,}+', "[tool names omitted]"),
    (r"\[SYSTEM NOTE\][\s\S]*?(?=\n\n|\z)", ""),
    (r"(?i)\([^)]*?(?:wrapped in answer tags|literal placeholder|optionN)[^)]*\)", ""),
    (r"(?im)^[^\n]*\b(?:wrapped in answer tags|wrap [^\n]{0,40}answer tags|do not echo this instruction|literal placeholder|optionN|emit\s+TERMINATE)[^\n]*$", ""),
    (r"(?im)^\s*(?:[-*]\s*)?option\s*\d+\s*:\s.*$", ""),
    (r"(?im)^\s*(?:[-*]\s*)?option\s*[A-F]\s*:\s.*$", ""),
    (r"(?is)<answer>.*?</answer>", ""),
    (r"(?im)^\s*terminate\s*$", ""),
    (r"\n{3,}", "\n\n"),
)

#: References to options, wordings that choose one, and words of control that a correction must not hold.
OPTION = r"(?i)\boption\s*[a-z0-9]+\b"
CHOOSING = (
    r"\b(?:correct|final)\s+answer\b",
    r"\b(?:the\s+answer|answer)\s+(?:is|would be)\s+option\s*[a-z0-9]+\b",
    r"\b(?:choose|select|pick)\s+option\s*[a-z0-9]+\b",
    r"\boption\s*[a-z0-9]+\s+(?:is|would be|looks like)\s+(?:the\s+)?(?:correct|best|right)\b",
    r"\b(?:supports|points to|favors)\s+option\s*[a-z0-9]+\b",
    r"\bthe\s+(?:most\s+scientifically\s+plausible|best|correct)\s+(?:explanation|choice|answer)\s+is\b",
    r"\bthe\s+best\s+option\s+is\b",
    r"\bthe\s+correct\s+choice\s+is\b",
    r"\bfinal\s+(?:choice|answer)\b",
)
CONTROL = (
    "re-check", "continue reasoning", "do-not-carry-forward", "required re-evaluation", "actionable instruction", "do not conclude", "do not carry forward", "looking at our options again",
    "therefore[, ]", "the correct answer is", "therefore the correct answer", "the answer is", "let me analyze", "from the search results", "i can now see that",
)
REPAIR_MARKS = (("[REASONING REPAIR]", "[END REASONING REPAIR]"), ("[CONCEPT CORRECTION]", "[END CONCEPT CORRECTION]"))

#: Phrases by which a planner's reason is an echo of an apology, and what a status says when it is bad.
ECHOES = (
    "you're absolutely right", "you are absolutely right", "you're right to question", "you are right to question", "let me re-evaluate", "let me reevaluate", "let me re evaluate",
    "let me reconsider", "i apologize", "my previous", "i was wrong", "i was incorrect", "thank you for pointing", "looking at this again", "on second thought",
)
BAD_STATUS = (
    "false", "incorrect", "wrong", "invalid", "off", "unsupported", "misaligned", "partially_supported", "partially supported", "potentially incorrect", "potentially_incorrect", "mismatched",
    "not supported", "not_supported", "off-target", "off_target",
)

#: Words for nucleic acids and proteins as the subject of a question, and for their parts.
ACID_SUBJECT = r"(?i)\b(rna|dna|aptamer|riboswitch|nucleic acid|nucleotide|oligonucleotide|mrna|trna|rrna)\b"
PROTEIN_SUBJECT = r"(?i)\b(protein|enzyme|peptide|polypeptide|antibody|receptor|kinase|transporter)\b"
PROTEIN_PART = r"(?i)\b(amino acid|amino acids|residue|residues|side chain|side chains|peptide backbone)\b"
ACID_PART = r"(?i)\b(nucleotide|nucleotides|nucleobase|nucleobases|base pair|base pairs|phosphodiester)\b"

#: Words that no search for a claim needs, and what counts as a technical term.
COMMON_WORDS = (
    "agent", "understanding", "scientific", "concept", "option", "options", "evaluation", "provided", "correct", "incorrect", "match", "matches", "fact", "facts", "study", "studies", "paper",
    "research", "result", "results", "show", "shows", "shown", "using", "based", "through", "about", "these", "those", "which", "their", "there", "mention", "mentions", "none", "only", "that",
    "this", "with", "from", "into",
)
TECHNICAL = r"(?U)\b(?:[A-Za-z]+[A-Za-z0-9-]*\d+[A-Za-z0-9-]*|[A-Z]{2,6}|[A-Za-z]+-[A-Za-z]+|\d+-\d+)\b"

#: Where Python's splitlines parts a text.
_LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def _body(x) -> Column:
    return F.coalesce(col(x), F.lit(""))


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _any(x: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(x, w))


def commitment(x, most: int = 240) -> Column:
    """The last line that commits to an answer, else the last of more than 20 characters; null where there is none or a tool printed it. A null text has none."""
    whole = r"(?imdU)^[^\n]*\b(?:" + "|".join(COMMITMENTS) + r")\b[^\n]*"

    def chosen(body: Column) -> Column:
        said = normalize_text(F.try_element_at(F.regexp_extract_all(body, F.lit(whole), F.lit(0)), F.lit(-1)))
        lines = F.filter(F.transform(F.split(body, _LINE_END), _strip), lambda s: F.length(s) > 20)
        return F.when(said != "", said).otherwise(F.try_element_at(lines, F.lit(-1)))

    return let(let(_body(x), chosen), lambda s: F.when(~is_tool_output(s), F.substring(s, 1, most)))


def scrubbed(x, most: int | None = 3000, more: tuple[str, ...] = ()) -> Column:
    """A text without tools' output, notes of the system and answers; of what is longer than ``most`` the two ends. A null text is ''.

    ``more`` are headings of tools' blocks besides ``TOOL_HEADINGS``; ``most``
    of None keeps the whole text.
    """
    out = F.replace(_body(x), F.lit("\r\n"), F.lit("\n"))
    headings = "|".join((*TOOL_HEADINGS, *more))
    out = F.regexp_replace(out, rf"(?:{headings})[^\n]*\n[\s\S]*?(?<=\n)(?=\n[A-Z]|\z)", "")
    for pattern, instead in SCRUBS:
        # as in Python, a line ends at a line feed alone and classes are Unicode's
        out = F.regexp_replace(out, "(?dU)" + pattern, instead)
    if most is None:
        return _strip(out)
    head, tail = most // 2, most - most // 2
    ends = lambda s: F.concat(F.regexp_replace(F.substring(s, 1, head), r"(?U)\s+$", ""), F.lit("\n...\n"), F.regexp_replace(F.substring(s, -tail, tail), r"(?U)^\s+", ""))
    return let(_strip(out), lambda s: F.when(F.length(s) <= most, s).otherwise(ends(s)))


def redacted(x) -> Column:
    """A text whose answers, endings and options are masked."""
    hidden = F.regexp_replace(_body(x), r"(?is)<answer>\s*.*?\s*</answer>", "[answer redacted]")
    return F.regexp_replace(F.regexp_replace(hidden, r"(?i)\bTERMINATE\b", "[terminate redacted]"), OPTION, "[option redacted]")


def chooses(x) -> Column:
    """Whether a text answers the question: a tag, an ending, or words that choose, those in marked repairs aside."""

    def judged(low: Column) -> Column:
        outside = low
        for start, end in REPAIR_MARKS:
            quoted = [m.lower().replace("[", r"\[").replace("]", r"\]") for m in (start, end)]
            outside = F.regexp_replace(outside, rf"(?s){quoted[0]}.*?(?:{quoted[1]}|\z)", "")
        return F.contains(low, F.lit("<answer>")) | F.contains(low, F.lit("terminate")) | outside.rlike("|".join(CHOOSING))

    return let(F.lower(normalize_text(x)), judged)


def is_patch(x) -> Column:
    """Whether a text is a marked repair that names its concept, an instruction, what was wrong and what is right. Fixed values throughout."""

    def judged(low: Column) -> Column:
        has = lambda *words: _any(low, words)
        marked = F.lit(False)
        for start, end in REPAIR_MARKS:
            marked |= has(start.lower()) & has(end.lower())
        wrong, right = has("original:", "original unsupported claim:", "faulty claim:"), has("corrected:", "corrected grounded guidance:", "correction:")
        return marked & has("concept:") & has("instruction:", "required re-evaluation:") & wrong & right

    return let(F.lower(_body(x)), judged)


def _free(s: Column) -> Column:
    return ~s.rlike(r"(?i)\b(?:" + "|".join(CONTROL) + r")\b") & ~chooses(s)


def corrected_claim(x) -> Column:
    """The first sentence of a correction, options masked; null unless it has 40 to 280 characters, no word of control and chooses nothing."""

    def checked(s: Column) -> Column:
        return F.when(F.length(s).between(40, 280) & _free(s), s)

    def shortened(s: Column) -> Column:
        low = F.lower(s)
        return F.when(~F.contains(low, F.lit("<answer>")) & ~F.contains(low, F.lit("terminate")), first_sentence(s))

    return let(let(redacted(normalize_text(x)), shortened), checked)


def planner_reason(x) -> Column:
    """The first two sentences of a planner's reason, at most 400 characters, options masked; null where it echoes an apology or chooses."""

    def usable(raw: Column) -> Column:
        bad = _any(F.lower(raw), ("<answer>", "terminate", "[answer redacted]", *ECHOES))
        return F.when((raw != "") & ~bad, F.array_join(F.slice(F.split(redacted(raw), r"(?<=[.!?])\s+", 3), 1, 2), " "))

    def cut(s: Column) -> Column:
        head = F.substring(s, 1, 400)
        # up to the last full stop before a space, if there is one
        short = F.trim(F.regexp_replace(head, r"(?s)^(.*)\. .*$", "$1"))
        ended = F.when(short.rlike("[.!?]$"), short).otherwise(F.concat(short, F.lit(".")))
        return F.when(F.length(s) > 400, ended).otherwise(s)

    return let(let(let(normalize_text(x), usable), cut), lambda s: F.when((s != "") & _free(s), s))


def is_bad_status(x) -> Column:
    return F.coalesce(_any(F.lower(F.trim(_body(x))), BAD_STATUS), F.lit(False))


def status_error(alignment, mapping, grounding) -> Column:
    """The kind of error that a planner's three statuses name, the first bad one; where none is, that of the mapping."""
    return F.when(is_bad_status(alignment), "alignment_error").when(is_bad_status(mapping), "mapping_error").when(is_bad_status(grounding), "fact_error").otherwise("mapping_error")


def subject_fault(question, category, source_type, source_ref, claim) -> Column:
    """Why a claim about what things are made of doesn't fit its question's subject: protein_parts, nucleic_acid_parts, or null."""
    asked, said = _body(question), F.concat_ws(" ", F.nullif(col(source_ref), F.lit("")), F.nullif(col(claim), F.lit("")))
    checked = (F.coalesce(col(category), F.lit("")) == "constraint_claim") | (F.coalesce(col(source_type), F.lit("")) == "entity_compatibility")
    acid = asked.rlike(ACID_SUBJECT)
    parts = said.rlike(PROTEIN_PART)
    return F.when(checked & acid & parts, "protein_parts").when(checked & ~acid & asked.rlike(PROTEIN_SUBJECT) & ~parts & said.rlike(ACID_PART), "nucleic_acid_parts")


def _fragment(x) -> Column:
    flat = F.regexp_replace(normalize_text(x), r"(?i)<answer>.*?</answer>", "")
    return F.btrim(normalize_text(F.regexp_replace(flat, r"(?i)\bterminate\b", "")), F.lit(" |"))


def _first_terms(start: Column, terms: Column, most: int) -> Column:
    """``start`` and then those of ``terms`` that differ from all before in any case, up to ``most``."""
    known = lambda acc, t: F.exists(acc, lambda a: F.lower(a) == F.lower(t))
    return F.aggregate(terms, start, lambda acc, t: F.when((F.size(acc) >= most) | known(acc, t), acc).otherwise(F.array_append(acc, t)))


def claim_query(*parts, most: int = 18, technical: int = 10, chars: int = 400) -> Column:
    """A search for a claim given in parts: technical terms first, then other words, each once in any case; the parts themselves where they hold neither.

    Parts that hold another or lie in one go. Null and empty parts say nothing.
    """
    none = F.array().cast("array<string>")
    held = lambda acc, p: F.exists(acc, lambda a: F.contains(a, p) | F.contains(p, a))
    kept = F.aggregate(F.array(*map(_fragment, parts)), none, lambda acc, p: F.when((p == "") | held(acc, p), acc).otherwise(F.array_append(acc, p)))

    def query(fragments: Column) -> Column:
        found = lambda pattern: F.flatten(F.transform(fragments, lambda p: F.regexp_extract_all(p, F.lit(pattern), F.lit(0))))
        words = F.filter(found(r"(?U)\b[A-Za-z][A-Za-z-]{3,}\b"), lambda w: ~F.lower(w).isin(*COMMON_WORDS))
        first = _first_terms(none, found(TECHNICAL), technical)
        terms = F.array_join(let(first, lambda f: _first_terms(f, words, most)), " ")
        return F.when(terms != "", terms).otherwise(F.array_join(fragments, " "))

    # beyond the limit up to the last space within it
    cut = lambda s: F.trim(F.regexp_replace(F.substring(s, 1, chars), r"^(.*) [^ ]*$", "$1"))
    return let(let(kept, query), lambda s: F.when(F.length(s) <= chars, s).otherwise(cut(s)))
