"""Claims: what they are about, whether evidence fits, and their wording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Words that say nothing about a claim's topic.
GENERIC_WORDS = (
    "agent", "understanding", "scientific", "concept", "provided", "correct", "incorrect", "study", "studies", "paper", "research", "result", "results", "using", "based", "through", "about",
    "these", "those", "which", "their", "there", "mention", "mentions", "question", "specific", "available", "tools", "tool", "directly", "address", "related", "comparison", "comparing",
    "and", "for", "the", "with", "from", "into", "that", "this", "than",
)


def relevance_terms(x, most: int = 16) -> Column:
    """Distinct words of three characters or with a digit that aren't generic, in order."""
    found = F.transform(F.regexp_extract_all(F.lower(F.coalesce(T.col(x), F.lit(""))), F.lit("([a-z0-9+.-]+)")), lambda w: F.btrim(w, F.lit(" .,+-")))
    kept = F.filter(found, lambda w: (w != "") & ~w.isin(*GENERIC_WORDS) & ((F.length(w) >= 3) | w.rlike("[0-9]")))
    return F.slice(F.array_distinct(kept), 1, most)


def is_relevant(claim, evidence, matches: int = 2, share: float = 0.35) -> Column:
    """Whether evidence holds ``matches`` of a claim's terms or ``share`` of them; empty evidence never is."""
    terms, body = relevance_terms(claim), F.lower(F.coalesce(T.col(evidence), F.lit("")))
    n = F.size(F.filter(terms, lambda t: F.contains(body, t)))
    return (F.trim(body) != "") & ((F.size(terms) == 0) | (n >= matches) | (n >= F.size(terms) * share))


def mentions(x, concept) -> Column:
    """Whether a text holds every word of a concept as a whole word."""
    low = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(T.col(x), F.lit(""))), r"[^\p{L}\p{N}_]+", " "), F.lit(" "))
    words = F.filter(F.split(T.normalize_keyword(concept), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    return (F.size(words) > 0) & F.forall(words, lambda w: F.contains(low, F.concat(F.lit(" "), w, F.lit(" "))))


def is_supported(evidence, chunk, share: float = 0.8) -> Column:
    """Whether a chunk holds the evidence as it is, or ``share`` of its words; a missing chunk doesn't."""

    def judged(e: Column, c: Column) -> Column:
        shared = lambda words: (F.size(words) > 0) & (F.size(F.array_intersect(words, T.token_set(c))) >= F.size(words) * share)
        return (e != "") & (c != "") & (F.contains(c, e) | T.let(T.token_set(e), shared))

    return T.let(T.entity_key(evidence), lambda e: T.let(T.entity_key(chunk), lambda c: judged(e, c)))


def leaks(question, answer) -> Column:
    asked = F.regexp_replace(T.entity_key(question), r"^according to [^,:]*[,:]\s*", "")
    return T.let(T.entity_key(answer), lambda a: (a != "") & F.contains(asked, a))


def failed(**rules: Column) -> Column:
    """The names of rules that don't hold, in order; null counts as not holding."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))


def options_valid(options: Column, answer) -> Column:
    """Just one correct option, whose text is the answer, and no two alike. ``options``: structs of text and is_correct."""
    right = F.filter(options, lambda o: o["is_correct"])
    keys = F.transform(options, lambda o: T.entity_key(o["text"]))
    return (F.size(right) == 1) & (T.entity_key(F.get(right, F.lit(0))["text"]) == T.entity_key(answer)) & (F.size(F.array_distinct(keys)) == F.size(keys))


def claim_text(head, relation, tail, strength) -> Column:
    """A fact as a sentence, as firm as its evidence. The wording."""
    r = F.regexp_replace(T.normalize_text(relation), "_", " ")
    h, t = T.col(head), T.col(tail)

    def said(s: Column) -> Column:
        first = F.when(s == "strong", "The available evidence supports that").otherwise("The evidence supports a contextual relationship in which")
        vague = F.concat_ws(" ", F.lit("The evidence suggests a reported association involving"), h, F.lit("and"), t)
        return F.when(s == "weak", vague).otherwise(F.concat_ws(" ", first, h, r, t))

    return F.concat(T.let(T.col(strength), said), F.lit("."))


#: What pages of publishers hold around an article, and what articles hold.
_BOILERPLATE = (
    r"(?i)(html\{|body\{|font-family|@media|display:|window\.|document\.|datalayer|gtm|log in|\bmenu\b|find a journal|publish with us|submit manuscript|"
    r"search by keyword or author|your privacy choices|accessibility statement|terms and conditions|privacy policy|advertisement|copy shareable link|saved research|\bcart\b|springer nature)"
)
_SECTION_WORDS = ("abstract", "introduction", "methods?", "results?", "discussion", "conclusion", "references", "author information", "ethics declarations")
_SECTIONS = rf"(?i)\b({'|'.join(_SECTION_WORDS)})\b"
#: A page is parted at these; a conclusion is no part of its own.
_PARTING = f"(?i)({'|'.join(w for w in _SECTION_WORDS if w != 'conclusion')})"


def is_article(x, title, min_chars: int = 1200) -> Column:
    """Whether a page's text is that of an article: long, little boilerplate, sentences, and words of its title."""

    def judged(body: Column, low: Column, sentences: Column) -> Column:
        code = sum((F.regexp_count(low, F.lit(p)) for p in (r"window\.", r"document\.", "font-family", "@media")), F.lit(0))
        words = F.filter(F.split(T.normalize_keyword(title), " "), lambda w: F.length(w) > 3)
        titled = (F.size(words) == 0) | F.exists(words, lambda w: F.contains(low, w))
        sectioned = body.rlike(_SECTIONS) | (sentences >= 3)
        return (F.length(body) >= max(min_chars, 200)) & (F.regexp_count(body, F.lit(_BOILERPLATE)) < 8) & (code < 2) & (sentences >= 2) & titled & sectioned

    sentences = lambda body: F.regexp_count(body, F.lit(r"[A-Z][^.?!]{40,}[.?!]"))
    return T.let(T.normalize_text(x), lambda body: T.let(F.lower(body), lambda low: T.let(sentences(body), lambda n: judged(body, low, n))))


def landing_text(x) -> Column:
    """A page's pieces between section words, without boilerplate, short ones and repeats."""
    return landing_pieces(T.html_text(x))


def landing_pieces(text) -> Column:
    """The same of a page's text without its markup."""

    def pieces(body: Column) -> Column:
        marked = F.regexp_replace(F.regexp_replace(body, r" \| ", "\n"), _PARTING, "\n$1\n")
        return F.filter(F.transform(F.split(marked, r"[\n\r]+"), lambda p: F.trim(p)), lambda p: (p != "") & ~p.rlike(_BOILERPLATE) & ((F.length(p) >= 40) | p.rlike(_SECTIONS)))

    def distinct(found: Column) -> Column:
        keys = F.transform(found, lambda p: F.lower(p))
        return T.let(keys, lambda k: F.filter(found, lambda p, i: F.array_position(k, F.lower(p)) == i + 1))

    return F.array_join(T.let(T.let(T.col(text), pieces), distinct), "\n")


def is_control_free(x) -> Column:
    """A corrected claim that can be shown: 40 to 280 characters, no direct answer in it."""
    body = T.normalize_text(x)
    return F.length(body).between(40, 280) & ~body.rlike(r"(?i)\b(the (correct )?answer is|option \d|choose option)\b")
