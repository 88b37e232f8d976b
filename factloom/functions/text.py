"""Text functions as Column builders. Null, missing and empty text are the same everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, for patterns.
WS = r"(?U)\s+"
#: Text that is normal as it stands: printable ASCII with one space between words. One look, where replacing takes two slow ones.
PLAIN = r"\A(?:[!-~]++(?: [!-~]++)*+)?\z"
#: White space as SQL's patterns have it, and the spaces that its trim takes off.
SQL_WS, SQL_SPACES = r"[\t\n\f\r ]+", " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once: a lambda's variable can't be copied into every place that mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_text(x) -> Column:
    """NULs to spaces, runs of white space to one space, ends stripped; null gives ''."""
    given = F.coalesce(col(x).cast("string"), F.lit(""))
    normal = F.trim(F.regexp_replace(F.regexp_replace(given, "\\x00", " "), WS, " "))
    # an expression isn't repeated, as plans would grow with every call within another
    return F.when(given.rlike(PLAIN), given).otherwise(normal) if isinstance(x, str) else normal


def normalize_keyword(x) -> Column:
    low = F.lower(F.coalesce(col(x), F.lit("")))
    normal = F.trim(F.regexp_replace(low, WS, " "))
    return F.when(low.rlike(PLAIN), low).otherwise(normal) if isinstance(x, str) else normal


def sql_spaced(x) -> Column:
    """Runs of white space to one space, ends stripped, as SQL has them; null stays null."""
    return F.when(col(x).rlike(PLAIN), col(x)).otherwise(F.btrim(F.regexp_replace(col(x), SQL_WS, " "), F.lit(SQL_SPACES)))


def sql_lower(x) -> Column:
    """Lower case of each letter by itself, as SQL has it: no sigma depends on its place, no capital I leaves its dot."""
    return F.lower(F.replace(F.replace(col(x), F.lit("Σ"), F.lit("σ")), F.lit("İ"), F.lit("i")))


def entity_key(x) -> Column:
    """Case-folded normalized text; of the letters whose case folding isn't their lower case, sharp s is covered."""
    return F.replace(F.lower(normalize_text(x)), F.lit("ß"), F.lit("ss"))


def relation_key(x) -> Column:
    return F.lower(F.replace(normalize_text(x), F.lit(" "), F.lit("_")))


def snake_case(x) -> Column:
    parted = F.translate(normalize_text(x), "-/", "_ ")
    kept = F.regexp_replace(parted, "[^A-Za-z0-9_ ]+", " ")
    return F.lower(F.regexp_replace(F.regexp_replace(kept, r"\s+", "_"), "^_+|_+$", ""))


def clean_entity(x) -> Column:
    """Outer punctuation off, typographic quotes plain, hyphens tight, an unclosed parenthesis cut."""
    bare = F.btrim(normalize_text(x), F.lit(" \t\n\r\"'`.,;:()[]{}"))
    plain = F.translate(bare, "“”’", "\"\"'")
    tight = F.regexp_replace(F.regexp_replace(plain, r"\s*-\s*", "-"), r"\s+", " ")
    return F.trim(F.regexp_replace(tight, r"\([^)]*$", ""))


def strip_markup(x) -> Column:
    return normalize_text(F.regexp_replace(F.coalesce(col(x), F.lit("")), "<[^>]+>", " "))


def html_text(x) -> Column:
    bare = F.regexp_replace(F.coalesce(col(x), F.lit("")), r"(?is)<script.*?</script>", " ")
    return strip_markup(F.regexp_replace(bare, r"(?is)<style.*?</style>", " "))


def token_set(x) -> Column:
    """Distinct ASCII letter and digit runs, in lower case, in order of their first place."""
    found = F.regexp_extract_all(F.coalesce(col(x), F.lit("")), F.lit("([A-Za-z0-9]+)"))
    return F.array_distinct(F.transform(found, F.lower))


def keyword_similarity(keyword, text) -> Column:
    """1 where the text holds the keyword, else the share of its tokens that the text has."""
    key, body = normalize_keyword(keyword), normalize_keyword(text)
    tokens = token_set(keyword)
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(tokens, token_set(text))), F.size(tokens)), F.lit(0.0))
    return F.when((key == "") | (body == ""), F.lit(0.0)).when(F.contains(body, key), F.lit(1.0)).otherwise(share)


def held(keyword, text) -> Column:
    """1 where the text holds the keyword as it stands, in any case, else 0; every text holds an empty one, and null neither holds nor is held."""
    return F.when(F.contains(sql_lower(text), sql_lower(keyword)), F.lit(1.0)).otherwise(F.lit(0.0))


def title_overlap(a, b) -> Column:
    tokens = token_set(a)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(tokens, token_set(b))), F.size(tokens)), F.lit(0.0))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """0 for empty vectors, those of unequal length and those of length zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = (F.size(col(a)) > 0) & (F.size(col(a)) == F.size(col(b)))
    return F.coalesce(F.when(usable, F.try_divide(dot(a, b), norms)), F.lit(0.0))


#: Words that mark a statement as hedged.
HEDGES = ("suggest", "suggested", "may", "might", "potential", "possibly", "associated", "association", "correlat", "linked")

#: Relations that state a mechanism, and those that state an association alone.
STRONG_RELATIONS = ("activates", "inhibits", "upregulates", "downregulates", "overexpressed_in", "upregulated_in", "downregulated_in", "improves", "promotes")
WEAK_RELATIONS = ("associated_with", "part_of")


def hedge_score(x) -> Column:
    """How many hedges the text holds, three or more counting 1."""
    body = F.lower(normalize_text(x))
    hits = F.size(F.filter(F.array(*map(F.lit, HEDGES)), lambda h: F.contains(body, h)))
    return F.least(hits / 3.0, F.lit(1.0))


def relation_strength(relation, declared: dict[str, str] | None = None) -> Column:
    """strong, medium or weak; what a vocabulary declares wins."""

    def graded(key: Column) -> Column:
        usual = F.when(key.isin(*STRONG_RELATIONS), "strong").when(key.isin(*WEAK_RELATIONS), "weak").otherwise("medium")
        if not declared:
            return usual
        by_name = F.create_map(*(F.lit(v) for kv in declared.items() for v in kv))
        return F.coalesce(F.try_element_at(by_name, key), usual)

    return let(relation_key(relation), graded)


def evidence_strength(relation_strengths: Column, supports: Column, hedge: Column) -> Column:
    """strong: all hops strong, two sources each, hardly hedged. weak: a weak hop, much hedged, or a hop without source."""
    least = F.coalesce(F.array_min(supports), F.lit(0))

    def graded(strengths: Column) -> Column:
        all_strong = (F.size(strengths) > 0) & F.forall(strengths, lambda s: s == "strong")
        any_weak = F.array_contains(strengths, "weak")
        return F.when(all_strong & (least >= 2) & (hedge < 0.34), "strong").when(any_weak | (hedge >= 0.67) | (least == 0), "weak").otherwise("medium")

    return let(relation_strengths, graded)


def doi_norm(x) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(col(x), F.lit("")))), r"^(doi:|https?://doi\.org/|http://dx\.doi\.org/)", "")
    return F.when(F.trim(bare).isin("n/a", "na", "none", "null", "unknown"), "").otherwise(F.trim(bare))


def host(url) -> Column:
    """What stands between the scheme and the path, in lower case."""
    return F.regexp_extract(F.lower(F.trim(F.coalesce(col(url), F.lit("")))), r"^(?:.*?://)?([^/]*)", 1)


#: Query parameters that track the reader.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "_ga", "_gid", "_hsenc", "_hsmi", "ref", "referrer", "source")


def url_clean(url) -> Column:
    """Without fragment and tracking parameters."""
    bare = F.regexp_replace(F.trim(F.coalesce(col(url), F.lit(""))), "#.*$", "")
    kept = F.regexp_replace(bare, rf"(?i)([?&])(?:{'|'.join(TRACKING)})=[^&]*", "$1")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, "&{2,}", "&"), r"\?&+", "?"), "[?&]+$", "")


def iso_date(x) -> Column:
    """2024/3/5, 2024-03-05 or 2024 as yyyy-MM-dd, yyyy-MM or yyyy; '' for anything else."""
    part = lambda i: F.regexp_extract(F.trim(F.coalesce(col(x), F.lit(""))), r"^(\d{4})(?:[-/](\d{1,2}))?(?:[-/](\d{1,2}))?$", i)
    two = lambda i: F.when(part(i) != "", F.lpad(part(i), 2, "0"))
    return F.concat_ws("-", F.nullif(part(1), F.lit("")), two(2), two(3))


def split_authors(x) -> Column:
    body = F.coalesce(col(x), F.lit(""))
    names = F.when(F.contains(body, F.lit(";")), F.split(body, ";")).otherwise(F.split(body, ","))
    return F.array_distinct(F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n != ""))


def title_key(normal: Column) -> Column:
    """A normal title's name in a cache; an empty one has one too."""
    return F.concat(F.lit("title::"), F.sha2(normal, 256))


def cache_key(doi, pmcid, pmid, title) -> Column:
    """The first of four ids that isn't empty, under its name; titles as digests. Null where all are empty."""
    named = [F.when(normalize_keyword(x) != "", F.concat(F.lit(f"{name}::"), normalize_keyword(x))) for name, x in (("doi", doi), ("pmcid", pmcid), ("pmid", pmid))]
    return F.coalesce(*named, F.when(normalize_keyword(title) != "", title_key(normalize_keyword(title))))


def cache_slug(key, length: int = 16) -> Column:
    return F.substring(F.sha2(F.coalesce(col(key), F.lit("")), 256), 1, max(int(length), 8))


def truncate(x, limit: int) -> Column:
    body = normalize_text(x)
    return F.when(F.length(body) <= limit, body).otherwise(F.concat(F.rtrim(F.substring(body, 1, limit - 3)), F.lit("...")))


def token_estimate(x) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(col(x), F.lit(""))) / 4)).cast("long")


def safe_name(x) -> Column:
    return F.regexp_replace(F.coalesce(col(x), F.lit("")), "[^A-Za-z0-9._-]+", "_")


def confidence_number(x) -> Column:
    """A number as it is; high, medium and low and their synonyms as 0.9, 0.7 and 0.4; 0 for anything else."""
    word = F.lower(F.trim(F.coalesce(col(x).cast("string"), F.lit(""))))
    return F.coalesce(word.try_cast("double"), F.when(word.isin("high", "strong"), 0.9).when(word.isin("medium", "moderate"), 0.7).when(word.isin("low", "weak"), 0.4), F.lit(0.0))


def markdown(title, abstract, body) -> Column:
    parts = F.array(
        F.concat(F.lit("# "), F.coalesce(F.nullif(normalize_text(title), F.lit("")), F.lit("Untitled"))),
        F.when(normalize_text(abstract) != "", F.concat(F.lit("## Abstract\n\n"), normalize_text(abstract))),
        F.when(normalize_text(body) != "", F.concat(F.lit("## Body\n\n"), normalize_text(body))),
    )
    return F.concat(F.concat_ws("\n\n", parts), F.lit("\n"))


def looks_like_sentence(x, max_words: int = 8, max_words_joined: int = 5) -> Column:
    """A phrase too long for an entity's name, or two names joined by and/or."""
    n = F.size(F.split(F.trim(F.coalesce(col(x), F.lit(""))), r"\s+"))

    def judged(low: Column) -> Column:
        padded = F.concat(F.lit(" "), low, F.lit(" "))
        joined = F.contains(padded, F.lit(" and ")) | F.contains(padded, F.lit(" or "))
        return low.rlike("^(interaction between|binding of|association between) ") | (n > max_words) | (joined & (n > max_words_joined))

    return let(normalize_keyword(x), judged)


def word_windows(text, words: int = 250, overlap: int = 40) -> Column:
    """An array of structs (k, start, end, text): windows of words, each sharing ``overlap`` with the one before."""
    size = max(int(words), 50)
    step = size - min(max(int(overlap), 0), size - 1)

    def windows(tokens: Column) -> Column:
        n = F.size(tokens)
        count = F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / F.lit(step)) + 1).cast("int")

        def window(k: Column) -> Column:
            start, end = k * step, F.least(k * step + size, n)
            return F.struct(k.alias("k"), start.alias("start"), end.alias("end"), F.array_join(F.slice(tokens, start + 1, size), " ").alias("text"))

        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), window)).otherwise(F.array().cast("array<struct<k:int,start:int,end:int,text:string>>"))

    tokens = F.array_remove(F.split(F.coalesce(col(text), F.lit("")), WS), "")
    return F.get(F.transform(F.array(tokens), windows), F.lit(0))
