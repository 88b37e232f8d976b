"""Vocabularies as rule tables, turned into Column expressions.

A vocabulary is a parameter: lists and maps that a caller reads from its own
tables. Chains stay below a few hundred branches; longer maps belong in a join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


@dataclass(frozen=True)
class Rule:
    """One way to tell an entity's type: kind is exact, starts, ends, holds, matches (from the start) or finds (anywhere)."""

    kind: str
    what: str
    type: str

    def test(self, name: Column, low: Column) -> Column:
        tests = {
            "exact": lambda: low == self.what, "starts": lambda: low.startswith(self.what), "ends": lambda: low.endswith(self.what),
            "holds": lambda: F.contains(low, F.lit(self.what)), "matches": lambda: name.rlike(f"^(?:{self.what})"), "finds": lambda: name.rlike(self.what),
        }
        return tests[self.kind]()


@dataclass(frozen=True)
class Vocabulary:
    types: tuple[Rule, ...] = ()
    type_names: dict[str, str] = field(default_factory=dict)
    relations: dict[str, str] = field(default_factory=dict)
    allowed: tuple[str, ...] = ()
    aliases: dict[str, str] = field(default_factory=dict)
    association_hints: tuple[str, ...] = ()
    improvement_hints: tuple[str, ...] = ()


def looked_up(table: dict[str, str], key: Column) -> Column:
    """Null where ``table`` lacks the key."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key) if table else F.lit(None).cast("string")


def entity_type(v: Vocabulary, raw_type, name) -> Column:
    """The first rule's type, else what the raw type maps to, else the raw type, else Entity."""
    cleaned = T.clean_entity(name)
    low = T.normalize_keyword(cleaned)
    raw = T.normalize_text(raw_type)
    chain = F.when(F.lit(False), F.lit(""))
    for rule in v.types:
        chain = chain.when(rule.test(cleaned, low), rule.type)
    return F.coalesce(chain, looked_up(v.type_names, T.snake_case(raw)), F.nullif(raw, F.lit("")), F.lit("Entity"))


#: Verbs whose part_of only says that things meet, or that one serves the other.
_MEETING = ("recruits", "binding", "binds", "bound_to", "through_the", "through", "forms", "interaction_with", "interaction_between", "association_between")
_SERVING = ("dna_binding", "mediated")
_DOWN, _UP = ("silences", "suppresses", "downregulates", "inhibits"), ("upregulates", "induces", "activates")


def relation(v: Vocabulary, normalized, surface, tail, tail_type, evidence) -> Column:
    """The canonical relation: the first of surface and normalized form that the vocabulary allows, refined by what it points to; '' without one."""
    said, norm, told = T.snake_case(surface), T.snake_case(normalized), T.normalize_keyword(evidence)
    hinted = lambda hints: F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(told, h)) if hints else F.lit(False)
    to_pathway = (T.col(tail_type) == "Pathway") | F.contains(T.normalize_keyword(tail), F.lit("pathway"))

    def refined(key: Column) -> Column:
        r = F.coalesce(looked_up(v.relations, key), key)
        by_verb = F.when(said.isin(*_DOWN), "downregulates").when(said.isin(*_UP), "upregulates").otherwise(r)
        return (
            F.when(r == "activated_by", "activates").when(r == "inhibited_by", "inhibits").when(r == "regulates_expression_of", by_verb)
            .when(r.isin("involved_in", "promotes") & to_pathway, "involved_in_pathway")
            .when((r == "associated_with") & (T.col(tail_type) == "ClinicalEndpoint") & hinted(v.improvement_hints), "improves")
            .when(r.isin(*v.allowed) if v.allowed else r != "", r)
        )

    part = norm == "part_of"
    return F.when(part & said.isin(*_MEETING), "associated_with").when(part & said.isin(*_SERVING), "involved_in").otherwise(
        F.coalesce(refined(said), refined(norm), F.when(hinted(v.association_hints), F.lit("associated_with")), F.lit(""))
    )


def abbreviations(evidence) -> Column:
    """A map from short form, in lower case, to long form, of every "Long form (LF)" whose initials fit."""
    pattern = r"([A-Za-z][A-Za-z0-9][A-Za-z0-9 /,\-]{3,120}?)\s*\(([A-Z][A-Z0-9\-]{1,15})\)"
    body = F.coalesce(T.col(evidence), F.lit(""))
    pairs = F.arrays_zip(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)).alias("long"), F.regexp_extract_all(body, F.lit(pattern), F.lit(2)).alias("short"))

    def fits(p: Column) -> Column:
        initials = F.upper(F.array_join(F.regexp_extract_all(p["long"], F.lit(r"\b([A-Za-z])"), F.lit(1)), ""))
        return F.contains(initials, F.regexp_replace(p["short"], "[^A-Z0-9]", ""))

    entries = F.transform(F.filter(pairs, fits), lambda p: F.struct(T.normalize_keyword(T.clean_entity(p["short"])).alias("k"), T.clean_entity(p["long"]).alias("v")))
    # of a short form's long forms the last holds
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    last = lambda k: F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def entity_name(v: Vocabulary, name, evidence) -> Column:
    """The long form that the evidence gives, else the vocabulary's alias, else the cleaned name."""
    cleaned = T.clean_entity(name)
    key = T.normalize_keyword(cleaned)
    return F.coalesce(F.try_element_at(abbreviations(evidence), key), looked_up(v.aliases, key), cleaned)


def keyword_variants(term, synonyms: dict[str, list[str]], replacements: dict[str, list[str]], suffixes: tuple[str, ...]) -> Column:
    """Array of structs (variant, how): synonyms, replaced words, suffixes and an acronym of three letters or more."""
    body, low = T.normalize_text(term), T.normalize_keyword(term)
    row = lambda variant, how: F.struct(variant.alias("variant"), F.lit(how).alias("how"))
    found = [F.when(low == k, row(F.lit(s), "synonym")) for k, names in synonyms.items() for s in names]
    found += [F.when(F.contains(low, F.lit(k)), row(F.regexp_replace(body, f"(?i){k}", r), "replacement")) for k, names in replacements.items() for r in names]
    short = (F.size(F.split(low, " ")) <= 4) & (low != "")
    found += [F.when(short, row(F.concat(body, F.lit(f" {s}")), "suffix")) for s in suffixes]
    acronym = F.upper(F.array_join(F.transform(F.regexp_extract_all(body, F.lit("([A-Za-z]+)")), lambda w: F.substring(w, 1, 1)), ""))
    found.append(F.when((F.length(acronym) >= 3) & (acronym != body), row(acronym, "acronym")))
    return F.array_compact(F.array(*found))
