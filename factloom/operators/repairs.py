"""Repairs of sessions: which turn to rewrite, which actions may run, what a planner's choice becomes, and claims read from models' records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import statements as S
from factloom.functions import text as T
from factloom.plans.ranks import latest_before

#: Kinds of messages that can be rewritten, and those that hold reasoning.
EDITABLE = ("ThoughtEvent", "TextMessage", "ToolCallRequestEvent", "ToolCallExecutionEvent")
REASONING = ("ThoughtEvent", "TextMessage")


def is_editable(source, kind, nested_kind=None) -> Column:
    """Whether a message is an agent's that may be rewritten; nulls count as empty."""
    s = F.coalesce(T.col(source), F.lit(""))
    known = T.col(kind).isin(*EDITABLE)
    if nested_kind is not None:
        known |= T.col(nested_kind) == "GroupChatAgentResponse"
    return (s != "") & (s != "user") & ~F.contains(s, F.lit("GroupChatManager")) & ~s.endswith("Termination") & F.coalesce(known, F.lit(False))


def is_reasoning(source, kind, content) -> Column:
    """Whether a message is reasoning that answers nothing yet; nulls count as empty."""
    body = F.coalesce(T.col(content), F.lit(""))
    told = F.lower(body).rlike("<answer>|terminate")
    return (F.coalesce(T.col(source), F.lit("")) != "user") & F.coalesce(T.col(kind).isin(*REASONING), F.lit(False)) & body.rlike(r"(?U)\S") & ~told


def reasoning_turns(messages: DataFrame, session: str = "session", order: str = "ts", source: str = "source", kind: str = "kind", content: str = "text") -> DataFrame:
    """``messages`` with ``repair_at``: where a repair of each is best put.

    That is the message itself if it is reasoning, else the latest earlier
    reasoning of its source, else that of any source, else itself. ``order``
    holds whole numbers. Sessions of any length are dealt into stretches.
    A null ``order`` stays null; a null source counts as none.
    """
    marked = messages.withColumn("_ok", is_reasoning(source, kind, content)).withColumn("_from", F.coalesce(source, F.lit("")))
    found = latest_before(marked, [session], order, F.col("_ok"), {"_same": ["_from"], "_any": []})
    earlier = F.coalesce(F.when(F.col("_from") != "", F.col("_same")), F.col("_any"), F.col(order))
    return found.withColumn("repair_at", F.when(F.col("_ok"), F.col(order)).otherwise(earlier)).drop("_ok", "_from", "_same", "_any")


def gated(actions: DataFrame, concepts: DataFrame, strict: bool = True, fallback: bool = False) -> DataFrame:
    """``actions`` with ``error``: the first rule that each breaks, null where it may run.

    ``actions``: session, action, replacement_text, body, claim_id,
    target_turn, ts, and for ``fallback`` anchor_not_found. ``concepts``, those
    that can be repaired: session, claim_id, corrected. ``strict`` asks for a
    concept in the session, and for a claim or a marked repair. Concepts are
    counted by session and claim before they are joined.
    """
    by_claim = concepts.groupBy(F.col("session").alias("_s"), F.col("claim_id").alias("_c")).agg(F.count(F.lit(1)).alias("_n"), F.trim(F.first("corrected", True)).alias("_fix"))
    any_of = by_claim.select("_s").distinct().withColumnRenamed("_s", "_s2").withColumn("_has", F.lit(True))
    rows = actions.join(by_claim, (F.col("session") == F.col("_s")) & (F.col("claim_id") == F.col("_c")), "left").join(any_of, F.col("session") == F.col("_s2"), "left")
    name = F.trim(F.coalesce("action", F.lit("")))
    text = F.coalesce("replacement_text", "body", F.lit(""))
    fix = F.coalesce("_fix", F.lit(""))
    by_id = F.col("claim_id").isNotNull()
    why = F.when(F.lit(False), "")
    if fallback:
        why = why.when(name != "edit_and_revert", "not_edit_and_revert").when(~by_id, "no_claim").when(F.coalesce("anchor_not_found", F.lit(False)), "no_anchor")
    if strict:
        why = why.when(F.col("_has").isNull(), "no_concepts")
    why = why.when(name != "edit_and_revert", "not_edit_and_revert").when(~text.rlike(r"(?U)\S"), "no_text")
    why = why.when(by_id & (F.coalesce("_n", F.lit(0)) != 1), "claim_not_one").when(by_id & (fix == ""), "no_correction").when(by_id & ~F.contains(text, fix), "correction_not_in_text")
    why = why.when(by_id & S.chooses(fix), "correction_chooses").when(by_id & fix.rlike(S.OPTION), "correction_names_option")
    payload = S.chooses("replacement_text") | S.chooses("body")
    why = why.when(~by_id & payload, "text_chooses").when(~by_id & text.rlike(S.OPTION), "text_names_option")
    if strict:
        why = why.when(~by_id & ~S.is_patch(text), "not_a_patch")
    why = why.when(F.col("target_turn").isNull() & F.col("ts").isNull(), "no_place")
    if fallback:
        low = F.lower(text)
        why = why.when(F.contains(low, F.lit("your_selected_option")), "placeholder").when(F.contains(low, F.lit("[system note]")), "system_note")
    return rows.withColumn("error", why).drop("_s", "_c", "_n", "_fix", "_s2", "_has")


def planner_concepts(plans: DataFrame, flagged: DataFrame, claims: DataFrame) -> DataFrame:
    """What a planner's choice to repair becomes where no claim of its session was flagged.

    ``plans``: session, decision, claim_id, correct, incorrect, concept, reason,
    alignment, mapping, grounding, target_turn. ``flagged``: session.
    ``claims``: session, claim_id, text, source_ref, turn; of claims with one id
    the last by turn holds. Plans without a usable correction give no row.
    """
    last = claims.groupBy(F.col("session").alias("_s"), F.col("claim_id").alias("_c")).agg(F.max_by(F.struct("text", "source_ref", "turn"), "turn").alias("_claim"))
    open_ = plans.filter(F.lower(F.trim("decision")) == "repair").join(flagged.select("session").distinct(), "session", "left_anti")
    rows = open_.join(last, (F.col("session") == F.col("_s")) & (F.col("claim_id") == F.col("_c")), "left")
    said = lambda *names: F.coalesce(*(F.nullif(F.trim(n), F.lit("")) for n in names))
    fixed = F.coalesce(S.corrected_claim("correct"), S.planner_reason("correct"), S.planner_reason("reason"))
    name = S.redacted(F.coalesce(said("concept", "_claim.source_ref"), F.lit("the agent's selected reasoning step")))
    return rows.select(
        "session", "claim_id", F.coalesce("_claim.turn", "target_turn").alias("turn"), name.alias("concept"), F.coalesce(said("incorrect", "_claim.text"), F.lit("")).alias("incorrect"),
        fixed.alias("corrected"), S.status_error("alignment", "mapping", "grounding").alias("error_type"),
    ).filter(F.col("corrected").isNotNull())


#: For each kind of record its category (null: the type), the fields of text, reference (the first that says something) and type, and what must be known.
KINDS = {
    "research": ("research_claim", "claimed_content", ("full_citation", "claimed_title", "claimed_url"), "inferred_source_type", ("claimed_content",)),
    "medical": ("medical_claim", "claimed_content", ("authority",), None, ("claimed_content", "authority")),
    "legal": ("legal_claim", "content", ("reference_name",), "type", ("content", "reference_name")),
    "code": (None, "code_snippet", ("package_name",), "language", ("package_name", "code_snippet")),
    "concept": (None, "concept_understanding", ("scientific_concept",), None, ("scientific_concept", "concept_understanding")),
}
ELEMENTS = ("import", "install", "function_call")
CONCEPT_KINDS = {"answer grounding:": ("mapping_claim", "answer_grounding"), "entity compatibility:": ("constraint_claim", "entity_compatibility"), "answer alignment:": ("answer_alignment_claim", "answer_alignment")}


def claims_of(records: DataFrame, raw: str = "raw", kind: str = "kind", dumps: tuple[str, ...] = ("literature results for",)) -> DataFrame:
    """``records`` that are claims, with category, claim, source_ref, source_type and statement, by their ``kind`` of ``KINDS``.

    ``raw`` holds a JSON object; others, unknown kinds and records without what
    their kind needs give no row. ``dumps``: signs that a concept is a tool's output.
    """
    field = lambda name: F.trim(F.coalesce(F.get_json_object(raw, f"$.{name}"), F.lit("")))
    known = lambda name: ~field(name).isin("", "Unknown")
    value = lambda name: field(name) != ""
    concept = F.lower(field("scientific_concept"))
    opens, lists = r"^\[?\{['\"]content['\"]", r"^\[\{['\"]"
    dumped = concept.rlike(opens) | S._any(concept, dumps) | S._any(F.lower(field("concept_understanding")), dumps) | field("concept_understanding").rlike(lists)
    category, source_type = F.lit("scientific_concept"), F.lit("scientific_concept")
    for start, (c, s) in CONCEPT_KINDS.items():
        category, source_type = F.when(concept.startswith(start), c).otherwise(category), F.when(concept.startswith(start), s).otherwise(source_type)

    def claim(name: str, spec) -> Column:
        cat, text, refs, typed, needed = spec
        ok = F.lit(True)
        for i, n in enumerate(needed):
            # of code and of what is understood only the presence counts
            ok &= value(n) if name == "code" or (name == "concept" and i) else known(n)
        if name == "code":
            ok &= field("element_type").isin(*ELEMENTS)
        if name == "concept":
            ok &= ~dumped
        kinds = {"medical": (F.lit(cat), F.lit("guideline")), "code": (field("element_type"), field("language")), "concept": (category, source_type)}
        c, s = kinds.get(name) or (F.lit(cat), field(typed))
        ref = F.coalesce(*(F.nullif(field(r), F.lit("")) for r in refs), F.lit(""))
        statement = field("context_snippet") if name == "concept" else field("original_statement")
        return F.when(ok, F.struct(c.alias("category"), field(text).alias("claim"), ref.alias("source_ref"), s.alias("source_type"), statement.alias("statement")))

    made = F.when(F.lit(False), claim("legal", KINDS["legal"]))
    for name, spec in KINDS.items():
        made = made.when(F.col(kind) == name, claim(name, spec))
    rest = [c for c in records.columns if c not in (raw, kind)]
    return records.withColumn("_claim", made).filter("_claim IS NOT NULL").select(*rest, "_claim.*")


def factual_claims(records: DataFrame, raw: str = "raw") -> DataFrame:
    """Each factual claim of a JSON list (claim_type factual or missing) with its concept and the concept's plain form; incomplete ones go."""
    kind = "array<struct<claim_type: string, concept: string, claim: string>>"
    rest = [c for c in records.columns if c != raw]
    rows = records.select(*rest, F.inline(F.from_json(raw, kind)))
    is_fact = F.lower(F.trim(F.coalesce(F.nullif(F.col("claim_type"), F.lit("")), F.lit("factual")))).isin("factual", "")
    out = rows.select(*rest, F.trim("concept").alias("concept"), F.trim("claim").alias("claim"), is_fact.alias("_ok")).filter("_ok AND concept <> '' AND claim <> ''").drop("_ok")
    return out.withColumn("canonical", T.normalize_keyword("concept"))
