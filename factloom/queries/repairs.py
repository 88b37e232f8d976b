"""What agents commit to, what of their texts is analysed, which repairs may run and how claims are searched."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import statements as S
from factloom.operators import repairs

from .base import query, table

_SPACE = r"E' \n\t\r\x0B\f'"
_COMMITS = "|".join(S.COMMITMENTS)


@query(
    rf"""WITH t AS (SELECT *, text || CASE WHEN turn % 3 = 1 THEN chr(10) || '  The best  answer is ' || role || '. On.' ELSE '' END body FROM conversations),
    s AS (SELECT *, regexp_extract_all(body, '(?im)^[^\n]*\b(?:{_COMMITS})\b[^\n]*') said, list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: length(x) > 20) longer FROM t)
    SELECT conv_id, turn, left(CASE WHEN len(said) > 0 THEN trim(regexp_replace(said[-1], '\s+', ' ', 'g')) ELSE longer[-1] END, 240) AS commitment FROM s"""
)
def commitments(spark, d):
    """The line in which each turn commits itself."""
    added = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("\n  The best  answer is "), "role", F.lit(". On."))).otherwise("")
    return table(spark, d, "conversations").select("conv_id", "turn", S.commitment(F.concat("text", added)).alias("commitment"))


@query(
    rf"""WITH t AS (SELECT doc_id, trim(regexp_replace(chr(10) || chr(10) || text || chr(10) || '[tool result omitted]' || chr(10) || chr(10) || lang, '\n{{3,}}', chr(10) || chr(10), 'g'), {_SPACE}) s FROM documents)
    SELECT doc_id, md5(CASE WHEN length(s) <= 3000 THEN s ELSE rtrim(left(s, 1500), {_SPACE}) || chr(10) || '...' || chr(10) || ltrim(right(s, 1500), {_SPACE}) END) AS scrubbed FROM t"""
)
def scrubbed_texts(spark, d):
    """Documents with notes, tools' output and answers around them, which go."""
    text = F.concat(
        F.lit("[SYSTEM NOTE] for "), "source", F.lit('\nto "end".\n\n'), "text", F.lit('\n{"status": "success", "query": {"of": "'), "source", F.lit('"}'), F.lit("\nTERMINATE\n- Option 2: "), "lang", F.lit("\n"), "lang", F.lit("\n\n<answer>1\n</answer>\n"),
    )
    return table(spark, d, "documents").select("doc_id", F.md5(S.scrubbed(text)).alias("scrubbed"))


@query(
    """WITH t AS (SELECT *, role <> 'user' AND NOT contains(text, chr(10)) ok FROM conversations)
    SELECT conv_id, turn, CASE WHEN ok THEN turn ELSE coalesce(max(CASE WHEN ok THEN turn END) OVER (PARTITION BY conv_id, role ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
      max(CASE WHEN ok THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), turn) END repair_at FROM t"""
)
def repair_turns(spark, d):
    """Where a repair of each turn is put: the nearest reasoning before it; turns of several lines count as calls of tools."""
    turns = table(spark, d, "conversations").withColumn("kind", F.when(F.contains("text", F.lit("\n")), "ToolCallRequestEvent").otherwise("TextMessage"))
    return repairs.reasoning_turns(turns, "conv_id", "turn", "role").select("conv_id", "turn", "repair_at")


@query(
    r"""WITH c AS (SELECT conv_id, turn // 2 claim, count(*) n, first(trim(left(text, 40))) fix FROM conversations WHERE role = 'assistant' GROUP BY ALL),
    h AS (SELECT DISTINCT conv_id FROM c), a AS (SELECT v.*, CASE WHEN v.turn % 4 = 3 THEN NULL ELSE v.turn // 2 END id, CASE WHEN v.turn % 5 = 4 THEN 'hold' ELSE 'edit_and_revert' END act, v.text || CASE WHEN v.turn % 8 = 3 THEN ' the final answer' ELSE '' END body FROM conversations v)
    SELECT a.conv_id, a.turn, CASE WHEN h.conv_id IS NULL THEN 'no_concepts' WHEN act <> 'edit_and_revert' THEN 'not_edit_and_revert' WHEN trim(text) = '' THEN 'no_text' WHEN id IS NOT NULL AND coalesce(n, 0) <> 1 THEN 'claim_not_one'
      WHEN id IS NOT NULL AND NOT contains(body, fix) THEN 'correction_not_in_text' WHEN id IS NULL AND turn % 8 = 3 THEN 'text_chooses' WHEN id IS NULL THEN 'not_a_patch' WHEN turn % 6 = 1 THEN 'no_place' END error
    FROM a LEFT JOIN h USING (conv_id) LEFT JOIN c ON c.conv_id = a.conv_id AND c.claim = a.id"""
)
def repair_gates(spark, d):
    """Turns as proposed rewrites, with the first rule that keeps each from running."""
    turns, claim = table(spark, d, "conversations"), F.floor(F.col("turn") / 2)
    concepts = turns.filter("role = 'assistant'").select(F.col("conv_id").alias("session"), claim.alias("claim_id"), F.substring("text", 1, 40).alias("corrected"))
    place = F.when(F.col("turn") % 6 != 1, F.col("turn"))
    actions = turns.select(
        F.col("conv_id").alias("session"), "turn", F.when(F.col("turn") % 5 == 4, "hold").otherwise("edit_and_revert").alias("action"), F.when(F.col("turn") % 4 != 3, claim).alias("claim_id"),
        F.concat("text", F.when(F.col("turn") % 8 == 3, " the final answer").otherwise("")).alias("replacement_text"), F.lit(None).cast("string").alias("body"), place.alias("target_turn"), place.alias("ts"),
    )
    return repairs.gated(actions, concepts).select(F.col("session").alias("conv_id"), "turn", "error")


@query(
    r"""WITH p AS (SELECT conv_id, max(turn) AS at FROM conversations GROUP BY 1), f AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system'),
    c AS (SELECT conv_id, turn, trim(text) AS text, role FROM conversations WHERE turn % 2 = 1)
    SELECT p.conv_id, coalesce(c.turn, p.at) turn, coalesce(c.role, 'the agent''s selected reasoning step') concept, md5(coalesce(c.text, '')) incorrect,
      'Turn ' || p.at || ' holds that the sample of conversation ' || p.conv_id || ' was taken twice.' corrected, CASE WHEN p.conv_id % 3 = 0 THEN 'alignment_error' WHEN p.conv_id % 3 = 1 THEN 'mapping_error' ELSE 'fact_error' END error_type
    FROM p LEFT JOIN c ON c.conv_id = p.conv_id AND c.turn = p.at WHERE p.conv_id NOT IN (SELECT conv_id FROM f) AND p.at % 3 <> 0"""
)
def planner_choices(spark, d):
    """What a plan to repair the last turn becomes, in conversations of which nothing was flagged."""
    turns = table(spark, d, "conversations").withColumnRenamed("conv_id", "session")
    last = turns.groupBy("session").agg(F.max("turn").alias("at"))
    say = F.concat(F.lit("Turn "), F.col("at").cast("string"), F.lit(" holds that the sample of conversation "), F.col("session").cast("string"), F.lit(" was taken twice. It was not."))
    status = lambda k: F.when(F.col("session") % 3 == k, "Potentially incorrect").otherwise("good")
    none = F.lit(None).cast("string")
    plans = last.select(
        "session", F.when(F.col("at") % 3 != 0, " Repair").otherwise("continue").alias("decision"), F.col("at").alias("claim_id"), say.alias("correct"), none.alias("incorrect"), F.lit(" ").alias("concept"), none.alias("reason"),
        status(0).alias("alignment"), status(1).alias("mapping"), status(2).alias("grounding"), F.col("at").alias("target_turn"),
    )
    claims = turns.filter("turn % 2 = 1").select("session", F.col("turn").alias("claim_id"), "text", F.col("role").alias("source_ref"), "turn")
    found = repairs.planner_concepts(plans, turns.filter("role = 'system'"), claims)
    return found.select(F.col("session").alias("conv_id"), "turn", "concept", F.md5("incorrect").alias("incorrect"), "corrected", "error_type")


@query(
    """SELECT conv_id, turn, 'research_claim' category, md5(trim(text)) claim, role source_ref, '' source_type FROM conversations WHERE role = 'user'
    UNION ALL SELECT conv_id, turn, 'legal_claim', md5(trim(text)), role || turn, 'case' FROM conversations WHERE role = 'assistant' AND turn % 4 <> 1
    UNION ALL SELECT conv_id, turn, 'mapping_claim', md5(trim(text)), 'Answer grounding: ' || turn, 'answer_grounding' FROM conversations WHERE role = 'system'"""
)
def strategy_claims(spark, d):
    """Turns as records of three kinds, read as claims."""
    turns = table(spark, d, "conversations").withColumn("no", F.col("turn").cast("string"))
    kind = F.when(F.col("role") == "user", "research").when(F.col("role") == "assistant", "legal").otherwise("concept")
    record = F.struct(
        F.when(F.col("role") == "user", F.col("text")).alias("claimed_content"), F.when(F.col("role") == "user", F.col("role")).alias("claimed_title"), F.col("text").alias("content"),
        F.when(F.col("turn") % 4 == 1, " Unknown ").otherwise(F.concat("role", "no")).alias("reference_name"), F.lit("case").alias("type"), F.concat(F.lit("Answer grounding: "), "no").alias("scientific_concept"),
        F.col("text").alias("concept_understanding"),
    )
    rows = turns.select("conv_id", "turn", kind.alias("kind"), F.to_json(record).alias("raw"))
    return repairs.claims_of(rows).select("conv_id", "turn", "category", F.md5("claim").alias("claim"), "source_ref", "source_type")


@query(
    """SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 AND role <> 'user' AND turn % 3 = 0 THEN 'protein_parts' WHEN conv_id % 2 = 1 AND role <> 'user' AND turn % 3 = 1 THEN 'nucleic_acid_parts' END fault FROM conversations"""
)
def subject_faults(spark, d):
    """Turns as claims about parts, held against the subject of the question."""
    asked = F.concat(F.when(F.col("conv_id") % 2 == 0, "Which RNA: ").otherwise("Which Enzyme: "), F.col("conv_id").cast("string"))
    said = F.when(F.col("turn") % 3 == 0, "its side chains").when(F.col("turn") % 3 == 1, "its base  pair, a Base pair").otherwise("its parts")
    kind = F.when(F.col("role") != "user", "constraint_claim").otherwise("scientific_concept")
    return table(spark, d, "conversations").select("conv_id", "turn", S.subject_fault(asked, kind, F.lit(""), F.col("role"), said).alias("fault"))


@query(
    rf"""WITH f AS (SELECT item_id, ['TP' || item_id || ' against mir-7', regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[\p{{L}}\p{{N}}_]*[À-ɏ][\p{{L}}\p{{N}}_]*', '_', 'g')] f FROM benchmark),
    t AS (SELECT item_id, f, list_concat(regexp_extract_all(f[1], '{S.TECHNICAL[4:]}'), regexp_extract_all(f[2], '{S.TECHNICAL[4:]}')) a, list_concat(regexp_extract_all(f[1], '\b[A-Za-z][A-Za-z-]{{3,}}\b'), regexp_extract_all(f[2], '\b[A-Za-z][A-Za-z-]{{3,}}\b')) b FROM f),
    u AS (SELECT item_id, list_filter(a, lambda x, i: list_position(list_transform(a, lambda y: lower(y)), lower(x)) = i)[1:10] a, list_filter(b, lambda x: lower(x) NOT IN {S.COMMON_WORDS!r}) b FROM t),
    v AS (SELECT item_id, a, list_filter(b, lambda x, i: list_position(list_transform(b, lambda y: lower(y)), lower(x)) = i AND NOT list_contains(list_transform(a, lambda y: lower(y)), lower(x))) b FROM u)
    SELECT item_id, array_to_string(list_concat(a, b)[1:18], ' ') AS search FROM v"""
)
def claim_searches(spark, d):
    """Benchmark texts as claims, each with the search for its evidence; a claim said twice counts once."""
    rows = table(spark, d, "benchmark")
    return rows.select("item_id", S.claim_query(F.concat(F.lit("TP"), F.col("item_id").cast("string"), F.lit(" against mir-7")), "text", F.concat(F.lit(" "), "text"), F.lit(None).cast("string"), F.lit("against mir-7")).alias("search"))
