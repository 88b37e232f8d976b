"""Repairs, commitments, scrubbing and searches against plain Python and by hand."""

import random

from pyspark.sql import functions as F

from factloom.functions import statements as S
from factloom.operators import repairs
from factloom.plans.ranks import latest_before

FIX = "The strain grows at a lower temperature than was claimed before."


def one(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    got = {r.i: r.y for r in rows.select("i", column("x").alias("y")).collect()}
    return [got[i] for i in range(len(texts))]


def test_latest_before_of_ranges(spark):
    draw = random.Random(3)
    rows = [(draw.choice(["a", "a", "a", "b", None]), draw.choice(["x", "y", None]), draw.choice([None, *range(300)]), draw.random() < 0.1, i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, f string, at bigint, ok boolean, _near int")
    df = df.withColumnRenamed("_near", "id").repartition(7)
    got = {r.id: (r.one, r.two) for r in latest_before(df, ["k"], "at", F.col("ok"), {"one": ["f"], "two": []}).collect()}

    def plain(k, f, at, fine):
        found = [t for a, b, t, ok, _ in rows if ok and a == k and (not fine or b == f) and t is not None and at is not None and t < at]
        return max(found, default=None)

    assert got == {i: (plain(k, f, at, True), plain(k, f, at, False)) for k, f, at, _, i in rows}


def test_reasoning_turns(spark):
    rows = [
        ("s", 1, "agent", "TextMessage", "thinks"), ("s", 2, "other", "ThoughtEvent", "thinks too"), ("s", 3, "agent", "ToolCallRequestEvent", "calls"), ("s", 4, "user", "TextMessage", "asks"),
        ("s", 5, "agent", "TextMessage", "<ANSWER>2</ANSWER>"), ("s", 6, None, "Unknown", None), ("t", 1, "agent", "TextMessage", " \n"), ("t", None, "agent", "TextMessage", "thinks"),
    ]
    df = spark.createDataFrame(rows, "session string, ts bigint, source string, kind string, text string")
    got = {(r.session, r.ts): r.repair_at for r in repairs.reasoning_turns(df).collect()}
    assert got == {("s", 1): 1, ("s", 2): 2, ("s", 3): 1, ("s", 4): 2, ("s", 5): 1, ("s", 6): 2, ("t", 1): 1, ("t", None): None}
    empty = repairs.reasoning_turns(df.limit(0))
    assert empty.count() == 0 and empty.columns == [*df.columns, "repair_at"]
    kinds = [("agent", "ToolCallExecutionEvent", None, True), ("user", "TextMessage", None, False), ("MyGroupChatManager1", "TextMessage", None, False), ("TextMentionTermination", "TextMessage", None, False), ("agent", None, "GroupChatAgentResponse", True), (None, "TextMessage", None, False), ("agent", "Other", None, False)]
    df = spark.createDataFrame(kinds, "s string, k string, n string, want boolean")
    assert all(r.got == r.want for r in df.select("want", repairs.is_editable("s", "k", "n").alias("got")).collect())


def test_commitments(spark):
    texts = ["I think so.\nMy answer is  two.\nThe final answer: 3.\nBye now, and thank you all.", "short\nthis line is longer than twenty\nno", "short", "", None, "a\r\nHence the best choice\twas made\r\nb", "Authors: A, and many more words here; my choice is literature results for: x", "i pick " + "x" * 500]
    assert one(spark, texts, S.commitment) == ["The final answer: 3.", "this line is longer than twenty", None, None, None, "Hence the best choice was made", None, ("i pick " + "x" * 500)[:240]]


def test_scrubbing(spark):
    long = " ".join(f"word{i}" for i in range(2000))
    names = ", ".join(f'"tool_{i}"' for i in range(4000))
    texts = [
        "before\r\nLiterature results for: x\na line\nanother\n\nAfter it", "a [{'content': 'x\ny', 'name': 'search', 'id': 1}] b", 'x {"status": "success", "n": 1} y', '[{"title": "t"}, {"url": "u"}]', f"[{names}] end", '"a_b", "c_d"',
        "one\n[SYSTEM NOTE] do\nthis\n\ntwo", "keep (say it wrapped in answer tags) this\nwrap it in answer tags\nrest", "x\nOption 3: what\n- option b: that\n TERMINATE \ny", "a<answer>\n1</answer>b", "a\n\n\n\n\nb", long, "", None,
        "Literature results for: x\n" * 3000,
    ]
    want = [
        "before\n\nAfter it", "a [tool result omitted] b", "x [tool result omitted] y", "[search results omitted]", "[[tool names omitted]] end", '"a_b", "c_d"',
        "one\n\ntwo", "keep  this\n\nrest", "x\n\ny", "ab", "a\n\nb", long[:1500].rstrip() + "\n...\n" + long[-1500:].lstrip(), "", "", "",
    ]
    assert one(spark, texts, S.scrubbed) == want
    assert one(spark, [long], lambda x: S.scrubbed(x, None)) == [long]
    assert one(spark, ["Catalogue says:\nthings\n"], lambda x: S.scrubbed(x, more=("Catalogue says",))) == [""]


def test_corrections(spark):
    two = "The first sentence says a thing. The second says another. The third is too much."
    texts = [f"{FIX} More of it.", "Too short.", f"{FIX[:-1]}, so choose option 2 now.", "<answer>b</answer> " + FIX, FIX + " terminate", "Therefore " + FIX, "x" * 300, None, f"[answer redacted] {FIX}", "It seems that option B was not meant in this sentence at all."]
    got = one(spark, texts, S.corrected_claim)
    assert got == [FIX, None, f"{FIX[:-1]}, so choose [option redacted] now.", f"[answer redacted] {FIX}", None, None, None, None, f"[answer redacted] {FIX}", "It seems that [option redacted] was not meant in this sentence at all."]
    reasons = [two, "I apologize. " + two, "<answer>", "", None, "a. " * 3 + "b", "y" * 399 + ". " + "z" * 50, "The best choice is this."]
    assert one(spark, reasons, S.planner_reason) == ["The first sentence says a thing. The second says another.", None, None, None, None, "a. a.", "y" * 399 + ".", None]
    assert one(spark, ["potentially incorrect", "OK", "", None, "Off-Target"], S.is_bad_status) == [True, False, False, False, True]
    patch = "[REASONING REPAIR]\nConcept: x\nOriginal: the correct answer\nCorrected: y\nInstruction: z\n[END REASONING REPAIR]"
    assert one(spark, [patch, patch[:-1], "plain", None], S.is_patch) == [True, False, False, False]
    assert one(spark, [patch, patch + " the correct answer", "[CONCEPT CORRECTION] final answer", "plain", None], S.chooses) == [False, True, False, False, False]


def test_gates(spark):
    edit, patch = "edit_and_revert", "[CONCEPT CORRECTION] Concept: a Faulty claim: b Correction: c Instruction: d [END CONCEPT CORRECTION]"
    concepts = [("s", "one", FIX), ("s", "two", FIX), ("s", "two", FIX), ("s", "bare", " "), ("s", "chosen", "the best option is here"), ("s", "named", "as option 2 has it"), ("s", None, FIX)]
    cases = [
        ("none", edit, FIX, None, "one", 1, "no_concepts"), ("s", "hold", FIX, None, "one", 1, "not_edit_and_revert"), ("s", None, FIX, None, "one", 1, "not_edit_and_revert"), ("s", edit, " \n", None, "one", 1, "no_text"),
        ("s", edit, None, None, "one", 1, "no_text"), ("s", edit, FIX, None, "two", 1, "claim_not_one"), ("s", edit, FIX, None, "three", 1, "claim_not_one"), ("s", edit, FIX, None, "bare", 1, "no_correction"),
        ("s", edit, "other", None, "one", 1, "correction_not_in_text"), ("s", edit, "the best option is here", None, "chosen", 1, "correction_chooses"), ("s", edit, "as option 2 has it", None, "named", 1, "correction_names_option"),
        ("s", edit, "terminate", None, None, 1, "text_chooses"), ("s", edit, patch, "the final answer", None, 1, "text_chooses"), ("s", edit, "see option 3", None, None, 1, "text_names_option"), ("s", edit, FIX, None, None, 1, "not_a_patch"),
        ("s", edit, patch, None, None, None, "no_place"), ("s", edit, patch, None, None, 1, None), ("s", edit, None, f"so: {FIX}", "one", 1, None), ("s", edit, f"{FIX} option 2", None, "one", 1, None),
    ]
    actions = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, session string, action string, replacement_text string, body string, claim_id string, target_turn int, want string").withColumn("ts", F.lit(None).cast("bigint"))
    known = spark.createDataFrame(concepts, "session string, claim_id string, corrected string")
    got = repairs.gated(actions, known).collect()
    assert len(got) == len(cases) and all(r.error == r.want for r in got), [(r.i, r.error, r.want) for r in got if r.error != r.want]
    more = [("s", edit, FIX, None, None, "no_claim"), ("s", edit, FIX, True, "one", "no_anchor"), ("s", edit, f"{FIX} your_selected_option", None, "one", "placeholder"), ("s", edit, f"{FIX} [System Note]", None, "one", "system_note"), ("s", edit, FIX, False, "one", None)]
    actions = spark.createDataFrame(more, "session string, action string, replacement_text string, anchor_not_found boolean, claim_id string, want string").select("*", F.lit(None).cast("string").alias("body"), F.lit(1).alias("target_turn"), F.lit(1).alias("ts"))
    assert all(r.error == r.want for r in repairs.gated(actions, known, fallback=True).collect())
    assert {r.error for r in repairs.gated(actions, known.limit(0)).collect()} == {"no_concepts"}


def test_planner_concepts(spark):
    fields = "session string, decision string, claim_id string, correct string, incorrect string, concept string, reason string, alignment string, mapping string, grounding string, target_turn int"
    plans = [("a", " REPAIR", "c", FIX, None, "", None, None, "wrong", None, 7), ("b", "repair", "c", FIX, None, None, None, None, None, None, 7), ("d", "repair", None, "No.", "was", "Option 1 of x", "It is so.", "fine", None, "Off", 7), ("e", "repair", "c", "", None, None, " ", None, None, None, 7), ("f", "stop", "c", FIX, None, None, None, None, None, None, 7), ("g", None, "c", FIX, None, None, None, None, None, None, 7)]
    claims = spark.createDataFrame([("a", "c", "old", "r0", 1), ("a", "c", "said", "ref", 2), ("e", "c", "said", "ref", 2)], "session string, claim_id string, text string, source_ref string, turn int")
    got = repairs.planner_concepts(spark.createDataFrame(plans, fields), spark.createDataFrame([("b",), ("b",)], "session string"), claims).collect()
    assert sorted(tuple(r) for r in got) == [("a", "c", 2, "ref", "said", FIX, "mapping_error"), ("d", None, 7, "[option redacted] of x", "was", "No.", "fact_error")]


def test_claims_of_records(spark):
    rows = [
        ("research", '{"claimed_content": " a ", "claimed_url": "u", "inferred_source_type": "web", "original_statement": "o"}', ("research_claim", "a", "u", "web", "o")), ("research", '{"claimed_content": "Unknown"}', None),
        ("medical", '{"claimed_content": "a", "authority": "who"}', ("medical_claim", "a", "who", "guideline", "")), ("medical", '{"claimed_content": "a"}', None), ("legal", '{"content": "a", "reference_name": "r", "type": "case"}', ("legal_claim", "a", "r", "case", "")),
        ("code", '{"element_type": "import", "package_name": "Unknown", "code_snippet": "import x", "language": "py"}', ("import", "import x", "Unknown", "py", "")), ("code", '{"element_type": "loop", "package_name": "p", "code_snippet": "c"}', None),
        ("concept", '{"scientific_concept": "Entity Compatibility: x", "concept_understanding": "u", "context_snippet": "s"}', ("constraint_claim", "u", "Entity Compatibility: x", "entity_compatibility", "s")),
        ("concept", '{"scientific_concept": "c", "concept_understanding": "Unknown"}', ("scientific_concept", "Unknown", "c", "scientific_concept", "")), ("concept", '{"scientific_concept": "[{\'content\': 1", "concept_understanding": "u"}', None),
        ("concept", '{"scientific_concept": "c", "concept_understanding": "Literature results for: x"}', None), ("other", "{}", None), (None, None, None), ("legal", "no json", None),
    ]
    df = spark.createDataFrame([(i, k, r) for i, (k, r, _) in enumerate(rows)], "i int, kind string, raw string")
    got = {r.i: tuple(r)[1:] for r in repairs.claims_of(df).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(rows) if w}
    facts = [(1, '[{"concept": " A  b", "claim": "x"}, {"claim_type": "Factual ", "concept": "c", "claim": "y"}, {"claim_type": "opinion", "concept": "c", "claim": "z"}, {"concept": "", "claim": "z"}, {"concept": "c"}]'), (2, None), (3, "no json"), (4, "[]")]
    got = repairs.factual_claims(spark.createDataFrame(facts, "i int, raw string")).collect()
    assert [tuple(r) for r in got] == [(1, "A  b", "x", "a b"), (1, "c", "y", "c")]


def test_subjects_and_searches(spark):
    rows = [("Which RNA?", "constraint_claim", None, None, "its residues", "protein_parts"), ("Which enzyme?", None, "entity_compatibility", "base pair", None, "nucleic_acid_parts"), ("Which enzyme?", None, None, "base pair", None, None), ("Which DNA enzyme?", "constraint_claim", "", "", "a nucleotide", None), (None, "constraint_claim", None, None, None, None)]
    df = spark.createDataFrame(rows, "q string, c string, s string, r string, t string, want string")
    assert all(r.got == r.want for r in df.select("want", S.subject_fault("q", "c", "s", "r", "t").alias("got")).collect())
    parts = [("TP53 binds MDM2", "tp53 binds  MDM2 strongly", None), ("The study shows RNA-seq", "and more", "rna-SEQ results with Étude words"), ("a b", "", None), (None, None, None), ("x" * 500, "y", None), ("<answer>1</answer> terminate |", None, None)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(parts)], "i int, a string, b string, c string")
    got = [r.s for r in df.select("i", S.claim_query("a", "b", "c").alias("s")).orderBy("i").collect()]
    assert got == ["TP53 MDM2 binds strongly", "RNA rna-SEQ more words", "a b", "", "x" * 400, ""]
