"""Reports, samples, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import reports, sampling, selection, turns

from .base import query, table

_RESULTS = """results AS (SELECT d.doc_id, d.lang question_type, CASE WHEN n_chars >= 3000 THEN 'T1' WHEN n_chars >= 500 THEN 'T2' ELSE 'T3' END tier,
  CASE WHEN n_chars >= 3000 THEN 1.5 WHEN n_chars >= 500 THEN 1.0 ELSE 0.5 END weight, CAST(quality AS DOUBLE) score, CASE WHEN toxic = 1 THEN 'toxic' ELSE '' END error FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def _results(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    tier = F.when(F.col("n_chars") >= 3000, "T1").when(F.col("n_chars") >= 500, "T2").otherwise("T3")
    weight = F.when(tier == "T1", 1.5).when(tier == "T2", 1.0).otherwise(0.5)
    return docs.join(labels, "doc_id").select(
        "doc_id", F.col("lang").alias("question_type"), tier.alias("tier"), weight.alias("weight"), F.col("quality").cast("double").alias("score"), F.when(F.col("toxic") == 1, "toxic").otherwise("").alias("error")
    )


@query(
    f"""WITH {_RESULTS} SELECT question_type, tier, count(*) n, round(avg(score), 6) acc, round(sum(score * weight) / sum(weight), 6) weighted_acc, sum(weight) total_weight, count(*) FILTER (error <> '') errors,
    CASE GROUPING(question_type, tier) WHEN 0 THEN 'question_type x tier' WHEN 1 THEN 'question_type' WHEN 2 THEN 'tier' ELSE '' END AS slice
    FROM results GROUP BY GROUPING SETS ((), (question_type), (tier), (tier, question_type))"""
)
def grouping_report(spark, d):
    found = reports.accuracy_report(_results(spark, d), (("question_type",), ("tier",), ("tier", "question_type")))
    return found.select("question_type", "tier", "n", F.round("acc", 6).alias("acc"), F.round("weighted_acc", 6).alias("weighted_acc"), "total_weight", "errors", "slice")


_CLAIMS = """claims AS (SELECT conv_id sample_id, CASE turn % 3 WHEN 0 THEN 'refuted' WHEN 1 THEN 'supported' ELSE 'unverifiable' END verdict,
  CASE turn % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE 0.5 END score, 1 + ln(1 + length(text)) concept_weight, CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END question_type FROM conversations)"""


@query(
    f"""WITH {_CLAIMS}, s AS (SELECT sample_id, question_type, count(*) n_claims, count(*) FILTER (verdict = 'refuted') n_refuted, count(*) FILTER (verdict = 'refuted') / count(*)::DOUBLE HR, avg(score) HS,
      max(CASE WHEN verdict = 'refuted' THEN 1 ELSE 0 END) HF, sum(score * concept_weight) cs, sum(concept_weight) cw FROM claims GROUP BY 1, 2)
    SELECT question_type, count(*) n_samples, CAST(sum(n_claims) AS BIGINT) n_claims, CAST(sum(n_refuted) AS BIGINT) n_refuted, round(avg(HR), 6) "HR_macro", round(avg(HS), 6) "HS_macro", round(avg(HF), 6) "HF_rate",
      round(sum(n_refuted) / sum(n_claims), 6) "HR_micro", round(sum(HS * n_claims) / sum(n_claims), 6) "HS_micro", round(sum(cs) / sum(cw), 6) "HS_weighted_micro" FROM s GROUP BY GROUPING SETS ((), (question_type))"""
)
def audit_report(spark, d):
    from factloom.functions.answers import verdict_score

    verdict = F.when(F.col("turn") % 3 == 0, "refuted").when(F.col("turn") % 3 == 1, "supported").otherwise("unverifiable")
    claims = table(spark, d, "conversations").select(
        F.col("conv_id").alias("sample_id"), F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd").alias("question_type"),
        verdict.alias("verdict"), verdict_score(verdict).alias("score"), (1 + F.log1p(F.length("text").cast("double"))).alias("concept_weight"),
    )
    found = reports.audit_report(reports.claim_metrics(claims, ("sample_id", "question_type")), (("question_type",),))
    return found.select("question_type", "n_samples", "n_claims", "n_refuted", *(F.round(c, 6).alias(c) for c in ("HR_macro", "HS_macro", "HF_rate", "HR_micro", "HS_micro", "HS_weighted_micro")))


@query(
    """SELECT source, round(count(*) FILTER (q AND t) / greatest(count(*) FILTER (t), 1e-8), 6) sensitivity, round(count(*) FILTER (NOT q AND NOT t) / greatest(count(*) FILTER (NOT t), 1e-8), 6) specificity,
    round(count(*) FILTER (q AND t) / greatest(count(*) FILTER (q), 1e-8), 6) ppv, round(count(*) FILTER (t) / count(*), 6) prevalence FROM (SELECT source, n_chars / 5000.0 >= 0.6 q, quality = 1 t FROM documents JOIN labels USING (doc_id)) GROUP BY source"""
)
def screening_metrics(spark, d):
    """Length as a test for quality, by source."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("risk", F.col("n_chars") / 5000.0)
    found = reports.screening(rows, "risk", "quality", 0.6, "source")
    return found.select("source", *(F.round(c, 6).alias(c) for c in ("sensitivity", "specificity", "ppv", "prevalence")))


@query(
    """SELECT l_linestatus, round(log2((avg(l_quantity) FILTER (l_returnflag = 'R') + 1e-6) / (avg(l_quantity) FILTER (l_returnflag <> 'R') + 1e-6)), 6) log2_fold_change FROM lineitem GROUP BY 1"""
)
def fold_change(spark, d):
    return reports.fold_change(table(spark, d, "lineitem"), "l_quantity", "l_returnflag = 'R'", "l_linestatus").select("l_linestatus", F.round("log2_fold_change", 6).alias("log2_fold_change"))


@query(
    """WITH r AS (SELECT p_brand, p_size dose, round(avg(p_retailprice) / 2000, 6) response FROM part GROUP BY 1, 2)
    SELECT p_brand, round(arg_min(response, dose) - arg_max(response, dose), 6) activity_drop, arg_min(dose, abs(response - 0.5) * 1000000 + dose / 1000.0) ic50 FROM r GROUP BY 1"""
)
def dose_response(spark, d):
    rows = table(spark, d, "part").groupBy("p_brand", F.col("p_size").alias("dose")).agg(F.round(F.avg("p_retailprice") / 2000, 6).alias("response"))
    return reports.dose_response(rows, "dose", "response", "p_brand").withColumn("activity_drop", F.round("activity_drop", 6))


@query("""SELECT l_suppkey, round(sum(l_quantity * l_discount) / greatest(sum(l_quantity), 1e-8), 6) score FROM lineitem GROUP BY 1""")
def weighted_signal(spark, d):
    return reports.weighted_signal(table(spark, d, "lineitem"), "l_quantity", "l_discount", "l_suppkey").withColumn("score", F.round("score", 6))


@query(
    """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) turn, min(doc_id) OVER (PARTITION BY source) f FROM documents) SELECT doc_id, source, turn FROM r ORDER BY turn, f, source LIMIT 100"""
)
def round_robin(spark, d):
    return sampling.rotated(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 100).select("doc_id", "source", "turn")


@query("""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) n FROM documents) WHERE n <= 3""")
def uniqueness_cap(spark, d):
    return sampling.capped(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 3)


_QUOTAS = """w AS (SELECT lang AS name, count(*)::DOUBLE ratio FROM documents GROUP BY 1), raw AS (SELECT *, 77 * ratio / sum(ratio) OVER () r FROM w),
q AS (SELECT name, ratio, floor(r) + CASE WHEN row_number() OVER (ORDER BY r - floor(r) DESC, r DESC, name DESC) <= 77 - sum(floor(r)) OVER () THEN 1 ELSE 0 END quota FROM raw)"""


def _quota(spark, d):
    return sampling.apportioned(table(spark, d, "documents").groupBy(F.col("lang").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("ratio")), 77)


@query(f"""WITH {_QUOTAS} SELECT name, CAST(quota AS BIGINT) quota FROM q""")
def largest_remainder(spark, d):
    return _quota(spark, d).select("name", "quota")


@query(f"""WITH {_QUOTAS}, r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) n FROM documents) SELECT doc_id, lang FROM r JOIN q ON lang = name WHERE n <= quota""")
def quota_select(spark, d):
    return sampling.allocated(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", _quota(spark, d)).select("doc_id", "lang")


def _picks(n: int) -> str:
    """``n`` greedy choices, each a step of its own."""
    steps = ["l0 AS MATERIALIZED (SELECT DISTINCT l_suppkey id, p_brand || '/' || p_size item FROM lineitem JOIN part ON l_partkey = p_partkey)"]
    for i in range(1, n + 1):
        steps.append(f"p{i} AS MATERIALIZED (SELECT id, count(*) gain FROM l{i - 1} GROUP BY id ORDER BY gain DESC, id LIMIT 1)")
        steps.append(f"l{i} AS MATERIALIZED (SELECT * FROM l{i - 1} WHERE item NOT IN (SELECT item FROM l{i - 1} JOIN p{i} USING (id)))")
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(f"SELECT {i} pick, id, gain FROM p{i}" for i in range(1, n + 1))


@query(_picks(5))
def greedy_cover(spark, d):
    """The suppliers that cover most brands, one after another; each choice rests on those before it."""
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    rows = line.join(part, line.l_partkey == part.p_partkey).groupBy(F.col("l_suppkey").alias("id")).agg(F.collect_set(F.concat_ws("/", "p_brand", F.col("p_size").cast("string"))).alias("items"))
    return selection.greedy_cover(rows, 5)


@query(
    """WITH k AS (SELECT *, role || chr(31) || trim(regexp_replace(text, '\\s+', ' ', 'g')) sig FROM conversations WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '')
    SELECT conv_id, turn FROM (SELECT *, lag(sig) OVER (PARTITION BY conv_id ORDER BY turn) before FROM k) WHERE before IS NULL OR before <> sig"""
)
def consecutive_dedup(spark, d):
    return turns.without_repeats(table(spark, d, "conversations"), "conv_id", "turn", "role", "text").select("conv_id", "turn")


@query(
    """SELECT conv_id, arg_max(turn, p * 1000000 + turn) turn, arg_max(role, p * 1000000 + turn) AS role, length(arg_max(text, p * 1000000 + turn)) n_chars FROM
    (SELECT *, CASE WHEN role = 'assistant' AND NOT (length(trim(text)) < 40 OR (contains(lower(text), 'terminate') AND length(trim(text)) < 200) OR contains(left(lower(trim(text)), 400), 'could not fetch') OR contains(left(lower(trim(text)), 400), 'could not retrieve')
      OR (contains(lower(text), '<answer>') AND length(trim(text)) < 400)) THEN 2 WHEN role = 'assistant' THEN 1 ELSE 0 END p FROM conversations) GROUP BY conv_id"""
)
def turn_prune(spark, d):
    found = turns.last_assistant(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return found.select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"))


@query(
    """SELECT conv_id, turn, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn) AS assistant_turn FROM conversations"""
)
def turn_numbers(spark, d):
    return turns.numbered(table(spark, d, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "assistant_turn")


@query(
    """WITH s AS (SELECT conv_id, turn, unnest(list_transform(regexp_split_to_array(text, '[.!?]+\\s+'), lambda x: trim(x))) claim, generate_subscripts(regexp_split_to_array(text, '[.!?]+\\s+'), 1) - 1 pos FROM conversations),
    f AS (SELECT conv_id, claim, min(turn * 100000 + pos) place FROM s WHERE length(claim) BETWEEN 20 AND 400 GROUP BY 1, 2),
    n AS (SELECT conv_id, place // 100000 turn, place % 100000 pos, md5(claim) claim_md5, row_number() OVER (PARTITION BY conv_id ORDER BY place) claim_no FROM f) SELECT * FROM n WHERE claim_no <= 50"""
)
def claim_sentences(spark, d):
    found = turns.sentence_claims(table(spark, d, "conversations"), "conv_id", "turn", "text")
    return found.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("pos").cast("long").alias("pos"), F.md5("claim").alias("claim_md5"), F.col("claim_no").cast("long").alias("claim_no"))


def _spans(spark, d):
    return table(spark, d, "events").select("user_id", (F.col("event_id") % 1000).alias("s"), (F.col("event_id") % 1000 + F.floor("value")).alias("e"))


@query(
    """WITH spans AS (SELECT user_id, event_id % 1000 AS s, event_id % 1000 + CAST(floor(value) AS BIGINT) AS e FROM events),
    m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) r FROM spans),
    i AS (SELECT *, sum(CASE WHEN r IS NULL OR s - r > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) k FROM m) SELECT user_id, min(s) s, max(e) e, count(*) n_spans FROM i GROUP BY user_id, k"""
)
def span_merge(spark, d):
    return turns.merged_spans(_spans(spark, d), "user_id", "s", "e", 3)


@query(
    """WITH spans AS (SELECT user_id, event_id % 1000 AS s, event_id % 1000 + CAST(floor(value) AS BIGINT) AS e FROM events)
    SELECT user_id, s, e FROM (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) r FROM spans) WHERE r IS NULL OR e > r"""
)
def span_subsumed(spark, d):
    return turns.outermost_spans(_spans(spark, d), "user_id", "s", "e")


@query(
    """SELECT user_id, count(*) FILTER (event_type = 'signup') n_signup, count(*) FILTER (event_type = 'error') n_error, count(*) FILTER (event_type = 'click') n_click, count(*) FILTER (event_type = 'view') n_view, count(*) FILTER (event_type = 'purchase') n_purchase FROM events GROUP BY 1"""
)
def event_pivot(spark, d):
    return turns.pivoted(table(spark, d, "events"), "user_id", "event_type", ("signup", "error", "click", "view", "purchase"))


@query(
    """SELECT event_id, count(*) OVER w n_recent, round(sum(value) OVER w, 6) cost_recent FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW)"""
)
def rate_window(spark, d):
    return turns.rate_windows(table(spark, d, "events"), "event_type", "ts", "value").select("event_id", "n_recent", F.round("cost_recent", 6).alias("cost_recent"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOURS THEN 0 ELSE 1 END n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) k FROM g)
    SELECT user_id, CAST(k AS BIGINT) AS session, count(*) n_events, epoch_us(max(ts)) - epoch_us(min(ts)) AS micros FROM s GROUP BY user_id, k"""
)
def session_stall(spark, d):
    found = turns.stalls(table(spark, d, "events"), "user_id", "ts", 6 * 3600)
    return found.select("user_id", F.col("session").cast("long").alias("session"), "n_events", (F.unix_micros("last_ts") - F.unix_micros("first_ts")).alias("micros"))


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def resume_pending(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query(
    """SELECT event_id, user_id, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS accuracy_so_far FROM events"""
)
def running_accuracy(spark, d):
    rows = table(spark, d, "events").withColumn("hit", (F.col("event_type") == "purchase").cast("int"))
    return turns.running_accuracy(rows, "user_id", "event_id", "hit").select("event_id", "user_id", F.round("accuracy_so_far", 6).alias("accuracy_so_far"))


@query(
    """WITH c AS (SELECT user_id, CAST(avg(event_id) AS BIGINT) cutoff FROM events GROUP BY 1) SELECT e.user_id, e.event_id, e.user_id + 1 AS new_session FROM events e JOIN c USING (user_id) WHERE e.event_id < c.cutoff"""
)
def session_revert(spark, d):
    """What every user's log keeps when it goes back to its middle."""
    events = table(spark, d, "events").select("user_id", "event_id")
    cut = events.groupBy("user_id").agg(F.round(F.avg("event_id")).cast("bigint").alias("cutoff"))
    return turns.reverted(events, "user_id", "event_id", cut)
