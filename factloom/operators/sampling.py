"""Choosing rows: quotas, caps, rotation, cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.plans.ranks import within_group


def rotated(df: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """The first row of each group, then the second of each, up to ``limit``; groups by their first row."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(order))
    first = df.groupBy(group).agg(F.min(order).alias("_first"))
    ranked = df.withColumn("turn", turn).filter(F.col("turn") <= limit)  # no group can give more
    return ranked.join(first, group).orderBy("turn", "_first", group).limit(limit).drop("_first")


def shuffled(df: DataFrame, key: str, seed: int, limit: int) -> DataFrame:
    """``limit`` rows in a pseudorandom order that depends on the seed and the key alone."""
    return df.withColumn("_r", F.xxhash64(F.lit(seed), key)).orderBy("_r", key).limit(limit).drop("_r")


def capped(df: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """At most ``most`` rows of each key, the first by ``order``."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_r") <= most).drop("_r")


def quotas(ratios: dict[str, float], total: int) -> dict[str, int]:
    """``total`` shared by ratio: whole parts first, what is left to the largest remainders (then ratios, then names)."""
    weight = sum(max(0.0, r) for r in ratios.values())
    if not weight:
        return dict.fromkeys(ratios, 0)
    shares = {k: total * max(0.0, r) / weight for k, r in ratios.items()}
    out = {k: int(s) for k, s in shares.items()}
    for k in sorted(shares, key=lambda k: (shares[k] - out[k], shares[k], k), reverse=True)[: total - sum(out.values())]:
        out[k] += 1
    return out


def apportioned(weights: DataFrame, total: int) -> DataFrame:
    """``weights`` (name, ratio) with quota, as ``quotas`` does; a row per kind."""
    every = Window.partitionBy(F.lit(0))
    raw = F.lit(total) * F.col("ratio") / F.sum("ratio").over(every)
    parts = weights.withColumn("raw", raw).withColumn("whole", F.floor("raw")).withColumn("rest", F.lit(total) - F.sum("whole").over(every))
    turn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.col("raw") - F.col("whole")), F.desc("raw"), F.desc("name")))
    return parts.withColumn("turn", turn).select("name", "ratio", (F.col("whole") + F.when(F.col("turn") <= F.col("rest"), 1).otherwise(0)).cast("long").alias("quota"))


def allocated(df: DataFrame, kind: str, order: str, quota: DataFrame) -> DataFrame:
    """The first rows of each kind by ``order``, as many as its quota."""
    most = quota.agg(F.max("quota")).first()[0] or 0  # no kind gives more, so that few rows of each part are ranked again
    ranked = within_group(df, [kind], order, most)
    return ranked.join(F.broadcast(quota.select(F.col("name").alias(kind), "quota")), kind).filter("_r <= quota").drop("_r", "quota")


def distractors(questions: DataFrame, pool: DataFrame, k: int = 3) -> DataFrame:
    """Up to ``k`` wrong answers for each question, by text: of the same relation, neither the answer nor another of the head's own tails.

    ``questions`` has id, head, relation, answer; ``pool`` has head, relation,
    tail. A head with n tails of its own needs the relation's first n + k + 1 at
    most: these are numbered, joined by number, and its own ones taken away, so
    that rows grow with the pool and no row is wider than k + 1 answers.
    """
    own = pool.select("head", "relation", "tail").distinct()
    tails = within_group(pool.select("relation", "tail").distinct(), ["relation"], "tail").withColumn("_r", F.col("_r").cast("bigint"))
    n = own.groupBy("head", "relation").agg(F.count(F.lit(1)).alias("n"))
    asked = questions.select("head", "relation").distinct().join(n, ["head", "relation"], "left")
    wanted = asked.select("head", "relation", F.explode(F.sequence(F.lit(1).cast("bigint"), F.coalesce("n", F.lit(0)) + k + 1)).alias("_r"))
    free = wanted.join(tails, ["relation", "_r"]).join(own, ["head", "relation", "tail"], "left_anti").withColumnRenamed("_r", "place")
    first = within_group(free, ["head", "relation"], "place", k + 1).groupBy("head", "relation").agg(F.sort_array(F.collect_list(F.struct("place", "tail"))).alias("free"))
    usable = F.filter(F.transform("free", lambda x: x["tail"]), lambda t: t != F.col("answer"))
    return questions.join(first, ["head", "relation"], "left").select("id", F.coalesce(F.slice(usable, 1, k), F.array().cast("array<string>")).alias("distractors"))


#: How many samples a node of each tier should have, and the order in which tiers give way.
TIER_QUOTAS = {"T1": 3, "T2": 2, "T3": 1}


def node_quotas(nodes: DataFrame, total: int, seed: int = 7) -> DataFrame:
    """``nodes`` (node, tier) with quota, at most ``total`` together: T3 gives way first, then T2, then T1.

    In a tier that gives way every node loses as much as the others, and what
    is left over is taken from the first nodes by a digest of seed and name.
    """
    tiers = {r["tier"]: r["n"] for r in nodes.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each tier
    excess = max(0, sum(TIER_QUOTAS[t] * n for t, n in tiers.items()) - total)
    quota = F.when(F.lit(False), F.lit(0))
    for tier in sorted(TIER_QUOTAS, reverse=True):
        n = tiers.get(tier, 0)
        if not n:
            continue
        gone = min(excess, TIER_QUOTAS[tier] * n)
        excess -= gone
        quota = quota.when(F.col("tier") == tier, TIER_QUOTAS[tier] - gone // n - F.when(F.col("_r") <= gone % n, 1).otherwise(0))
    order = F.struct(F.sha1(F.concat_ws("|", F.lit(str(seed)), "node")), F.col("node"))
    ranked = within_group(nodes.withColumn("_order", order), ["tier"], "_order")
    return ranked.select("node", "tier", quota.cast("long").alias("quota"))


def allocation_report(selected: DataFrame, touched: DataFrame, n_nodes: int) -> DataFrame:
    """By type: how many samples were taken, how far their share is from an equal one, and the share of the graph's nodes that they touch.

    ``selected`` has id and type, ``touched`` id and node.
    """
    counts = selected.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    state = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"))  # one row
    covered = selected.join(touched, "id").groupBy("type", "node").agg(F.lit(1).alias("one")).groupBy("type").agg(F.count(F.lit(1)).alias("covered_nodes"))
    out = counts.join(covered, "type", "left").join(F.broadcast(state))
    rate = lambda a, b: F.round(a / b, 4)
    return out.select("type", "n", rate(F.col("n"), F.col("total")).alias("share"), F.round(F.col("n") / F.col("total") - F.lit(1.0) / F.col("types"), 4).alias("deviation"), F.coalesce("covered_nodes", F.lit(0)).alias("covered_nodes"), rate(F.coalesce("covered_nodes", F.lit(0)), F.lit(max(n_nodes, 1))).alias("coverage"))


def top_by_needles(rows: DataFrame, group: str, text: str, key: str, needles: list[str], k: int) -> DataFrame:
    """Of each group the ``k`` texts that hold most of ``needles``, in any case; those that hold none never."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = sum((F.when(F.contains(low, F.lit(n.lower())), 1).otherwise(0) for n in dict.fromkeys(needles)), F.lit(0))
    scored = rows.withColumn("hits", hits).filter("hits > 0").withColumn("_order", F.struct((-F.col("hits")).alias("hits"), F.col(key).alias("key")))
    return within_group(scored, [group], "_order", k).withColumnRenamed("_r", "place").drop("_order")
