"""Choosing samples so that nodes get their quotas, or so that as many nodes as possible are covered."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.plans.ranks import within_group
from factloom.plans.storage import broadcast_if_small, drop_stored, new_path, stored

#: Items that a round of greedy choices brings to the driver at most.
PULLED = 50_000


def draw(seed: int, *names: str) -> Column:
    """A pseudorandom text by which rows are ordered, from the seed and the columns alone."""
    return F.sha1(F.concat_ws("|", F.lit(str(seed)), *(F.col(n).cast("string") for n in names)))


def type_targets(ratios: dict[str, float], total: int) -> dict[str, int]:
    return {t: int(round(max(0.0, r) * total)) for t, r in ratios.items()}


def allocated_by_node(touched: DataFrame, nodes: DataFrame, targets: dict[str, int], seed: int = 7) -> DataFrame:
    """id, type, node, tier and round of the samples picked for the nodes' quotas.

    ``touched`` has id, type and node, a row for each node that a sample
    touches; ``nodes`` has node, tier and quota; ``targets`` says how many
    samples of each type are wanted in all. Tiers are served T1 first. In a
    round every node that lacks samples asks for one, of the type that is
    farthest behind its target, then of the type of which the node has most
    left, then the first by name; of these samples the first by a draw. A
    sample that many ask for goes to one of them by a draw. A type gives as
    many in a round as it is behind, or half of what it is asked for if that is
    more; the others ask again. So types stay near their targets, each sample
    is picked once, and rounds grow with the logarithm of the nodes.

    Rows with a null id or node are ignored; a type without a target is behind by nothing.
    """
    spark = touched.sparkSession
    kinds = dict(touched.dtypes)
    demand = stored(nodes.select("node", "tier", F.col("quota").alias("want")).filter("want > 0"), "demand")
    all_ = stored(touched.select("id", "type", "node").dropna(subset=["id", "node"]).distinct(), "touched")
    types = [r["type"] for r in all_.select("type").distinct().collect()]  # a row for each type
    path, rounds, have = new_path(spark, "picks"), 0, dict.fromkeys(types, 0)
    none = spark.createDataFrame([], f"id {kinds['id']}, type string, node {kinds['node']}, tier string, round int")
    picks = none
    for tier in ("T1", "T2", "T3"):
        # a tier's rounds read what its own nodes touch
        own = stored(all_.join(broadcast_if_small(demand.filter(F.col("tier") == tier).select("node").distinct()), "node", "left_semi").withColumn("draw", draw(seed, "id")), "touched")
        while True:
            behind = {t: targets.get(t, 0) - n for t, n in have.items()}
            # picks are fewer than quotas; what is open and lacking follows from them, so that no round writes it again
            got = broadcast_if_small(picks.filter(F.col("tier") == tier).groupBy("node").agg(F.count(F.lit(1)).alias("got")))
            lacking = demand.filter(F.col("tier") == tier).join(got, "node", "left").filter(F.col("want") > F.coalesce("got", F.lit(0))).select("node", "tier")
            asked = own.join(broadcast_if_small(lacking), "node").join(broadcast_if_small(picks.select("id")), "id", "left_anti")
            by_type = asked.groupBy("node", "tier", "type").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("draw", "id")).alias("first"))
            state = F.lit(0).cast("bigint")
            for t, m in behind.items():
                state = F.when(F.col("type").eqNullSafe(F.lit(t)), m).otherwise(state)
            choice = by_type.groupBy("node", "tier").agg(F.min_by(F.struct("type", "first"), F.struct((-state).alias("b"), (-F.col("n")).alias("n"), "type")).alias("c"))
            choice = choice.select("node", "tier", F.col("c.type").alias("type"), F.col("c.first.id").alias("id"), draw(seed, "node").alias("turn"))
            won = choice.groupBy("id", "type").agg(F.min(F.struct("turn", "node", "tier")).alias("w")).withColumn("order", F.struct("w.turn", "w.node", "id"))
            won = stored(won, "won")
            sizes = {r["type"]: r["n"] for r in won.groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()}
            if not sizes:
                drop_stored(won)
                break
            most = {t: min(n, max(behind[t], -(-n // 2))) for t, n in sizes.items()}
            cut = [t for t, n in sizes.items() if n > most[t]]
            taken = won
            if cut:  # the first of these by a draw
                limit = F.lit(0)
                for t, m in most.items():
                    limit = F.when(F.col("type").eqNullSafe(F.lit(t)), m).otherwise(limit)
                taken = within_group(won, ["type"], "order").filter(F.col("_r") <= limit)
            rounds += 1
            taken.select("id", "type", "w.node", "w.tier", F.lit(rounds).alias("round")).write.mode("append").parquet(path)
            drop_stored(won)
            picks = spark.read.parquet(path)
            have = {t: n + most.get(t, 0) for t, n in have.items()}
    return picks


def quota_gaps(picked: DataFrame, nodes: DataFrame) -> DataFrame:
    """By tier: nodes, what they were to get and got, and how many nodes got too little."""
    got = picked.groupBy("node").agg(F.count(F.lit(1)).alias("got"))
    both = nodes.join(got, "node", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    return both.groupBy("tier").agg(F.count(F.lit(1)).alias("nodes"), F.sum("quota").cast("bigint").alias("wanted"), F.sum("got").alias("got"), F.count_if(F.col("got") < F.col("quota")).alias("short"))


class _Greedy:
    """Greedy cover over a table of (id, stratum, item), some of whose best candidates are looked at on the driver at a time."""

    def __init__(self, candidates: DataFrame):
        self.spark = candidates.sparkSession
        self.kind = dict(candidates.dtypes)["id"]
        each = candidates.filter(F.col("id").isNotNull())
        self.ids = each.select("id", "stratum")
        self.items = stored(each.select("id", "stratum", F.explode("items").alias("item")).filter(F.col("item").isNotNull()).distinct(), "items")
        self.chosen: dict = {}
        self.rounds = 0

    def _picked(self, ids) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame([(i,) for i in ids], f"id {self.kind}"))  # picks, as many as asked for at most

    def _left(self, where: Column) -> DataFrame:
        """What candidates have that no chosen one has."""
        some = self.items.filter(where)
        if not self.chosen:
            return some
        covered = self.items.join(self._picked(self.chosen), "id", "left_semi").select("item").distinct()
        return some.join(broadcast_if_small(covered), "item", "left_anti")

    def step(self, where: Column, most: int) -> list[tuple]:
        """(id, gain) of the next picks, one at least while there is a gain.

        Gains are counted exactly once. Of the best candidates, the items are
        looked at here, and each pick only lowers gains, so that counts are
        bounds: the best by its bound is counted again, and picked if it still
        beats the next bound and all candidates that were not looked at.
        """
        self.rounds += 1
        left = self._left(where)
        gains = left.groupBy("id").agg(F.count(F.lit(1)).alias("gain"))
        top = [(-r["gain"], r["id"]) for r in gains.orderBy(F.desc("gain"), "id").limit(4 * most + 1).collect()]
        if not top:
            return []
        n, total = 1, -top[0][0]
        while n < len(top) and n < 4 * most and total - top[n][0] <= PULLED:
            total -= top[n][0]
            n += 1
        rest = top[n] if n < len(top) else (0, None)
        if n == 1:  # the best is the best, whatever it holds
            return [(top[0][1], -top[0][0])]
        held: dict = {}
        for r in left.join(self._picked(i for _, i in top[:n]), "id", "left_semi").select("id", "item").collect():
            held.setdefault(r["id"], set()).add(r["item"])
        heap, seen, out = top[:n], set(), []
        heapq.heapify(heap)
        while heap and len(out) < most:
            bound, i = heapq.heappop(heap)
            now = (-len(held[i] - seen), i)
            if now[0] != bound:
                if now[0]:
                    heapq.heappush(heap, now)
                continue
            if rest[1] is not None and now > rest:
                break
            out.append((i, -bound))
            seen |= held[i]
        return out

    def take(self, picks: list[tuple]) -> None:
        self.chosen |= dict(picks)

    def fill(self, where: Column, most: int) -> list[tuple]:
        """The first by id that are not chosen, for no gain."""
        rest = self.ids.filter(where)
        rest = rest.join(self._picked(self.chosen), "id", "left_anti") if self.chosen else rest
        return [(r["id"], 0) for r in rest.select("id").distinct().orderBy("id").limit(most).collect()]


def _as_rows(spark, rows: list[tuple], kind: str) -> DataFrame:
    return spark.createDataFrame(rows, f"pick int, id {kind}, phase int, gain long")


def greedy_cover(candidates: DataFrame, picks: int, stop_at_no_gain: bool = True) -> DataFrame:
    """pick, id and gain of up to ``picks`` candidates (id, items), each adding most items that none before it has; ties to the least id.

    ``picks`` is a limit of the feature. A round is one aggregation over what
    is uncovered and gives as many picks as are certain.
    """
    greedy, every = _Greedy(candidates.withColumn("stratum", F.lit(""))), F.lit(True)
    while len(greedy.chosen) < picks and (found := greedy.step(every, picks - len(greedy.chosen))):
        greedy.take(found)
    if not stop_at_no_gain and len(greedy.chosen) < picks:
        greedy.take(greedy.fill(every, picks - len(greedy.chosen)))
    rows = [(n, i, 1, g) for n, (i, g) in enumerate(greedy.chosen.items(), 1)]
    return _as_rows(candidates.sparkSession, rows, greedy.kind).drop("phase")


def balanced_subset(candidates: DataFrame, cap: int, budget: int) -> DataFrame:
    """pick, id, phase and gain: of each stratum up to ``cap`` candidates by what they add, then others by what they add.

    ``candidates`` has id, stratum and items, in one row or in several; dealt
    out by id, they are told apart where they lie. Strata are served by name, each
    greedily over what all before left uncovered, ties to the least id, also
    when nothing more is added. Then, whatever the stratum, candidates that
    add something follow until ``budget`` are picked or nothing is left to add.
    A null stratum is one of its own; null ids and items are ignored.
    """
    greedy = _Greedy(candidates)
    phase: dict = {}
    for r in greedy.ids.select("stratum").distinct().orderBy("stratum").collect():
        own, n = F.col("stratum").eqNullSafe(F.lit(r["stratum"])), len(greedy.chosen) + cap
        while len(greedy.chosen) < n and (found := greedy.step(own, n - len(greedy.chosen))):
            greedy.take(found)
        if len(greedy.chosen) < n:
            greedy.take(greedy.fill(own, n - len(greedy.chosen)))
    phase = dict.fromkeys(greedy.chosen, 1)
    while len(greedy.chosen) < budget and (found := greedy.step(F.lit(True), budget - len(greedy.chosen))):
        greedy.take(found)
    return _as_rows(candidates.sparkSession, [(n, i, phase.get(i, 2), g) for n, (i, g) in enumerate(greedy.chosen.items(), 1)], greedy.kind)
