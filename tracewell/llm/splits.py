"""Problem 5: splits that keep related records together.

Prompts are connected components of ids and logged questions. Components of the same label profile
(and so of the same size) form a bundle; minimum-cost flows settle how many components of each bundle
go to each split; members are taken in order of a hash.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.labels import label_key, prompt_key, text_key
from tracewell.llm.components import connected_components
from tracewell.llm.lookup import MOST_NARROW, looked_up
from tracewell.operators.ranking import ranked
from tracewell.operators.records import one_per_key
from tracewell.session import cut


def _logged_pairs(logged: DataFrame) -> DataFrame:
    """Distinct (prompt_id, question), materialised: else the optimiser would make the keys, which are
    regular expressions, on every logged row before the rows are made distinct."""
    return cut(logged.select("prompt_id", "question").distinct())


def prompt_graph(logged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``prompt_id``, ``node``) of each distinct id, and (``node``, ``component``) of all linked keys."""
    seen = _logged_pairs(logged).select("prompt_id", prompt_key(F.col("prompt_id")).alias("u"), text_key(F.col("question")).alias("v"))
    ids = seen.select("prompt_id", F.col("u").alias("node")).where("node is not null").distinct()
    return ids, connected_components(seen.select("u", "v"))


def prompt_components(logged: DataFrame) -> DataFrame:
    """``prompt_id`` (each distinct non-null value), ``node``, ``component`` from prompt_id, question.

    Two values share a component if they are spellings of one id, were logged with the same
    question apart from case and white space, or one is the question of the other, also through
    further values. Blank ids and questions link nothing; a blank id isn't in the result.
    """
    ids, found = prompt_graph(logged)
    return ids.join(found, "node", "left").select("prompt_id", "node", F.coalesce("component", "node").alias("component"))


def node_components(logged: DataFrame) -> DataFrame:
    """``node``, ``component`` for every id key and question key that the log links."""
    return prompt_graph(logged)[1]


def same_prompt_pairs(logged: DataFrame) -> DataFrame:
    """``prompt_id_a`` < ``prompt_id_b`` (by code point): different values of one prompt.

    The pairs asked for are the result itself; only spellings within one prompt are paired.
    """
    ids = prompt_components(logged).select("prompt_id", "component")
    a = ids.withColumnRenamed("prompt_id", "prompt_id_a")
    b = ids.withColumnRenamed("prompt_id", "prompt_id_b")
    return a.join(b, "component").where("prompt_id_a < prompt_id_b").select("prompt_id_a", "prompt_id_b")


class MinCostFlow:
    """Successive shortest paths (Bellman-Ford) on a small graph with integral capacities."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[float] = []

    def arc(self, a: int, b: int, cap: int, cost: float) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, s: int, t: int, amount: int) -> int:
        sent = 0
        while sent < amount:
            dist, via = {s: 0.0}, {}
            queue = [s]
            while queue:
                nxt = []
                for a in queue:
                    for e in self.out[a]:
                        b, d = self.to[e], dist[a] + self.cost[e]
                        if self.cap[e] > 0 and d < dist.get(b, math.inf) - 1e-9:
                            dist[b], via[b] = d, e
                            nxt.append(b)
                queue = list(dict.fromkeys(nxt))
            if t not in dist:
                break
            path, at = [], t
            while at != s:
                path.append(via[at])
                at = self.to[via[at] ^ 1]
            push = min([amount - sent, *(self.cap[e] for e in path)])
            for e in path:
                self.cap[e] -= push
                self.cap[e ^ 1] += push
            sent += push
        return sent


#: Marginal costs of a split are exact for so many components of one size, and in so many equal steps beyond.
STEPS = 1024

#: Rows of each label in a component, in order of label.
Profile = tuple[tuple[str, int], ...]


def settle_quotas(bundles: list[tuple[Profile, int]], shares: dict[str, float]) -> dict[Profile, dict[str, int]]:
    """Components per bundle (label profile, count) and split.

    The relaxed allocation gives each split its share of every bundle, or of what its labels still lack there
    once larger components are placed, which meets all quotas exactly; its whole parts stand, as far as a split
    still has room. What is left over is placed from the largest size to
    the least, all bundles of a size by one flow bundle -> split -> sink. Its costs are the growth of the
    squared deviation of a split from its quota, in rows, and, a hundredth of it, of each label within a
    split, so the rounding of one size makes good for that of the sizes before.
    """
    names = sorted(shares)
    size = {p: sum(c for _, c in p) for p, _ in bundles}
    total = sum(size[p] * n for p, n in bundles)
    of_label: dict[str, int] = defaultdict(int)
    for p, n in bundles:
        for lab, c in p:
            of_label[lab] += c * n
    quota = {s: shares[s] * total for s in names}
    label_quota = {(lab, s): shares[s] * r for lab, r in of_label.items() for s in names}
    have: dict[str, float] = dict.fromkeys(names, 0.0)
    label_have: dict[tuple[str, str], float] = dict.fromkeys(label_quota, 0.0)
    out: dict[Profile, dict[str, int]] = {}

    def give(p: Profile, s: str, n: int) -> None:
        have[s] += n * size[p]
        for lab, c in p:
            label_have[lab, s] += n * c

    by_size: dict[int, list[tuple[Profile, int]]] = defaultdict(list)
    for p, n in bundles:
        by_size[size[p]].append((p, n))
    for z in sorted(by_size, reverse=True):
        left: dict[Profile, int] = {}
        for p, n in sorted(by_size[z]):
            out[p] = {}
            # the share of a split is what its labels still lack there, which is the target share at first
            lack = {(lab, s): max(0.0, label_quota[lab, s] - label_have[lab, s]) for lab, _ in p for s in names}
            of = {lab: sum(lack[lab, s] for s in names) or 1.0 for lab, _ in p}
            part = {s: sum(c * lack[lab, s] / of[lab] for lab, c in p) / z for s in names}
            for s in names:
                whole = math.floor(n * part[s] + 1e-9)
                out[p][s] = max(0, min(whole, math.floor((quota[s] - have[s]) / z + 1e-9)))
                give(p, s, out[p][s])
            left[p] = n - sum(out[p].values())
        units = sum(left.values())
        if not units:
            continue
        open_ = [p for p in sorted(left) if left[p]]
        flow = MinCostFlow(2 + len(open_) + len(names))
        arcs = {}
        for i, p in enumerate(open_):
            flow.arc(0, 2 + i, left[p], 0)
            for j, s in enumerate(names):
                cost = sum(c * (2 * (label_have[lab, s] - label_quota[lab, s]) + c) for lab, c in p)
                arcs[p, s] = flow.arc(2 + i, 2 + len(open_) + j, left[p], 0.01 * cost / max(1, total))
        steps = min(units, STEPS)
        for j, s in enumerate(names):
            # marginal costs of a convex deviation, as parallel arcs of growing cost
            done = 0
            for k in range(steps):
                n = (units - done) // (steps - k)
                flow.arc(2 + len(open_) + j, 1, n, z * (2 * (have[s] + done * z - quota[s]) + n * z) / max(1, total))
                done += n
        flow.run(0, 1, units)
        for (p, s), e in arcs.items():
            out[p][s] += flow.cap[e ^ 1]
            give(p, s, flow.cap[e ^ 1])
    return out


def _raw_key(c: Column) -> Column:
    """128 bits of hash of a value as it stands; null for null."""
    return F.when(c.isNotNull(), F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(17), c).alias("b")))


def placed_rows(records: DataFrame) -> DataFrame:
    """``candidate_id``, ``label``, ``component`` of each distinct candidate, materialised.

    A row without an id goes by its question, and one without either is a prompt of its own. Ids and questions
    are read once per distinct pair; rows carry the hashes of theirs.
    """
    pairs = _logged_pairs(records)
    seen = cut(pairs.select(_raw_key(F.col("prompt_id")).alias("p"), _raw_key(F.col("question")).alias("q"), prompt_key(F.col("prompt_id")).alias("u"), text_key(F.col("question")).alias("v")))
    found = connected_components(seen.select("u", "v"))

    def part_of(raw: str, node: str, name: str) -> DataFrame:
        nodes = seen.where(f"{raw} is not null and {node} is not null").groupBy(raw).agg(F.min(node).alias("node"))
        return cut(nodes.join(found, "node", "left").select(raw, F.coalesce("component", "node").alias(name)))

    rows = one_per_key(records.select("candidate_id", _raw_key(F.col("prompt_id")).alias("p"), _raw_key(F.col("question")).alias("q"), "dataset"), "candidate_id")
    rows = cut(rows.select("candidate_id", "p", "q", F.coalesce(F.regexp_replace(label_key("dataset"), "(train|test|validation|valid|val|dev)$", ""), F.lit("")).alias("label")))
    by_id, by_question = part_of("p", "u", "component"), part_of("q", "v", "component")
    cols = ["candidate_id", "label", "component"]
    known = looked_up(rows, by_id, "p").select(*cols)
    # ids that are null or blank: few keys are missing, so this side is small or its questions are many
    rest = cut(rows.join(F.broadcast(by_id.select("p")) if by_id.limit(MOST_NARROW + 1).count() <= MOST_NARROW else by_id.select("p"), "p", "left_anti"))
    asked = looked_up(rest, by_question, "q").select(*cols)
    own = F.concat(F.lit("row:"), F.coalesce(F.col("candidate_id").cast("string"), F.lit("")))
    alone = rest.join(by_question.select("q"), "q", "left_anti").select("candidate_id", "label", own.alias("component"))
    return cut(known.unionByName(asked).unionByName(alone))


def assign_splits(records: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """``candidate_id``, ``label``, ``component``, ``split`` for each distinct candidate.

    ``records``: candidate_id, prompt_id, question, dataset. Rows are placed by :func:`placed_rows`. Shares are
    divided by their sum. The driver holds one entry per distinct label profile of a component; there are at
    most sqrt(2 x rows) sizes. Ties and repeated rows don't matter: order is by hash and then by component.
    """
    placed = placed_rows(records)
    per = placed.groupBy("component", "label").agg(F.count("*").alias("n")).groupBy("component").agg(F.array_sort(F.collect_list(F.struct("label", "n"))).alias("profile"))
    members = cut(per.select("component", F.to_json("profile").alias("bundle"), "profile"))
    counted = members.groupBy("bundle").agg(F.count("*").alias("n"), F.first("profile").alias("profile")).collect()
    key_of = {tuple((x["label"], x["n"]) for x in r["profile"]): r["bundle"] for r in counted}
    bundles = [(tuple((x["label"], x["n"]) for x in r["profile"]), r["n"]) for r in counted]
    shares = {r["split"]: float(r["share"]) for r in targets.where("split is not null and share > 0").collect()}
    if not shares:
        raise ValueError("no split has a share")
    shares = {s: x / sum(shares.values()) for s, x in shares.items()}
    plan = []
    for p, x in settle_quotas(bundles, shares).items():
        at = 0
        for s in sorted(x):
            if x[s]:
                plan.append((key_of[p], s, at + 1, at + x[s]))
                at += x[s]
    plan_df = records.sparkSession.createDataFrame(plan, "bundle string, split string, lo long, hi long")
    order = ranked(members.select("component", "bundle"), ["bundle"], [F.xxhash64(F.lit(seed), "component"), F.col("component")])
    chosen = cut(order.join(plan_df, "bundle").where("position between lo and hi").select("component", "split"))
    return looked_up(placed, chosen, "component").select("candidate_id", "label", "component", "split")


def split_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """Per split: prompts, rows, share reached and share wanted; splits without rows stand with zeros."""
    got = assigned.groupBy("split").agg(F.countDistinct("component").alias("prompts"), F.count("*").alias("rows"))
    whole = F.sum("rows").over(Window.partitionBy(F.lit(0)))  # one row per split
    return targets.where("split is not null").select("split", F.col("share").alias("target_share")).join(got, "split", "left").fillna(0, ["prompts", "rows"]).withColumn("share", F.try_divide(F.col("rows"), whole))
