"""Mixing sources to target weights (problem 8).

Method: hierarchical budgeting over trees of domain, language and source. Weights go up the tree, budgets down; a
node that cannot use its budget, even with every document used ``max_repeats`` times, leaves the rest to its
siblings, and only what all of them together cannot use goes to the siblings of their parent. Each leaf then takes
whole epochs of its documents and the beginning of one more, in an order seeded by plan, leaf and epoch.

Only sums by leaf (source and language, not documents) reach the driver.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheafline.session import cut

#: Parts by hash of an epoch of a leaf; one part is ordered exactly, so it must fit in a task.
PARTS = 4096


class Node:
    def __init__(self) -> None:
        self.children: dict[str, Node] = {}
        self.weight = self.capacity = self.budget = 0.0
        self.leaf: tuple | None = None

    def total(self) -> None:
        for c in self.children.values():
            c.total()
        if self.children:
            self.weight = sum(c.weight for c in self.children.values())
            self.capacity = sum(c.capacity for c in self.children.values())

    def fill(self, amount: float) -> None:
        """Gives ``amount`` (at most the capacity) to the children by weight; what one cannot use its siblings share."""
        self.budget = amount = min(amount, self.capacity)
        open_ = [c for _, c in sorted(self.children.items())]
        given = {id(c): 0.0 for c in open_}
        while open_ and amount > 1e-9:
            weight = sum(c.weight for c in open_)
            share = {id(c): amount * (c.weight / weight if weight else 1 / len(open_)) for c in open_}
            full = [c for c in open_ if given[id(c)] + share[id(c)] >= c.capacity]
            for c in full or open_:
                use = min(share[id(c)], c.capacity - given[id(c)]) if full else share[id(c)]
                given[id(c)] += use
                amount -= use
            if not full:
                break
            open_ = [c for c in open_ if c not in full]
        for c in self.children.values():
            c.fill(given[id(c)])


def budgets(targets: list[dict], sizes: list[tuple[str, str, int]], total: int, domains: dict[str, str] | None = None) -> list[tuple]:
    """(plan, source, lang, tokens of the leaf, budget) of each leaf; domains: source -> domain, other sources form a domain of their own; targets: rows of the plans; sizes: source, lang, tokens."""
    by_source: dict[str, list[tuple[str, int]]] = defaultdict(list)
    for source, lang, n in sizes:
        by_source[source].append((lang, n))
    plans: dict[str, list[dict]] = defaultdict(list)
    for t in targets:
        if t["plan_name"] is not None and t["source"] is not None and (t["target_share"] or 0) > 0:
            plans[t["plan_name"]].append(t)
    out = []
    for plan, rows in sorted(plans.items()):
        root, leaves = Node(), []
        for t in rows:
            size = sum(n for _, n in by_source.get(t["source"], ()))
            domain = (domains or {}).get(t["source"], t["source"])
            for lang, n in by_source.get(t["source"], ()) or [("und", 0)]:
                node = root
                for name in (domain, lang, t["source"]):
                    node = node.children.setdefault(name, Node())
                node.weight += t["target_share"] * (n / size if size else 1)
                node.capacity += n * max(t["max_repeats"] or 1, 0)
                node.leaf = (plan, t["source"], lang, n)
                leaves.append(node)
        root.total()
        root.fill(total * max(r["budget_ratio"] or 0 for r in rows))
        out += [(*n.leaf, n.budget) for n in dict.fromkeys(leaves)]
    return out


def mix(documents: DataFrame, targets: DataFrame, sizes: DataFrame | None = None, seed: int = 7, parts: int = PARTS, domains: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(selection, shares).

    domains: source -> domain, the upper level of the trees; a source that is not named forms a domain of its own.
    documents: doc_id, text, source, lang; sizes: doc_id, source, lang, n_tokens if already counted.
    selection: plan_name, source, lang, doc_id, uses, n_tokens; one row for each document used by a plan, ``uses`` times.
    shares: plan_name, source, target_share (sums to 1 in a plan), wanted_tokens, actual_tokens, actual_share, most_uses.

    Texts without tokens (null, empty) are never selected, having no size; a null language counts as ``und``; a null
    source is in no plan but counts in the total; sources without documents get nothing and their share goes on.
    Repeated target rows count once; repeated documents are documents. A document is taken if at least half of
    it lies in the budget of its leaf, so a leaf misses its budget by half a document at most.
    """
    from sheafline.llm.tokens import count_tokens

    if sizes is None:
        lang = F.coalesce("lang", F.lit("und")).alias("lang")
        sizes = cut(count_tokens(documents.select("doc_id", "source", lang, "text"), ["doc_id", "source", "lang"], "text"))
    spark = sizes.sparkSession
    wanted = targets.select("plan_name", "source", "target_share", "max_repeats", "budget_ratio").distinct()
    plans = [r.asDict() for r in wanted.collect()]  # fixed, a few rows a plan
    named = [s for s in {p["source"] for p in plans} if s is not None]
    total = sizes.agg(F.sum("n_tokens")).head()[0] or 0
    leaf_sizes = [(r[0], r[1], r[2]) for r in sizes.where(F.col("source").isin(named)).groupBy("source", "lang").agg(F.sum("n_tokens")).collect()]  # sources by languages
    leaves = budgets(plans, leaf_sizes, total, domains)
    schema = "plan_name string, source string, lang string, leaf_tokens bigint, budget double"
    tree = spark.createDataFrame(leaves, schema)
    tree = tree.withColumns({"full": F.when(F.col("leaf_tokens") > 0, F.floor(F.col("budget") / F.col("leaf_tokens") + 1e-12)).otherwise(0).cast("int")})
    tree = tree.withColumn("rest", F.greatest(F.col("budget") - F.col("full") * F.col("leaf_tokens"), F.lit(0.0)))  # a full leaf may miss its capacity by a rounding error
    order = F.xxhash64(F.lit(seed), "plan_name", "source", "lang", "full", "doc_id")
    rows = (
        sizes.where(F.col("n_tokens") > 0)
        .join(F.broadcast(tree), ["source", "lang"])  # plans by leaves, not documents
        .withColumns({"order": order, "part": F.pmod(F.shiftright(order, 20), F.lit(parts)).cast("int")})
    )
    keys = ["plan_name", "source", "lang"]
    sums = rows.groupBy(*keys, "part", "rest").agg(F.sum("n_tokens").alias("tokens"))
    run = Window.partitionBy(*keys).orderBy("part")
    sums = sums.withColumn("before", F.sum("tokens").over(run) - F.col("tokens"))
    edge = sums.where(F.col("before") <= F.col("rest")).groupBy(*keys).agg(F.max("part").alias("edge"), F.max_by("before", "part").alias("before"))
    rows = rows.join(F.broadcast(edge), keys, "left").na.fill(-1, ["edge"])  # one row a leaf; without an edge whole epochs only
    inner = rows.where(F.col("part") != F.col("edge")).withColumn("more", (F.col("part") < F.col("edge")).cast("int"))
    at_edge = rows.where(F.col("part") == F.col("edge"))
    upto = Window.partitionBy(*keys).orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("n_tokens").over(upto), F.lit(0))
    at_edge = at_edge.withColumn("more", (start + F.col("n_tokens") / 2 <= F.col("rest")).cast("int"))
    chosen = inner.unionByName(at_edge).withColumn("uses", F.col("full") + F.col("more")).where(F.col("uses") > 0)
    selection = chosen.select(*keys, "doc_id", "uses", "n_tokens")
    share = F.col("target_share") / F.sum("target_share").over(Window.partitionBy("plan_name"))
    goals = wanted.where(F.col("target_share") > 0).groupBy("plan_name", "source").agg(F.sum("target_share").alias("target_share"), F.max("budget_ratio").alias("ratio"))
    goals = goals.withColumn("target_share", share).withColumn("wanted_tokens", F.col("target_share") * F.col("ratio") * F.lit(total))
    got = selection.groupBy("plan_name", "source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("actual_tokens"), F.max("uses").alias("most_uses"))
    shares = goals.drop("ratio").join(got, ["plan_name", "source"], "left").na.fill(0, ["actual_tokens", "most_uses"])
    of_plan = F.sum("actual_tokens").over(Window.partitionBy("plan_name"))
    return selection, shares.withColumn("actual_share", F.when(of_plan > 0, F.col("actual_tokens") / of_plan).otherwise(0.0))
