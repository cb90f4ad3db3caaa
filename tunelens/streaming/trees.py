"""Incremental decision trees, one-against-rest trees and bagged forests.

A tree is its tests, which the driver holds, and its leaves, which are rows of a table: class sums, centred moments and
value counts, the leaf's own prediction, and what it remembers of earlier attempts. Each batch is one job: rows are routed
by an expression built from the tests, meet the predictions of their leaves, and shrink to sums per leaf and class; these
are merged into the leaf rows, which try their splits where they are. Only confusion counts and the splits that won reach
the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tunelens.session import dropped, scratch_path
from tunelens.streaming import moments
from tunelens.streaming.evaluate import Classifier
from tunelens.streaming.splits import CRITERIA, Split, best_split, hoeffding_bound

BROADCAST_LEAVES = 20_000
#: Leaves that one task merges and scores, at the least.
LEAVES_PER_TASK = 16
SD_FLOOR = 1e-9
NO_CHANCE = -1e300


@dataclass(frozen=True)
class Feature:
    """A double column; a nominal one holds value indices 0..values-1."""

    name: str
    values: int = 0


@dataclass(frozen=True)
class TreeOptions:
    criterion: str = "InfoGainSplitCriterion"
    growth: bool = True
    binary_only: bool = False
    grace: float = 200
    tie: float = 0.05
    confidence: float = 1e-7
    leaf_kind: int = 2  # 0 majority class, 1 naive Bayes, 2 whichever was right more often at the leaf
    nb_threshold: float = 0
    no_pre_prune: bool = False
    remove_poor: bool = False
    max_depth: int = 20

    def __post_init__(self):
        if self.criterion not in CRITERIA:
            raise ValueError(f"unknown criterion {self.criterion}")


@dataclass
class Node:
    """A test with children, or a leaf. ``inherited`` are the class weights a leaf is born with."""

    depth: int
    attr: int = -1
    kind: str = ""
    value: float = 0.0
    children: list[int] = field(default_factory=list)
    inherited: list[float] = field(default_factory=list)

    @property
    def is_leaf(self) -> bool:
        return not self.children


@dataclass
class Tree:
    """The tests of one tree; ``allowed`` limits the attributes it may use, ``subset`` draws some of them per leaf."""

    features: list[Feature]
    classes: int
    options: TreeOptions
    allowed: list[int]
    subset: int | None = None
    seed: int = 0
    nodes: list[Node] = field(default_factory=list)

    def __post_init__(self):
        self.nodes = self.nodes or [Node(0, inherited=[0.0] * self.classes)]

    def leaves(self) -> list[int]:
        return [i for i, n in enumerate(self.nodes) if n.is_leaf]

    @property
    def depth(self) -> int:
        return max(n.depth for n in self.nodes)

    def split(self, at: int, attr: int, kind: str, value: float, branches: list[list[float]]) -> list[int]:
        """Turn a leaf into a test; returns the new leaves."""
        node, first = self.nodes[at], len(self.nodes)
        self.nodes += [Node(node.depth + 1, inherited=[float(v) for v in b]) for b in branches]
        node.attr, node.kind, node.value = attr, kind, value
        node.children = list(range(first, len(self.nodes)))
        return node.children

    def drawn(self, at: int) -> list[int]:
        """Attributes that the leaf may test."""
        if self.subset is None or self.subset >= len(self.allowed):
            return self.allowed
        ranked = sorted(self.allowed, key=lambda i: (mix_int(at * 1009 + i, self.seed), i))
        return sorted(ranked[: self.subset])

    # Routing -----------------------------------------------------------------------------------------------------

    def route(self) -> str:
        """SQL for the node number of the leaf a row falls into. NULL and unknown values take the last branch."""
        return self._walk() if self.depth else "0"

    def _walk(self) -> str:
        """Step down constant node arrays, one step per level: the expression does not grow with the tree's shape."""
        kinds = {"": 0, "numeric": 1, "one": 2, "many": 3}
        arrays = {
            "attr": [n.attr for n in self.nodes],
            "kind": [kinds[n.kind] for n in self.nodes],
            "value": [f"{n.value!r}D" for n in self.nodes],
            "fan": [len(n.children) for n in self.nodes],
            "first": [n.children[0] if n.children else -1 for n in self.nodes],
        }
        lit = {k: f"array({', '.join(map(str, v))})[node]" for k, v in arrays.items()}
        x = f"array({', '.join(f'`{f.name}`' for f in self.features)})[{lit['attr']}]"
        last = f"({lit['fan']} - 1)"
        step = (
            f"CASE WHEN {lit['kind']} = 1 THEN IF({x} <= {lit['value']}, 0, 1) "
            f"WHEN {lit['kind']} = 2 THEN IF({x} = {lit['value']}, 0, 1) "
            f"ELSE CAST(IF({x} >= 0 AND {x} < {last} AND {x} = floor({x}), {x}, {last}) AS INT) END"
        )
        return (
            f"aggregate(sequence(1, {self.depth}), 0, "
            f"(node, level) -> IF({lit['kind']} = 0, node, {lit['first']} + {step}))"
        )


# Leaves --------------------------------------------------------------------------------------------------------------

LEAF = """m int, leaf int, tried double, right_majority double, right_bayes double, poor array<int>, sums array<double>,
    majority int, shares array<double>, model struct<trusted: boolean, prior: array<double>, mean: array<array<double>>,
    deviation: array<array<double>>, share: array<array<array<double>>>>,
    counts array<struct<label: int, prediction: int, n: bigint>>,
    attr int, kind string, value double, branches array<array<double>>"""


class Layout:
    """Where a leaf's row of sums keeps what: per class its weight, then for a numeric feature count, mean, squared
    deviations, least and largest value, and for a nominal one the weight of each value."""

    def __init__(self, features: list[Feature], classes: int):
        self.features, self.classes = features, classes
        self.first, at = [], 1
        for f in features:
            self.first.append(at)
            at += f.values or 5
        self.width = at

    def empty(self) -> np.ndarray:
        row = np.zeros((self.classes, self.width))
        for f, at in zip(self.features, self.first):
            if not f.values:
                row[:, at + 3 : at + 5] = np.inf, -np.inf
        return row

    def absorb(self, row: np.ndarray, part: np.ndarray, pivots: list[float]) -> None:
        """Merge the sums of one batch, taken around ``pivots``, into a class's ``row``."""
        row[0] += part[0]
        for f, at, pivot in zip(self.features, self.first, pivots):
            if f.values:
                row[at : at + f.values] += part[at : at + f.values]
            elif part[at]:
                own = moments.from_sums(*part[at : at + 3], pivot)
                row[at : at + 3] = moments.merge(tuple(row[at : at + 3]), own)
                row[at + 3], row[at + 4] = min(row[at + 3], part[at + 3]), max(row[at + 4], part[at + 4])

    def absorb_all(self, sums: np.ndarray, own: tuple[np.ndarray, np.ndarray], parts: np.ndarray, pivots: list[float]) -> None:
        """What :meth:`absorb` does, for the (leaf, class) rows ``own`` of ``sums``, all different, and their ``parts``."""
        rows = sums[own]
        rows[:, 0] += parts[:, 0]
        for f, at, pivot in zip(self.features, self.first, pivots):
            if f.values:
                rows[:, at : at + f.values] += parts[:, at : at + f.values]
                continue
            new = np.flatnonzero(parts[:, at])
            row, part = rows[new, at : at + 5].T, parts[new, at : at + 5].T
            merged = moments.merge_all(row[:3], moments.from_sums_all(*part[:3], pivot))
            low, high = np.where(part[3] < row[3], part[3], row[3]), np.where(part[4] > row[4], part[4], row[4])
            rows[new, at : at + 5] = np.column_stack([*merged, low, high])
        sums[own] = rows

    def stats(self, sums: np.ndarray, i: int) -> dict:
        """What a split merit reads of feature ``i``, by class; ``sums`` are those of a leaf or, with an axis more in
        front, of many."""
        f, at = self.features[i], self.first[i]
        if f.values:
            return {"values": sums[..., at : at + f.values].swapaxes(-1, -2)}
        return {k: sums[..., at + j] for j, k in enumerate(("n", "mean", "m2", "min", "max"))}

    def columns(self, pivots: list[float]) -> Column:
        """The sums of a group of rows with weight ``w``, in this order."""
        out = ["sum(w)"]
        for f, pivot in zip(self.features, pivots):
            x = f"`{f.name}`"
            if f.values:
                out += [f"sum(IF({x} = {v}, w, 0.0D))" for v in range(f.values)]
                continue
            gap = f"({x} - ({pivot!r}D))"
            out += [f"sum(IF({x} IS NULL, 0.0D, w))", f"coalesce(sum(w * {gap}), 0.0D)", f"coalesce(sum(w * {gap} * {gap}), 0.0D)"]
            out += [f"coalesce(min(IF(w > 0, {x}, NULL)), double('inf'))", f"coalesce(max(IF(w > 0, {x}, NULL)), double('-inf'))"]
        return F.expr(f"array({', '.join(out)})")


def advance(leaf: dict, tree: Tree, layout: Layout, pivots: list[float], tries: bool = True) -> dict:
    """A leaf after a batch: ``parts`` are its sums by class and prediction. Tries to split it if it saw enough rows, unless
    ``tries`` is off."""
    sums = layout.empty() if leaf["sums"] is None else np.array(leaf["sums"]).reshape(layout.classes, layout.width)
    right_majority, right_bayes = leaf["right_majority"], leaf["right_bayes"]
    counts: dict[tuple[int, int], int] = {}
    order = ("y", "label", "prediction", "majority", "bayes")
    for p in sorted(leaf["parts"] or [], key=lambda p: tuple(-1 if p[k] is None else p[k] for k in order)):
        key = (p["label"], p["prediction"])
        counts[key] = counts.get(key, 0) + p["rows"]
        part = np.array(p["part"])
        if part[0] > 0:
            right_majority += part[0] if p["majority"] == p["y"] else 0.0
            right_bayes += part[0] if p["bayes"] == p["y"] else 0.0
            layout.absorb(sums[p["y"]], part, pivots)
    node, o = tree.nodes[leaf["leaf"]], tree.options
    out = {
        "m": leaf["m"], "leaf": leaf["leaf"], "tried": leaf["tried"], "right_majority": right_majority,
        "right_bayes": right_bayes, "poor": leaf["poor"] or [0] * len(layout.features), "sums": sums.ravel().tolist(),
        "counts": [{"label": y, "prediction": g, "n": n} for (y, g), n in counts.items()],
    }
    mass, seen = sums[:, 0], float(sums[:, 0].sum())
    due = o.growth and seen - leaf["tried"] >= o.grace and (mass > 0).sum() > 1 and node.depth < o.max_depth
    if due and tries:
        out["tried"] = seen
        split = _decide(tree, leaf["leaf"], sums, layout, out["poor"])
        if split is not None:
            return out | {
                "attr": split.attr, "kind": split.kind, "value": split.value, "branches": split.branches.tolist()}
    return out | _prediction(tree, node, sums, layout, right_majority, right_bayes)


def _decide(tree: Tree, at: int, sums: np.ndarray, layout: Layout, poor: list[int]) -> Split | None:
    """The split that wins at a leaf. Ties go to the lower attribute; ``poor`` counts attributes that fall behind."""
    o, mass = tree.options, sums[:, 0]
    found = []
    for i in tree.drawn(at):
        if poor[i] < 2:
            s = best_split(i, layout.stats(sums, i), mass, o.criterion, o.binary_only)
            if s is not None:
                found.append(s)
    if not found:
        return None
    found.sort(key=lambda s: (-s.merit, s.attr))
    best, second = found[0], found[1].merit if len(found) > 1 else 0.0
    bound = hoeffding_bound(float(mass.sum()), tree.classes, o.confidence, o.criterion)
    if o.remove_poor:
        for s in found:
            poor[s.attr] = poor[s.attr] + 1 if best.merit - s.merit > bound else 0
    if not o.no_pre_prune and best.merit <= 0:
        return None
    return best if best.merit - second > bound or bound < o.tie else None


def _prediction(tree: Tree, node: Node, sums: np.ndarray, layout: Layout, right_majority: float, right_bayes: float) -> dict:
    """What a leaf predicts: class shares, what it inherited at its birth included, and its naive Bayes model.

    The model holds log priors by class; per feature mean and deviation by class, or log shares by class and value. A
    feature the tree may not use has neither.
    """
    o = tree.options
    mass = np.asarray(node.inherited) + sums[:, 0]
    shares = mass / mass.sum() if mass.sum() > 0 else np.zeros_like(mass)
    out = {"majority": int(np.argmax(mass)), "shares": shares.tolist()}
    n, seen = sums[:, 0], float(sums[:, 0].sum())
    if not o.leaf_kind or not seen:
        return out
    trusted = seen > o.nb_threshold and (o.leaf_kind == 1 or right_bayes > right_majority)
    means, deviations, value_shares = [], [], []
    for i, f in enumerate(layout.features):
        s = layout.stats(sums, i)
        if i not in tree.allowed:
            means.append([0.0] * layout.classes)
            deviations.append([0.0] * layout.classes)
            value_shares.append([])
        elif f.values:
            smooth = np.log((s["values"] + 1.0) / (s["values"].sum(axis=0) + f.values))
            means.append([0.0] * layout.classes)
            deviations.append([0.0] * layout.classes)
            value_shares.append(smooth.T.tolist())
        else:
            means.append(s["mean"].tolist())
            sd = np.sqrt(s["m2"] / np.maximum(s["n"], 1e-300))
            deviations.append(np.maximum(sd, SD_FLOOR).tolist())
            value_shares.append([])
    prior = [float(np.log(v / seen)) if v > 0 else NO_CHANCE for v in n]
    model = {"trusted": bool(trusted), "prior": prior, "mean": means, "deviation": deviations, "share": value_shares}
    return out | {"model": model}


# Row weights ---------------------------------------------------------------------------------------------------------

_SPAN = 2**31


def mix_int(value: int, salt: int) -> int:
    """Integer mix below 2^31; the same steps as :func:`mix_sql`."""
    a = (value % _SPAN * 1103515245 + (value // _SPAN) % _SPAN * 69069 + (salt + 1) * 12345) % _SPAN
    a ^= a >> 15
    a = (a * 1664525 + (salt + 1) * 1013904223) % _SPAN
    a ^= a >> 13
    return (a * 22695477 + 1) % _SPAN


def mix_array(low: np.ndarray, high: np.ndarray, salt: int) -> np.ndarray:
    """:func:`mix_int` of many row numbers, given by their two parts below 2^31."""
    a = (low.astype(np.int64) * 1103515245 + high.astype(np.int64) * 69069 + (salt + 1) * 12345) % _SPAN
    a = ((a ^ (a >> 15)) * 1664525 + (salt + 1) * 1013904223) % _SPAN
    return ((a ^ (a >> 13)) * 22695477 + 1) % _SPAN


def mix_sql(value: str, salt: str) -> str:
    """SQL for a repeatable integer mix of a row number, below 2^31."""
    first = (
        f"pmod(pmod({value}, {_SPAN}L) * 1103515245L + pmod({value} div {_SPAN}L, {_SPAN}L) * 69069L "
        f"+ ({salt} + 1) * 12345L, {_SPAN}L)"
    )
    second = f"pmod(({first} ^ shiftright({first}, 15)) * 1664525L + ({salt} + 1) * 1013904223L, {_SPAN}L)"
    return f"pmod(({second} ^ shiftright({second}, 13)) * 22695477L + 1L, {_SPAN}L)"


def poisson_steps(rate: float) -> list[int]:
    """Cumulative Poisson probabilities scaled to 2^31, until the tail is empty."""
    if not 0 <= rate <= 500:  # beyond it exp(-rate) runs out of digits
        raise ValueError("a Poisson rate lies between 0 and 500")
    p, total, k, steps = float(np.exp(-rate)), 0.0, 0, []
    while total < 1 - 1e-9:
        total += p
        steps.append(int(total * _SPAN))
        k += 1
        p *= rate / k
    return steps


def poisson_sql(drawn: str, rate: float) -> str:
    """SQL for a Poisson draw: the inverse distribution function of a mixed number."""
    steps = poisson_steps(rate)
    whens = " ".join(f"WHEN {drawn} < {step}L THEN {k}.0D" for k, step in enumerate(steps))
    return f"CASE {whens} ELSE {len(steps)}.0D END"


# Ensembles -----------------------------------------------------------------------------------------------------------


class TreeLearner(Classifier):
    """Named trees trained side by side, each predicting for itself: one tree, a grid of settings, or ablations.

    ``home`` is the folder of the leaf tables, by default the shared scratch folder; a table is removed when the one
    after its successor is written.
    """

    votes = False
    key = None

    def __init__(
        self,
        features: list[Feature],
        classes: int,
        options: dict[str, TreeOptions],
        without: dict[str, list[str]] | None = None,
    ):
        self.features, self.classes = features, classes
        self.layout = Layout(features, classes)
        self.home: str | None = None
        self.pivots: list[float] | None = None
        self.written: list[str] = []  # leaf tables, the last one in force
        self.trees: dict[str, Tree] = {}
        for name, o in options.items():
            dropped_here = (without or {}).get(name, [])
            allowed = [i for i, f in enumerate(features) if f.name not in dropped_here]
            self.trees[name] = Tree(features, classes, o, allowed)
        self.fresh = [(m, 0) for m in range(len(self.trees))]  # leaves that are in no table yet

    def depths(self) -> dict[str, int]:
        return {name: t.depth for name, t in self.trees.items()}

    def state(self) -> dict:
        """The tests, and where the leaves are; it does not hold the leaves themselves."""
        return {
            "trees": {name: [asdict(n) for n in t.nodes] for name, t in self.trees.items()},
            "pivots": self.pivots, "leaves": self.written[-1] if self.written else None,
            "fresh": [list(x) for x in self.fresh],
        }

    def load(self, state: dict) -> None:
        for name, nodes in state["trees"].items():
            self.trees[name].nodes = [Node(**n) for n in nodes]
        self.pivots = state["pivots"]
        at = state["leaves"]
        self.written = self.written[: self.written.index(at) + 1] if at in self.written else [at] if at else []
        self.fresh = [tuple(x) for x in state["fresh"]]

    def leaves(self, spark: SparkSession) -> DataFrame:
        """One row per leaf of every tree: the table of the last batch without the leaves it split, and the new ones."""
        trees = list(self.trees.values())
        rows = []
        for m, at in self.fresh:
            mass = np.asarray(trees[m].nodes[at].inherited)
            shares = (mass / mass.sum() if mass.sum() > 0 else mass).tolist()
            rows.append((m, at, 0.0, 0.0, 0.0, None, None, int(np.argmax(mass)), shares, *[None] * 6))
        fresh = spark.createDataFrame(rows, LEAF)
        if not self.written:
            return fresh
        return spark.read.schema(LEAF).parquet(self.written[-1]).where("attr IS NULL").unionByName(fresh)

    def _small(self) -> bool:
        return sum(len(t.leaves()) for t in self.trees.values()) <= BROADCAST_LEAVES

    def _target(self) -> str:
        """SQL for the class a tree learns; ``m`` is the number of the tree."""
        return "label"

    def _weight(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("w", F.lit(1.0))

    def _vote(self) -> str:
        """SQL for the votes by class, from ``shares``: class shares by tree."""
        raise NotImplementedError

    # The same three for the Arrow batches of a whole replay.

    def targets(self, label: np.ndarray, m: int) -> np.ndarray:
        if len(label) and not (label.min() >= 0 and label.max() < self.classes):
            raise ValueError(f"a label is not one of {self.classes} classes")
        return label

    def weights_of(self, table, m: int) -> np.ndarray:
        return np.ones(table.num_rows)

    def votes_of(self, shares: list[np.ndarray]) -> np.ndarray:
        """Votes by row and class, from the class shares by row of every tree."""
        raise NotImplementedError

    def drawing(self) -> list[Column]:
        """Columns that the weights are drawn by."""
        return []

    def _routed(self, batch: DataFrame, kept: list[str]) -> DataFrame:
        """``kept`` columns, the leaf of every tree, and the class that ensembles vote for as ``vote``."""
        leaves = [f"leaf_{k}" for k in range(len(self.trees))]
        routed = batch.selectExpr(*kept, *[f"{t.route()} AS {c}" for c, t in zip(leaves, self.trees.values())])
        if not self.votes:
            return routed.selectExpr(*kept, *leaves, "CAST(NULL AS INT) AS vote")
        table = self.leaves(batch.sparkSession).select("m", "leaf", "shares")
        if self._small():
            # One row with the shares by tree and by place among the tree's leaves.
            by_tree = table.groupBy("m").agg(F.array_sort(F.collect_list(F.struct("leaf", "shares"))).alias("of"))
            packed = by_tree.agg(F.array_sort(F.collect_list(F.struct("m", "of"))).alias("known")).withColumn("one", F.lit(1))
            places = [
                f"known[{k}].of[array({', '.join(map(str, _places(t)))})[leaf_{k}]].shares"
                for k, t in enumerate(self.trees.values())
            ]
            rows = routed.withColumn("one", F.lit(1)).join(F.broadcast(packed), "one")
            rows = rows.withColumn("shares", F.expr(f"array({', '.join(places)})"))
        else:
            rows = routed.withColumn("row", F.monotonically_increasing_id())
            each = rows.selectExpr("*", f"posexplode(array({', '.join(leaves)})) AS (m, leaf)").join(table, ["m", "leaf"])
            same = Window.partitionBy("row")
            gathered = F.array_sort(F.collect_list(F.struct("m", "shares")).over(same))  # one entry a tree
            rows = each.withColumn("shares", F.transform(gathered, lambda s: s["shares"])).where("m = 0")
        votes = rows.withColumn("votes", F.expr(self._vote()))
        return votes.selectExpr(*kept, *leaves, "CAST(array_position(votes, array_max(votes)) - 1 AS INT) AS vote")

    def _spread(self, batch: DataFrame, others: list[str]) -> DataFrame:
        """One row per (row, tree): its leaf, and the vote of the ensemble. ``others`` are kept beside the features."""
        kept = [f"`{f.name}`" for f in self.features] + others
        leaves = ", ".join(f"leaf_{k}" for k in range(len(self.trees)))
        return self._routed(batch, kept).selectExpr(*kept, "vote", f"posexplode(array({leaves})) AS (m, leaf)")

    def _learning(self, batch: DataFrame) -> DataFrame:
        """One row per (row, tree) with the target ``y`` and the weight ``w``."""
        rows = self._spread(batch, ["label"] + ([self.key] if self.key else []))
        return self._weight(rows.withColumn("y", F.expr(f"CAST({self._target()} AS INT)")))

    def _predicted(self, rows: DataFrame) -> DataFrame:
        """Add the majority and the naive Bayes prediction of each leaf (NULL where it has none), and the one used.

        Ensembles vote by class shares, so their leaves need neither.
        """
        if self.votes:
            return rows.selectExpr("*", "CAST(NULL AS INT) AS majority", "CAST(NULL AS INT) AS bayes", "vote AS prediction")
        scores = f"array({', '.join(self._log_likelihood(c) for c in range(self.classes))})"
        models = self.leaves(rows.sparkSession).select("m", "leaf", "majority", "model")
        return (
            rows.join(F.broadcast(models) if self._small() else models, ["m", "leaf"])
            .withColumn("scores", F.expr(f"IF(model IS NULL, NULL, {scores})"))
            .withColumn("bayes", F.expr("CAST(array_position(scores, array_max(scores)) - 1 AS INT)"))
            .withColumn("prediction", F.expr("IF(coalesce(model.trusted, false), bayes, majority)"))
            .drop("model", "scores")
        )

    def _log_likelihood(self, c: int) -> str:
        terms = [f"model.prior[{c}]"]
        for i, f in enumerate(self.features):
            x = f"`{f.name}`"
            if f.values:
                known = f"size(model.share[{i}]) > 0 AND {x} >= 0 AND {x} < {f.values}"
                term = f"IF({known}, model.share[{i}][{c}][CAST({x} AS INT)], 0.0D)"
            else:
                sd, gap = f"model.deviation[{i}][{c}]", f"({x} - model.mean[{i}][{c}])"
                term = f"IF({sd} > 0, -ln({sd}) - {gap} * {gap} / (2 * {sd} * {sd}), 0.0D)"
            terms.append(f"coalesce({term}, 0.0D)")
        return " + ".join(terms)

    def predict(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """``df`` with the ``prediction`` of the named tree, or of the ensemble, as it is now."""
        member = 0 if self.votes else list(self.trees).index(name or next(iter(self.trees)))
        named = {f.name for f in self.features}
        others = [f"`{c}`" for c in df.columns if c not in named]
        rows = self._predicted(self._spread(df, others).where(F.col("m") == member))
        return rows.select(*[f"`{c}`" for c in df.columns], "prediction")

    def step(self, batch: DataFrame) -> list[tuple[str, int, int, int]]:
        """Predict with the trees as they are, count (name, label, prediction, n), then train and try splits.

        Rows without a label are left out; a NULL feature takes the last branch and joins no sums.
        """
        spark = batch.sparkSession
        batch = batch.where("label IS NOT NULL")
        pivots = self._pivots(batch)
        rows = self._predicted(self._learning(batch))
        groups = rows.groupBy("m", "leaf", "y", "label", "prediction", "majority", "bayes").agg(
            F.count("*").alias("rows"), self.layout.columns(pivots).alias("part"))
        parts = groups.groupBy("m", "leaf").agg(  # class combinations of one leaf
            F.collect_list(F.struct("y", "label", "prediction", "majority", "bayes", "rows", "part")).alias("parts"))
        known = self.leaves(spark).select("m", "leaf", "tried", "right_majority", "right_bayes", "poor", "sums")
        n_leaves = sum(len(t.leaves()) for t in self.trees.values())
        tasks = max(1, min(spark.sparkContext.defaultParallelism, n_leaves // LEAVES_PER_TASK))
        touched = known.join(parts, ["m", "leaf"], "left").repartition(tasks, "m", "leaf")
        path = scratch_path(spark, "leaves", self.home)
        touched.mapInArrow(_advance_all(list(self.trees.values()), self.layout, pivots), LEAF).write.parquet(path)
        self.written.append(path)
        for old in self.written[:-2]:
            dropped(spark, old)
        self.written = self.written[-2:]
        return self._learned(spark.read.schema(LEAF).parquet(path))

    def _pivots(self, batch: DataFrame) -> list[float]:
        """A value near the middle of each feature, around which sums of squares keep their digits: its mean over the
        first batch that has rows."""
        if self.pivots is not None:
            return self.pivots
        numeric = [f.name for f in self.features if not f.values]
        means = batch.agg(F.count("*").alias("n"), *[F.avg(F.col(f"`{n}`")).alias(f"a{i}") for i, n in enumerate(numeric)]).first()
        by_name = {n: means[f"a{i}"] or 0.0 for i, n in enumerate(numeric)}
        pivots = [0.0 if f.values else float(by_name[f.name]) for f in self.features]
        if means["n"]:
            self.pivots = pivots
        return pivots

    def _learned(self, table: DataFrame) -> list[tuple[str, int, int, int]]:
        """Grow the tests by the splits that won; returns the confusion counts."""
        names = list(self.trees)
        counts = table.select("m", F.inline("counts")).groupBy("m", "label", "prediction").agg(F.sum("n").alias("n"))
        if self.votes:
            counts = counts.where("m = 0")
        # At most members * classes^2 rows, and one row per split that won.
        rows = sorted(tuple(r) for r in counts.collect())
        splits = table.where("attr IS NOT NULL").select("m", "leaf", "attr", "kind", "value", "branches").collect()
        self.fresh = []
        for m, leaf, *split in sorted(tuple(r) for r in splits):
            self.fresh += [(m, child) for child in self.trees[names[m]].split(leaf, *split)]
        return [("ensemble" if self.votes else names[m], label, guess, n) for m, label, guess, n in rows]


def _places(tree: Tree) -> list[int]:
    """For each node its place among the leaves."""
    places, n = [], 0
    for node in tree.nodes:
        places.append(n if node.is_leaf else -1)
        n += node.is_leaf
    return places


def _advance_all(trees: list[Tree], layout: Layout, pivots: list[float], tries: bool = True):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        floats = pa.list_(pa.float64())
        nested = pa.list_(floats)
        model = pa.struct([
            ("trusted", pa.bool_()), ("prior", floats), ("mean", nested), ("deviation", nested), ("share", pa.list_(nested))])
        count = pa.struct([("label", pa.int32()), ("prediction", pa.int32()), ("n", pa.int64())])
        schema = pa.schema([
            ("m", pa.int32()), ("leaf", pa.int32()), ("tried", pa.float64()), ("right_majority", pa.float64()),
            ("right_bayes", pa.float64()), ("poor", pa.list_(pa.int32())), ("sums", floats), ("majority", pa.int32()),
            ("shares", floats), ("model", model), ("counts", pa.list_(count)), ("attr", pa.int32()), ("kind", pa.string()),
            ("value", pa.float64()), ("branches", nested)])
        for batch in batches:
            rows = [advance(leaf, trees[leaf["m"]], layout, pivots, tries) for leaf in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


class OneVsRestTrees(TreeLearner):
    """A two-class tree per class; the class whose tree is most certain wins, ties to the lower class."""

    votes = True

    def __init__(self, features: list[Feature], classes: int, options: TreeOptions):
        super().__init__(features, 2, {str(c): options for c in range(classes)})

    def _target(self) -> str:
        return "label = m"

    def _vote(self) -> str:
        return "transform(shares, s -> s[1])"

    def targets(self, label: np.ndarray, m: int) -> np.ndarray:
        return (label == m).astype(np.int64)

    def votes_of(self, shares: list[np.ndarray]) -> np.ndarray:
        return np.column_stack([s[:, 1] for s in shares])


class Forest(TreeLearner):
    """Online bagging: each tree weighs each row by a Poisson draw and tests a few attributes per leaf.

    ``feature_mode`` 0 takes ``subset`` attributes, 1 takes floor(sqrt(M)) + 1. ``key`` is the row number the draws
    depend on.
    """

    votes = True

    def __init__(
        self,
        features: list[Feature],
        classes: int,
        options: TreeOptions,
        size: int = 10,
        feature_mode: int = 1,
        subset: int = 2,
        rate: float = 6.0,
        key: str = "id",
    ):
        super().__init__(features, classes, {str(k): options for k in range(size)})
        self.rate, self.key = rate, key
        drawn = subset if feature_mode == 0 else int(np.sqrt(len(features))) + 1
        for k, tree in enumerate(self.trees.values()):
            tree.subset, tree.seed = drawn, k

    def _weight(self, rows: DataFrame) -> DataFrame:
        drawn = rows.withColumn("drawn", F.expr(mix_sql(f"`{self.key}`", "m")))
        return drawn.withColumn("w", F.expr(poisson_sql("drawn", self.rate))).drop("drawn")

    def _vote(self) -> str:
        none = f"array_repeat(0.0D, {self.classes})"
        return f"aggregate(shares, {none}, (total, s) -> zip_with(total, s, (a, b) -> a + b))"

    def drawing(self) -> list[Column]:
        key = f"`{self.key}`"
        low, high = f"pmod({key}, {_SPAN}L)", f"pmod({key} div {_SPAN}L, {_SPAN}L)"
        return [F.expr(f"CAST({low} AS BIGINT)").alias("low"), F.expr(f"CAST({high} AS BIGINT)").alias("high")]

    def weights_of(self, table, m: int) -> np.ndarray:
        low, high = (table.column(c) for c in ("low", "high"))
        drawn = mix_array(low.fill_null(0).to_numpy(), high.fill_null(0).to_numpy(), m)
        steps = poisson_steps(self.rate)
        w = np.searchsorted(steps, drawn, side="right").astype(float)
        return np.where(low.is_null().to_numpy(zero_copy_only=False), float(len(steps)), w)

    def votes_of(self, shares: list[np.ndarray]) -> np.ndarray:
        total = np.zeros((len(shares[0]), self.classes))
        for s in shares:
            total = total + s
        return total


# Statistics as tables ------------------------------------------------------------------------------------------------


def leaf_statistics(learner: TreeLearner, batch: DataFrame) -> DataFrame:
    """Sums of one batch in long form: (member, leaf, y, attr, name, value, n, mean, m2, min, max).

    A numeric attribute has one row per leaf and class, a nominal one a row per value; ``m2`` are the squared
    deviations from the mean.
    """
    batch = batch.where("label IS NOT NULL")
    pivots = learner._pivots(batch)
    groups = learner._learning(batch).groupBy("m", "leaf", "y").agg(learner.layout.columns(pivots).alias("part"))
    none = F.lit(None).cast("double")
    cells = []
    for i, (f, at) in enumerate(zip(learner.features, learner.layout.first)):
        head = [F.lit(i).alias("attr"), F.lit(f.name).alias("name")]
        if f.values:
            for v in range(f.values):
                cells.append(
                    F.struct(
                        *head, F.lit(v).alias("value"), F.col("part")[at + v].alias("n"),
                        *[none.alias(c) for c in ("mean", "m2", "min", "max")],
                    )
                )
        else:
            n, s, q, low, high = (F.col("part")[at + k] for k in range(5))
            mean, m2 = moments.centred(n, s, q, F.lit(pivots[i]))
            seen = [F.when(n > 0, c).alias(a) for c, a in ((mean, "mean"), (m2, "m2"), (low, "min"), (high, "max"))]
            cells.append(F.struct(*head, F.lit(None).cast("int").alias("value"), n.alias("n"), *seen))
    member = F.element_at(F.array(*map(F.lit, learner.trees)), F.col("m") + 1).alias("member")
    return groups.select(member, "leaf", "y", F.inline(F.array(*cells)))


def split_scores(stats: DataFrame, classes: int, options: TreeOptions) -> DataFrame:
    """Best test of every attribute of every leaf with the bound that decides: (member, leaf, attr, kind, value,
    merit, bound). Groups are the statistics of one leaf: attributes by classes by values."""

    def score(pdf):
        import pandas as pd

        parent = np.zeros(classes)
        by_attr = {}
        for attr, rows in pdf.groupby("attr"):
            if rows["value"].notna().any():
                table = np.zeros((int(rows["value"].max()) + 1, classes))
                for r in rows.itertuples():
                    table[int(r.value), r.y] += r.n
                by_attr[attr] = {"values": table}
                mass = table.sum(axis=0)
            else:
                s = {"min": np.full(classes, np.inf), "max": np.full(classes, -np.inf)}
                s |= {k: np.zeros(classes) for k in ("n", "mean", "m2")}
                for r in rows[rows["n"] > 0].itertuples():
                    for k in s:
                        s[k][r.y] = getattr(r, k)
                by_attr[attr] = s
                mass = s["n"]
            parent = np.maximum(parent, mass)
        bound = hoeffding_bound(parent.sum(), classes, options.confidence, options.criterion)
        out = []
        for attr, s in by_attr.items():
            best = best_split(attr, s, parent, options.criterion, options.binary_only)
            if best is not None:
                out.append((pdf["member"].iloc[0], pdf["leaf"].iloc[0], attr, best.kind, best.value, best.merit, bound))
        return pd.DataFrame(out, columns=["member", "leaf", "attr", "kind", "value", "merit", "bound"])

    schema = "member string, leaf int, attr int, kind string, value double, merit double, bound double"
    return stats.groupBy("member", "leaf").applyInPandas(score, schema)
