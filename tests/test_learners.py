"""Learners against plain loops over the same rows, and streams against replays."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunelens.sources import replay
from tunelens.streaming import evaluate
from tunelens.streaming.clustering import StreamingKMeans
from tunelens.streaming.linear import LinearLearner, LinearOptions
from tunelens.streaming.outliers import flag_outliers
from tunelens.streaming.prequential import LEARNERS, prequential
from tunelens.streaming.splits import best_split, hoeffding_bound, merit, normal_cdf
from tunelens.streaming.stream import ModelStore, replay_stream, stream_prequential, train_batch
from tunelens.streaming.trees import Feature, Forest, OneVsRestTrees, TreeLearner, TreeOptions, mix_int, poisson_steps


def rows(n=400, seed=7):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rng.random(), rng.gauss(0, 1), rng.randrange(3)
        y = int((a > 0.5) != (rng.random() < 0.1))
        out.append((i, a, b, float(c), y, c if a > 0.3 else 0))
    return out


SCHEMA = "id bigint, a double, b double, c double, label int, label3 int"


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(4).cache()


def plain_linear(data, size, loss, reg, lam, rp, classes=None):
    """Reference loop: one row at a time."""
    w = {k: [0.0] * 4 for k in range(classes or 1)}
    predicted = []
    for start in range(0, len(data), size):
        batch = data[start : start + size]
        grad = {k: [0.0] * 4 for k in w}
        for _, a, b, c, y, y3 in batch:
            x = (a, b, c, 1.0)
            s = {k: sum(wi * xi for wi, xi in zip(w[k], x)) for k in w}
            label = y if classes is None else y3
            guess = int(s[0] > 0) if classes is None else max(w, key=lambda k: (s[k], -k))
            predicted.append((start // size, label, guess))
            for k in w:
                t = label if classes is None else int(label == k)
                sign = 2 * t - 1
                g = {
                    "LogisticLoss": 1 / (1 + math.exp(-s[k])) - t,
                    "SquaredLoss": s[k] - sign,
                    "HingeLoss": -sign if sign * s[k] < 1 else 0.0,
                    "PerceptronLoss": -sign if sign * s[k] <= 0 else 0.0,
                }[loss]
                grad[k] = [gi + g * xi for gi, xi in zip(grad[k], x)]
        for k in w:
            g = [v / len(batch) for v in grad[k]]
            pen = {"ZeroRegularizer": lambda v: 0, "L1Regularizer": np.sign, "L2Regularizer": lambda v: v}[reg]
            w[k] = [w[k][i] - lam * (g[i] + (rp * pen(w[k][i]) if i < 3 else 0)) for i in range(4)]
    return w, predicted


@pytest.mark.parametrize("loss", ["LogisticLoss", "SquaredLoss", "HingeLoss", "PerceptronLoss"])
@pytest.mark.parametrize("reg", ["L1Regularizer", "L2Regularizer"])
def test_linear_against_a_loop(data, loss, reg):
    learner = LinearLearner(["a", "b", "c"], {"m": LinearOptions(3, 0.1, loss, reg, 0.01)})
    counts = []
    for i, batch in replay.replay_file(data, "id", 100, None):
        counts += [(i, y, p, n) for _, y, p, n in learner.step(batch)]
    w, predicted = plain_linear(rows(), 100, loss, reg, 0.1, 0.01)
    assert learner.weights["m", 0] == pytest.approx(w[0], abs=1e-9)
    assert sorted(counts) == sorted((*k, predicted.count(k)) for k in set(predicted))


def test_one_against_rest_linear(data):
    learner = LinearLearner(["a", "b", "c"], {"m": LinearOptions(3, 0.5)}, classes=3)
    three = data.drop("label").withColumnRenamed("label3", "label")
    counts = []
    for i, batch in replay.replay_file(three, "id", 100, None):
        counts += [(i, y, p, n) for _, y, p, n in learner.step(batch)]
    w, predicted = plain_linear(rows(), 100, "LogisticLoss", "ZeroRegularizer", 0.5, 0.001, classes=3)
    for k in range(3):
        assert learner.weights["m", k] == pytest.approx(w[k], abs=1e-9)
    assert sorted(counts) == sorted((*k, predicted.count(k)) for k in set(predicted))
    assert learner.predict(three, "m").where("prediction = label").count() > 200


def test_feature_number_must_match():
    with pytest.raises(ValueError, match="4 features declared"):
        LinearLearner(["a", "b", "c"], {"m": LinearOptions(4)})


FEATURES = [Feature("a"), Feature("b"), Feature("c", 3)]


class PlainTree:
    """Reference tree: keeps the rows themselves and recounts them at every attempt."""

    def __init__(self, o):
        self.o = o
        self.root = self.leaf(0, [0.0, 0.0])

    def leaf(self, depth, inherited):
        return {"depth": depth, "inherited": inherited, "rows": [], "tried": 0, "mc": 0, "nb": 0, "test": None}

    def find(self, x):
        node = self.root
        while node["test"]:
            kind, attr, value, children = node["test"]
            node = children[int(x[attr])] if kind == "many" else children[0] if x[attr] <= value else children[1]
        return node

    def guesses(self, node, x):
        mass = [node["inherited"][k] + sum(r[3] == k for r in node["rows"]) for k in (0, 1)]
        mc = int(mass[1] > mass[0])
        if not node["rows"]:
            return mc, None
        scores = []
        for k in (0, 1):
            mine = [r for r in node["rows"] if r[3] == k]
            s = math.log(len(mine) / len(node["rows"])) if mine else -1e300
            for attr in (0, 1):
                if mine:
                    v = [r[attr] for r in mine]
                    m = sum(v) / len(v)
                    sd = max(math.sqrt(max(sum(z * z for z in v) / len(v) - m * m, 0)), 1e-9)
                else:
                    m, sd = 0.0, 1e-9
                s += -math.log(sd) - (x[attr] - m) ** 2 / (2 * sd * sd)
            s += math.log((sum(r[2] == x[2] for r in mine) + 1) / (len(mine) + 3))
            scores.append(s)
        return mc, int(scores[1] > scores[0])

    def batch(self, batch):
        out, seen = [], []
        for x in batch:
            node = self.find(x)
            mc, nb = self.guesses(node, x)
            kind, n = self.o.leaf_kind, len(node["rows"])
            use = nb is not None and n > self.o.nb_threshold and (kind == 1 or (kind == 2 and node["nb"] > node["mc"]))
            out.append((x[3], nb if use else mc))
            seen.append((node, x, mc, nb))
        for node, x, mc, nb in seen:
            node["rows"].append(x)
            node["mc"] += mc == x[3]
            node["nb"] += kind_ok(self.o, nb) and nb == x[3]
        for node in self.leaves(self.root):
            self.attempt(node)
        return out

    def leaves(self, node):
        if not node["test"]:
            return [node]
        return [leaf for child in node["test"][3] for leaf in self.leaves(child)]

    def attempt(self, node):
        n, o = len(node["rows"]), self.o
        if n - node["tried"] < o.grace or len({r[3] for r in node["rows"]}) < 2 or node["depth"] >= o.max_depth:
            return
        node["tried"] = n
        parent = [sum(r[3] == k for r in node["rows"]) for k in (0, 1)]
        found = []
        for attr in (0, 1):
            v = [r[attr] for r in node["rows"]]
            lo, hi = min(v), max(v)
            best = None
            for j in range(1, 11):
                cut = lo + (hi - lo) * j / 11
                below = []
                for k in (0, 1):
                    w = [r[attr] for r in node["rows"] if r[3] == k]
                    m = sum(w) / len(w)
                    sd = math.sqrt(max(sum(z * z for z in w) / len(w) - m * m, 0))
                    below.append(len(w) * float(normal_cdf(np.array((cut - m) / sd))))
                sides = [below, [p - b for p, b in zip(parent, below)]]
                gain = self.gain(parent, sides)
                if best is None or gain > best[0]:
                    best = (gain, attr, "numeric", cut, sides)
            found.append(best)
        sides = [[sum(r[2] == v and r[3] == k for r in node["rows"]) for k in (0, 1)] for v in range(3)]
        found.append((self.gain(parent, sides), 2, "many", 0.0, sides))
        found.sort(key=lambda f: (-f[0], f[1]))
        bound = math.sqrt(math.log(1 / o.confidence) / (2 * n))
        if found[0][0] > 0 and (found[0][0] - found[1][0] > bound or bound < o.tie):
            _, attr, kind, value, sides = found[0]
            node["test"] = (kind, attr, value, [self.leaf(node["depth"] + 1, s) for s in sides])

    def gain(self, parent, sides):
        def impurity(c):
            t = sum(c)
            p = [v / t for v in c if t > 0 and v > 0]
            if self.o.criterion == "GiniSplitCriterion":
                return 1 - sum(q * q for q in p) if t > 0 else 0.0
            return -sum(q * math.log2(q) for q in p)

        total = sum(map(sum, sides))
        return impurity(parent) - sum(sum(s) / total * impurity(s) for s in sides)


def kind_ok(o, nb):
    return o.leaf_kind != 0 and nb is not None


def shape(tree, at=0):
    node = tree.nodes[at]
    if node.is_leaf:
        return "leaf"
    return (node.attr, node.kind, round(node.value, 9), [shape(tree, c) for c in node.children])


def plain_shape(node):
    if not node["test"]:
        return "leaf"
    kind, attr, value, children = node["test"]
    return (attr, kind, round(value, 9), [plain_shape(c) for c in children])


@pytest.mark.parametrize("criterion", ["InfoGainSplitCriterion", "GiniSplitCriterion"])
@pytest.mark.parametrize("leaf_kind", [0, 1, 2])
def test_tree_against_a_loop(data, criterion, leaf_kind):
    o = TreeOptions(criterion=criterion, grace=40, confidence=0.1, tie=0.2, leaf_kind=leaf_kind)
    learner, plain = TreeLearner(FEATURES, 2, {"t": o}), PlainTree(o)
    source = rows()
    for i, batch in replay.replay_file(data, "id", 80, None):
        got = {(y, p): n for _, y, p, n in learner.step(batch)}
        want = plain.batch([(a, b, c, y) for _, a, b, c, y, _ in source[i * 80 : (i + 1) * 80]])
        assert got == {k: want.count(k) for k in set(want)}
    tree = learner.trees["t"]
    assert shape(tree) == plain_shape(plain.root) and tree.depth >= 1


def branch(tree, row, at=0):
    """The leaf of one row, walked in Python."""
    node = tree.nodes[at]
    if node.is_leaf:
        return at
    x, last = row[tree.features[node.attr].name], len(node.children) - 1
    if node.kind == "numeric":
        k = 0 if x is not None and x <= node.value else 1
    elif node.kind == "one":
        k = 0 if x == node.value else 1
    else:
        k = int(x) if x is not None and x in range(last) else last
    return branch(tree, row, node.children[k])


def test_routing(data):
    learner = TreeLearner(FEATURES, 2, {"t": TreeOptions(grace=20, confidence=0.3, tie=0.5)})
    for _, batch in replay.replay_file(data, "id", 80, None):
        learner.step(batch)
    tree = learner.trees["t"]
    strange = data.unionByName(data.limit(3).withColumn("c", F.lit(9.0))).unionByName(data.limit(3).withColumn("a", F.lit(None).cast("double")))
    strange = strange.unionByName(data.limit(3).withColumn("c", F.lit(1.5)))
    routed = strange.withColumn("leaf", F.expr(tree.route())).collect()
    assert all(r.leaf == branch(tree, r) for r in routed) and len({r.leaf for r in routed}) > 2


def test_prefix_of_a_stream(spark, data):
    """The metrics of the first chunks do not depend on how many rows follow."""
    def run(n):
        learner = TreeLearner(FEATURES, 2, {"t": TreeOptions(grace=5, confidence=0.9, tie=0.9)})
        table = prequential(spark, replay.replay_file(data.where(f"id < {n}"), "id", 20), learner)
        return learner, sorted(tuple(r) for r in table.where("batch < 5").collect())

    (_, few), (_, many) = run(100), run(400)
    assert few == many


def test_missing_values(spark, data):
    """Rows without a label change nothing; a missing feature is 0 to a linear model and no sum to a tree."""
    from tunelens.streaming.clustering import StreamingKMeans
    from tunelens.streaming.linear import LinearLearner, LinearOptions

    gaps = data.withColumn("label", F.lit(None).cast("int"))
    both = data.unionByName(gaps)
    whole, more = make_learner(), make_learner()
    assert sorted(whole.step(data)) == sorted(more.step(both)) and whole.state()["trees"] == more.state()["trees"]
    assert leaf_rows(spark, whole) == leaf_rows(spark, more)
    holes = data.withColumn("a", F.when(F.col("id") % 3 > 0, F.col("a")))
    filled = holes.fillna(0.0, ["a"])
    one, two = (LinearLearner(["a"], {"m": LinearOptions(1, 0.5)}) for _ in range(2))
    assert sorted(one.step(holes.unionByName(holes.withColumn("label", F.lit(None).cast("int"))))) == sorted(two.step(filled))
    assert one.state() == two.state()
    make_learner().step(holes)
    model = StreamingKMeans(["a"], 2)
    found = model.step(holes)
    assert sum(n for j, n, *_ in found if j is not None) == holes.where("a IS NOT NULL").count()
    assert sum(n for _, n, *_ in found) == holes.count()


def test_poisson_rate():
    from tunelens.streaming.trees import poisson_steps

    assert poisson_steps(1.0)[-1] <= 2**31 and len(poisson_steps(400.0)) > 400
    with pytest.raises(ValueError):
        poisson_steps(800.0)


def test_splits():
    counts = np.array([30.0, 10.0])
    sides = np.array([[30.0, 0.0], [0.0, 10.0]])
    assert merit(counts, sides, "InfoGainSplitCriterion") == pytest.approx(0.8112781)
    assert merit(counts, sides, "GiniSplitCriterion") == pytest.approx(0.375)
    assert merit(counts, sides, "VarianceReductionSplitCriterion") == pytest.approx(0.1875)
    one = best_split(0, {"values": np.array([[10.0, 0.0], [5.0, 5.0], [15.0, 5.0]])}, counts, "GiniSplitCriterion", True)
    assert one.kind == "one" and one.branches.sum() == 40
    assert normal_cdf(np.array([0.0, 1.96, -1.96])) == pytest.approx([0.5, 0.975, 0.025], abs=1e-4)
    assert hoeffding_bound(1000, 2, 0.01, "InfoGainSplitCriterion") == pytest.approx(0.04798, abs=1e-4)
    with pytest.raises(ValueError):
        TreeOptions(criterion="nope")


def test_options_limit_growth(data):
    base = dict(grace=20, confidence=0.3, tie=0.5)
    learner = TreeLearner(FEATURES, 2, {
        "free": TreeOptions(**base), "frozen": TreeOptions(growth=False, **base), "stump": TreeOptions(max_depth=1, **base),
        "without": TreeOptions(**base), "poor": TreeOptions(remove_poor=True, **base)}, {"without": ["a"]})
    for _, batch in replay.replay_file(data, "id", 80, None):
        learner.step(batch)
    assert learner.depths()["frozen"] == 0 and learner.depths()["stump"] == 1 and learner.depths()["free"] > 1
    assert all(n.attr != 0 for n in learner.trees["without"].nodes)


def leaf_rows(spark, learner):
    return sorted((tuple(r) for r in learner.leaves(spark).drop("counts").collect()), key=lambda r: r[:2])


def test_state_survives_json(spark, data):
    batches = [b for _, b in replay.replay_file(data, "id", 100, None)]
    make = lambda: TreeLearner(FEATURES, 2, {"t": TreeOptions(grace=40, confidence=0.1)})
    straight, restarted = make(), make()
    for b in batches[:2]:
        straight.step(b)
        restarted.step(b)
    again = make()
    again.load(json.loads(json.dumps(restarted.state())))
    assert sorted(straight.step(batches[2])) == sorted(again.step(batches[2]))
    assert straight.state()["trees"] == again.state()["trees"] and leaf_rows(spark, straight) == leaf_rows(spark, again)


def test_driver_sees_counts_and_splits_only(spark, data, monkeypatch):
    """What a batch brings to the driver does not grow with the leaves; the plan of large models gives the same trees."""
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    from tunelens.streaming import trees

    seen = []
    collect = Classic.collect
    monkeypatch.setattr(Classic, "collect", lambda df: (lambda rows: seen.append(len(rows)) or rows)(collect(df)))
    o = TreeOptions(grace=20, confidence=0.3, tie=0.5)
    runs = {}
    for limit in (trees.BROADCAST_LEAVES, 0):
        monkeypatch.setattr(trees, "BROADCAST_LEAVES", limit)
        learners = TreeLearner(FEATURES, 2, {"t": o}), Forest(FEATURES, 2, o, size=3)
        out = []
        for _, batch in replay.replay_file(data, "id", 80, None):
            before = [sum(len(t.leaves()) for t in one.trees.values()) for one in learners]
            del seen[:]
            out.append([sorted(one.step(batch)) for one in learners])
            grown = sum(len(t.leaves()) for one in learners for t in one.trees.values()) - sum(before)
            assert sum(seen) <= 2 * 4 + grown
        runs[limit] = out, [shape(t) for one in learners for t in one.trees.values()]
    first, second = runs.values()
    assert first == second and sum(before) > 8


def test_moments_of_large_values(spark):
    """Epoch milliseconds: moments of leaves, splits and outliers keep their digits."""
    from tunelens.streaming import moments
    from tunelens.streaming.outliers import flag_outliers
    from tunelens.streaming.trees import leaf_statistics

    rng = np.random.default_rng(3)
    x = 1.7e12 + rng.normal(0, 5.0, 600)
    y = (x > 1.7e12 + 1).astype(int)
    df = spark.createDataFrame([(i, float(v), int(k)) for i, (v, k) in enumerate(zip(x, y))], "id bigint, x double, label int")
    learner = TreeLearner([Feature("x")], 2, {"t": TreeOptions(grace=1000)})
    for r in leaf_statistics(learner, df).collect():
        own = x[y == r.y]
        assert r["mean"] == pytest.approx(own.mean(), abs=1e-3) and r["m2"] / r["n"] == pytest.approx(own.var(), rel=1e-4)
    for _, batch in replay.replay_file(df, "id", 100, None):
        learner.step(batch)
    sums = np.array(learner.leaves(spark).first()["sums"]).reshape(2, -1)
    for k in (0, 1):
        own = x[y == k]
        assert sums[k, 1] == len(own) and sums[k, 3] / sums[k, 1] == pytest.approx(own.var(), rel=1e-4)
    halves = [(float(len(h)), float(h.mean()), float(h.var() * len(h))) for h in (x[:200], x[200:])]
    n, mean, m2 = moments.merge(*halves)
    assert (n, mean) == (600, pytest.approx(x.mean(), abs=1e-3)) and m2 / n == pytest.approx(x.var(), rel=1e-4)
    chunks = df.selectExpr("CAST(id div 100 AS BIGINT) AS chunk_id", "x", "id")
    far = {r.id for r in flag_outliers(chunks, ["x"]).where("outlier").collect()}
    want = set()
    for b in range(1, 6):
        past = x[: b * 100]
        want |= {i for i in range(b * 100, b * 100 + 100) if abs(x[i] - past.mean()) / past.std() > 3}
    assert far == want


def test_tree_predicts_rows(data):
    """Predictions of rows, by name and by vote, are those the next batch is counted by."""
    o = TreeOptions(grace=40, confidence=0.1, tie=0.2)
    for learner in (TreeLearner(FEATURES, 2, {"other": TreeOptions(growth=False), "t": o}), Forest(FEATURES, 2, o, size=3)):
        parts = [b for _, b in replay.replay_file(data, "id", 100, None)]
        for batch in parts[:3]:
            learner.step(batch)
        rows = learner.predict(parts[3], "t")
        assert rows.columns == [*data.columns, "prediction"] and rows.count() == 100
        want = {(r.label, r.prediction): r["count"] for r in rows.groupBy("label", "prediction").count().collect()}
        name = "ensemble" if learner.votes else "t"
        assert want == {(y, p): n for m, y, p, n in learner.step(parts[3]) if m == name}


def test_poisson_weights(spark):
    forest = Forest(FEATURES, 2, TreeOptions(), size=2, rate=6.0)
    df = spark.range(20000).selectExpr("id", "posexplode(array(0, 0)) AS (m, leaf)")
    got = forest._weight(df).groupBy("m").agg(F.avg("w").alias("mean"), F.var_pop("w").alias("var")).collect()
    for r in got:
        assert r["mean"] == pytest.approx(6, abs=0.15) and r["var"] == pytest.approx(6, abs=0.4)
    steps = poisson_steps(6.0)
    sample = {(r.id, r.m): r.w for r in forest._weight(df).where("id < 50").collect()}
    for (i, m), w in sample.items():
        u = mix_int(i, m)
        assert w == next((k for k, s in enumerate(steps) if u < s), len(steps))
    big = spark.createDataFrame([(10**17, 0, 0)], "id bigint, m int, leaf int")
    assert forest._weight(big).first().w >= 0


def test_forest_and_one_against_rest_learn(data):
    o = TreeOptions(grace=40, confidence=0.1, tie=0.2)
    forest = Forest(FEATURES, 2, o, size=5, feature_mode=1)
    assert [t.subset for t in forest.trees.values()] == [2] * 5
    last = None
    for _, batch in replay.replay_file(data, "id", 80, None):
        last = forest.step(batch)
    assert sum(n for *_, n in last) == 80 and sum(n for _, y, p, n in last if y == p) > 55
    three = data.drop("label").withColumnRenamed("label3", "label")
    trees = OneVsRestTrees(FEATURES, 3, o)
    for _, batch in replay.replay_file(three, "id", 80, None):
        last = trees.step(batch)
    assert sum(n for _, y, p, n in last if y == p) > 60
    assert set(LEARNERS) == {"sgd", "ht", "mc", "rf", "kmeans", "outliers"}


def test_evaluators(spark):
    pairs = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 4 + [(2, 1)] * 1 + [(1, 0)] * 3
    df = spark.createDataFrame(pairs, "label int, prediction int").withColumn("b", F.lit(0))
    counts = evaluate.confusion(df, ["b"])
    basic = evaluate.classification_metrics(counts, ["b"]).first()
    assert basic.accuracy == 0.6 and basic.recall == round(4 / 7, 6) and basic.precision == round(4 / 7, 6)
    wide = evaluate.classification_metrics(counts, ["b"], "extended").first()
    assert wide.instances == 15 and wide.recall == pytest.approx((5 / 7 + 4 / 7 + 0) / 3, abs=1e-6)
    none = evaluate.classification_metrics(evaluate.confusion(df.where("label = 0 AND prediction = 0"), ["b"]), ["b"]).first()
    assert (none.accuracy, none.recall, none.precision, none.f1) == (1.0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("frequency,width", [(50, 50), (40, 100), (100, 30)])
def test_sampled_metrics_against_a_loop(spark, frequency, width):
    rng = random.Random(5)
    data = [("hot" if i % 4 else "cold", i, rng.randrange(2), rng.randrange(2)) for i in range(730)]
    df = spark.createDataFrame(data, "s string, id bigint, label int, prediction int")
    got = {(r.s, r.rows): (r.instances_all, r.accuracy_all, r.instances_last, r.accuracy_last)
           for r in evaluate.sampled_metrics(df, ["s"], "id", frequency, width).collect()}
    want = {}
    for s in ("hot", "cold"):
        mine = [d for d in data if d[0] == s]
        for at in range(frequency, len(mine) + 1, frequency):
            seen, last = mine[:at], mine[max(at - width, 0) : at]
            acc = lambda v: round(sum(d[2] == d[3] for d in v) / len(v), 6)
            want[s, at] = (len(seen), acc(seen), len(last), acc(last))
    assert got == want


def test_kmeans_against_a_loop(spark, data):
    model = StreamingKMeans(["a", "b"], 3, decay=0.5)
    r = replay.replay_file(data, "id", 100, None)
    centres = [[x[1], x[2]] for x in rows()[:3]]
    weights = [0.0] * 3
    for i, batch in r:
        model.step(batch)
        groups = {}
        for _, a, b, *_ in rows()[i * 100 : (i + 1) * 100]:
            d = [(a - c[0]) ** 2 + (b - c[1]) ** 2 for c in centres]
            groups.setdefault(d.index(min(d)), []).append((a, b))
        for j in range(3):
            past, mine = weights[j] * 0.5, groups.get(j, [])
            if mine:
                centres[j] = [(centres[j][k] * past + sum(m[k] for m in mine)) / (past + len(mine)) for k in (0, 1)]
            weights[j] = past + len(mine)
        assert np.allclose(model.centres, centres) and model.weights == pytest.approx(weights)


def test_outliers_use_earlier_batches_only(spark):
    data = [(i // 50, float(i % 10)) for i in range(100)] + [(1, 1000.0), (0, 1000.0)]
    df = spark.createDataFrame(data, "chunk_id bigint, x double")
    flagged = flag_outliers(df.where("NOT (chunk_id = 0 AND x = 1000)"), ["x"]).where("outlier").collect()
    assert [(r.chunk_id, r.x) for r in flagged] == [(1, 1000.0)]


def make_learner():
    return TreeLearner(FEATURES, 2, {"t": TreeOptions(grace=40, confidence=0.1, tie=0.2)})


def test_stream_equals_replay_and_restarts(spark, data, tmp_path):
    r = replay.replay_file(data, "id", 100, None)
    want = sorted(tuple(x) for x in prequential(spark, r, make_learner()).select("batch", "accuracy", "f1").collect())
    store = ModelStore(spark, str(tmp_path / "store"))

    def run(stream):
        return stream_prequential(stream, make_learner(), store, str(tmp_path / "checkpoint"))

    replay_stream(r, str(tmp_path / "in"), data, run)
    got = sorted(tuple(x) for x in store.metrics().select("batch", "accuracy", "f1").collect())
    assert got == want and len(got) == 4
    # A repeated batch leaves the stored result alone.
    train_batch(store, make_learner(), data, 3)
    assert sorted(tuple(x) for x in store.metrics().select("batch", "accuracy", "f1").collect()) == want


def test_repeated_first_batch_and_lost_model(spark, data, tmp_path):
    store, learner = ModelStore(spark, str(tmp_path / "store")), make_learner()
    train_batch(store, learner, data, 0)
    once = store.metrics().collect()
    again = ModelStore(spark, str(tmp_path / "store"))
    again.done = lambda batch: False  # its metrics were lost: the batch is redone in the same process
    train_batch(again, learner, data, 0)
    assert store.metrics().collect() == once
    fresh = make_learner()
    again.load_model(fresh, 0)
    assert fresh.state() == learner.state() and leaf_rows(spark, fresh) == leaf_rows(spark, learner)
    with pytest.raises(FileNotFoundError):
        train_batch(store, learner, data, 7)


def test_paced_stream(spark, data, tmp_path):
    data.where("id < 100").write.parquet(str(tmp_path / "in"))
    store = ModelStore(spark, str(tmp_path / "store"))
    stream = replay.dir_stream(spark, data.schema, max_files=100).parquet(str(tmp_path / "in"))
    query = stream_prequential(stream, make_learner(), store, str(tmp_path / "cp"), interval="200 milliseconds")
    query.processAllAvailable()
    query.stop()
    assert store.metrics().agg(F.sum("instances")).first()[0] == 100
