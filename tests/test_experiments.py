"""Grids, ordering helpers, experiment scores and run files."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunelens.functions.scalars import sizeof_fmt
from tunelens.operators import experiments as x
from tunelens.operators.ordering import in_order, number_rows, quartiles, running_sums
from tunelens.plans import grids
from tunelens.sources import runs


@pytest.mark.parametrize(
    "key,size",
    [(("ht", "tweets"), 32), (("ht", "agrawal"), 108), (("sgd", "tweets"), 64), (("sgd", "agrawal"), 64),
     (("sgd", "tweets_file"), 32), (("rf", "tweets"), 108), (("rf", "arff"), 8), (("mc", "tweets"), 16),
     (("single", "arff"), 16), (("variants", "run"), 16), (("variants", "convert"), 16)],
)
def test_grid_sizes(spark, key, size):
    rows = grids.grid(spark, *key).collect()
    assert len(rows) == size == len({r.hp for r in rows})
    assert [r.hp_idx for r in sorted(rows, key=lambda r: r.hp_idx)] == list(range(size))


def test_grid_runs_the_last_key_fastest(spark):
    first, second = grids.grid(spark, "ht", "tweets").orderBy("hp_idx").take(2)
    assert first.hp == "spark_ht_c0.01_t0.05_g200_sInfoGainSplitCriterion_d20" and second.d == "30"


def test_decode_is_the_inverse_of_encode(spark):
    for model in ("ht", "sgd", "rf"):
        grid = grids.grid(spark, model, "tweets")
        keys = [c for c in grid.columns if c not in ("hp", "hp_idx")]
        for r in grid.select("*", grids.decode_hp(F.col("hp")).alias("decoded")).collect():
            assert r.decoded == {k: r[k] for k in keys}


def test_variant_names(spark):
    df = spark.createDataFrame([(1, 2, 0, None, 16), (0, 0, 1, 1, 9)], "p int, n int, b int, a int, f int")
    named = df.select("*", grids.dataset_variant_name(*[F.col(c) for c in "pnbaf"]).alias("name"))
    back = named.select("name", grids.parse_variant_name(F.col("name")).alias("v")).collect()
    assert [r.name for r in back] == ["tweets_p1_n2_b0_nosp_f16", "tweets_p0_n0_b1_a1_nosp_f9"]
    assert [tuple(r.v) for r in back] == [(1, 2, 0, None, 16), (0, 0, 1, 1, 9)]
    assert spark.range(1).select(grids.dataset_of(F.lit("/x/agrawal/HT"))).first()[0] == "agrawal"


def test_configurations(spark):
    rates = {r.config: r.offered_rate for r in grids.system_configs(spark).collect()}
    assert rates == dict(zip([f"s{i}" for i in range(1, 10)], [1600, 3200, 4800, 6400, 1600, 4800, 6400, 4800, 4800]))
    constant = grids.config_groups(spark).where("study = 'constant_rate'").collect()
    assert {rates[r.config] for r in constant} == {4800}


def hot_rows(seed=1):
    """One key holds most rows."""
    rng = random.Random(seed)
    return [("hot" if i % 3 else f"k{i % 7}", i, rng.randrange(100), rng.random()) for i in range(3000)]


@pytest.mark.parametrize("parts", [1, 8])
def test_numbering_and_running_sums(spark, parts):
    data = hot_rows()
    df = spark.createDataFrame(data, "k string, t bigint, v bigint, x double").repartition(parts)
    numbered = {(r.k, r.t): r.rn for r in number_rows(df, ["k"], ["t"]).collect()}
    summed = {(r.k, r.t): r.total for r in running_sums(df, ["k"], "t", {"total": F.col("v")}, bucket=100).collect()}
    count, total = {}, {}
    for k, t, v, _ in data:
        count[k] = count.get(k, 0) + 1
        total[k] = total.get(k, 0) + v
        assert numbered[k, t] == count[k] and summed[k, t] == total[k]
    assert len(numbered) == len(data) == len(summed)


def test_slices_cover_the_order(spark):
    ordered = in_order(spark.range(1000).repartition(5).withColumn("r", F.hash("id")), "id")
    assert ordered.count == 1000
    got = [sorted(r.id for r in ordered.slice(a, b).collect()) for a, b in ((0, 333), (333, 999), (999, 1000), (1000, 1200))]
    assert got == [list(range(333)), list(range(333, 999)), [999], []]


def test_quartiles_match_numpy(spark):
    data = hot_rows(2) + [("one", 0, 0, 5.0)]
    df = spark.createDataFrame(data, "k string, t bigint, v bigint, x double")
    for r in quartiles(df, ["k"], "x").collect():
        values = [d[3] for d in data if d[0] == r.k]
        assert (r.q1, r.median, r.q3) == pytest.approx(tuple(np.percentile(values, [25, 50, 75]))) and r.n == len(values)


def test_box_stats(spark):
    points = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 5, 6, 7, 8, 9, 100]], "k string, value double")
    box = x.box_stats(points, ["k"]).first()
    assert (box.median, box.whisker_low, box.whisker_high, box.fliers) == (5.5, 1.0, 9.0, 1)
    assert [r.value for r in x.box_fliers(points, ["k"]).collect()] == [100.0]


def cube(spark, n=60, seed=3):
    rng = random.Random(seed)
    rows = [(e, h, 100, *(rng.uniform(50, 100) for _ in range(4)), 5, rng.randrange(100, 900), 9, rng.randrange(100, 900))
            for e in range(1, 4) for h in range(n // 3)]
    df = spark.createDataFrame(rows, "exp int, hp_idx int, instances bigint, accuracy double, recall double, precision double, "
                                     "f1 double, jobs bigint, job_ms bigint, tasks bigint, task_ms bigint")
    return df.withColumn("throughput", x.throughput(F.col("instances"), F.col("job_ms"))).withColumn(
        "latency", x.latency(F.col("task_ms"), F.col("tasks")))


def test_normalised_values_stay_in_range(spark):
    rows = x.pareto_distances(x.normalized_cube(cube(spark))).collect()
    for m in ("norm_accuracy", "norm_job_ms", "norm_throughput", "norm_latency"):
        values = [r[m] for r in rows]
        assert min(values) == 0 and max(values) == 100
    for r in rows:
        ideal = r.norm_accuracy == 100 and r.norm_throughput == 100
        assert (r.distance_acc_thr == 0) == ideal
        assert r.distance_acc_thr == pytest.approx(100 * math.hypot(1 - r.norm_accuracy / 100, 1 - r.norm_throughput / 100))


def test_flat_measure_is_null(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert [r.norm_v for r in x.normalize(df, ["v"], []).collect()] == [None, None]


def test_pareto_front_against_all_pairs(spark):
    df = cube(spark, 90, 5).withColumn("accuracy", F.round("accuracy", 0)).withColumn("throughput", F.round("throughput", -1))
    rows = df.collect()
    want = {(r.exp, r.hp_idx) for r in rows if not any(
        o.accuracy >= r.accuracy and o.throughput >= r.throughput and (o.accuracy > r.accuracy or o.throughput > r.throughput)
        for o in rows)}
    got = {(r.exp, r.hp_idx) for r in x.pareto_front(df, "accuracy", "throughput").collect()}
    assert got == want


def test_best_breaks_ties_by_lowest_index(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (2, 0, 5.0), (1, 1, 5.0), (2, 1, 4.0)], "exp int, hp_idx int, m double")
    assert tuple(x.best_overall(df, "m").select("hp_idx", "exp").first()) == (0, 1)
    assert {(r.hp_idx, r.exp) for r in x.best_conf_per_hp(df, "m").collect()} == {(0, 1), (1, 1)}
    assert {(r.exp, r.hp_idx) for r in x.best_hp_per_conf(df, "m").collect()} == {(1, 0), (2, 0)}
    marked = x.mark_baseline_best(df, "m").where("is_best").collect()
    assert {(r.exp, r.hp_idx) for r in marked} == {(1, 0), (2, 0)}


def test_last_half_and_learning_curve(spark):
    rows = [(1, 0, b, 10, float(b), 0.0, 0.0, 0.0) for b in range(5)]
    df = spark.createDataFrame(rows, "exp int, hp_idx int, batch bigint, instances bigint, accuracy double, recall double, precision double, f1 double")
    assert x.last_half_mean(df).first().last_half_accuracy == 3.0  # batches 2, 3, 4
    curve = x.learning_curve(df).orderBy("batch").collect()
    assert [r.cumulative_instances for r in curve] == [10, 20, 30, 40, 50]


def test_metrics_csv_by_path(spark, tmp_path):
    for exp, acc in (("s1", 0.5), ("s10", 0.25)):
        (tmp_path / exp).mkdir()
        lines = ["time,n,a,r,p,f"] + [f"t{i},{i}00.7,{acc},0.5,0.5,0.5" for i in range(1, 13)]
        (tmp_path / exp / "spark_ht_c0.1_d20.csv").write_text("\n".join(lines) + "\n")
    rows = runs.read_metrics_csv(spark, str(tmp_path)).orderBy("exp", "batch").collect()
    assert [(r.exp, r.hp, r.batch, r.instances, r.accuracy) for r in rows[:2]] == [
        (1, "spark_ht_c0.1_d20", 0, 100, 50.0), (1, "spark_ht_c0.1_d20", 1, 200, 50.0)]
    assert [r.instances for r in rows[12:]] == [i * 100 for i in range(1, 13)] and rows[12].exp == 10


def test_conf_and_depth(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    (tmp_path / "s1" / "spark-defaults.conf").write_text("# c\n\nspark.a   1\nspark.b x\n")
    got = {(r.exp, r.key, r.value) for r in runs.read_spark_conf(spark, str(tmp_path)).collect()}
    assert got == {(1, "spark.a", "1"), (1, "spark.b", "x")}
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "x.conf").write_text("spark.a 1 2\n")
    with pytest.raises(Exception, match="not a key and a value"):
        runs.read_spark_conf(spark, str(bad)).collect()
    logs = tmp_path / "logs" / "s2"
    logs.mkdir(parents=True)
    (logs / "hp1.log").write_text("x\ntree depth: 3 | a\ntree depth: 12 | b\n")
    (logs / "hp2.log").write_text("nothing\n")
    got = {(r.exp, r.hp, r.depth) for r in runs.read_tree_depth(spark, str(tmp_path / "logs")).collect()}
    assert got == {(2, "hp1", 12), (2, "hp2", 0)}


def test_sizes(spark):
    values = [0, 1023, 1024, 1508062003, -2048, 5 * 1024**6]
    df = spark.createDataFrame([(v,) for v in values], "v bigint").select(sizeof_fmt(F.col("v")).alias("s"))
    assert [r.s for r in df.collect()] == ["0.0B", "1023.0B", "1.0KiB", "1.4GiB", "-2.0KiB", "5.0EiB"]


def test_configurations_sort_by_number(spark):
    df = spark.createDataFrame([("s10",), ("s9",), ("s1",)], "c string")
    assert [r.c for r in df.orderBy(grids.config_order(F.col("c"))).collect()] == ["s1", "s9", "s10"]
