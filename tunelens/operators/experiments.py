"""One row per (configuration, hyper-parameter set), and everything computed from those rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelens.functions.scalars import inverse_minmax, minmax
from tunelens.operators.ordering import bounded, in_order, quartiles, running_sums
from tunelens.plans.grids import BASELINE_CONFIG
from tunelens.session import stored

RUN = ["exp", "hp_idx"]
METRICS = ["accuracy", "recall", "precision", "f1"]
LARGER_IS_BETTER = ["accuracy", "recall", "precision", "f1", "throughput"]
SMALLER_IS_BETTER = ["job_ms", "task_ms", "latency"]
# Means keep more digits than the metrics they average: sums in another order must not change a best pick.
MEAN_DIGITS = 9


def metric_summary(metrics: DataFrame, weighted: bool = False, keys: list[str] = RUN) -> DataFrame:
    """Instances and mean metrics of each run; batches count equally unless ``weighted`` by their instances."""

    def mean(name: str) -> Column:
        if weighted:
            return F.try_divide(F.sum(F.col(name) * F.col("instances")), F.sum("instances"))
        return F.avg(name)

    return metrics.groupBy(*keys).agg(
        F.sum("instances").alias("instances"), *[F.round(mean(m), MEAN_DIGITS).alias(m) for m in METRICS]
    )


def learning_curve(metrics: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """Metrics against the instances seen so far, with the index of each batch and the mean over the last half."""
    curve = running_sums(
        metrics, keys, "batch", {"cumulative_instances": F.col("instances"), "batch_no": F.lit(1).cast("bigint")}
    )
    return curve.join(last_half_mean(metrics, keys), keys)


def last_half_mean(metrics: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """Mean accuracy over the batches from index floor(n / 2) on."""
    rows = metrics.select(*keys, "batch", "accuracy")
    numbered = running_sums(rows, keys, "batch", {"no": F.lit(1).cast("bigint")}, totals=True)
    late = F.col("no") > F.floor(F.col("no_total") / 2)
    return numbered.groupBy(*keys).agg(
        F.round(F.avg(F.when(late, F.col("accuracy"))), MEAN_DIGITS).alias("last_half_accuracy")
    )


def throughput(instances: Column, job_ms: Column) -> Column:
    """Records per second."""
    return F.try_divide(F.lit(1000.0) * instances, job_ms)


def latency(task_ms: Column, tasks: Column, factor: float = 2.0) -> Column:
    return F.try_divide(F.lit(factor) * task_ms, tasks)


def experiment_cube(metrics: DataFrame, times: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """Metrics and run times of each run joined on their key, with throughput and latency.

    From files, the key is (exp, hp): ``read_metrics_csv`` and ``eventstats.experiment_times`` share it.
    """
    return (
        metric_summary(metrics, keys=keys)
        .join(times, keys)
        .withColumn("throughput", F.round(throughput(F.col("instances"), F.col("job_ms")), 6))
        .withColumn("latency", F.round(latency(F.col("task_ms"), F.col("tasks")), 6))
    )


def normalize(df: DataFrame, larger: list[str], smaller: list[str], prefix: str = "norm_") -> DataFrame:
    """Min-max scale measures to 0..100 over the whole table; the extremes come from a one-row subquery."""
    extremes = df.agg(
        F.struct(
            *[F.min(m).alias(f"min_{m}") for m in larger + smaller],
            *[F.max(m).alias(f"max_{m}") for m in larger + smaller],
        )
    ).scalar()
    scaled = {m: minmax(F.col(m), extremes[f"min_{m}"], extremes[f"max_{m}"]) for m in larger}
    scaled |= {m: inverse_minmax(F.col(m), extremes[f"min_{m}"], extremes[f"max_{m}"]) for m in smaller}
    return df.select("*", *[c.alias(prefix + m) for m, c in scaled.items()])


def normalized_cube(cube: DataFrame) -> DataFrame:
    return normalize(cube, LARGER_IS_BETTER, SMALLER_IS_BETTER).withColumn(
        "norm_joined_time", joined_time(F.col("norm_job_ms"), F.col("norm_task_ms"))
    )


def joined_time(job: Column, task: Column) -> Column:
    return (job + task) / 2


# The score weights over normalised measures.
SCORES = {
    "score_acc_joined": {"norm_accuracy": 1 / 2, "norm_joined_time": 1 / 2},
    "score_acc_job_task": {"norm_accuracy": 1 / 3, "norm_job_ms": 1 / 3, "norm_task_ms": 1 / 3},
    "score_acc_thr": {"norm_accuracy": 1 / 2, "norm_throughput": 1 / 2},
    "score_acc_lat": {"norm_accuracy": 1 / 2, "norm_latency": 1 / 2},
    "score_acc_thr_lat": {"norm_accuracy": 1 / 3, "norm_throughput": 1 / 3, "norm_latency": 1 / 3},
}
# The measures of each distance to the ideal point.
DISTANCES = {
    "distance_acc_thr": ["norm_accuracy", "norm_throughput"],
    "distance_acc_lat": ["norm_accuracy", "norm_latency"],
    "distance_acc_thr_lat": ["norm_accuracy", "norm_throughput", "norm_latency"],
}


def weighted_score(weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for measure, weight in weights.items():
        total = total + F.lit(weight) * F.col(measure)
    return total


def weighted_scores(cube: DataFrame, scores: dict[str, dict[str, float]] = SCORES) -> DataFrame:
    return cube.select("*", *[weighted_score(w).alias(name) for name, w in scores.items()])


def pareto_distance(measures: list[str]) -> Column:
    """Distance to the point where every normalised measure is 100, times 100; smaller is better."""
    total = F.lit(0.0)
    for m in measures:
        gap = F.lit(1.0) - F.col(m) / F.lit(100.0)
        total = total + gap * gap
    return F.sqrt(total) * F.lit(100.0)


def pareto_distances(cube: DataFrame) -> DataFrame:
    return cube.select("*", *[pareto_distance(m).alias(name) for name, m in DISTANCES.items()])


def pareto_front(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows no other row beats on two measures (both larger is better).

    A row survives when its ``y`` is the best among equal ``x`` and above every ``y`` of a larger ``x``. The best
    ``y`` of the larger ``x`` values is a running maximum: partition maxima first, then inside each sorted partition.
    """
    from pyspark.sql import Window

    best = df.groupBy(x).agg(F.max(y).alias("_best"))
    ranked = in_order(best, F.col(x).desc()).table.withColumn("_part", F.shiftright("pos_id", 33))
    heads = ranked.groupBy("_part").agg(F.max("_best").alias("_top"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per sorted partition
    heads = heads.select("_part", F.max("_top").over(earlier).alias("_before"))
    inside = Window.partitionBy("_part").orderBy("pos_id").rowsBetween(Window.unboundedPreceding, -1)
    bound = F.greatest(F.max("_best").over(inside), F.col("_before"))
    front = (
        ranked.join(heads, "_part")
        .withColumn("_bound", bound)
        .where(F.col("_bound").isNull() | (F.col("_best") > F.col("_bound")))
        .select(F.col(x).alias("_x"), "_best")
    )
    return df.join(front, (df[x] == front["_x"]) & (df[y] == front["_best"]), "left_semi")


#: Survivors of so many tasks meet in one task of the next round.
FRONT_FAN_IN = 8


def pareto_front_3(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """Rows no other row beats on three measures: none is as good in all and better in one (larger is better).

    Points are reduced where they are, then survivors of a few tasks at a time, until one task has the front: points that
    meet have survived every smaller round. Equal rows stay together; a row without one of the measures is left out.
    """
    measures = [x, y, z]
    schema = "x double, y double, z double"
    spark = df.sparkSession
    points = df.select(*[F.col(m).cast("double").alias(c) for m, c in zip(measures, "xyz")]).dropna().distinct()
    points = stored(points.mapInArrow(_front_of_3, schema), "front")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while tasks > 1:
        tasks = -(-tasks // FRONT_FAN_IN)
        points = stored(points.repartition(tasks).mapInArrow(_front_of_3, schema), "front")
    same = [F.col(m).cast("double") == F.col(f"_{c}") for m, c in zip(measures, "xyz")]
    return df.join(points.toDF("_x", "_y", "_z"), same, "left_semi")


def _front_of_3(batches):
    """The points of a task that no other of its points beats.

    Points are taken by falling x. Those kept so far form a staircase, z falling as y rises; the first step at or right of
    a point's y has the largest z a rival can have.
    """
    from bisect import bisect_left, insort

    import pyarrow as pa

    points = sorted((p for b in batches for p in zip(*[c.to_pylist() for c in b.columns])), reverse=True)
    kept, steps = [], []  # steps: (y, z)
    for p in points:
        _, y, z = p
        at = bisect_left(steps, (y,))
        if at < len(steps) and steps[at][1] >= z:
            continue
        kept.append(p)
        while at and steps[at - 1][1] <= z:
            at -= 1
            del steps[at]
        while at < len(steps) and steps[at][0] == y:
            del steps[at]
        insort(steps, (y, z))
    columns = [pa.array(c, pa.float64()) for c in zip(*kept)] if kept else [pa.array([], pa.float64())] * 3
    yield pa.RecordBatch.from_arrays(columns, ["x", "y", "z"])


def best_by(df: DataFrame, keys: list[str], measure: str, order: list[str], smallest: bool = False) -> DataFrame:
    """Arg-max (or arg-min) row per key; ties go to the lowest ``order`` columns.

    An aggregation, not a window: each task keeps one candidate per key.
    """
    value = F.col(measure)
    rank = F.struct(
        (value if smallest else -value).alias("v"), *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)]
    )
    others = [c for c in df.columns if c not in keys]
    top = F.min_by(F.struct(*others), F.when(value.isNotNull(), rank)).alias("_best")
    return df.groupBy(*keys).agg(top).select(*keys, "_best.*")


def best_conf_per_hp(df: DataFrame, measure: str) -> DataFrame:
    return best_by(df, ["hp_idx"], measure, ["exp"])


def best_hp_per_conf(df: DataFrame, measure: str) -> DataFrame:
    return best_by(df, ["exp"], measure, ["hp_idx"])


def best_overall(df: DataFrame, measure: str) -> DataFrame:
    """Single best run, scanning hyper-parameter sets first, then configurations."""
    return best_by(df, [], measure, ["hp_idx", "exp"])


def mark_baseline_best(df: DataFrame, measure: str, smallest: bool = False) -> DataFrame:
    """Mark, in every configuration, the hyper-parameter set that is best on the baseline configuration."""
    baseline = df.where(F.col("exp") == int(BASELINE_CONFIG[1:]))
    best = best_by(baseline, [], measure, ["hp_idx"], smallest).select(F.col("hp_idx").alias("_hp")).alias("b")
    return df.withColumn("is_best", F.col("hp_idx") == best.scalar())


def best_report(results: DataFrame, digits: int = 2) -> DataFrame:
    """The best-settings report as rows of text (section, pos, line).

    ``results``: exp, hp_idx, hp, accuracy, overall_accuracy. Sections: by last-half and by overall accuracy, the best
    configuration of every setting, the best setting of every configuration, and the best run of all.
    """
    sections = []
    for measure, said in (("accuracy", "last half"), ("overall_accuracy", "overall")):
        value = F.format_string(f"%.{digits}f", F.col(measure))
        conf, hp = F.concat(F.lit("s"), F.col("exp").cast("string")), F.col("hp")
        for kind, best, pos, line in (
            ("configuration per setting", best_conf_per_hp, F.col("hp_idx"), F.concat_ws(": ", hp, conf, value)),
            ("setting per configuration", best_hp_per_conf, F.col("exp"), F.concat_ws(": ", conf, hp, value)),
            ("best run", best_overall, F.lit(0), F.concat_ws(": ", conf, hp, value)),
        ):
            rows = best(results.select("exp", "hp_idx", "hp", "accuracy", "overall_accuracy"), measure)
            section = F.lit(f"{kind} ({said})").alias("section")
            sections.append(rows.select(section, pos.cast("bigint").alias("pos"), line.alias("line")))
    total = sections[0]
    for s in sections[1:]:
        total = total.unionByName(s)
    return total


def conf_matrix(df: DataFrame, measures: list[str], confs: list[int]) -> DataFrame:
    """Hyper-parameter rows by configuration columns."""
    pivoted = df.groupBy("hp_idx").pivot("exp", confs).agg(*[F.first(m).alias(m) for m in measures])
    if len(measures) == 1:
        renamed = {str(c): f"{measures[0]}_s{c}" for c in confs}
    else:
        renamed = {f"{c}_{m}": f"{m}_s{c}" for c in confs for m in measures}
    return pivoted.withColumnsRenamed(renamed)


def series(df: DataFrame, x: list[str], y: list[str], by: list[str]) -> DataFrame:
    """Long form of chart data: one row per point of every measure in ``y``."""
    ids = list(dict.fromkeys(by + x))
    return df.select(*ids, *[F.col(m).cast("double").alias(m) for m in y]).unpivot(ids, y, "measure", "value")


def box_stats(points: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Quartiles, whiskers (extreme points within 1.5 IQR) and the number of fliers per key."""
    boxed = _with_fences(points, keys, value)
    inside = F.when(~F.col("_out"), F.col(value))
    return boxed.groupBy(*keys).agg(
        F.first("n").alias("n"),
        F.first("q1").alias("q1"),
        F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.min(inside).alias("whisker_low"),
        F.max(inside).alias("whisker_high"),
        F.count_if("_out").alias("fliers"),
    )


def box_fliers(points: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The points outside the whiskers, one row each."""
    return _with_fences(points, keys, value).where("_out").select(*points.columns)


def _with_fences(points: DataFrame, keys: list[str], value: str) -> DataFrame:
    boxes = bounded(quartiles(points, keys, value))
    reach = (F.col("q3") - F.col("q1")) * F.lit(1.5)
    outside = (F.col(value) < F.col("q1") - reach) | (F.col(value) > F.col("q3") + reach)
    return points.where(F.col(value).isNotNull()).join(boxes, keys).withColumn("_out", outside)


def compare_runs(runs: dict[str, DataFrame], keys: list[str] | None = None) -> DataFrame:
    """Result sets stacked under their labels and normalised together.

    Input columns: exp, the ``keys`` of a setting (hp_idx by default), accuracy, overall_accuracy, job_ms, task_ms.
    """
    keys = keys or ["hp_idx"]
    stacked = None
    for label, df in runs.items():
        part = df.select(
            F.lit(label).alias("run"), "exp", *keys, "accuracy", "overall_accuracy", "job_ms", "task_ms"
        )
        stacked = part if stacked is None else stacked.unionByName(part)
    scaled = normalize(stacked, ["accuracy", "overall_accuracy"], ["job_ms", "task_ms"])
    return scaled.withColumn("norm_joined_time", joined_time(F.col("norm_job_ms"), F.col("norm_task_ms")))


def single_node_results(metrics: DataFrame, times: DataFrame, depths: DataFrame) -> DataFrame:
    """Last-half and overall accuracy, F1, mean job and task times and tree depth of each run."""
    means = metrics.groupBy(*RUN).agg(
        F.round(F.avg("accuracy"), MEAN_DIGITS).alias("overall_accuracy"), F.round(F.avg("f1"), MEAN_DIGITS).alias("f1")
    )
    return (
        means.join(last_half_mean(metrics), RUN)
        .withColumnRenamed("last_half_accuracy", "accuracy")
        .join(
            times.select(
                *RUN,
                F.round(F.try_divide(F.col("job_ms"), F.col("jobs")), 6).alias("job_ms"),
                F.round(F.try_divide(F.col("task_ms"), F.col("tasks")), 2).alias("task_ms"),
            ),
            RUN,
        )
        .join(depths, RUN, "left")
    )


def results_table(results: DataFrame) -> DataFrame:
    """Single-node results with their normalised columns."""
    scaled = normalize(results, ["accuracy", "overall_accuracy", "f1"], ["job_ms", "task_ms"])
    return scaled.withColumn("norm_joined_time", joined_time(F.col("norm_job_ms"), F.col("norm_task_ms")))
