"""Registered queries over grids, runs and experiment results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tunelens.operators import experiments as x
from tunelens.plans import fixtures, grids
from tunelens.plans import oracle_views as v
from tunelens.session import scratch_path, stored
from tunelens.sources import runs

CONFS = list(range(1, 10))
HT_KEYS = ["c", "t", "g", "s", "d"]
SGD_KEYS = ["l", "o", "r", "p"]
NORMS = [
    "norm_accuracy",
    "norm_recall",
    "norm_precision",
    "norm_f1",
    "norm_job_ms",
    "norm_task_ms",
    "norm_throughput",
    "norm_latency",
    "norm_joined_time",
]


def _rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def _metrics(spark, sf_dir, batches=20):
    return fixtures.percent(fixtures.metrics(spark, sf_dir, batches))


def _cube(spark, sf_dir):
    return x.experiment_cube(_metrics(spark, sf_dir), fixtures.times(spark, sf_dir))


def _norm_cube(spark, sf_dir):
    # The cube has one row per run: stored once, it is read for its extremes and for its rows.
    return x.normalized_cube(stored(_cube(spark, sf_dir), "cube"))


def _results(spark, sf_dir, batches=20):
    return x.single_node_results(
        _metrics(spark, sf_dir, batches), fixtures.times(spark, sf_dir), fixtures.depths(spark, sf_dir)
    )


def _results_table(spark, sf_dir, batches=20):
    return x.results_table(stored(_results(spark, sf_dir, batches), "results"))


def _grid_query(model, dataset):
    """Every grid row with the number of table rows and the quantity that fall on it."""

    def run(spark, sf_dir):
        size = grids.grid_size(model, dataset)
        used = (
            fixtures.table(spark, sf_dir, "lineitem")
            .groupBy((F.col("l_partkey") % size).cast("int").alias("hp_idx"))
            .agg(F.count("*").alias("rows"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
        )
        return grids.grid(spark, model, dataset).join(used, "hp_idx", "left")

    return run


def _grid_sql(model, dataset):
    values = grids.GRIDS[model, dataset]
    size = grids.grid_size(model, dataset)
    radix, index = size, []
    for k, choices in values.items():
        radix //= len(choices)
        index.append(f"{k}_i * {radix}")
    froms = ", ".join(
        "(VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(choices)) + f") v_{k}({k}_i, {k})"
        for k, choices in values.items()
    )
    name = f"'spark_{model}'" + "".join(f" || '_{k}' || {k}" for k in values)
    return f"""WITH g AS (SELECT CAST({" + ".join(index)} AS INTEGER) AS hp_idx, {name} AS hp,
        {", ".join(values)} FROM {froms}), u AS (SELECT CAST(l_partkey % {size} AS INTEGER) AS hp_idx,
        count(*) AS rows, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1)
        SELECT * FROM g LEFT JOIN u USING (hp_idx)"""


def _decode(spark, sf_dir):
    """Rows and quantity by decoded hyper-parameter value, over all keys of the forest grid."""
    named = _grid_query("rf", "tweets")(spark, sf_dir)
    return (
        named.select(F.explode(grids.decode_hp(F.col("hp"))).alias("key", "value"), "rows")
        .groupBy("key", "value")
        .agg(F.count("*").alias("settings"), F.sum("rows").alias("rows"))
    )


def _system_configs(spark, sf_dir):
    load = _metrics(spark, sf_dir).groupBy(grids.config_name(F.col("exp")).alias("config")).agg(
        F.sum("instances").alias("instances")
    )
    joined = grids.system_configs(spark).join(load, "config", "left")
    return joined.withColumn("seconds", F.round(F.try_divide("instances", "offered_rate"), 6))


def _config_groups(spark, sf_dir):
    return grids.config_groups(spark).join(_system_configs(spark, sf_dir), "config", "left")


def _variants(spark, sf_dir):
    """Variant names of all events, parsed back and counted."""
    k = F.col("event_id")
    name = grids.dataset_variant_name(
        k % 2, F.floor(k / 2) % 4, F.floor(k / 8) % 2, F.when(k % 3 > 0, k % 3 - 1), F.lit(16)
    )
    parsed = grids.parse_variant_name(F.col("variant"))
    return (
        fixtures.table(spark, sf_dir, "events")
        .groupBy(name.alias("variant"))
        .agg(F.count("*").alias("events"))
        .select("variant", "events", grids.dataset_of(F.col("variant")).alias("dataset"), parsed.alias("v"))
        .select("variant", "events", "dataset", "v.*")
    )


def _metrics_read(spark, sf_dir):
    names = grids.grid(spark, "ht", "tweets").select("hp_idx", "hp")
    raw = fixtures.metrics(spark, sf_dir).join(names, "hp_idx").withColumn("exp", grids.config_name(F.col("exp")))
    path = scratch_path(spark, "metrics")
    runs.write_metrics_csv(raw, path)
    return _rounded(runs.read_metrics_csv(spark, path), x.METRICS)


def _results_round_trip(spark, sf_dir):
    table = _results_table(spark, sf_dir).join(grids.grid(spark, "ht", "tweets").drop("hp"), "hp_idx")
    path = scratch_path(spark, "results")
    runs.write_results_csv(table, path, HT_KEYS)
    back = runs.read_results_csv(spark, path)
    return _rounded(back, [c for c in back.columns if c not in ("exp", *HT_KEYS)])


def _results_read_sgd(spark, sf_dir):
    table = _results_table(spark, sf_dir).join(grids.grid(spark, "sgd", "tweets").drop("hp"), "hp_idx")
    path = scratch_path(spark, "results")
    runs.write_results_csv(table, path, SGD_KEYS, "sgd")
    back = runs.read_results_csv(spark, path)
    return _rounded(back, [c for c in back.columns if c not in ("exp", *SGD_KEYS)])


def _results_read_cluster(spark, sf_dir):
    cube = _norm_cube(spark, sf_dir).join(grids.grid(spark, "ht", "tweets").drop("hp"), "hp_idx")
    path = scratch_path(spark, "results")
    runs.write_results_csv(cube, path, HT_KEYS, "cluster")
    back = runs.read_results_csv(spark, path)
    return _rounded(back, [c for c in back.columns if c not in ("exp", *HT_KEYS)])


def _compare_files(spark, sf_dir):
    """The runs of 20 and of 10 batches, each from its result file, one by titles and one by column numbers."""
    names = grids.grid(spark, "ht", "tweets").drop("hp")
    paths = []
    for batches in (20, 10):
        paths.append(scratch_path(spark, "results"))
        runs.write_results_csv(_results_table(spark, sf_dir, batches).join(names, "hp_idx"), paths[-1], HT_KEYS)
    sides = {
        "20 batches": runs.read_results_csv(spark, paths[0]),
        "10 batches": runs.read_results_columns(spark, paths[1], 5, 7, 9, 13, 15),
    }
    compared = x.compare_runs(sides, HT_KEYS)
    return _rounded(compared, [c for c in compared.columns if c.startswith("norm_")])


def _best_report(spark, sf_dir):
    names = grids.grid(spark, "ht", "tweets").select("hp_idx", "hp")
    return x.best_report(stored(_results(spark, sf_dir).join(names, "hp_idx"), "results"), digits=9)


def _conf_read(spark, sf_dir):
    """Settings written one file per supplier nation, with comments and blank lines between them."""
    lines = fixtures.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), F.col("s_nationkey")).alias("exp"),
        F.explode(
            F.array(
                F.lit("# supplier"),
                F.lit(""),
                F.concat(F.lit("spark.supplier."), F.col("s_suppkey"), F.lit("   "), F.col("s_name")),
            )
        ).alias("value"),
    )
    path = scratch_path(spark, "conf")
    lines.write.partitionBy("exp").text(path)
    return runs.read_spark_conf(spark, path)


def _tree_depth(spark, sf_dir):
    """Learner logs written from all line items; runs on configuration 9 never mention a depth."""
    lines = fixtures.table(spark, sf_dir, "lineitem").select(
        grids.config_name((F.col("l_suppkey") % 9 + 1)).alias("exp"),
        (F.col("l_partkey") % 32).alias("hp"),
        F.when(
            F.col("l_suppkey") % 9 < 8, F.format_string("step %d depth: %d | leaves", "l_orderkey", "l_linenumber")
        )
        .otherwise(F.format_string("step %d", "l_orderkey"))
        .alias("value"),
    )
    path = scratch_path(spark, "logs")
    lines.write.partitionBy("exp", "hp").text(path)
    return runs.read_tree_depth(spark, path)


def _last_half(spark, sf_dir):
    return x.last_half_mean(_metrics(spark, sf_dir))


def _scores(spark, sf_dir):
    scored = x.weighted_scores(_norm_cube(spark, sf_dir))
    return _rounded(scored.select("exp", "hp_idx", *x.SCORES), x.SCORES)


def _distances(spark, sf_dir):
    scored = x.pareto_distances(_norm_cube(spark, sf_dir))
    return _rounded(scored.select("exp", "hp_idx", *x.DISTANCES), x.DISTANCES)


def _front(spark, sf_dir):
    cube = stored(_cube(spark, sf_dir), "cube")
    return x.pareto_front(cube, "accuracy", "throughput").select("exp", "hp_idx", "accuracy", "throughput")


def _front_3(spark, sf_dir):
    """Trade-offs of accuracy, throughput and latency, of which less is better."""
    cube = stored(_norm_cube(spark, sf_dir), "cube")
    return x.pareto_front_3(cube, "norm_accuracy", "norm_throughput", "norm_latency").select(
        "exp", "hp_idx", "accuracy", "throughput", "latency")


def _ordered_configs(spark, sf_dir):
    """Runs in the order of their configurations, by number: s10 follows s9."""
    names = fixtures.table(spark, sf_dir, "orders").selectExpr("concat('run/s', 1 + o_custkey % 12) AS name")
    counted = names.groupBy("name").agg(F.count("*").alias("runs"))
    place = F.row_number().over(Window.orderBy(grids.config_order(F.col("name"))))  # a row per configuration
    return counted.select("name", "runs", place.alias("place"))


def _best(operator):
    """Best runs by last-half and by overall accuracy."""

    def run(spark, sf_dir):
        results = stored(_results(spark, sf_dir), "results").select("exp", "hp_idx", "accuracy", "overall_accuracy")
        parts = [
            operator(results, measure).select(F.lit(by).alias("by"), "exp", "hp_idx", F.col(measure).alias("best"))
            for by, measure in (("last_half", "accuracy"), ("overall", "overall_accuracy"))
        ]
        return parts[0].unionByName(parts[1])

    return run


def _marked(spark, sf_dir):
    cube = stored(x.pareto_distances(_norm_cube(spark, sf_dir)), "scored")
    by_accuracy = x.mark_baseline_best(cube, "accuracy").withColumnRenamed("is_best", "best_accuracy")
    marked = x.mark_baseline_best(by_accuracy, "distance_acc_thr_lat", smallest=True)
    return marked.select("exp", "hp_idx", "best_accuracy", F.col("is_best").alias("best_distance"))


def _time_matrix(spark, sf_dir):
    return x.conf_matrix(_results(spark, sf_dir), ["job_ms", "task_ms", "depth"], CONFS)


BOXED = ["accuracy", "norm_accuracy", "norm_joined_time", "score_acc_joined", "score_acc_job_task"]


def _points(spark, sf_dir):
    scored = x.weighted_scores(_norm_cube(spark, sf_dir))
    return _rounded(x.series(scored, ["hp_idx"], BOXED, ["exp"]), ["value"])


def _boxes(spark, sf_dir):
    boxes = x.box_stats(_points(spark, sf_dir), ["measure", "exp"])
    # A quarter of a 6-digit gap has 8 digits: rounding there leaves no ties.
    return _rounded(boxes, ["q1", "median", "q3", "whisker_low", "whisker_high"], 9)


def _fliers(spark, sf_dir):
    return x.box_fliers(_points(spark, sf_dir), ["measure", "exp"])


SERIES = ["recall", "precision", "f1", "accuracy", "throughput", "latency", "jobs", "job_ms", "tasks", "task_ms"]


def _series_by_hp(spark, sf_dir):
    return x.series(_cube(spark, sf_dir), ["hp_idx"], SERIES, ["exp"])


def _series_grouped(spark, sf_dir):
    """Accuracy, throughput and latency by study and place, with the baseline's best setting marked."""
    cube = x.mark_baseline_best(stored(_cube(spark, sf_dir), "cube"), "accuracy")
    cube = cube.withColumn("config", grids.config_name(F.col("exp")))
    points = x.series(cube, ["hp_idx"], ["accuracy", "throughput", "latency"], ["config", "is_best"])
    return points.join(grids.config_groups(spark), "config")


def _compare(spark, sf_dir):
    """The same runs cut into 20 and into 10 batches."""
    a, b = _results(spark, sf_dir), _results(spark, sf_dir, 10)
    compared = x.compare_runs({"20 batches": stored(a, "a"), "10 batches": stored(b, "b")})
    return _rounded(compared, [c for c in compared.columns if c.startswith("norm_")])


QUERIES = {
    "hp_grid_ht": _grid_query("ht", "tweets"),
    "hp_grid_ht_agrawal": _grid_query("ht", "agrawal"),
    "hp_grid_sgd": _grid_query("sgd", "tweets"),
    "hp_grid_sgd_tweets_file": _grid_query("sgd", "tweets_file"),
    "hp_grid_rf": _grid_query("rf", "tweets"),
    "hp_grid_rf_arff": _grid_query("rf", "arff"),
    "hp_grid_mc": _grid_query("mc", "tweets"),
    "hp_grid_single": _grid_query("single", "arff"),
    "hp_decode": _decode,
    "system_configs": _system_configs,
    "config_groups": _config_groups,
    "variant_names": _variants,
    "metrics_read": _metrics_read,
    "metrics_summary": lambda s, d: x.metric_summary(_metrics(s, d)),
    "metrics_summary_weighted": lambda s, d: x.metric_summary(_metrics(s, d), weighted=True),
    "metrics_last_half": _last_half,
    "learning_curve": lambda s, d: x.learning_curve(_metrics(s, d)),
    "results_read": _results_round_trip,
    "results_read_sgd": _results_read_sgd,
    "results_read_cluster": _results_read_cluster,
    "compare_runs_files": _compare_files,
    "best_report": _best_report,
    "conf_read": _conf_read,
    "tree_depth": _tree_depth,
    "experiment_cube": _cube,
    "experiment_normalized": lambda s, d: _rounded(_norm_cube(s, d), NORMS),
    "experiment_results_table": lambda s, d: _rounded(
        _results_table(s, d),
        ["norm_accuracy", "norm_overall_accuracy", "norm_f1", "norm_job_ms", "norm_task_ms", "norm_joined_time"],
    ),
    "score_weighted": _scores,
    "score_pareto_distance": _distances,
    "pareto_front": _front,
    "pareto_front_3": _front_3,
    "configs_in_order": _ordered_configs,
    "best_conf_per_hp": _best(x.best_conf_per_hp),
    "best_hp_per_conf": _best(x.best_hp_per_conf),
    "best_overall": _best(x.best_overall),
    "best_hp_marked": _marked,
    "time_matrix": _time_matrix,
    "box_stats": _boxes,
    "box_fliers": _fliers,
    "series_by_hp": _series_by_hp,
    "series_grouped": _series_grouped,
    "compare_runs": _compare,
}

_M = v.metrics()
_CUBE = f"WITH {_M}, {v.TIMES}, {v.SUMMARY}, {v.CUBE}"
_NORM = f"{_CUBE}, {v.NORM_CUBE}"
_SINGLE = f"WITH {_M}, {v.TIMES}, {v.SUMMARY}, {v.LAST_HALF}, {v.SINGLE}"


def _round_list(columns, digits=6):
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


def _score_sql(weights):
    return "0.0::DOUBLE + " + " + ".join(f"{w!r}::DOUBLE * {m}" for m, w in weights.items())


def _distance_sql(measures):
    gaps = " + ".join(f"(1.0 - {m} / 100.0::DOUBLE) * (1.0 - {m} / 100.0::DOUBLE)" for m in measures)
    return f"sqrt(0.0::DOUBLE + {gaps}) * 100.0::DOUBLE"


def _best_sql(partition, order):
    over = f"PARTITION BY {partition}" if partition else ""
    pick = """SELECT '{by}' AS by, exp, hp_idx, {m} AS best FROM r
        QUALIFY row_number() OVER ({over} ORDER BY {m} DESC, {order}) = 1"""
    parts = [
        pick.format(by="last_half", m="accuracy", over=over, order=order),
        pick.format(by="overall", m="overall_accuracy", over=over, order=order),
    ]
    return f"{_SINGLE} SELECT * FROM ({parts[0]}) UNION ALL SELECT * FROM ({parts[1]})"


_CONFIG_VALUES = ", ".join(
    f"('s{i + 1}', {r}, {p}, {r * p})" for i, (r, p) in enumerate(grids.SYSTEM_CONFIGS)
)
_SYSTEM = f"""WITH {_M}, k(config, records_per_partition, partitions_per_s, offered_rate) AS (VALUES {_CONFIG_VALUES}),
    l AS (SELECT 's' || exp AS config, CAST(sum(instances) AS BIGINT) AS instances FROM m GROUP BY 1),
    sc AS (SELECT *, round(CAST(instances AS DOUBLE) / offered_rate, 6) AS seconds FROM k LEFT JOIN l USING (config))"""
_GROUP_VALUES = ", ".join(
    f"('{g}', {i + 1}, '{c}')" for g, members in grids.CONFIG_GROUPS.items() for i, c in enumerate(members)
)
_GROUPS = f"gr(study, place, config) AS (VALUES {_GROUP_VALUES})"
_STACK = "UNION ALL".join(
    f" SELECT exp, hp_idx, '{m}' AS measure, CAST({m} AS DOUBLE) AS value FROM {{src}} " for m in SERIES
)
_BOX_POINTS = f"""{_NORM}, sc AS (SELECT *, {", ".join(f"{_score_sql(x.SCORES[k])} AS {k}"
    for k in ("score_acc_joined", "score_acc_job_task"))} FROM n),
    p AS ({"UNION ALL".join(f" SELECT exp, hp_idx, '{b}' AS measure, round({b}, 6) + 0.0 AS value FROM sc "
    for b in BOXED)}), q AS (SELECT measure, exp, count(value) AS n, quantile_cont(value, 0.25) AS q1,
    quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM p WHERE value IS NOT NULL GROUP BY 1, 2),
    o AS (SELECT p.*, n, q1, median, q3, value < q1 - (q3 - q1) * 1.5 OR value > q3 + (q3 - q1) * 1.5 AS out
    FROM p JOIN q USING (measure, exp) WHERE value IS NOT NULL)"""
_ROUND5 = _round_list(["q1", "median", "q3", "whisker_low", "whisker_high"], 9)
_DEPTHS = """CAST(l_suppkey % 9 + 1 AS INTEGER) AS exp, CAST(l_partkey % 32 AS VARCHAR) AS hp,
    CASE WHEN l_suppkey % 9 < 8 THEN max(l_linenumber) ELSE 0 END AS depth"""


def _compare_sql():
    def chain(name, batches):
        # The same views under other names, for another number of batches.
        text = ", ".join([v.metrics("m", batches), v.TIMES, v.SUMMARY, v.LAST_HALF, v.SINGLE])
        return f"""SELECT '{name}' AS run, exp, hp_idx, accuracy, overall_accuracy, job_ms, task_ms
            FROM (WITH {text} SELECT * FROM r)"""

    norms = ", ".join(
        [v.norm("accuracy"), v.norm("overall_accuracy"), v.norm("job_ms", True), v.norm("task_ms", True)]
    )
    columns = ["norm_accuracy", "norm_overall_accuracy", "norm_job_ms", "norm_task_ms", "norm_joined_time"]
    return f"""WITH u AS ({chain("20 batches", 20)} UNION ALL {chain("10 batches", 10)}),
        a AS (SELECT *, {norms} FROM u), b AS (SELECT *, (norm_job_ms + norm_task_ms) / 2 AS norm_joined_time FROM a)
        SELECT run, exp, hp_idx, accuracy, overall_accuracy, job_ms, task_ms, {_round_list(columns)} FROM b"""


ORACLES = {
    "hp_grid_ht": _grid_sql("ht", "tweets"),
    "hp_grid_ht_agrawal": _grid_sql("ht", "agrawal"),
    "hp_grid_sgd": _grid_sql("sgd", "tweets"),
    "hp_grid_sgd_tweets_file": _grid_sql("sgd", "tweets_file"),
    "hp_grid_rf": _grid_sql("rf", "tweets"),
    "hp_grid_rf_arff": _grid_sql("rf", "arff"),
    "hp_grid_mc": _grid_sql("mc", "tweets"),
    "hp_grid_single": _grid_sql("single", "arff"),
    "hp_decode": f"""WITH g AS ({_grid_sql("rf", "tweets")})
        {" UNION ALL ".join(f"SELECT '{k}' AS key, {k} AS value, count(*) AS settings, CAST(sum(rows) AS BIGINT) "
        f"AS rows FROM g GROUP BY 2" for k in grids.GRIDS["rf", "tweets"])}""",
    "system_configs": f"{_SYSTEM} SELECT * FROM sc",
    "config_groups": f"{_SYSTEM}, {_GROUPS} SELECT * FROM gr LEFT JOIN sc USING (config)",
    "variant_names": """WITH e AS (SELECT CAST(event_id % 2 AS INTEGER) AS p, CAST((event_id // 2) % 4 AS INTEGER) AS n,
        CAST((event_id // 8) % 2 AS INTEGER) AS b,
        CAST(CASE WHEN event_id % 3 > 0 THEN event_id % 3 - 1 END AS INTEGER) AS a FROM events)
        SELECT 'tweets_p' || p || '_n' || n || '_b' || b || coalesce('_a' || a, '') || '_nosp_f16' AS variant,
        count(*) AS events, 'tweets' AS dataset, p, n, b, a, 16 AS f FROM e GROUP BY ALL""",
    "metrics_read": f"""WITH {_M}, g AS ({_grid_sql("ht", "tweets")}), o AS (SELECT *, row_number() OVER
        (PARTITION BY exp, hp_idx ORDER BY batch) - 1 AS no FROM m) SELECT exp, hp, no AS batch, instances, accuracy,
        recall, precision, f1 FROM o JOIN g USING (hp_idx)""",
    "metrics_summary": f"WITH {_M}, {v.SUMMARY} SELECT * FROM s",
    "metrics_summary_weighted": f"""WITH {_M} SELECT exp, hp_idx, CAST(sum(instances) AS BIGINT) AS instances,
        {", ".join(f"round(sum({c} * instances) / sum(instances), 9) AS {c}" for c in x.METRICS)}
        FROM m GROUP BY 1, 2""",
    "metrics_last_half": f"WITH {_M}, {v.LAST_HALF} SELECT * FROM lh",
    "learning_curve": f"""WITH {_M}, {v.LAST_HALF} SELECT m.*, last_half_accuracy, CAST(sum(instances) OVER w AS BIGINT)
        AS cumulative_instances, row_number() OVER w AS batch_no FROM m JOIN lh USING (exp, hp_idx)
        WINDOW w AS (PARTITION BY exp, hp_idx ORDER BY batch)""",
    "conf_read": """SELECT CAST(s_nationkey AS INTEGER) AS exp, 'spark.supplier.' || s_suppkey AS key,
        s_name AS value FROM supplier""",
    "tree_depth": f"SELECT {_DEPTHS} FROM lineitem GROUP BY l_suppkey % 9, l_partkey % 32",
    "experiment_cube": f"{_CUBE} SELECT * FROM c",
    "experiment_normalized": f"{_NORM} SELECT * EXCLUDE ({', '.join(NORMS)}), {_round_list(NORMS)} FROM n",
    "score_weighted": f"""{_NORM}, q AS (SELECT exp, hp_idx,
        {", ".join(f"{_score_sql(w)} AS {k}" for k, w in x.SCORES.items())} FROM n)
        SELECT exp, hp_idx, {_round_list(x.SCORES)} FROM q""",
    "score_pareto_distance": f"""{_NORM}, q AS (SELECT exp, hp_idx,
        {", ".join(f"{_distance_sql(m)} AS {k}" for k, m in x.DISTANCES.items())} FROM n)
        SELECT exp, hp_idx, {_round_list(x.DISTANCES)} FROM q""",
    "pareto_front": f"""{_CUBE} SELECT exp, hp_idx, accuracy, throughput FROM c WHERE NOT EXISTS (SELECT 1 FROM c d
        WHERE d.accuracy >= c.accuracy AND d.throughput >= c.throughput
        AND (d.accuracy > c.accuracy OR d.throughput > c.throughput))""",
    "pareto_front_3": f"""{_NORM} SELECT exp, hp_idx, accuracy, throughput, latency FROM n c WHERE NOT EXISTS (SELECT 1 FROM n d
        WHERE d.accuracy >= c.accuracy AND d.throughput >= c.throughput AND d.latency <= c.latency
        AND (d.accuracy > c.accuracy OR d.throughput > c.throughput OR d.latency < c.latency))""",
    "configs_in_order": """SELECT 'run/s' || k AS name, count(*) AS runs, CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS place
        FROM (SELECT 1 + o_custkey % 12 AS k FROM orders) GROUP BY k""",
    "best_conf_per_hp": _best_sql("hp_idx", "exp"),
    "best_hp_per_conf": _best_sql("exp", "hp_idx"),
    "best_overall": _best_sql("", "hp_idx, exp"),
    "best_hp_marked": f"""{_NORM}, q AS (SELECT *, {_distance_sql(x.DISTANCES["distance_acc_thr_lat"])} AS dist FROM n),
        b AS (SELECT arg_max(hp_idx, (accuracy, -hp_idx)) AS ba, arg_min(hp_idx, (dist, hp_idx)) AS bd
        FROM q WHERE exp = 1) SELECT exp, hp_idx, hp_idx = ba AS best_accuracy, hp_idx = bd AS best_distance
        FROM q, b""",
    "time_matrix": f"""{_SINGLE} SELECT hp_idx, {", ".join(f"max({m}) FILTER (exp = {c}) AS {m}_s{c}"
        for m in ("job_ms", "task_ms", "depth") for c in CONFS)} FROM r GROUP BY hp_idx""",
    "box_stats": f"""{_BOX_POINTS}, b AS (SELECT measure, exp, any_value(n) AS n, any_value(q1) AS q1,
        any_value(median) AS median, any_value(q3) AS q3, min(value) FILTER (NOT out) AS whisker_low,
        max(value) FILTER (NOT out) AS whisker_high, count(*) FILTER (out) AS fliers FROM o GROUP BY 1, 2)
        SELECT measure, exp, n, fliers, {_ROUND5} FROM b""",
    "box_fliers": f"{_BOX_POINTS} SELECT measure, exp, hp_idx, value FROM o WHERE out",
    "series_by_hp": f"{_CUBE} {_STACK.format(src='c')}",
    "series_grouped": f"""{_CUBE}, {_GROUPS}, b AS (SELECT arg_max(hp_idx, (accuracy, -hp_idx)) AS ba FROM c
        WHERE exp = 1), k AS (SELECT 's' || exp AS config, *, hp_idx = ba AS is_best FROM c, b),
        p AS ({" UNION ALL ".join(f"SELECT config, is_best, hp_idx, '{m}' AS measure, {m} AS value FROM k"
        for m in ("accuracy", "throughput", "latency"))}) SELECT * FROM p JOIN gr USING (config)""",
    "compare_runs": _compare_sql(),
}
_TABLE_NORMS = ["norm_accuracy", "norm_overall_accuracy", "norm_f1", "norm_job_ms", "norm_task_ms", "norm_joined_time"]
_TABLE = f"""{_SINGLE}, a AS (SELECT *, {v.norm("accuracy")}, {v.norm("overall_accuracy")}, {v.norm("f1")},
    {v.norm("job_ms", True)}, {v.norm("task_ms", True)} FROM r),
    tb AS (SELECT *, (norm_job_ms + norm_task_ms) / 2 AS norm_joined_time FROM a)"""
ORACLES["experiment_results_table"] = (
    f"{_TABLE} SELECT * EXCLUDE ({', '.join(_TABLE_NORMS)}), {_round_list(_TABLE_NORMS)} FROM tb"
)
_BACK = ["accuracy", "overall_accuracy", "f1", "job_ms", "task_ms", *_TABLE_NORMS]
ORACLES["results_read"] = f"""{_TABLE}, g AS ({_grid_sql("ht", "tweets")})
    SELECT exp, c, t, g, s, d, CAST(depth AS DOUBLE) AS depth, {_round_list(_BACK)}
    FROM (SELECT * EXCLUDE (hp_idx), hp_idx AS h FROM tb) JOIN (SELECT hp_idx AS h, c, t, g, s, d FROM g) USING (h)"""
ORACLES["results_read_sgd"] = f"""{_TABLE}, g AS ({_grid_sql("sgd", "tweets")})
    SELECT exp, l, o, r, p, {_round_list(_BACK)}
    FROM (SELECT * EXCLUDE (hp_idx), hp_idx AS h FROM tb) JOIN (SELECT hp_idx AS h, l, o, r, p FROM g) USING (h)"""
_CLUSTER_BACK = ["instances", "accuracy", "norm_accuracy", "recall", "norm_recall", "precision", "norm_precision", "f1",
                 "norm_f1", "jobs", "job_ms", "norm_job_ms", "tasks", "task_ms", "norm_task_ms", "norm_joined_time"]
ORACLES["results_read_cluster"] = f"""{_NORM}, g AS ({_grid_sql("ht", "tweets")})
    SELECT exp, c, t, g, s, d, {", ".join(f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in _CLUSTER_BACK)}
    FROM (SELECT * EXCLUDE (hp_idx), hp_idx AS h FROM n) JOIN (SELECT hp_idx AS h, c, t, g, s, d FROM g) USING (h)"""
ORACLES["compare_runs_files"] = f"""SELECT run, exp, c, t, g, s, d, accuracy, overall_accuracy, job_ms, task_ms,
    norm_accuracy, norm_overall_accuracy, norm_job_ms, norm_task_ms, norm_joined_time
    FROM (SELECT * EXCLUDE (hp_idx), hp_idx AS h FROM ({_compare_sql()}))
    JOIN (SELECT hp_idx AS h, c, t, g, s, d FROM ({_grid_sql("ht", "tweets")})) USING (h)"""


def _report_sql():
    parts = []
    for m, said in (("accuracy", "last half"), ("overall_accuracy", "overall")):
        for kind, pos, over, order, line in (
            ("configuration per setting", "hp_idx", "PARTITION BY hp_idx", "exp", "hp || ': s' || exp"),
            ("setting per configuration", "exp", "PARTITION BY exp", "hp_idx", "'s' || exp || ': ' || hp"),
            ("best run", "0", "", "hp_idx, exp", "'s' || exp || ': ' || hp"),
        ):
            parts.append(f"""SELECT * FROM (SELECT '{kind} ({said})' AS section, CAST({pos} AS BIGINT) AS pos,
                {line} || ': ' || printf('%.9f', {m}) AS line FROM rh
                QUALIFY row_number() OVER ({over} ORDER BY {m} DESC, {order}) = 1)""")
    return f"""{_SINGLE}, g AS ({_grid_sql("ht", "tweets")}), rh AS (SELECT r.*, hp FROM r JOIN g USING (hp_idx))
        {" UNION ALL ".join(parts)}"""


ORACLES["best_report"] = _report_sql()
