"""Hyper-parameter grids, system configurations and run names as data."""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The tuned settings and their order; the last key varies fastest.
CRITERIA = ["InfoGainSplitCriterion", "GiniSplitCriterion"]
LOSSES = ["LogisticLoss", "SquaredLoss", "HingeLoss", "PerceptronLoss"]
REGULARIZERS = ["ZeroRegularizer", "L2Regularizer"]
_TREE_WIDE = {
    "c": ["0.001", "0.01", "0.1"],
    "t": ["0.001", "0.05", "0.1"],
    "g": ["50", "800", "1500"],
    "s": CRITERIA,
    "d": ["20", "30"],
}
GRIDS: dict[tuple[str, str], dict[str, list[str]]] = {
    ("ht", "tweets"): {
        "c": ["0.01", "0.1"],
        "t": ["0.05", "0.1"],
        "g": ["200", "500"],
        "s": CRITERIA,
        "d": ["20", "30"],
    },
    ("ht", "agrawal"): _TREE_WIDE,
    ("sgd", "tweets"): {
        "l": ["0.001", "0.01", "0.05", "0.1"],
        "o": LOSSES,
        "r": REGULARIZERS,
        "p": ["0.001", "0.01"],
    },
    ("sgd", "tweets_file"): {"l": ["0.001", "0.01"], "o": LOSSES, "r": REGULARIZERS, "p": ["0.001", "0.01"]},
    ("rf", "tweets"): {"es": ["10"], "m": ["2"], "a": ["6"], **_TREE_WIDE},
    ("rf", "agrawal"): {"es": ["10"], "m": ["1"], "a": ["6"], **_TREE_WIDE},
    ("rf", "arff"): {
        "c": ["0.01", "0.1"],
        "t": ["0.05", "0.1"],
        "g": ["200"],
        "s": ["InfoGainSplitCriterion"],
        "d": ["20"],
        "e": ["10", "20"],
    },
    ("mc", "tweets"): {
        "c": ["0.01", "0.1"],
        "t": ["0.05", "0.1"],
        "g": ["200", "500"],
        "s": ["InfoGainSplitCriterion"],
        "d": ["20", "30"],
    },
    ("single", "arff"): {
        "c": ["0.01", "0.1"],
        "t": ["0.05", "0.1"],
        "g": ["200"],
        "s": CRITERIA,
        "p": ["", "-p"],
    },
    ("variants", "run"): {"p": ["0", "1"], "n": ["0", "2"], "b": ["0", "1"], "a": ["0", "1"]},
    ("variants", "convert"): {"p": ["0", "1"], "n": ["0", "1", "2", "3"], "a": ["0", "1"]},
}
GRIDS["sgd", "agrawal"] = GRIDS["sgd", "tweets"]
# Fixed values: (records per partition, partitions per second) of the nine system configurations s1..s9.
SYSTEM_CONFIGS = [(100, 16), (200, 16), (300, 16), (400, 16), (200, 8), (200, 24), (200, 32), (100, 48), (400, 12)]
# The three studies, each an ordered list of configurations.
CONFIG_GROUPS = {
    "vary_records": ["s1", "s2", "s3", "s4"],
    "vary_partitions": ["s5", "s2", "s6", "s7"],
    "constant_rate": ["s8", "s6", "s3", "s9"],
}
BASELINE_CONFIG = "s1"


def grid_size(model: str, dataset: str) -> int:
    return prod(len(v) for v in GRIDS[model, dataset].values())


def grid(spark: SparkSession, model: str, dataset: str) -> DataFrame:
    """(hp_idx, hp, one column per key): every combination in nested-loop order, by mixed radix on the index."""
    values = GRIDS[model, dataset]
    size = grid_size(model, dataset)
    rows = spark.range(size).select(F.col("id").cast("int").alias("hp_idx"))
    radix = size
    for key, choices in values.items():
        radix //= len(choices)
        digit = F.floor(F.col("hp_idx") / F.lit(radix)) % len(choices)
        rows = rows.withColumn(key, F.element_at(F.array(*map(F.lit, choices)), (digit + 1).cast("int")))
    return rows.withColumn("hp", encode_hp(model, list(values))).select("hp_idx", "hp", *values)


def encode_hp(model: str, keys: list[str]) -> Column:
    """``spark_<model>_<key><value>_...`` from the key columns."""
    return F.concat_ws("_", F.lit(f"spark_{model}"), *[F.concat(F.lit(k), F.col(k)) for k in keys])


def decode_hp(hp: Column) -> Column:
    """Map of key to value; a key is the leading letters of each part after the model name."""
    parts = F.split(hp, "_")
    parts = F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0)))
    keys = F.transform(parts, lambda p: F.regexp_extract(p, r"^([a-z]+)(.*)$", 1))
    values = F.transform(parts, lambda p: F.regexp_extract(p, r"^([a-z]+)(.*)$", 2))
    return F.map_from_arrays(keys, values)


def config_name(exp: Column) -> Column:
    return F.concat(F.lit("s"), exp.cast("string"))


def config_order(name: Column) -> Column:
    """Sort key of a configuration name: its number, so that s10 follows s9."""
    return F.regexp_extract(name, r"(\d+)$", 1).try_cast("int")


def system_configs(spark: SparkSession) -> DataFrame:
    rows = [(f"s{i + 1}", r, p, r * p) for i, (r, p) in enumerate(SYSTEM_CONFIGS)]
    return spark.createDataFrame(
        rows, "config string, records_per_partition int, partitions_per_s int, offered_rate int"
    )


def config_groups(spark: SparkSession) -> DataFrame:
    rows = [(g, i + 1, c) for g, members in CONFIG_GROUPS.items() for i, c in enumerate(members)]
    return spark.createDataFrame(rows, "study string, place int, config string")


def dataset_variant_name(p: Column, n: Column, b: Column, a: Column, features: Column) -> Column:
    """``tweets_p<p>_n<n>_b<b>[_a<a>]_nosp_f<features>``; the adaptive part is left out when NULL."""
    parts = [F.concat(F.lit(k), v.cast("string")) for k, v in (("p", p), ("n", n), ("b", b), ("a", a))]
    return F.concat_ws("_", F.lit("tweets"), *parts, F.lit("nosp"), F.concat(F.lit("f"), features.cast("string")))


def parse_variant_name(name: Column) -> Column:
    def part(key: str) -> Column:
        return F.regexp_extract(name, rf"_{key}(\d+)", 1).try_cast("int").alias(key)

    return F.struct(part("p"), part("n"), part("b"), part("a"), part("f"))


def dataset_of(path: Column) -> Column:
    return F.when(path.contains("agrawal"), "agrawal").when(path.contains("tweets"), "tweets")
