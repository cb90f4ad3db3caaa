"""ARFF relations, and head files that describe a relation's columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATA_MARK = "@data"
ATTRIBUTE_MARK = "@attribute"
MAX_COLUMNS = 100_000


@dataclass(frozen=True)
class Attribute:
    """One declared column; ``domain`` lists the values of a nominal one."""

    name: str
    kind: str
    domain: tuple[str, ...] = ()

    @property
    def nominal(self) -> bool:
        return bool(self.domain)

    @property
    def line(self) -> str:
        return f"{ATTRIBUTE_MARK} {self.name} {'{' + ','.join(self.domain) + '}' if self.nominal else self.kind}"


def parse_attribute(line: str) -> Attribute:
    _, name, kind = line.strip().split()[:3]
    if kind.startswith("{") and kind.endswith("}"):
        return Attribute(name, "nominal", tuple(kind[1:-1].split(",")))
    return Attribute(name, kind)


def read_arff_header(spark: SparkSession, path: str | list[str]) -> list[Attribute]:
    """Attributes of a relation that lies in one file or in many.

    Files without marked lines hold rows only; all others must declare the same attributes in the same order, and end
    their header with a data mark in their first block. Headers are compared where they are: two of them at most reach the
    driver, with no more lines than a relation may have columns.
    """
    lines = spark.read.text(path).where(F.col("_metadata.file_block_start") == 0).select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"), F.trim("value").alias("value"))
    marked = lines.where(F.col("value").startswith("@"))
    heads = marked.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("row", "value")))["value"].alias("lines"))
    declared = F.filter("lines", lambda v: v.contains(DATA_MARK) | v.contains(ATTRIBUTE_MARK))
    found = heads.select("file", declared.alias("lines")).groupBy("lines").agg(F.min("file").alias("file"))
    found = found.orderBy("file").take(2)
    if len(found) > 1:
        raise ValueError(f"{found[0]['file']} and {found[1]['file']} declare different attributes")
    head = list(found[0]["lines"]) if found else []
    end = next((i for i, line in enumerate(head) if DATA_MARK in line), None)
    if end is None:
        raise ValueError(f"no {DATA_MARK} among the first lines of {found[0]['file'] if found else path}")
    if end > MAX_COLUMNS:
        raise ValueError(f"{found[0]['file']} declares {end} attributes, more than {MAX_COLUMNS}")
    return [parse_attribute(line) for line in head[:end]]


def is_data_line(value: Column) -> Column:
    return (F.trim(value) != "") & ~F.substring(value, 1, 1).isin("@", "%")


def read_arff(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows typed by the header that all files share; the domain of a nominal column is kept in its field metadata.

    A cell that does not fit its declared type fails the job, and so does a row with too few or too many cells.
    """
    attributes = read_arff_header(spark, path)
    rows = spark.read.text(path).where(is_data_line(F.col("value")))
    cells = F.split(F.trim("value"), ",")
    wrong = F.raise_error(F.concat(F.lit(f"not {len(attributes)} cells: "), F.col("value")))
    cells = rows.select(F.when(F.size(cells) == len(attributes), cells).otherwise(wrong).alias("c"))
    columns = []
    for i, a in enumerate(attributes):
        if a.nominal:
            columns.append(F.col("c")[i].alias(a.name, metadata={"domain": list(a.domain)}))
        else:
            columns.append(F.col("c")[i].cast("double").alias(a.name))
    return cells.select(*columns)


def attributes_of(df: DataFrame) -> list[Attribute]:
    """Attributes of a DataFrame; columns without a domain in their metadata are numeric."""
    return [
        Attribute(f.name, "nominal", tuple(f.metadata["domain"]))
        if "domain" in f.metadata
        else Attribute(f.name, "numeric")
        for f in df.schema.fields
    ]


def with_domains(df: DataFrame, domains: dict[str, list[str]]) -> DataFrame:
    """Declare nominal columns."""
    return df.select(
        *[
            F.col(c).cast("string").alias(c, metadata={"domain": list(domains[c])}) if c in domains else F.col(c)
            for c in df.columns
        ]
    )


def arff_lines(df: DataFrame) -> DataFrame:
    """Data lines of a relation, class last as the column order has it."""
    return df.select(F.concat_ws(",", *[F.col(c).cast("string") for c in df.columns]).alias("value"))


def write_arff(df: DataFrame, path: str, relation: str = "relation") -> None:
    """A folder of text files; the first file holds the header alone, the rows follow in the others."""
    header = [f"@relation {relation}", *[a.line for a in attributes_of(df)], DATA_MARK]
    head = df.sparkSession.createDataFrame([(line,) for line in header], "value string").coalesce(1)
    head.unionByName(arff_lines(df)).write.text(path)


def clean_trailing(lines: DataFrame) -> DataFrame:
    """Drop the stray comma at the end of data lines; header and comment lines stay as they are."""
    value = F.col("value")
    return lines.select(
        F.when(is_data_line(value), F.regexp_replace(value, r",\s*$", "")).otherwise(value).alias("value")
    )


def head_lines(profile: DataFrame, digits: int | None = None) -> DataFrame:
    """Head-file lines (pos, value) of a profile; the comment line comes first."""

    def number(name: str) -> Column:
        return F.col(name).cast("string") if digits is None else F.format_string(f"%.{digits}f", name)

    numeric = F.concat_ws(" ", F.lit(ATTRIBUTE_MARK), "name", "type", *map(number, ("min", "max", "mean", "stdev")))
    nominal = F.concat(
        F.lit(f"{ATTRIBUTE_MARK} "),
        "name",
        F.lit(" {"),
        F.array_join("domain", ","),
        F.lit("} {"),
        F.array_join(F.transform("domain", lambda v: F.col("counts")[v].cast("string")), ","),
        F.lit("}"),
    )
    lines = profile.select("pos", F.when(F.col("type") == "nominal", nominal).otherwise(numeric).alias("value"))
    comment = profile.sparkSession.createDataFrame(
        [(-1, "% Features with min, max, average, stdev")], "pos int, value string"
    )
    return comment.unionByName(lines)


def write_arff_head(profile: DataFrame, path: str) -> None:
    # One line per attribute: bounded by the width of the relation.
    head_lines(profile).coalesce(1).sortWithinPartitions("pos").select("value").write.text(path)


def read_arff_head(spark: SparkSession, path: str) -> DataFrame:
    """(name, type, min, max, mean, stdev, domain, counts) of each attribute line."""
    number = r"([-+0-9.eE]+|NaN)"
    numeric = rf"^{ATTRIBUTE_MARK}\s+(\S+)\s+([A-Za-z]+)\s+{number}\s+{number}\s+{number}\s+{number}\s*$"
    nominal = rf"^{ATTRIBUTE_MARK}\s+(\S+)\s+\{{([^}}]*)\}}\s+\{{([^}}]*)\}}\s*$"
    value = F.col("value")
    is_nominal = value.rlike(nominal)

    def stat(group: int) -> Column:
        return F.when(~is_nominal, F.regexp_extract(value, numeric, group).try_cast("double"))

    domain = F.split(F.regexp_extract(value, nominal, 2), ",")
    counts = F.split(F.regexp_extract(value, nominal, 3), ",").cast("array<bigint>")
    return (
        spark.read.text(path)
        .where(value.startswith(ATTRIBUTE_MARK))
        .select(
            F.when(is_nominal, F.regexp_extract(value, nominal, 1))
            .otherwise(F.regexp_extract(value, numeric, 1))
            .alias("name"),
            F.when(is_nominal, F.lit("nominal")).otherwise(F.regexp_extract(value, numeric, 2)).alias("type"),
            stat(3).alias("min"),
            stat(4).alias("max"),
            stat(5).alias("mean"),
            stat(6).alias("stdev"),
            F.when(is_nominal, domain).alias("domain"),
            F.when(is_nominal, F.map_from_arrays(domain, counts)).alias("counts"),
        )
    )
