"""Labelled short texts, one JSON object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TWEET_SCHEMA = (
    "id bigint, text string, cntPosts bigint, cntLists bigint, cntFollowers bigint, cntFriends bigint, "
    "accountAge bigint, class string"
)


def read_tweets(spark: SparkSession, path: str, schema: str = TWEET_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
