"""All registered queries and their SQL."""

from __future__ import annotations

from tunelens.plans import queries_eventlog, queries_experiments, queries_instances, queries_streaming

_MODULES = [queries_eventlog, queries_experiments, queries_instances, queries_streaming]


def _in_utc(query):
    def run(spark, sf_dir):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf_dir)

    return run


def queries():
    return {name: _in_utc(query) for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
