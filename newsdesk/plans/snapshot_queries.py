"""Queries on versioned tables: written, changed and read again in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.operators import store
from newsdesk.plans.flow_queries import _ARTICLES, _N, _snapshots
from newsdesk.plans.registry import query, table
from newsdesk.shared import shared_dir
from newsdesk.sources.snapshots import Snapshots


def _new(spark: SparkSession, rows: DataFrame, key: str) -> Snapshots:
    """A table in the shared folder, with as many cells as exchanges have partitions."""
    return Snapshots.create(rows, f"{shared_dir(spark)}/table-{uuid.uuid4().hex}", key, int(spark.conf.get("spark.sql.shuffle.partitions")))


@query(
    f"""WITH {_ARTICLES.format(n=_N)} SELECT coalesce(b.url, o.url) AS url, coalesce(b.title, o.title) AS title, coalesce(b.country, o.country) AS country, o.tags AS tags
        FROM o FULL JOIN b ON o.url = b.url"""
)
def snapshot_merge(spark: SparkSession, d: str) -> DataFrame:
    """D2 on a stored table: what the version after the batch holds."""
    old, batch = _snapshots(spark, d)
    articles = _new(spark, old, "url")
    return articles.read(articles.merge(batch, lambda rows, new: store.upsert(rows, new, "url", keep=("tags",))))


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def snapshot_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Rows by the keys of another table, which come often."""
    people = _new(spark, table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "id")
    return people.lookup(table(spark, d, "orders").where(F.col("o_totalprice") > 300000).select(F.col("o_custkey").alias("id")))
