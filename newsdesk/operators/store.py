"""Changes of tables as functions from an old snapshot and a batch to a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_per_key(batch: DataFrame, key: str, order: str) -> DataFrame:
    """D3: of rows with equal keys in a batch the last one counts."""
    return last_by(batch, key, order)


def last_by(batch: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key. max_by combines before the shuffle, so a hot key costs a row a task."""
    rest = [c for c in batch.columns if c != key]
    last = batch.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return last.select(*[F.col(c) if c == key else F.col(f"_row.`{c}`").alias(c) for c in batch.columns])


def persist(old: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Articles after a batch (seq, url, title, ..., tags, dedup_title, dedup_error), and its stage events.

    Rows without title or url are passed over. Of rows of one url the last counts; tags and dedup_title
    come from the last row that has tags, and stay as they were where none has. Each row with a
    dedup_title also gives a done event of distill, each other with a dedup_error a failed one."""
    real = batch.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != ""))
    kept = [c for c in old.columns if c not in ("url", "tags", "dedup_title")]
    last = real.groupBy("url").agg(
        F.max_by(F.struct(*kept), "seq").alias("_row"), F.max_by(F.struct("tags", "dedup_title"), F.when(F.col("tags").isNotNull(), F.col("seq"))).alias("_tagged")
    )
    new = last.select("url", *[F.col(f"_row.{c}").alias(f"_{c}") for c in kept], F.col("_tagged"), F.lit(True).alias("_new"))
    both = old.join(new, "url", "full")
    column = lambda c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    tagged = lambda c: F.when(F.col("_tagged").isNotNull(), F.col(f"_tagged.{c}")).otherwise(F.col(c)).alias(c)
    after = both.select(*[F.col(c) if c == "url" else tagged(c) if c in ("tags", "dedup_title") else column(c) for c in old.columns])
    done, failed = F.coalesce("dedup_title", F.lit("")) != "", F.coalesce("dedup_error", F.lit("")) != ""
    events = real.where(done | failed).select(
        "seq", "url", F.lit("distill").alias("stage"), F.when(done, "done").otherwise("failed").alias("status"), F.when(~done, F.col("dedup_error")).alias("error")
    )
    return after, events


def enrichment_rows(packets: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that packets (model, entries of ordinal, status, url, title, provider, provider_model, error) give
    the enrichment table, the last of each url, and how many entries are stored and skipped. An entry
    without url or title is skipped. The provider is the entry's, else the packet's model; the model
    is the packet's, else the entry's. ``articles`` (article_id, url) has the url's article by then."""
    fit = (F.coalesce("url", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "")
    named = packets.where(fit).select(
        "ordinal", "url", F.coalesce("status", F.lit("unknown")).alias("status"), F.coalesce("provider", "model").alias("provider"), F.coalesce("model", "provider_model").alias("model"), "error"
    )
    counts = packets.agg(F.count_if(fit).cast("int").alias("stored"), F.count_if(~fit).cast("int").alias("skipped"))
    return last_by(named, "url", "ordinal").join(articles.select("article_id", "url"), "url").drop("ordinal"), counts


def adapt(rows: DataFrame, schema: str) -> DataFrame:
    """Rows of an older shape in the columns of ``schema``: known ones are cast, new ones are null."""
    from pyspark.sql.types import StructType

    wanted = StructType.fromDDL(schema)
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def upsert(old: DataFrame, batch: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the batch replace or join those of ``old``; columns in ``keep`` and
    those that the batch lacks stay as they were, and are null in new rows."""
    new = batch.select(F.col(key).alias("_key"), F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in batch.columns if c != key])
    both = old.join(new, F.col(key) == F.col("_key"), "full")

    def column(c: str) -> Column:
        if c == key:
            return F.coalesce(key, "_key").alias(key)
        if c in keep or c not in batch.columns:
            return F.col(c)
        return F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)

    return both.select(*[column(c) for c in old.columns])


def patch(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Like upsert of known keys, but nulls and empty texts of the change leave the old value."""
    new = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in changes.columns if c != key])
    both = old.join(new, F.col(key) == F.col("_key"), "left")
    some = lambda c: F.when(F.col(f"_{c}").cast("string") != "", F.col(f"_{c}"))
    return both.select(*[F.coalesce(some(c), F.col(c)).alias(c) if c in changes.columns and c != key else F.col(c) for c in old.columns])


def cascade_delete(parent: DataFrame, child: DataFrame, gone: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the rows that ``gone`` (key) names."""
    left = parent.join(gone.select(key), key, "left_anti")
    return left, child.join(gone.select(F.col(key).alias(foreign)), foreign, "left_anti")


def replace_chain(routes: DataFrame, task: str, models: list[int]) -> DataFrame:
    """A task's models anew, in the order given; other tasks stay. Models must be whole numbers."""
    if any(isinstance(m, bool) or not isinstance(m, int) for m in models):
        raise ValueError("models of a chain are whole numbers")
    spark = routes.sparkSession
    new = spark.createDataFrame([(task, k, m) for k, m in enumerate(models)], "task string, position int, model_id long")
    return routes.where(F.col("task") != task).select("task", "position", "model_id").unionByName(new)


def enabled_routes(routes: DataFrame, models: DataFrame, providers: DataFrame) -> DataFrame:
    """Routes whose model and provider are enabled too. The control tables have a few rows
    each; whether they are broadcast is left to their measured size."""
    return (
        routes.where("enabled").join(models.where("enabled").drop("enabled"), "model_id").join(providers.where("enabled").drop("enabled"), "provider_id")
    )


def provider_models(providers: DataFrame, models: DataFrame) -> DataFrame:
    """Each provider with its models by name, an empty list without any."""
    lists = models.groupBy("provider_id").agg(F.array_sort(F.collect_list("model")).alias("models"))
    return providers.join(lists, "provider_id", "left").withColumn("models", F.coalesce("models", F.array().cast("array<string>")))
