"""One place for the session settings that the library's results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "newsdesk", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC time and adaptive execution; ANSI mode stays on, as Spark 4 sets it.

    ``master`` and ``shuffle_partitions`` are for tests and benches: a cluster sets its own.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Captured pages come in more charsets than Unicode, and with bytes that their charset doesn't hold.
        .config("spark.sql.legacy.javaCharsets", "true")
        .config("spark.sql.legacy.codingErrorAction", "true")
        # Streams keep values, lists, maps and timers for each key, which only this store holds.
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
