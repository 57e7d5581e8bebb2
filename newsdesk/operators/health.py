"""Health of upstream providers from their calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsdesk.operators.ranking import rank_in_group

#: What counts as a success, and the states from worst to best.
OK_STATES = ("ok", "slow")
SEVERITY = ("down", "auth_error", "timeout", "rate_limited", "slow", "ok")
WINDOW = 20


def call_history(calls: DataFrame, ts: str, order: list[str], block: int = 1000) -> DataFrame:
    """After each call (provider, state, error) the failures in a row, the last error, the
    last success and the success rate over the last 20 calls. An ok clears the error, a slow one keeps it.

    A provider's calls are numbered by time and folded in blocks of ``block``; what the blocks before leave
    behind (last success, last ok, last failure) comes to each block as one row, and the last 19 calls of
    a block go to the next one too. So no task holds a provider's whole log."""
    ok = F.col("state").isin(*OK_STATES)
    timed = calls.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    ranked = rank_in_group(timed, ["provider"], "_us", order, width=3_600_000_000, out="_rank")
    at = F.col("_rank")
    marked = ranked.withColumns({
        "_ok": ok, "_success": F.when(ok, F.struct(at.alias("at"), F.col(ts).alias("ts"))), "_clean": F.when(F.col("state") == "ok", at),
        "_fail": F.when(~ok, F.struct(at.alias("at"), F.coalesce("error", "state").alias("error"))), "_block": F.floor(at / block),
    })
    ends = ("_success", "_clean", "_fail")
    # Numbers come first in these, so the largest is the last.
    left = marked.groupBy("provider", "_block").agg(*[F.max(c).alias(f"{c}_end") for c in ends])
    before = Window.partitionBy("provider").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    left = left.select("provider", "_block", *[F.max(f"{c}_end").over(before).alias(f"{c}_before") for c in ends])
    near = at % block >= block - (WINDOW - 1)
    spread = marked.withColumn("_home", F.col("_block")).withColumn("_block", F.explode(F.when(near, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))))
    w = Window.partitionBy("provider", "_block").orderBy("_rank")
    rolling, so_far = w.rowsBetween(1 - WINDOW, 0), w.rowsBetween(Window.unboundedPreceding, 0)
    folded = spread.select(
        "*", F.round(F.sum(F.col("_ok").cast("int")).over(rolling) / F.count("*").over(rolling), 2).alias("success_rate"), *[F.max(c).over(so_far).alias(f"{c}_here") for c in ends]
    )
    folded = folded.where("_home = _block").join(left, ["provider", "_block"])
    success, clean, fail = (F.coalesce(f"{c}_here", f"{c}_before") for c in ends)
    return folded.select(
        *calls.columns,
        (at - F.coalesce(success["at"], F.lit(-1))).cast("int").alias("consecutive_failures"),
        F.when(fail["at"] > F.coalesce(clean, F.lit(-1)), fail["error"]).alias("last_error"),
        success["ts"].alias("last_success_at"),
        "success_rate",
    )


def snapshot(calls: DataFrame, ts: str, order: list[str]) -> DataFrame:
    """M2: each provider as its last call left it."""
    history = call_history(calls, ts, order)
    rest = [c for c in history.columns if c != "provider"]
    last = history.groupBy("provider").agg(F.max_by(F.struct(*rest), F.struct(ts, *order)).alias("_row"))
    return last.select(*[F.col(c) if c == "provider" else F.col(f"_row.{c}").alias(c) for c in history.columns])


def overall(providers: DataFrame) -> DataFrame:
    """Down if all fail, degraded if any isn't ok, else ok; ok without providers."""
    failing = ~F.col("state").isin(*OK_STATES)
    whole = providers.agg(F.count("*").alias("n"), F.bool_and(failing).alias("all_failing"), F.bool_or(F.col("state") != "ok").alias("any_bad"))
    return whole.select(
        F.when((F.col("n") > 0) & F.col("all_failing"), "down").when((F.col("n") > 0) & F.col("any_bad"), "degraded").otherwise("ok").alias("overall"), F.col("n").cast("int").alias("providers")
    )


def worst(providers: DataFrame) -> DataFrame:
    """The provider in the worst state, ties to the smaller name."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("state"))
    return providers.agg(F.min(F.struct(rank.alias("rank"), F.col("provider"), F.col("state"))).alias("w")).select("w.provider", "w.state")
