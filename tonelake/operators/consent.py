"""Consent: who may be shown, who may be fetched, and what goes when somebody opts out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.functions.scalars import masked


def active(receipts: DataFrame, principal: str, action: str) -> DataFrame:
    """Keys with an active receipt of the action."""
    return (receipts.filter((F.col("principal") == principal) & (F.col("action") == action) & (F.col("state") == "active"))
            .select("principal_key").distinct())


def exposable(df: DataFrame, receipts: DataFrame, principal: str, key: str) -> DataFrame:
    """Rows whose key has opted in and not out."""
    named = lambda a: active(receipts, principal, a).withColumnRenamed("principal_key", key)
    return df.join(named("opt_in"), key, "left_semi").join(named("opt_out"), key, "left_anti")


def exclude_optouts(df: DataFrame, receipts: DataFrame, principal: str, key: str) -> DataFrame:
    """Rows whose key has not opted out; also what is purged once a principal opts out."""
    return df.join(active(receipts, principal, "opt_out").withColumnRenamed("principal_key", key), key, "left_anti")


def purge_optouts(tables: dict[str, DataFrame], receipts: DataFrame, principal: str, key: str) -> dict[str, DataFrame]:
    """What stays of each table about a principal (catalogue, queue, id map) after all active opt-outs."""
    return {name: exclude_optouts(df, receipts, principal, key) for name, df in tables.items()}


def latest_receipt(receipts: DataFrame, *keys: str) -> DataFrame:
    """The newest receipt of each key; ties go to the larger id.  A grouped max_by, so no sort is needed."""
    rest = [c for c in receipts.columns if c not in keys]
    return receipts.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("created_at", "consent_id")).alias("r")).select(*keys, "r.*")


def statuses(asked: DataFrame, receipts: DataFrame, principal: str) -> DataFrame:
    """One row per asked key (column principal_key): deny, allow or none, by its newest active receipt."""
    own = receipts.filter((F.col("principal") == principal) & (F.col("state") == "active")).select("principal_key", "action", "created_at", "consent_id")
    df = asked.join(latest_receipt(own, "principal_key"), "principal_key", "left")
    return df.select("principal_key", F.when(F.col("action") == "opt_out", "deny").when(F.col("action") == "opt_in", "allow").otherwise("none").alias("status"))


def status(receipts: DataFrame, principal: str, key: int) -> DataFrame:
    """Exactly one row: deny, allow or none, by the newest active receipt of a principal."""
    own = receipts.filter((F.col("principal") == principal) & (F.col("principal_key") == key) & (F.col("state") == "active"))
    newest = own.agg(F.max_by("action", F.struct("created_at", "consent_id")).alias("action"))  # one row, also of nothing
    return newest.select(F.when(F.col("action") == "opt_out", "deny").when(F.col("action") == "opt_in", "allow").otherwise("none").alias("status"))


def resolve_all(asked: DataFrame, receipts: DataFrame, principal: str) -> DataFrame:
    """An audit row for each asked key: allowed or not, and why."""
    newest = latest_receipt(receipts.filter((F.col("principal") == principal) & (F.col("state") == "active")).select("principal_key", "action", "created_at", "consent_id"), "principal_key")
    df = asked.join(newest.select("principal_key", "action"), "principal_key", "left")
    allowed = F.coalesce(F.col("action") == "opt_in", F.lit(False))
    return df.select("principal_key", allowed.alias("allowed"), F.coalesce("action", F.lit("no_receipt")).alias("reason"))


def mask_columns(df: DataFrame, consent_id: str, *columns: str) -> DataFrame:
    return df.withColumns({c: masked(F.col(consent_id), F.col(c)) for c in columns})


def ready(queue: DataFrame, now, limit: int | None = None) -> DataFrame:
    """Queue rows that are due and not leased, most urgent first."""
    at = F.lit(now).cast("timestamp")
    df = queue.filter((F.col("next_attempt_at") <= at) & (F.col("lease_until").isNull() | (F.col("lease_until") < at)))
    df = df.orderBy(F.desc("priority"), F.asc("next_attempt_at"), F.asc("id"))
    return df.limit(limit) if limit else df


def claim(queue: DataFrame, claimed: DataFrame, until) -> DataFrame:
    """The queue with the claimed rows leased."""
    flag = claimed.select("id", F.lit(True).alias("__claimed"))
    return queue.join(flag, "id", "left").withColumn("lease_until", F.when(F.col("__claimed"), F.lit(until).cast("timestamp")).otherwise(F.col("lease_until"))).drop("__claimed")
