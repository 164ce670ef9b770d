"""Reads of kept state: by key with a default, by place, and the rows of keys that aren't paused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def state_or_default(asked: DataFrame, state: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """asked with the columns of each key's state; a key without one gets the defaults whole.

    A stored null stays null: only a missing state is filled.  Null keys have no state.
    """
    kept = state.select(F.col(key).alias("_key"), *defaults, F.lit(True).alias("_there"))
    joined = asked.join(kept, asked[key] == F.col("_key"), "left")
    return joined.select(*(asked[c] for c in asked.columns), *(F.when(F.col("_there"), F.col(c)).otherwise(F.lit(v)).alias(c) for c, v in defaults.items()))


def at_place(findings: DataFrame, asked: DataFrame, page: str = "page_id", seq: str = "seq") -> DataFrame:
    """asked (page, place) with ok, copied, error: the text of the page's first finding at ``start-end``."""
    by_place = findings.withColumn("place", F.concat_ws("-", "start", "end")).groupBy(page, "place").agg(F.min_by("text", seq).alias("copied"), F.lit(True).alias("_there"))
    ok = F.coalesce("_there", F.lit(False))
    return asked.join(by_place, [page, "place"], "left").select(page, "place", ok.alias("ok"), "copied", F.when(~ok, "Finding not found").alias("error"))


def active(events: DataFrame, settings: DataFrame, key: str, paused: str = "paused") -> DataFrame:
    """The events of keys that aren't paused; keys without a setting, and null keys, are active.  Also for a stream against a table."""
    off = settings.where(F.col(paused)).select(F.col(key).alias("_key")).distinct()
    return events.join(off.withColumn("_off", F.lit(True)), events[key] == F.col("_key"), "left").where("_off is null").select(*(events[c] for c in events.columns))
