"""Messages and replies: typed fields with fallbacks, the state of a model, settings over defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The models that may be offered, in order; those without a size aren't available.
MODELS = [("multilingual", "Multilingual", 25 * 1024 * 1024, 384), ("scholar", None, None, None), ("keywords", None, None, None)]
MODEL = "multilingual"


def available_models(spark) -> DataFrame:
    """ord, id, label, dimensions of the models that can be loaded; the label tells the size in whole MB."""
    rows = spark.createDataFrame([(i, *m) for i, m in enumerate(MODELS)], "ord int, id string, display_name string, size_bytes long, dimensions int")
    label = F.format_string("%s (~%d MB)", "display_name", F.round(F.col("size_bytes") / 2**20).cast("long"))
    return rows.where("display_name is not null").select("ord", "id", label.alias("label"), "dimensions")


def pluck_string(payload: Column, key: str, fallback: str) -> Column:
    """The string under a key of a JSON object; the fallback if it is missing, of another type, or there is no object."""
    value = F.try_variant_get(F.try_parse_json(payload), f"$.{key}", "variant")
    own = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(F.try_parse_json(payload), f"$.{key}", "string"))
    return F.coalesce(own, F.lit(fallback))


def pluck_list(payload: Column, key: str) -> Column:
    """The elements under a key of a JSON object, as variants; none if it is missing or no list."""
    own = F.try_variant_get(F.try_parse_json(payload), f"$.{key}", "array<variant>")
    return F.coalesce(own, F.array().cast("array<variant>"))


def model_status(ok: Column, error: Column) -> Column:
    """struct<status, uptime, error, model_id> of a reply; ``ok`` is null where no reply came."""
    text = F.lower(F.coalesce(error, F.lit("")))
    none, own = F.lit(None).cast("string"), F.lit(MODEL)

    def state(name: str, uptime: float, message: Column, model: Column) -> Column:
        return F.struct(F.lit(name).alias("status"), F.lit(uptime).alias("uptime"), message.alias("error"), model.alias("model_id"))

    return (
        F.when(ok.isNull(), state("off", -1.0, none, none)).when(ok, state("loaded", 0.0, none, own))
        .when(F.contains(text, F.lit("not loaded")) | F.contains(text, F.lit("not wired")), state("off", -1.0, none, none))
        .when(F.contains(text, F.lit("loading")), state("loading", 0.0, none, own)).otherwise(state("error", -1.0, F.coalesce(error, F.lit("unknown error")), own))
    )


def status_text(status: Column) -> Column:
    """A status as lines; what it doesn't know has none."""
    line = lambda name, value: F.concat(F.rpad(F.lit(f"{name}:"), 10, " "), value)
    filled = lambda c: F.when(c != "", c)
    uptime = F.when(status["uptime"] >= 0, F.format_string("%.1f s", status["uptime"]))
    return F.concat_ws("\n", line("status", status["status"]), line("modelId", filled(status["model_id"])), line("uptime", uptime), line("error", filled(status["error"])))


def with_defaults(stored: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Stored settings, with defaults where a column is null or missing."""
    return stored.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in stored.columns else F.lit(v) for k, v in defaults.items()})
