"""What model servers and configuration files say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usage_classes(prompt: Column, completion: Column, cached: Column, created: Column) -> Column:
    """Token classes of a server's counts: what was read from or written to the cache is no input; absent counts are 0."""
    n = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    rest = F.greatest(F.greatest(n(prompt) - n(cached), F.lit(0)) - n(created), F.lit(0))
    return F.struct(rest.cast("bigint").alias("input_tokens"), n(completion).alias("output_tokens"), n(cached).alias("cache_read_tokens"), n(created).alias("cache_write_tokens"))


def models(bodies: DataFrame) -> DataFrame:
    """id, max_len of the models in bodies (value) of a model list; entries without an id are left out."""
    each = bodies.select(F.explode(F.from_json("value", "data array<struct<id:string,max_model_len:bigint>>")["data"]).alias("m"))
    return each.select("m.id", F.col("m.max_model_len").alias("max_len")).where("id is not null")


def resolved(settings: DataFrame, overrides: DataFrame, model: str) -> DataFrame:
    """name, value of settings (name, value), with what overrides (model, name, value) say for exactly this model; null values
    override nothing."""
    own = overrides.where((F.col("model") == model) & F.col("value").isNotNull()).select("name", F.col("value").alias("own"))
    return settings.join(own, "name", "left").select("name", F.coalesce("own", "value").alias("value"))


#: Settings that variables of the environment may give.
FROM_ENVIRONMENT = ["provider", "model", "base_url", "api_key"]


def with_environment(settings: DataFrame, variables: DataFrame, prefix: str) -> DataFrame:
    """name, value of settings with what variables (name, value) named `<prefix>_<SETTING>` say of the four settings above; a
    setting that is only there is added. An empty value counts, a null one does not. What is overridden per model comes
    after this: resolved(with_environment(...), ...)."""
    short = F.lower(F.expr(f"substring(name, {len(prefix) + 2})"))
    own = variables.where(F.col("name").isin([f"{prefix}_{n.upper()}" for n in FROM_ENVIRONMENT]) & F.col("value").isNotNull())
    own = own.groupBy(short.alias("name")).agg(F.max("value").alias("own"))
    return settings.join(own, "name", "full").select("name", F.coalesce("own", "value").alias("value"))
