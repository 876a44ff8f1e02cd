"""Model calls over rows, with an injected client, and the coercion of replies."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import clamp, keep_vocabulary, model_json

# The closed vocabularies of model replies, and the scores they hold.
LAYERS = (
    "Presentation", "UI", "Controller", "API", "Middleware", "Application", "Service", "Domain", "Repository", "Persistence", "Infrastructure",
    "Messaging", "Integration", "Security", "Authentication", "Authorization", "Configuration", "Database", "Cache", "CLI", "Background Worker",
    "Shared", "Unknown",
)
DOMAINS = (
    "Authentication", "Authorization", "Billing", "Payments", "Orders", "Inventory", "Products", "Catalog", "CRM", "Customers", "Users", "Accounts",
    "Notifications", "Messaging", "Analytics", "Reporting", "Administration", "Search", "Scheduling", "Logging", "Monitoring", "Media", "Content",
    "Shipping", "Tax", "Finance", "Support", "AI/ML", "Unknown",
)
RESPONSIBILITIES = (
    "Validation", "Persistence", "Business Logic", "Transformation", "Mapping", "Serialization", "Deserialization", "Caching", "Authorization",
    "Authentication", "Routing", "Orchestration", "Coordination", "Event Publishing", "Event Handling", "API Client", "Database Access",
    "Configuration", "Utility", "Factory", "Builder", "Parsing", "Formatting", "Monitoring", "Metrics", "Testing",
)
METRICS = (
    "complexity", "maintainability", "readability", "coupling", "cohesion", "testability", "risk", "stability", "reusability", "technical_debt",
)
METRIC_SCHEMA = ", ".join(f"{m} double" for m in METRICS)
SCHEMA = (
    "summary string, business_domain array<string>, architecture_layer string, responsibilities array<string>, risks array<string>, "
    f"technical_debt array<string>, quality_metrics struct<{METRIC_SCHEMA.replace(' double', ': double')}>, confidence double"
)


def metrics(reply: Column) -> Column:
    """The ten scores, each in [0, 1], 0 where the reply has none."""
    return F.struct(*[clamp(F.coalesce(reply[m], F.lit(0.0))).alias(m) for m in METRICS])


def _said(values: Column) -> Column:
    """Strings that are not blank; an empty array for null."""
    return F.coalesce(F.filter(values, lambda x: F.trim(x) != ""), F.array().cast("array<string>"))


def call_model(df: DataFrame, key: str, prompt: str, complete: Callable[[str], str]) -> DataFrame:
    """``key, reply``: the client is called for each row inside the tasks; a
    call that raises gives a null reply. The client must be picklable."""

    def run(frames):
        for pdf in frames:
            replies = []
            for text in pdf[prompt]:
                try:
                    replies.append(complete(text))
                except Exception:  # noqa: BLE001 - any failure degrades the row
                    replies.append(None)
            yield pd.DataFrame({key: pdf[key], "reply": replies})

    kind = dict(df.dtypes)[key]
    return df.select(key, prompt).mapInPandas(run, f"{key} {kind}, reply string")


def enrichment(replies: DataFrame, key: str) -> DataFrame:
    """Replies as typed rows; what is missing, malformed or outside the
    vocabularies becomes Unknown with confidence 0."""
    r = replies.withColumn("j", model_json(F.col("reply"), SCHEMA))
    layer = F.col("j.architecture_layer")
    return r.select(
        key, F.coalesce(F.nullif(F.trim("j.summary"), F.lit("")), F.lit("Unknown")).alias("summary"),
        F.coalesce(keep_vocabulary(F.col("j.business_domain"), list(DOMAINS), "Unknown"), F.array(F.lit("Unknown"))).alias("business_domain"),
        F.when(layer.isin(*LAYERS), layer).otherwise("Unknown").alias("architecture_layer"),
        F.coalesce(keep_vocabulary(F.col("j.responsibilities"), list(RESPONSIBILITIES)), F.array().cast("array<string>")).alias("responsibilities"),
        _said(F.col("j.risks")).alias("risks"), _said(F.col("j.technical_debt")).alias("technical_debt"),
        metrics(F.col("j.quality_metrics")).alias("quality_metrics"),
        F.when(F.col("j.summary").isNull(), 0.0).otherwise(clamp(F.coalesce("j.confidence", F.lit(0.0)))).alias("confidence"),
    )


def overlay(base: DataFrame, model: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Model values over deterministic ones, where the model gave any."""
    m = model.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return base.join(m, key, "left").withColumns({c: F.coalesce(F.nullif(f"_{c}", F.lit("Unknown")), c) for c in columns}).drop(*[f"_{c}" for c in columns])
