"""Requirements, statuses of fields and of whole labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions import fixed


def requirement(beverage: Column, field: str, expected_abv: Column, imported: Column, flavours: Column | None = None) -> Column:
    """required, optional or not-applicable, for one field."""
    if field == "abv":
        asked = F.when(beverage == "wine", expected_abv > 14).when(beverage == "malt-beverage", flavours if flavours is not None else F.lit(False))
    else:
        asked = imported if field == "countryOfOrigin" else F.lit(False)
    resolved = F.when(F.coalesce(asked, F.lit(False)), "required").otherwise("optional")
    return F.coalesce(*[F.when(beverage == b, resolved if row[field] == "conditional" else F.lit(row[field])) for b, row in fixed.REQUIREMENTS.items()])


def requirement_table(spark: SparkSession) -> DataFrame:
    """beverage, field, base: the 32 rows."""
    rows = [(b, f, base) for b, row in fixed.REQUIREMENTS.items() for f, base in row.items()]
    return spark.createDataFrame(rows, "beverage string, field string, base string")


def resolve_requirements(df: DataFrame) -> DataFrame:
    """Eight rows for each of ``df`` (beverage, expected_abv, imported): field, requirement."""
    joined = df.join(F.broadcast(requirement_table(df.sparkSession)), "beverage")
    asked = F.when(F.col("field") == "abv", (F.col("beverage") == "wine") & (F.col("expected_abv") > 14)).when(F.col("field") == "countryOfOrigin", F.col("imported"))
    return joined.withColumn("requirement", F.when(F.col("base") != "conditional", F.col("base")).when(F.coalesce(asked, F.lit(False)), "required").otherwise("optional")).drop("base")


def strict_status(missing: Column, passed: Column, poor: Column, confidence: Column) -> Column:
    return F.when(missing, "missing").when(passed, F.when(poor, "manual-review").otherwise("pass")).when(confidence < fixed.LOW_CONFIDENCE, "low-confidence").otherwise("fail")


def nuanced_status(result: Column, confidence: Column, poor: Column) -> Column:
    failed = F.when(confidence >= fixed.FAIL_CONFIDENCE, "fail").when(confidence < fixed.LOW_CONFIDENCE, "low-confidence").when(poor, "manual-review").otherwise("warning")
    return (
        F.when(result == "missing", "missing")
        .when(result.isin("pass", "pass-normalised"), F.when(poor, "manual-review").otherwise("pass"))
        .when(result == "likely-match", F.when(poor, "manual-review").otherwise("likely-match"))
        .when(result == "fail", failed)
        .otherwise("manual-review")
    )


def _overall(n) -> Column:
    """The overall status from ``n(status, ...)``, the number of fields with one of those statuses."""
    active = n(*[s for s in fixed.FIELD_STATUSES if s != "not-required"])
    return (
        F.when(n("fail") > 0, "fail")
        .when((n("low-confidence") >= 2) | (n("missing") >= 2) & (n("missing") * 2 > active), "request-better-image")
        .when((n("manual-review") > 0) | (n("missing") > 0), "needs-manual-review")
        .when(n("warning", "likely-match", "low-confidence") > 0, "pass-with-warnings")
        .otherwise("pass")
    )


def rollup_array(statuses: Column) -> Column:
    """The overall status of an array of field statuses; of none, pass."""
    return _overall(lambda *s: F.size(F.filter(statuses, lambda x: x.isin(*s))))


def rollup_overall(fields: DataFrame, key: str, status: str = "ai_status") -> DataFrame:
    """key, overall: one row for each key, from a row for each field."""
    counts = fields.groupBy(key).agg(*[F.count_if(F.col(status) == s).alias(s) for s in fixed.FIELD_STATUSES])

    def n(*statuses: str) -> Column:
        total = F.col(f"`{statuses[0]}`")
        for s in statuses[1:]:
            total = total + F.col(f"`{s}`")
        return total

    return counts.select(key, _overall(n).alias("overall"))


def effective_status(ai: Column, human: Column) -> Column:
    return F.coalesce(human, ai)


def rollup_with_overrides(fields: DataFrame, actions: DataFrame, key: str, field: str, order: str) -> DataFrame:
    """key, overall, after the last override action (a human status, or null for clear) of each field."""
    last = actions.groupBy(key, field).agg(F.max_by("human_status", order).alias("human"))
    joined = fields.join(last, [key, field], "left").withColumn("status", effective_status(F.col("ai_status"), F.col("human")))
    return rollup_overall(joined, key, "status")


def apply_overlays(volume_status: Column, volume_passed: Column, standard: Column, bottler_status: Column, has_phrase: Column) -> tuple[Column, Column, Column, Column]:
    """(volume status, its overlay outcome or null, bottler status, its overlay outcome or null)."""
    odd = volume_passed & ~standard
    silent = bottler_status.isin("pass", "likely-match") & ~has_phrase
    return (F.when(odd, "warning").otherwise(volume_status), F.when(odd, "net_contents_non_standard_fill"), F.when(silent, "warning").otherwise(bottler_status), F.when(silent, "bottler_function_phrase_missing"))
