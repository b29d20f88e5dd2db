"""What reviewers read: explanations, actions, titles, costs and forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import fixed
from tallymark.functions.text import let


def exact_text(number: Column) -> Column:
    """A double to two decimals as its binary value rounds (ties up), whole numbers without decimals; ``?`` for none."""
    def shown(n: Column) -> Column:
        return F.when(n.isNull() | F.isnan(n), "?").when(n % 1 == 0, n.cast("long").cast("string")).otherwise(F.regexp_replace(fixed_two(n), r"\.?0+$", ""))

    return let(number, shown)


def fixed_two(number: Column) -> Column:
    """A double from 0 up with two decimals, rounded as its binary value lies.

    Formatting would round the shortest decimal of the double: 1.005 lies below the tie, but its
    text does not. So what the product with 100 loses is found by splitting the number into two
    halves whose products are exact.
    """
    def rounded(n: Column) -> Column:
        high = n * 134217729.0 - (n * 134217729.0 - n)
        return let(F.floor(n * 100), lambda c: c + F.floor(((high * 100 - c) + (n - high) * 100) + 0.5))

    def shown(c: Column) -> Column:
        return F.concat(F.floor(c / 100).cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))

    return let(let(number, rounded), shown)


#: Numbers that the texts name, and those shown as a percentage.
_NUMBERS, _PERCENT = ("found", "expected", "delta", "tolerance", "distance"), ("similarity", "ai_confidence")


def explanation(kind: Column, detail: Column) -> Column:
    """The fixed text of an outcome with its numbers. detail: a struct of the numbers that the texts name, and the beverage.

    The text is looked up by kind and its places filled in turn, so the expression does not grow with the texts.
    """
    texts = F.expr("map(" + ", ".join(f"{_quoted(k)}, {_quoted(t)}" for k, t in fixed.EXPLANATIONS.items()) + ")")
    values = [*[detail[n].cast("double") for n in _NUMBERS], *[F.coalesce(detail[n].cast("double"), F.lit(0.0)) * 100 for n in _PERCENT]]
    places = [*[f"{{{n}}}" for n in _NUMBERS], *[f"{{{n}|%}}" for n in _PERCENT]]
    shown = F.transform(F.array(*values), exact_text)
    characters = F.when(detail["distance"] == 1, "character").otherwise("characters")
    drink = F.when(detail["beverage"] == "wine", "wine").when(detail["beverage"] == "distilled-spirits", "distilled spirits").otherwise("this beverage class")
    section = F.when(detail["beverage"] == "wine", "§ 4.72").otherwise("§ 5.203")
    named = {"{characters}": characters, "{drink}": drink, "{section}": section}

    def filled(numbers: Column) -> Column:
        out = F.element_at(texts, kind)
        for k, place in enumerate(places):
            out = F.replace(out, F.lit(place), numbers[k])
        for place, value in named.items():
            out = F.replace(out, F.lit(place), value)
        return out

    return let(shown, filled)


def _quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def suggested_action(status: Column, poor: Column, validated: Column) -> Column:
    by_status = F.coalesce(*[F.when(status == s, text) for s, text in fixed.ACTIONS.items()], F.lit(""))
    return F.when(poor & status.isin("manual-review", "low-confidence"), F.when(validated, fixed.ACTION_SPOT_CHECK).otherwise(fixed.ACTION_BETTER_IMAGE)).otherwise(by_status)


def displayed_confidence(confidence: Column, validated: Column) -> Column:
    return F.when(validated, F.greatest(confidence, F.lit(fixed.SHOWN_CONFIDENCE))).otherwise(confidence)


def title_of(value: Column, titles: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in titles.items() for x in pair]), value)


def ai_cost(usage: DataFrame, prices: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """``usage`` with cost_usd by model_role; a price that is missing or below zero is the listed one."""
    def price(role: str, k: int) -> float:
        own = (prices or {}).get(role, fixed.PRICES[role])[k]
        return float(own) if own is not None and 0 <= own < float("inf") else fixed.PRICES[role][k]

    rows = [(role, price(role, 0), price(role, 1)) for role in fixed.PRICES]
    listed = usage.sparkSession.createDataFrame(rows, "model_role string, usd_in double, usd_out double")
    # A row for each role: two.
    cost = F.col("prompt_tokens") / 1_000_000 * F.col("usd_in") + F.col("completion_tokens") / 1_000_000 * F.col("usd_out")
    return usage.join(F.broadcast(listed), "model_role").withColumn("cost_usd", cost).drop("usd_in", "usd_out")


def forecast(n: Column, slots: Column) -> Column:
    """struct(cost_usd, duration_ms, eta, warn) for a batch of n labels."""
    ms = F.when((n > 0) & (slots > 0), F.ceil(n / slots) * fixed.MS_PER_LABEL).otherwise(F.lit(0)).cast("long")
    seconds = F.floor(ms / 1000 + 0.5).cast("long")
    minutes = F.floor(seconds / 60).cast("string")
    eta = F.when(seconds < 60, F.concat(F.lit("~"), seconds.cast("string"), F.lit(" s"))).when(seconds % 60 == 0, F.concat(F.lit("~"), minutes, F.lit(" min"))).otherwise(F.concat(F.lit("~"), minutes, F.lit(" min "), (seconds % 60).cast("string"), F.lit(" s")))
    return F.struct((F.greatest(n, F.lit(0)) * fixed.USD_PER_LABEL).alias("cost_usd"), ms.alias("duration_ms"), eta.alias("eta"), (n >= fixed.WARN_AT).alias("warn"))


def batch_title(n: Column, brand: Column, filename: Column) -> Column:
    base = F.concat(n.cast("string"), F.lit(" labels"))
    named = F.coalesce(F.nullif(F.trim(brand), F.lit("")), F.nullif(F.trim(filename), F.lit("")))
    return F.substring(F.when(named.isNotNull(), F.concat(base, F.lit(" — "), named)).otherwise(base), 1, fixed.TITLE_MAX)


def rules_footer(version: Column) -> Column:
    date = F.regexp_extract(version, r"^ttb-(\d{4}-\d{2}-\d{2})$", 1)
    said = F.when(date != "", F.concat(F.lit("(verified "), date, F.lit(")."))).otherwise(F.concat(F.lit("(rules "), version, F.lit(").")))
    return F.concat(F.lit("Government warning text was checked against 27 CFR § 16.21 "), said)


def completed_at(iso: Column) -> Column:
    """A point in time as ``Apr 29, 2026, 12:00 PM UTC``; text that is none stays. The session's zone must be UTC."""
    return F.coalesce(F.concat(F.date_format(F.try_to_timestamp(iso), "MMM dd, yyyy, hh:mm a"), F.lit(" UTC")), iso)
