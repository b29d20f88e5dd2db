"""Alcohol content, volumes and fill sizes, as column expressions on doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.functions import fixed
from tallymark.functions.text import trim


def _first_number(text: Column, pattern: str) -> Column:
    """The first group of the first match as a number."""
    return F.nullif(F.regexp_extract(text, f"(?i){pattern}", 1), F.lit("")).try_cast("double")


def parse_abv(text: Column) -> Column:
    """struct(abv, proof): what a text says of either; nulls where it says nothing."""
    abv = F.coalesce(_first_number(text, fixed.ALCOHOL_FIRST_PATTERN), _first_number(text, fixed.PERCENT_PATTERN))
    return F.struct(abv.alias("abv"), _first_number(text, fixed.PROOF_PATTERN).alias("proof"))


def abv_tolerance(expected: Column, beverage: Column) -> Column:
    return F.when(beverage == "wine", F.when(expected > 14, fixed.WINE_TOLERANCE_ABOVE_14).otherwise(fixed.WINE_TOLERANCE)).otherwise(fixed.OTHER_TOLERANCE)


def check_abv(parsed: Column, expected: Column, beverage: Column) -> Column:
    """struct(result, found, delta, tolerance); result is pass, unparseable, internal_inconsistency or out_of_tolerance."""
    abv, proof = parsed["abv"], parsed["proof"]
    found = F.coalesce(abv, proof / 2)
    tolerance = abv_tolerance(expected, beverage)
    delta = F.abs(found - expected)
    crossed = (beverage == "wine") & ((found > 14) != (expected > 14))
    result = (
        F.when(found.isNull(), "unparseable")
        .when(F.coalesce(F.abs(proof - abv * 2) > tolerance * 2, F.lit(False)), "internal_inconsistency")
        .when(crossed | ~(delta <= tolerance + fixed.ABV_EPSILON), "out_of_tolerance")
        .otherwise("pass")
    )
    return F.struct(result.alias("result"), found.alias("found"), delta.alias("delta"), tolerance.alias("tolerance"))


def parse_volume(text: Column) -> Column:
    """The first volume of a text in millilitres; null without one above zero of a known unit."""
    text = trim(text)
    amount = _first_number(text, fixed.VOLUME_PATTERN)
    unit = F.regexp_replace(F.lower(F.regexp_extract(text, f"(?i){fixed.VOLUME_PATTERN}", 2)), r"\s+", " ")
    factor = F.create_map(*[F.lit(x) for name, ml in fixed.ML_PER_UNIT.items() for x in (name, float(ml))])[unit]
    return F.when(amount > 0, amount * factor)


def check_volume(found: Column, expected: Column) -> Column:
    """pass, unparseable or volume_mismatch, of two volumes in millilitres."""
    delta = F.abs(found - expected) / F.greatest(found, expected)
    return F.when(found.isNull() | expected.isNull(), "unparseable").when(delta <= fixed.VOLUME_TOLERANCE + fixed.VOLUME_EPSILON, "pass").otherwise("volume_mismatch")


def is_standard_fill(ml: Column, beverage: Column) -> Column:
    """Whether a size is on the list of its beverage; wines above three litres may be whole litres."""
    def listed(sizes: tuple[int, ...]) -> Column:
        return F.exists(F.array(*[F.lit(float(s)) for s in sizes]), lambda s: F.abs(s - ml) <= fixed.SIZE_TOLERANCE_ML)

    rest = ml % 1000
    litres = (ml > 3000) & ((rest <= fixed.SIZE_TOLERANCE_ML) | (rest >= 1000 - fixed.SIZE_TOLERANCE_ML))
    return F.when(beverage == "wine", listed(fixed.WINE_SIZES_ML) | litres).when(beverage == "distilled-spirits", listed(fixed.SPIRITS_SIZES_ML)).otherwise(F.lit(True))
