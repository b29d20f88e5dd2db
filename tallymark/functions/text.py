"""Text: normal forms, statements, names and parsers, as column expressions.

Everything but Unicode compatibility forms is a built-in expression. For those one Arrow
function exists, and ``to_nfkc`` shows it the texts that are not plain ASCII alone.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallymark.functions import fixed

_SPACE = r"[\s   -     　﻿]"
_SINGLE = {mark: to for to, marks in fixed.FOLDED_MARKS.items() if len(to) == 1 for mark in marks}


def _fold(text: Column, zero_width: bool) -> Column:
    """Marks of print as plain ones: one pass for those that become one character or none."""
    text = F.translate(text, "".join(_SINGLE) + (fixed.ZERO_WIDTH if zero_width else ""), "".join(_SINGLE.values()))
    for to, marks in fixed.FOLDED_MARKS.items():
        for mark in marks if len(to) > 1 else "":
            text = F.replace(text, F.lit(mark), F.lit(to))
    return text


#: Set between parts of a text; one that was there before becomes a blank.
_MARK = "\x01"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value made once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_SPACE}+|{_SPACE}+$", "")


def collapse(text: Column) -> Column:
    return trim(F.regexp_replace(text, rf"{_SPACE}+", " "))


def strip_markdown(text: Column) -> Column:
    """Without emphasis, code ticks, links, headings, bullets and quote marks."""
    for pattern, to in ((r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^\s{0,3}(?:#{1,6}|>|[-*+])\s+", ""), (r"(\*\*\*|\*\*|\*|___|__)(\S(?:.*?\S)?)\1", "$2"), (r"`{1,3}([^`]+)`{1,3}", "$1")):
        text = F.regexp_replace(text, pattern, to)
    return text


def normal(text: Column, profile: str) -> Column:
    """A normal form of text that is in NFKC already (ASCII always is).

    statement: marks and white space folded, mark-up dropped, lower case; ladder: lower case,
    quotes dropped, other punctuation a space; token: letters and digits in lower case alone;
    phrase: lower case and single spaces.
    """
    if profile == "statement":
        return F.lower(collapse(F.regexp_replace(strip_markdown(_fold(text, True)), r"<[^>]+>", "")))
    if profile == "ladder":
        return collapse(F.regexp_replace(F.regexp_replace(F.lower(_fold(text, False)), "['\"]", ""), rf"[^\p{{L}}\p{{N}}\s ]", " "))
    if profile == "token":
        return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")
    if profile == "phrase":
        return collapse(F.lower(text))
    raise ValueError(profile)


@F.pandas_udf(StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def _decompose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


def to_nfkc(df: DataFrame, column: str, form: str = "NFKC") -> DataFrame:
    """``df`` with ``column`` in a compatibility form; plain ASCII texts never leave the JVM.

    It is a column, not a union of filtered parts: ``df`` is read once, and no filter on texts moves into the joins below.
    """
    text = F.col(column)
    plain = text.isNull() | ~text.rlike(r"[^\x00-\x7F]")
    other = (_compose if form == "NFKC" else _decompose)(F.when(~plain, text))
    return df.withColumn(column, F.when(plain, text).otherwise(other))


def normalize_text(df: DataFrame, column: str, profile: str, to: str | None = None) -> DataFrame:
    """``df`` with the normal form of ``column`` in ``to``."""
    to = to or column
    work = df if to == column else df.withColumn(to, F.col(column))
    return to_nfkc(work, to).withColumn(to, normal(F.col(to), profile)) if profile != "phrase" else work.withColumn(to, normal(F.col(to), profile))


def pick_statement(ocr: Column, model: Column) -> Column:
    """The statement's text: from the exact prefix on, else from a colon-less one in any case, else what the model read."""
    def window(at: Column) -> Column:
        return trim(F.substr(ocr, at, F.lit(fixed.STATEMENT_WINDOW)))

    exact = F.instr(ocr, fixed.STATEMENT_PREFIX)
    loose = F.instr(F.upper(ocr), fixed.STATEMENT_PREFIX[:-1])
    return F.when(exact > 0, window(exact)).when(loose > 0, window(loose)).otherwise(F.coalesce(model, F.lit("")))


_BODY = " ".join(fixed.STATEMENT_BODY.split()).lower()


def statement_body(statement: Column) -> Column:
    """The normal form of what follows the prefix."""
    return normal(F.substr(trim(statement), F.lit(len(fixed.STATEMENT_PREFIX) + 1)), "statement")


def check_statement(statement: Column, body: Column | None = None) -> Column:
    """pass, prefix_missing, prefix_capitalization or wording_mismatch. body: ``statement_body``, if it is at hand."""
    text = trim(F.coalesce(statement, F.lit("")))
    return (
        F.when(text == "", "prefix_missing")
        .when(~text.startswith(fixed.STATEMENT_PREFIX), F.when(F.upper(text).startswith(fixed.STATEMENT_PREFIX), "prefix_capitalization").otherwise("prefix_missing"))
        .when((statement_body(text) if body is None else body) == _BODY, "pass")
        .otherwise("wording_mismatch")
    )


def common_start(a: Column, b: Column, most: int) -> Column:
    """How many characters (``most`` at most) two different texts share from the start: found by halving."""
    def longer(step: int) -> Callable[[Column], Column]:
        return lambda k: F.when(F.substr(a, k + 1, F.lit(step)) == F.substr(b, k + 1, F.lit(step)), k + step).otherwise(k)

    at = F.lit(0)
    for bit in reversed(range(most.bit_length())):
        at = let(at, longer(1 << bit))
    return at


def edits(a: Column, b: Column, most: int) -> Column:
    """Levenshtein distance of two texts, b of ``most`` characters at most: what they share at both ends costs none."""
    def rest(pair: Column) -> Column:
        return let(common_start(pair["a"], pair["b"], most), lambda k: F.struct(*[F.reverse(F.substr(pair[x], k + 1)).alias(x) for x in "ab"]))

    ends = let(let(F.struct(a.alias("a"), b.alias("b")), rest), rest)
    return F.when(a == b, 0).otherwise(let(ends, lambda p: F.levenshtein(p["a"], p["b"])))


def statement_distance(statement: Column, body: Column | None = None) -> Column:
    """Edits between the body and the required one, where the prefix is right; else null."""
    text = trim(F.coalesce(statement, F.lit("")))
    found = statement_body(text) if body is None else body
    return F.when(text.startswith(fixed.STATEMENT_PREFIX), let(found, lambda b: edits(b, F.lit(_BODY), len(_BODY))))


def normalize_address(text: Column) -> Column:
    """Without postal codes, states by their code, the longest name at each place."""
    names = "|".join(name.replace(" ", r"\s+") for name in sorted(fixed.STATE_CODES, key=len, reverse=True))
    codes = F.create_map(*[F.lit(x) for pair in fixed.STATE_CODES.items() for x in pair])
    text = F.regexp_replace(F.translate(text, _MARK, " "), r"\b\d{5}(?:-\d{4})?\b", " ")
    # Names stand alone between marks, so one pass finds them all and a map has their codes.
    parts = F.split(F.regexp_replace(text, rf"(?i)\b({names})\b", f"{_MARK}$1{_MARK}"), _MARK)
    return F.array_join(F.transform(parts, lambda p: F.coalesce(codes[F.lower(F.regexp_replace(p, r"\s+", " "))], p)), "")


def is_united_states(country: Column) -> Column:
    """Whether a country is a known name of the United States; blank and null are not."""
    return F.coalesce((trim(country) != "") & normal(country, "ladder").isin(*fixed.US_ALIASES), F.lit(False))


def strip_origin(text: Column) -> Column:
    """Without the phrases that lead to a country."""
    text = trim(text)
    for phrase in fixed.ORIGIN_PHRASES:
        text = F.regexp_replace(text, rf"(?i)^{phrase}\s+", "")
    return trim(text)


def function_phrase(ocr: Column, evidence: Column) -> Column:
    """The longest function phrase near the evidence, or anywhere if that is not found; null if none."""
    whole = normal(F.concat(F.coalesce(ocr, F.lit("")), F.lit("\n"), F.coalesce(evidence, F.lit(""))), "phrase")
    anchor = normal(F.coalesce(evidence, F.lit("")), "phrase")
    phrases = sorted(fixed.FUNCTION_PHRASES, key=len, reverse=True)

    def near(t: Column) -> Column:
        at = F.when(t["anchor"] == "", 0).otherwise(F.instr(t["whole"], t["anchor"]))
        first = F.greatest(F.lit(1), at - fixed.PHRASE_REACH)
        return F.when(at > 0, F.substr(t["whole"], first, at - first + F.char_length(t["anchor"]))).otherwise(t["whole"])

    place = let(F.struct(whole.alias("whole"), anchor.alias("anchor")), near)
    return let(place, lambda p: F.coalesce(*[F.when(F.contains(p, F.lit(x)), x) for x in phrases]))


def quality_flags(notes: Column) -> Column:
    """The flags that notes on an image give, in order, each once."""
    text = F.lower(F.coalesce(notes, F.lit("")))
    hand = rf"|(?:{'|'.join(fixed.HAND_WORDS)})\s+(?:{'|'.join(fixed.HAND_COVERS)})"
    found = [F.when(text.rlike(rf"\b(?:{'|'.join(words)}{hand if flag == 'obstruction' else ''})\b"), F.lit(flag)) for flag, words in fixed.QUALITY_WORDS.items()]
    return F.array_compact(F.array(*found))


def filename_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"^(.+)\.[^.]*$", "$1")


def export_filename(brand: Column, review_id: Column, ending: str = ".jpg") -> Column:
    """A file name from the brand (in NFKD) and the start of the id."""
    slug = F.substring(F.lower(F.regexp_replace(trim(F.regexp_replace(brand, r"[^\w\s-]", "")), r"\s+", "-")), 1, 60)
    return F.concat(F.when(F.coalesce(slug, F.lit("")) == "", "label").otherwise(slug), F.lit("-"), F.substring(review_id, 1, 8), F.lit(ending))
