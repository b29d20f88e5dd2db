"""Word differences between the required statement and what labels say."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions import fixed


def word_diff(wanted: list[str], have: list[str]) -> Iterator[tuple[str, str]]:
    """(op, token) that turns ``wanted`` into ``have`` and keeps as many words as can be.

    Of several such ways it takes, from the left: keep a word that stands at both places; else
    remove, if that keeps no fewer words than adding would; else add.
    """
    longest = [[0] * (len(have) + 1) for _ in range(len(wanted) + 1)]
    for i in reversed(range(len(wanted))):
        for j in reversed(range(len(have))):
            longest[i][j] = longest[i + 1][j + 1] + 1 if wanted[i] == have[j] else max(longest[i + 1][j], longest[i][j + 1])
    i = j = 0
    while i < len(wanted) or j < len(have):
        if i < len(wanted) and j < len(have) and wanted[i] == have[j]:
            yield "kept", wanted[i]
            i, j = i + 1, j + 1
        elif i < len(wanted) and (j == len(have) or longest[i + 1][j] >= longest[i][j + 1]):
            yield "removed", wanted[i]
            i += 1
        else:
            yield "added", have[j]
            j += 1


def statement_redline(df: DataFrame, key: str, statement: str) -> DataFrame:
    """key, pos, op (kept, removed, added), token: the required text's kept and removed words and the label's added ones.

    Each distinct statement is compared once, by ``word_diff``; a null one is empty.
    """
    wanted = f"{fixed.STATEMENT_PREFIX} {fixed.STATEMENT_BODY}".split()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["_s"]:
                rows += [(text, pos, op, token) for pos, (op, token) in enumerate(word_diff(wanted, text.split()))]
            yield pd.DataFrame(rows, columns=["_s", "pos", "op", "token"])

    texts = df.select(F.col(key), F.coalesce(F.col(statement), F.lit("")).alias("_s"))
    lines = texts.select("_s").distinct().mapInPandas(work, "_s string, pos int, op string, token string")
    return texts.join(lines, "_s").drop("_s")


def redline_summary(lines: DataFrame) -> DataFrame:
    """token, op, n: which words labels drop and add most."""
    return lines.filter("op <> 'kept'").groupBy("token", "op").agg(F.count("*").alias("n"))
