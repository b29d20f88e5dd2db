"""URL rules: host suffixes and path prefixes, joined to rules on short hash prefixes.

A url is expanded into one expression for each pair of a host suffix (last k labels) and a path
prefix (first n code points) of a shape that some rule has; other shapes can match none. The
expressions are joined to the rules on the first four bytes of their SHA-256, as lists of this
kind are published, and a hit counts only if the whole digests agree. Of several rules the
longest wins; at the same length the longer host, then a blocking rule.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm._common import ascii_lower

PREFIX_HEX = 8
#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: The verdict where no rule fits.
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if null or without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty if null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def judge(urls: DataFrame, rules: DataFrame, keep: tuple[str, ...] = ("page_id",), url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """``keep`` columns, host, path, rule, verdict: one row for each row of ``urls``.

    ``rules`` has host, path and verdict (allow or block); rows with a null in them, and all but
    one of repeated rules, are left out. Which shapes rules have (labels of the host, length of
    the path) comes to the driver: at most as many as hosts have labels times the longest path.
    A url is only expanded by the shapes of as many labels as its host has or fewer.
    The join is left to the planner, which broadcasts the rules only below its size threshold.
    """
    text = F.concat(ascii_lower(F.col("host")), F.col("path"))
    known = rules.dropna(subset=["host", "path", "verdict"]).groupBy(ascii_lower(F.col("host")).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    known = known.select(F.size(F.split("host", r"\.")).alias("labels"), F.char_length("path").alias("size"), text.alias("rule"), F.char_length("host").alias("host_size"), "verdict", F.sha2(text, 256).alias("rule_digest"))
    known = known.withColumn("prefix", F.substring("rule_digest", 1, PREFIX_HEX))
    shapes = [tuple(r) for r in known.select("labels", "size").distinct().collect()]
    base = urls.select(*[F.col(f"`{c}`") for c in keep], host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path"))
    labels = F.split("host", r"\.")
    # One expression whatever the rules: a literal map from labels to lengths, looked up only for suffixes that the host has.
    lengths: dict[int, list[int]] = {}
    for k, n in sorted(shapes):
        lengths.setdefault(k, []).append(n)
    by_labels = F.from_json(F.lit(json.dumps(lengths)), "map<string, array<int>>")
    suffixes = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(lengths, default=1))))

    def prefixes(k: Column) -> Column:
        fitting = F.filter(F.coalesce(F.try_element_at(by_labels, k.cast("string")), F.array().cast("array<int>")), lambda n: n <= F.char_length("path"))
        suffix = F.array_join(F.slice(labels, F.size(labels) - k + 1, k), ".")
        return F.transform(fitting, lambda n: F.concat(suffix, F.substring(F.col("path"), F.lit(1), n)))

    made = F.flatten(F.transform(suffixes, prefixes))
    best = F.struct(F.char_length("rule").alias("size"), F.col("host_size"), (F.col("verdict") == "block").alias("block"), "rule", "verdict")
    fit = base.withColumn("expression", F.explode(made))
    fit = fit.withColumn("digest", F.sha2("expression", 256)).withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    fit = fit.join(known, "prefix").filter(F.col("digest") == F.col("rule_digest")).select(*keep, "host", "path", best.alias("best"), F.lit(0).cast("long").alias("n"))
    none = base.select("*", F.lit(None).cast(fit.schema["best"].dataType).alias("best"), F.lit(1).cast("long").alias("n"))
    # Equal rows get equal verdicts: they are counted and expanded again, so no row needs a number.
    won = none.unionByName(fit).groupBy(*keep, "host", "path").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    won = won.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return won.select(*keep, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


SQL = r"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS rid FROM pages),
r(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT u.rid, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY u.rid ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, r.verdict DESC) AS k
    FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM u LEFT JOIN m ON m.rid = u.rid AND m.k = 1
"""
