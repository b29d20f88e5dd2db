"""Scoring against labelled cases, and audits of the statement check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import fixed
from tallymark.functions.text import check_statement
from tallymark.operators.ranks import order_statistics


def score_golden_join(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """The expectations with ``actual`` and ``matched``: whether it is among ``allowed``; nothing there is a miss."""
    return expected.join(actual, keys, "left").withColumn("matched", F.coalesce(F.array_contains("allowed", F.col("actual")), F.lit(False)))


def _shown(shares: tuple[float, ...], found: dict[float, float | None]) -> list[Column]:
    return [F.lit(found[q] if found[q] is not None else 0.0).cast("double").alias(f"p{round(q * 100)}") for q in shares]


def latency_quantiles(runs: DataFrame, value: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """p50, p95 and so on, interpolated; 0 for no rows. The rows are looked at when this is called."""
    return runs.sparkSession.range(1).select(*_shown(shares, order_statistics(runs, value, shares)))


def score_golden(results: DataFrame) -> DataFrame:
    """Totals, accuracy over cases that ran, latency and cost, of (skipped, matched, latency_ms, cost_usd)."""
    ran = ~F.col("skipped")
    n_ran, passed = F.count_if(ran), F.count_if(ran & F.col("matched"))
    cost = F.when(ran, F.col("cost_usd"))
    shares = (0.5, 0.95)
    times = _shown(shares, order_statistics(results.filter(ran), "latency_ms", shares))
    totals = results.agg(F.count("*").alias("total"), F.count_if("skipped").alias("skipped"), n_ran.alias("ran"), passed.alias("passed"), (n_ran - passed).alias("failed"), F.coalesce(passed / F.nullif(n_ran, F.lit(0)), F.lit(0.0)).alias("accuracy"), F.round(F.coalesce(F.avg(cost), F.lit(0.0)), 9).alias("avg_cost"), F.round(F.coalesce(F.sum(cost), F.lit(0.0)), 9).alias("total_cost"))
    return totals.select("total", "skipped", "ran", "passed", "failed", "accuracy", *times, "avg_cost", "total_cost")


def tag_breakdown(cases: DataFrame, tags: str = "tags") -> DataFrame:
    return cases.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy("tag")


def recall_gate(results: DataFrame, least_accuracy: float = 0.95) -> DataFrame:
    """must_fail, hits, recall, gate_failed of (must_fail, overall, statement, matched)."""
    must = F.col("must_fail")
    hit = must & (F.col("overall") == "fail") & (F.col("statement") == "fail")
    n, hits = F.count_if(must), F.count_if(hit)
    accuracy = F.avg(F.col("matched").cast("double"))
    return results.agg(n.alias("must_fail"), hits.alias("hits"), F.coalesce(hits / F.nullif(n, F.lit(0)), F.lit(1.0)).alias("recall"), ((hits < n) | F.coalesce(accuracy < least_accuracy, F.lit(False))).alias("gate_failed"))


# --- Fixed values: replacements that each must make the statement fail -------------------------
SWAPS = (("Surgeon General", "Surgeon-General"), ("birth defects", "birth defect"), ("health problems", "health issues"), ("drive a car", "drive a vehicle"), ("alcoholic beverages", "alcohol beverages"), ("operate machinery", "operate equipment"), ("during pregnancy", "while pregnant"))
TYPOGRAPHIC = (("(1)", "“1”"), ("Surgeon General,", "Surgeon General;"), ("Surgeon General,", "Surgeon General-"))
TRAILING = (" Drink responsibly.", " For more information visit example.gov.")
INSERTED = ("X", "Q", "Z", "*", "!", "$")


def mutation_audit(statements: DataFrame, column: str = "statement") -> DataFrame:
    """category, n, rejected: every edit of every statement of the table that passes, checked again.

    Eleven kinds: the prefix's case and absence, commas, words, sentences and marks exchanged, a
    character put in or taken out at every place of the body, text added. All must fail. A blank
    is not taken out: beside another blank that would change nothing. Equal statements are checked and edited
    once and counted as often as they occur; the edits are dealt out by their place.
    """
    good = statements.groupBy(F.trim(column).alias("s")).agg(F.count("*").alias("times")).filter(check_statement(F.col("s")) == "pass")
    body = F.substr(F.col("s"), F.lit(len(fixed.STATEMENT_PREFIX) + 1))
    whole = [("prefix-title", F.concat(F.lit("Government Warning:"), body)), ("prefix-lower", F.concat(F.lower(F.lit(fixed.STATEMENT_PREFIX)), body)), ("prefix-drop", F.trim(body))]
    whole += [("comma-drop-general", F.replace("s", F.lit("General,"), F.lit("General"))), ("comma-drop-machinery", F.replace("s", F.lit("machinery,"), F.lit("machinery")))]
    whole += [(name, F.replace("s", F.lit(a), F.lit(b))) for name, pairs in (("word-swap", SWAPS), ("typographic", TYPOGRAPHIC)) for a, b in pairs]
    whole += [("sentence-swap", F.regexp_replace("s", r"\(1\)(.*?)\s*\(2\)(.*)$", "(2)$2 (1)$1")), *[("trailing-text", F.concat("s", F.lit(t))) for t in TRAILING]]

    def listed(edits: list[tuple[str, Column]]) -> Column:
        return F.explode(F.array(*[F.struct(F.lit(c).alias("category"), e.alias("edit")) for c, e in edits])).alias("m")

    fixed_edits = good.select("s", "times", listed(whole)).select("s", "times", "m.*")
    at = good.select("s", "times", F.explode(F.sequence(F.instr("s", "(1)"), F.char_length("s") - 1)).alias("k")).repartition("s", "k")
    before, after = F.substr(F.col("s"), F.lit(1), F.col("k") - 1), F.substr(F.col("s"), F.col("k"))
    put = [("char-insert", F.concat(before, F.lit(c), after)) for c in INSERTED]
    cut = [("char-delete", F.concat(before, F.substr(after, F.lit(2))))]
    placed = at.select("s", "times", "k", listed(put + cut)).filter("m.category <> 'char-delete' OR (k >= instr(s, '(1)') + 5 AND substr(s, k, 1) <> ' ')").select("s", "times", "m.*")
    edits = fixed_edits.unionByName(placed).filter("edit <> s")
    return edits.groupBy("category").agg(F.sum("times").alias("n"), F.sum(F.when(check_statement(F.col("edit")) != "pass", F.col("times")).otherwise(0)).alias("rejected"))
