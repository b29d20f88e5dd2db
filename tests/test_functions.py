import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from __spark_entry__ import SMOKE_DIR
from tallymark.functions import explain, fixed, fuzzy, strict, text
from tallymark.plans import catalog


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}")


def column(spark, rows, expression, kind="string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], f"v {kind}").select(expression).collect()]


@pytest.mark.parametrize(("a", "b", "want"), [("stones drow", "stones throw", 87), ("stone mountain", "stones throw", 38), ("a b", "a b c", 100), ("whisky", "whiskey", 92), ("", "x", 0)])
def test_similarity_anchors(spark, a, b, want):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(fuzzy.similarity(F.col("a"), F.col("b"))).collect()[0][0]
    assert round(100 * got) == want


def _table_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b, 1):
            row.append(before[j - 1] + 1 if x == y else max(before[j], row[j - 1]))
    return row[-1]


def _plain_ratio(a, b):
    """The similarity as its definition has it, over the whole sides."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared = " ".join(sorted(left & right))
    one, two = (" ".join([shared, *sorted(x)]).strip() for x in (left - right, right - left))
    return max(int(200 * _table_length(x, y) / (len(x) + len(y)) + 0.5) if x and y else 0 for x, y in ((shared, one), (shared, two), (one, two))) / 100


def test_common_length_is_the_textbook_one(spark):
    rng = random.Random(11)
    pairs = [("".join(rng.choices(letters, k=rng.randrange(most))), "".join(rng.choices(letters, k=rng.randrange(most)))) for letters in ("ab", "abcdefgh", "aé𝛼b ü") for most in (3, 12, 70, 200) for _ in range(25)]
    pairs += [("a" * n, "a" * m) for n in (61, 62, 63, 124, 125) for m in (1, 62, 124, 300)] + [("", ""), ("", "a"), ("xy" * 400, "yx" * 500)]
    got = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string").select("k", fuzzy.common_length(F.col("a"), F.col("b")).alias("n")).collect()
    assert {r.k: r.n for r in got} == {k: _table_length(*p) for k, p in enumerate(pairs)}


def test_similarity_is_the_best_of_three_ratios(spark):
    rng = random.Random(7)
    words = ["old", "tom", "toms", "stone", "stones", "a", "b", "distillery", "co", "ñandú"]
    pairs = [(" ".join(rng.choices(words, k=rng.randrange(7))), " ".join(rng.choices(words, k=rng.randrange(7)))) for _ in range(400)]
    got = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string").select("k", fuzzy.similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert {r.k: r.s for r in got} == {k: _plain_ratio(*p) for k, p in enumerate(pairs)}
    nulls = spark.createDataFrame([(None, "a"), ("a", None)], "a string, b string").select(fuzzy.similarity(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in nulls] == [None, None]


def test_readings_of_other_applications_are_measured(spark, tmp_path):
    """From 1,000,000 parts on ids meet, and readings are paired with other applications: unlike brands go through the ladder as well."""
    for table, key, by in (("part", "p_partkey", 1000003), ("supplier", "s_suppkey", None), ("nation", None, None)):
        rows = spark.read.parquet(f"{SMOKE_DIR}/{table}.parquet")
        twice = rows.unionByName(rows.withColumn(key, F.col(key) + (by or rows.count()))) if key else rows
        twice.write.parquet(str(tmp_path / f"{table}.parquet"))
    pairs = catalog._pairs(spark, str(tmp_path), "e.label_id, e.brand_value, a.brand").collect()

    def form(brand):
        return " ".join(re.sub("[^a-z0-9]", " ", re.sub("['\"]", "", brand.lower())).split())

    def plain(read, brand):
        if read is None or read == brand:
            return "missing" if read is None else "pass"
        if form(read) == form(brand):
            return "pass-normalised"
        near = _plain_ratio(form(read), form(brand))
        return "likely-match" if near >= fixed.LIKELY else "fail" if near < fixed.UNLIKELY else "gray"

    want = Counter((r.label_id, plain(r.brand_value, r.brand)) for r in pairs)
    got = catalog.QUERIES["match_ladder"](spark, str(tmp_path)).filter("source = 'view'").collect()
    assert Counter((r.label_id, r.result) for r in got) == want
    assert any(r.label_id > 1000003 and r.brand_value and form(r.brand_value) != form(r.brand) for r in pairs)


def test_no_python_in_the_verification_job(spark):
    from tallymark.plans import catalog

    assert "Python" not in catalog.QUERIES["verify_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_ladder(spark):
    rows = [(None, "Stone's Throw"), ("Stone's Throw", "Stone's Throw"), ("STONES THROW", "Stone's Throw"), ("Stones Drow", "Stones Throw"), ("Stone Mountain", "Stone's Throw"), ("Old Tom LLC", "Old Tom"), ("!!!", "???"), ("", "x")]
    got = fuzzy.match_ladder(spark.createDataFrame(rows, "a string, b string"), "a", "b").collect()
    assert [r.match_result for r in got] == ["missing", "pass", "pass-normalised", "gray", "fail", "likely-match", "pass-normalised", "fail"]
    assert got[7].match_similarity == 0


def test_origin_and_address(spark):
    rows = [("Product of U.S.A.", "United States"), ("Made in France", "France"), (None, "France"), ("France", "Spain")]
    got = fuzzy.match_ladder(spark.createDataFrame(rows, "a string, b string"), "a", "b", "origin").collect()
    assert [r.match_result for r in got] == ["pass-normalised", "pass", "missing", "fail"]
    rows = [("Bardstown, KY 40004", "Bardstown, Kentucky 40004"), ("Bardstown, Kentucky", "12 Main St, Bardstown, KY 40004-1234")]
    got = fuzzy.match_ladder(spark.createDataFrame(rows, "a string, b string"), "a", "b", "address").collect()
    assert [r.match_result for r in got] == ["pass", "likely-match"]


def test_abv(spark):
    rows = ["45% Alc./Vol.", "90 Proof", "Alc. 40 percent by vol.", "n/a", "100%", "45% (70 proof)", None]
    got = [tuple(r.p) for r in spark.createDataFrame([(r,) for r in rows], "v string").select(strict.parse_abv(F.col("v")).alias("p")).collect()]
    assert got == [(45.0, None), (None, 90.0), (40.0, None), (None, None), (0.0, None), (45.0, 70.0), (None, None)]


@pytest.mark.parametrize(("found", "expected", "beverage", "want"), [("45.3%", 45.0, "distilled-spirits", "pass"), ("45.31%", 45.0, "distilled-spirits", "out_of_tolerance"), ("13.5%", 12.0, "wine", "pass"), ("13.6%", 12.0, "wine", "out_of_tolerance"), ("14%", 15.0, "wine", "out_of_tolerance"), ("45% 70 proof", 45.0, "unknown", "internal_inconsistency"), ("x", 1.0, "wine", "unparseable")])
def test_check_abv(spark, found, expected, beverage, want):
    df = spark.createDataFrame([(found, expected, beverage)], "t string, e double, b string")
    assert df.select(strict.check_abv(strict.parse_abv(F.col("t")), F.col("e"), F.col("b"))["result"]).first()[0] == want


def test_volumes(spark):
    assert column(spark, ["750 mL", "0.75 L", "12 fl oz", "75cl", "fl.oz", "5 fl.oz", "1,000 mL", "0 mL", None], strict.parse_volume(F.col("v"))) == [750.0, 750.0, 354.8823552, 750.0, None, None, None, None, None]
    df = spark.createDataFrame([(750.0, "wine"), (680.0, "distilled-spirits"), (5000.0, "wine"), (5300.0, "wine"), (680.0, "malt-beverage")], "ml double, b string")
    assert [r[0] for r in df.select(strict.is_standard_fill(F.col("ml"), F.col("b"))).collect()] == [True, False, True, False, True]


def test_statement(spark):
    good = f"{fixed.STATEMENT_PREFIX} {fixed.STATEMENT_BODY}"
    rows = [good, good.replace("General,", "General"), good.replace("GOVERNMENT WARNING", "Government Warning"), fixed.STATEMENT_BODY, "", None, f"**{fixed.STATEMENT_PREFIX}**", good + " More.", good.replace("drive a", "drive  a"), f"{fixed.STATEMENT_PREFIX} **{fixed.STATEMENT_BODY}**"]
    assert column(spark, rows, text.check_statement(F.col("v"))) == ["pass", "wording_mismatch", "prefix_capitalization", "prefix_missing", "prefix_missing", "prefix_missing", "prefix_missing", "wording_mismatch", "pass", "pass"]


def test_unicode_forms(spark):
    df = text.normalize_text(one(spark, "Ｂｒａｎｄ “ＡＢＣ” – é"), "v", "ladder")
    assert df.first()[0] == "brand abc é"


def test_unicode_forms_read_their_input_once(spark):
    """A column is brought in form without a filter on texts, which would go below the joins, and without reading the rows again."""
    values = ["Ｂｒａｎｄ “ＡＢＣ” – é", "Plain 'ab' C", "", None, "ﬁne", "\u212b\u00a0x"]
    df = spark.createDataFrame([(i, v, values[-1 - i]) for i, v in enumerate(values)], "i int, v string, w string")
    both = text.normalize_text(text.normalize_text(df, "v", "ladder", "a"), "w", "token", "b")
    assert [tuple(r) for r in both.orderBy("i").select("a", "b").collect()] == [("brand abc é", "åx"), ("plain ab c", "fine"), ("", None), (None, ""), ("fine", "plainabc"), ("å x", "brandabcé")]
    plan = catalog.QUERIES["normalize_text"](spark, SMOKE_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [p_partkey#") == 2  # the view has two parts
    assert not [line for line in plan.splitlines() if "RLIKE" in line and ("Filter" in line or "Join" in line)]


def test_function_phrase(spark):
    df = spark.createDataFrame([("x", "Bottled by Acme"), ("brewed and bottled by Acme in town", "Acme"), ("Acme", None), ("made by us " + "z" * 200 + " Acme", "Acme")], "o string, e string")
    assert [r[0] for r in df.select(text.function_phrase(F.col("o"), F.col("e"))).collect()] == ["bottled by", "brewed and bottled by", None, None]


def test_numbers_round_as_binary(spark):
    assert column(spark, [1.005, 2.675, 45.0, 0.125, 0.1, 99.999], explain.fixed_two(F.col("v")), "double") == ["1.00", "2.67", "45.00", "0.13", "0.10", "100.00"]
    assert column(spark, [45.0, 45.5, None, 0.1 + 0.2], explain.exact_text(F.col("v")), "double") == ["45", "45.5", "?", "0.3"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from([*fixed.FIELD_STATUSES]), max_size=8))
def test_rollup_does_not_depend_on_order(spark, statuses):
    from tallymark.operators.status import rollup_array

    df = spark.createDataFrame([(statuses,), (sorted(statuses),)], "s array<string>")
    a, b = (r[0] for r in df.select(rollup_array(F.col("s"))).collect())
    assert a == b
    if not statuses:
        assert a == "pass"


def test_quality_notes(spark):
    got = column(spark, ["blurry text with glare", "right-hand corner ok", "finger covering edge", None], text.quality_flags(F.col("v")))
    assert got == [["blur", "glare"], [], ["obstruction"], []]


def test_edits_is_the_levenshtein_distance(spark):
    texts = ["", "a", "ab", "ba", "aab", "abab", "kitten", "sitting", "kittens", "sit", "xkitten", "kiten", "ünï", "üni"]
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    assert pairs.filter(text.edits(F.col("a"), F.col("b"), 7) != F.levenshtein("a", "b")).count() == 0
    assert pairs.filter(text.edits(F.col("a"), F.col("b"), 7).isNull()).count() == 0
