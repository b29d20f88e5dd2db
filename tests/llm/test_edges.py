"""Every operator on empty tables, nulls, a long text and columns with clashing names; the stages of the pipeline."""

import pytest
from pyspark.sql import functions as F

from tallymark.llm import decontam, htmltext, langid, licenses, packing, pii, quality, simhash, substrings, urlrules

# Columns that are called what operators call theirs inside.
CLASH = "doc_id long, text string, lang string, source string, later long, fp long, salt long, failed int, pattern int, rest string, n int, text_digest string, line int, `group` int, key string, task int, words string, fingerprint string, kept string, made string, lot long, most long"
CLASHING = (7,) * 1 + (7, 7, 1, 1, "r", 1, "d", 1, 1, "k", 1, "w", "f", "t", "m", 1, 1)
LONG = "Some words, of a text that is long. " * 30_000


def _frame(spark, texts):
    rows = [(i, t, lang, source, *CLASHING) for i, t, lang, source in texts]
    return spark.createDataFrame(rows, CLASH)


@pytest.fixture(scope="module")
def docs(spark):
    return _frame(spark, [(1, None, None, None), (2, "", "en", "a"), (3, "one two three four five six", "en", "a"), (3, "one two three four five six", "en", "a"), (None, "no id here", "de", None), (4, LONG, "fr", "b"), (5, LONG + "end", "fr", "b"), (6, "ünï çödé wörds", "de", "b")]).repartition(3)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([("a", "two three four", 1), ("a", "two three four", 1), (None, "five six", 2), ("b", None, 3), ("c", "", 4)], "item_id string, text string, spans int")


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame([("MIT", "one two three four five six", 1), (None, "x", 1), ("Y", None, 1)], "license_id string, text string, digest int")


OPERATORS = {
    "packing": lambda d, b, k: packing.pack(d),
    "simhash": lambda d, b, k: simhash.groups(d),
    "licenses": lambda d, b, k: licenses.scan(d, k),
    "quality": lambda d, b, k: quality.judge(d),
    "decontam": lambda d, b, k: decontam.find(d, b),
    "pii": lambda d, b, k: pii.scan(d),
    "substrings": lambda d, b, k: substrings.remove_repeats(d),
    "langid": lambda d, b, k: langid.identify(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_on_edges(docs, bench, known, name):
    run = OPERATORS[name]
    assert run(docs.limit(0), bench, known).count() == 0
    assert run(docs.limit(0), bench.limit(0), known.limit(0)).count() == 0
    got = run(docs, bench, known).collect()
    if name != "packing":
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in docs.select("doc_id").collect())
    by = {r.doc_id: r for r in got}
    if name == "packing":
        assert sum(r.length for r in got if r.doc_id in (1, 2)) == 2 and len({(r.doc_id, r.start) for r in got if r.doc_id == 4}) == len([r for r in got if r.doc_id == 4])
    if name == "simhash":
        assert by[1].component_id == by[2].component_id == 1 and by[3].component_id == 3 and by[4].component_id == 4
    if name == "licenses":
        assert by[3].license_id == "MIT" and by[1].license_id is None
    if name == "decontam":
        assert by[3].items == ["a"] and by[3].spans == [(1, 6)] and by[1].n_words == 0
    if name == "substrings":
        assert by[5].n_removed >= by[5].n_words - 13 and by[4].n_removed == 0 and by[1].kept == ""
    if name == "langid":
        assert by[1].lang_pred == by[2].lang_pred == "und"


def test_pages_on_edges(spark):
    schema = "page_id long, url string, html string, host string, path string, best string, n int, text string, rule_digest string"
    pages = spark.createDataFrame([(1, None, None, *"hpb", 1, "t", "r"), (None, "", "", *"hpb", 1, "t", "r"), (2, "http://a.org/" + "x/" * 500_000, "<p>" + LONG, *"hpb", 1, "t", "r"), (2, "http://a.org/" + "x/" * 500_000, "<p>" + LONG, *"hpb", 1, "t", "r")], schema)
    rules = urlrules.rule_table(spark, [("org", "/" + "x/" * k, "block") for k in range(300)] + [(None, "/", "block"), ("org", "/", "block")])
    got = urlrules.judge(pages, rules).collect()
    assert len(got) == 4 and {r.rule for r in got} == {None, "org/" + "x/" * 299}
    assert urlrules.judge(pages.limit(0), rules).count() == 0 == htmltext.extract(pages.limit(0)).count()
    assert sorted(r.n_chars for r in htmltext.extract(pages).collect()) == [0, 0, len(LONG) - 1, len(LONG) - 1]


def test_keep_first_takes_no_row_by_chance(spark, docs):
    rows = [(1, "a b c d e", "en", "z"), (1, "a b c d e", "en", "y"), (1, "a b c d e", None, "y"), (2, "a b c d e", "en", "a"), (None, "a b c d e", "en", "a"), (None, "a b c d e", "en", "a"), (3, "other words of its own", "en", "a"), (3, "words unlike all of those", "en", "a")]
    made = _frame(spark, rows)
    kept = simhash.keep_first(made)
    assert kept.columns == made.columns
    got = sorted(map(str, kept.collect()))
    assert got == sorted(map(str, simhash.keep_first(made.orderBy(F.desc("source"))).collect()))
    assert [r.doc_id for r in kept.orderBy("doc_id").collect()] == [None, None, 1, 3, 3]
    assert simhash.keep_first(made.select("doc_id", "text")).count() == 5
    assert simhash.keep_first(docs.limit(0)).count() == 0


def test_stages_on_edges(spark, docs, bench):
    assert sorted(str(r.doc_id) for r in quality.keep_good(docs).collect()) == sorted(str(r.doc_id) for r in quality.judge(docs).filter("kept").collect())
    assert quality.keep_good(docs).columns == decontam.drop_contaminated(docs, bench).columns == pii.replace(docs).columns == docs.columns
    assert sorted(str(r.doc_id) for r in decontam.drop_contaminated(docs, bench).collect()) == ["1", "2", "4", "5", "6", "None"]
    for stage in (quality.keep_good, simhash.keep_first, pii.replace, packing.pack):
        assert stage(docs.limit(0)).count() == 0


def test_stages_of_the_pipeline_against_their_operators(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)

    def ids(frame):
        return sorted(r.doc_id for r in frame.select("doc_id").collect())

    assert ids(stage["quality rules"](spark, rows, sf_dir)) == ids(quality.judge(rows).filter("kept"))
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert ids(stage["benchmark decontamination"](spark, rows, sf_dir)) == ids(decontam.digest(decontam.find(rows, bench)).filter("NOT contaminated"))
    masked = {r.doc_id: r.text for r in stage["PII"](spark, rows, sf_dir).collect()}
    assert masked == {r.doc_id: r.text for r in pii.scan(rows).collect()}
