"""Spelling variants against a plain version: every word against every other."""

import re
import zlib
from collections import Counter

import pytest

from tallymark.llm import spelling


def plain(rows):
    """The contract, word by word."""
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}

    def one_edit(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) if near[w] else None for w in n}
    form = {w: f if f and n[f] >= 2 * n[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def rows_of(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


#: Few letters, so that words of all kinds of edits, halves that repeat, and chains of forms are common.
def made_texts():
    import random

    draw = random.Random(5)
    letters = "abAé×ÿ"
    words = ["".join(draw.choice(letters) for _ in range(draw.randint(4, 9))) for _ in range(250)]
    words += ["aaaaa", "aaaaaa", "aaaaaaa", "aaaaaaaa", "x" * 300, "x" * 301, "x" * 150 + "y" + "x" * 149]
    rows = []
    for k in range(60):
        rows.append((k, " ".join(w for w in words for _ in range(int(draw.paretovariate(1)) if draw.random() < 0.5 else 0))))
    rows.append((70, "hello " * 12 + "hellos " * 6 + "hellosa " * 3))
    return [*rows, (None, "aaaaa bbbbb"), (1, None), (2, ""), (3, "1 2 3 Ā一 abcde1fghij"), (3, "1 2 3 abcde1fghij")]


@pytest.mark.parametrize("group", [spelling.GROUP, 3])
def test_every_word_against_every_other(spark, group):
    """Also with groups so small that most are dealt over cells."""
    rows = made_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = rows_of(spelling.variants(df, group=group))
    assert len(found) == len(set(found))
    assert set(found) == plain(rows)
    assert any(f[1] and f[2] not in (f[0], f[1]) for f in found), "no chain of forms in the fixture"


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert set(rows_of(spelling.variants(df))) == plain(rows)


def test_edges(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "Hello hello HELLO hellos hellos hellos", "x", 2)] * 2, "doc_id long, text string, word string, n long")
    assert {(r.word, r.form, r.root, r.n) for r in spelling.variants(df).collect()} == {("hello", None, "hello", 6), ("hellos", None, "hellos", 6)}
    df = spark.createDataFrame([(1, "hello " * 12 + "hellos " * 6 + "hellosa " * 3)], "doc_id long, text string")
    assert {(r.word, r.form, r.root, r.form_n) for r in spelling.variants(df).collect()} == {("hello", None, "hello", None), ("hellos", "hello", "hello", 12), ("hellosa", "hellos", "hello", 6)}


def chained(doc_id):
    """Runs that lose a letter in a document and leave another run that loses one."""

    def cut(run):
        h = zlib.crc32(f"{doc_id}:{run}".encode())
        return run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run

    for k in range(200_000):
        run = "".join(chr(97 + k // 26**i % 26) for i in range(4)) + "stone"
        if cut(run) != run and cut(cut(run)) != cut(run):
            yield run, cut(run)


def test_a_letter_is_lost_once(spark):
    """A run's rest is not cut again where it stands in the text as well, before or after the run."""
    first, second = next(chained(7))
    rows = [(7, f"{first} {second} " * 3), (8, f"{first} {second}")]
    assert spelling.words_of(7, rows[0][1].encode())[second.encode()] == 3
    assert set(rows_of(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")))) == plain(rows)
