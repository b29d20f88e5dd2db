"""Toxicity: held-out accuracy, and its parts against plain versions."""

import zlib

import numpy as np

from tallymark.llm import toxicity


def test_held_out_accuracy(spark):
    """On documents whose labels nothing was learned from."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.score(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    toxic, clean = [r.score for r in held if r.toxic], [r.score for r in held if not r.toxic]
    assert np.mean([s >= 0.5 for s in toxic]) > 0.85 and np.mean([s >= 0.5 for s in clean]) < 0.01
    assert np.mean([(t > c) + (t == c) / 2 for t in toxic for c in clean]) > 0.95
    assert abs(np.mean(toxic + clean) - len(toxic) / len(held)) < 0.02  # calibrated


def test_labels_of_held_out_rows_do_not_count(spark):
    """Turning them round changes no score."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    assert sorted(toxicity.score(docs, labels).collect()) == sorted(toxicity.score(docs, turned).collect())


def test_features():
    weight = toxicity.Weights({"blorb": 3.0, "quax|": 2.0})
    f = dict(zip(toxicity.FEATURES, toxicity.features("You IDIOT!! a b c d e f g h i blorb and quaxter st*pid1x m.o.r.o.n then l o s e r then stuuupid", weight), strict=True))
    assert f["insults"] == np.log1p(1) and f["learned"] == np.log1p(5) and f["learned_most"] == 3
    assert f["near_person"] > 0 and f["shouted"] > 0 and f["repeated_marks"] > 0 and f["spaced"] > 0 and f["lengthened"] > 0
    assert f["hidden"] >= np.log1p(3)  # m.o.r.o.n, l o s e r, stuuupid
    assert toxicity.features("", weight) == [0.0] * len(toxicity.FEATURES)
    assert toxicity.features("\n \t", weight)[:5] == [0.0] * 5
    far = dict(zip(toxicity.FEATURES, toxicity.features("you " + "word " * 20 + "idiot", weight), strict=True))
    assert far["near_person"] == 0 and far["insults"] > 0


def test_isotonic_is_the_least_squares_rising_fit():
    """By the min-max formula, rank by rank."""
    draw = np.random.default_rng(4)
    for n in (1, 2, 7, 40):
        score, y, w = np.sort(draw.random(n)), draw.integers(0, 2, n).astype(float), draw.random(n) + 0.1
        at, rate = toxicity.isotonic(score, y, w)
        assert (np.diff(rate) > 0).all() and (np.diff(at) >= 0).all()
        mean = [[(w[i : j + 1] * y[i : j + 1]).sum() / w[i : j + 1].sum() if i <= j else np.nan for j in range(n)] for i in range(n)]
        want = [max(min(mean[i][j] for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
        assert np.allclose(sorted(set(np.round(rate, 9))), sorted(set(np.round(want, 9))))


def test_first_tree_is_the_best_split():
    """A tree of depth one against all splits between values."""
    draw = np.random.default_rng(6)
    x = draw.integers(0, 6, (200, 3)).astype(float)
    y = ((x[:, 1] > 2) ^ (draw.random(200) < 0.1)).astype(float)
    w = draw.random(200) + 0.5
    made = toxicity.Trees().fit(x, y, w, trees=1, depth=1, rate=1.0)
    p = (w * y).sum() / w.sum()
    g, h = w * (p - y), w * p * (1 - p)

    def loss(part):
        return g[part].sum() ** 2 / (h[part].sum() + toxicity.L2)

    best = max((loss(x[:, k] <= v) + loss(x[:, k] > v), k, v) for k in range(3) for v in range(5))
    right = x[:, best[1]] > best[2]
    want = np.where(right, -g[right].sum() / (h[right].sum() + toxicity.L2), -g[~right].sum() / (h[~right].sum() + toxicity.L2)) + np.log(p / (1 - p))
    assert np.allclose(made.score(x), want)


def test_edges(spark):
    """Null and empty texts, null ids, repeated rows, no labels, labels of one kind, other columns in the way."""
    docs = spark.createDataFrame([(1, "you idiot", "x", 1.0), (1, "you idiot", "x", 1.0), (2, None, None, None), (None, "", None, None), (3, "fine text " * 5000, "y", 2.0)], "doc_id int, text string, label string, toxic double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    found = {(r.doc_id, r.predicted) for r in toxicity.score(docs, none).collect()}
    assert found == {(1, 0), (2, 0), (None, 0), (3, 0)}
    assert toxicity.score(docs, none).count() == 5
    one = spark.createDataFrame([(1, 1), (1, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs, one).count() == 5
    assert toxicity.score(docs.limit(0), one).count() == 0
