"""Alignment against a plain version that cuts at common borders and lists all links."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallymark.llm import alignment


def pieces_of(texts):
    """Token ids and bytes by the tokenizers themselves."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in shown)}
    out = []
    for text in texts:
        if not text:
            out.append(([], []))
            continue
        ids = a.encode(" " + text, add_special_tokens=False).ids
        x = [(k, bytes(byte_of[c] for c in a.id_to_token(k))) for k in ids]
        y = []
        for k in b.encode(text):
            piece = b.id_to_piece(k)
            y.append((k, bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()))
        same = b"".join(p for _, p in x) == b"".join(p for _, p in y) == (" " + text).encode()
        out.append((x, y) if same else ([], []))
    return out


def plain(rows):
    found = []
    for x, y in pieces_of([t for _, t in rows]):
        ends = [np.cumsum([len(p) for _, p in z]).tolist() if z else [] for z in (x, y)]
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append(([k for k, _ in x[i:p]], [k for k, _ in y[j:q]]))
            i, j = p, q
        found.append((len(x), len(y), groups))
    held = Counter()
    for _, _, groups in found:
        held.update({(a, b) for g in groups for a in g[0] for b in g[1]})
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = []
    for (doc_id, _), (n_a, n_b, groups) in zip(rows, found, strict=True):
        links = [held[a, b] == most[a] for g in groups for a in g[0] for b in g[1]]
        total = sum(held[a, b] for g in groups for a in g[0] for b in g[1])
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(links), total, hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


HARD = [
    (1, "The quick brown fox"), (1, "The quick brown fox"), (2, None), (3, ""), (4, " "), (5, "  two  spaces\n\n\ttab "), (6, "naïve café — “quoted” …"),
    (7, "日本語のテキスト、漢字かな"), (8, "emoji 👩‍👩‍👧‍👦 🏳️‍🌈 and \U00010348"), (9, "<|endoftext|> <s> </s> <unk> <0x41>"), (10, "a▁b"), (11, "a" * 5000), (12, " nbsp  em"),
    (13, "x = {'k': [1, 2.5e-10]}  # ok\r\n"), (14, "ﬁ ligature ① full－width"), (None, "null id"), (15, "é combining"), (16, "\x00\x01 control"), (17, "क्षत्रिय हिन्दी"), (18, "1234567890" * 50), (19, "!?" * 300), (20, "word " * 2000),
]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(("block", "batch"), [(alignment.BLOCK, alignment.BATCH), (200, 50)])
def test_hard_texts(spark, block, batch):
    """Also with blocks and batches of a text or two."""
    df = spark.createDataFrame(HARD, "doc_id long, text string").repartition(3)
    assert rows_of(alignment.align(df, block=block, batch=batch)) == plain(HARD)


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows_of(alignment.align(df, block=20000)) == plain([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_lanes_and_wide_groups():
    """Any lane length gives the same groups; a group of many links the same sums as its links one by one."""
    draw = np.random.default_rng(3)
    for lane in (1, 2, 5, 1000):
        borders = np.sort(draw.choice(np.arange(1, 500), 120, False))
        a, b = (np.append(borders[draw.random(120) < 0.6], 500) for _ in "ab")
        a, b = np.union1d(a, [200]), np.union1d(b, [200])
        got = alignment.merge(a, b, np.array([0, 200, 500]), lane)
        common = np.intersect1d(a, b)
        want = np.stack((np.searchsorted(a, np.append(0, common[:-1]), "right"), np.searchsorted(a, common) + 1, np.searchsorted(b, np.append(0, common[:-1]), "right"), np.searchsorted(b, common) + 1)).T
        assert (got == want).all()
    a, b = draw.integers(0, 9, 200), draw.integers(0, 7, 100)
    _, pairs, times = alignment._links(np.array([[0, 200, 0, 100]]), np.zeros(1, int), a, b, 7)
    assert dict(zip(pairs.tolist(), times.tolist(), strict=True)) == dict(Counter((x * 7 + y) for x in a.tolist() for y in b.tolist()))


def test_edges(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([("7", "same text", "x", 1)] * 3, "doc_id string, text string, block string, pairs int")
    found = rows_of(alignment.align(df))
    assert len(found) == 3 and len(set(found)) == 1 and found[0][6] == 3 * found[0][4] and found[0][5] == found[0][4]
    counted = alignment.links(df)
    assert counted.columns == ["a_id", "b_id", "n", "best"] and {r.n for r in counted.collect()} == {3}
