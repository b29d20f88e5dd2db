"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

A text becomes a few numbers: how densely words of a lexicon occur, how near they stand to the second
person, capitals, punctuation, and how many words are obfuscated (letters replaced, split or repeated),
among them those that are in the lexicon once they are cleaned up. The lexicon has two parts: a short
list of insults, and words and word beginnings that are learned from the labels: those whose rate in
toxic texts is above that in others by a clear margin (a lower bound of the log odds ratio, so that a few
chance hits do not count).

Labels are used of at most ``SAMPLE`` rows, toxic and other ones half and half as far as there are as
many; the others weigh as much as they stand for. They are dealt by hash into three parts, so that
nothing is fitted on rows that it has itself been learned from: the lexicon, the trees, and the
calibration. Everything that comes to the driver or is sent out is bounded by ``SAMPLE`` and ``LEXICON``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm._common import map_slices, text_columns, utf8

#: Labelled rows that are learned from, at most.
SAMPLE = 30000
#: Learned words and beginnings, at most.
LEXICON = 20000
#: Lengths of the beginnings.
STEMS = (4, 5, 6)
#: A learned word's log odds ratio is at least this, at so many standard errors below its estimate.
MARGIN, ERRORS = 1.0, 1.64
#: Words between a lexicon word and a second person that count as near.
NEAR = 5
TREES, DEPTH, RATE, BINS, LEAST_LEAF, L2 = 80, 3, 0.15, 32, 5.0, 1.0
#: Tokens that a task remembers.
REMEMBERED = 1 << 18

INSULTS = frozenset(
    "idiot idiots idiotic moron morons moronic stupid dumb dumbass fool loser losers pathetic worthless scum trash garbage clown disgusting "
    "imbecile cretin dimwit halfwit bastard bitch asshole jerk creep freak pervert coward liar scumbag vermin parasite filth pig swine rat "
    "shut hate kill die ugly fat retard retarded whore slut fuck fucking shit crap bullshit damn suck sucks "
    "idioten dummkopf trottel arschloch scheisse scheiße blöd depp vollidiot abschaum hure schwein widerlich "
    "imbécile connard salope merde stupide abruti crétin ordure putain débile "
    "idiota estúpido estúpida imbécil puta mierda cabrón pendejo basura asqueroso gilipollas".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur youre du dich dir dein deine euch ihr tu te toi ton ta tes vous votre usted ustedes tú ti vosotros".split())

_TOLD = INSULTS | SECOND_PERSON
_WORD = re.compile(r"[^\W\d_]+")
# A token with marks or digits between or for letters; letters one by one; a letter three times over; three capitals.
_MIXED = re.compile(r"[^\W\d_]\w*(?:[@$!*#.\-_0-9]+\w+)+")
_SPACED = re.compile(r"(?<!\w)[^\W\d_](?:[ .\-_*][^\W\d_](?!\w)){3,}")
_LONG = re.compile(r"([^\W\d_])\1{2,}")
_BANGS = re.compile(r"[!?]{2,}")
_PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": "", "#": "", " ": ""})
_AROUND = ".,;:!?…()[]{}<>\"'«»“”„‘’|/"
_BETWEEN = np.zeros(256, bool)
_BETWEEN[[ord(c) for c in " .-_*"]] = True

FEATURES = ("insult_density", "insults", "learned_density", "learned", "learned_most", "near_person", "person_density", "capitals", "shouted", "bangs", "questions", "repeated_marks", "marks", "mixed", "spaced", "lengthened", "hidden", "words")


def stems(word: str) -> list[str]:
    """The word and its beginnings, marked by a bar."""
    return [word, *[word[:n] + "|" for n in STEMS if n < len(word)]]


class Weights:
    """What a token (without white space, lower-cased) adds to a text's numbers; tokens seen before are remembered."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon, self.seen = lexicon, {}
        #: A token of letters that begins with none of these adds nothing but itself.
        self.heads = {s[: min(STEMS)].removesuffix("|") for s in (*lexicon, *_TOLD)}

    def word(self, word: str) -> float:
        """The learned weight of a word, the most of its own and its beginnings'."""
        get, most = self.lexicon.get, self.lexicon.get(word, 0.0)
        for n in STEMS:
            if n >= len(word):
                break
            if (w := get(word[:n] + "|", 0.0)) > most:
                most = w
        return most

    def listed(self, word: str) -> bool:
        return word in INSULTS or self.word(word) > 0

    def __call__(self, token: str) -> tuple[float, ...]:
        """Words, letters, insults, learned weight, the most of it, words of the second person, mixed, lengthened, and hidden ones."""
        if (found := self.seen.get(token)) is None:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            words = [token] if token.isalpha() else _WORD.findall(token)
            weights = [self.word(w) for w in words]
            bare = token.strip(_AROUND)
            mixed, long = not bare.isalpha() and _MIXED.fullmatch(bare) is not None, _LONG.search(token) is not None
            clean = {*([bare.translate(_PLAIN)] if mixed else []), *([_LONG.sub(r"\1", w) for w in words] if long else [])}
            found = self.seen[token] = (
                len(words), sum(map(len, words)), sum(w in INSULTS for w in words), sum(weights), max(weights, default=0.0),
                sum(w in SECOND_PERSON for w in words), int(mixed), int(long), int(any(map(self.listed, clean))),
            )
        return found


def _near_person(lowered: str, weight: Weights) -> int:
    """Listed words with a second person at most NEAR words away."""
    words = _WORD.findall(lowered)
    listed = {w for w in set(words) if weight.listed(w)}
    person, said = (np.array([k for k, w in enumerate(words) if w in some]) for some in (SECOND_PERSON, listed))
    if not len(person) or not len(said):
        return 0
    at = np.searchsorted(person, said)
    gap = np.minimum(np.abs(said - person[np.minimum(at, len(person) - 1)]), np.abs(said - person[np.maximum(at - 1, 0)]))
    return int((gap <= NEAR).sum())


def features(text: str, weight: Weights) -> list[float]:
    """The numbers of ``FEATURES``; an empty text has zeros."""
    lowered = text.lower()
    n_words = n_letters = insults = people = mixed = lengthened = hidden = 0
    learned = most = 0.0
    points, low = (np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32) for t in (text, lowered))
    heads, first = weight.heads, min(STEMS)
    lengthening = ((low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & (low[2:] > 64)).any()
    for token, n in Counter(lowered.split()).items():
        if not lengthening:  # most tokens are a word, with marks around it or without, that adds nothing else
            bare = token if token.isalpha() else token.strip(_AROUND)
            if bare[:first] not in heads and bare.isalpha():
                n_words += n
                n_letters += n * len(bare)
                continue
        words, letters, insult, value, top, person, mix, long, hide = weight(token)
        n_words += n * words
        n_letters += n * letters
        if insult or person or value or mix or long:
            insults += n * insult
            learned += n * value
            most = max(most, top)
            people += n * person
            mixed += n * mix
            lengthened += n * long
            hidden += n * hide
    near = _near_person(lowered, weight) if people and (insults or learned) else 0
    capital = points != low if len(points) == len(low) else np.fromiter(map(str.isupper, text), bool, len(text))
    shouted = sum(len(w) > 2 and w.isupper() for w in _WORD.findall(text)) if (capital[2:] & capital[1:-1] & capital[:-2]).any() else 0
    between = _BETWEEN[np.minimum(points, 255)]
    spaced = _SPACED.findall(lowered) if (between[4:] & between[2:-2] & between[:-4]).any() else []
    hidden += sum(weight.listed(t.translate(_PLAIN)) for t in spaced)
    n, asked, called = max(n_words, 1), text.count("?"), text.count("!")
    marks = len(text) - n_letters - text.count(" ") - text.count("\n")
    return [
        insults / n, math.log1p(insults), learned / n, math.log1p(learned), most, near / n, people / n, int(capital.sum()) / max(n_letters, 1), shouted / n,
        called / n, asked / n, len(_BANGS.findall(text)) / n if asked + called > 1 else 0.0, marks / max(len(text), 1), mixed / n, len(spaced) / n, lengthened / n, math.log1p(hidden), math.log1p(n_words),
    ]


class Trees:
    """Boosted trees for the logistic loss; splits are sought among ``BINS`` quantiles of each feature."""

    def __init__(self) -> None:
        self.borders: list[np.ndarray] = []
        self.start = 0.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # feature and bin of each inner node, value of each leaf

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(b, x[:, k], "right") for k, b in enumerate(self.borders)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
        self.borders = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="higher")) for k in range(x.shape[1])]
        # Features that are mostly zero: a border right above zero, whatever the quantiles.
        self.borders = [np.unique(np.append(b, np.quantile(v[v > 0], [0.0, 0.25, 0.5, 0.75]))) if (v := x[:, k]).max(initial=0) > 0 else b for k, b in enumerate(self.borders)]
        bins = self.binned(x)
        n_bins = max(map(len, self.borders)) + 1
        share = min(max((weight * y).sum() / weight.sum(), 1e-4), 1 - 1e-4)
        self.start = math.log(share / (1 - share))
        score = np.full(len(y), self.start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)
            split_feature, split_bin = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, n_bins, np.int64)
            for level in range(depth):
                first, width = 2**level - 1, 2**level
                best = np.full(width, 1e-9)
                for k in range(x.shape[1]):
                    at = (node - first) * n_bins + bins[:, k]
                    gs, hs, ws = (np.bincount(at, v, width * n_bins).reshape(width, n_bins).cumsum(1) for v in (g, h, weight))
                    left_g, left_h, left_w = gs[:, :-1], hs[:, :-1], ws[:, :-1]
                    all_g, all_h, all_w = gs[:, -1:], hs[:, -1:], ws[:, -1:]
                    gain = left_g**2 / (left_h + L2) + (all_g - left_g) ** 2 / (all_h - left_h + L2) - all_g**2 / (all_h + L2)
                    gain[(left_w < LEAST_LEAF) | (all_w - left_w < LEAST_LEAF)] = 0
                    top = gain.argmax(1)
                    value = gain[np.arange(width), top]
                    better = value > best
                    best[better] = value[better]
                    split_feature[first : first + width][better], split_bin[first : first + width][better] = k, top[better]
                node = 2 * node + 1 + (bins[np.arange(len(y)), split_feature[node]] > split_bin[node])
            leaf = node - (2**depth - 1)
            value = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + L2)
            self.trees.append((split_feature, split_bin, value))
            score = score + value[leaf]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        bins, out = self.binned(x), np.full(len(x), self.start)
        for feature, border, value in self.trees:
            node = np.zeros(len(x), np.int64)
            while (inner := node < len(feature)).any():
                at = np.where(inner, node, 0)
                node = np.where(inner, 2 * node + 1 + (bins[np.arange(len(x)), feature[at]] > border[at]), node)
            out += value[node - len(feature)]
        return out


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores and rising rates between which a score is calibrated: pooled adjacent violators, at the mean score of each pool."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # weight, weighted labels, weighted scores
    for s, t, w in zip(score[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
        pools.append([w, w * t, w * s])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[0] for p in pools]), np.array([p[1] / p[0] for p in pools])


class Model:
    """Lexicon, trees and calibration; without labels of both kinds the score is the sigmoid of a text's insults."""

    def __init__(self, lexicon: dict[str, float], trees: Trees | None = None, pools: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.weight, self.trees, self.pools = Weights(lexicon), trees, pools

    def margins(self, texts: list[bytes]) -> np.ndarray:
        x = np.array([features(t.decode("utf-8", "replace"), self.weight) for t in texts]).reshape(len(texts), len(FEATURES))
        return self.trees.score(x) if self.trees else 4 * x[:, 1] - 4

    def scores(self, texts: list[bytes]) -> np.ndarray:
        margin = self.margins(texts)
        raw = 1 / (1 + np.exp(-margin))
        # A hundredth of the score is the trees' own, so that texts of one pool keep their order.
        return raw if self.pools is None else 0.99 * np.interp(margin, *self.pools) + 0.01 * raw


def held_out(id_col: Column) -> Column:
    """Whether 5 divides the crc32 of the id as text; a null id is not held out, and not learned from."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(5)) == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """text, toxic, weight, lot (0 to 9) of at most ``limit`` labelled rows that are not held out.

    Ids of least hash are taken, of each label as many as half the limit, or more where the other has fewer. An id labelled
    twice is toxic if one of its labels says so.
    """
    ids = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    ids = ids.withColumn("hash", F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 40)))
    n = {r.toxic: r.n for r in ids.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {t: min(k, max(limit // 2, limit - sum(v for u, v in n.items() if u != t))) for t, k in n.items()}
    taken = None
    for t, k in share.items():
        # A limit on the hash keeps nearly all of the share, and the rest is cut off by rank: both bound what is sent out.
        some = ids.filter((F.col("toxic") == t) & (F.col("hash") < int((1 << 40) * min(1.0, 1.2 * k / n[t] + 1e-3)))).orderBy("hash", "doc_id").limit(k)
        some = some.withColumn("weight", F.lit(n[t] / k))
        taken = some if taken is None else taken.unionByName(some)
    if taken is None:
        taken = ids.withColumn("weight", F.lit(1.0))
    # At most ``limit`` rows of numbers.
    return docs.join(F.broadcast(taken), "doc_id").select("text", "toxic", "weight", F.pmod(F.xxhash64(F.lit("lot"), "doc_id"), F.lit(10)).alias("lot"))


def learn_lexicon(rows: DataFrame, limit: int = LEXICON) -> dict[str, float]:
    """Words and beginnings that stand in toxic texts clearly more often, with their log odds ratios."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter[tuple[str, int]] = Counter()
            for text, toxic in zip(utf8(b.column("text")), b.column("toxic").to_pylist(), strict=True):
                found = {s for w in set(_WORD.findall(text.decode("utf-8", "replace").lower())) for s in stems(w)}
                seen.update((s, toxic) for s in found)
                seen[("", toxic)] += 1
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in seen], pa.string()), pa.array([t for _, t in seen], pa.int32()), pa.array(seen.values(), pa.int64())], ["stem", "toxic", "n"])

    counted = map_slices(rows.select("text", "toxic"), work, "stem string, toxic int, n long").groupBy("stem").agg(F.sum(F.col("n") * F.col("toxic")).alias("t"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("c"))
    counted = counted.persist()
    size = counted.filter("stem = ''").first()
    if size is None or not size.t or not size.c:
        counted.unpersist()
        return {}
    odds = F.log((F.col("t") + 0.5) / (size.t + 1)) - F.log((F.col("c") + 0.5) / (size.c + 1))
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    clear = counted.filter("stem <> '' and t > 1").select("stem", odds.alias("odds"), (odds - ERRORS * error).alias("least")).filter(F.col("least") >= MARGIN)
    out = {r.stem: r.odds for r in clear.orderBy(F.desc("least"), "stem").limit(limit).collect()}
    counted.unpersist()
    return out


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, toxic)."""
    rows = sample(docs, labels, limit).persist()
    lexicon = learn_lexicon(rows.filter("lot < 5"))
    weight = Weights(lexicon)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t.decode("utf-8", "replace"), weight) for t in utf8(b.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), b.column("toxic"), b.column("weight"), b.column("lot")], ["x", "toxic", "weight", "lot"])

    made = map_slices(rows.filter("lot >= 5").select("text", "toxic", "weight", "lot"), work, "x array<double>, toxic int, weight double, lot long").collect()  # at most ``limit`` rows of numbers
    rows.unpersist()
    made.sort(key=lambda r: (r.lot, r.toxic, r.x))
    x, y, w = np.array([r.x for r in made]).reshape(len(made), len(FEATURES)), np.array([r.toxic for r in made], float), np.array([r.weight for r in made], float)
    fit, kept = np.array([r.lot < 8 for r in made], bool), np.array([r.lot >= 8 for r in made], bool)
    if len(set(y[fit])) < 2:
        return Model(lexicon)
    trees = Trees().fit(x[fit], y[fit], w[fit])
    pools = isotonic(trees.score(x[kept]), y[kept], w[kept]) if len(set(y[kept])) == 2 else None
    return Model(lexicon, trees, pools)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of ``docs``.

    Learns only from labels of rows that are not held out. A null text is scored as an empty one; a null id is scored and
    not held out. Where there are no labels of both kinds, the score says how many insults of the fixed list a text has.
    """
    rows = text_columns(docs, id_col, text_col)
    model = train(rows, labels, limit)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # LEXICON words and TREES trees at most

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = np.clip(m.scores(utf8(b.column("text"))), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return map_slices(rows.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), work, "doc_id long, held_out boolean, score double, predicted int")
