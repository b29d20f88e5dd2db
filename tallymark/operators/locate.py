"""Word sequences: n-grams, layout, and phrases located in documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.text import let

SPACES = r"[ \t\r\n]+"
#: Phrases that are sent to all tasks at once, in bytes.
BROADCAST_BYTES = 64 << 20


def words_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos (from 0), word: the words of a text, split at white space."""
    return df.select(key, F.posexplode(F.filter(F.split(text, SPACES), lambda w: w != "")).alias("pos", "word"))


def token_ngrams(words: DataFrame, key: str, n: int) -> DataFrame:
    """key, pos, ngram: every n words in a row of each key."""
    w = Window.partitionBy(key).orderBy("pos")
    parts = [F.col("word"), *[F.lead("word", k).over(w) for k in range(1, n)]]
    return words.select(key, "pos", F.array(*parts).alias("_p")).filter(F.col("_p")[n - 1].isNotNull()).select(key, "pos", F.array_join("_p", " ").alias("ngram"))


def tokens_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, tokens: the words of a text as tokens (letters and digits in lower case), empty ones kept; null has none."""
    line = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " "))
    # Whole texts at a time, not word by word: one blank between words, then letters, digits and those blanks alone.
    plain = F.regexp_replace(F.lower(line), r"[^\p{L}\p{N} ]+", "")
    return df.select(key, F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(plain, " ")).alias("tokens"))


def passages(items: DataFrame, key: str, n: int) -> DataFrame:
    """phrase (key, item_pos, whole), tokens: the token lists of ``items`` (key, tokens), and every n tokens in a row of longer ones."""
    whole = F.array(F.struct(F.lit(0).alias("item_pos"), F.lit(True).alias("whole"), F.col("tokens").alias("tokens")))
    parts = F.transform(F.sequence(F.lit(0), F.size("tokens") - n), lambda k: F.struct(k.alias("item_pos"), F.lit(False).alias("whole"), F.slice("tokens", k + 1, F.lit(n)).alias("tokens")))
    made = items.select(key, F.explode(F.when(F.size("tokens") > n, F.concat(whole, parts)).otherwise(whole)).alias("p"))
    return made.select(F.struct(key, F.col("p.item_pos"), F.col("p.whole")).alias("phrase"), F.col("p.tokens").alias("tokens"))


def layout_words(words: DataFrame, key: str) -> DataFrame:
    """Stand-in boxes for words of a text line: x0, x1, y0, y1, confidence."""
    width = F.greatest(F.lit(20), F.char_length("word") * 12)
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    sized = words.withColumn("width", width)
    x0 = F.lit(10) + F.coalesce(F.sum(F.col("width") + 10).over(w), F.lit(0))
    return sized.withColumn("x0", x0).select(key, "pos", "word", "x0", (F.col("x0") + F.col("width")).alias("x1"), F.lit(10).alias("y0"), F.lit(40).alias("y1"), F.lit(0.95).alias("confidence"))


def locate_phrase(docs: DataFrame, phrases: DataFrame, doc: str, phrase: str, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc, phrase, first_pos, n_words: where all tokens of a phrase first stand in a row.

    docs: doc, tokens (a list, empty tokens kept); phrases: phrase, tokens, where empty tokens
    are dropped and phrases without any locate nothing. A document's words stay in its row: the
    phrases are sent out under the token that fewest of them have, and at each place of that
    token the phrase is compared with the words around it. The phrases' size is asked for first; beyond
    ``most_bytes`` they go out in several parts, each with a pass of its own over the documents.
    """
    wanted = phrases.select(phrase, F.filter("tokens", lambda t: t != "").alias("wanted")).filter(F.size("wanted") > 0)
    size = wanted.agg(F.sum(F.octet_length(F.array_join("wanted", " ")) + 16 * F.size("wanted") + 64)).first()[0] or 0
    parts = max(1, -(-size // most_bytes))
    out = None
    for k in range(parts):
        part = wanted.filter(F.pmod(F.xxhash64("wanted"), F.lit(parts)) == k) if parts > 1 else wanted
        # A token that few phrases have stands for rare: no pass over the documents is needed to choose it.
        ranked = part.select(phrase, "wanted", F.posexplode("wanted").alias("at", "token"))
        often = ranked.groupBy("token").agg(F.count("*").alias("n"))
        rarest = ranked.join(F.broadcast(often), "token").groupBy(phrase, "wanted").agg(F.min_by(F.struct("token", "at"), F.struct("n", -F.char_length("token"), "at")).alias("r"))
        rarest = rarest.select(phrase, "wanted", F.col("r.token").alias("token"), F.col("r.at").alias("at"))
        # The size of the part was checked.
        places = docs.select(doc, "tokens", F.posexplode("tokens").alias("pos", "token")).join(F.broadcast(rarest), "token")
        start = F.col("pos") - F.col("at")
        same = (start >= 0) & (F.slice("tokens", F.greatest(start, F.lit(0)) + 1, F.size("wanted")) == F.col("wanted"))
        found = places.filter(same).groupBy(doc, phrase).agg(F.min(start).alias("first_pos"), F.first(F.size("wanted")).cast("long").alias("n_words"))
        out = found if out is None else out.unionByName(found)
    return out


def locate_quote(tokens: Column, quote: Column, *others: Column) -> Column:
    """struct(first_pos, n_words): where a row's quote first stands in its own tokens, else the first of ``others`` that does; null if none.

    Empty tokens count in ``tokens`` and are dropped from quotes.
    """
    def found(wanted: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(tokens) - F.size(wanted)), lambda k: F.slice(tokens, k + 1, F.size(wanted)) == wanted)
        return F.when((F.size(wanted) > 0) & (F.size(wanted) <= F.size(tokens)), F.struct(F.get(places, F.lit(0)).alias("first_pos"), F.size(wanted).alias("n_words")))

    made = [let(F.filter(q, lambda t: t != ""), found) for q in (quote, *others)]
    return F.coalesce(*[F.when(m["first_pos"].isNotNull(), m) for m in made])


def quote_box(words: Column, place: Column) -> Column:
    """struct(x0, y0, x1, y1) around the words (structs with these four) of a place that ``locate_quote`` found."""
    inside = F.slice(words, place["first_pos"] + 1, place["n_words"])

    def side(name: str) -> Column:
        return F.transform(inside, lambda w: w[name])

    return F.when(place.isNotNull(), F.struct(F.array_min(side("x0")).alias("x0"), F.array_min(side("y0")).alias("y0"), F.array_max(side("x1")).alias("x1"), F.array_max(side("y1")).alias("y1")))


def phrase_boxes(located: DataFrame, boxes: DataFrame, doc: str) -> DataFrame:
    """The box around each located phrase."""
    inside = located.join(boxes.select(doc, "pos", "x0", "x1", "y0", "y1"), doc).filter("pos BETWEEN first_pos AND first_pos + n_words - 1")
    keys = located.columns
    return inside.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
