"""The ladder of text matches: equal, equal in normal form, similar by token sets, judged.

The similarity is a longest common subsequence by bits, in built-in expressions: it sees a pair of
normal forms where the cheaper rungs left a row open, and null elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import fixed
from tallymark.functions.text import normal, normalize_address, strip_origin

RESULTS = ("missing", "pass", "pass-normalised", "likely-match", "gray", "fail")


#: Bits of a word of the subsequence's state: with the carry a sum of two of them stays within a long.
_BITS = 62
_FULL = (1 << _BITS) - 1


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once, however often it is read."""
    return F.transform(F.array(value), body)[0]


def _letter_bits(letters: Column, others: Column, words: Column) -> Column:
    """Map from each letter that the other text has too to its places in the text, as one long for each word of ``_BITS`` letters."""
    def places(letter: Column, word: Column) -> Column:
        # A sum over the places: a letter's bit doubles with each step to the right, so it is added from the right.
        return F.aggregate(F.reverse(F.slice(letters, word * _BITS + 1, _BITS)), F.lit(0).cast("long"), lambda a, x: a + a + (x == letter).cast("long"))

    return _bound(F.array_intersect(letters, others), lambda known: F.map_from_arrays(known, F.transform(known, lambda letter: F.transform(words, lambda word: places(letter, word)))))


def _with_letter(row: Column, places: Column) -> Column:
    """The state after a letter that stands at ``places``: row + hit | row - hit, word by word with the carry."""
    def word(done: Column, k: Column) -> Column:
        added = row[k] + row[k].bitwiseAND(places[k]) + done["carry"]
        new = added.bitwiseAND(F.lit(_FULL)).bitwiseOR(row[k] - row[k].bitwiseAND(places[k]))
        return F.struct(F.shiftright(added, _BITS).alias("carry"), F.concat(done["words"], F.array(new)).alias("words"))

    start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<long>").alias("words"))
    return F.aggregate(F.sequence(F.lit(0), F.size(row) - 1), start, word)["words"]


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two texts, in code points; the time is that of the longer one's length times the words of 62 letters of the shorter one."""
    def count(two: Column) -> Column:
        words = F.sequence(F.lit(0), F.floor((F.size(two["short"]) - 1) / _BITS).cast("int"))

        def found(bits: Column) -> Column:
            def step(row: Column, letter: Column) -> Column:
                return _bound(F.try_element_at(bits, letter), lambda places: F.when(places.isNull(), row).otherwise(_with_letter(row, places)))

            last = F.aggregate(two["long"], F.transform(words, lambda _: F.lit(_FULL)), step)
            return F.aggregate(last, F.lit(0), lambda n, x: n + _BITS - F.bit_count(x))

        return _bound(_letter_bits(two["short"], two["long"], words), found)

    def count_short(two: Column) -> Column:
        """The same where the shorter text fits one word: the state is a long, and no carry leaves it."""
        def found(bits: Column) -> Column:
            places = F.transform(two["long"], lambda letter: F.coalesce(F.try_element_at(bits, letter)[0], F.lit(0).cast("long")))
            last = F.aggregate(places, F.lit(_FULL), lambda row, at: (row + row.bitwiseAND(at)).bitwiseAND(F.lit(_FULL)).bitwiseOR(row.bitwiseAND(F.bitwise_not(at))))
            return _BITS - F.bit_count(last)

        return _bound(_letter_bits(two["short"], two["long"], F.array(F.lit(0))), found)

    swap = F.char_length(a) > F.char_length(b)
    two = F.struct(F.split(F.when(swap, b).otherwise(a), "").alias("short"), F.split(F.when(swap, a).otherwise(b), "").alias("long"))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("int")).when((a == "") | (b == ""), 0).otherwise(_bound(two, lambda two: F.when(F.size(two["short"]) <= _BITS, count_short(two)).otherwise(count(two))))


def token_sets(a: Column, b: Column) -> Column:
    """struct(shared, only_left, only_right) of the tokens of two normal forms, each sorted and distinct."""
    left, right = (F.array_distinct(F.filter(F.split(x, " "), lambda t: t != "")) for x in (a, b))
    return F.struct(*[F.array_sort(x).alias(n) for n, x in (("shared", F.array_intersect(left, right)), ("only_left", F.array_except(left, right)), ("only_right", F.array_except(right, left)))])


def similarity(a: Column, b: Column) -> Column:
    """Token-set similarity of two normal forms, 0 to 1 in whole hundredths; 0 if either has no tokens, null if either is null.

    It is the best of three ratios: of the shared tokens with each side, and of both sides, each
    written as its shared tokens and then its own. What is shared begins all three, so only the
    sides' own tokens need a common subsequence.
    """
    def ratio(common: Column, both: Column) -> Column:
        return F.floor(common * 200 / both + 0.5)

    def best(x: Column) -> Column:
        shared, left, right = (F.char_length(x[n]) for n in ("shared", "only_left", "only_right"))
        some = shared > 0
        one, two = (shared + n + F.when(some & (n > 0), 1).otherwise(0) for n in (left, right))
        own = common_length(x["only_left"], x["only_right"]) + F.when(some & (left > 0) & (right > 0), 1).otherwise(0)
        sides = [F.when(some, ratio(shared, shared + n)).otherwise(0) for n in (one, two)]
        return F.when((one == 0) | (two == 0), 0.0).otherwise(F.greatest(*sides, ratio(shared + own, one + two)) / 100)

    def joined(sets: Column) -> Column:
        return F.struct(*[F.array_join(sets[n], " ").alias(n) for n in ("shared", "only_left", "only_right")])

    return F.when(a.isNotNull() & b.isNotNull(), _bound(token_sets(a, b), lambda sets: _bound(joined(sets), best)))


#: How a kind of field is brought in form before the ladder: (extracted, expected) to the same.
_CLEAN = {"text": lambda a, b: (a, b), "address": lambda a, b: (normalize_address(a), normalize_address(b)), "origin": lambda a, b: (strip_origin(a), b)}


def ladder_layers(matches: dict[str, tuple[Column, Column, str]]) -> list[dict[str, Column]]:
    """The columns that lead to name_result and name_similarity for each match (extracted, expected, kind), layer by layer.

    Kinds are text, address (postal codes and state names dealt with) and origin (leading
    phrases dropped, names of the United States alike). A result of ``gray`` is for a judge, or
    else a reviewer. The steps are columns of their own, so that no expression is made twice and
    the similarities of all matches are asked for in one go.
    """
    cleaned = {n: _CLEAN[kind](a, b) for n, (a, b, kind) in matches.items()}
    layers = [{f"_{n}_a": c[0] for n, c in cleaned.items()} | {f"_{n}_b": c[1] for n, c in cleaned.items()}]
    layers.append({f"_{n}_l": normal(F.col(f"_{n}_a"), "ladder") for n in matches} | {f"_{n}_r": normal(F.col(f"_{n}_b"), "ladder") for n in matches})

    def decided(n: str) -> Column:
        a, b, left, right = (F.col(f"_{n}_{k}") for k in "ablr")
        out = F.when(a.isNull(), "missing")
        if matches[n][2] == "origin":
            out = out.when(left.isin(*fixed.US_ALIASES) & right.isin(*fixed.US_ALIASES), "pass-normalised")
        return out.when(a == b, "pass").when(left == right, "pass-normalised")

    layers.append({f"_{n}_d": decided(n) for n in matches})
    layers.append({f"_{n}_{k}": F.when(F.col(f"_{n}_d").isNull(), F.col(f"_{n}_{k}")) for n in matches for k in "lr"})
    layers.append({f"_{n}_s": similarity(F.col(f"_{n}_l"), F.col(f"_{n}_r")) for n in matches})

    def result(n: str) -> Column:
        near = F.col(f"_{n}_s")
        return F.coalesce(F.col(f"_{n}_d"), F.when(near >= fixed.LIKELY, "likely-match").when(near < fixed.UNLIKELY, "fail").otherwise("gray"))

    shown = {n: F.when(F.col(f"_{n}_d") == "missing", 0.0).when(F.col(f"_{n}_d").isNotNull(), 1.0).otherwise(F.col(f"_{n}_s")) for n in matches}
    layers.append({f"{n}_result": result(n) for n in matches} | {f"{n}_similarity": shown[n] for n in matches})
    return layers


def match_ladders(df: DataFrame, matches: dict[str, tuple[Column, Column, str]]) -> DataFrame:
    """``df`` with the results of ``ladder_layers``."""
    kept = df.columns
    for layer in ladder_layers(matches):
        df = df.withColumns(layer)
    # As the row of a generator: a filter on a result would else be moved below the layers, with all of them written into it.
    told = [f"{n}_{k}" for n in matches for k in ("result", "similarity")]
    return df.select(*kept, F.explode(F.array(F.struct(*told))).alias("_told")).select(*kept, *[F.col(f"_told.{t}").alias(t) for t in told])


def match_ladder(df: DataFrame, extracted: str, expected: str, kind: str = "text", to: str = "match") -> DataFrame:
    """``match_ladders`` for one pair of columns."""
    return match_ladders(df, {to: (F.col(extracted), F.col(expected), kind)})


def match_distinct(df: DataFrame, extracted: str, expected: str, kind: str = "text", to: str = "match") -> DataFrame:
    """``match_ladder`` where pairs recur: each distinct pair goes through the ladder once, and rows are joined to its result."""
    pairs = match_ladder(df.select(F.col(extracted).alias("_a"), F.col(expected).alias("_b")).distinct(), "_a", "_b", kind, to)
    same = F.col(extracted).eqNullSafe(F.col("_a")) & F.col(expected).eqNullSafe(F.col("_b"))
    return df.join(pairs, same).drop("_a", "_b")
