"""Personal data: format-preserving pseudonyms by Feistel permutation, in Spark SQL expressions only.

A value that is recognised and valid is replaced by another value of the same format, through a
keyed permutation of that format's values: equal values get equal pseudonyms in every document
and spelling, different values different ones, and who has the key can undo it. Numbers that fail
their check (a card number with a wrong check digit, a date that is no date) are left alone.

Eight rounds. Digit and hexadecimal strings are cut into halves that are added place by place
to digits of a keyed SHA-256; values with a mixed radix (dates by day, addresses, numbers with
forbidden areas) are written as a pair (a, b) of Z_m x Z_n with m times n the number of values,
so no value leaves the format and nothing has to be tried again.

E-mail addresses have no finite format; they get a keyed digest as their name.

No pattern repeats a group without a bound, so the depth of a match does not grow with the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: For tests and examples; production passes a secret of its own.
KEY = "example-key"

#: Days from FIRST_DAY on that are permuted, as 270 times 271.
FIRST_DAY, DAYS = "1900-01-01", (270, 271)

#: Months as dates write them, the calling codes of one and two digits (all others have three).
MONTHS = "January February March April May June July August September October November December".split()
_SHORT_CODES = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
#: A domain name has at most 127 labels.
_LABELS = 127

_LEFT, _RIGHT = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_MONTH = "(?:" + "|".join(MONTHS) + ")"
_SHORT_MONTH = "(?:" + "|".join(m[:3] for m in MONTHS) + ")"
KINDS = {
    "email": rf"(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){{1,{_LABELS}}}",
    "secret": rf"{_LEFT}(?:(?:AKIA|ASIA)[0-9A-Z]{{16}}|(?:sk|pk|ghp|gho|ghs|xoxb|xoxp)[-_][0-9A-Za-z]{{20,64}}){_RIGHT}",
    "token": rf"{_LEFT}[0-9A-Fa-f]{{32,64}}{_RIGHT}",
    "account": rf"{_LEFT}[A-Z]{{2}}[0-9]{{2}}(?: ?[0-9A-Z]{{4}}){{2,7}}(?: ?[0-9A-Z]{{1,3}})?{_RIGHT}|{_LEFT}[a-z]{{2}}[0-9]{{2}}[0-9a-z]{{11,30}}{_RIGHT}",
    # A time may follow a date, as in 2020-01-02T10:00.
    "date": rf"(?<![0-9A-Za-z./-])(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}|[0-9]{{1,2}}\.[0-9]{{1,2}}\.[0-9]{{4}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}|(?:{_MONTH}|{_SHORT_MONTH}) [0-9]{{1,2}}, [0-9]{{4}}|[0-9]{{1,2}} (?:{_MONTH}|{_SHORT_MONTH}) [0-9]{{4}})(?!(?!T[0-9]{{2}}:)[0-9A-Za-z]|[./-][0-9])",
    "address": rf"(?<![0-9A-Za-z.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9A-Za-z]|\.[0-9])",
    "insurance": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])|(?<![0-9A-Za-z-]|[0-9] )[0-9]{3} [0-9]{2} [0-9]{4}(?![0-9A-Za-z]|[ -][0-9])",
    "phone": r"(?:(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?)?(?<![0-9A-Za-z])\([0-9]{3}\)[ -]?[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])|(?:(?<![0-9A-Za-z+])\+1[ .-])?(?<![0-9A-Za-z.-]|[0-9] )[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}(?![0-9A-Za-z]| [0-9])|(?<![0-9A-Za-z+])\+[1-9](?:[ .()/-]{0,2}[0-9]){7,14}(?![0-9A-Za-z])",
    "card": rf"{_LEFT}(?:[0-9]{{13,19}}|[0-9]{{4}}([ -])[0-9]{{4}}\2[0-9]{{4}}\2[0-9]{{4}}|[0-9]{{4}}([ -])[0-9]{{6}}\3[0-9]{{5}}){_RIGHT}",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: Every kind has one of these: a hexadecimal token with no digit, or one at its end, a run of 31 letters.
HINT = "@|[0-9][0-9A-Fa-f.,() /-]|[A-Fa-f]{31}|A[KS]IA[0-9A-Z]|(?:sk|pk|gh[pos]|xox[bp])[-_][0-9A-Za-z]{20}"
_DIGITS, _HEX = "0123456789", "0123456789abcdef"
_UPPER, _ALNUM = _DIGITS + "ABCDEFGHIJKLMNOPQRSTUVWXYZ", _DIGITS + "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _sql(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digest(key: str, kind: str, step: str, value: str) -> str:
    return f"sha2(concat({_sql(f'{key}:{kind}:')}, {step}, ':', {value}), 256)"


def permute_string(value: str, kind: str, key: str, letters: str = _DIGITS) -> str:
    """SQL for the permutation of a string over ``letters`` (10 to 62 of them), 2 to 64 long."""
    alphabet, base = _sql(letters), len(letters)
    half = f"(length({value}) DIV 2)"
    drawn = "instr('0123456789abcdef', substr(s.h, 2 * i - 1, 1)) * 16 + instr('0123456789abcdef', substr(s.h, 2 * i, 1)) - 17"
    add = f"array_join(transform(sequence(1, length(s.a)), i -> substr({alphabet}, pmod(instr({alphabet}, substr(s.a, i, 1)) - 1 + {drawn}, {base}) + 1, 1)), '')"
    # Two steps a round: draw the digest, then add it, so that it is made once.
    drawn_state = f"named_struct('a', s.a, 'b', s.b, 'h', {_digest(key, kind, 'cast(r AS string)', 's.b')})"
    added_state = f"named_struct('a', s.b, 'b', {add}, 'h', '')"
    return f"aggregate(sequence(0, {2 * ROUNDS - 1}), named_struct('a', substr({value}, 1, {half}), 'b', substr({value}, {half} + 1), 'h', ''), (s, r) -> IF(r % 2 = 0, {drawn_state}, {added_state}), s -> concat(s.a, s.b))"


def permute_pair(value: str, kind: str, key: str, m: int, n: int) -> str:
    """SQL for the permutation of a number below m * n."""
    drawn = f"cast(conv(substr({_digest(key, kind, 'cast(r AS string)', 'cast(s.b AS string)')}, 1, 15), 16, 10) AS bigint)"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('a', cast({value} AS bigint) DIV {n}L, 'b', cast({value} AS bigint) % {n}L), (s, r) -> named_struct('a', s.b, 'b', pmod(s.a + {drawn}, IF(r % 2 = 1, {m}L, {n}L))), s -> s.a * {n}L + s.b)"


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _refill(template: str, digits: str, skip: str = "0") -> str:
    """The template with its digits, but the first ``skip``, replaced by those of ``digits`` in turn."""
    return f"array_join(transform(sequence(1, length({template})), i -> IF(substr({template}, i, 1) RLIKE '[0-9]' AND length({_digits(f'substr({template}, 1, i)')}) > {skip}, substr({digits}, length({_digits(f'substr({template}, 1, i)')}) - {skip}, 1), substr({template}, i, 1))), '')"


def _with(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is made once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _luhn(digits: str) -> str:
    """SQL for the Luhn sum mod 10 of a digit string, its last digit counting once."""
    at = f"cast(substr({digits}, length({digits}) + 1 - k, 1) AS int)"
    return f"aggregate(sequence(1, length({digits})), 0, (t, k) -> t + IF(k % 2 = 1, {at}, IF({at} > 4, 2 * {at} - 9, 2 * {at}))) % 10"


def _mod97(value: str) -> str:
    """SQL for a string of digits and capitals (A is 10) modulo 97."""
    return f"aggregate(split({value}, ''), 0, (t, x) -> (CASE WHEN x = '' THEN t WHEN x RLIKE '[0-9]' THEN t * 10 + cast(x AS int) ELSE t * 100 + ascii(x) - 55 END) % 97)"


def _checked(account: str) -> str:
    """SQL for the account number with the check digits that the rest asks for."""
    bare = f"replace({account}, ' ', '')"
    return f"concat(left({account}, 2), lpad(cast(98 - {_mod97(f"concat(substr({bare}, 5), left({bare}, 2), '00')")} AS string), 2, '0'), substr({account}, 5))"


def pseudonym(m: str, key: str = KEY) -> str:
    """SQL for the replacement of one match of PATTERN; the match itself where it is not valid."""
    email = f"concat('u', substr({_digest(key, 'email', _sql(''), f'lower({m})')}, 1, 16), '@example.invalid')"
    token = permute_string(f"lower({m})", "token", key, _HEX)
    token = f"IF({m} = upper({m}), upper({token}), {token})"
    short = f"{m} RLIKE '^(?:[0-9]+ )?(?!May){_SHORT_MONTH} '"
    forms = (
        (f"{m} LIKE '____-__-__'", "yyyy-MM-dd"), (f"{m} LIKE '____/__/__'", "yyyy/MM/dd"), (f"{m} LIKE '__.__.____'", "dd.MM.yyyy"), (f"{m} LIKE '__/__/____'", "MM/dd/yyyy"), (f"{m} LIKE '__/__/____'", "dd/MM/yyyy"),
        (f"{m} LIKE '%.%.____'", "d.M.yyyy"), (f"{m} LIKE '%/%/____' AND NOT {m} LIKE '__/__/____'", "M/d/yyyy"), (f"{m} LIKE '%/%/____' AND NOT {m} LIKE '__/__/____'", "d/M/yyyy"),
        (f"{m} LIKE '%,%' AND {short}", "MMM d, yyyy"), (f"{m} LIKE '% %' AND NOT {m} LIKE '%,%' AND {short}", "d MMM yyyy"), (f"{m} LIKE '%,%' AND NOT {short}", "MMMM d, yyyy"), (f"{m} LIKE '% %' AND NOT {m} LIKE '%,%' AND NOT {short}", "d MMMM yyyy"),
    )
    # A slash date is read with the month first and, where that is no date, with the day first.
    taken = [f"{is_form} AND try_to_date({m}, '{form}') IS NOT NULL THEN" for is_form, form in forms]
    parsed = "CASE " + " ".join(f"WHEN {t} try_to_date({m}, '{form}')" for t, (_, form) in zip(taken, forms, strict=True)) + " END"
    day = permute_pair(f"datediff(d, DATE'{FIRST_DAY}')", "date", key, *DAYS)
    shown = "CASE " + " ".join(f"WHEN {t} date_format(e, '{form}')" for t, (_, form) in zip(taken, forms, strict=True)) + " END"
    new_day = _with(f"date_add(DATE'{FIRST_DAY}', cast({day} AS int))", "e", shown)
    date = _with(parsed, "d", f"IF(d IS NULL OR datediff(d, DATE'{FIRST_DAY}') NOT BETWEEN 0 AND {DAYS[0] * DAYS[1] - 1}, {m}, {new_day})")
    number = f"aggregate(split({m}, '\\\\.'), 0L, (t, o) -> t * 256 + cast(o AS bigint))"
    address = _with(permute_pair(number, "address", key, 1 << 16, 1 << 16), "v", "concat_ws('.', v DIV 16777216, v DIV 65536 % 256, v DIV 256 % 256, v % 256)")
    area, group, serial = (f"cast(substr({m}, {a}, {n}) AS bigint)" for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = f"{area} BETWEEN 1 AND 899 AND {area} <> 666 AND {group} > 0 AND {serial} > 0"
    index = f"(({area} - 1 - IF({area} > 666, 1, 0)) * 989901 + ({group} - 1) * 9999 + {serial} - 1)"
    number = "(v DIV 989901 + 1 + IF(v DIV 989901 >= 665, 1, 0))"
    insurance = _with(permute_pair(index, "insurance", key, 898, 989901), "v", f"concat(lpad({number}, 3, '0'), substr({m}, 4, 1), lpad(v % 989901 DIV 9999 + 1, 2, '0'), substr({m}, 4, 1), lpad(v % 9999 + 1, 4, '0'))")
    # The calling code stays: its digits are skipped. A number of the North American plan is ten digits with or without +1.
    code = f"IF({m} LIKE '+%' AND NOT {m} RLIKE '[(]', length(coalesce(nullif(regexp_extract({_digits(m)}, '^({_SHORT_CODES})', 1), ''), '...')), greatest(0, length({_digits(m)}) - 10))"
    phone = _with(code, "k", _with(permute_string(f"substr({_digits(m)}, k + 1)", "phone", key), "v", _refill(m, "v", "k")))
    mark = f"regexp_extract({m}, '^(?:A[KS]IA|[a-z]+[-_])', 0)"
    secret = _with(f"substr({m}, length({mark}) + 1)", "b", f"concat({mark}, IF({m} RLIKE '^A[KS]IA', {permute_string('b', 'secret', key, _UPPER)}, {permute_string('b', 'secret', key, _ALNUM)}))")
    # An account: country and letters stay, the digits of the account are permuted, the two check digits follow from the rest.
    plain = "replace(a, ' ', '')"
    own = _digits("substr(c, 5)")
    filled = _with(f"concat('00', {permute_string(own, 'account', key)})", "v", _refill("a", "v"))
    account = _with(plain, "c", f"IF({_mod97('concat(substr(c, 5), left(c, 4))')} <> 1 OR length({own}) < 6, a, {_with(filled, 'w', _checked('w'))})")
    account = _with(f"upper({m})", "a", _with(account, "x", f"IF(a = {m}, x, lower(x))"))
    body = permute_string("left(c, length(c) - 1)", "card", key)
    check = f"pmod(10 - {_luhn('y')}, 10)"
    whole = _with(body, "v", _with("concat(v, '0')", "y", f"concat(v, {check})"))
    card = _with(_digits(m), "c", f"IF({_luhn('c')} <> 0, {m}, {_with(whole, 'w', _refill(m, 'w'))})")
    return f"""CASE WHEN {m} LIKE '%@%' THEN {email}
        WHEN {m} RLIKE '^A[KS]IA|^[a-z]+[-_]' THEN {secret}
        WHEN {m} RLIKE '^[0-9A-Fa-f]{{32,64}}$' THEN {token}
        WHEN {m} RLIKE '^[A-Z]{{2}}[0-9]{{2}}|^[a-z]{{2}}[0-9]{{2}}' THEN {account}
        WHEN {m} RLIKE '[a-z]|^(?:[0-9]{{4}}[-/][0-9]{{2}}[-/][0-9]{{2}}|[0-9]{{1,2}}([./])[0-9]{{1,2}}\\\\1[0-9]{{4}})$' THEN {date}
        WHEN {m} RLIKE '^[0-9]+(?:\\\\.[0-9]+){{3}}$' THEN {address}
        WHEN {m} RLIKE '^[0-9]{{3}}[- ][0-9]{{2}}[- ][0-9]{{4}}$' THEN IF({valid}, {insurance}, {m})
        WHEN {m} RLIKE '^[+(]|^[0-9]{{3}}[ .-][0-9]{{3}}[ .-]' THEN {phone}
        ELSE {card} END"""


def _replaced(text_col: str, key: str) -> Column:
    """A struct of the text of that column with its personal data replaced, and of the number of values replaced."""
    text, p = f"`{text_col}`", _sql(PATTERN)
    # Every match is looked for and replaced once; text and number are read off the two lists.
    joined = f"array_join(zip_with(split({text}, {p}, -1), w, (x, y) -> concat(x, coalesce(y, ''))), '')"
    count = "cast(size(filter(zip_with(f, w, (x, y) -> x <> y), z -> z)) AS bigint)"
    made = _with(f"regexp_extract_all({text}, {p}, 0)", "f", _with(f"transform(f, m -> {pseudonym('m', key)})", "w", f"named_struct('text', {joined}, 'n', {count})"))
    return F.expr(f"IF({text} RLIKE {_sql(HINT)}, {made}, named_struct('text', {text}, 'n', 0L))")


def replace(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """``docs``, all rows and columns, with the values in ``text_col`` replaced. Null stays null.

    The key is a literal of the plan: it is as safe as the driver's logs.
    """
    return docs.withColumn(text_col, _replaced(text_col, key)["text"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """doc_id, text (with pseudonyms), n_replaced: one row for each row of ``docs``. A null text stays null, with none replaced."""
    made = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), _replaced(text_col, key).alias("made"))
    return made.select("doc_id", F.col("made.text").alias("text"), F.coalesce("made.n", F.lit(0).cast("long")).alias("n_replaced"))
