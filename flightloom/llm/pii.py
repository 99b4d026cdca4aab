"""Pseudonyms for personal data, with DataFrame functions only.

Numbers and dates that pass validation are permuted by a keyed Feistel network
inside their own format: a card number becomes a card number with a right check
digit, a date another date in the same notation, an address another address.
The same value has the same pseudonym in every document, different values have
different ones, and who has the key can undo it.  E-mail addresses and secrets,
which have no fixed format, are replaced by keyed digests (of 80 and 64 bits, so
different ones differ but for chance), which nobody can undo.

Everything is column expressions: one pattern finds the candidates, `split` with
the same pattern finds the text between them, a higher-order function replaces
each candidate.  Candidates that fail validation are text again, and cards are
looked for in all text that is left.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, table

#: Rounds of the network.
ROUNDS = 8

_GAP = r"[^\p{L}\p{N}\n]{0,5}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"

#: Splits a string between its characters.
_CHARS = r"(?!\A)(?!\z)"

#: Length of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 33: "RU",
}


def _iban_of(length: int, countries: str) -> str:
    full, rest = divmod(length - 4, 4)
    return rf"(?:{countries.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{full}}}" + (rf" ?[A-Z0-9]{{{rest}}}" if rest else "")


#: Candidates by kind, in the order in which they are tried at a place; cards are looked for in what is left.
PATTERNS = {
    "secret": rf'(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)){_GAP}[=:]{_GAP}[A-Za-z0-9_+/\-]{{8,}}|\b(?i:AKIA)[0-9A-Za-z]{{16}}\b|\b[0-9a-fA-F]{{32,}}\b',
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "iban": rf"\b(?:{'|'.join(_iban_of(*x) for x in IBAN_LENGTHS.items())})\b|\b[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?\b",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d/-]|\.\d)",
    "ssn": r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])",
    "phone": rf"\+\d{{1,3}}{_GAP}\(?\d{{2,4}}\)?{_GAP}\d{{3,4}}{_GAP}\d{{3,4}}(?!\d)|\(\d{{3}}\){_GAP}\d{{3}}{_GAP}\d{{4}}(?!\d)|(?<![\d-])\d{{3}}[ .-]\d{{3}}[ .-]\d{{4}}(?![\d-])",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())

#: Runs of digit groups that can hold cards, the groups, and a card.
CARD_RUN, CARD_GROUP, CARD = r"(?<!\d)\d[\d -]{11,}\d(?!\d)", r"[ -]*\d+", r"\A\d(?:[ -]?\d){12,18}\z"

#: Digits of a card, the usual numbers first: where readings of a run overlap, the first one that is valid counts.
CARD_LENGTHS = (16, 15, 19, 14, 13, 18, 17)

#: Dates are permuted within blocks of 400 years, 189 x 773 days, counted from here.
FIRST_DAY, DAYS = "1800-01-01", (189, 773)

#: First and last block, the years 1 to 199 and 9800 to 9999: number, first day from FIRST_DAY, sizes.
FIRST_BLOCK, LAST_BLOCK = (-5, -657071, (13, 5591)), (20, 20 * 146097, (184, 397))


@dataclass(frozen=True)
class Key:
    """The secret, and whether pseudonyms are made or undone."""

    secret: str
    undo: bool = False


def _long(c: Column | int) -> Column:
    return (F.lit(c) if isinstance(c, int) else c).cast("long")


def _feistel(a: Column, b: Column, size_a: Column | int, size_b: Column | int, key: Key, kind: str) -> Column:
    """Keyed permutation of the pairs (a, b), 0 <= a < size_a, 0 <= b < size_b, or its inverse; a struct with fields a and b."""
    size_a, size_b = _long(size_a), _long(size_b)
    sign = -1 if key.undo else 1

    def turn(s: Column, i: Column) -> Column:
        def noise(x: Column) -> Column:
            told = F.concat_ws("|", F.lit(key.secret), F.lit(kind), size_a.cast("string"), size_b.cast("string"), i.cast("string"), x.cast("string"))
            return F.conv(F.substring(F.sha2(told.cast("binary"), 256), 1, 14), 16, 10).cast("long")

        new_a, new_b = F.pmod(s["a"] + sign * F.pmod(noise(s["b"]), size_a), size_a), F.pmod(s["b"] + sign * F.pmod(noise(s["a"]), size_b), size_b)
        return F.when(i % 2 == 0, F.struct(new_a.alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), new_b.alias("b")))

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if key.undo else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, F.struct(_long(a).alias("a"), _long(b).alias("b")), turn)


def _permuted_digits(digits: Column, key: Key, kind: str) -> Column:
    """Another string of as many digits (2 to 30)."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    ten = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    got = _feistel(F.substring(digits, F.lit(1), u), F.substring(digits, u + 1, n), ten(u), ten(n - u), key, kind)
    return F.transform(F.array(got), lambda s: F.concat(F.lpad(s["a"].cast("string"), u, "0"), F.lpad(s["b"].cast("string"), n - u, "0")))[0]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _filled(form: Column, digits: Column) -> Column:
    """The form with its digits replaced one by one."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("i"))

    def step(s: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(F.concat(s["out"], F.when(digit, F.substring(digits, s["i"] + 1, F.lit(1))).otherwise(c)).alias("out"), (s["i"] + digit.cast("int")).alias("i"))

    return F.aggregate(F.split(form, _CHARS), start, step, lambda s: s["out"])


def _luhn(digits: Column) -> Column:
    """Sum of the Luhn rule over all digits, the last one undoubled."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _card(hit: Column, key: Key) -> Column:
    """Pseudonym of a card that is valid."""

    def made(payload: Column) -> Column:
        check = F.pmod(10 - F.pmod(_luhn(F.concat(payload, F.lit("0"))), F.lit(10)), F.lit(10))
        return F.concat(payload, check.cast("string"))

    digits = _digits(hit)
    payload = _permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    return _filled(hit, F.transform(F.array(payload), made)[0])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _cards_in_run(run: Column, key: Key) -> Column:
    """A run of digit groups with its cards replaced, a struct of text and n; any groups in a row can be a card."""

    def reading(groups: Column, i: Column, j: Column) -> Column:
        text = F.regexp_replace(F.array_join(F.slice(groups, i, j - i + 1), ""), r"\A[ -]+", "")
        rank = F.array_position(F.array(*map(F.lit, CARD_LENGTHS)), F.length(_digits(text)))
        return F.struct(rank.alias("rank"), i.alias("i"), j.alias("j"), text.alias("text"))

    def replaced(groups: Column) -> Column:
        n = F.size(groups)
        every = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, F.least(i + 18, n)), lambda j: reading(groups, i, j))))
        valid = F.filter(F.filter(every, lambda x: x["text"].rlike(CARD)), lambda x: F.pmod(_luhn(_digits(x["text"])), F.lit(10)) == 0)
        none = F.slice(valid, 1, 0)
        apart = lambda got, x: ~F.exists(got, lambda y: (x["i"] <= y["j"]) & (y["i"] <= x["j"]))
        return _let(F.aggregate(F.array_sort(valid), none, lambda got, x: F.when(apart(got, x), F.concat(got, F.array(x))).otherwise(got)), lambda cards: written(groups, cards))

    def written(groups: Column, cards: Column) -> Column:
        def shown(group: Column, at: Column) -> Column:
            return _let(F.filter(cards, lambda x: (at + 1).between(x["i"], x["j"])), lambda here: F.when(F.size(here) == 0, group).when(here[0]["i"] == at + 1, F.concat(F.regexp_extract(group, "^[ -]*", 0), _card(here[0]["text"], key))).otherwise(F.lit("")))

        return F.struct(F.array_join(F.transform(groups, shown), "").alias("text"), F.size(cards).alias("n"))

    return _let(F.regexp_extract_all(run, F.lit(CARD_GROUP), F.lit(0)), replaced)


def _cards(text: Column, key: Key) -> Column:
    """A text with its cards replaced, a struct of text and n."""

    def replaced(runs: Column) -> Column:
        joined = F.array_join(F.zip_with(F.split(text, CARD_RUN, -1), runs, lambda gap, run: F.concat(gap, F.coalesce(run["text"], F.lit("")))), "")
        return F.struct(joined.alias("text"), F.aggregate(runs, F.lit(0), lambda n, run: n + run["n"]).alias("n"))

    found = F.transform(F.regexp_extract_all(text, F.lit(CARD_RUN), F.lit(0)), lambda run: _cards_in_run(run, key))
    return F.when(text.rlike(CARD_RUN), _let(found, replaced)).otherwise(F.struct(text.alias("text"), F.lit(0).alias("n")))


def _mod97(text: Column) -> Column:
    """Remainder by 97 of an IBAN's rearranged form, letters as 10 to 35."""

    def add(total: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), F.pmod(total * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(total * 100 + F.ascii(c) - 55, F.lit(97)))

    return F.aggregate(F.split(text, _CHARS), F.lit(0), add)


def _iban(hit: Column, key: Key) -> Column:
    bare = F.regexp_replace(hit, " ", "")
    rest = F.substring(bare, F.lit(5), F.length(bare))
    digits = _digits(rest)

    def made(body: Column) -> Column:
        check = 98 - _mod97(F.concat(body, F.substring(bare, 1, 2), F.lit("00")))
        return F.concat(F.lpad(check.cast("string"), 2, "0"), _digits(body))

    new = F.transform(F.array(_filled(rest, _permuted_digits(digits, key, "iban"))), made)[0]
    right = (_mod97(F.concat(rest, F.substring(bare, 1, 4))) == 1) & (F.length(digits) >= 2) & (F.length(digits) <= 30)
    return F.when(right, _filled(hit, new)).otherwise(hit)


def _ip(hit: Column, key: Key) -> Column:
    parts = F.transform(F.split(hit, r"\."), lambda x: x.cast("long"))
    got = _feistel(parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], 65536, 65536, key, "ip")
    octets = lambda x: [F.floor(x / 256).cast("long").cast("string"), F.pmod(x, F.lit(256)).cast("string")]
    return F.transform(F.array(got), lambda s: F.concat_ws(".", *octets(s["a"]), *octets(s["b"])))[0]


def _ssn(hit: Column, key: Key) -> Column:
    d = _digits(hit)
    area, group, serial = (F.substring(d, *x).cast("long") for x in ((1, 3), (4, 2), (6, 4)))
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    got = _feistel(place * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn")

    def shown(s: Column) -> Column:
        area = F.floor(s["a"] / 99).cast("long") + 1
        area = area + F.when(area >= 666, 1).otherwise(0)
        pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
        return F.concat_ws("-", pad(area, 3), pad(F.pmod(s["a"], F.lit(99)) + 1, 2), pad(s["b"] + 1, 4))

    return F.transform(F.array(got), shown)[0]


def _date(hit: Column, key: Key) -> Column:
    """ISO, day.month.year, and month/day/year (or day/month/year where only that is a date)."""
    d, first = _digits(hit), F.to_date(F.lit(FIRST_DAY))
    out = hit
    for separator, form, parts in (("/", "dd/MM/yyyy", (5, 3, 1)), ("/", "MM/dd/yyyy", (5, 1, 3)), (".", "dd.MM.yyyy", (5, 3, 1)), ("-", "yyyy-MM-dd", (1, 5, 7))):
        y, m, day = (F.substring(d, at, 4 if k == 0 else 2) for k, at in enumerate(parts))
        when = F.try_to_date(F.concat_ws("-", y, m, day), "yyyy-MM-dd")
        number = F.datediff(when, first)
        block = F.floor(number / (DAYS[0] * DAYS[1]))
        of = lambda usual, pick: F.when(block == FIRST_BLOCK[0], pick(FIRST_BLOCK)).when(block == LAST_BLOCK[0], pick(LAST_BLOCK)).otherwise(usual)  # noqa: E731, B023
        start = of(block * DAYS[0] * DAYS[1], lambda x: x[1])
        size_a, size_b = of(DAYS[0], lambda x: x[2][0]), of(DAYS[1], lambda x: x[2][1])
        inside = number - start
        got = _feistel(F.floor(inside / size_b), F.pmod(inside, size_b), size_a, size_b, key, "date")
        there = F.transform(F.array(got), lambda s: F.date_add(first, (start + s["a"] * size_b + s["b"]).cast("int")))[0]  # noqa: B023
        shown = F.date_format(there, form)
        fits = F.contains(hit, F.lit(separator)) & when.isNotNull()
        out = F.when(fits, shown).otherwise(out)
    return out


def _phone(hit: Column, key: Key) -> Column:
    """The country code stays, all other digits change."""
    head = F.when(hit.startswith("+"), F.regexp_extract(hit, r"^\+\d{1,3}", 0)).otherwise(F.lit(""))
    tail = F.substring(hit, F.length(head) + 1, F.length(hit))
    return F.concat(head, _filled(tail, _permuted_digits(_digits(tail), key, "phone")))


def _digest(value: Column, key: Key, kind: str, n: int) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.lit(key.secret), F.lit(kind), value).cast("binary"), 256), 1, n)


def _email(hit: Column, key: Key) -> Column:
    low = F.lower(hit)
    return F.concat(F.lit("u"), _digest(low, key, "email", 20), F.lit("@d"), _digest(F.substring_index(low, "@", -1), key, "domain", 16), F.lit(".invalid"))


def _secret(hit: Column, key: Key) -> Column:
    named = F.regexp_extract(hit, rf"^(?s)(.*?{_GAP}[=:]{_GAP})[A-Za-z0-9_+/\-]+$", 1)
    value = F.substring(hit, F.length(named) + 1, F.length(hit))
    return F.concat(named, F.lit("[secret "), _digest(value, key, "secret", 16), F.lit("]"))


_MAKERS = {"secret": _secret, "email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone}


def pseudonym(hit: Column, key: Key) -> Column:
    """What stands for a candidate; candidates that fail validation stay as they are."""
    out = hit
    for kind in reversed(PATTERNS):
        if not (key.undo and kind in ("secret", "email")):
            out = F.when(hit.rlike(rf"\A(?:{PATTERNS[kind]})\z"), _MAKERS[kind](hit, key)).otherwise(out)
    return out


def _parts(gaps: Column, hits: Column, made: Column) -> Column:
    """Array of (gap, made): text to be looked at for cards, then a replaced value; candidates that did not change belong to the gaps."""
    found = F.zip_with(F.zip_with(gaps, hits, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit"))), made, lambda x, new: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), new.alias("made")))
    start = F.struct(F.expr("cast(array() as array<struct<gap:string,made:string>>)").alias("out"), F.lit("").alias("open"))

    def step(s: Column, x: Column) -> Column:
        gap = F.concat(s["open"], x["gap"])
        closed = F.struct(F.concat(s["out"], F.array(F.struct(gap.alias("gap"), x["made"].alias("made")))).alias("out"), F.lit("").alias("open"))
        return F.when(x["hit"] != x["made"], closed).otherwise(F.struct(s["out"].alias("out"), F.concat(gap, F.coalesce(x["hit"], F.lit(""))).alias("open")))

    last = lambda s: F.concat(s["out"], F.array(F.struct(s["open"].alias("gap"), F.lit("").alias("made"))))
    return F.aggregate(found, start, step, last)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None, undo: bool = False) -> DataFrame:
    """`docs` with personal data in the text replaced; with count_col also the number of values replaced.

    With undo, pseudonyms made with the same key become the values again (not the
    digests of e-mail addresses and secrets); where a number stands beside others
    that can be read as one card with it, another reading may count.

    A null text stays null and counts 0, an empty one stays empty; texts of any
    length are read whole.  Other columns, whatever their names, and repeated
    rows pass through (a column of the name count_col is replaced).  An empty
    table gives an empty result."""
    secret = Key(key, undo)
    hits_col, new_col, parts_col = fresh(docs, "hits"), fresh(docs, "replaced"), fresh(docs, "parts")
    text, hits, new, parts = F.col(text_col).cast("string"), F.col(hits_col), F.col(new_col), F.col(parts_col)
    likely = text.rlike(r"[0-9@=:]")
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    out = docs.withColumn(hits_col, F.when(likely, found)).withColumn(new_col, F.transform(hits, lambda h: pseudonym(h, secret)))
    looked = F.transform(_parts(F.split(text, PATTERN, -1), hits, new), lambda x: F.struct(_cards(x["gap"], secret).alias("cards"), x["made"].alias("made")))
    out = out.withColumn(parts_col, F.when(likely, looked))
    joined = F.array_join(F.transform(parts, lambda x: F.concat(x["cards"]["text"], x["made"])), "")
    out = out.withColumn(text_col, F.when(likely, joined).otherwise(text))
    if count_col:
        changed = F.size(F.filter(F.zip_with(hits, new, lambda a, b: a != b), lambda x: x)) + F.aggregate(parts, F.lit(0), lambda n, x: n + x["cards"]["n"])
        out = out.withColumn(count_col, F.greatest(F.coalesce(changed, F.lit(0)), F.lit(0)).cast("long"))
    return out.drop(hits_col, new_col, parts_col)


#: Setting that names the key, and what the query takes without it.
KEY_SETTING, EXAMPLE_KEY = "flightloom.pii.key", "key of the example query"


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pseudonymise(docs, spark.conf.get(KEY_SETTING, EXAMPLE_KEY), count_col="n_replaced").select("doc_id", "text", "n_replaced")
