"""Format-preserving Feistel pseudonyms for personal numbers and dates, with DataFrame functions only.

A value that passes its kind's validation is replaced by a keyed permutation of all
values of its format: a payment card by one with a right check digit, an address by
an address, a date by a date.  Equal values get equal pseudonyms in all documents
under one key, and different ones different; without the key they can't be undone.
A day is one pseudonym in every format; it stays in the first twelve of a month or
beyond them, as only the latter can be told apart where the month stands first.

Kinds: payment cards (13 to 19 digits, Luhn), telephone numbers (+ country code and
10 national digits in groups), IPv4 addresses, US social security numbers, dates
(year-month-day and day or month first, valid days of 1900 to 2099) and, as they
stand among them, the names of e-mail addresses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import let
from .shared import plain, table

ROUNDS = 8
#: The key of tests and of the registered query, which anyone can undo; a production run has its own secret.
KEY = "docvalid-public-test-key"
#: The session's setting that names the secret.
SETTING = "spark.docvalid.pii.key"

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IPV4 = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\w)"
DATE = r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}[/.]\d{2}[/.]\d{4})(?![\w/-]|\.\d)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
PHONE = r"(?<!\w)\+\d{1,3}[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\w)"
#: No letter follows a group of digits, nor the groups that hyphens tie to it.
_ENDS = r"(?!(?:-\d++)*+[\w-])"
#: Groups of digits, 13 digits at least, up to one that begins another kind's value; which of them are cards, _cards decides.
RUN = rf"(?<![\w.-])(?=\d(?:[ -]?\d){{12}})\d++{_ENDS}(?:[ -](?!{EMAIL}|{IPV4}|{DATE}|{SSN})\d++{_ENDS})*+"
ANY = "|".join((EMAIL, IPV4, DATE, SSN, PHONE, RUN))
#: Cards as they are mostly written: these go before other spans of a run.
CARD_FORM = r"^(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})$"

#: The first year of the dates that are permuted, and the number of their months: 1900-01 to 2099-12.
FIRST_YEAR, MONTHS = 1900, 2400


def _number(text: Column) -> Column:
    return text.cast("bigint")


def _drawn(key: str, kind: str, step: Column, value: Column, below: Column) -> Column:
    """A keyed number from 0 to below - 1, by 60 bits of SHA-256."""
    hexed = F.substring(F.sha2(F.concat_ws("/", F.lit(key), F.lit(kind), step.cast("string"), value.cast("string")), 256), 1, 15)
    return F.pmod(F.conv(hexed, 16, 10).cast("bigint"), below)


def _rounds(key: str, kind: str, a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    """struct(a, b) after ROUNDS unbalanced Feistel rounds over 0..size_a-1 and 0..size_b-1; an even number puts the halves back."""
    start = F.struct(a.alias("a"), b.alias("b"), size_a.alias("m"), size_b.alias("n"))

    def step(x: Column, r: Column) -> Column:
        moved = F.pmod(x["a"] + _drawn(key, kind, r, x["b"], x["m"]), x["m"])
        return F.struct(x["b"].alias("a"), moved.alias("b"), x["n"].alias("m"), x["m"].alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """A permutation of the strings of as many digits (2 to 36)."""

    def of(d: Column) -> Column:
        n = F.length(d)
        half = F.floor(n / 2).cast("int")
        power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("bigint")
        out = _rounds(key, kind, _number(F.substring(d, F.lit(1), half)), _number(F.substring(d, half + 1, n - half)), power(half), power(n - half))
        return let(out, lambda x: F.concat(F.lpad(x["a"].cast("string"), half, "0"), F.lpad(x["b"].cast("string"), n - half, "0")))

    return let(digits, of)


def permute_below(value: Column, size: int, key: str, kind: str, also=None) -> Column:
    """A permutation of 0 to size - 1 (of those that ``also`` holds for), by walking cycles of one of a power of 4.

    The walk ends after 64 steps at the latest; it needs more with a chance of less
    than 10^-7 a value when a quarter of the power's values count, and then is null.
    """
    bits = 2
    while 1 << bits < size:
        bits += 2
    side = F.lit(1 << (bits // 2)).cast("bigint")
    fits = lambda x: (x < size) & (also(x) if also else F.lit(True))

    def walk(x: Column, i: Column) -> Column:
        moved = let(_rounds(key, kind, F.floor(x / side).cast("bigint"), F.pmod(x, side), side, side), lambda y: y["a"] * side + y["b"])
        return F.when((i > 1) & fits(x), x).otherwise(moved)

    out = F.aggregate(F.sequence(F.lit(1), F.lit(64)), value.cast("bigint"), walk)
    return let(out, lambda x: F.when(fits(x), x))


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def put_digits(form: Column, digits: Column) -> Column:
    """form, its digits replaced by ``digits`` from left to right."""

    def of(pair: Column) -> Column:
        one = lambda c, i: F.when(c.rlike("[0-9]"), F.substring(pair["d"], F.length(only_digits(F.substring(pair["f"], F.lit(1), i + 1))), F.lit(1))).otherwise(c)
        return F.array_join(F.transform(F.split(pair["f"], ""), one), "")

    return let(F.struct(form.alias("f"), digits.alias("d")), of)


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of the digits, from the right, where every second is doubled, beginning with the ``doubled``-th (0 or 1)."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda c, i: let(c.cast("int") * F.when(i % 2 == doubled, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(values, F.lit(0), lambda s, v: s + v)


def _card(m: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        body = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
        whole = let(body, lambda b: F.concat(b, F.pmod(10 - luhn_sum(b, 0) % 10, F.lit(10)).cast("string")))
        return put_digits(m, whole)

    return let(only_digits(m), of)


def _cards(run: Column, key: str) -> Column:
    """struct(text, n): a run of groups of digits, with pseudonyms for the n cards in it.

    Cards are the spans of whole groups with 13 to 19 digits and a right check digit:
    first those of a usual form, then from the left and the longest; none overlap.
    """
    pieces = F.regexp_extract_all(run, F.lit("([0-9]+[ -]?)"), F.lit(1))

    def spans(p: Column) -> Column:
        def of(i: Column, c: Column) -> Column:
            text = F.regexp_replace(F.array_join(F.slice(p, i + 1, c), ""), "[ -]$", "")
            return let(text, lambda t: F.struct((~t.rlike(CARD_FORM)).alias("odd"), i.alias("i"), (-c).alias("c"), t.alias("t")))

        def right(x: Column) -> Column:
            return let(only_digits(x["t"]), lambda d: F.when(F.length(d).between(13, 19), luhn_sum(d, 1) % 10 == 0).otherwise(F.lit(False)))

        at = F.transform(p, lambda _, i: F.filter(F.transform(F.sequence(F.lit(1), F.least(F.lit(19), F.size(p) - i)), lambda c: of(i, c)), right))
        return F.sort_array(F.flatten(at))

    def chosen(found: Column) -> Column:
        overlaps = lambda x, y: (x["i"] < y["i"] - y["c"]) & (y["i"] < x["i"] - x["c"])
        none = F.filter(found, lambda _: F.lit(False))
        return F.aggregate(found, none, lambda taken, x: F.when(F.exists(taken, lambda y: overlaps(x, y)), taken).otherwise(F.array_append(taken, x)))

    def put(x: Column) -> Column:
        def piece(text: Column, k: Column) -> Column:
            last = F.regexp_extract(text, "[ -]$", 0)
            here = F.filter(x["cards"], lambda y: (y["i"] <= k) & (k < y["i"] - y["c"]))

            def of(y: Column) -> Column:
                card = F.when(y["i"] == k, _card(y["t"], key)).otherwise(F.lit(""))
                return F.when(y.isNull(), text).otherwise(F.concat(card, F.when(k == y["i"] - y["c"] - 1, last).otherwise(F.lit(""))))

            return let(F.get(here, F.lit(0)), of)

        return F.struct(F.array_join(F.transform(x["pieces"], piece), "").alias("text"), F.size(x["cards"]).alias("n"))

    return let(pieces, lambda p: let(chosen(spans(p)), lambda c: let(F.struct(p.alias("pieces"), c.alias("cards")), put)))


def _phone(m: Column, key: str) -> Column:
    return let(only_digits(m), lambda d: put_digits(m, F.concat(F.substring(d, F.lit(1), F.length(d) - 10), permute_digits(F.substring(d, F.length(d) - 9, F.lit(10)), key, "phone"))))


def _ip(m: Column, key: str) -> Column:
    def of(parts: Column) -> Column:
        a, b, c, d = (F.get(parts, F.lit(i)).cast("bigint") for i in range(4))
        side = F.lit(65536).cast("bigint")
        out = _rounds(key, "ip", a * 256 + b, c * 256 + d, side, side)
        text = let(out, lambda x: F.concat_ws(".", *[v.cast("string") for h in ("a", "b") for v in (F.floor(x[h] / 256), x[h] % 256)]))
        return F.when(F.forall(parts, lambda p: p.cast("int") <= 255), text).otherwise(m)

    return let(F.split(m, r"\."), of)


def _ssn_valid(x: Column) -> Column:
    area = F.floor(x / 1_000_000)
    return (area > 0) & (area != 666) & (area < 900) & (F.floor(x / 10_000) % 100 > 0) & (x % 10_000 > 0)


def _ssn(m: Column, key: str) -> Column:
    def of(x: Column) -> Column:
        moved = permute_below(x, 10**9, key, "ssn", _ssn_valid)
        return F.when(_ssn_valid(x), F.coalesce(let(moved, lambda y: put_digits(m, F.lpad(y.cast("string"), 9, "0"))), m)).otherwise(m)

    return let(_number(only_digits(m)), of)


def permute_day(day: Column, key: str) -> Column:
    """A permutation of the days of 1900 to 2099, null for others: of the first to twelfth of all months, and of the others."""
    months = (F.year(day) - FIRST_YEAR) * 12 + F.month(day) - 1
    low = F.dayofmonth(day) <= 12
    first, size = F.when(low, 1).otherwise(13), F.when(low, 12).otherwise(19)
    start = F.struct(months.cast("bigint").alias("a"), (F.dayofmonth(day) - first).cast("bigint").alias("b"))
    month = lambda x: F.make_date((FIRST_YEAR + F.floor(x["a"] / 12)).cast("int"), (x["a"] % 12 + 1).cast("int"), F.lit(1))
    fits = lambda x: x["b"] + first <= F.dayofmonth(F.last_day(month(x)))

    def walk(x: Column, i: Column) -> Column:
        moved = let(_rounds(key, "date", x["a"], x["b"], F.lit(MONTHS).cast("bigint"), size.cast("bigint")), lambda y: F.struct(y["a"].alias("a"), y["b"].alias("b")))
        return F.when((i > 1) & fits(x), x).otherwise(moved)

    # one step in thirty leads to a day that its month lacks; so many in turn never do
    out = F.aggregate(F.sequence(F.lit(1), F.lit(24)), start, walk)
    return F.when((months >= 0) & (months < MONTHS), let(out, lambda x: F.date_add(month(x), (x["b"] + first - 1).cast("int"))))


def _date(m: Column, key: str) -> Column:
    """Year first, or day first where that is a valid day, else month first."""
    mark = F.substring(m, 3, 1)
    iso = m.rlike(r"^\d{4}-")
    day_first, month_first = (F.try_to_date(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, a, 2), F.substring(m, b, 2)), "yyyy-MM-dd") for a, b in ((4, 1), (1, 4)))

    def of(x: Column) -> Column:
        form = lambda *parts: let(permute_day(F.coalesce(x["iso"], x["dmy"], x["mdy"]), key), lambda d: F.concat(*[F.date_format(d, p) if isinstance(p, str) else p for p in parts]))
        text = F.when(x["iso"].isNotNull(), form("yyyy-MM-dd")).when(x["dmy"].isNotNull(), form("dd", mark, "MM", mark, "yyyy")).otherwise(form("MM", mark, "dd", mark, "yyyy"))
        return F.coalesce(text, m)

    return let(F.struct(F.when(iso, F.try_to_date(m, "yyyy-MM-dd")).alias("iso"), F.when(~iso, day_first).alias("dmy"), F.when(~iso, month_first).alias("mdy")), of)


def _email(m: Column, key: str) -> Column:
    """The name before the @: its letters and digits, each within its kind, in Feistel rounds over its two halves."""
    name, rest = F.substring_index(m, "@", 1), F.substring(m, F.instr(m, "@"), F.length(m))

    def shift(c: Column, k: Column) -> Column:
        moved = lambda first, n: F.char(first + F.pmod(F.ascii(c) - first + k, F.lit(n)))
        return F.when(c.rlike("[a-z]"), moved(97, 26)).when(c.rlike("[A-Z]"), moved(65, 26)).when(c.rlike("[0-9]"), moved(48, 10)).otherwise(c)

    def step(x: Column, r: Column) -> Column:
        hexed = F.sha2(F.concat_ws("/", F.lit(key), F.lit("email"), r.cast("string"), x["b"]), 256)
        moved = let(hexed, lambda h: F.array_join(F.transform(F.split(x["a"], ""), lambda c, i: shift(c, F.conv(F.substring(h, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int"))), ""))
        return F.struct(x["b"].alias("a"), moved.alias("b"))

    def of(n: Column) -> Column:
        half = F.floor(F.length(n) / 2).cast("int")
        start = F.struct(F.substring(n, F.lit(1), half).alias("a"), F.substring(n, half + 1, F.length(n)).alias("b"))
        out = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
        return let(out, lambda x: F.concat(x["a"], x["b"], rest))

    return let(name, of)


def pseudonym(m: Column, key: str) -> Column:
    """struct(text, n): the pseudonym of a text that ANY matches, itself where its validation fails, and the number of values replaced."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    one = lambda new: let(new, lambda v: F.struct(v.alias("text"), (v != m).cast("int").alias("n")))
    return (
        F.when(F.instr(m, "@") > 0, one(_email(m, key)))
        .when(F.substring(m, 1, 1) == "+", one(_phone(m, key)))
        .when(whole(r"\d{1,3}(?:\.\d{1,3}){3}"), one(_ip(m, key)))
        .when(whole(r"\d{4}-\d{2}-\d{2}|\d{2}[/.]\d{2}[/.]\d{4}"), one(_date(m, key)))
        .when(whole(r"\d{3}-\d{2}-\d{4}"), one(_ssn(m, key)))
        .otherwise(_cards(m, key))
    )


def secret(spark: SparkSession) -> str:
    """The key that the session's setting names; ValueError without one."""
    if not (key := spark.conf.get(SETTING, None)):
        raise ValueError(f"set {SETTING} to a secret key")
    return key


def pseudonymise(docs: DataFrame, key: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with its text's values replaced, and n_replaced, their number (bigint, 0 for none).

    key: the secret, by default that of the session's setting.  A null text stays null
    and an empty one empty; text without such values is not
    changed in any character.  All other columns stay as they are, in their order,
    save one named n_replaced, whose place the number takes.  Rows are independent:
    repeated ones get the same result, and an empty table gives an empty one.
    """
    secret_ = secret(docs.sparkSession) if key is None else key
    text = docs[f"`{text_col}`"].cast("string")
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1)))
    # the row as one column, so that no name of its own can clash with ours
    held = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), text.alias("text"), found.alias("found"))
    held = held.withColumn("new", F.when(F.size("found") > 0, F.transform("found", lambda m: pseudonym(m, secret_))))

    def joined(new: Column) -> Column:
        return F.array_join(F.zip_with(F.split("text", ANY, -1), new, lambda gap, v: F.concat(gap, F.coalesce(v["text"], F.lit("")))), "")

    new_text = F.when(F.col("new").isNotNull(), joined(F.col("new"))).otherwise(F.col("text"))
    count = F.when(F.col("new").isNotNull(), F.aggregate("new", F.lit(0), lambda s, v: s + v["n"])).otherwise(F.lit(0)).cast("bigint")
    kept = [c for c in docs.columns if c.lower() != "n_replaced"]
    return held.select(*[new_text.alias(c) if c.lower() == text_col.lower() else F.col("row").getField(c).alias(c) for c in kept], count.alias("n_replaced"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the public key, as tests must know the result."""
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)
