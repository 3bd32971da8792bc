"""Format-preserving pseudonyms of personal values, in DataFrame functions only.

Values are found by one pattern, validated by kind, and replaced by a keyed permutation within
their format (a Feistel network), so that equal values have equal pseudonyms in every document and
different values of a format keep different ones:

========  ======================================  ===================================================
kind      valid when                              permuted
========  ======================================  ===================================================
email     name, host, top-level domain            letters and digits of the name
secret    after password/token/key = or :         letters and digits of the value
key       AKIA and 16 characters, ghp_, sk-       letters and digits after the prefix
ip        four numbers up to 255                  the 32-bit address
iban      country, check digits, sum right        letters and digits of the account; the check digits follow
phone     +country or separated 3-3-4 digits      all digits but country code and leading ones
abroad    + and 8 to 15 digits, set apart or not  all digits but the first three
ssn       area, group, serial in range            index within all valid numbers
date      of the calendar, 1900 to 2099           year and day of the year (29 February: the leap year)
card      13 to 19 digits, Luhn sum right         all digits but the last, which keeps the sum right
========  ======================================  ===================================================

Dates are year first, or day first; one that can't be day first is month first (its day is above 12), and is permuted
among such: year, and up to the 28th month and day.

Cards are looked for in whole chains of digit groups (one space or hyphen between two): any groups in a row with 13 to
19 digits and the right sum, those with most digits first, then from the left; what is beside them is searched for dates,
ssns and phones.

Text halves take turns: one is shifted, character by character within its class (digit, small or
capital letter), by amounts drawn from SHA-2 of the key, the round and the other half.  Numbers do
the same with two residues.  Anything else, invalid values included, stays as it is.

Defined results: a null text stays null and counts 0 values; an empty one stays empty; repeated rows
are treated alike; other columns are passed on (n_private is replaced).  The key is the caller's: who has it can undo the
pseudonyms, and one key links equal values.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
EDGE, END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}" + END,
    "secret": EDGE + r"(?i:password|passwd|pwd|token|secret|api_?key)\s{0,2}[=:]\s{0,2}[\"']?[A-Za-z0-9+/_-]{8,}+",
    "key": EDGE + r"(?:AKIA[0-9A-Z]{16}|(?:ghp_|gho_|sk-)[A-Za-z0-9]{20,}+)" + END,
    "iban": EDGE + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + END,
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "date": EDGE + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})" + END,
    "ssn": EDGE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + END,
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}" + END,
    "abroad": r"(?<![0-9A-Za-z+])\+[1-9](?:[ .-]?[(]?[0-9][)]?){7,14}" + END,
}
#: A whole chain of digit groups, however long; groups that begin an address or a dotted date aren't of it.
OTHER = r"(?!(?:[0-9]{1,3}\.){3}[0-9]|[0-9]{2}[./][0-9]{2}[./][0-9]{4}|[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-])"
PATTERNS["card"] = r"(?<![0-9A-Za-z.])(?=[0-9](?:[ -]?[0-9]){12})[0-9]++" + END + "(?:[ -]" + OTHER + "[0-9]++" + END + ")*+"
#: What may stand beside the cards of a chain.
BESIDE = "|".join(f"(?:{PATTERNS[k]})" for k in ("date", "ssn", "phone"))
#: What every value of some kind has at least one of: digits, an email's @, a secret's mark, or the beginning of a key.
HINT = "[0-9@=:]|AKIA|ghp_|gho_|sk-"
FINDER = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _is(value: Column, kind: str) -> Column:
    return value.rlike(f"^(?:{PATTERNS[kind]})$")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def _keyed(key: str, kind: str, i: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), other), 512)


def _shift(text: Column, stream: Column) -> Column:
    """Every character moved within its class by a byte of the stream."""

    def one(c: Column, j: Column, stream: Column) -> Column:
        by = F.conv(F.substring(stream, (j % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        at = F.ascii(c)
        moved = lambda first, n: F.char(F.pmod(at - first + by, F.lit(n)) + first)
        return F.when(at.between(48, 57), moved(48, 10)).when(at.between(97, 122), moved(97, 26)).when(at.between(65, 90), moved(65, 26)).otherwise(c)

    moved = _let(stream, lambda known: F.array_join(F.transform(F.split(text, ""), lambda c, j: one(c, j, known)), ""))
    return F.when(F.length(text) == 0, F.lit("")).otherwise(moved)


def permute_text(text: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the strings of this text's format."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r"))
    turn = lambda acc, i: F.struct(acc["r"].alias("l"), _shift(acc["l"], _keyed(key, kind, i, acc["r"])).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda acc: F.concat(acc["l"], acc["r"]))


def permute_pair(a: Column, n: int, b: Column, m: int, key: str, kind: str) -> tuple[Column, Column]:
    """A keyed permutation of the pairs of residues modulo n and m."""
    drawn = lambda i, x: F.conv(F.substring(_keyed(key, kind, i, x.cast("string")), 1, 12), 16, 10).cast("long")

    def turn(acc: Column, i: Column) -> Column:
        first = F.pmod(acc["a"] + drawn(i, acc["b"]), F.lit(n))
        return F.when(i % 2 == 0, F.struct(first.alias("a"), acc["b"].alias("b"))).otherwise(
            F.struct(acc["a"].alias("a"), F.pmod(acc["b"] + drawn(i, acc["a"]), F.lit(m)).alias("b"))
        )

    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)
    return done["a"], done["b"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refill(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced, in order."""
    put = lambda acc, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(acc["s"], F.substring(digits, acc["n"], F.lit(1))).alias("s"), (acc["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["n"].alias("n")))
    return F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("n")), put, lambda acc: acc["s"])


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits that stand before a check digit."""
    weigh = lambda acc, c: F.struct((acc["t"] + F.when(acc["odd"], F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))).alias("t"), (~acc["odd"]).alias("odd"))
    return F.aggregate(F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("t"), F.lit(True).alias("odd")), weigh, lambda acc: acc["t"])


def _is_card(value: Column) -> Column:
    digits = _digits(value)
    return F.length(digits).between(13, 19) & ((_luhn_sum(F.substring(digits, F.lit(1), F.length(digits) - 1)) + F.substring(digits, -1, 1).cast("int")) % 10 == 0)


def _card(value: Column, key: str) -> Column:
    digits = _digits(value)
    fresh = permute_text(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    whole = _let(fresh, lambda x: F.concat(x, F.pmod(-_luhn_sum(x), F.lit(10)).cast("string")))
    return _let(whole, lambda x: _refill(value, x))


def _chain(value: Column, key: str) -> Column:
    """(v, p) parts of a chain of digit groups, end to end."""
    groups = F.split(value, "(?<=[ -])", -1)  # each with the separator that follows it
    joined = lambda g, i, n: F.array_join(F.slice(g, i + 1, n), "")

    def spans(g: Column) -> Column:
        ends = lambda i: F.sequence(i, F.least(i + 18, F.size(g) - 1))
        runs = F.flatten(F.transform(F.sequence(F.lit(0), F.size(g) - 1), lambda i: F.transform(ends(i), lambda j: F.struct((-F.length(_digits(joined(g, i, j - i + 1)))).alias("few"), i.alias("i"), j.alias("j")))))
        cards = F.array_sort(F.filter(runs, lambda r: r["few"].between(-19, -13) & _is_card(joined(g, r["i"], r["j"] - r["i"] + 1))))
        free = lambda acc, r: ~F.exists(acc, lambda x: (x["i"] <= r["j"]) & (r["i"] <= x["j"]))
        none = F.array().cast("array<struct<i:int,j:int>>")
        return F.array_sort(F.aggregate(cards, none, lambda acc, r: F.when(free(acc, r), F.array_append(acc, F.struct(r["i"].alias("i"), r["j"].alias("j")))).otherwise(acc)))

    def parts(g: Column, s: Column) -> Column:
        def part(x: Column, k: Column) -> Column:
            begin = F.when(k == 0, F.lit(0)).otherwise(F.get(s, k - 1)["j"] + 1)
            card = joined(g, x["i"], x["j"] - x["i"] + 1)
            return F.array_append(_replaced(joined(g, begin, x["i"] - begin), BESIDE, ("date", "ssn", "phone"), key), F.struct(card.alias("v"), _card(card, key).alias("p")))

        done = F.when(F.size(s) > 0, F.element_at(s, -1)["j"] + 1).otherwise(F.lit(0))
        return F.concat(F.flatten(F.transform(s, part)), _replaced(joined(g, done, F.size(g) - done), BESIDE, ("date", "ssn", "phone"), key))

    return _let(groups, lambda g: _let(spans(g), lambda s: parts(g, s)))


def _replaced(text: Column, pattern: str, kinds: tuple[str, ...], key: str) -> Column:
    """(v, p) parts of ``text``, end to end: what the pattern finds, and what is between."""
    same = lambda g: F.struct(g.alias("v"), g.alias("p"))
    found = F.regexp_extract_all(text, F.lit(pattern), 0)

    def part(g: Column, v: Column) -> Column:
        return F.when(v.isNull(), F.array(same(g))).otherwise(F.array(same(g), F.struct(v.alias("v"), pseudonym(v, key, kinds).alias("p"))))

    return F.flatten(F.zip_with(F.split(text, pattern, -1), found, part))


def _ip(value: Column, key: str) -> Column:
    part = F.transform(F.split(value, "[.]"), lambda x: x.cast("int"))
    a, b = permute_pair(part[0] * 256 + part[1], 1 << 16, part[2] * 256 + part[3], 1 << 16, key, "ip")
    out = F.concat_ws(".", *[x.cast("string") for x in (F.floor(a / 256), a % 256, F.floor(b / 256), b % 256)])
    return F.when(F.forall(part, lambda x: x <= 255), out).otherwise(value)


def _ssn(value: Column, key: str) -> Column:
    area, group, serial = (F.split(value, "-")[i].cast("int") for i in range(3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    a, b = permute_pair(place * 99 + group - 1, 898 * 99, serial - 1, 9999, key, "ssn")
    place = F.floor(a / 99)
    area = F.when(place >= 665, place + 2).otherwise(place + 1)
    return F.when(valid, F.format_string("%03d-%02d-%04d", area, a % 99 + 1, b + 1)).otherwise(value)


def _date(value: Column, key: str) -> Column:
    iso, mark = value.rlike("^[0-9]{4}-"), F.substring(value, 3, 1)
    dashed = F.translate(value, "./", "--")
    day_first, month_first = F.try_to_date(dashed, "dd-MM-yyyy"), F.try_to_date(dashed, "MM-dd-yyyy")
    day = F.coalesce(F.try_to_date(value, "yyyy-MM-dd"), day_first, month_first)
    valid = day.isNotNull() & F.year(day).between(1900, 2099)
    leap_day = (F.month(day) == 2) & (F.dayofmonth(day) == 29)
    in_leap = (F.dayofyear(F.make_date(F.year(day), F.lit(12), F.lit(31))) == 366) & (F.month(day) > 2)
    year, place = permute_pair(F.year(day) - 1900, 200, F.dayofyear(day) - 1 - in_leap.cast("int"), 365, key, "date")
    plain = F.date_add(F.make_date(F.lit(2001), F.lit(1), F.lit(1)), place.cast("int"))  # a year of 365 days
    usual = F.make_date((year + 1900).cast("int"), F.month(plain), F.dayofmonth(plain))
    nth, _ = permute_pair(F.floor((F.year(day) - 1904) / 4), 49, F.lit(0), 1, key, "leap")
    leap = F.make_date((nth * 4 + 1904).cast("int"), F.lit(2), F.lit(29))
    fresh = F.when(leap_day, leap).otherwise(usual)
    year, place = permute_pair(F.year(day) - 1900, 200, (F.month(day) - 1) * 16 + F.dayofmonth(day) - 13, 192, key, "month first")
    late, _ = permute_pair(F.year(day) - 1900, 200, F.lit(0), 1, key, "late")
    among = F.when(leap_day, leap).when(F.dayofmonth(day) > 28, F.make_date((late + 1900).cast("int"), F.month(day), F.dayofmonth(day))).otherwise(F.make_date((year + 1900).cast("int"), (F.floor(place / 16) + 1).cast("int"), (place % 16 + 13).cast("int")))
    parts = lambda x, first, second: F.concat(F.date_format(x, first), mark, F.date_format(x, second), mark, F.date_format(x, "yyyy"))
    return F.when(valid & iso, F.date_format(fresh, "yyyy-MM-dd")).when(valid & day_first.isNotNull(), parts(fresh, "dd", "MM")).when(valid, parts(among, "MM", "dd")).otherwise(value)


def _remainder(chars: Column) -> Column:
    """Of the number that digits and letters (10 to 35) spell, divided by 97."""
    add = lambda acc, c: F.when(F.ascii(c) < 58, (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(chars, ""), F.lit(0), add)


def _iban(value: Column, key: str) -> Column:
    def changed(plain: Column) -> Column:
        country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
        valid = F.length(plain).between(15, 34) & (_remainder(F.concat(account, country, F.substring(plain, 3, 2))) == 1)
        check = lambda x: F.concat(country, F.lpad((98 - _remainder(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0"), x)
        return F.when(valid, _let(_let(permute_text(account, key, "iban"), check), lambda x: _spread(value, x))).otherwise(value)

    return _let(F.replace(value, F.lit(" "), F.lit("")), changed)


def _spread(value: Column, chars: Column) -> Column:
    """``value`` with all but its spaces replaced, in order."""
    put = lambda acc, c: F.when(c != " ", F.struct(F.concat(acc["s"], F.substring(chars, acc["n"], F.lit(1))).alias("s"), (acc["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["n"].alias("n")))
    return F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("n")), put, lambda acc: acc["s"])


def _abroad(value: Column, key: str) -> Column:
    digits = _digits(value)
    return _let(F.concat(F.substring(digits, 1, 3), permute_text(F.substring(digits, F.lit(4), F.length(digits)), key, "abroad")), lambda x: _refill(value, x))


def _phone(value: Column, key: str) -> Column:
    body = F.regexp_extract(value, r"[(]?[0-9]{3}[)]?[ .-]?[0-9]{3}[ .-][0-9]{4}$", 0)
    digits = _digits(body)
    free = F.concat(F.substring(digits, 2, 2), F.substring(digits, 5, 6))
    fresh = permute_text(free, key, "phone")
    whole = F.concat(F.substring(digits, 1, 1), F.substring(fresh, 1, 2), F.substring(digits, 4, 1), F.substring(fresh, 3, 6))
    return F.concat(F.substring(value, F.lit(1), F.length(value) - F.length(body)), _refill(body, whole))


def _after(pattern: str, kind: str) -> Callable[[Column, str], Column]:
    """Permutes what follows the prefix that ``pattern`` matches."""

    def out(value: Column, key: str) -> Column:
        prefix = F.regexp_extract(value, pattern, 0)
        return F.concat(prefix, permute_text(F.substring(value, F.length(prefix) + 1, F.length(value)), key, kind))

    return out


def _email(value: Column, key: str) -> Column:
    at = F.instr(value, "@")
    return F.concat(permute_text(F.substring(value, F.lit(1), at - 1), key, "email"), F.substring(value, at, F.length(value)))


CHANGES: dict[str, Callable[[Column, str], Column]] = {
    "email": _email,
    "secret": _after(r"^[A-Za-z_]+\s*[=:]\s*[\"']?", "secret"),
    "key": _after(r"^(?:AKIA|ghp_|gho_|sk-)", "key"),
    "iban": _iban,
    "ip": _ip,
    "date": _date,
    "ssn": _ssn,
    "phone": _phone,
    "abroad": _abroad,
}


def pseudonym(value: Column, key: str, kinds: tuple[str, ...] = tuple(CHANGES)) -> Column:
    """What replaces a value that ``FINDER`` found, unless it is a chain of digit groups."""
    out = value
    for kind in reversed(kinds):
        out = F.when(_is(value, kind), CHANGES[kind](value, key)).otherwise(out)
    return out


#: The setting that holds the key of the query and the pipeline.
KEY_SETTING = "spark.weftgraph.pseudonym.key"


def session_key(spark: SparkSession) -> str:
    """The key in the session's settings; where there is none, a fresh one, which links values within one result only."""
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(16)


def pseudonymize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with the values in ``text`` replaced, and n_private: how many were."""
    found = F.regexp_extract_all(F.col(text), F.lit(FINDER), 0)
    mark = "__values"
    while mark in docs.columns:
        mark += "_"
    some = docs.withColumn(mark, F.when(F.col(text).rlike(HINT), found))
    single = "|".join(f"(?:{PATTERNS[k]})" for k in CHANGES)

    def replace(v: Column) -> Column:
        parts = F.when(v.rlike(f"^(?:{single})$"), F.array(F.struct(v.alias("v"), pseudonym(v, key).alias("p")))).otherwise(_chain(v, key))
        return _let(parts, lambda x: F.struct(F.array_join(F.transform(x, lambda y: y["p"]), "").alias("p"), F.size(F.filter(x, lambda y: y["v"] != y["p"])).alias("n")))

    some = some.withColumn(mark, F.when(F.size(mark) > 0, F.transform(F.col(mark), replace)))
    gaps = F.split(F.col(text), FINDER, -1)
    rebuilt = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.col(mark), i)["p"], F.lit("")))), "")
    changed = F.aggregate(F.col(mark), F.lit(0), lambda n, x: n + x["n"])
    return some.withColumns({text: F.when(F.col(mark).isNotNull(), rebuilt).otherwise(F.col(text)), "n_private": F.when(F.col(mark).isNotNull(), changed).otherwise(0)}).drop(mark)
