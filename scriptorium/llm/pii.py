"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Found are e-mail addresses, IBANs (mod 97), social security numbers, payment cards (Luhn),
IPv4 addresses, calendar dates (1700 to 2099) and phone numbers. What has the form but fails
the check is left as it is. Each kind is permuted within its own format: lengths, separators,
country codes and check digits stay valid, so equal values get equal pseudonyms in every
document, different ones different, and whoever holds the key can turn them back. An
e-mail's local part and domain name become keyed digests of fixed form (one way).

Dates keep their order: ISO, day first (also where both readings are possible), or month first
where only that reads as a date. Those are permuted among themselves, as a pseudonym that also
reads day first could not be turned back; the others share one permutation. IBANs may be
printed in groups of four; a short upper-case word right behind them is told from a group by the check.

A permutation is an alternating Feistel network on Z_a x Z_b: a value is split in two, and
each half in turn is shifted by a keyed SHA-256 of the other. It is a bijection for any a
and b, so no cycle walking is needed.

All of it is column expressions: texts without a digit and without an @ pass untouched,
others are cut at their matches and put together again. One row out for each row in, with no
shuffle. Null texts stay null with zero counts; empty texts stay empty; a null doc_id stays
null; repeated rows repeat their result. Extra columns are kept in front of the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, set_aside

#: The key of the registered query; others pass their own.
KEY = "example key, replace in production"
ROUNDS = 8
DATE_START, DATE_A, DATE_B = "1700-01-01", 189, 773  # the 146,097 days of 400 years
MONTH_FIRST_A, MONTH_FIRST_B = 9, 9833  # their 88,497 days after the 12th of a month
SSN_A, SSN_B = 898, 99 * 9999

_L, _R = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "iban": _L + r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)" + _R,
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card": _L + r"(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})" + _R,
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9A-Za-z])",
    "date": r"(?<![0-9A-Za-z/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})(?![0-9A-Za-z]|[/.-][0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,5}(?![0-9A-Za-z])",
}
KINDS = list(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _keyed(key: str, kind: str | Column, number: Column, value: Column, below: Column) -> Column:
    """A number below ``below`` (up to 1e15) from the key, the round and a value."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind) if isinstance(kind, str) else kind, number.cast("string"), value.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), below)


def feistel(key: str, kind: str | Column, left: Column, right: Column, a: Column, b: Column, back: bool) -> Column:
    """struct(l, r): (left, right) of Z_a x Z_b permuted by the key, or turned back."""
    sign = F.lit(-1 if back else 1)

    def step(v: Column, i: Column) -> Column:
        odd = i % 2 == 1
        shift_l = F.pmod(v.l + sign * _keyed(key, kind, i, v.r, a), a)
        shift_r = F.pmod(v.r + sign * _keyed(key, kind, i, v.l, b), b)
        return F.struct(F.when(odd, shift_l).otherwise(v.l).alias("l"), F.when(odd, v.r).otherwise(shift_r).alias("r"))

    rounds = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if back else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _pad(n: Column, size: Column) -> Column:
    return F.lpad(n.cast("string"), size, F.lit("0"))


def _power(size: Column) -> Column:
    return F.rpad(F.lit("1"), size + 1, F.lit("0")).cast("long")


def digits_permuted(key: str, kind: str, digits: Column, back: bool) -> Column:
    """A string of 2 to 30 digits as another one of its length."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    tweak = F.concat(F.lit(kind), F.length(digits).cast("string"))
    left, right = F.left(digits, half), F.right(digits, rest)
    pair = feistel(key, tweak, left, right, _power(half), _power(rest), back)
    return F.element_at(F.transform(F.array(pair), lambda p: F.concat(_pad(p.l, half), _pad(p.r, rest))), 1)


def _only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _refilled(m: Column, digits: Column) -> Column:
    """m with its digits replaced in order."""
    def step(v: Column, i: Column) -> Column:
        c = F.substring(m, i, 1)
        digit = c.rlike("[0-9]")
        return F.struct(F.concat(v.s, F.when(digit, F.substring(digits, v.k, 1)).otherwise(c)).alias("s"), (v.k + digit.cast("int")).alias("k"))

    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))
    return F.aggregate(F.sequence(F.lit(1), F.length(m)), start, step, lambda v: v.s)


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Digits summed from the right; each at an even place (doubled=0) or odd one is doubled."""
    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, 1).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == doubled, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step)


def _mod97(alnum: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        c = F.substring(alnum, i, 1)
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), (total * 10 + c.cast("int")) % 97).otherwise((total * 100 + letter) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(alnum)), F.lit(0), step)


def _is_iban(m: Column) -> Column:
    compact = F.regexp_replace(m, " ", "")
    return (F.length(compact) >= 15) & (_mod97(F.concat(F.substring(compact, 5, 40), F.left(compact, F.lit(4)))) == 1)


def _iban_core(m: Column) -> Column:
    """m, without its last group where only the rest passes the check."""
    return F.when(_is_iban(m), m).otherwise(F.regexp_replace(m, " [A-Z0-9]{1,4}$", ""))


def _valid(m: Column) -> dict[str, Column]:
    part = lambda i: F.element_at(F.split(m, r"\."), i).cast("int")
    return {
        "email": F.lit(True),
        "iban": _is_iban(_iban_core(m)),
        "ssn": ~F.left(m, F.lit(3)).isin("000", "666") & ~m.startswith("9") & (F.substring(m, 5, 2) != "00") & (F.right(m, F.lit(4)) != "0000"),
        "card": luhn_sum(_only_digits(m), 0) % 10 == 0,
        "ip": (part(1) < 256) & (part(2) < 256) & (part(3) < 256) & (part(4) < 256),
        "date": F.coalesce(_date(m).between(DATE_START, "2099-12-31"), F.lit(False)),
        "phone": F.length(_only_digits(m)).between(7, 18),
    }


def _iso(m: Column) -> Column:
    """The date's text in ISO order."""
    y, a, b = F.right(m, F.lit(4)), F.substring(m, 1, 2), F.substring(m, 4, 2)
    day_first = m.rlike(r"^[0-9]{2}[/.](0[1-9]|1[0-2])[/.]")
    return F.when(m.rlike("^[0-9]{4}-"), m).otherwise(F.when(day_first, F.concat_ws("-", y, b, a)).otherwise(F.concat_ws("-", y, a, b)))


def _date(m: Column) -> Column:
    return F.try_to_date(_iso(m), "yyyy-MM-dd")


def _month_first(m: Column) -> Column:
    return m.rlike("^[0-9]{2}[/.](1[3-9]|[23])")


def _late_days(month: Column) -> Column:
    """Days after the 12th in the months from DATE_START on before this one."""
    return F.datediff(F.add_months(F.lit(DATE_START).cast("date"), month.cast("int")), F.lit(DATE_START).cast("date")) - 12 * month


def _late_day(n: Column) -> Column:
    """The date that n days after the 12th of a month come before."""
    guess = F.floor(n * 4800 / (MONTH_FIRST_A * MONTH_FIRST_B))
    months = F.filter(F.sequence(guess - 3, guess + 3), lambda x: (_late_days(x) <= n) & (n < _late_days(x + 1)))
    return F.element_at(F.transform(F.slice(months, 1, 1), lambda x: F.date_add(F.add_months(F.lit(DATE_START).cast("date"), x.cast("int")), (12 + n - _late_days(x)).cast("int"))), 1)


def _in_order_of(m: Column, date: Column) -> Column:
    """A date written in m's order: ISO, day first or month first."""
    iso, stop = F.date_format(date, "yyyy-MM-dd"), F.substring(m, 3, 1)
    y, mo, d = F.left(iso, F.lit(4)), F.substring(iso, 6, 2), F.right(iso, F.lit(2))
    return F.when(m.rlike("^[0-9]{4}-"), iso).when(_month_first(m), F.concat(mo, stop, d, stop, y)).otherwise(F.concat(d, stop, mo, stop, y))


def _pseudonyms(key: str, m: Column, back: bool) -> dict[str, Column]:
    digits = _only_digits(m)
    # Each value is bound once by a one-element transform.
    bind = lambda col, use: F.element_at(F.transform(F.array(col), use), 1)

    def card(d: Column) -> Column:
        return bind(digits_permuted(key, "card", F.left(d, F.length(d) - 1), back), lambda p: F.concat(p, F.pmod(10 - luhn_sum(p, 1) % 10, F.lit(10)).cast("string")))

    def iban(core: Column) -> Column:
        bban = F.substring(F.regexp_replace(core, " ", ""), 5, 40)
        numbers = _only_digits(bban)
        new = F.when(F.length(numbers) >= 2, _refilled(bban, digits_permuted(key, "iban", numbers, back))).otherwise(bban)
        checked = bind(new, lambda n: F.concat(_pad(98 - _mod97(F.concat(n, F.left(core, F.lit(2)), F.lit("00"))), F.lit(2)), _only_digits(n)))
        return F.concat(bind(checked, lambda d: _refilled(core, d)), F.substr(m, F.length(core) + 1))

    area = F.left(m, F.lit(3)).cast("int")
    ssn = feistel(key, "ssn", area - 1 - (area > 666).cast("int"), (F.substring(m, 5, 2).cast("int") - 1) * 9999 + F.right(m, F.lit(4)).cast("int") - 1, F.lit(SSN_A), F.lit(SSN_B), back)
    part = lambda i: F.element_at(F.split(m, r"\."), i).cast("long")
    ip = feistel(key, "ip", part(1) * 256 + part(2), part(3) * 256 + part(4), F.lit(65536), F.lit(65536), back)
    day = F.datediff(_date(m), F.lit(DATE_START).cast("date"))
    date = feistel(key, "date", F.floor(day / DATE_B), day % DATE_B, F.lit(DATE_A), F.lit(DATE_B), back)
    # Of a month-first date the days after the 12th up to it: 12 are left out in each month, its own included.
    late = day - 12 * F.ceil(F.months_between(F.add_months(F.trunc(_date(m), "month"), 1), F.lit(DATE_START).cast("date"))).cast("int")
    month_first = feistel(key, "month first", F.floor(late / MONTH_FIRST_B), late % MONTH_FIRST_B, F.lit(MONTH_FIRST_A), F.lit(MONTH_FIRST_B), back)
    as_date = lambda col, use: bind(col, lambda p: _in_order_of(m, use(p)))
    lead = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    at = F.instr(m, "@")
    digest = lambda what, col, n: F.left(F.sha2(F.concat_ws("|", F.lit(key), F.lit(what), F.lower(col)), 256), F.lit(n))
    return {
        "email": m if back else F.concat(digest("local", m, 12), F.lit("@"), digest("domain", F.substr(m, at + 1), 8), F.regexp_extract(m, r"\.[A-Za-z0-9-]+$", 0)),
        "iban": bind(_iban_core(m), iban),
        "ssn": bind(ssn, lambda p: F.concat(_pad(p.l + 1 + (p.l >= 665).cast("int"), F.lit(3)), F.lit("-"), _pad(F.floor(p.r / 9999) + 1, F.lit(2)), F.lit("-"), _pad(p.r % 9999 + 1, F.lit(4)))),
        "card": bind(card(digits), lambda d: _refilled(m, d)),
        "ip": bind(ip, lambda p: F.concat_ws(".", *[c.cast("string") for c in (F.floor(p.l / 256), p.l % 256, F.floor(p.r / 256), p.r % 256)])),
        "date": F.when(_month_first(m), as_date(month_first, lambda p: _late_day(p.l * MONTH_FIRST_B + p.r))).otherwise(
            as_date(date, lambda p: F.date_add(F.lit(DATE_START).cast("date"), (p.l * DATE_B + p.r).cast("int")))
        ),
        "phone": F.concat(lead, bind(F.substr(m, F.length(lead) + 1), lambda rest: _refilled(rest, digits_permuted(key, "phone", _only_digits(rest), back)))),
    }


def pseudonymize(docs: DataFrame, key: str = KEY, back: bool = False) -> DataFrame:
    """docs with ``text`` pseudonymized (or turned back) and counts n_<kind> (long) added;
    count columns of the same names in docs are replaced."""
    counts = [f"n_{k}" for k in KINDS]

    def replaced(m: Column) -> Column:
        """struct(kind, new): kind is null where the check fails."""
        kind = F.lit(None).cast("string")
        fine, new = _valid(m), _pseudonyms(key, m, back)
        for k in reversed(KINDS):
            kind = F.when(m.rlike(f"^(?:{PATTERNS[k]})$"), F.when(fine[k], F.lit(k))).otherwise(kind)
        out = m
        pick = lambda v: F.struct(
            v.alias("kind"), F.coalesce(*[F.when(v == k, new[k]) for k in KINDS], out).alias("new")
        )
        return F.element_at(F.transform(F.array(kind), pick), 1)

    plain, names = set_aside(docs.drop(*counts))
    text = F.col(names["text"]).cast("string")
    hint = text.rlike("[0-9@]")
    found = plain.select("*", F.when(hint, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).alias("_found"))
    found = found.withColumn("_found", F.when(F.size("_found") > 0, F.transform("_found", replaced)))
    gaps = F.split(text, ANY, -1)
    whole = F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, F.size("_found")), F.col("_found"), lambda g, f: F.concat(g, f.new)), ""), F.element_at(gaps, -1))
    new = F.when(F.col("_found").isNull(), text).otherwise(whole)
    n = lambda k: F.coalesce(F.size(F.filter("_found", lambda f: f.kind == k)), F.lit(0))
    return found.select(
        *[new.alias(c) if c == "text" else F.col(n).alias(c) for c, n in names.items()],
        *[F.when(F.col("_found").isNull(), F.lit(0)).otherwise(n(k)).cast("long").alias(f"n_{k}") for k in KINDS],
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(documents(spark, sf_dir).select("doc_id", "text"))
