"""Format-preserving pseudonyms for personal data, in DataFrame operations only.

A text is cut at everything that looks like personal data.  A hit that also
passes the check of its kind is replaced by a keyed permutation of itself within
its format, all else stays as it is to the last character.  Hits have any length.
As the permutation depends on the key and the value alone, equal values keep equal
pseudonyms across documents, different values keep different ones, and with the
key ``restore`` turns texts back: a pseudonym is a hit of the same kind in the same place.
The permutations are Feistel networks, in restoring run backwards; where one leaves
the kind of a value, it is repeated until it is back in it:

- characters (cards, phones, mail names, secrets, other numbers): the string is
  halved; each round adds to one half a keyed hash of the other half, place by
  place within the character's class, so a digit stays a digit, a lower-case
  letter a lower-case letter, and a hexadecimal string hexadecimal.  A secret keeps
  a prefix that tells its kind.  Cards (13 to 19 digits with a Luhn check digit):
  all but the last digit are permuted and the check digit is set anew; numbers
  of that length without a valid check digit stay without one.  Three digits after
  a card of 16 are part of it only if 19 digits have a check digit and 16 have none.
- IBANs (compact or in groups, of their country's length, with a valid check): all
  after the check digits is permuted, the country stays, the check is set anew.
- IPv4 addresses: two halves of 16 bits.
- dates (YYYY-MM-DD, also before a time; YYYY/M/D; D.M.YYYY, D/M/YYYY, D-M-YYYY, or month first
  where only that is valid; with the month's name in English, German, French or Spanish; 1800 to
  2199): the 146,097 days of 400 years as a 189 x 773 grid; rows and columns take turns.  DD.MM.YY: the
  36,525 days of 1950 to 2049 as a 75 x 487 grid.  Where the day or month has one digit, a leading zero or
  the month first, or a month's name is of a language, the permutation is repeated until the new day is written so too.
- mail names in any script: letters move within ranges of letters (see LETTERS), marks
  and what is in none of the ranges stay.

Numbers of 9 to 12 or over 19 digits, phones and social security numbers have no
check digit to validate; as they may be account or identity numbers, all are permuted
where they stand by themselves.  Runs of 13 to 19 digits and cards in groups are hits wherever no digit touches them, so also
after letters, underscores and hyphens.  What stays in clear: shorter numbers that touch a letter, ``_`` or
(before) ``-``, other formats of dates, names and addresses in prose.

Null text stays null, empty text empty.  Texts without a hit are returned as they
are; very long ones take time in proportion to their length.  Equal rows stay
equal; all other columns are kept; an empty table gives an empty table.  Values
only link where they are written in the same format.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm.exprs import let

ROUNDS = 6
DAYS, COLUMNS = 146_097, 773
FIRST_DAY, LAST_DAY = "1800-01-01", "2199-12-31"
#: The days of dates with two digits for the year.
SHORT_DAYS, SHORT_COLUMNS, FIRST_SHORT = 36_525, 487, "1950-01-01"

MAIL_NAME = r"[\p{L}\p{M}\p{N}._%+\-]"
MAIL = rf"{MAIL_NAME}++@[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{M}}\p{{N}}.\-]*[\p{{L}}\p{{M}}\p{{N}}])?\.\p{{L}}{{2,}}"
ADDRESS = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
DATE = r"\d{4}-\d{2}-\d{2}"
WRITTEN = r"\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4}"
YEAR_FIRST = r"\d{4}/\d{1,2}/\d{1,2}|\d{4}\.\d{2}\.\d{2}"
SHORT_YEAR = r"\d{2}\.\d{2}\.\d{2}|\d{2}/\d{2}/\d{2}|\d{2}-\d{2}-\d{2}"
#: The months' names.
MONTHS = {
    "English": "January February March April May June July August September October November December",
    "German": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember",
    "French": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "Spanish": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "short": "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec",
}
NAMES = "|".join(sorted({n for names in MONTHS.values() for n in names.split()}, key=lambda n: (-len(n), n)))
ENGLISH = "|".join(sorted({n for k in ("English", "short") for n in MONTHS[k].split()}, key=lambda n: (-len(n), n)))
DAY_NAMED = rf"(\d{{1,2}})((?:st|nd|rd|th|\.|er)?(?: de| of)? )({NAMES})(\.?(?: de|,)? )(\d{{4}})"
MONTH_NAMED = rf"({ENGLISH})(\.? )(\d{{1,2}})((?:st|nd|rd|th)?,? )(\d{{4}})"
NAMED = f"{DAY_NAMED}|(?=[JFMASOND]){MONTH_NAMED}".replace("((", "(?:(").replace("(\\d", "(?:\\d").replace(f"({NAMES})", f"(?:{NAMES})").replace(f"({ENGLISH})", f"(?:{ENGLISH})")
#: With a country code, in groups of 3, 3 and 4 digits, or national with a leading 0.
TRIPLE = r"\d{3}[ .\-]\d{3}[ .\-]\d{4}"
NATIONAL = r"0\d(?:[ .\-]\d{2}){4}|0\d{2,4}[ /\-]\d{6,8}|0\d{2,4}[ \-]\d{3,4}[ \-]\d{3,4}"
PHONE = rf"\+\d{{1,3}}[ .\-]?\(?\d{{2,4}}\)?(?:[ .\-]?\d{{2,4}}){{2,4}}|\(\d{{3}}\) ?\d{{3}}[ .\-]\d{{4}}|{TRIPLE}|{NATIONAL}"
SOCIAL = r"\d{3}-\d{2}-\d{4}"
FOURS = r"\d{4}[ .\-]\d{4}[ .\-]\d{4}[ .\-]\d{4}"
CARD = rf"{FOURS}(?:[ .\-]\d{{3}}(?!\d))?|\d{{4}}[ \-]\d{{6}}[ \-]\d{{4,5}}|\d{{4}}[ \-]\d{{4}}[ \-]\d{{5}}|\d{{6}}[ \-]\d{{13}}"
NUMBER = r"\d{9,}"
#: Hex or mixed strings of 32 characters or more with a digit, and keys with a known prefix.
PREFIX = "AKIA|ghp_|sk-|sk_live_|xox[bp]-"
SECRET = rf"(?=[A-Za-z]*\d)[A-Za-z0-9]{{32,}}|(?:{PREFIX})[A-Za-z0-9_\-]{{12,}}"
#: Countries by the length of their IBANs.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV",
    22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR",
    27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
IBAN = "|".join(
    rf"(?:{names})\d{{2}}(?:[ \-]?[A-Z0-9]{{4}}){{{(size - 4) // 4}}}" + (rf"[ \-]?[A-Z0-9]{{{size % 4}}}" if size % 4 else "")
    for size, names in IBAN_COUNTRIES.items()
)
#: Around an IBAN; one in a mail address is a part of that.
BEFORE_IBAN, AFTER_IBAN = r"(?<![A-Za-z0-9@])", r"(?![A-Za-z0-9]|[\w.%+\-]*@)"
#: The most repeats of the permutation of a written date; one in five days at least is written with one digit each.
WALK = 256
#: The same where a kind of secret or card may be left; at worst one value in four leaves its kind at a step.
STEPS = 64

HIT = "|".join(
    [
        rf"(?<!{MAIL_NAME})(?:{MAIL})",
        rf"(?<![A-Za-z0-9])(?:{SECRET})(?![A-Za-z0-9])",
        rf"(?<![\w.])(?:{ADDRESS})(?![\w]|\.\d)",
        rf"(?<![\w/\-])(?<!\d\.)(?:{WRITTEN}|{YEAR_FIRST}|{SHORT_YEAR})(?!\w|[./\-]\d)",
        rf"(?<![\p{{L}}\p{{N}}_])(?:{NAMED})(?!\d)",
        rf"(?<!\d)(?:{CARD})(?!\d)",
        rf"(?<![\w+])(?:{PHONE})(?!\w)",
        rf"(?<![\w\-])(?:{DATE}(?=T\d)|(?:{DATE}|{SOCIAL}|{NUMBER})(?![\w]))",
        r"(?<!\d)\d{13,19}(?!\d)",
    ]
)


#: Ranges of code points that are all letters of one case: (first, how many).
LETTERS = (
    (0xC0, 23), (0xD8, 7), (0xDF, 24), (0xF8, 8), (0x391, 17), (0x3A3, 9), (0x3AC, 35), (0x400, 16), (0x410, 32), (0x430, 32), (0x450, 16),
    (0x5D0, 27), (0x621, 26), (0x641, 10), (0x3041, 86), (0x30A1, 90), (0x4E00, 20992), (0xAC00, 11172),
)


def _pad(key: str, label: Column, half: Column) -> Column:
    """32 keyed bytes from one half, as hexadecimal digits."""
    return F.sha2(F.concat(F.lit(key), F.lit("|"), label, F.lit("|"), half), 256)


def _shifted(chars: Column, pad: Column, alphabet: str | None, back: bool) -> Column:
    """Each character moved on, or back, within its class by the pad's byte at its place (the pad repeats).

    With an ``alphabet``, all characters are of it and it is the one class.
    """

    def moved(c: Column, i: Column) -> Column:
        byte = F.conv(F.substring(pad, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")

        def by(size: int) -> Column:
            return size - byte % size if back else byte

        if alphabet:
            return F.substring(F.lit(alphabet), (F.instr(F.lit(alphabet), c) - 1 + by(len(alphabet))) % len(alphabet) + 1, F.lit(1))

        def beyond(code: Column) -> Column:
            """A letter that isn't ASCII, within its range."""
            firsts, sizes = (F.expr(f"array({', '.join(str(r[k]) for r in LETTERS)})") for k in (0, 1))
            at = F.size(F.filter(firsts, lambda first: first <= code)) - 1

            def within(r: Column) -> Column:
                new = (code - r["first"] + F.pmod(F.lit(-1) * byte if back else byte, r["size"])) % r["size"] + r["first"]
                return F.when((at >= 0) & (code < r["first"] + r["size"]), F.decode(F.unhex(F.lpad(F.hex(new), 4, "0")), "UTF-16BE"))

            return F.coalesce(let(F.struct(F.get(firsts, at).alias("first"), F.get(sizes, at).alias("size")), within), c)

        def step(first: str, size: int) -> Column:
            return F.char((F.ascii(c) - ord(first) + by(size)) % size + ord(first))

        return (
            F.when((c >= "0") & (c <= "9"), step("0", 10))
            .when((c >= "a") & (c <= "z"), step("a", 26))
            .when((c >= "A") & (c <= "Z"), step("A", 26))
            .when(c < "\u0080", c)
            .otherwise(let(F.ascii(c), beyond))
        )

    return F.array_join(F.transform(F.filter(F.split(chars, ""), lambda c: c != ""), moved), "")


def _rounds(back: bool) -> Column:
    return F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))


def permuted_text(key: str, label: str, value: Column, alphabet: str | None = None, back: bool = False) -> Column:
    """The character network; without an alphabet, characters outside 0-9, a-z and A-Z stay in place."""

    def from_half(size: Column) -> Column:
        state = F.struct(F.substring(value, F.lit(1), size).alias("a"), F.substring(value, size + 1, F.length(value)).alias("b"))

        def turn(s: Column, r: Column) -> Column:
            # the first half moves by the second one in even rounds, the second by the first in odd ones
            even, name = r % 2 == 0, F.concat(F.lit(label), F.lit(":"), r.cast("string"))

            def moved(half: Column) -> Column:
                new = _shifted(half["moves"], _pad(key, name, half["by"]), alphabet, back)
                return let(new, lambda new: F.struct(F.when(even, new).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(new).alias("b")))

            return let(F.struct(F.when(even, s["a"]).otherwise(s["b"]).alias("moves"), F.when(even, s["b"]).otherwise(s["a"]).alias("by")), moved)

        return F.aggregate(_rounds(back), state, turn, lambda s: F.concat(s["a"], s["b"]))

    return let(F.floor(F.length(value) / 2).cast("int"), from_half)


def _number(key: str, label: Column, half: Column) -> Column:
    return F.conv(F.substring(_pad(key, label, half.cast("string")), 1, 12), 16, 10).cast("long")


def _turned(key: str, label: str, s: Column, r: Column, rows: int, columns: int, back: bool) -> Column:
    """One round on a grid: the row moves by the column in even rounds, the column by the row in odd ones."""
    even, name = r % 2 == 0, F.concat(F.lit(label), F.lit(":"), r.cast("string"))
    number = _number(key, name, F.when(even, s["b"]).otherwise(s["a"]))
    size = F.when(even, rows).otherwise(columns)
    by = number % size
    new = (F.when(even, s["a"]).otherwise(s["b"]) + (size - by if back else by)) % size
    return let(new, lambda new: F.struct(F.when(even, new).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(new).alias("b")))


def permuted_grid(key: str, label: str, value: Column, rows: int, columns: int, back: bool = False) -> Column:
    """A permutation of 0 .. rows * columns - 1."""
    state = F.struct(F.floor(value / columns).cast("long").alias("a"), (value % columns).cast("long").alias("b"))

    return F.aggregate(_rounds(back), state, lambda s, r: _turned(key, label, s, r, rows, columns, back), lambda s: s["a"] * columns + s["b"])


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum of a string of digits, of which the last counts once."""
    size = F.length(digits)

    def weight(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = (size - i) % 2 == 0
        return F.when(~twice, d).when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), weight), F.lit(0), lambda a, x: a + x)


def _laid_out(pattern: Column, digits: Column) -> Column:
    """The digits put where ``pattern`` has digits."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(
        F.filter(F.split(pattern, ""), lambda c: c != ""),
        start,
        lambda s, c: F.when(
            c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substring(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))
        ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
        lambda s: s["out"],
    )


def _long_number(key: str, value: Column, back: bool) -> Column:
    """13 to 19 digits: how far the last digit is from the check digit stays, so cards map to cards and others to others."""

    def off(body: Column, last: Column) -> Column:
        return (luhn_sum(F.concat(body, F.lit("0"))) + last) % 10

    def of_digits(digits: Column) -> Column:
        body, last = F.substring(digits, F.lit(1), F.length(digits) - 1), F.substring(digits, -1, 1).cast("int")
        return let(
            permuted_text(key, "card", body, "0123456789", back),
            lambda new: _laid_out(value, F.concat(new, ((off(body, last) + 10 - luhn_sum(F.concat(new, F.lit("0"))) % 10) % 10).cast("string"))),
        )

    return let(F.regexp_replace(value, "[^0-9]", ""), of_digits)


def _walked(value: Column, kind: Callable[[Column], Column], step: Callable[[Column], Column]) -> Column:
    """``step`` of ``value``, repeated until the result is of the value's kind."""

    def turn(s: Column, _: Column) -> Column:
        def moved(new: Column) -> Column:
            return F.struct(new.alias("value"), s["kind"].alias("kind"), (kind(new) == s["kind"]).alias("done"))

        return F.when(s["done"], s).otherwise(let(step(s["value"]), moved))

    state = F.struct(value.alias("value"), kind(value).alias("kind"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), state, turn, lambda s: s["value"])


def _card(key: str, value: Column, back: bool) -> Column:
    """Of 4-4-4-4-3 digits, the last three stay apart unless they make the card."""
    longer = value.rlike(rf"^{FOURS}[ .\-]")

    def apart(v: Column) -> Column:
        digits = F.regexp_replace(v, "[^0-9]", "")
        return longer & ((luhn_sum(digits) % 10 != 0) | (luhn_sum(F.substring(digits, 1, 16)) % 10 == 0))

    def of_kind(kind: Column) -> Column:
        # by the value's own kind, so that all steps are of one permutation
        size = F.when(kind, F.lit(19)).otherwise(F.length(value))
        return _walked(value, apart, lambda v: F.concat(_long_number(key, F.substring(v, F.lit(1), size), back), F.substring(v, size + 1, F.lit(4))))

    return let(apart(value), of_kind)


def _secret(key: str, value: Column, back: bool) -> Column:
    """Digits stay digits, hexadecimal strings hexadecimal, and prefixes as they are."""

    def prefix(v: Column) -> Column:
        return F.regexp_extract(v, rf"^(?:{PREFIX})", 0)

    def kind(v: Column) -> Column:
        # an IBAN is found as one before all else
        return (
            F.when(v.rlike("^[0-9]+$"), F.lit("digits"))
            .when(v.rlike("^(?=.*[0-9])[0-9a-f]{32,}$"), F.lit("hex"))
            .when(v.rlike("^(?=.*[0-9])[0-9A-F]{32,}$"), F.lit("HEX"))
            .when(v.rlike(rf"^(?:{IBAN})$") & _is_iban(v), F.lit("iban"))
            .otherwise(F.concat(F.lit("other"), prefix(v)))
        )

    def step(v: Column) -> Column:
        return (
            F.when(kind_of_value == "hex", permuted_text(key, "hex", v, "0123456789abcdef", back))
            .when(kind_of_value == "HEX", permuted_text(key, "hex", v, "0123456789ABCDEF", back))
            .otherwise(F.concat(front, permuted_text(key, "other", F.substring(v, F.length(front) + 1, F.length(v)), back=back)))
        )

    # by the value's own kind and prefix, so that all steps are of one permutation
    kind_of_value, front = kind(value), prefix(value)
    return _walked(value, kind, step)


def _mod_97(plain: Column) -> Column:
    """Letters count as 10 to 35."""

    def add(n: Column, c: Column) -> Column:
        d = (F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1).cast("int")
        return (n * F.when(d > 9, 100).otherwise(10) + d) % 97

    return F.aggregate(F.filter(F.split(plain, ""), lambda c: c != ""), F.lit(0), add)


def _is_iban(value: Column) -> Column:
    plain = F.regexp_replace(value, "[^A-Z0-9]", "")
    return _mod_97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1


def _iban(key: str, value: Column, back: bool) -> Column:
    def with_check(new: Column) -> Column:
        country = F.substring(value, 1, 2)
        check = 98 - _mod_97(F.concat(F.regexp_replace(new, "[^A-Z0-9]", ""), country, F.lit("00")))
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), new)

    return let(permuted_text(key, "iban", F.substring(value, F.lit(5), F.length(value)), back=back), with_check)


def _phone(key: str, value: Column, back: bool) -> Column:
    """A country code stays, and so does the 0 that makes a number a national one."""
    country = F.regexp_extract(value, rf"^(?:\+\d{{1,3}}(?=[ .\-(])|0(?!\d\d[ .\-]\d{{3}}[ .\-]\d{{4}}$))", 0)
    return F.concat(country, permuted_text(key, "phone", F.substring(value, F.length(country) + 1, F.length(value)), back=back))


def _address(key: str, value: Column, back: bool) -> Column:
    def of_parts(parts: Column) -> Column:
        whole = F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n * 256 + p.cast("long"))
        return let(
            permuted_grid(key, "address", whole, 65536, 65536, back),
            lambda n: F.concat_ws(".", *(F.floor(n / 256**k).cast("long") % 256 for k in (3, 2, 1, 0))),
        )

    return let(F.split(value, r"\."), of_parts)


def _date(key: str, value: Column, back: bool) -> Column:
    day = F.datediff(F.try_to_date(value, "yyyy-MM-dd"), F.to_date(F.lit(FIRST_DAY))).cast("long")
    new = permuted_grid(key, "date", day, DAYS // COLUMNS, COLUMNS, back)
    return F.date_format(F.date_add(F.to_date(F.lit(FIRST_DAY)), new.cast("int")), "yyyy-MM-dd")


def _walked_date(
    key: str, start: Column, kind: Column, fits: Callable[[Column, Column], Column], written: Callable[[Column, Column], Column], back: bool, short: bool = False
) -> Column:
    """``written`` of the permuted day, the permutation repeated until the day ``fits``.

    ``start``: the day's number from the first one; ``kind`` is worked out once and handed to both functions with the date.
    """
    first, rows, columns, label = (FIRST_SHORT, SHORT_DAYS // SHORT_COLUMNS, SHORT_COLUMNS, "short") if short else (FIRST_DAY, DAYS // COLUMNS, COLUMNS, "date")
    state = F.struct(F.floor(start / columns).cast("long").alias("a"), (start % columns).cast("long").alias("b"), F.lit(False).alias("done"), kind.alias("kind"))

    def date(s: Column) -> Column:
        return F.date_add(F.to_date(F.lit(first)), (s["a"] * columns + s["b"]).cast("int"))

    def turn(s: Column, i: Column) -> Column:
        r = ROUNDS - 1 - i % ROUNDS if back else i % ROUNDS

        def moved(new: Column, done: bool) -> Column:
            return F.struct(new["a"].alias("a"), new["b"].alias("b"), F.lit(done).alias("done"), s["kind"].alias("kind"))

        there = s["done"] | ((i > 0) & (i % ROUNDS == 0) & fits(date(s), s["kind"]))
        return F.when(there, moved(s, True)).otherwise(let(_turned(key, label, s, r, rows, columns, back), lambda new: moved(new, False)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(WALK * ROUNDS)), state, turn, lambda s: written(date(s), s["kind"]))


def _day_number(year: Column, month: Column, day: Column) -> Column:
    """Days since FIRST_DAY; null if there is no such day within 400 years."""
    found = F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    return F.when(found.between(F.to_date(F.lit(FIRST_DAY)), F.to_date(F.lit(LAST_DAY))), F.datediff(found, F.to_date(F.lit(FIRST_DAY))).cast("long"))


def _written_date(key: str, value: Column, back: bool) -> Column:
    """A date of two numbers and a year keeps its order, its marks and the width of each number."""
    first, mark, second = F.regexp_extract(value, r"^\d+", 0), F.regexp_extract(value, r"\D", 0), F.regexp_extract(value, r"^\d+\D(\d+)", 1)
    in_order = _day_number(F.substring(value, -4, 4), second, first)
    start = F.coalesce(in_order, _day_number(F.substring(value, -4, 4), first, second))
    kind = F.struct(in_order.isNotNull().alias("in_order"), F.length(first).alias("first"), F.length(second).alias("second"))

    def numbers(d: Column, k: Column) -> tuple[Column, Column]:
        return F.when(k["in_order"], F.dayofmonth(d)).otherwise(F.month(d)), F.when(k["in_order"], F.month(d)).otherwise(F.dayofmonth(d))

    def fits(d: Column, k: Column) -> Column:
        a, b = numbers(d, k)
        return ((a < 10) | (k["first"] == 2)) & ((b < 10) | (k["second"] == 2)) & (k["in_order"] | (b > 12))

    def written(d: Column, k: Column) -> Column:
        a, b = (F.lpad(n.cast("string"), k[w], "0") for n, w in zip(numbers(d, k), ("first", "second"), strict=True))
        return F.concat(a, mark, b, mark, F.year(d).cast("string"))

    return F.when(start.isNull(), value).otherwise(_walked_date(key, start, kind, fits, written, back))


def _year_first(key: str, value: Column, back: bool) -> Column:
    """Y/M/D and Y.MM.DD keep their marks and the width of each number."""
    mark, month, day = F.substring(value, 5, 1), F.regexp_extract(value, r"^\d+\D(\d+)", 1), F.regexp_extract(value, r"\d+$", 0)
    start = _day_number(F.substring(value, 1, 4), month, day)
    kind = F.struct(F.length(month).alias("month"), F.length(day).alias("day"))

    def fits(d: Column, k: Column) -> Column:
        return ((F.month(d) < 10) | (k["month"] == 2)) & ((F.dayofmonth(d) < 10) | (k["day"] == 2))

    def written(d: Column, k: Column) -> Column:
        return F.concat(F.year(d).cast("string"), mark, F.lpad(F.month(d).cast("string"), k["month"], "0"), mark, F.lpad(F.dayofmonth(d).cast("string"), k["day"], "0"))

    return F.when(start.isNull(), value).otherwise(_walked_date(key, start, kind, fits, written, back))


def _short_year(key: str, value: Column, back: bool) -> Column:
    """DD.MM.YY, or month first where only that is valid: a day of 1950 to 2049."""
    first, mark, second, short = F.substring(value, 1, 2), F.substring(value, 3, 1), F.substring(value, 4, 2), F.substring(value, 7, 2)
    year = F.concat(F.when(short < "50", "20").otherwise("19"), short)

    def since(month: Column, day: Column) -> Column:
        return F.datediff(F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd"), F.to_date(F.lit(FIRST_SHORT))).cast("long")

    in_order = since(second, first)
    start = F.coalesce(in_order, since(first, second))

    def fits(d: Column, k: Column) -> Column:
        return k["in_order"] | (F.dayofmonth(d) > 12)

    def written(d: Column, k: Column) -> Column:
        m = mark
        return F.when(k["in_order"], F.concat(F.date_format(d, "dd"), m, F.date_format(d, "MM"), m, F.date_format(d, "yy"))).otherwise(F.concat(F.date_format(d, "MM"), m, F.date_format(d, "dd"), m, F.date_format(d, "yy")))

    return F.when(start.isNull(), value).otherwise(_walked_date(key, start, F.struct(in_order.isNotNull().alias("in_order")), fits, written, back, short=True))


def _named_date(key: str, value: Column, back: bool) -> Column:
    """A day with its month's name keeps the language, the order and what stands between.

    A name that several languages have is of the first of them, so the new name has to be of the same first one.
    """
    lists = [names.split() for names in MONTHS.values()]
    listed = F.expr(f"array({', '.join('array(' + ', '.join(map(repr, row)) + ')' for row in lists)})")
    # whether a name is in no list before its own
    own = F.expr(f"array({', '.join('array(' + ', '.join(str(all(n not in x for x in lists[:k])) for n in row) + ')' for k, row in enumerate(lists))})")

    def with_language(p: Column) -> Column:
        at = F.transform(listed, lambda row: F.array_position(row, p["name"]).cast("int"))
        first = F.array_position(F.transform(at, lambda n: n > 0), F.lit(True)).cast("int") - 1
        return let(F.struct(at.alias("at"), first.alias("language")), lambda f: moved(p, f["language"], F.get(f["at"], f["language"])))

    def moved(p: Column, language: Column, month: Column) -> Column:
        start = _day_number(p["year"], month.cast("string"), p["day"])
        kind = F.struct(language.alias("language"), p["day"].startswith("0").alias("zero"))

        def fits(d: Column, k: Column) -> Column:
            return F.get(F.get(own, k["language"]), F.month(d) - 1) & (~k["zero"] | (F.dayofmonth(d) < 10))

        def written(d: Column, k: Column) -> Column:
            name = F.get(F.get(listed, k["language"]), F.month(d) - 1)
            number = F.concat(F.when(k["zero"], "0").otherwise(""), F.dayofmonth(d).cast("string"))
            front, middle = F.when(p["day_first"], number).otherwise(name), F.when(p["day_first"], name).otherwise(number)
            return F.concat(front, p["between"], middle, p["after"], F.year(d).cast("string"))

        return F.when(start.isNull() | (p["day"] == "0") | (p["day"] == "00"), value).otherwise(_walked_date(key, start, kind, fits, written, back))

    def parted(pattern: str, day: int, name: int) -> Column:
        found = {k: F.regexp_extract(value, f"^{pattern}$", i).alias(k) for k, i in (("day", day), ("name", name), ("between", 2), ("after", 4), ("year", 5))}
        return F.struct(F.lit(name == 3).alias("day_first"), *found.values())

    return let(F.when(value.rlike(f"^{DAY_NAMED}$"), parted(DAY_NAMED, 1, 3)).otherwise(parted(MONTH_NAMED, 3, 1)), with_language)


def _mail(key: str, value: Column, back: bool) -> Column:
    """The name and the host are permuted apart; the dots and the top-level domain stay."""
    name, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    top = F.substring_index(host, ".", -1)
    rest = F.substring(host, F.lit(1), F.length(host) - F.length(top))
    return F.concat(permuted_text(key, "mail", name, back=back), F.lit("@"), permuted_text(key, "host", rest, back=back), top)


def pseudonym(key: str, value: Column, back: bool = False) -> Column:
    """What replaces a hit, or with ``back`` what it replaced; the hit itself if it fails the check of its kind."""
    is_address = value.rlike(rf"^{ADDRESS}$")
    octets = F.forall(F.split(value, r"\."), lambda p: p.cast("int") < 256)
    plain = F.forall(F.split(value, r"\."), lambda p: (F.length(p) == 1) | ~p.startswith("0"))
    is_date = value.rlike(rf"^{DATE}$")
    day = F.when(is_date, F.try_to_date(value, "yyyy-MM-dd"))
    return (
        F.when(value.contains("@"), _mail(key, value, back))
        .when(value.rlike(rf"^(?:{IBAN})$") & _is_iban(value), _iban(key, value, back))
        .when(is_address, F.when(octets & plain, _address(key, value, back)).otherwise(value))
        .when(is_date, F.when(day.between(F.to_date(F.lit(FIRST_DAY)), F.to_date(F.lit(LAST_DAY))), _date(key, value, back)).otherwise(value))
        .when(value.rlike(rf"^(?:{WRITTEN})$"), _written_date(key, value, back))
        .when(value.rlike(rf"^(?:{YEAR_FIRST})$"), _year_first(key, value, back))
        .when(value.rlike(rf"^(?:{SHORT_YEAR})$"), _short_year(key, value, back))
        .when(value.rlike(rf"^(?:{NAMED})$"), _named_date(key, value, back))
        .when(value.rlike(rf"^(?:{CARD}|\d{{13,19}})$"), _card(key, value, back))
        .when(value.rlike(rf"^[+(]|^(?:{TRIPLE}|{NATIONAL})$"), _phone(key, value, back))
        .when(value.rlike(rf"^(?:{SECRET})$"), _secret(key, value, back))
        .otherwise(permuted_text(key, "other", value, back=back))
    )


def _ibans(text: Column) -> Column:
    """The valid IBANs of a text as a pattern, empty if there are none; what only looks like one hides nothing."""
    found = F.regexp_extract_all(text, F.lit(rf"{BEFORE_IBAN}(?=[A-Z]{{2}}\d)(?=({IBAN}){AFTER_IBAN})"), F.lit(1))
    return F.when(text.rlike("[A-Z]{2}[0-9]{2}"), F.array_join(F.array_distinct(F.filter(found, _is_iban)), "|")).otherwise("")


def pseudonymized(text: Column, key: str, back: bool = False) -> Column:
    """The text with each valid hit replaced, or with ``back`` put back."""
    # a character that stands for hits, so that a pattern for all rows is compiled once
    gap = "\u0000"

    def cut(ibans: Column) -> Column:
        """All hits in order, and what stands between them.  Only where there are IBANs the pattern is the row's own."""
        own = F.concat(F.lit(f"{BEFORE_IBAN}(?:"), ibans, F.lit(f"){AFTER_IBAN}|{HIT}"))
        found = F.when(ibans == "", F.regexp_extract_all(text, F.lit(HIT), F.lit(0))).otherwise(F.regexp_extract_all(text, own, F.lit(0)))
        gaps = F.when(F.contains(text, F.lit(gap)), F.split(text, F.when(ibans == "", HIT).otherwise(own), -1)).otherwise(
            F.split(F.when(ibans == "", F.regexp_replace(text, HIT, gap)).otherwise(F.regexp_replace(text, own, F.lit(gap))), gap, -1)
        )
        return let(found, lambda found: F.when(F.size(found) == 0, text).otherwise(woven(found, gaps)))

    def woven(found: Column, gaps: Column) -> Column:
        new = F.transform(found, lambda v: pseudonym(key, v, back))
        return F.array_join(F.flatten(F.zip_with(gaps, new, lambda gap, value: F.array(gap, F.coalesce(value, F.lit(""))))), "")

    # every kind has a digit, an @ or a known prefix
    return F.when(text.rlike(f"[0-9@]|{PREFIX}"), let(_ibans(text), cut)).otherwise(text)


def pseudonymize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with the text column replaced; no shuffle.

    ``key`` is secret in production; it ends up in the plan, so keep query plans
    as safe as the key.
    """
    return docs.withColumn(text, pseudonymized(F.col(text), key))


def restore(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The original texts of ``pseudonymize``d ones."""
    return docs.withColumn(text, pseudonymized(F.col(text), key, back=True))
