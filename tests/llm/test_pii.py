"""Pseudonyms against an implementation in plain Python that shares only the patterns, and back again."""

import datetime
import hashlib
import random
import re

import pytest
import regex

from skerry.llm import pii, queries

LONG = [
    "sk-" + "a7B" * 55, "key sk-proj-" + "Zz9_" * 45 + " end", "mail " + "n" * 65 + "@example.org.", "id 12345678901234567890", "id " + "9" * 40,
    "AKIA" + "Q2" * 8, "ghp_" + "x" * 36, "x" * 40 + "1" + "Y" * 200, "0123456789abcdef" * 20, "F0" * 16, "g" + "1" * 31, "1" * 31 + "h", "0x" + "ab12" * 8,
    "..dots.first@mail.example.co.uk, _u@a.de", "0111 1111 1111 1111 and 0171 1234 56789", "4111 1111 1111 1111 123", "4222 2222 2222 2222 003", "ssn 123-45-6789",
]


def pad(key, label, half):
    return hashlib.sha256(f"{key}|{label}|{half}".encode()).digest()


def characters(key, label, value, alphabet=None):
    size = len(value) // 2
    halves = [value[:size], value[size:]]
    for r in range(6):
        by, out = pad(key, f"{label}:{r}", halves[1 - r % 2]), []
        for i, c in enumerate(halves[r % 2]):
            wide = next((map(chr, range(a, a + n)) for a, n in pii.LETTERS if a <= ord(c) < a + n), c)
            ring = alphabet or next((x for x in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c in x), "".join(wide))
            out.append(ring[(ring.index(c) + by[i % 32]) % len(ring)])
        halves[r % 2] = "".join(out)
    return "".join(halves)


def grid(key, label, value, rows, columns, only=None):
    a, b = divmod(value, columns)
    for r in range(6):
        if r % 2 == 0:
            a = (a + int.from_bytes(pad(key, f"{label}:{r}", b)[:6], "big")) % rows
        else:
            b = (b + int.from_bytes(pad(key, f"{label}:{r}", a)[:6], "big")) % columns
    return a * columns + b


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10


def mod97(plain):
    return int("".join(str(int(c, 36)) for c in plain)) % 97


def is_iban(value):
    plain = re.sub("[^A-Z0-9]", "", value)
    return mod97(plain[4:] + plain[:4]) == 1


def number(key, value):
    digits = re.sub("[^0-9]", "", value)
    body, off = digits[:-1], (luhn(digits[:-1] + "0") + int(digits[-1])) % 10
    new = characters(key, "card", body)
    new = iter(new + str((off - luhn(new + "0")) % 10))
    return "".join(next(new) if c.isdigit() else c for c in value)


def card(key, value):
    def apart(v):
        digits = re.sub("[^0-9]", "", v)
        return luhn(digits) != 0 or luhn(digits[:16]) == 0

    if len(value) != 23 or not re.match(pii.FOURS, value):
        return number(key, value)
    new, kind = value, apart(value)
    while True:
        new = number(key, new[:19]) + new[19:] if kind else number(key, new)
        if apart(new) == kind:
            return new


def secret(key, value):
    def kind(v):
        if v.isdigit():
            return "digits"
        if len(v) > 31 and re.search("[0-9]", v) and re.fullmatch("[0-9a-f]+|[0-9A-F]+", v):
            return "hex" if re.search("[a-f]", v) else "HEX"
        return "iban" if re.fullmatch(pii.IBAN, v) and is_iban(v) else "other " + (re.match(f"(?:{pii.PREFIX})?", v)[0])

    new, own, front = value, kind(value), re.match(f"(?:{pii.PREFIX})?", value)[0]
    while True:
        if own.lower() == "hex":
            new = characters(key, "hex", new, "0123456789abcdef" if own == "hex" else "0123456789ABCDEF")
        else:
            new = front + characters(key, "other", new[len(front) :])
        if kind(new) == own:
            return new


FIRST, LAST = datetime.date(1800, 1, 1), datetime.date(2199, 12, 31)


def a_date(y, m, d):
    try:
        return datetime.date(int(y), int(m), int(d))
    except ValueError:
        return None


def written(key, value):
    a, mark, b, y = re.fullmatch(r"(\d+)(\D)(\d+)\D(\d+)", value).groups()
    in_range = lambda d: d is not None and FIRST <= d <= LAST
    in_order = in_range(a_date(y, b, a))
    day = a_date(y, b, a) if in_order else a_date(y, a, b)
    if not in_range(day):
        return value
    at = (day - FIRST).days
    while True:
        at = grid(key, "date", at, 189, 773)
        new = FIRST + datetime.timedelta(at)
        x, z = (new.day, new.month) if in_order else (new.month, new.day)
        if len(str(x)) <= len(a) and len(str(z)) <= len(b) and (in_order or z > 12):
            return f"{x:0{len(a)}}{mark}{z:0{len(b)}}{mark}{new.year}"


def other_date(key, value):
    """Year first, two digits for the year, or a month's name."""
    months = {k: v.split() for k, v in pii.MONTHS.items()}
    first, size, label, ok = FIRST, (189, 773), "date", lambda d: True
    if m := re.fullmatch(r"(\d{4})(\D)(\d+)(\D)(\d+)", value):
        day, w, z = a_date(m[1], m[3], m[5]), len(m[3]), len(m[5])
        ok, put = (lambda d: len(str(d.month)) <= w and len(str(d.day)) <= z), (lambda d: f"{d.year}{m[2]}{d.month:0{w}}{m[4]}{d.day:0{z}}")
    elif m := re.fullmatch(r"(\d\d)(\D)(\d\d)\D(\d\d)", value):
        first, size, label = datetime.date(1950, 1, 1), (75, 487), "short"
        year = int(m[4]) + (2000 if m[4] < "50" else 1900)
        in_order = a_date(year, m[3], m[1]) is not None
        day = a_date(year, m[3], m[1]) or a_date(year, m[1], m[3])
        ok, put = (lambda d: in_order or d.day > 12), (lambda d: d.strftime(f"%d{m[2]}%m{m[2]}%y" if in_order else f"%m{m[2]}%d{m[2]}%y"))
    else:
        m = re.fullmatch(pii.DAY_NAMED, value)
        n, name, y, front = (m[1], m[3], m[5], True) if m else (lambda m: (m[3], m[1], m[5], False))(m := re.fullmatch(pii.MONTH_NAMED, value))
        lists = list(months.values())
        mine = next(i for i, x in enumerate(lists) if name in x)
        day = a_date(y, lists[mine].index(name) + 1, n)
        ok = lambda d: all(lists[mine][d.month - 1] not in x for x in lists[:mine]) and (n[0] != "0" or d.day < 10)
        number = lambda d: ("0" if n[0] == "0" else "") + str(d.day)
        put = (lambda d: f"{number(d)}{m[2]}{lists[mine][d.month - 1]}{m[4]}{d.year}") if front else (lambda d: f"{lists[mine][d.month - 1]}{m[2]}{number(d)}{m[4]}{d.year}")
    if day is None or not FIRST <= day <= LAST:
        return value
    while True:
        day = first + datetime.timedelta(grid(key, label, (day - first).days, *size))
        if ok(day):
            return put(day)


def one(key, value):
    if "@" in value:
        name, host = value.split("@")
        rest, top = host[: host.rindex(".") + 1], host[host.rindex(".") + 1 :]
        return f"{characters(key, 'mail', name)}@{characters(key, 'host', rest)}{top}"
    if re.fullmatch(pii.IBAN, value) and is_iban(value):
        new = characters(key, "iban", value[4:])
        return f"{value[:2]}{98 - mod97(re.sub('[^A-Z0-9]', '', new) + value[:2] + '00'):02}{new}"
    if re.fullmatch(pii.ADDRESS, value):
        parts = value.split(".")
        if any(int(p) > 255 or p != str(int(p)) for p in parts):
            return value
        new = grid(key, "address", int.from_bytes(bytes(map(int, parts)), "big"), 65536, 65536)
        return ".".join(map(str, new.to_bytes(4, "big")))
    if re.fullmatch(pii.DATE, value):
        day = a_date(*value.split("-"))
        return (FIRST + datetime.timedelta(grid(key, "date", (day - FIRST).days, 189, 773))).isoformat() if day and FIRST <= day <= LAST else value
    if re.fullmatch(pii.WRITTEN, value):
        return written(key, value)
    if re.fullmatch(f"{pii.YEAR_FIRST}|{pii.SHORT_YEAR}|{pii.NAMED}", value):
        return other_date(key, value)
    if re.fullmatch(rf"{pii.CARD}|\d{{13,19}}", value):
        return card(key, value)
    if re.match(r"[+(]", value) or re.fullmatch(f"{pii.TRIPLE}|{pii.NATIONAL}", value):
        front = re.match(r"\+\d{1,3}(?=[ .\-(])|0(?!\d\d[ .\-]\d{3}[ .\-]\d{4}$)|", value)[0]
        return front + characters(key, "phone", value[len(front) :])
    if re.fullmatch(pii.SECRET, value):
        return secret(key, value)
    return characters(key, "other", value)


def whole(key, text):
    if text is None:
        return None
    found = re.finditer(rf"{pii.BEFORE_IBAN}(?=[A-Z]{{2}}\d)(?=({pii.IBAN}){pii.AFTER_IBAN})", text, re.A)
    valid = "|".join(m[1] for m in found if is_iban(m[1]))
    pattern = f"{pii.BEFORE_IBAN}(?:{valid}){pii.AFTER_IBAN}|{pii.HIT}" if valid else pii.HIT
    return regex.sub(ascii_classes(pattern), lambda m: one(key, m[0]), text)


def ascii_classes(pattern):
    """``\\d`` and ``\\w`` as Spark has them, ASCII only, beside classes of all scripts."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in (r"\d", r"\w"):
            plain = "0-9" if two == r"\d" else "A-Za-z0-9_"
            out.append(plain if inside else f"[{plain}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = (inside or two[0] == "[") and two[0] != "]"
            out.append(two[0])
        i += 2 if two[0] == "\\" else 1
    return "".join(out)


def test_query_agrees_with_plain_python_and_is_restored(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    new = queries.op10_pii(spark, sf_dir)
    got = {r.doc_id: r.text for r in new.collect()}
    assert got == {i: whole(queries.PII_KEY, t) for i, t in docs.items()}
    assert sum(got[i] != docs[i] for i in docs) > 5
    assert {r.doc_id: r.text for r in pii.restore(new, queries.PII_KEY).collect()} == docs


def test_long_and_odd_values_agree_and_are_restored(spark):
    rng = random.Random(1)
    texts = LONG + [f"x {''.join(rng.choice('0123456789') for _ in range(n))} y" for n in range(9, 45)]
    texts += [f"{rng.choice(['', '0'])}{rng.randrange(10**4):04d} {rng.randrange(10**4):04d} {rng.randrange(10**4):04d} {rng.randrange(10**4):04d} {rng.randrange(1000):03d}" for _ in range(60)]
    texts += ["".join(rng.choice("abcdefg0123456789") for _ in range(33)) for _ in range(40)] + [f"on {d}.{m}.1984, {m:02}/{d + 12}/1975" for d in (1, 9, 17) for m in (2, 11)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    new = pii.pseudonymize(rows, "k")
    got = [r.text for r in sorted(new.collect())]
    assert got == [whole("k", t) for t in texts]
    assert [r.text for r in sorted(pii.restore(new, "k").collect())] == texts
    for text, changed in zip(LONG, got, strict=False):
        runs = re.findall("[A-Za-z0-9]{16,}", text)
        assert not any(run[4:] in changed for run in runs if not run.startswith("0x"))


@pytest.mark.parametrize("size", [5_000])
def test_very_long_repeated_and_empty(spark, size):
    text = "word 1234567890 " * (size // 16) + "a1" * size + " " + "m" * size + "@mail.com"
    rows = spark.createDataFrame([(text, 1), (text, 1), ("", 2)], "text string, found int")
    got = pii.pseudonymize(rows, "k").collect()
    assert got[0] == got[1] and got[2].text == "" and got[0].text == whole("k", text)
    assert pii.pseudonymize(rows.where("false"), "k").count() == 0


LISTED = [
    "id-4111111111111111", "acct_4111111111111111", "card4111111111111111x", "4111.1111.1111.1111", "no 4111-1111-1111-1111.",
    "José.García@example.com", "иван.петров@почта.рф", "山田太郎@例え.jp", "born 1984/12/31", "born 1984/5/1, 1984.05.01", "on 31.12.84 and 12/31/84", "12 March 1984",
    "March 12, 1984", "12. März 1984", "le 05 février 1984", "12 de marzo de 1984", "Aug 3, 1999", "May 5 1984", "3rd of June 1950", "31 décembre 2199",
]


def test_values_beside_letters_in_other_scripts_and_other_dates(spark):
    docs = spark.createDataFrame(list(enumerate(LISTED)), "doc_id long, text string")
    new = pii.pseudonymize(docs, "k").cache()
    got = {r.doc_id: r.text for r in new.collect()}
    back = {r.doc_id: r.text for r in pii.restore(new, "k").collect()}
    for i, text in enumerate(LISTED):
        assert got[i] != text and got[i] == whole("k", text), text
        assert back[i] == text, (text, got[i])
    assert re.fullmatch(r"id-\d{16}", got[0]) and luhn(got[0][3:]) == 0 and luhn(re.sub(r"\D", "", got[3])) == 0
    assert not set(re.split(r"\W", got[5])) & {"José", "García", "example"} and re.fullmatch(r"\w{4}\.\w{6}@\w{7}\.com", got[5])
    assert got[6].endswith(".рф") and "иван" not in got[6] and "山田" not in got[7]
    assert re.fullmatch(r"born \d{4}/\d\d/\d\d", got[8]) and re.fullmatch(r"on \d\d\.\d\d\.\d\d and \d\d/\d\d/\d\d", got[10])
    assert re.fullmatch(r"\d{1,2}\. (Januar|Februar|März|Mai|Juni|Juli|Oktober|Dezember) \d{4}", got[13]), got[13]
    assert re.fullmatch(r"\d{1,2} de [a-z]+ de \d{4}", got[15]) and re.fullmatch(r"le 0\d [a-zéû]+ \d{4}", got[14])


def test_named_and_short_dates_are_permuted(spark):
    """Different days get different pseudonyms of the same kind, and all come back."""
    import datetime

    days = [datetime.date(1950, 1, 1) + datetime.timedelta(11 * i) for i in range(3000)]
    months = {k: v.split() for k, v in pii.MONTHS.items()}
    rows = []
    for d in days:
        rows += [d.strftime("%d.%m.%y"), f"{d.year}/{d.month}/{d.day}"]
        rows += [f"{d.day} {months[k][d.month - 1]} {d.year}" for k in ("English", "German", "French", "Spanish")]
        rows += [f"{months['short'][d.month - 1]} {d.day:02d}, {d.year}"]
    rows = list(dict.fromkeys(rows))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(8)
    new = pii.pseudonymize(docs, "k").cache()
    got = {r.doc_id: r.text for r in new.collect()}
    assert {r.doc_id: r.text for r in pii.restore(new, "k").collect()} == dict(enumerate(rows))
    assert len(set(got.values())) == len(rows) and sum(got[i] == t for i, t in enumerate(rows)) < 10
    shape = lambda t: re.sub(r"[A-Za-zéûä]+", "x", re.sub(r"\d+", "9", t))
    assert all(shape(got[i]) == shape(t) for i, t in enumerate(rows))


def test_numbers_and_dates_that_are_none_stay(spark):
    texts = ["31.02.84", "32 March 1984", "0 May 1984", "1984/13/01", "a1234567890b", "version 12.34.56", "March of 1984", "x-123456789"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.pseudonymize(docs, "k").collect()} == dict(enumerate(texts))
