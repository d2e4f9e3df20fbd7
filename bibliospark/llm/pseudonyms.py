"""PII pseudonyms by keyed Feistel permutations within the format of a value. Column expressions only.

Found: e-mail addresses, IPv4 addresses, dates, social security numbers, IBANs, phone and card numbers; numbers and
dates only when they are valid (calendar day, number ranges, mod-97 and Luhn check digits). A value's letters and digits
are cut in two halves that are shifted in turn by a keyed hash of the other half - letters among letters, digits among
digits - or, where the valid values are a range, the value's number is split by mixed radix and permuted the same
way. Check digits are computed anew. Both are permutations, so different values stay different, and the same value
gets the same pseudonym in every document, however it is punctuated and, in e-mail addresses and IBANs, capitalised. A
phone's country code stays; a number without one is taken as a national number, a trunk zero is a digit of its own.

A number, an expiry date or a word beside a value does not hide it: a run of digit groups is searched for the cards in
it (any sub-run of 13 to 19 digits between group borders with right check digits, usual groupings first, then longer
ones), IBANs have the length of their country, phones of +1 and +7 eleven digits. Phones of other countries have no known
length and take a number of two to four digits that follows. The key stands in the plan as a value: plans and event logs
are as secret as the key.

Defined cases: null text stays null; empty text and invalid numbers stay as they are; repeated rows get equal
results; e-mail domains, country codes and the first digit of cards are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh

ROUNDS = 8
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: IBAN lengths by country.
_LENGTHS = {15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL",
            24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU"}
_COUNTRIES = "|".join(_LENGTHS.values())
_IBANS = "|".join(rf"(?:{names})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, names in _LENGTHS.items())
# Country codes of two digits; those of 1 and 7 have one digit, others three.
TWO_DIGIT_CODES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: A run of digit groups ends before a group that begins a date, an address or a number with points.
_NEXT = r"[./][0-9]{1,2}[./][0-9]{4}|(?:\.[0-9]{1,3}){3}|\.[0-9]{3}[.-][0-9]{4}|[A-Za-z0-9._%+-]*+@[A-Za-z0-9]"
#: Not after more than 15 digits of a phone (Java asks for a pattern whose longest match is plain to see).
_LONG = "".join(rf"(?<!\+{'[ .()-]{0,2}[0-9]' * n})" for n in range(16, 24))
#: Candidates by kind; the first that matches at a place is taken.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": rf"(?<![A-Za-z0-9])(?:(?i:{_IBANS})|[A-Z]{{2}}[0-9]{{2}}(?:(?: (?!(?:{_COUNTRIES})[0-9]{{2}}))?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9]))",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "iso_date": r"(?<![0-9./-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9]|[./-][0-9])",
    "date": r"(?<![0-9./-])[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4}(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9+])(?:\+[17](?:[ .()-]{0,2}[0-9]){10}|\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}" + _LONG + r"|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9]|[.-][0-9])",
    "card": rf"(?<![0-9])[0-9](?:[ -]?[0-9]){{12}}[0-9 -]*(?<=[0-9])(?![0-9]|{_NEXT})",
}
ANY = "|".join(PATTERNS.values())
#: What may stand between the cards of a run of digit groups; a card, and its usual groupings.
INNER = "|".join([PATTERNS["iso_date"], PATTERNS["ssn"], r"(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9]|[.-][0-9])"])
CARD, MOST_CARD = r"^[0-9](?:[ -]?[0-9]){12,18}$", 37
USUAL = r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{1,3})?|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5})$"
#: Days of a 400-year cycle from its first day on, as a product, and those of them that are a 13th or later; areas and
#: groups of social security numbers, and serials.
FIRST_DAY, DAYS, LATE_DAYS, AREAS, SERIALS = "1800-01-01", (189, 773), (9, 9833), 898 * 99, 9999


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value evaluated once: within a lambda it would be evaluated again for each element."""
    return F.transform(F.array(value), body)[0]


def _hash(key: str, kind: str, turn: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), half).cast("binary"), 256)


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _shifted(text: Column, hashed: Column) -> Column:
    """Each letter or digit moved among its kind by a byte of the hash."""

    def moved(c: Column, i: Column) -> Column:
        k = F.conv(F.substr(hashed, i % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int")
        among = lambda first, n: F.char((F.ascii(c) - first + k) % n + first)
        return F.when(c.between("0", "9"), among(48, 10)).when(c.between("a", "z"), among(97, 26)).otherwise(among(65, 26))

    return F.array_join(F.transform(_letters(text), moved), "")


def permuted_text(text: Column, key: str, kind: str) -> Column:
    """A Feistel permutation of strings of letters and digits that keeps what each place is."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1, F.length(text)).alias("r"))

    def turn(s: Column, i: Column) -> Column:
        left = F.struct(_shifted(s["l"], _hash(key, kind, i, s["r"])).alias("l"), s["r"].alias("r"))
        right = F.struct(s["l"].alias("l"), _shifted(s["r"], _hash(key, kind, i, s["l"])).alias("r"))
        return F.when(i % 2 == 0, left).otherwise(right)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["l"], s["r"]))


def permuted_number(x: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A Feistel permutation of 0 <= x < a * b: the quotient and the rest by b, moved in turn."""
    start = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).cast("long").alias("r"))

    def moved(value: Column, n: int, turn: Column, other: Column) -> Column:
        k = F.conv(F.substring(_hash(key, kind, turn, other.cast("string")), 1, 15), 16, 10).cast("long")
        return ((value + k % n) % n).cast("long")

    def turn(s: Column, i: Column) -> Column:
        left = F.struct(moved(s["l"], a, i, s["r"]).alias("l"), s["r"].alias("r"))
        right = F.struct(s["l"].alias("l"), moved(s["r"], b, i, s["l"]).alias("r"))
        return F.when(i % 2 == 0, left).otherwise(right)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: (s["l"] * b + s["r"]).cast("long"))


def _only(text: Column, kept: str) -> Column:
    return F.regexp_replace(text, f"[^{kept}]", "")


def _put(form: Column, kept: str, values: Column) -> Column:
    """The form with its letters and digits replaced, in order, by the values."""

    def put(form: Column, values: Column) -> Column:
        nth = lambda i: F.length(_only(F.substr(form, F.lit(1), i + 1), kept))
        return F.array_join(F.transform(_letters(form), lambda c, i: F.when(c.rlike(f"[{kept}]"), F.substr(values, nth(i), F.lit(1))).otherwise(c)), "")

    return _let(F.struct(form.alias("form"), values.alias("values")), lambda x: put(x["form"], x["values"]))


def _luhn(digits: Column) -> Column:
    """Sum of the Luhn rule for digits that a check digit follows."""

    def total(digits: Column) -> Column:
        def part(c: Column, i: Column) -> Column:
            d = c.cast("int")
            twice = (F.length(digits) - i) % 2 == 1
            return F.when(twice & (d > 4), d * 2 - 9).when(twice, d * 2).otherwise(d)

        return F.aggregate(F.transform(_letters(digits), part), F.lit(0), lambda s, x: s + x)

    return _let(digits, total)


def _mod97(text: Column) -> Column:
    """The rest by 97 of digits and capitals (A is 10)."""

    def part(s: Column, c: Column) -> Column:
        v = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.when(v < 10, (s * 10 + v) % 97).otherwise((s * 100 + v) % 97)

    return F.aggregate(_letters(text), F.lit(0), part)


def _is_card(digits: Column) -> Column:
    """Whether digits, not all of them 0, end in the check digit of those before."""
    n = F.length(digits)
    return ((_luhn(F.substr(digits, F.lit(1), n - 1)) + F.substr(digits, n, F.lit(1)).cast("int")) % 10 == 0) & digits.rlike("[1-9]")


def _card(m: Column, key: str) -> Column:
    """Of digits that are a card's: the first stays, the check digit is computed anew."""

    def made(digits: Column) -> Column:
        new = F.concat(F.substring(digits, 1, 1), permuted_text(F.substr(digits, F.lit(2), F.length(digits) - 2), key, "card"))
        return _let(new, lambda x: F.concat(x, ((F.lit(10) - _luhn(x) % 10) % 10).cast("string")))

    return _put(m, "0-9", _let(_only(m, "0-9"), made))


def _phone(m: Column, key: str) -> Column:
    """The country code stays; the national number is permuted as digits, so that its punctuation does not matter."""
    code = lambda digits: F.when(~F.startswith(m, F.lit("+")), 0).when(digits.rlike("^[17]"), 1).when(F.substring(digits, 1, 2).isin(*TWO_DIGIT_CODES), 2).otherwise(3)
    made = lambda digits: F.concat(F.substr(digits, F.lit(1), code(digits)), permuted_text(F.substr(digits, code(digits) + 1, F.length(digits)), key, "phone"))
    digits = _only(m, "0-9")
    return F.when(F.length(digits).between(8, 15), _put(m, "0-9", _let(digits, made)))


def _cased(new: Column, form: Column) -> Column:
    """The text with the form's capitals and small letters."""
    return F.array_join(F.zip_with(_letters(new), _letters(form), lambda n, c: F.when(c.between("a", "z"), F.lower(n)).when(c.between("A", "Z"), F.upper(n)).otherwise(n)), "")


def _email(m: Column, key: str) -> Column:
    """The local part is permuted in small letters and gets its capitals back."""
    local = F.substring_index(m, "@", 1)
    new = _put(F.lower(local), "a-z0-9", permuted_text(_only(F.lower(local), "a-z0-9"), key, "email"))
    return F.concat(_cased(new, local), F.substr(m, F.length(local) + 1, F.length(m)))


def _iban(m: Column, key: str) -> Column:
    plain = _only(F.upper(m), "A-Z0-9")
    country = F.substring(plain, 1, 2)
    body = F.substr(plain, F.lit(5), F.length(plain))
    valid = (_mod97(F.concat(body, F.substring(plain, 1, 4))) == 1) & F.length(plain).between(15, 34)
    check = lambda new: F.lpad((F.lit(98) - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    whole = _let(permuted_text(body, key, "iban"), lambda new: F.concat(country, check(new), new))
    return F.when(valid, _cased(_put(F.upper(m), "A-Z0-9", whole), m))


def _ip(m: Column, key: str) -> Column:
    x = F.aggregate(F.split(m, r"\."), F.lit(0).cast("long"), lambda s, o: s * 256 + o.cast("long"))
    y = permuted_number(x, 65536, 65536, key, "ip")
    return _let(y, lambda y: F.concat_ws(".", *[(F.shiftright(y, s) % 256).cast("string") for s in (24, 16, 8, 0)]))


def _new_day(day: Column, key: str) -> Column:
    x = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
    new = F.date_add(F.lit(FIRST_DAY).cast("date"), permuted_number(x, *DAYS, key, "date").cast("int"))
    return F.when(x.between(0, DAYS[0] * DAYS[1] - 1), new)


def _new_late_day(day: Column, key: str) -> Column:
    """The same among the days from the 13th of a month on: what is written month first stays what only that order reads."""
    first = F.lit(FIRST_DAY).cast("date")
    month = lambda m: F.add_months(first, m)
    before = lambda m: F.datediff(month(m), first) - 12 * m  # noqa: E731 - late days before the month m of the cycle
    x = (F.datediff(day, first) - 12 * ((F.year(day) - 1800) * 12 + F.month(day))).cast("long")

    def placed(y: Column) -> Column:
        near = F.floor(y * 4800 / (LATE_DAYS[0] * LATE_DAYS[1])).cast("int")
        own = F.array_max(F.filter(F.transform(F.sequence(F.lit(-3), F.lit(3)), lambda i: near + i), lambda m: (m >= 0) & (before(m) <= y)))
        return _let(own, lambda m: F.date_add(month(m), (y - before(m)).cast("int") + 12))

    return F.when(x.between(0, LATE_DAYS[0] * LATE_DAYS[1] - 1), _let(permuted_number(x, *LATE_DAYS, key, "late date"), placed))


def _iso_date(m: Column, key: str) -> Column:
    return F.date_format(_new_day(F.try_to_date(m, "yyyy-MM-dd"), key), "yyyy-MM-dd")


def _date(m: Column, key: str) -> Column:
    """Day first where it can be one, month first else; both parts keep two digits unless one was given.

    Dates that are month first, as the second part is no month, are permuted among themselves.
    """
    parts, mark = F.split(m, "[./]"), F.regexp_extract(m, "[./]", 0)
    a, b, year = parts[0], parts[1], parts[2]
    day_first = b.cast("int") <= 12
    iso = F.concat_ws("-", year, F.lpad(F.when(day_first, b).otherwise(a), 2, "0"), F.lpad(F.when(day_first, a).otherwise(b), 2, "0"))
    padded = (F.length(a) == 2) & (F.length(b) == 2)

    def written(new: Column) -> Column:
        day = F.when(padded, F.date_format(new, "dd")).otherwise(F.dayofmonth(new).cast("string"))
        month = F.when(padded, F.date_format(new, "MM")).otherwise(F.month(new).cast("string"))
        return F.when(new.isNotNull(), F.concat(F.when(day_first, day).otherwise(month), mark, F.when(day_first, month).otherwise(day), mark, F.date_format(new, "yyyy")))

    given = F.try_to_date(iso, "yyyy-MM-dd")
    return _let(F.when(day_first, _new_day(given, key)).otherwise(_new_late_day(given, key)), written)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = area - F.when(area > 666, 2).otherwise(1)
    y = permuted_number((index * 99 + group - 1) * SERIALS + serial - 1, AREAS, SERIALS, key, "ssn")

    def written(y: Column) -> Column:
        high = F.floor(y / SERIALS)
        i = F.floor(high / 99) + 1
        i = i + F.when(i > 665, 1).otherwise(0)
        return F.concat_ws("-", F.lpad(i.cast("string"), 3, "0"), F.lpad((high % 99 + 1).cast("string"), 2, "0"), F.lpad((y % SERIALS + 1).cast("string"), 4, "0"))

    return F.when(valid, _let(y, written))


_MAKERS = {"email": _email, "iban": _iban, "ip": _ip, "iso_date": _iso_date, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def _kind(m: Column) -> Column:
    """What a candidate is, told by its form."""
    forms = {"email": "@", "iban": "^[A-Za-z]{2}[0-9]", "ip": r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$", "iso_date": "^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
             "date": r"^[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}$", "ssn": "^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
             "phone": r"^(\+.*|\([0-9]{3}\).*|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})$"}
    out = F
    for kind, form in forms.items():
        out = out.when(m.rlike(form), F.lit(kind))
    return out.otherwise(F.lit("card"))


def replaced(candidate: Column, key: str, kinds: tuple[str, ...] = tuple(_MAKERS)) -> Column:
    """The pseudonym of a candidate, null where it is not valid."""
    kind = _kind(candidate)
    out = F
    for name in kinds:
        out = out.when(kind == name, _MAKERS[name](candidate, key))
    return out


_PIECE = "struct<kind:string,new:string,old:string>"


def _piece(kind: Column, new: Column, old: Column) -> Column:
    return F.struct(kind.alias("kind"), new.alias("new"), old.alias("old")).cast(_PIECE)


def _plain(text: Column) -> Column:
    return _piece(F.lit(None), F.lit(None), text)


def _cards(text: Column, key: str) -> Column:
    """The pieces of a run of digit groups: its cards and what is between them."""
    spans = "array<struct<s:int,e:int>>"
    groups = F.filter(F.split(text, "(?<=[0-9])(?![0-9])|(?<![0-9])(?=[0-9])"), lambda g: g != "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("out"))

    def place(a: Column, g: Column) -> Column:
        end = a["at"] + F.length(g)
        here = F.struct(a["at"].alias("s"), end.alias("e"))
        return F.struct(end.alias("at"), F.when(g.rlike("^[0-9]"), F.concat(a["out"], F.array(here))).otherwise(a["out"]).alias("out"))

    places = F.aggregate(groups, start, place, lambda a: a["out"])

    def runs(p: Column, ps: Column, i: Column) -> Column:
        near = F.substr(text, p["s"] + 1, F.lit(MOST_CARD))  # looked up once: places of a text are counted from its beginning
        texts = _let(near, lambda x: F.transform(F.slice(ps, i + 1, 19), lambda q: F.struct(p["s"].alias("s"), q["e"].alias("e"), F.substr(x, F.lit(1), q["e"] - p["s"]).alias("old"))))
        fit = F.filter(texts, lambda r: (r["e"] - r["s"] <= MOST_CARD) & r["old"].rlike(CARD))
        cards = F.filter(fit, lambda r: _let(_only(r["old"], "0-9"), _is_card))
        return F.transform(cards, lambda r: F.struct(F.when(r["old"].rlike(USUAL), 0).otherwise(1).alias("odd"), (-F.length(_only(r["old"], "0-9"))).alias("digits"), r["s"].alias("s"), r["e"].alias("e")))

    found = F.flatten(F.transform(F.array(places), lambda ps: F.flatten(F.transform(ps, lambda p, i: runs(p, ps, i)))))
    none = F.array().cast(spans)

    def pick(a: Column, r: Column) -> Column:
        one = F.array(F.struct(r["s"].alias("s"), r["e"].alias("e")))
        return F.when(F.exists(a, lambda x: (x["s"] < r["e"]) & (r["s"] < x["e"])), a).otherwise(F.concat(a, one))

    picked = F.array_sort(F.aggregate(F.array_sort(found), none, pick))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_PIECE}>").alias("out"))

    def put(a: Column, r: Column) -> Column:
        gap, old = _plain(F.substr(text, a["at"] + 1, r["s"] - a["at"])), F.substr(text, r["s"] + 1, r["e"] - r["s"])
        return F.struct(r["e"].alias("at"), F.concat(a["out"], F.array(gap, _piece(F.lit("card"), _card(old, key), old))).alias("out"))

    return F.aggregate(picked, begin, put, lambda a: F.concat(a["out"], F.array(_plain(F.substr(text, a["at"] + 1, F.length(text))))))


def pieces(m: Column, key: str) -> Column:
    """A candidate as an array of pieces: values with their pseudonyms and what is between them."""
    whole = F.array(_piece(_kind(m), replaced(m, key, tuple(k for k in _MAKERS if k not in ("iban", "card"))), m))
    inner = lambda x: F.when(x.isNotNull(), F.array(_piece(_kind(x), replaced(x, key, ("iso_date", "ssn", "phone")), x))).otherwise(F.array().cast(f"array<{_PIECE}>"))
    cards = F.flatten(F.zip_with(F.split(m, INNER, -1), F.regexp_extract_all(m, F.lit(INNER), F.lit(0)), lambda part, x: F.concat(_cards(part, key), inner(x))))
    # an IBAN of no known country may have taken words that follow
    cuts = F.array(m, F.regexp_replace(m, " [A-Z0-9]+$", ""), F.regexp_replace(m, " [A-Z0-9]+ [A-Z0-9]+$", ""))
    iban = F.get(F.filter(F.transform(cuts, lambda c: _piece(F.lit("iban"), _iban(c, key), c)), lambda c: c["new"].isNotNull()), F.lit(0))
    ibans = F.transform(F.array(iban), lambda c: F.when(c.isNotNull(), F.array(c, _plain(F.substr(m, F.length(c["old"]) + 1, F.length(m))))).otherwise(F.array(_plain(m))))[0]
    kind = _kind(m)  # what is no IBAN may hold cards
    return F.when((kind == "iban") & iban.isNotNull(), ibans).when(kind.isin("iban", "card"), cards).otherwise(whole)


def pseudonymise(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """The documents' columns, ``text`` with pseudonyms, and pii_found: an array of (kind, pseudonym) in order.

    A column named pii_found is replaced.
    """
    candidates, made_ = fresh(docs, "_candidates", "_made")
    text = F.col(column).cast("string")
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    held = docs.withColumn(candidates, found)
    made = F.transform(candidates, lambda m: pieces(m, key))
    held = held.withColumn(made_, made)
    joined = F.array_join(F.zip_with(F.split(text, ANY, -1), F.col(made_), lambda part, ps: F.concat(part, F.coalesce(F.array_join(F.transform(ps, lambda m: F.coalesce(m["new"], m["old"])), ""), F.lit("")))), "")
    valid = F.transform(F.filter(F.coalesce(F.flatten(made_), F.array().cast(f"array<{_PIECE}>")), lambda m: m["new"].isNotNull()), lambda m: F.struct(m["kind"].alias("kind"), m["new"].alias("pseudonym")))
    return held.withColumn("pii_found", valid).withColumn(column, F.when(F.size("pii_found") > 0, joined).otherwise(text)).drop(candidates, made_)
