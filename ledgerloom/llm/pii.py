"""PII: format-preserving Feistel pseudonyms, in SQL expressions only.

One pattern finds candidates: e-mail addresses, long hexadecimal secrets, IBANs, IPv4
addresses, dates, phone numbers, US social security numbers and payment card numbers.
Each is validated (Luhn, mod 97, real dates, octets up to 255); what isn't valid stays
as it is. Cards and IBANs that stand beside other digits or words (expiry, CVV, BIC) are
looked for within their run: prefixes at its groups, the longest first, and parts that
are laid out like a card. Valid numbers and dates go through a keyed Feistel network whose domain is
their own format, so the result is again valid and of the same layout, different
values stay different, and equal values get equal pseudonyms in all documents:

* digit strings: halves L, R; (L, R) <- (R, L + f(R) mod 10^|L|), ROUNDS times;
* cards keep their first digit and get a fresh Luhn digit; IBANs keep country and
  letters and get fresh check digits; phones of 3-3-4 digits keep what precedes their last ten digits, any other that begins
  with + keeps its country code;
* IPv4: halves of 16 bits;
* dates: days of one 400-year Gregorian cycle, 146097 = 189 * 773 of them, as a pair
  (mod 189, mod 773) whose parts are moved in turn;
* social security numbers: the 898 areas and 99 groups that exist, and the 9999 serial
  numbers, as such a pair too. No cycle walking is needed.

E-mail addresses and secrets have no numeric format: they become keyed digests of the
same kind. f is SHA-256 over key, kind, round and half.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import numbered

ROUNDS = 8
#: Patterns of the kinds, in order of precedence; cards come last. A group without a bound
#: repeats possessively (++): Java matches it in a loop, and any other one by recursion.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+)++"
SECRET = r"(?<![\p{L}\p{N}])[0-9A-Fa-f]{32,64}(?![\p{L}\p{N}])"
#: Characters of an IBAN, by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = (
    r"(?<![\p{L}\p{N}])(?:"
    + "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items())
    + r")(?![\p{L}\p{N}])"
)
#: What may be an IBAN of any other length, and words after it.
IBAN_RUN = r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
IPV4 = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[/.-][0-9])"
PHONE = r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
#: Country code, then groups of digits, 8 to 15 digits in all.
CALLING = r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
PHONE_ABROAD = rf"(?<![0-9+]){CALLING}(?:[ .-]?(?:\([0-9]{{1,4}}\)|[0-9])){{4,14}}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD_RUN = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
#: Usual layouts of cards, which are found anywhere in a run of digits.
CARD_LAYOUT = r"(?<![0-9])(?=((?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}(?:\2[0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![0-9])))"
#: A run of digits, valid or not, up to where something else begins; known cards go between the two parts.
CARD_FIRST = r"(?<![0-9])[0-9](?:[0-9]|[ -](?!"
CARD_REST = rf"{IPV4}|{DATE}|{SSN}|(?<= )[0-9]{{3}}-[0-9]{{3}}-[0-9]{{4}}(?![0-9-]))[0-9]){{12,18}}(?![0-9])"
KINDS = {"email": EMAIL, "secret": SECRET, "iban": IBAN, "ipv4": IPV4, "date": DATE, "phone": PHONE, "phone abroad": PHONE_ABROAD, "ssn": SSN}
FORMATS = {"-": "yyyy-MM-dd", "/": "dd/MM/yyyy", ".": "dd.MM.yyyy"}
#: Whole-value forms of the kinds, to tell which one was found.
FORMS = {
    "email": r"^.*@",
    "date": r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})$",
    "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    "iban": r"^[A-Z]{2}[0-9]{2} ?[A-Z0-9]",
    "ipv4": r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$",
    "phone": r"^(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}$",
}


def let(x: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of x, which is computed once however often ``then`` uses it, also within lambdas."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def _prf(key: str, kind: str, i: Column, half: Column) -> Column:
    """A number below 16**13 of key, kind, round and half."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def feistel_digits(digits: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the digit strings of each length from 2 to 30; a single digit stays."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    start = F.struct(F.substr(digits, F.lit(1), half).alias("l"), F.substr(digits, half + 1, n).alias("r"))

    def turn(acc: Column, i: Column) -> Column:
        width = F.length(acc["l"])
        size = F.pow(F.lit(10.0), width).cast("long")
        moved = F.pmod(acc["l"].cast("long") + F.pmod(_prf(key, kind, i, acc["r"]), size), size)
        return F.struct(acc["r"].alias("l"), F.lpad(moved.cast("string"), width, "0").alias("r"))

    rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
    moved = F.aggregate(rounds, start, turn, lambda acc: F.concat(acc["l"], acc["r"]))
    return F.when(n < 2, digits).otherwise(moved)


def feistel_ipv4(ip: Column, key: str) -> Column:
    part = lambda i: F.split_part(ip, F.lit("."), F.lit(i)).cast("long")
    start = F.struct((part(1) * 256 + part(2)).alias("l"), (part(3) * 256 + part(4)).alias("r"))
    turn = lambda acc, i: F.struct(acc["r"].alias("l"), F.pmod(acc["l"] + _prf(key, "ipv4", i, acc["r"]), F.lit(65536)).alias("r"))
    octets = lambda acc: F.concat_ws(".", *[F.floor(x / 256).cast("string") if high else F.pmod(x, F.lit(256)).cast("string") for x in (acc["l"], acc["r"]) for high in (True, False)])
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, octets)


def feistel_pair(a: Column, b: Column, m: int, n: int, key: str, kind: str) -> Column:
    """A keyed permutation of the pairs (a below m, b below n), as a struct: the parts are moved in turn."""

    def turn(acc: Column, i: Column) -> Column:
        first = F.struct(F.pmod(acc["a"] + _prf(key, f"{kind}-a", i, acc["b"]), F.lit(m)).alias("a"), acc["b"].alias("b"))
        return F.when(i % 2 == 1, first).otherwise(F.struct(acc["a"].alias("a"), F.pmod(acc["b"] + _prf(key, f"{kind}-b", i, acc["a"]), F.lit(n)).alias("b")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def feistel_date(day: Column, key: str) -> Column:
    """A keyed permutation of the dates of each 400-year cycle (1700 to 2099 is one)."""
    base = F.lit("1700-01-01").cast("date")
    since = F.datediff(day, base).cast("long")
    cycle, inside = F.floor(since / 146097), F.pmod(since, F.lit(146097))
    moved = feistel_pair(F.floor(inside / 773), F.pmod(inside, F.lit(773)), 189, 773, key, "date")
    return F.date_add(base, (cycle * 146097 + moved["a"] * 773 + moved["b"]).cast("int"))


def feistel_ssn(digits: Column, key: str) -> Column:
    """A keyed permutation of the valid social security numbers: no area 000, 666 or from 900 on, no group 00, no serial 0000."""
    part = lambda i, n: F.substr(digits, F.lit(i), F.lit(n)).cast("long")
    area = part(1, 3) - F.when(part(1, 3) > 666, 2).otherwise(1)
    moved = feistel_pair(area * 99 + part(4, 2) - 1, part(6, 4) - 1, 898 * 99, 9999, key, "ssn")
    area = F.floor(moved["a"] / 99)
    out = (area + F.when(area < 665, 1).otherwise(2), F.pmod(moved["a"], F.lit(99)) + 1, moved["b"] + 1)
    return F.concat(*[F.lpad(x.cast("string"), n, "0") for x, n in zip(out, (3, 2, 4), strict=True)])


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum mod 10: 0 for a valid number."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c > "4", 9).otherwise(0)))
    return F.pmod(F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda acc, x: acc + x), F.lit(10))


def mod97(alnum: Column) -> Column:
    """ISO 7064: letters count as 10 to 35, the whole number mod 97."""

    def add(acc: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.between("0", "9"), F.pmod(acc * 10 + c.cast("int"), F.lit(97))).otherwise(F.pmod(acc * 100 + letter, F.lit(97)))

    return F.aggregate(F.split(alnum, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(add(acc, c)))


def refill(pattern: Column, digits: Column) -> Column:
    """``pattern`` with its digits replaced, in order, by ``digits``."""

    def put(acc: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        out = F.concat(acc["out"], F.when(digit, F.substr(acc["rest"], F.lit(1), F.lit(1))).otherwise(c))
        return F.struct(out.alias("out"), F.when(digit, F.substr(acc["rest"], F.lit(2))).otherwise(acc["rest"]).alias("rest"))

    return F.aggregate(F.split(pattern, ""), F.struct(F.lit("").alias("out"), digits.alias("rest")), put, lambda acc: acc["out"])


def card_ok(value: Column) -> Column:
    return let(F.regexp_replace(value, "[^0-9]", ""), lambda digits: F.length(digits).between(13, 19) & (luhn_sum(digits) == 0) & ~digits.rlike("^0+$"))


def iban_ok(value: Column) -> Column:
    plain = F.regexp_replace(value, " ", "")
    return mod97(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))) == 1


def kind_of(value: Column) -> Column:
    """The kind of a value that the pattern found, or null if it isn't valid."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    date_ok = F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in FORMATS.values()]).isNotNull()
    ssn_ok = ~F.substr(value, F.lit(1), F.lit(3)).rlike("^(?:000|666|9)") & ~value.rlike("-00-|-0000$")
    return (
        F.when(value.rlike(FORMS["email"]), "email")
        .when(value.rlike(FORMS["ipv4"]), "ipv4")
        .when(value.rlike(FORMS["date"]), F.when(date_ok, "date"))
        .when(value.rlike(FORMS["ssn"]), F.when(ssn_ok, "ssn"))
        .when(value.rlike(FORMS["phone"]), "phone")
        .when(value.startswith("+"), F.when(F.length(digits).between(8, 15), "phone"))
        .when(value.rlike("^[0-9][0-9 -]*$") & (F.length(digits) < 32), F.when(card_ok(value), "card"))
        .when(value.rlike("^[0-9A-Fa-f]{32,64}$"), "secret")
        .when(value.rlike(FORMS["iban"]), F.when(iban_ok(value), "iban"))
    )


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a valid value of a kind."""
    return let(F.regexp_replace(value, "[^0-9]", ""), lambda digits: _of_kind(value, digits, kind, key))


def _of_kind(value: Column, digits: Column, kind: Column, key: str) -> Column:
    n = F.length(digits)

    def digest(n: Column) -> Column:
        return F.substr(F.sha2(F.concat_ws("|", F.lit(key), kind, F.lower(value)), 256), F.lit(1), n)

    body = F.concat(F.substr(digits, F.lit(1), F.lit(1)), feistel_digits(F.substr(digits, F.lit(2), n - 2), key, "card"))
    card = let(body, lambda b: F.concat(b, F.pmod(10 - luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))
    phone = F.concat(F.substr(digits, F.lit(1), F.greatest(n - 10, F.lit(0))), feistel_digits(F.substr(digits, F.greatest(n - 9, F.lit(1)), F.lit(10)), key, "phone"))
    code = F.length(F.regexp_extract(value, f"^{CALLING}", 0)) - 1
    abroad = F.concat(F.substr(digits, F.lit(1), code), feistel_digits(F.substr(digits, code + 1), key, "phone"))
    plain = F.regexp_replace(value, " ", "")
    bban, country = F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(2))

    def iban(new: Column) -> Column:
        check = F.lpad((98 - mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
        return F.concat(check, F.regexp_replace(new, "[^0-9]", ""))

    iban_digits = let(refill(bban, feistel_digits(F.regexp_replace(bban, "[^0-9]", ""), key, "iban")), iban)
    date = F.coalesce(*[F.date_format(feistel_date(F.try_to_timestamp(value, F.lit(f)).cast("date"), key), f) for f in FORMATS.values()])
    return (
        F.when(kind == "email", F.concat(F.lit("user-"), digest(F.lit(12)), F.lit("@redacted.invalid")))
        .when(kind == "secret", F.when(value.rlike("[a-f]"), digest(F.length(value))).otherwise(F.upper(digest(F.length(value)))))
        .when(kind == "ipv4", feistel_ipv4(value, key))
        .when(kind == "date", date)
        .when(kind == "phone", refill(value, F.when(value.rlike(FORMS["phone"]), phone).otherwise(abroad)))
        .when(kind == "ssn", refill(value, feistel_ssn(digits, key)))
        .when(kind == "card", refill(value, card))
        .when(kind == "iban", refill(value, iban_digits))
    )


def prefixes(run: Column, last: str, least: int) -> Column:
    """The prefixes of a run of groups that end where a group ends, of ``least`` characters at least, longest first."""
    ends = F.filter(F.sequence(F.length(run), F.lit(1), F.lit(-1)), lambda i: (i >= least) & (F.substr(run, i, F.lit(1)).rlike(last)) & ~F.substr(run, i + 1, F.lit(1)).rlike(last))
    return F.transform(ends, lambda i: F.substr(run, F.lit(1), i))


def hidden(text: Column) -> tuple[Column, Column]:
    """(IBANs, cards) of a text that are valid, as one pattern each; empty for none.

    A candidate is digits, letters, blanks and dashes, so it is a pattern as it stands.
    """

    def found(pattern: str, ok: Callable[[Column], Column], last: str, least: int, group: int = 0) -> Column:
        runs = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        return F.transform(runs, lambda v: F.get(F.filter(prefixes(v, last, least), ok), F.lit(0)))

    def pattern(values: Column) -> Column:
        longest = F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull())), lambda a, b: F.length(b) - F.length(a))
        return F.array_join(longest, "|")

    ibans = pattern(found(IBAN_RUN, iban_ok, "^[A-Z0-9]$", 12))
    cards = pattern(F.concat(found(CARD_RUN, card_ok, "^[0-9]$", 13), found(CARD_LAYOUT, card_ok, "^[0-9]$", 13, 1)))
    maybe = lambda p, x: F.when(text.rlike(p), x).otherwise("")
    return maybe(IBAN_RUN, ibans), maybe("[0-9](?:[ -]?[0-9]){12}", cards)


#: What marks the ends of a value within a text, what hides a mark that the text holds itself, and the two hidden ones.
MARK, HIDE, HIDDEN = "\x01", "\x02", ("\x02\x03", "\x02\x04")


def pseudonymise(docs: DataFrame, key: str, text: str = "text", found: str | None = None) -> DataFrame:
    """docs with the PII of column ``text`` replaced; ``found`` names a last column for the kinds replaced, in order.

    All rows and columns stay, whatever the columns' names; ``found`` gets an underscore
    or more if docs has a column of that name. Null texts stay null, empty ones empty;
    equal rows stay equal. ``n_chars``, if it is the number of characters of the text,
    isn't touched.
    """
    names = docs.columns
    at = names.index(text)
    docs = numbered(docs)
    col = F.col(f"c{at}")
    kinds = list(KINDS)
    before, after = ("|".join(f"(?:{KINDS[n]})" for n in part) for part in (kinds[: kinds.index("iban")], kinds[kinds.index("iban") :]))
    own = lambda c, p, q: F.when(F.col(c) != "", F.concat(F.lit(p), F.col(c), F.lit(q))).otherwise("")
    pattern = F.concat(
        F.lit(f"{before}|"),
        own("ibans", r"(?<![\p{L}\p{N}])(?:", r")(?![\p{L}\p{N}])|"),
        F.lit(f"{after}|"),
        own("cards", "(?<![0-9])(?:", ")(?![0-9])|"),
        F.lit(CARD_FIRST),
        own("cards", "(?:", ")(?![0-9])|"),
        F.lit(CARD_REST),
    )
    ibans, cards = hidden(col)
    marked = F.regexp_replace(F.replace(F.replace(col, F.lit(HIDE), F.lit(HIDDEN[0])), F.lit(MARK), F.lit(HIDDEN[1])), pattern, F.lit(f"{MARK}$0{MARK}"))
    out = docs.withColumns({"ibans": ibans, "cards": cards})
    # a text without a digit or @ has nothing to find: most are passed by at once; of the others, every second part is a value
    out = out.withColumn("parts", F.when(col.rlike("[0-9@]"), F.split(marked, MARK, -1)))
    value_of = lambda v, kind: F.when(kind.isNull(), v).otherwise(pseudonym(v, kind, key))
    known = F.transform("parts", lambda v, i: F.struct(v.alias("value"), F.when(i % 2 == 1, kind_of(v)).alias("kind")))
    out = out.withColumn("known", F.when(F.size("parts") > 1, known))
    joined = F.array_join(F.transform("known", lambda h: value_of(h["value"], h["kind"])), "")
    plain = F.replace(F.replace(joined, F.lit(HIDDEN[1]), F.lit(MARK)), F.lit(HIDDEN[0]), F.lit(HIDE))
    columns = [F.col(f"c{i}") for i in range(len(names))]
    columns[at] = F.when(F.col("known").isNotNull(), plain).otherwise(col).alias(f"c{at}")
    if found is None:
        return out.select(*columns).toDF(*names)
    listed = F.filter(F.transform("known", lambda h: h["kind"]), lambda k: k.isNotNull())
    while found.lower() in map(str.lower, names):
        found += "_"
    return out.select(*columns, F.coalesce(listed, F.array().cast("array<string>")).alias("found")).toDF(*names, found)
