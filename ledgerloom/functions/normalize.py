"""Match keys: names, titles, places, urls, languages, work modes, dates.

Every function takes and returns a Column and stays in the JVM. Null counts as the empty string. Word boundaries are written out as
ASCII look-arounds: Java's own follow Unicode, and would tell 'stageé' from 'stage'.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers and Python see it: ASCII and the no-break space.
WS = r"[\s ]"
LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

#: Legal forms, in the order in which they are tried.
LEGAL_SUFFIXES = r"s\.?p\.?a\.?|s\.?r\.?l\.?|s\.?a\.?s\.?|ltd|limited|gmbh|sas|sarl|bv|nv|sl|sa|inc|llc|spa|srl"
#: City and country names that are one.
CITY_ALIASES = {
    "milano": "milan",
    "roma": "rome",
    "torino": "turin",
    "italia": "italy",
    "francia": "france",
    "germania": "germany",
    "spagna": "spain",
    "paesi bassi": "netherlands",
    "olanda": "netherlands",
}
#: Words for an internship, which all become "intern".
INTERN_WORDS = ("stage", "stagista", "stagiaire", "stageur", "tirocinio", "tirocinante", "internship", "intern", r"praktikant(?::in)?", "praktikum", r"beca(?:rio/a)?")
#: Query parameters that carry tracking, beside utm and utm_*.
TRACKING = ("refid", "trackingid", "trk", "trkinternal", "originalreferer", "fbclid", "gclid", "mc_cid", "mc_eid")
#: Names of each language.
LANGUAGES = {
    "italian": "it italiano italian italienne italien",
    "english": "en inglese english anglais englisch",
    "french": "fr francese french francais franzosisch",
    "german": "de tedesco german deutsch allemand",
    "spanish": "es spagnolo spanish espanol espagnol",
    "portuguese": "pt portoghese portuguese portugues portugais",
    "dutch": "nl olandese dutch nederlands neerlandais",
    "chinese": "zh cinese chinese chinois mandarin mandarino",
    "japanese": "ja giapponese japanese japonais",
    "korean": "ko coreano korean coreen",
    "russian": "ru russo russian russe",
    "arabic": "ar arabo arabic arabe",
    "polish": "pl polacco polish polonais",
    "swedish": "sv svedese swedish suedois",
}


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def lookup(c: Column, table: dict[str, str]) -> Column:
    """The table's value for ``c``, or ``c`` itself."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), c)


@lru_cache(maxsize=1)
def _decompositions() -> tuple[str, str, dict[str, str]]:
    """(characters that NFKD takes to one other, those others, what it takes each of the rest to), marks aside.

    Made from the Unicode tables, but for Hangul syllables, which follow a rule.
    """
    one, others, more = [], [], {}
    for point in (*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xF900, 0x30000)):
        c = chr(point)
        parts = "".join(x for x in unicodedata.normalize("NFKD", c) if not 0x300 <= ord(x) <= 0x36F)
        if parts == c:
            continue
        if len(parts) == 1:
            one.append(c)
            others.append(parts)
        else:
            more[c] = parts
    return "".join(one), "".join(others), more


def _hangul(c: Column) -> Column:
    """The two or three letters of a syllable."""
    code = F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("int") - 0xAC00
    letter = lambda p: F.decode(F.unhex(F.lpad(F.hex(p), 4, "0")), "UTF-16BE")
    last = F.pmod(code, F.lit(28))
    return F.concat(letter(F.floor(code / 588) + 0x1100), letter(F.floor(F.pmod(code, F.lit(588)) / 28) + 0x1161), F.when(last > 0, letter(last + 0x11A7)).otherwise(""))


def nfkd(c: Column) -> Column:
    """NFKD without the combining marks U+0300 to U+036F, in the JVM.

    Marks beyond these keep their order. Most text is ASCII and passes by; single
    letters are translated, and only a text with a ligature, fraction, syllable or the
    like is taken apart letter by letter.
    """
    one, others, more = _decompositions()
    c = text(c)
    known = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in more.items())), F.lit("\x01"), F.lit("\x02"))
    apart = lambda x: F.when(x.between("\uac00", "\ud7a3"), _hangul(x)).otherwise(F.coalesce(F.try_element_at(known, x), x))
    rest = "".join(f"\\x{{{ord(x):x}}}" for x in more)
    whole = F.when(c.rlike(f"[\uac00-\ud7a3{rest}]"), F.array_join(F.transform(F.split(c, ""), apart), "")).otherwise(c)
    return F.when(~c.rlike("[^\\x00-\\x7f]"), c).otherwise(F.regexp_replace(F.translate(whole, one, others), "[\u0300-\u036f]", ""))


@lru_cache(maxsize=1)
def _to_ascii() -> tuple[str, str, dict[str, str]]:
    """Of the decompositions those that hold ASCII, or nothing: all that a key of a-z and 0-9 can tell apart."""
    one, others, more = _decompositions()
    pairs = [(a, b) for a, b in zip(one, others, strict=True) if b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs), {k: v for k, v in more.items() if not v or any(x.isascii() for x in v)}


def latin(c: Column) -> Column:
    """As nfkd for what becomes a key of ASCII letters and digits: other letters stay as they are, and the table is small."""
    one, others, more = _to_ascii()
    c = text(c)
    known = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in more.items())), F.lit("\x01"), F.lit("\x02"))
    rest = "".join(f"\\x{{{ord(x):x}}}" for x in more)
    apart = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(known, x), x)), "")
    whole = F.when(c.rlike(f"[{rest}]"), apart).otherwise(c)
    return F.when(~c.rlike("[^\\x00-\\x7f]"), c).otherwise(F.regexp_replace(F.translate(whole, one, others), "[\u0300-\u036f]", ""))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def alnum_words(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))


def norm_company(c: Column, fold=latin) -> Column:
    """Lower case, no marks, no parentheses, no legal form; words of a-z and 0-9."""
    plain = F.regexp_replace(fold(F.lower(text(c))), r"\([^)]*\)", " ")
    return alnum_words(F.regexp_replace(plain, f"(?i){LEFT}(?:{LEGAL_SUFFIXES}){RIGHT}", " "))


def norm_title(c: Column, fold=latin) -> Column:
    """Lower case, no marks, every word for an internship as "intern"."""
    return alnum_words(F.regexp_replace(fold(F.lower(text(c))), f"(?i){LEFT}(?:{'|'.join(sorted(INTERN_WORDS, key=len, reverse=True))}){RIGHT}", "intern"))


def norm_city(c: Column, fold=latin) -> Column:
    """What precedes the first comma, folded; known names of one place become one."""
    first = fold(F.lower(F.trim(F.split_part(text(c), F.lit(","), F.lit(1)))))
    return lookup(collapse(F.regexp_replace(first, r"[^a-z\s]+", " ")), CITY_ALIASES)


def role_key(company: Column, title: Column, location: Column, fold=latin) -> Column:
    return key_of(norm_company(company, fold), norm_title(title, fold), norm_city(location, fold))


def key_of(company: Column, title: Column, city: Column) -> Column:
    """The role key of parts that are normalised already."""
    return F.concat(F.lit("x:"), company, F.lit("|"), title, F.lit("|"), city)


def is_tracking(name: Column) -> Column:
    k = F.lower(name)
    return (k == "utm") | k.startswith("utm_") | k.isin(*TRACKING)


def normalize_url(c: Column) -> Column:
    """No fragment, no tracking parameters, the others sorted, no trailing slash, lower case."""
    s = F.regexp_replace(F.trim(text(c)), "#.*$", "")
    head = F.regexp_replace(F.split_part(s, F.lit("?"), F.lit(1)), "/+$", "")
    query = F.when(F.instr(s, "?") > 0, F.substr(s, F.instr(s, "?") + 1)).otherwise("")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~is_tracking(F.split_part(p, F.lit("="), F.lit(1)))))
    return F.lower(F.when(F.size(kept) > 0, F.concat_ws("?", head, F.array_join(kept, "&"))).otherwise(head))


def strip_seat_suffix(c: Column) -> Column:
    """Drops what follows the first em or en dash; a hyphen is part of a title."""
    return F.trim(F.regexp_replace(text(c), r"\s*[—–]\s*.*$", ""))


def _referred(ref: Column) -> Column:
    """The character of ``&#...;``, or the reference itself where it names none."""
    digits = F.regexp_replace(F.regexp_extract(ref, "^&#x?([0-9A-Fa-f]+);$", 1), "^0+(?=.)", "")
    is_hex = ref.startswith("&#x")
    fits = (F.length(digits) <= 8) & (is_hex | digits.rlike("^[0-9]+$"))
    point = F.when(fits, F.conv(digits, 16, 10).cast("long")).otherwise(F.lit(-1))
    point = F.when(is_hex, point).otherwise(F.when(fits, digits.cast("long")).otherwise(F.lit(-1)))
    valid = point.between(0, 0xD7FF) | point.between(0xE000, 0x10FFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")).otherwise(ref)


def decode_entities(c: Column) -> Column:
    """Named and numeric references, &amp; first, so what was written twice is decoded twice."""
    v = text(c)
    named = F.replace(v, F.lit("&amp;"), F.lit("&"))
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " ")):
        named = F.replace(named, F.lit(f"&{name};"), F.lit(char))
    pattern = "&#x?[0-9A-Fa-f]+;"
    refs = F.transform(F.regexp_extract_all(named, F.lit(pattern), F.lit(0)), _referred)
    decoded = F.array_join(F.zip_with(F.split(named, pattern), refs, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    return F.when(F.instr(v, "&") == 0, v).when(F.instr(named, "&#") == 0, named).otherwise(decoded)


def strip_tags(c: Column) -> Column:
    """Tags become spaces, white space collapses."""
    return collapse(F.regexp_replace(text(c), "<[^>]+>", " "))


def norm_language(c: Column, fold=latin) -> Column:
    names = {n: k for k, v in LANGUAGES.items() for n in v.split()}
    return lookup(F.regexp_replace(fold(F.lower(F.trim(text(c)))), "[^a-z]", ""), names)


def is_known_language(c: Column, fold=latin) -> Column:
    return norm_language(c, fold).isin(*LANGUAGES)


def work_mode(c: Column) -> Column:
    """onsite, hybrid or fully_remote from a source's own spelling; null if it isn't declared."""
    k = F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]", "")
    return F.when(k.isin("onsite", "hybrid"), k).when(k.isin("remote", "fullyremote"), "fully_remote")


def parse_date(c: Column) -> Column:
    """ISO, then day first with four or two digits of the year (69 to 99 are 19xx); a trailing time is dropped."""
    s = F.regexp_replace(F.trim(text(c)), r"[T ]\d{1,2}:.*$", "")
    short = F.regexp_extract(s, r"^(\d{1,2}/\d{1,2}/)(\d{2})$", 2)
    century = F.when(short == "", s).otherwise(F.concat(F.regexp_extract(s, r"^(\d{1,2}/\d{1,2}/)", 1), F.when(short >= "69", "19").otherwise("20"), short))
    return F.coalesce(F.try_to_timestamp(century, F.lit("yyyy-M-d")), F.try_to_timestamp(century, F.lit("d/M/yyyy"))).cast("date")


def detect_date_format(c: Column) -> Column:
    s = F.trim(text(c))
    return F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), "iso").when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), "dmy").when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), "dmy2")


def format_date(c: Column, iso: bool = False) -> Column:
    return F.date_format(c, "yyyy-MM-dd" if iso else "dd/MM/yyyy")


def same_value(a: Column, b: Column, date: bool = False) -> Column:
    """Equal as text, or as dates in a date column."""
    x, y = F.trim(text(a)), F.trim(text(b))
    equal = x == y
    return equal | F.coalesce(parse_date(x) == parse_date(y), F.lit(False)) if date else equal


def company_id(c: Column, prefix: str = "polids-", fold=latin) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(norm_company(c, fold)), 1, 8))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of the sets of words."""
    x, y = (F.filter(F.array_distinct(F.split(v, " +")), lambda t: t != "") for v in (a, b))
    total = F.size(x) + F.size(y)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.lit(2.0) * F.size(F.array_intersect(x, y)) / total).otherwise(F.lit(0.0))


def parse_retry_after(c: Column, now_ms: Column) -> Column:
    """Milliseconds of whole seconds or of an HTTP date, 0 at least; else null."""
    s = F.trim(text(c))
    when = F.unix_millis(F.try_to_timestamp(F.regexp_replace(s, "^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss")))
    return F.when(s.rlike(r"^\d+$"), s.cast("long") * 1000).when(when.isNotNull(), F.greatest(when - now_ms, F.lit(0)))


def backoff_ms(attempt: Column, rand: Column) -> Column:
    return F.floor(rand * F.least(F.lit(8000.0), F.lit(1000.0) * F.pow(F.lit(2.0), attempt))).cast("long")


def host_of(c: Column) -> Column:
    """The host with its port, or the text itself where there is none."""
    host = F.regexp_extract(text(c), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1)
    return F.when(host != "", F.lower(host)).otherwise(text(c))


def search_place(c: Column) -> Column:
    return F.when(F.trim(text(c)).rlike(r"(?i)^(eu|e\.u\.?)$"), "European Union").otherwise(text(c))


def search_url(base: str, query: Column, place: Column, start: Column, recency_days: Column) -> Column:
    recent = F.when(recency_days.isNotNull(), F.concat(F.lit("&f_TPR=r"), (recency_days * 86400).cast("string"))).otherwise("")
    return F.concat(F.lit(base + "?keywords="), F.url_encode(query), F.lit("&location="), F.url_encode(place), F.lit("&start="), start.cast("string"), recent)


def contains_quote(haystack: Column, quote: Column) -> Column:
    """Substring test after collapsing white space."""
    return F.contains(collapse(text(haystack)), collapse(text(quote)))


def run_name(day: Column, master: Column, edition: Column) -> Column:
    return F.concat_ws("-", day, master, edition)
