"""Column expressions that clean and normalise station, price and date fields. Built-in functions only."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Street abbreviations of address matching.
STREETS = {
    "ST": "STREET", "RD": "ROAD", "AVE": "AVENUE", "HWY": "HIGHWAY", "LN": "LANE", "DR": "DRIVE", "CRES": "CRESCENT", "BLVD": "BOULEVARD", "CT": "COURT",
    "TCE": "TERRACE", "PL": "PLACE", "PDE": "PARADE", "CL": "CLOSE", "GR": "GROVE", "CCT": "CIRCUIT", "PKWY": "PARKWAY", "FWY": "FREEWAY", "EXWY": "EXPRESSWAY",
}
# States that an address may end with, before its postcode.
STATES = ["NSW", "VIC", "QLD", "SA", "WA", "TAS", "NT", "ACT"]
# Postcodes that are known to be wrong, and those of another territory that have no place in the data.
POSTCODES = {"1579": "2019", "2056": "2506", "2461": "2460", "2751": "2750", "2860": "2680"}
ELSEWHERE = ["2609", "2914"]
#: Forms of dates, tried in turn: the pattern, and what a text of it looks like.
DATE_PATTERNS = (
    ("yyyy-M-d'T'H:m:s", r"^\d{4}-\d+-\d+T\d+:\d+:\d+$"), ("yyyy-M-d H:m:s", r"^\d{4}-\d+-\d+ \d+:\d+:\d+$"), ("yyyy-M-d", r"^\d{4}-\d+-\d+$"),
    ("d/M/yyyy h:m:s a", r"^\d+/\d+/\d{4} \d+:\d+:\d+ [AaPp][Mm]$"), ("d/M/yyyy H:m", r"^\d+/\d+/\d{4} \d+:\d+$"), ("d/M/yyyy", r"^\d+/\d+/\d{4}$"),
)


def int_to_date(c: Column) -> Column:
    return F.to_date(c.cast("string"), "yyyyMMdd")


def date_to_int(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd").cast("int")


def month_of_int(c: Column) -> Column:
    return F.date_format(int_to_date(c), "yyyy-MM")


def to_decicents(cents: Column) -> Column:
    """Tenths of a cent, halves to even."""
    return F.bround(cents * 10).cast("int")


def _words(raw: Column) -> tuple[Column, Column]:
    """The words of an address, commas as words of their own, without state and postcode at its end; and that postcode."""
    words = F.filter(F.split(F.regexp_replace(raw, ",", " , "), r"\s+"), lambda w: w != "")
    code, state = F.get(words, F.size(words) - 1), F.get(words, F.size(words) - 2)
    ends = F.coalesce(code.rlike(r"^\d{4}$") & F.upper(state).isin(STATES), F.lit(False))
    return F.when(ends, F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))).otherwise(words), F.when(ends, code)


def normalise_address(raw: Column) -> Column:
    """Lower-case address without state and postcode, with full street types before the first comma, no punctuation."""
    words, _ = _words(F.upper(raw))
    comma = F.array_position(words, ",").cast("int")
    types = F.create_map(*[F.lit(x) for kv in STREETS.items() for x in kv])

    def full(word: Column) -> Column:
        """A street type at the word's end, after no letter or digit, in full; its dot goes."""
        kind = F.element_at(types, F.regexp_extract(word, r"(\w+)\.?$", 1))
        return F.when(kind.isNull(), word).otherwise(F.concat(F.regexp_replace(word, r"\w+\.?$", ""), kind))

    street = F.when(comma > 0, F.slice(words, F.lit(1), F.greatest(comma - 1, F.lit(0)))).otherwise(words)
    rest = F.when(comma > 0, F.slice(words, F.greatest(comma, F.lit(1)), F.size(words)))
    flat = F.concat_ws(" ", F.transform(street, full), rest)
    return F.when(raw.isNotNull(), F.lower(F.trim(F.regexp_replace(F.translate(flat, ",./", "   "), r"\s+", " "))))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def slug_of(name: str) -> str:
    """slug() of a plain string, for column names."""
    return re.sub("^_+|_+$", "", re.sub("[^a-z0-9]+", "_", name.lower()))


def title(c: Column) -> Column:
    """Each run of letters with a capital first."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1)), F.initcap), "")


def suburb_of(address: Column) -> Column:
    """Suburb of an address that ends with state and postcode, else null.

    It is what follows the last comma, or, without a comma or with nothing after it, what follows the last street type.
    """
    words, code = _words(address)
    kinds = [*STREETS.values(), *STREETS]

    def behind(listed: Column, mark) -> tuple[Column, Column]:
        """Place of the last word that mark holds for (0: none), and the words behind it."""
        at = F.coalesce(F.array_max(F.transform(listed, lambda w, i: F.when(mark(w), i + 1).otherwise(0))), F.lit(0))
        return at, F.slice(listed, at + 1, F.size(listed) - at)

    comma, tail = behind(words, lambda w: w == ",")
    _, rest = behind(F.array_remove(words, ","), lambda w: F.upper(F.rtrim(w, F.lit("."))).isin(kinds))
    found = F.array_join(F.when((comma > 0) & (F.size(tail) > 0), tail).otherwise(rest), " ")
    return title(F.when(code.isNotNull() & (found != ""), found))


def postcode_of(address: Column) -> Column:
    """The postcode behind the state, else the last number of four digits; null if there is none."""
    return F.coalesce(_words(address)[1], F.nullif(F.regexp_extract(address, r"\b(\d{4})\b[^0-9]*$", 1), F.lit("")))


def parse_date(c: Column, patterns: tuple[tuple[str, str], ...] = DATE_PATTERNS) -> Column:
    """The first pattern that fits, as a timestamp; null if none does."""
    return F.coalesce(*[F.when(F.trim(c).rlike(shape), F.try_to_timestamp(F.trim(c), F.lit(p))) for p, shape in patterns])


def swap_day_month(at: Column, month: Column, today: Column | None = None) -> Column:
    """A date or time of a file of that month: as it is, or with day and month changed round, else null; null too if after today."""
    swapped = F.make_date(F.year(at), F.dayofmonth(at), F.month(at))
    days = F.when(F.month(at) == month, F.to_date(at)).when((F.dayofmonth(at) == month) & (F.dayofmonth(at) <= 12), swapped)
    return days if today is None else F.when(days <= today, days)


def month_of_name(name: Column) -> Column:
    """Last month named in a file name, as yyyy-MM: 2024-03, mar2024 or march-2024 forms."""
    months = "january february march april may june july august september october november december".split()
    iso = F.get(F.reverse(F.regexp_extract_all(name, F.lit(r"(\d{4}-(?:0[1-9]|1[0-2]))"), F.lit(1))), F.lit(0))
    word = F.get(F.reverse(F.regexp_extract_all(F.lower(name), F.lit(r"((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[-_ ]?\d{4})"), F.lit(1))), F.lit(0))
    number = reduce(lambda c, im: F.when(F.substring(word, 1, 3) == im[1][:3], F.lpad(F.lit(str(im[0] + 1)), 2, "0")).otherwise(c), enumerate(months), F.lit(None).cast("string"))
    return F.coalesce(iso, F.when(word.isNotNull(), F.concat(F.substring(word, -4, 4), F.lit("-"), number)))


def clean_price(c: Column, cap: float = 999.0) -> Column:
    price = c.try_cast("double")
    return F.when(price.isNotNull(), F.bround(F.least(F.lit(cap), price), 1))


def clean_postcode(given: Column, address: Column, correct_inferred: bool = True) -> Column:
    """The postcode as given, or the address's last word where it is blank, corrected; null for one of another territory.

    Without correct_inferred only given postcodes are corrected, and the address's word stands.
    """
    said = F.nullif(F.trim(given), F.lit(""))
    code = F.coalesce(said, F.nullif(F.regexp_extract(F.trim(address), r"(\S+)$", 1), F.lit("")))
    wrong = F.create_map(*[F.lit(x) for kv in POSTCODES.items() for x in kv])
    return F.when(~code.isin(ELSEWHERE), F.coalesce(F.element_at(wrong, code if correct_inferred else said), code))


def brand_by_prefix(name: Column, brands: list[tuple[str, str]], other: str = "Independent") -> Column:
    """The brand of the first prefix that the name has."""
    return reduce(lambda c, pb: F.when(F.startswith(F.lower(name), F.lit(pb[0])), pb[1]).otherwise(c), reversed(brands), F.lit(other))


def band(premium: Column, width: float = 10.0) -> Column:
    return F.when(premium > width, "Sticky").when(premium < -width, "Discount").otherwise("Competitive")


def regime(share: Column) -> Column:
    return F.when(share.isNull(), "unmatched").when(share < 0.6, "early").when(share < 1.0, "late").otherwise("overdue")


def fingerprint(names: list[str]) -> Column:
    """Number and hash of an ordered list of names."""
    return F.concat(F.lit(f"{len(names)}:"), F.substring(F.sha2(F.lit("\n".join(names)), 256), 1, 12))


def heat_colour(share: Column) -> Column:
    """Green at zero, red at one, as #rrggbb."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    return F.format_string("#%02x%02x00", F.floor(x * 255).cast("int"), F.floor((F.lit(1.0) - x) * 255).cast("int"))
