"""Column functions for public-finance text, numbers, dates and labels. No UDF but title_case.

Money is BIGINT cents. Decimal arithmetic rounds half away from zero unless a name says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

SAFE_INTEGER = 9007199254740991
#: The names of months.
MONTHS = ("gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre")


def cents(amount: Column) -> Column:
    """Euros to integer cents."""
    return F.round(amount.cast("decimal(18,2)") * 100, 0).cast("bigint")


def population(text: Column) -> Column:
    """Integer in Italian notation; one or less and anything unreadable is unknown; halves go to even."""
    number = F.replace(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    value = number.try_cast("double")
    return F.when(value > 1, F.bround(value, 0).cast("bigint"))


def title_digit(code: Column) -> Column:
    """First digit of a code, else '?'."""
    return F.coalesce(F.nullif(F.regexp_extract(code, r"\d", 0), F.lit("")), F.lit("?"))


def euro(cents_: Column) -> Column:
    return (cents_.cast("decimal(20,0)") / 100).cast("decimal(20,2)")


def per_capita(cents_: Column, people: Column) -> Column:
    """Euros a head, two digits; null without people."""
    return F.when(people > 0, F.round(cents_.cast("decimal(20,0)") / (people.cast("decimal(18,0)") * 100), 2).cast("decimal(20,2)"))


def per_capita_even(cents_: Column, people: Column) -> Column:
    """As per_capita, with halves to even: of whole cents a head, so that no binary fraction tells."""
    low = F.floor(F.try_divide(cents_.cast("decimal(20,0)"), people.cast("decimal(18,0)"))).cast("bigint")
    rest = 2 * (cents_ - low * people)
    up = (rest > people) | ((rest == people) & (low % 2 != 0))
    return F.when(people > 0, euro(low + up.cast("bigint")))


def italian_cents(text: Column, signed: bool = False) -> Column:
    """'1.234,5' to cents; anything else null."""
    ok = text.rlike(r"^-?\d[\d.]*(,\d+)?$" if signed else r"^\d[\d.]*(,\d+)?$")
    number = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(ok, F.round(number.try_cast("decimal(38,6)") * 100, 0).cast("bigint"))


def floor_zero_cents(amount: Column) -> Column:
    """Number to cents; negative corrections count as zero."""
    return F.greatest(F.round(amount.cast("decimal(20,6)") * 100, 0).cast("bigint"), F.lit(0).cast("bigint"))


def grouped_cents(text: Column) -> Column:
    """Amounts with optional euro sign, groups of three and a decimal comma, or one point whose tail is no group."""
    t = F.regexp_replace(text, r"[€\s\x{A0}]", "")
    plain = F.when(t.rlike(r"^\d{1,3}(\.\d{3})+(,\d+)?$"), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
    plain = F.coalesce(plain, F.when(t.rlike(r"^\d+(,\d+)?$"), F.replace(t, F.lit(","), F.lit("."))), F.when(t.rlike(r"^\d+\.(\d{1,2}|\d{4,})$"), t))
    return F.round(plain.try_cast("decimal(38,6)") * 100, 0).cast("bigint")


def millions_to_cents(text: Column) -> Column:
    """'12,34567' million euros to cents."""
    return F.when(text.rlike(r"^\d+(,\d+)?$"), F.round(F.replace(text, F.lit(","), F.lit(".")).try_cast("decimal(30,10)") * 100000000, 0).cast("bigint"))


def exact_cents(text: Column) -> Column:
    """Amounts with exactly two digits after the point, of either sign."""
    return F.when(text.rlike(r"^-?\d+\.\d{2}$"), (text.try_cast("decimal(20,2)") * 100).cast("bigint"))


def whole_euro_cents(text: Column, signed: bool = False) -> Column:
    """Whole euros to cents; blank is unknown."""
    ok = F.trim(text).rlike(r"^-?\d+$" if signed else r"^\d+$")
    return F.when(ok, F.trim(text).try_cast("bigint") * 100)


def point_cents(text: Column) -> Column:
    """Decimal point with at most two digits."""
    return F.when(text.rlike(r"^-?\d+(\.\d{1,2})?$"), (text.try_cast("decimal(20,2)") * 100).cast("bigint"))


def comma_decimal(text: Column) -> Column:
    """Signed decimal with a comma."""
    return F.when(text.rlike(r"^-?\d+(,\d+)?$"), F.replace(text, F.lit(","), F.lit(".")).try_cast("decimal(30,6)"))


def payment_amount(text: Column) -> Column:
    """White space goes, the first comma is the point; blank is null and to be refused; zero stays."""
    return F.regexp_replace(F.regexp_replace(text, r"\s", ""), r"^([^,]*),", "$1.").try_cast("decimal(20,2)")


def lenient_number(text: Column) -> Column:
    """As payment_amount, but unreadable is zero."""
    return F.coalesce(payment_amount(text), F.lit(0).cast("decimal(20,2)"))


def basis_points(value: Column, base: Column) -> Column:
    """value / base in hundredths of a percent, rounded half away from zero; null on a zero base."""
    return F.round(F.try_divide(value.cast("decimal(20,0)") * 10000, base.cast("decimal(18,0)")), 0).cast("bigint")


def checked_points(percent: Column, most: int) -> Column:
    """Percent in hundredths, halves away from zero; null beyond most percent either way."""
    return F.when(F.abs(percent) <= most, F.round(percent * 100, 0).cast("bigint"))


def round_half_away(n: Column, d: Column) -> Column:
    """n / d of integers as an integer, halves away from zero; null without d."""
    return F.round(F.try_divide(n.cast("decimal(20,0)"), d.cast("decimal(18,0)")), 0).cast("bigint")


def round_half_up(x: Column) -> Column:
    """Half toward plus infinity."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def percentage(part: Column, whole: Column) -> Column:
    """Six digits; null when the whole is zero."""
    return F.round(F.try_divide(part.cast("decimal(20,0)") * 100, whole.cast("decimal(18,0)")).cast("decimal(30,10)"), 6).cast("decimal(20,6)")


def compact_text(text: Column) -> Column:
    """One space for any white space; blank and overflow marks (only #) are null."""
    t = F.trim(F.regexp_replace(F.replace(text, F.lit(" "), F.lit(" ")), r"\s+", " "))
    return F.when((t != "") & ~t.rlike(r"^#+$"), t)


def normalized_code(text: Column, pattern: str | None = None) -> Column:
    code = F.upper(compact_text(text))
    return code if pattern is None else F.when(code.rlike(pattern), code)


def flexible_date(text: Column) -> Column:
    """dd/MM/yyyy or yyyy-MM-dd; the spreadsheet sentinels of 1900 are null."""
    t = compact_text(text)
    day = F.coalesce(F.try_to_date(t, "dd/MM/yyyy"), F.try_to_date(t, "yyyy-MM-dd"))
    return F.when(day > F.lit("1900-01-01").cast("date"), day)


def checked_date(text: Column, field: str) -> Column:
    """Struct of the date and, where the text is no plausible date, a warning."""
    day = F.when(text.rlike(r"^(19|20|21)\d{2}-\d{2}-\d{2}"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))
    return F.struct(day.alias("date"), F.when(day.isNull() & (F.trim(text) != ""), F.concat(F.lit(f"{field}: "), text)).alias("warning"))


def tax_code(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"^\[|\]$", "")


def header_name(name: str) -> str:
    return "_".join(name.replace("﻿", "").strip().lower().split())


def header_key(text: Column) -> Column:
    """The same for names in a column."""
    return F.replace(F.lower(F.trim(F.regexp_replace(F.replace(text, F.lit("\ufeff"), F.lit("")), r"\s+", " "))), F.lit(" "), F.lit("_"))


def cup(text: Column) -> Column:
    code = F.upper(F.trim(text))
    return F.when(code.rlike(r"^[A-Z0-9]{15}$"), code)


def istat_code(text: Column) -> Column:
    """Six digits with leading zeros; longer input stays as it is."""
    return F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text)


def province_code(municipality: Column) -> Column:
    return F.substring(municipality, 1, 3)


def search_key(text: Column) -> Column:
    """Lower case without accents, full-width and joined letters, apostrophes and dashes unified, one space."""
    wide = "".join(chr(0xFF21 + i) for i in range(26)) + "".join(chr(0xFF41 + i) for i in range(26)) + "".join(chr(0xFF10 + i) for i in range(10))
    low = F.lower(F.translate(text, wide, "abcdefghijklmnopqrstuvwxyz" * 2 + "0123456789"))
    low = F.translate(low, "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy")
    for joined, parts in (("[’‘´`]", "'"), ("[–—]", "-"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), (r"\s+", " ")):
        low = F.regexp_replace(low, joined, parts)
    return F.trim(low)


def same_name(a: Column, b: Column) -> Column:
    """Equality without case and accents."""
    return F.collate(F.trim(F.regexp_replace(a, r"\s+", " ")), "UNICODE_CI_AI") == F.collate(F.trim(F.regexp_replace(b, r"\s+", " ")), "UNICODE_CI_AI")


def contains_folded(fields: list[Column], term: str) -> Column:
    """Whether a term occurs in any of the fields, without case and accents."""
    return F.contains(F.collate(F.concat_ws("\n", *fields), "UNICODE_CI_AI"), F.collate(F.lit(term), "UNICODE_CI_AI"))


#: Words that stay in lower case within a name.
PARTICLES = ("di", "de", "del", "della", "delle", "dei", "degli", "dell", "da", "dal", "dalla", "d", "in", "nel", "nella", "nelle", "nell", "su", "sul", "sulla", "sull", "e", "a", "al", "alla", "all", "con", "per", "lo", "la", "le", "il", "i", "gli")


def municipality_name(text: Column) -> Column:
    """Registry capitals to a name: no 'COMUNE DI', particles low, both sides of an apostrophe or hyphen high."""
    words = F.split(F.lower(F.regexp_replace(F.trim(text), r"(?i)^comune di\s+", "")), r"\s+")

    def word(w: Column, i: Column) -> Column:
        parts = F.regexp_replace(F.regexp_replace(w, "'", "'\u0001"), "-", "-\u0001")
        high = F.array_join(F.transform(F.split(parts, "\u0001"), F.initcap), "")
        return F.when((i > 0) & F.regexp_replace(w, "[.']", "").isin(*PARTICLES), w).otherwise(high)

    return F.array_join(F.transform(words, word), " ")


def implied_population(pairs: list[tuple[Column, Column]]) -> Column:
    """Rounded mean of total / per-capita over the pairs that allow it, at least 1; else null."""
    found = F.array_compact(F.array(*[F.when((each > 0) & (total > 0), total.cast("double") / each.cast("double")) for total, each in pairs]))
    mean = F.try_divide(F.aggregate(found, F.lit(0.0), lambda a, x: a + x), F.size(found).cast("double"))
    return F.when(F.size(found) > 0, F.greatest(F.lit(1).cast("bigint"), round_half_up(mean)))


def population_band(people: Column) -> Column:
    """Labels and borders of the five bands."""
    return F.when(people.isNull(), "non-disponibile").when(people < 1000, "meno-di-1.000").when(people < 5000, "1.000-4.999").when(people < 20000, "5.000-19.999").otherwise("20.000-o-piu")


def external_url(text: Column) -> Column:
    """https:// before a bare host; other schemes are null."""
    t = F.trim(text)
    return F.when(t.rlike(r"(?i)^https?://[^\s/]+\.[^\s/]+"), t).when(~t.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:") & t.rlike(r"^[^\s/]+\.[^\s/]+"), F.concat(F.lit("https://"), t))


def yes_no(text: Column) -> Column:
    flag = F.upper(F.trim(text))
    return F.when(flag == "S", True).when(flag == "N", False)


def freshness(at: Column, now: Column, stale_after: Column) -> Column:
    """unknown, fresh or stale; more than five minutes ahead is unknown, as is a missing time or threshold. Ages count whole seconds of the clock: fractions of both times are cut off first."""
    age = F.timestamp_diff("SECOND", F.date_trunc("second", at), F.date_trunc("second", now))
    return F.when(at.isNull() | stale_after.isNull() | (age < -300), "unknown").when(age > stale_after, "stale").otherwise("fresh")


def month_name(number: Column) -> Column:
    return F.when(number.between(1, 12), F.element_at(F.array(*map(F.lit, MONTHS)), F.least(F.greatest(number, F.lit(1)), F.lit(12)).cast("int")))


def month_number(name: Column) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.trim(name))), F.lit(0)).cast("int")


def completed_month(year: Column, month: Column, latest: Column, observed: Column) -> Column:
    """False for the month that is still filling: the latest of the observation's own year; unknown dates count as that."""
    return ~(month.eqNullSafe(latest) & F.coalesce(F.year(observed) == year, F.lit(True)))


def availability(year: Column, collected: list[int], published_until: int) -> Column:
    return F.when(year.isin(*collected), "available").when(year >= published_until, "not-yet-published").otherwise("not-collected")


def polygon_area(ring: Column) -> Column:
    """Shoelace area of a ring of (x, y) structs."""
    n = F.size(ring)
    terms = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(ring, i)["x"] * F.element_at(ring, i % n + 1)["y"] - F.element_at(ring, i % n + 1)["x"] * F.element_at(ring, i)["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)) / 2


def italian_number(amount: Column, digits: int) -> Column:
    """Points between groups of three, a comma before the given digits; halves away from zero."""
    shown = F.format_number(F.round(F.abs(amount).cast("decimal(30,6)"), digits), digits)
    return F.concat(F.when(amount < 0, "-").otherwise(""), F.translate(shown, ",.", ".,"))


def exact_euro(amount: Column) -> Column:
    return F.concat(italian_number(amount, 0), F.lit(" €"))


def compact_euro(amount: Column, reference: Column | None = None) -> Column:
    """Billions, millions or euros, by the size of the amount or of a reference (a table's largest)."""
    size = F.abs(amount if reference is None else reference)
    billions, millions = F.concat(italian_number(amount / 1e9, 2), F.lit(" mld €")), F.concat(italian_number(amount / 1e6, 1), F.lit(" mln €"))
    return F.when(size >= 1e9, billions).when(size >= 1e6, millions).otherwise(exact_euro(amount))


def percent_text(value: Column, digits: int = 1) -> Column:
    return F.concat(italian_number(value, digits), F.lit("%"))


def period_kind(year: Column, month: Column, now: Column) -> Column:
    """What a request selects: latest, year, month, or invalid (a month without a year, or out of range)."""
    return (
        F.when(year.isNull() & month.isNull(), "latest").when(year.isNull() | (year < 2000) | (year > now + 1), "invalid")
        .when(month.isNull(), "year").when(month.between(1, 12), "month").otherwise("invalid")
    )


def territorial_level(code: Column, asked: Column) -> Column:
    """region, province or municipality by the length of a code; else municipality where something else is asked."""
    n = F.length(code)
    return F.when(n == 2, "region").when(n == 3, "province").when((n == 6) | asked, "municipality").otherwise("region")


def release_of(title: Column, prefix: str) -> Column:
    """Struct kind, year, month of a release's title, by fixed patterns: '2024/03 - prefix' or '2024 - prefix Consuntivo'; else of nulls."""
    final, monthly = rf"^(20\d\d) - {prefix} Consuntivo$", rf"^(20\d\d)/(0[1-9]|1[0-2]) - {prefix}$"
    year = F.coalesce(F.nullif(F.regexp_extract(title, final, 1), F.lit("")), F.nullif(F.regexp_extract(title, monthly, 1), F.lit("")))
    kind = F.when(title.rlike(final), "consuntivo").when(title.rlike(monthly), "mensile")
    month = F.nullif(F.regexp_extract(title, monthly, 2), F.lit("")).cast("int")
    return F.struct(kind.alias("kind"), year.cast("int").alias("year"), month.alias("month"))


def product_code(kind: Column, month: Column, suffix: str) -> Column:
    """Code (fixed values) under which a release is published; null without a kind, or a month where it needs one."""
    monthly = F.concat(F.lit("PBS_SPE_M"), F.lpad(month.cast("string"), 2, "0"), F.lit(f"_{suffix}_001"))
    return F.when(kind == "consuntivo", F.lit(f"PBS_SPE_RND_{suffix}_001")).when(kind == "mensile", monthly)


def works(rows: DataFrame) -> DataFrame:
    """Public works by number: funding secured, planned and actual cost, change in basis points (null unless both are positive), what is to find."""
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("cents"))), F.lit(0))
    found = rows.groupBy("number").agg(
        F.sum("cents").alias("actual"), part(F.col("flag") != "R").alias("planned"), part(F.col("flag") == "A").alias("secured"), F.max("day").alias("planned_end"),
        F.when(F.bool_and(F.col("status") == "F"), "C").alias("status"), F.count_if(F.col("flag") == "N").alias("open"),
    )
    both = (F.col("planned") > 0) & (F.col("actual") > 0)
    change = F.when(both, basis_points(F.col("actual") - F.col("planned"), F.col("planned")))
    return found.withColumn("change_bp", change).withColumn("to_find", F.greatest(F.col("actual") - F.col("secured"), F.lit(0)))


def work_signals(warnings: Column, status: Column, planned_end: Column, actual_end: Column, observed: Column, change_bp: Column, to_find: Column) -> Column:
    """Screening signals of a public work, in fixed order."""
    late = (F.coalesce(status, F.lit("")) != "C") & (planned_end < observed) & actual_end.isNull()
    return F.array_compact(F.array(F.when(F.size(warnings) > 0, "data-quality"), F.when(late, "schedule-check"), F.when(change_bp >= 1000, "cost-growth"), F.when(to_find > 0, "funding-gap")))


def canonical_json(*columns: str) -> Column:
    """JSON of a row with its keys in order."""
    return F.to_json(F.struct(*sorted(columns)))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
