"""Scalar functions over texts made from the given tables, each with SQL of its own: a function that goes wrong changes a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from civicframe.functions import scalars as X
from civicframe.plans.queries import query
from civicframe.plans.roles import movements, read
from civicframe.sources.readers import simplified

#: Texts for the number grammars, made of the keys of parts; the same expression in Spark and in SQL.
_A, _B, _C = "CAST(i % 1000 AS STRING)", "lpad(CAST(i * 13 % 97 AS STRING), 2, '0')", "lpad(CAST(i * 7 % 1000 AS STRING), 3, '0')"
NUMBERS = f"""CASE i % 24 WHEN 0 THEN '' WHEN 1 THEN ' ' WHEN 2 THEN {_A} WHEN 3 THEN '-' || {_A} WHEN 4 THEN lpad({_A}, 5, '0') WHEN 5 THEN {_A} || ',' || {_B}
    WHEN 6 THEN '-' || {_A} || ',' || {_B} WHEN 7 THEN {_A} || '.' || substr({_B}, 1, 1) WHEN 8 THEN {_A} || '.' || {_B} WHEN 9 THEN '-' || {_A} || '.' || {_B}
    WHEN 10 THEN {_A} || '.' || {_C} WHEN 11 THEN {_A} || '.' || {_C} || ',' || {_B} WHEN 12 THEN '€ ' || {_A} || '.' || {_C} WHEN 13 THEN '€' || {_A} || ',' || substr({_B}, 1, 1) || ' '
    WHEN 14 THEN {_A} || ' ' || {_C} WHEN 15 THEN {_A} || ',' || {_C} || {_B} WHEN 16 THEN 'abc' || {_A} WHEN 17 THEN {_A} || 'e3' WHEN 18 THEN {_A} || '.' WHEN 19 THEN ',' || {_B}
    WHEN 20 THEN {_A} || ',' || {_B} || ',' || {_C} WHEN 21 THEN '--' || {_A} WHEN 22 THEN '+' || {_A} ELSE {_A} || '.' || {_C} || {_B} END"""
#: Texts for codes, dates, names and addresses, made of the keys and dates of orders.
_K, _D = "CAST(i AS STRING)", "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_YMD = f"substr({_D}, 9, 2) || '/' || substr({_D}, 6, 2) || '/' || substr({_D}, 1, 4)"
_MONTHS = ", ".join(f"'{m}'" for m in X.MONTHS)
TEXTS = f"""CASE i % 36 WHEN 0 THEN '' WHEN 1 THEN ' ' WHEN 2 THEN '###' WHEN 3 THEN '#a' || {_K} WHEN 4 THEN ' a  ' || {_K} WHEN 5 THEN 'c72e1' || lpad({_K}, 10, '0')
    WHEN 6 THEN ' C72E1' || lpad({_K}, 10, '0') || ' ' WHEN 7 THEN 'C72E1' || lpad({_K}, 9, '0') WHEN 8 THEN '[' || {_K} || ']' WHEN 9 THEN '[' || {_K} WHEN 10 THEN {_K} || ']' WHEN 11 THEN lpad({_K}, 6, '0')
    WHEN 12 THEN {_K} WHEN 13 THEN {_D} WHEN 14 THEN substr({_D}, 1, 8) || '31' WHEN 15 THEN {_YMD} WHEN 16 THEN '31' || substr({_YMD}, 3) WHEN 17 THEN '1900-01-01' WHEN 18 THEN '00/01/1900'
    WHEN 19 THEN {_D} || 'T10:00:00' WHEN 20 THEN '18' || substr({_D}, 3) WHEN 21 THEN 'www.c' || {_K} || '.it' WHEN 22 THEN 'http://a' || {_K} || '.it/x' WHEN 23 THEN 'HTTPS://B' || {_K} || '.it'
    WHEN 24 THEN 'ftp://c' || {_K} || '.it' WHEN 25 THEN 'mailto:x' || {_K} || '@y.it' WHEN 26 THEN 'nodots' || {_K} WHEN 27 THEN 'd.it/path?q=' || {_K} WHEN 28 THEN 'S' WHEN 29 THEN 'n' WHEN 30 THEN ' s '
    WHEN 31 THEN 'SI' WHEN 32 THEN upper(split_part('{",".join(X.MONTHS)}', ',', 1 + CAST(i % 12 AS INT))) WHEN 33 THEN ' ' || split_part('{",".join(X.MONTHS)}', ',', 1 + CAST(i % 7 AS INT)) || ' '
    WHEN 34 THEN 'agost' ELSE 'a' || chr(160) || {_K} END"""
_N, _T = f"WITH t AS (SELECT p_partkey AS i, {NUMBERS.replace('i *', 'p_partkey *').replace('i %', 'p_partkey %')} AS s FROM part)", f"WITH t AS (SELECT i, {TEXTS} AS s FROM (SELECT o_orderkey AS i, o_orderdate FROM orders))"


def texts_of(spark, sf_dir, texts: str) -> DataFrame:
    """i and s: a text for each part (NUMBERS) or order (TEXTS)."""
    if texts is NUMBERS:
        return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("i")).select("i", F.expr(texts).alias("s"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), "o_orderdate").select("i", F.expr(texts).alias("s"))


def literal(name: str, texts: str, sql: str):
    """Registers columns over the texts of a table."""

    def register(columns):
        def build(spark, sf_dir):
            return texts_of(spark, sf_dir, texts).select("i", "s", *[c.alias(n) for n, c in columns(F.col("s")).items()])

        query(name, f"{_N if texts is NUMBERS else _T} SELECT i, s, {sql} FROM t", roles=False)(build)
        return columns

    return register


def _money(match: str, text: str, scale: str = "100", kind: str = "DECIMAL(30,8)") -> str:
    return f"CASE WHEN regexp_full_match({match}) THEN CAST(round(TRY_CAST({text} AS {kind}) * {scale}, 0) AS BIGINT) END"


# --- money and numbers ----------------------------------------------------------------------------------------------

_EUROS = "CAST(trunc(n / 100) AS BIGINT)"


@query(
    "x03_euro_and_head",
    """WITH t AS (SELECT p_partkey AS k, CAST(p_partkey * 37 - 5000 AS BIGINT) AS n, CASE
        WHEN p_partkey % 9 > 1 THEN CAST(p_partkey % 9 * 100 AS BIGINT) WHEN p_partkey % 9 = 1 THEN 0 END AS people FROM part),
        h AS (SELECT *, CASE WHEN people > 0 THEN n // people - CASE
        WHEN n < 0 AND n % people <> 0 AND n // people * people > n THEN 1 ELSE 0 END END AS low FROM t),
        r AS (SELECT *, n - low * people AS rest FROM h)
        SELECT k, CAST(CAST(n AS DECIMAL(20,0)) / 100 AS DECIMAL(20,2)) AS euros,
        CAST(CAST(low + CASE WHEN 2 * rest > people OR 2 * rest = people AND low % 2 <> 0 THEN 1 ELSE 0 END AS DECIMAL(20,0)) / 100 AS
        DECIMAL(20,2)) AS head FROM r""",
    roles=False,
)
def euro_and_head(spark, sf_dir):
    """Cents as euros, and a head's share with halves to even; without people there is none."""
    key = F.col("p_partkey")
    n = (key * 37 - 5000).cast("bigint")
    people = F.when(key % 9 > 1, (key % 9 * 100).cast("bigint")).when(key % 9 == 1, F.lit(0))
    return read(spark, sf_dir, "part").select(key.alias("k"), X.euro(n).alias("euros"), X.per_capita_even(n, people).alias("head"))


@literal(
    "x04_x05_x08_x09_x10_cents", NUMBERS,
    f"""{_money("s, '[0-9][0-9.]*(,[0-9]+)?'", "replace(replace(s, '.', ''), ',', '.')")} AS italian,
        {_money("s, '-?[0-9][0-9.]*(,[0-9]+)?'", "replace(replace(s, '.', ''), ',', '.')")} AS italian_signed,
        greatest(CAST(round(TRY_CAST(CASE WHEN regexp_full_match(s, '-?[0-9]+([.][0-9]+)?') THEN s END AS DECIMAL(20,6)) * 100, 0) AS BIGINT), 0) AS floored,
        CASE WHEN regexp_full_match(s, '-?[0-9]+[.][0-9]{{2}}') THEN CAST(TRY_CAST(replace(s, '.', '') AS BIGINT) AS BIGINT) END AS exact,
        CASE WHEN regexp_full_match(trim(s), '[0-9]+') THEN CAST(TRY_CAST(trim(s) || '00' AS BIGINT) AS BIGINT) END AS whole,
        CASE WHEN regexp_full_match(trim(s), '-?[0-9]+') THEN CAST(TRY_CAST(trim(s) || '00' AS BIGINT) AS BIGINT) END AS whole_signed,
        CASE WHEN regexp_full_match(s, '-?[0-9]+([.][0-9]{{1,2}})?') THEN CAST(TRY_CAST(split_part(s, '.', 1) || rpad(split_part(s, '.', 2), 2, '0') AS BIGINT) AS BIGINT) END AS point""",
)
def money(s: Column) -> dict:
    number = F.when(s.rlike(r"^-?[0-9]+([.][0-9]+)?$"), s).try_cast("decimal(20,6)")
    return {
        "italian": X.italian_cents(s), "italian_signed": X.italian_cents(s, signed=True), "floored": X.floor_zero_cents(number), "exact": X.exact_cents(s),
        "whole": X.whole_euro_cents(s), "whole_signed": X.whole_euro_cents(s, signed=True), "point": X.point_cents(s),
    }


_PAID = "TRY_CAST(regexp_replace(regexp_replace(s, '[\\s]', '', 'g'), '^([^,]*),', '\\1.') AS DECIMAL(20,2))"


@literal(
    "x11_x12_x13_x14_decimals", NUMBERS,
    f"""CAST(CASE WHEN regexp_full_match(s, '-?[0-9]+(,[0-9]+)?') THEN TRY_CAST(replace(s, ',', '.') AS DECIMAL(30,6)) END AS DECIMAL(30,6)) AS signed,
        CASE WHEN regexp_matches(s, 'e') THEN NULL ELSE {_PAID} END AS payment, coalesce(CASE WHEN regexp_matches(s, 'e') THEN NULL ELSE {_PAID} END, 0) AS lenient,
        CASE WHEN regexp_full_match(s, '-?[0-9]+(,[0-9]+)?') AND abs(TRY_CAST(replace(s, ',', '.') AS DECIMAL(30,6))) <= 1000
            THEN CAST(round(TRY_CAST(replace(s, ',', '.') AS DECIMAL(30,6)) * 100, 0) AS BIGINT) END AS points""",
)
def decimals(s: Column) -> dict:
    plain = F.when(~s.contains("e"), s)
    return {"signed": X.comma_decimal(s), "payment": X.payment_amount(plain), "lenient": X.lenient_number(plain), "points": X.checked_points(X.comma_decimal(s), 1000)}


@query(
    "x15_x16_rounding",
    """WITH t AS (SELECT p_partkey AS k, CAST(p_partkey * 5 - 777 AS BIGINT) AS n, CAST(p_partkey % 7 AS BIGINT) AS d FROM part)
        SELECT k, CAST(CASE WHEN d > 0 THEN sign(n) * ((2 * abs(n) + d) // (2 * d)) END AS BIGINT) AS away, CASE
        WHEN d > 0 THEN CAST(floor(CAST(n AS DOUBLE) / d + 0.5) AS BIGINT) END AS up FROM t""",
    roles=False,
)
def rounding(spark, sf_dir):
    """Halves away from zero, and toward plus infinity: they differ below zero."""
    n, d = (F.col("p_partkey") * 5 - 777).cast("bigint"), (F.col("p_partkey") % 7).cast("bigint")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), X.round_half_away(n, d).alias("away"), X.round_half_up(F.try_divide(n.cast("double"), d.cast("double"))).alias("up"))


@literal(
    "x01_x06_x07_x11_numbers", NUMBERS,
    """CASE WHEN TRY_CAST(replace(replace(replace(s, ' ', ''), '.', ''), ',', '.') AS DOUBLE) > 1
            THEN CAST(round_even(TRY_CAST(replace(replace(replace(s, ' ', ''), '.', ''), ',', '.') AS DOUBLE), 0) AS BIGINT) END AS people,
        CASE WHEN regexp_matches(s, '^\\d[\\d.]*(,\\d+)?$') THEN CAST(round(TRY_CAST(replace(replace(s, '.', ''), ',', '.') AS DECIMAL(30,6)) * 100, 0) AS BIGINT) END AS italian,
        CAST(round(TRY_CAST(CASE WHEN regexp_matches(regexp_replace(s, '[€\\s]', '', 'g'), '^\\d{1,3}(\\.\\d{3})+(,\\d+)?$') THEN replace(replace(regexp_replace(s, '[€\\s]', '', 'g'), '.', ''), ',', '.')
        WHEN regexp_matches(regexp_replace(s, '[€\\s]', '', 'g'), '^\\d+(,\\d+)?$') THEN replace(regexp_replace(s, '[€\\s]', '', 'g'), ',', '.')
        WHEN regexp_matches(regexp_replace(s, '[€\\s]', '', 'g'), '^\\d+\\.(\\d{1,2}|\\d{4,})$') THEN regexp_replace(s, '[€\\s]', '', 'g') END AS DECIMAL(30,6)) * 100, 0) AS BIGINT) AS grouped,
        CASE WHEN regexp_matches(s, '^\\d+(,\\d+)?$') THEN CAST(round(TRY_CAST(replace(s, ',', '.') AS DECIMAL(28,8)) * 100000000, 0) AS BIGINT) END AS millions,
        CASE WHEN regexp_matches(s, '^-?\\d+\\.\\d{2}$') THEN CAST(TRY_CAST(s AS DECIMAL(20,2)) * 100 AS BIGINT) END AS exact""",
)
def numbers(s: Column) -> dict:
    """Number grammars."""
    return {"people": X.population(s), "italian": X.italian_cents(s), "grouped": X.grouped_cents(s), "millions": X.millions_to_cents(s), "exact": X.exact_cents(s)}


# --- text -----------------------------------------------------------------------------------------------------------

_COMPACT = "trim(regexp_replace(replace(s, chr(160), ' '), '\\s+', ' ', 'g'))"
_CODE = f"CASE WHEN {_COMPACT} <> '' AND NOT regexp_full_match({_COMPACT}, '#+') THEN upper({_COMPACT}) END"


@literal(
    "x02_x18_x20_x22_x25_text", TEXTS,
    f"""coalesce(nullif(regexp_extract(s, '\\d'), ''), '?') AS digit, CASE WHEN {_COMPACT} <> '' AND NOT regexp_matches({_COMPACT}, '^#+$') THEN {_COMPACT} END AS compact,
        CASE WHEN coalesce(TRY_STRPTIME(trim(s), '%d/%m/%Y'), TRY_STRPTIME(trim(s), '%Y-%m-%d')) > DATE '1900-01-01'
            THEN CAST(coalesce(TRY_STRPTIME(trim(s), '%d/%m/%Y'), TRY_STRPTIME(trim(s), '%Y-%m-%d')) AS DATE) END AS day,
        regexp_replace(trim(s), '^\\[|\\]$', '', 'g') AS tax, CASE WHEN length(s) < 6 THEN lpad(s, 6, '0') ELSE s END AS istat""",
)
def texts(s: Column) -> dict:
    """Digits, compact texts, dates, tax codes and codes of places."""
    return {"digit": X.title_digit(s), "compact": X.compact_text(s), "day": X.flexible_date(s), "tax": X.tax_code(s), "istat": X.istat_code(s)}


@literal(
    "x19_x24_x26_codes", TEXTS,
    f"""{_CODE} AS code, CASE WHEN regexp_full_match({_CODE}, '[A-Z]+') THEN {_CODE} END AS letters,
        CASE WHEN length(trim(s)) = 15 AND regexp_full_match(trim(s), '[A-Za-z0-9]+') THEN upper(trim(s)) END AS project, substr(s, 1, 3) AS province""",
)
def codes(s: Column) -> dict:
    return {"code": X.normalized_code(s), "letters": X.normalized_code(s, "^[A-Z]+$"), "project": X.cup(s), "province": X.province_code(s)}


_ISO = "CASE WHEN regexp_matches(s, '^(19|20|21)\\d\\d-\\d\\d-\\d\\d') THEN CAST(TRY_STRPTIME(substr(s, 1, 10), '%Y-%m-%d') AS DATE) END"


@literal("x21_checked_dates", TEXTS, f"{_ISO} AS day, CASE WHEN {_ISO} IS NULL AND trim(s) <> '' THEN 'end: ' || s END AS warning")
def dates(s: Column) -> dict:
    found = X.checked_date(s, "end")
    return {"day": found["date"], "warning": found["warning"]}


_HEADER = "CASE i % 5 WHEN 0 THEN chr(65279) || 'Cod. ' || n || ' ' WHEN 1 THEN '  ' || upper(n) WHEN 2 THEN n || '  x' || chr(9) || 'y' WHEN 3 THEN 'già_' || n ELSE '' END"


@query("x23_headers", f"""WITH t AS (SELECT i, {_HEADER} AS s FROM (SELECT p_partkey AS i, p_name AS n FROM part)) SELECT i, s,
        regexp_replace(lower(trim(regexp_replace(replace(s, chr(65279), ''), '\\s+', ' ', 'g'))), ' ', '_', 'g') AS name FROM t""", roles=False)
def headers(spark, sf_dir):
    """Names of columns as a reader makes them, from the names of parts."""
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.col("p_name").alias("n"))
    return rows.select("i", F.expr(_HEADER.replace("chr(65279)", "'\ufeff'")).alias("s")).select("i", "s", X.header_key(F.col("s")).alias("name"))


_PLACE = """CASE i % 6 WHEN 0 THEN 'COMUNE DI ' || a || ' NELL' || chr(39) || b WHEN 1 THEN 'SAN ' || a || chr(39) || ' DI ' || b WHEN 2 THEN 'comune di  ' || a || '-' || b WHEN 3 THEN 'L' || chr(39) || a
    WHEN 4 THEN 'CITTÀ DELLA ' || b || ' E ' || a ELSE 'DI ' || a || ' IN DEGLI' END"""
_PLACES = "SELECT c_custkey AS i, c_mktsegment AS a, replace(upper(n_name), '_', '') AS b FROM customer JOIN nation ON c_nationkey = n_nationkey"
_HIGH = "upper(substr({0}, 1, 1)) || substr({0}, 2)"
_PARTICLES = ", ".join(f"'{w}'" for w in X.PARTICLES)


@query(
    "x28_names",
    f"""WITH t AS (SELECT i, {_PLACE} AS s FROM ({_PLACES})), w AS (SELECT i, s, string_split_regex(lower(regexp_replace(trim(s), '(?i)^comune di\\s+', '')), '\\s+') AS ws FROM t)
        SELECT i, s, array_to_string(list_transform(ws, lambda w, k: CASE WHEN k > 1 AND list_contains([{_PARTICLES}], regexp_replace(w, '[.'']', '', 'g')) THEN w
            ELSE array_to_string(list_transform(string_split(array_to_string(list_transform(string_split(w, ''''), lambda p: {_HIGH.format('p')}), ''''), '-'), lambda p: {_HIGH.format('p')}), '-') END), ' ') AS name FROM w""",
    roles=False,
)
def names(spark, sf_dir):
    """Registry capitals to names, made of segments and nations."""
    rows = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.col("c_custkey").alias("i"), F.col("c_mktsegment").alias("a"), F.replace(F.upper("n_name"), F.lit("_"), F.lit("")).alias("b"))
    return rows.select("i", F.expr(_PLACE).alias("s")).select("i", "s", X.municipality_name(F.col("s")).alias("name"))


@literal(
    "x31_x32_addresses_and_flags", TEXTS,
    """CASE WHEN regexp_matches(trim(s), '^[hH][tT][tT][pP][sS]?://[^\\s/]+[.][^\\s/]+') THEN trim(s)
        WHEN NOT regexp_matches(trim(s), '^[a-zA-Z][a-zA-Z0-9+.-]*:') AND regexp_matches(trim(s), '^[^\\s/]+[.][^\\s/]+') THEN 'https://' || trim(s) END AS url,
        CASE upper(trim(s)) WHEN 'S' THEN true WHEN 'N' THEN false END AS flag""",
)
def addresses(s: Column) -> dict:
    return {"url": X.external_url(s), "flag": X.yes_no(s)}


@literal("x36_month_numbers", TEXTS, f"nullif(list_position([{_MONTHS}], lower(trim(s))), 0) AS number, [{_MONTHS}][length(s)] AS name")
def month_numbers(s: Column) -> dict:
    return {"number": X.month_number(s), "name": X.month_name(F.length(s))}


#: The search key of a column in SQL.
FOLD_SQL = r"trim(regexp_replace(strip_accents(lower(translate({0}, '’‘´`–—', '''''''''--'))), '\s+', ' ', 'g'))"
_WIDE = "０１２３４５６７８９"
_FOLDED = """CASE i % 8 WHEN 0 THEN 'L’' || n WHEN 1 THEN 'L''' || upper(n) WHEN 2 THEN 'l`' || n || ' – centro' WHEN 3 THEN translate(CAST(i AS STRING), '0123456789', '０１２３４５６７８９') || n
    WHEN 4 THEN 'ﬁ' || n || 'ﬀ' WHEN 5 THEN 'Forlì—' || n WHEN 6 THEN 'forli-' || n ELSE ' ' || n || '   é  ' END"""


@query(
    "f04_x27_folded_search",
    f"""WITH t AS (SELECT i, {_FOLDED} AS s FROM (SELECT p_partkey AS i, p_name AS n FROM part)),
        k AS (SELECT i, s, {FOLD_SQL.format(f"translate(replace(replace(s, 'ﬁ', 'fi'), 'ﬀ', 'ff'), '{_WIDE}', '0123456789')")} AS key FROM t)
        SELECT i, s, key, starts_with(key, 'l''') OR contains(key, ' l''') AS found FROM k""",
    roles=False,
)
def folded_search(spark, sf_dir):
    """One key for accents, case, full-width and joined letters, apostrophes and dashes, over the names of parts."""
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.col("p_name").alias("n"))
    key = X.search_key(F.col("s"))
    rows = rows.select("i", F.expr(_FOLDED.replace("''", "\\'")).alias("s"))
    return rows.select("i", "s", key.alias("key"), F.contains(F.concat(F.lit(" "), key), F.concat(F.lit(" "), X.search_key(F.lit("L´")))).alias("found"))


# --- records --------------------------------------------------------------------------------------------------------


@query(
    "x29_implied_people",
    """WITH t AS (SELECT c_custkey AS k, CAST(floor(c_acctbal) AS BIGINT) AS total, CASE
        WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 7 END AS each, c_custkey % 5 AS other FROM customer),
        r AS (SELECT k, CASE WHEN total > 0 AND each > 0 THEN CAST(total AS DOUBLE) / each END AS a, CASE
        WHEN total > 0 AND other > 0 THEN CAST(2 * total AS DOUBLE) / other END AS b FROM t)
        SELECT k, CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN greatest(1, CAST(floor((coalesce(a, 0.0) + coalesce(b, 0.0)) / (CASE
        WHEN a IS NULL THEN 0 ELSE 1 END + CASE WHEN b IS NULL THEN 0 ELSE 1 END) + 0.5) AS BIGINT)) END AS people FROM r""",
    roles=False,
)
def implied(spark, sf_dir):
    """People from totals and amounts a head, where these allow it."""
    k, total = F.col("c_custkey"), F.floor("c_acctbal").cast("bigint")
    pairs = [(total, F.when(k % 3 == 0, F.lit(0)).otherwise(k % 7)), (2 * total, k % 5)]
    return read(spark, sf_dir, "customer").select(k.alias("k"), X.implied_population(pairs).alias("people"))


@query(
    "x37_x38_work_signals",
    """+ w AS (SELECT number, CAST(sum(cents) AS BIGINT) AS actual, CAST(coalesce(sum(cents) FILTER (flag <> 'R'), 0) AS BIGINT) AS planned,
            CAST(coalesce(sum(cents) FILTER (flag = 'A'), 0) AS BIGINT) AS secured, max(day) AS planned_end, CASE
        WHEN bool_and(status = 'F') THEN 'C' END AS status, count(*) FILTER (flag = 'N') AS n FROM mov GROUP BY number),
        s AS (SELECT *, CASE WHEN planned > 0 AND actual > 0 THEN CAST(round(CAST(actual - planned AS DOUBLE) * 10000 / planned,
        0) AS BIGINT) END AS change_bp, greatest(actual - secured, 0) AS to_find FROM w)
        SELECT number, secured, planned, actual, change_bp, array_to_string(list_filter([CASE WHEN n = 7 THEN 'data-quality' END, CASE
        WHEN coalesce(status, '') <> 'C' AND planned_end < DATE '1999-01-01' THEN 'schedule-check' END,
            CASE WHEN change_bp >= 1000 THEN 'cost-growth' END, CASE
        WHEN to_find > 0 THEN 'funding-gap' END], lambda x: x IS NOT NULL), ',') AS signals FROM s""",
)
def public_works(spark, sf_dir):
    """Funding, planned and actual cost of every work, and what to look at."""
    none = F.array().cast("array<string>")
    works = X.works(movements(spark, sf_dir))
    warned = F.when(F.col("open") == 7, F.array(F.lit("doubtful"))).otherwise(none)
    signals = X.work_signals(warned, F.col("status"), F.col("planned_end"), F.lit(None).cast("date"), F.lit("1999-01-01").cast("date"), F.col("change_bp"), F.col("to_find"))
    return works.select("number", "secured", "planned", "actual", "change_bp", F.array_join(signals, ",").alias("signals"))


_DOTS = "translate(format('{{:,}}', CAST({0} AS BIGINT)), ',', '.')"
_SIGN = "CASE WHEN v < 0 THEN '-' ELSE '' END"


def _italian(n: str, digits: int, unit: str) -> str:
    """SQL: a whole number of the last digit, shown with that many digits after a comma."""
    tail = "" if not digits else f" || ',' || lpad(CAST({n} % {10**digits} AS VARCHAR), {digits}, '0')"
    return f"{_SIGN} || {_DOTS.format(f'{n} // {10**digits}')}{tail} || ' {unit}'"


_BILLIONS, _MILLIONS, _PLAIN = _italian("((abs(v) + 5000000) // 10000000)", 2, "mld €"), _italian("((abs(v) + 50000) // 100000)", 1, "mln €"), _italian("abs(v)", 0, "€")


@query(
    "x39_formats",
    f"""WITH t AS (SELECT o_orderkey AS i, CAST((CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE 1 END) * (o_orderkey % 100000) * (CASE o_orderkey % 4 WHEN 0 THEN 1000 WHEN 1 THEN 10000 WHEN 2 THEN 1000000 ELSE 100000000 END) AS BIGINT) AS v FROM orders)
        SELECT i, CAST(v AS DOUBLE) AS v, {_PLAIN} AS exact, CASE WHEN abs(v) >= 1000000000 THEN {_BILLIONS} WHEN abs(v) >= 1000000 THEN {_MILLIONS} ELSE {_PLAIN} END AS own,
        {_BILLIONS} AS like_billions, {_DOTS.format("(i % 90000 * 10 + 4) // 80")} || ',' || ((i % 90000 * 10 + 4) // 8) % 10 || '%' AS pct FROM t""",
    roles=False,
)
def formats(spark, sf_dir):
    """Italian notation of amounts and shares; a table takes its unit from its largest figure."""
    i = F.col("i")
    size = F.when(i % 4 == 0, 1000).when(i % 4 == 1, 10_000).when(i % 4 == 2, 1_000_000).otherwise(100_000_000)
    v = (F.when(i % 5 == 0, -1).otherwise(1) * (i % 100_000) * size).cast("double")
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i")).withColumn("v", v)
    share = (i % 90_000).cast("double") / 8
    return rows.select("i", "v", X.exact_euro(F.col("v")).alias("exact"), X.compact_euro(F.col("v")).alias("own"), X.compact_euro(F.col("v"), F.lit(2e9)).alias("like_billions"), X.percent_text(share).alias("pct"))


@query("x40_k05_digests", """SELECT n_nationkey AS region, sha256(n_name) AS sha, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}' AS json,
    sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}') AS json_sha FROM nation""", roles=False)  # fmt: skip
def digests(spark, sf_dir):
    """Digests of values and of canonical JSON."""
    json = X.canonical_json("n_nationkey", "n_name")
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("region"), F.sha2("n_name", 256).alias("sha"), json.alias("json"), F.sha2(json, 256).alias("json_sha"))


@query(
    "x40_crc32",
    """SELECT c_custkey AS i, c_name AS s, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(c_name, ''), lambda x: CAST(ord(x) AS BIGINT))),
        lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda k: CAST(-1 AS BIGINT))), lambda r, k: xor(r >> 1, CASE WHEN r % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END))), 4294967295) AS BIGINT) AS crc FROM customer""",
    roles=False,
)
def checksums(spark, sf_dir):
    """Checksums of names; SQL divides by the polynomial bit by bit."""
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), F.col("c_name").alias("s"), F.crc32(F.encode("c_name", "UTF-8")).alias("crc"))


@query(
    "x42_geometry",
    """WITH t AS (SELECT p_partkey AS i, CAST(10 + p_partkey % 90 AS DOUBLE) AS w, CAST(10 + p_size AS DOUBLE) AS h, CAST(p_partkey % 11 AS DOUBLE) / 8 AS e FROM part)
        SELECT i, round(w * h - w * e / 2, 6) AS area, CAST(4 + CASE WHEN e > 0.5 THEN 1 ELSE 0 END AS INT) AS points FROM t""",
    roles=False,
)
def geometry(spark, sf_dir):
    """Areas of rectangles with a dent as large as the parts say, and how many points are left at a tolerance of one half."""
    i, w, h, e = F.col("i"), F.col("w"), F.col("h"), F.col("e")
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), (10 + F.col("p_partkey") % 90).cast("double").alias("w"), (10 + F.col("p_size")).cast("double").alias("h"), ((F.col("p_partkey") % 11).cast("double") / 8).alias("e"))
    zero = F.lit(0.0)
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((zero, zero), (w / 2, e), (w, zero), (w, h), (zero, h))])
    rows = rows.withColumn("ring", ring)
    return rows.select(i, F.round(X.polygon_area(F.col("ring")), 6).alias("area"), F.size(simplified(F.col("ring"), 0.5)).alias("points"))


@query("x43_availability", """SELECT DISTINCT year, CASE WHEN year IN (1996, 1998, 2000) THEN 'available'
        WHEN year >= 2000 THEN 'not-yet-published' ELSE 'not-collected' END AS state FROM mov""")
def available(spark, sf_dir):
    return movements(spark, sf_dir).select("year").distinct().select("year", X.availability(F.col("year"), [1996, 1998, 2000], 2000).alias("state"))


@query(
    "x44_periods",
    """WITH t AS (SELECT o_orderkey AS i, CAST(CASE WHEN o_orderkey % 7 > 0 THEN year(o_orderdate) END AS INT) AS year, CAST(CASE WHEN o_orderkey % 2 = 0 THEN month(o_orderdate) + o_orderkey % 3 - 1 END AS INT) AS month FROM orders)
        SELECT i, year, month, CASE WHEN year IS NULL AND month IS NULL THEN 'latest' WHEN year IS NULL THEN 'invalid' WHEN year < 2000 OR year > 2001 THEN 'invalid'
        WHEN month IS NULL THEN 'year' WHEN month BETWEEN 1 AND 12 THEN 'month' ELSE 'invalid' END AS kind FROM t""",
    roles=False,
)
def periods(spark, sf_dir):
    """What a request's year and month select, both taken from orders: some lack one, some months are out of range."""
    i = F.col("o_orderkey")
    year = F.when(i % 7 > 0, F.year("o_orderdate"))
    month = F.when(i % 2 == 0, F.month("o_orderdate") + i % 3 - 1).cast("int")
    rows = read(spark, sf_dir, "orders").select(i.alias("i"), year.alias("year"), month.alias("month"))
    return rows.select("i", "year", "month", X.period_kind(F.col("year"), F.col("month"), F.lit(2000)).alias("kind"))


@query(
    "x45_levels",
    """SELECT c_custkey AS k, CASE length(CAST(c_custkey AS VARCHAR)) WHEN 2 THEN 'region' WHEN 3 THEN 'province' WHEN 6 THEN 'municipality'
        ELSE CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'municipality' ELSE 'region' END END AS level FROM customer""",
    roles=False,
)
def levels(spark, sf_dir):
    """Territorial level by the length of a code, else by what else is asked."""
    code = F.col("c_custkey").cast("string")
    asked = F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), X.territorial_level(code, asked).alias("level"))


# --- releases and documents -----------------------------------------------------------------------------------------

#: Dimensions of the payment releases, with the prefix of their titles and the suffix of their codes.
DIMENSIONS = {"missions": ("Pagamenti per missione", "MIS"), "titles": ("Pagamenti per titolo", "TIT")}


@query(
    "x35_s10_release_identity",
    """+ d(dimension, prefix, suffix) AS (VALUES ('missions', 'Pagamenti per missione', 'MIS'), ('titles', 'Pagamenti per titolo', 'TIT')),
        p AS (SELECT DISTINCT year, month FROM mov WHERE year >= 2000),
        t AS (SELECT d.*, year, month, CASE WHEN month = 12 THEN year || ' - ' || prefix || ' Consuntivo'
        WHEN month = 5 THEN year || '/' || month || ' - ' || prefix ELSE year || '/' || lpad(CAST(month AS VARCHAR), 2,
        '0') || ' - ' || prefix END AS title FROM p, d)
        SELECT title, dimension, CASE WHEN month = 12 THEN 'consuntivo' WHEN month <> 5 THEN 'mensile' END AS kind, CASE
        WHEN month <> 5 THEN year END AS year, CASE WHEN month NOT IN (5, 12) THEN month END AS month,
        CASE WHEN month = 12 THEN 'PBS_SPE_RND_' || suffix || '_001'
        WHEN month <> 5 THEN 'PBS_SPE_M' || lpad(CAST(month AS VARCHAR), 2, '0') || '_' || suffix || '_001' END AS code FROM t""",
)
def release_identity(spark, sf_dir):
    """Titles of releases, of which those of May are malformed, parsed to kind and period, and the product code of each."""
    periods = movements(spark, sf_dir).filter("year >= 2000").select("year", "month").distinct()
    found = None
    for name, (prefix, suffix) in DIMENSIONS.items():
        year, month = F.col("year").cast("string"), F.col("month").cast("string")
        title = F.when(F.col("month") == 12, F.concat(year, F.lit(f" - {prefix} Consuntivo"))).when(F.col("month") == 5, F.concat_ws("/", year, month)).otherwise(F.concat_ws("/", year, F.lpad(month, 2, "0")))
        title = F.when(F.col("month") == 12, title).otherwise(F.concat(title, F.lit(f" - {prefix}")))
        release = X.release_of(F.col("title"), prefix)
        rows = periods.select(title.alias("title")).select("title", F.lit(name).alias("dimension"), release["kind"].alias("kind"), release["year"].alias("year"), release["month"].alias("month"))
        rows = rows.withColumn("code", X.product_code(F.col("kind"), F.col("month"), suffix))
        found = rows if found is None else found.unionByName(rows)
    return found


_REGISTRY = """+ m AS (SELECT DISTINCT year, month FROM mov), t AS (SELECT 'u/' || year || '/' || month AS document, CASE month % 3 WHEN 0 THEN 'VIII' WHEN 1 THEN ' VIII ' ELSE 'IX' END AS series,
        CASE WHEN month % 5 = 0 THEN 'X' ELSE 'D' END AS type, CAST(month AS VARCHAR) AS number, year || '-' || lpad(CAST(month AS VARCHAR), 2, '0') || '-01' AS presented,
        CASE WHEN month % 3 = 2 OR month % 5 = 0 THEN 'Altro' WHEN month % 2 = 0 THEN 'Rendiconto delle entrate e delle spese del Senato per l''anno finanziario ' || year
        ELSE 'PROGETTO DI  BILANCIO interno del Senato per l''anno finanziario ' || year END AS title FROM m, (VALUES (0), (1)) AS v(k) WHERE k = 0 OR month % 4 = 0)"""


@query(
    "s21_x41_registry",
    _REGISTRY + """, o AS (SELECT *, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS name FROM t WHERE trim(series) = 'VIII' AND trim(type) = 'D')
        SELECT DISTINCT CASE WHEN lower(name) LIKE 'rendiconto%' THEN 'account' ELSE 'budget' END AS kind, CAST(right(name,
        4) AS INT) AS year, CAST(number AS INT) AS number, document, CAST(presented AS DATE) AS presented FROM o""",
)
def registry(spark, sf_dir):
    """Documents of one series, one or two for each month of payments: kind and year from the title, exact repetitions once."""
    from civicframe.sources.readers import registry_documents

    m, year = F.col("month"), F.col("year").cast("string")
    rows = movements(spark, sf_dir).select("year", "month").distinct().withColumn("k", F.explode(F.when(m % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    title = F.when((m % 3 == 2) | (m % 5 == 0), "Altro").when(m % 2 == 0, F.concat(F.lit("Rendiconto delle entrate e delle spese del Senato per l'anno finanziario "), year))
    title = title.otherwise(F.concat(F.lit("PROGETTO DI  BILANCIO interno del Senato per l'anno finanziario "), year))
    rows = rows.select(
        F.concat_ws("/", F.lit("u"), year, m.cast("string")).alias("document"), F.when(m % 3 == 0, "VIII").when(m % 3 == 1, " VIII ").otherwise("IX").alias("series"),
        F.when(m % 5 == 0, "X").otherwise("D").alias("type"), m.cast("string").alias("number"), title.alias("title"), F.make_date("year", "month", F.lit(1)).cast("string").alias("presented"),
    )
    return registry_documents(rows, "VIII", "D")


@query(
    "j12_companion_guard",
    """+ r AS (SELECT DISTINCT year, month, CASE WHEN month = 12 THEN 'consuntivo' ELSE 'mensile' END AS kind FROM mov
        WHERE flag = 'A'), s AS (SELECT DISTINCT year, month, CASE WHEN month >= 11 THEN 'consuntivo' ELSE 'mensile' END AS kind FROM mov
        WHERE flag = 'R')
        SELECT r.year, r.month, CASE WHEN s.year IS NULL THEN 'missing'
        WHEN s.kind <> r.kind THEN 'other kind' ELSE 'companion' END AS state FROM r LEFT JOIN s ON r.year = s.year AND r.month = s.month""",
)
def companions(spark, sf_dir):
    """A release joins another dimension's only when kind, year and month are the same."""
    from civicframe.operators.joins import companion

    rows = movements(spark, sf_dir)
    kind = lambda last: F.when(F.col("month") >= last, "consuntivo").otherwise("mensile").alias("kind")
    one = rows.filter("flag = 'A'").select("year", "month", kind(12)).distinct()
    other = rows.filter("flag = 'R'").select("year", "month", kind(11)).distinct()
    return companion(one, other, ["year", "month"], "kind")


#: Regions of Italy by their statistical code, and the subdivisions of the international standard in the same order.
REGION_CODES = tuple(f"{i:02d}" for i in range(1, 21))
SUBDIVISIONS = ("21", "23", "25", "32", "34", "36", "42", "45", "52", "55", "57", "62", "65", "67", "72", "75", "77", "78", "82", "88")


@query(
    "j13_j15_region_codes",
    f"""+ m(iso, code) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in zip(SUBDIVISIONS, REGION_CODES))}), h AS (SELECT entity,
        'it-' || CAST(entity % 100 AS VARCHAR) AS header FROM ent)
        SELECT entity, code, CASE WHEN code <> '04' THEN 'regione-' || code END AS anchor FROM h LEFT
        JOIN m ON m.iso = upper(substr(header, 4))""",
)
def region_codes(spark, sf_dir):
    """Subdivision to region; a region that is two territories elsewhere has no single anchor."""
    from civicframe.operators.joins import single_valued
    from civicframe.plans.roles import entities

    codes = spark.createDataFrame(list(zip(SUBDIVISIONS, REGION_CODES)), "iso string, code string")
    territories = spark.createDataFrame([(c, f"regione-{c}") for c in REGION_CODES] + [("04", "provincia-04b")], "code string, anchor string")
    header = F.concat(F.lit("it-"), (F.col("entity") % 100).cast("string"))
    rows = entities(spark, sf_dir).select("entity", F.regexp_replace(F.upper(header), "^IT-", "").alias("iso"))
    return rows.join(F.broadcast(codes), "iso", "left").join(F.broadcast(single_valued(territories, "code", "anchor")), "code", "left").select("entity", "code", "anchor")
