"""Scalar functions as column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- protected arithmetic and flags ---------------------------------------------------------------


def safe_divide(numerator, denominator, multiplier: float = 1.0) -> Column:
    """multiplier * a / b where both are present and b > 0, else NULL."""
    a, b = _c(numerator), _c(denominator)
    return F.when(a.isNotNull() & (b > 0), F.lit(multiplier) * a.cast("double") / b.cast("double"))


def positive_flag(x, support: Column | None = None) -> Column:
    """1 if positive, 0 if not; NULL if missing or outside the support."""
    x = _c(x)
    known = x.isNotNull() if support is None else x.isNotNull() & support
    return F.when(known, (x > 0).cast("long"))


def flag_of(condition: Column, inputs) -> Column:
    """The condition as 0/1; NULL as soon as one input is. SQL's own AND would give 0 for false AND NULL."""
    known = F.lit(True)
    for x in inputs:
        known = known & _c(x).isNotNull()
    return F.when(known, condition.cast("long"))


def null_aware_sum(*columns) -> Column:
    """The sum of those present, NULL if none is."""
    cols = [_c(c) for c in columns]
    total = F.coalesce(cols[0], F.lit(0))
    for c in cols[1:]:
        total = total + F.coalesce(c, F.lit(0))
    return F.when(F.coalesce(*cols).isNotNull(), total)


def clamp_share(x, tolerance: float = 1e-12) -> Column:
    """Shares within the tolerance of [0, 1] are set to its ends; those further out stay as they are, to be reported."""
    x = _c(x)
    return F.when((x < 0) & (x >= -tolerance), F.lit(0.0)).when((x > 1) & (x <= 1 + tolerance), F.lit(1.0)).otherwise(x)


def threshold_status(x, warn_below=None, fail_below=None, warn_above=None, fail_above=None) -> Column:
    """fail, warn, pass or na; bounds are strict on both sides."""
    x = _c(x)
    out = F.when(x.isNull() | F.isnan(x.cast("double")), F.lit("na"))
    if fail_below is not None:
        out = out.when(x < fail_below, F.lit("fail"))
    if fail_above is not None:
        out = out.when(x > fail_above, F.lit("fail"))
    if warn_below is not None:
        out = out.when(x < warn_below, F.lit("warn"))
    if warn_above is not None:
        out = out.when(x > warn_above, F.lit("warn"))
    return out.otherwise(F.lit("pass"))


# --- dates and months -----------------------------------------------------------------------------


def yyyymm(d) -> Column:
    d = _c(d)
    return F.year(d) * 100 + F.month(d)


def month_ordinal(key) -> Column:
    """Months since year 0 of a yyyymm key."""
    k = _c(key).cast("int")
    return F.floor(k / 100).cast("int") * 12 + k % 100 - 1


def ordinal_month(ordinal) -> Column:
    """The yyyymm key of a month ordinal."""
    o = _c(ordinal)
    return (F.floor(o / 12) * 100 + o % 12 + 1).cast("int")


def add_months_key(key, n) -> Column:
    return ordinal_month(month_ordinal(key) + (n if isinstance(n, Column) else F.lit(n)))


def parse_month_key(text) -> Column:
    """yyyymm of 'YYYYMM' or 'YYYY-MM'; NULL for others or a month outside 1..12."""
    t = F.trim(_c(text).cast("string"))
    year, month = F.regexp_extract(t, r"^(\d{4})-?(\d{2})$", 1), F.regexp_extract(t, r"^(\d{4})-?(\d{2})$", 2)
    y, m = F.try_to_number(year, F.lit("9999")), F.try_to_number(month, F.lit("99"))
    return F.when((year != "") & m.between(1, 12), (y * 100 + m).cast("int"))


def valid_month_key(key) -> Column:
    k = _c(key)
    return k.isNotNull() & k.between(190001, 220012) & (k % 100).between(1, 12)


def hhmm(x) -> Column:
    """Zero-padded HHMM of a number or text; NULL if it is no time of day."""
    n = _c(x).cast("string").try_cast("int")
    return F.when((n >= 0) & (n <= 2359) & (n % 100 < 60), F.lpad(n.cast("string"), 4, "0"))


def acquisition_time(date, time_text) -> Column:
    """Timestamp of a date and its HHMM text."""
    t = _c(time_text)
    return F.to_timestamp(F.concat_ws(" ", _c(date).cast("string"), F.concat(F.substring(t, 1, 2), F.lit(":"), F.substring(t, 3, 2), F.lit(":00"))))


def rounded_text(x, decimals: int) -> Column:
    """A fixed number of decimals; halves go to the even digit."""
    return F.format_string(f"%.{decimals}f", F.bround(_c(x).cast("double"), decimals))


def month_distance(a, b) -> Column:
    """Distance of two calendar months around the year."""
    d = F.abs(_c(a) - _c(b))
    return F.least(d, 12 - d)


def month_angle(month) -> Column:
    return F.lit(2 * math.pi) * (_c(month) - 1) / 12


def scan_date(key) -> Column:
    """Y/M/1 without padding."""
    k = _c(key)
    return F.concat_ws("/", F.floor(k / 100).cast("string"), (k % 100).cast("string"), F.lit("1"))


def parse_period(text) -> Column:
    """yyyymm of Y/M or Y/M/D."""
    p = F.split(F.trim(_c(text)), "/")
    y, m = F.try_element_at(p, F.lit(1)).try_cast("int"), F.try_element_at(p, F.lit(2)).try_cast("int")
    return F.when(m.between(1, 12) & F.size(p).isin(2, 3), y * 100 + m)


def period_months(start_key, end_key) -> Column:
    return month_ordinal(end_key) - month_ordinal(start_key) + 1


def study_bounds(start_key, end_key) -> tuple[Column, Column]:
    """First day of the first month and last day of the last."""
    day = lambda k: F.make_date(F.floor(_c(k) / 100).cast("int"), (_c(k) % 100).cast("int"), F.lit(1))
    return day(start_key), F.last_day(day(end_key))


# --- classes --------------------------------------------------------------------------------------


def class_from_number(x, low_below: float = 30, high_from: float = 80) -> Column:
    """l below the first bound, h from the second, n between; NULL for NULL."""
    x = _c(x)
    return F.when(x < low_below, F.lit("l")).when(x >= high_from, F.lit("h")).when(x.isNotNull(), F.lit("n"))


def class_from_label(x, mapping: dict[str, str]) -> Column:
    """The class of a trimmed lower-case label; NULL for one that is not mapped."""
    table = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return F.try_element_at(table, F.lower(F.trim(_c(x).cast("string"))))


def class_rank(x) -> Column:
    x = _c(x)
    return F.when(x == "l", 0).when(x == "n", 1).when(x == "h", 2)


def class_by_sensor(sensor, number, label, mapping: dict[str, str]) -> Column:
    """By sensor: the numeric or the label mapping; NULL for another sensor."""
    s = _c(sensor)
    return F.when(s == "modis", class_from_number(number)).when(s == "viirs", class_from_label(label, mapping))


# --- text -----------------------------------------------------------------------------------------


def blank_to_null(x) -> Column:
    t = F.trim(_c(x))
    return F.when(~t.isin("", "NA", "NaN", "nan"), t)


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """NFKC; Spark has no built-in for it."""
    return s.str.normalize("NFKC")


def normal_text(x, ascii_only: bool = False) -> Column:
    """NFKC, trimmed, runs of white space one blank. ``ascii_only`` leaves out the NFKC step, which ASCII does not need."""
    t = _c(x) if ascii_only else nfkc(_c(x))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def _tokens(x) -> Column:
    return F.regexp_extract_all(_c(x), F.lit("[A-Za-z0-9]+"), F.lit(0))


def snake_slug(x) -> Column:
    return F.array_join(F.transform(_tokens(x), lambda t: F.lower(t)), "_")


def title_slug(x) -> Column:
    """Tokens joined by _: one letter upper, else first upper and the rest lower."""
    return F.array_join(F.transform(_tokens(x), lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1000)))), "_")


def initials(x, n: int = 2) -> Column:
    """The first letters of the first n tokens, or the first n letters of a single one."""
    t = _tokens(x)
    many = F.array_join(F.transform(F.slice(t, 1, n), lambda w: F.substring(w, 1, 1)), "")
    return F.upper(F.when(F.size(t) > 1, many).otherwise(F.substring(F.array_join(t, ""), 1, n)))


def derive_codes(labels: list[str], mapping: dict[str, str] | None = None) -> list[str]:
    """Codes of an ordered small dimension: the mapping's, else two initials, then more, then a number; each used once.

    The order of the rows decides, so this folds over the dimension on the driver.
    """
    import re

    used: set[str] = set()
    out = []
    for label in labels:
        tokens = re.findall("[A-Za-z0-9]+", label)
        letters = "".join(tokens) if len(tokens) == 1 else "".join(t[0] for t in tokens)
        tries = [(mapping or {}).get(label)] if label in (mapping or {}) else [letters[:n].upper() for n in range(2, max(3, len(letters) + 1))]
        code = next((t for t in tries if t and t not in used), None)
        n = 2
        while code is None or code in used:
            code, n = f"{tries[0]}{n}", n + 1
        used.add(code)
        out.append(code)
    return out


# --- model scale ----------------------------------------------------------------------------------


def log2_checked(x) -> Column:
    """log2; raises for what is not positive and finite."""
    x = _c(x)
    bad = x.isNull() | ~(x > 0) | F.isnan(x) | (x == float("inf"))
    return F.when(bad, F.raise_error(F.concat(F.lit("not positive and finite: "), F.coalesce(x.cast("string"), F.lit("NULL")))).cast("double")).otherwise(F.log2(x))


def odds_ratio(beta, se, z: float = 1.959963984540054) -> tuple[Column, Column, Column]:
    """exp of an estimate and its normal bounds; NULL where it over- or underflows."""
    b, s = _c(beta), _c(se)
    def guarded(x: Column) -> Column:
        e = F.exp(x)
        return F.when((e > 0) & (e < float("inf")), e)
    return guarded(b), guarded(b - z * s), guarded(b + z * s)


def safe_fraction(a, b) -> Column:
    """a / b; NULL on a zero or missing denominator."""
    return F.when(_c(b) != 0, _c(a) / _c(b))


def drift_flag(local, reference, absolute: float, relative: float) -> Column:
    """1 if two numbers differ by more than both tolerances, NULL if one is missing."""
    d = F.abs(_c(local) - _c(reference))
    return flag_of((d > absolute) & (d > relative * F.abs(_c(reference))), [local, reference])


def utm_epsg(west, south, east, north) -> Column:
    """EPSG code of the UTM zone of a box's centre; the equal-area 6933 outside UTM's latitudes."""
    lon, lat = (_c(west) + _c(east)) / 2, (_c(south) + _c(north)) / 2
    zone = F.least(F.greatest(F.floor((lon + 180) / 6) + 1, F.lit(1)), F.lit(60))
    return F.when(lat.between(-80, 84), F.when(lat >= 0, 32600 + zone).otherwise(32700 + zone)).otherwise(6933).cast("int")
