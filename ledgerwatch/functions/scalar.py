"""Scalar functions as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_text(c, default: str) -> Column:
    """Trimmed; blank or null becomes the default."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))


def infer_hour(step) -> Column:
    return F.pmod(step, F.lit(24))


def abbreviate(c, length: int) -> Column:
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit("..."))).otherwise(c)


def parse_amount(c) -> Column:
    """``¥10K+`` and the like as a number; what can't be read is 0."""
    s = F.upper(F.regexp_replace(F.trim(c), "[¥￥,]", ""))
    factor = F.when(s.rlike(r"K\+?$"), 1e3).when(s.rlike(r"M\+?$"), 1e6).otherwise(1.0)
    return F.coalesce(F.regexp_replace(s, r"[KM]\+?$", "").try_cast("double") * factor, F.lit(0.0))


def event_time(c) -> Column:
    """Milliseconds from a number (ms, or microseconds of a day), ``HH:MM:SS[.mmm]``, an ISO duration or a numeric string; else 0."""
    s = F.trim(c)
    number = s.try_cast("bigint")
    from_number = F.when((number > 0) & (number <= 86_400_000_000), F.floor(number / 1000)).otherwise(number)
    part = lambda pattern, k, kind="bigint": F.coalesce(F.nullif(F.regexp_extract(s, pattern, k), F.lit("")).try_cast(kind), F.lit(0).cast(kind))
    clock = r"^(\d+):(\d+)(?::(\d+))?(?:\.(\d+))?$"
    millis = F.rpad(F.substring(F.regexp_extract(s, clock, 4), 1, 3), 3, "0").try_cast("bigint")
    from_clock = (part(clock, 1) * 3600 + part(clock, 2) * 60 + part(clock, 3)) * 1000 + F.coalesce(millis, F.lit(0))
    iso = r"^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?$"
    from_iso = part(iso, 1) * 3_600_000 + part(iso, 2) * 60_000 + F.round(part(iso, 3, "double") * 1000).cast("bigint")
    return F.coalesce(F.when(number.isNotNull(), from_number).when(s.rlike(iso), from_iso).when(s.rlike(clock), from_clock), F.lit(0)).cast("bigint")


def mask(c, least: int, head: int = 4) -> Column:
    """First ``head`` and last four characters; what is shorter than ``least`` stays."""
    return F.when(F.length(c) < least, c).otherwise(F.concat(F.substring(c, 1, head), F.lit("****"), F.substring(c, -4, 4)))


def mask_account(c) -> Column:
    return mask(c, 6)


def mask_phone(c) -> Column:
    return mask(c, 7, head=3)


def mask_device(c) -> Column:
    return mask(c, 8)


#: Prior risk of a detection source and of a city.
SOURCE_RISK = {"ML": 0.6, "GNN": 0.7, "CEP": 0.5, "SQL": 0.4, "GRAPH": 0.65}
CITY_RISK = {"上海": 0.3, "北京": 0.35, "成都": 0.2, "深圳": 0.4, "广州": 0.25, "杭州": 0.3, "武汉": 0.2, "南京": 0.25, "重庆": 0.2, "天津": 0.25, "UNKNOWN": 0.15}


def lookup(key, table: dict, default: float) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def source_risk(source) -> Column:
    return lookup(F.split_part(F.upper(source), F.lit("_"), F.lit(1)), SOURCE_RISK, 0.3)


def city_risk(city) -> Column:
    return lookup(city, CITY_RISK, 0.2)


def latency_total(stages) -> Column:
    """Greatest time of a map of stage times, less the first."""
    return F.array_max(F.map_values(stages)) - F.try_element_at(stages, F.lit("t0"))


def confidence_words(c) -> Column:
    return F.when(c >= 0.95, "极高").when(c >= 0.85, "很高").when(c >= 0.75, "较高").when(c >= 0.60, "中等").otherwise("较低")


def two_digits(c) -> Column:
    """A number of zero or more with two digits after the point, halves up."""
    n = F.floor(c * 100 + 0.5)
    return F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))


def amount_words(c) -> Column:
    """Amounts from 10 000 on in units of ten thousand."""
    return F.when(c >= 10000, F.concat(two_digits(c / 10000), F.lit("万元"))).otherwise(F.concat(two_digits(c), F.lit("元")))
