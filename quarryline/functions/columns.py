"""Scalar column functions (F1 to F11)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column, pattern: str = "[a-z]+", lower: bool = True) -> Column:
    """All matches of the pattern; runs of a class are what splitting by all others leaves, which is twice as fast."""
    text = F.lower(text) if lower else text
    if pattern.startswith("[") and pattern.endswith("]+") and not pattern.startswith("[^"):
        return F.filter(F.split(text, f"[^{pattern[1:]}"), lambda w: w != "")
    return F.regexp_extract_all(text, F.lit(f"({pattern})"))


def tokens_ws(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def local_hhmm_to_utc(date: Column, hhmm: Column, zone: Column) -> Column:
    return F.to_utc_timestamp(F.try_to_timestamp(F.concat(date, F.lit(" "), F.lpad(hhmm.cast("string"), 4, "0")), F.lit("yyyy-MM-dd HHmm")), zone)


def unpack(packed: Column, index: int) -> Column:
    return F.get(F.split(packed, ","), F.lit(index)).try_cast("int")


def cyclical(degrees: Column) -> tuple[Column, Column]:
    return F.cos(F.radians(degrees)), F.sin(F.radians(degrees))


def last_three(call: Column) -> Column:
    return F.substring(F.trim(call), -3, 3)


def safe_log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def month_of(ts: Column) -> Column:
    return F.trunc(ts.cast("date"), "month")


def week_of(ts: Column) -> Column:
    return F.trunc(ts.cast("date"), "week")


def hash_bucket(key: Column, n: int, seed: str = "") -> Column:
    """md5 bucket 0 to n - 1, the same in every engine and partitioning."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % n).cast("int")
