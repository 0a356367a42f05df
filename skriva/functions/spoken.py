"""Numbers, sizes, times and addresses as they are said aloud."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NS = 1_000_000_000


def counted(n: Column, one: str, many: str, zero: bool = True) -> Column:
    """no packets, 1 packet, 12 packets."""
    said = F.when(n == 1, F.lit(f"1 {one}"))
    if zero:
        said = said.when(n == 0, F.lit(f"no {many}"))
    return said.otherwise(F.concat(n.cast("string"), F.lit(f" {many}")))


def spoken_bytes(name: str) -> Column:
    """A size (a column of that name), in steps of 1024: whole kilobytes, tenths of what is larger."""
    n = F.col(name)

    def tenths(step: int) -> Column:
        t = F.expr(f"({name} * 10) div {step} + CASE WHEN 2 * (({name} * 10) % {step}) > {step} OR (2 * (({name} * 10) % {step}) = {step} AND (({name} * 10) div {step}) % 2 = 1) THEN 1 ELSE 0 END")
        return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))

    whole = F.expr(f"{name} div 1024 + CASE WHEN 2 * ({name} % 1024) > 1024 OR (2 * ({name} % 1024) = 1024 AND ({name} div 1024) % 2 = 1) THEN 1 ELSE 0 END")
    return (
        F.when(n >= 1 << 30, F.concat(tenths(1 << 30), F.lit(" gigabytes")))
        .when(n >= 1 << 20, F.concat(tenths(1 << 20), F.lit(" megabytes")))
        .when(n >= 1 << 10, F.concat(whole.cast("string"), F.lit(" kilobytes")))
        .otherwise(counted(n, "byte", "bytes"))
    )


def spoken_time(seconds: Column) -> Column:
    """Whole seconds as minutes and seconds; minutes never become hours."""
    s = F.floor(seconds).cast("long")
    m, r = F.floor(s / 60).cast("long"), s % 60
    minutes, rest = counted(m, "minute", "minutes", zero=False), counted(r, "second", "seconds", zero=False)
    return F.when(m == 0, rest).when(r == 0, minutes).otherwise(F.concat(minutes, F.lit(" "), rest))


def moment(seconds: Column) -> Column:
    return F.when(seconds < 1, F.lit("At the start")).otherwise(F.concat(spoken_time(seconds), F.lit(" in")))


def time_left(position: Column, total: Column) -> Column:
    return F.greatest(total - position, F.lit(0))


def percent(part: Column, whole: Column) -> Column:
    """A share in whole percent, ties to even; 0 of nothing."""
    return F.when(whole > 0, F.bround(part / whole * 100, 0).cast("long")).otherwise(F.lit(0).cast("long"))


def spoken_address(address: Column) -> Column:
    """Dots and colons as words; a doubled colon is named."""
    v6 = F.trim(F.regexp_replace(F.replace(F.replace(address, F.lit("::"), F.lit(" double colon ")), F.lit(":"), F.lit(" colon ")), " +", " "))
    return F.when(address.contains(":"), v6).otherwise(F.replace(address, F.lit("."), F.lit(" dot ")))


def spoken_name(name: Column) -> Column:
    return F.replace(name, F.lit("."), F.lit(" dot "))


def sapi_rate(wpm: Column) -> Column:
    """Words a minute, on the engine's scale of -10 to 10 about 175."""
    speed = F.greatest(F.lit(50.0), F.least(F.lit(500.0), wpm.cast("double")))
    return F.greatest(F.lit(-10), F.least(F.lit(10), F.round(F.log(speed / 175.0) / math.log(1.15)).cast("int")))


def fit_within(width: Column, height: Column, edge: int = 2048) -> Column:
    """Width and height scaled so that the long edge is `edge` at most, each 1 at least."""
    scale = F.lit(float(edge)) / F.greatest(width, height)
    size = lambda c: F.when(F.greatest(width, height) > edge, F.greatest(F.round(c * scale).cast("int"), F.lit(1))).otherwise(c.cast("int"))
    return F.struct(size(width).alias("width"), size(height).alias("height"))


def degrees(parts: Column, reference: Column) -> Column:
    """One to three parts (degrees, minutes, seconds) to signed degrees."""
    at = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(0.0))
    value = at(0) + at(1) / 60 + at(2) / 3600
    return F.when(F.size(parts) > 0, F.when(F.upper(reference).isin("S", "W"), -value).otherwise(value))


def on_earth(lat: Column, lon: Column) -> Column:
    return (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~F.isnan(lat) & ~F.isnan(lon)


def civil_date(epoch_seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch_seconds), "yyyy-MM-dd HH:mm:ss")


def is_newer(candidate: Column, current: Column) -> Column:
    """Whether one version x.y.z is later than another; a pre-release (-...) is before its version; false if not versions."""
    shape = r"^v?(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+.*)?$"
    key = lambda c: F.struct(*[F.regexp_extract(c, shape, i).cast("long").alias(f"n{i}") for i in (1, 2, 3)], (F.regexp_extract(c, shape, 4) == "").alias("final"), F.regexp_extract(c, shape, 4).alias("pre"))
    return F.coalesce(candidate.rlike(shape) & current.rlike(shape) & (key(candidate) > key(current)), F.lit(False))
