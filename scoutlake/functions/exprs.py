"""Small column expressions shared by the operators. All stay inside Catalyst."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), c))


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is zero."""
    return col(a).cast("double") / F.nullif(col(b).cast("double"), F.lit(0.0))


def ratio0(a: Column | str, b: Column | str) -> Column:
    """a / b, 0 where b is zero or null."""
    return F.coalesce(safe_div(a, b), F.lit(0.0))


def to_number(c: Column | str) -> Column:
    """Number of any text or numeric column; what does not parse becomes 0."""
    return F.coalesce(col(c).try_cast("double"), F.lit(0.0))


def half_up(c: Column | str, digits: int) -> Column:
    """Rounds like ``F.round``, by arithmetic alone; for many rows of values from 0 to 1000.

    ``F.round`` takes every double through text. Values are first taken to the nearest 1e-9, where
    doubles of this size are exact, so a half is seen as a half; ``digits`` is at most nine."""
    whole = F.floor(col(c) * 1e9 + 0.5).cast("double")
    if digits < 9:
        whole = F.floor((whole + 5.0 * 10.0 ** (8 - digits)) / 10.0 ** (9 - digits)).cast("double")
    return whole / 10.0**digits


def finite_or_zero(c: Column | str) -> Column:
    c = col(c)
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(c)


def logistic(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def fixed(c: Column, digits: int) -> Column:
    """Text with a fixed number of decimals of the exact binary value (3.15 is a little less, so
    3.1); true ties go to the even digit, null stays null."""
    unit = 10.0**digits
    c = c.cast("double")
    size = F.abs(c)
    scaled = size * unit
    # What the product lost, by cutting the factor into two halves of which each product is exact.
    shifted = size * 134217729.0
    high = shifted - (shifted - size)
    lost = (high * unit - scaled) + (size - high) * unit
    whole = F.floor(scaled).cast("double")
    over = scaled - whole
    odd = F.pmod(whole, F.lit(2.0)) == 1.0
    up = (over > 0.5) | ((over == 0.5) & ((lost > 0) | ((lost == 0) & odd)))
    near = F.signum(c) * (whole + up.cast("double")) / unit
    value = F.when(scaled < 2.0**52, near).otherwise(c)
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", value))


def utc_text(seconds: Column | str, fmt: str = "yyyy-MM-dd'T'HH:mm:ss'Z'") -> Column:
    """Epoch seconds as UTC text, whatever the session time zone is."""
    whole = F.floor(col(seconds)).cast("bigint")
    moment = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=whole)
    return F.date_format(moment, fmt)


def filled(template: str, **columns: Column) -> Column:
    """Text of a template whose {names} are replaced by columns."""
    pieces = re.split(r"\{(\w+)\}", template)
    parts = [columns[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(pieces) if p]
    return F.concat(*parts)


def compact_array(items: list[Column]) -> Column:
    """Array of the non-null items, in order."""
    return F.array_compact(F.array(*items))


def total(items: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, items)


def spread(n: Column | str, s: Column | str, sq: Column | str) -> Column:
    """Population variance from count, sum and sum of squares of integers.

    The numerator is exact decimal arithmetic, so merging partial sums in any order
    gives the same value and equal inputs give exactly 0.
    """
    wide = "decimal(19,0)"
    n, s, sq = col(n), col(s), col(sq)
    top = n.cast(wide) * sq.cast(wide) - s.cast(wide) * s.cast(wide)
    return F.when(n > 0, top.cast("double") / (n.cast("double") * n.cast("double")))


def entropy_bits(n: Column | str, c_log_c: Column | str) -> Column:
    """Shannon entropy in bits from N = sum(c) and sum(c * log2(c)).

    Both sums are mergeable, so no window over the host's values is needed. Rounding
    at 1e-12 removes the cancellation noise of the difference, which keeps values
    such as exactly 2 bits on the right side of strict thresholds.
    """
    n, c_log_c = col(n).cast("double"), col(c_log_c)
    raw = F.log2(n) - c_log_c / n
    return F.when(n > 0, F.greatest(F.lit(0.0), F.round(raw, 12))).otherwise(F.lit(0.0))


def private_ip(ip: Column | str) -> Column:
    """Loopback, RFC 1918 or link-local IPv4."""
    ip = col(ip)
    part = F.split(ip, r"\.")
    a = F.try_element_at(part, F.lit(1)).try_cast("int")
    b = F.try_element_at(part, F.lit(2)).try_cast("int")
    scoped = (
        (a == 10)
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 169) & (b == 254))
    )
    dotted = F.size(part) == 4
    return F.coalesce(
        ip.startswith("127.") | (ip == "localhost") | (dotted & scoped), F.lit(False)
    )


def protocol_name(proto: Column | str, other: str = "number") -> Column:
    """TCP/UDP by number. ``other`` names the rest: 'number', or any fixed word."""
    proto = col(proto)
    rest = proto.cast("string") if other == "number" else F.lit(other)
    return F.when(proto == 6, F.lit("TCP")).when(proto == 17, F.lit("UDP")).otherwise(rest)
