"""Random numbers as column expressions of keys: partitioning and retries cannot change them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 12


def key(*parts) -> Column:
    """The text that a draw is hashed from."""
    return F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))


def uniform(*parts) -> Column:
    """A number in [0, 1) drawn by the key: the leading hexadecimal digits of its MD5."""
    return F.conv(F.substring(F.md5(key(*parts)), 1, HEX_DIGITS), 16, 10).cast("double") / float(16**HEX_DIGITS)


def normal(*parts) -> Column:
    """A standard normal draw by Box and Muller from two uniform ones."""
    radius = F.sqrt(-2.0 * F.log(1.0 - uniform(*parts, "a")))
    return radius * F.cos(2.0 * math.pi * uniform(*parts, "b"))


def rank_key(*parts) -> Column:
    """A value to order rows at random but repeatably."""
    return F.md5(key(*parts))
