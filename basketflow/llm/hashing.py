"""Hashes that SQL engines share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_long(text: Column) -> Column:
    """The first sixty bits of the MD5 of a string (UTF-8), as a long."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def keyed(*parts: Column | str) -> Column:
    """``md5_long`` of the parts joined by colons; strings are literals."""
    return md5_long(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))
