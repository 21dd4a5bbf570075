"""Deterministic hashes: every random choice is a function of stable ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FINGERPRINT_PRIME = (1 << 61) - 1


def text_of(*parts: Column | str | int) -> Column:
    """``a:b:c`` as the hashed text; plain Python values are literals, names are columns."""
    return F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def sha_text(*parts: Column | str | int) -> Column:
    return F.sha2(text_of(*parts), 256)


def word60(digest: Column) -> Column:
    """Leading 60 bits of a hex digest as a non-negative BIGINT."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def little_endian_mod(digest: Column, n: int) -> Column:
    """First eight digest bytes, least significant first, modulo ``n``."""
    swapped = F.concat(*[F.substring(digest, 2 * i + 1, 2) for i in reversed(range(8))])
    return (F.conv(swapped, 16, 10).cast("decimal(20,0)") % F.lit(n)).cast("int")


def row_text(*columns: str) -> Column:
    """Unambiguous text of a row: ``length:value`` per column, ``~`` for NULL."""
    def one(name: str) -> Column:
        text = F.col(name).cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~"))

    return F.concat_ws("|", *[one(c) for c in columns])
