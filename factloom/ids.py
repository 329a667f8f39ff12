"""Record ids: canonical text, and a compact binary form for shuffles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space (Unicode White_Space, zero-width no-break space).
SPACES = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

UUID_PATTERN = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def strip(c: Column) -> Column:
    """Text without white space at either end."""
    return F.trim(c, F.lit(SPACES))


def canonical_id(c: Column) -> Column:
    """Lower case, no outer white space; null for null and blank."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def pack_id(c: Column) -> Column:
    """Canonical id as bytes: 16 for a UUID, else 16 zero bytes and the text. Injective; null stays null."""
    text = canonical_id(c)
    other = F.concat(F.unhex(F.lit("00" * 16)), F.encode(text, "UTF-8"))
    return F.when(text.rlike(UUID_PATTERN), F.unhex(F.translate(text, "-", ""))).otherwise(other)


def unpack_id(c: Column) -> Column:
    """The canonical id text of `pack_id`'s bytes."""
    h = F.lower(F.hex(c))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(F.length(c) == 16, F.concat_ws("-", *parts)).otherwise(F.decode(F.substring(c, 17, 2**30), "UTF-8"))
