"""Error-code tokens inside messages, their numbers and hexadecimal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what looks like an error code in a message.
TOKEN_PATTERN = r"(0x[0-9A-Fa-f]{4,}|errno=\d+|OSStatus\s-?\d+|error\s-?\d+|kIOReturn\w*|-\d{6,})"

INT32_MAX, UINT32_MAX = 2**31 - 1, 2**32 - 1


def extract_error_tokens(message: Column) -> Column:
    """All code-like tokens, leftmost first, without overlap."""
    return F.regexp_extract_all(message, F.lit(TOKEN_PATTERN), F.lit(1))


def parse_code(text: Column) -> Column:
    """A hexadecimal (``0x``) or decimal number as a long, else null.

    Hexadecimal values with only the 32-bit sign bit range are read as negative 32-bit numbers.
    More than 16 digits after leading zeros are no code but a digest, and give null.
    """
    t = F.trim(text)
    digits = F.regexp_extract(t, "^0[xX]0*([0-9A-Fa-f]+)$", 1)
    value = F.when(F.length(digits) <= 16, F.conv(digits, 16, 10)).try_cast("long")
    signed = F.when((value > INT32_MAX) & (value <= UINT32_MAX), value - 2**32).otherwise(value)
    return F.when(t.rlike(r"^0[xX][0-9A-Fa-f]+$"), signed).otherwise(t.try_cast("long"))


def code_hex(code: Column, domain: Column) -> Column:
    """``0x%X`` of the 32-bit pattern; IOReturn is padded to eight; HTTP and gRPC have none."""
    pattern = code.cast("long").bitwiseAND(F.lit(UINT32_MAX))
    return (
        F.when(code.isNull() | domain.isin("HTTP", "gRPC"), F.lit(None).cast("string"))
        .when(domain == "IOReturn", F.format_string("0x%08X", pattern))
        .otherwise(F.format_string("0x%X", pattern))
    )
