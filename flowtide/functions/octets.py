"""Integers out of a binary column, as SQL text of built-in functions.

SQL text, not Column objects: a decoder needs dozens of these, and each
``selectExpr`` then crosses from Python to the JVM once per output column.
"""


def octets(data: str, offset: int | str, count: int) -> str:
    """``count`` raw bytes starting at 0-based ``offset``."""
    return f"substring({data}, {offset} + 1, {count})"


def big_endian(data: str, offset: int | str, count: int) -> str:
    """Unsigned big-endian integer of up to 7 bytes as bigint.

    NULL when the bytes start past the end of ``data``. Slicing before ``hex``
    keeps the text short; of the built-in ways to read a byte this measured
    fastest.
    """
    return f"CAST(conv(hex({octets(data, offset, count)}), 16, 10) AS BIGINT)"


def word_pair(data: str, offset: int | str) -> str:
    """Two adjacent 32-bit words packed into one (signed) bigint: one
    conversion instead of two. Split it by ``>>> 32`` and ``& 4294967295``."""
    return f"CAST(conv(hex({octets(data, offset, 8)}), 16, -10) AS BIGINT)"
