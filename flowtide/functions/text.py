"""Readable text for addresses, types, times and feature values.

Everything here is for presentation; grouping always uses the raw values.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def mac_text(mac: Column) -> Column:
    """``aa:bb:cc:dd:ee:ff``."""
    digits = F.lower(F.hex(mac))
    pair = lambda i: F.substring(digits, 2 * i + 1, 2)
    return F.concat(pair(0), *[part for i in range(1, 6) for part in (F.lit(":"), pair(i))])


def ethertype_text(ether_type: Column) -> Column:
    """``0x0800``."""
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(ether_type)), 4, "0"))


def ipv4_text(address: Column) -> Column:
    """Dotted quad of an unsigned 32-bit address held in a bigint."""
    byte = lambda shift: F.shiftright(address, shift).bitwiseAND(F.lit(255)).cast("string")
    # concat, not concat_ws: a missing address must stay missing.
    dot = F.lit(".")
    return F.concat(byte(24), dot, byte(16), dot, byte(8), dot, byte(0))


def ipv6_text(address: Column) -> Column:
    """Canonical text of a 16-byte address.

    The first longest run of two or more zero groups becomes ``::``. When the
    part before the last 32 bits is all zeros, or all zeros but a final
    ``ffff``, those 32 bits are written as a dotted quad.
    """
    # ":a:b:...:h:" lets one search find a run of whole groups.
    padded = F.regexp_replace(F.lower(F.hex(address)), "(....)", ":$1")
    joined = F.concat(F.regexp_replace(padded, ":0{1,3}", ":"), F.lit(":"))

    def compress(text: Column) -> Column:
        run = F.coalesce(*[_position(text, ":0" * n + ":") for n in range(8, 1, -1)])
        return let(
            run,
            lambda found: F.when(found.isNull(), F.btrim(text, F.lit(":"))).otherwise(
                F.concat(
                    F.btrim(F.substring(text, F.lit(1), found["at"]), F.lit(":")),
                    F.lit("::"),
                    F.btrim(F.substring(text, found["at"] + found["size"], F.length(text)), F.lit(":")),
                )
            ),
        )

    tail = ipv4_text(F.conv(F.hex(F.substring(address, 13, 4)), 16, 10).cast("bigint"))
    zeros = lambda n: F.lit(bytes(n))
    return (
        F.when(
            F.substring(address, 1, 12) == F.lit(bytes(10) + b"\xff\xff"),
            F.concat(F.lit("::ffff:"), tail),
        )
        .when(
            (F.substring(address, 1, 12) == zeros(12)) & (F.substring(address, 13, 2) != zeros(2)),
            F.concat(F.lit("::"), tail),
        )
        .when(address.isNotNull(), let(joined, compress))
    )


def _position(text: Column, part: str) -> Column:
    """Where ``part`` occurs in ``text`` and its size; NULL if nowhere."""
    at = F.instr(text, part)
    return F.when(at > 0, F.struct(at.alias("at"), F.lit(len(part)).alias("size")))


def time_text(ts: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` in the session time zone."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def _per_double(kind: str, form: str):
    """A function of doubles that formats each as C does, in Arrow batches.

    Correct rounding of the exact binary value is what ``%`` does natively; in
    built-in expressions it takes long decimals for each value and is an order of
    magnitude slower. Nested, so that tasks need no import of this package.
    """
    import pyarrow as pa

    number = kind == "double"

    def apply(values: pa.Array) -> pa.Array:
        texts = [None if v is None else form % v for v in values.to_pylist()]
        if number:
            return pa.array([None if t is None else float(t) for t in texts], pa.float64())
        return pa.array(texts, pa.string())

    return F.arrow_udf(apply, kind)


def six_digits(x: Column) -> Column:
    """``x`` rounded to six significant digits, still a double; exact ties go to
    the even digit."""
    return _per_double("double", "%.5e")(x.cast("double"))


def six_digit_text(x: Column) -> Column:
    """The text a default C++ output stream writes for ``x``.

    Six significant digits without trailing zeros; exponents below -4 or from
    6 on switch to scientific notation.
    """
    return _per_double("string", "%g")(x.cast("double"))
