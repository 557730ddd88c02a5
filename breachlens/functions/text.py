"""Native string renderings that follow Python's formatting rules."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _powers(base: int, n: int) -> Column:
    return F.array(*[F.lit(Decimal(base ** i)).cast("decimal(38,0)") for i in range(n)])


def _six_digits(m: Column, j: Column, x: Column) -> Column:
    """(d, up): the integer part of m · 2^j · 10^(5 - x), and whether what is cut off rounds it up, half to even.

    The quotient is a fraction of integers: powers of ten are taken apart into those of two and five."""
    power = lambda table, n: table[F.greatest(n, F.lit(0))]
    fives, twos = _powers(5, 31), _powers(2, 126)
    s = (5 - x).cast("int")
    two = (j + s).cast("int")
    over = m * power(fives, s) * power(twos, two)
    under = power(fives, -s) * power(twos, -two)
    return _let(F.struct(over.cast("decimal(38,0)").alias("over"), under.cast("decimal(38,0)").alias("under")), lambda f: _let(
        F.struct((f["over"] - f["over"] % f["under"]).alias("whole"), (f["over"] % f["under"]).alias("rest")), lambda w: _let(
            (w["whole"] / f["under"]).cast("long"), lambda d: F.struct(
                d.alias("d"), x.cast("int").alias("x"),
                ((w["rest"] * 2 > f["under"]) | ((w["rest"] * 2 == f["under"]) & (d % 2 == 1))).alias("up")))))


def _exact_g(v: Column) -> Column:
    """The rendering of a double above 0, from its exact value."""
    k = F.floor(F.log2(v)).cast("int")
    # one bit more than a double has, so that m is whole also where the logarithm is off by one
    parts = F.struct((v * F.pow(F.lit(2.0), 53 - k)).cast("decimal(38,0)").alias("m"), (k - 53).alias("j"), F.floor(F.log10(v)).cast("int").alias("x"))
    found = _let(parts, lambda p: _let(_six_digits(p["m"], p["j"], p["x"]), lambda f: F.when(
        f["d"] >= 1_000_000, _six_digits(p["m"], p["j"], p["x"] + 1)).when(
        f["d"] < 100_000, _six_digits(p["m"], p["j"], p["x"] - 1)).otherwise(f)))
    rounded = _let(found, lambda f: _let(f["d"] + f["up"].cast("long"), lambda d: F.struct(
        F.when(d == 1_000_000, F.lit("1")).otherwise(F.rtrim(d.cast("string"), F.lit("0"))).alias("s"),
        (f["x"] + (d == 1_000_000).cast("int")).alias("x"))))

    def written(r: Column) -> Column:
        s, x = r["s"], r["x"]
        rest = lambda at: F.substring(s, at, F.lit(6))
        point = lambda t: F.when(t != "", F.concat(F.lit("."), t)).otherwise(F.lit(""))
        whole = F.concat(F.rpad(F.substring(s, F.lit(1), x + 1), x + 1, F.lit("0")), point(rest(x + 2)))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -x - 1), s)
        exponent = F.concat(F.when(x < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(x).cast("string"), 2, "0"))
        return F.when(x.between(0, 5), whole).when(x.between(-4, -1), small).otherwise(
            F.concat(F.substring(s, 1, 1), point(rest(F.lit(2))), exponent))

    return _let(rounded, written)


def format_g(x: Column) -> Column:
    """Python ``f"{v:g}"``: 6 significant digits, trailing zeros removed,
    scientific below 1e-4 or from 1e6 (``12.0→12``, ``1234567→1.23457e+06``).

    The JVM's ``%g`` gives the same digits unless the cut is near a half, where it
    rounds the shortest decimal half up. There they come from the double's exact
    value, an integer times a power of two, rounded half to even. Beyond 1e-24 to
    1e24 decimals of 38 digits can't hold it, and the JVM's digits stay.
    """
    v = x.cast("double")
    size = F.abs(v)
    java = F.regexp_replace(F.format_string("%g", v), r"(\.\d*?)0+(e|$)", "$1$2")
    java = F.regexp_replace(java, r"\.(e|$)", "$1")
    sign = F.when(v.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
    odd = F.when(F.isnan(v), F.lit("nan")).when(size == float("inf"), F.concat(sign, F.lit("inf"))).when(size == 0, F.concat(sign, F.lit("0")))
    small = (size < 1e6) & (size == F.floor(size))
    cut = size * F.pow(F.lit(10.0), 5 - F.floor(F.log10(size)))
    near_half = F.when((size >= 1e-24) & (size < 1e24), F.abs(cut - F.floor(cut) - 0.5) < 1e-6)
    exact = F.when(small, size.cast("long").cast("string")).when(near_half, _exact_g(size))
    return F.when(v.isNull(), F.lit(None)).otherwise(F.coalesce(odd, F.concat(sign, exact), java))


def format_fixed(x: Column, decimals: int) -> Column:
    """Python ``f"{v:.Nf}"`` for values below 1000 (no grouping separators).

    ``format_number`` rounds the exact binary value half-even, as Python does;
    ``format_string('%.2f')`` would round the shortest decimal form half-up.
    """
    return F.format_number(x.cast("double"), decimals)


def python_float(x: Column) -> Column:
    """Python ``repr`` of a finite double: shortest digits, a point always, an exponent below 1e-4 or from 1e16.

    Java writes an exponent below 1e-3 and from 1e7; those are written out through an exact decimal.
    """
    d = x.cast("double")
    java = d.cast("string")
    plain = F.regexp_replace(F.regexp_replace(d.cast("decimal(38,20)").cast("string"), r"0+$", ""), r"\.$", ".0")
    digits = F.regexp_replace(F.regexp_extract(java, r"^([^E]*)E", 1), r"\.0$", "")
    power = F.regexp_extract(java, r"E(-?[0-9]+)$", 1)
    sign = F.when(power.startswith("-"), F.lit("e-")).otherwise(F.lit("e+"))
    scientific = F.concat(digits, sign, F.lpad(F.replace(power, F.lit("-"), F.lit("")), 2, "0"))
    written_out = (F.abs(d) >= 1e-4) & (F.abs(d) < 1e16)
    return F.when(~java.contains("E"), java).when(written_out, plain).otherwise(scientific)


# The short escapes of JSON.
_SHORT_ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def _json_char(c: Column) -> Column:
    code = F.ascii(c)
    hex4 = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    beyond = code - 0x10000
    pair = F.concat(hex4(F.shiftright(beyond, 10) + 0xD800), hex4(beyond.bitwiseAND(0x3FF) + 0xDC00))
    out = F.when(code.between(0x20, 0x7E), c).when(code > 0xFFFF, pair).otherwise(hex4(code))
    for char, escape in _SHORT_ESCAPES.items():
        out = F.when(c == char, F.lit(escape)).otherwise(out)
    return out


def json_string(s: Column) -> Column:
    """A text as a JSON string in ASCII (NULL stays NULL): characters beyond it are written as ``\\u`` and four lower-case
    hexadecimal digits, those beyond U+FFFF as a surrogate pair."""
    escaped = F.array_join(F.transform(F.split(s, ""), _json_char), "")
    plain = ~s.rlike(r'[^\x20\x21\x23-\x5B\x5D-\x7E]')
    return F.concat(F.lit('"'), F.when(plain, s).otherwise(escaped), F.lit('"'))


__all__ = ["format_g", "format_fixed", "python_float", "json_string"]
