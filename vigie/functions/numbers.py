"""Rounding and number formatting.

R rounds half to even, on the value that the double stores (Q7): 2.675 is a
little less than its text says, so ``round(2.675, 2)`` is 2.67. The part of a
double that a float holds and the part that it does not are 24 and at most 29
bits wide, so that both times a power of ten up to 10**10 (24 bits beside its
powers of two) are exact doubles: their sum decides every half exactly, with
JVM arithmetic alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import col
from .text import pad_left

_INF = float("inf")
_WHOLE = float(2**53)  # from here on doubles have no fraction
MAX_DIGITS = 10


def finite(c: Column | str) -> Column:
    c = col(c)
    return ~F.isnan(c) & (F.abs(c) != F.lit(_INF))


def round_even(c: Column | str, digits: int = 0) -> Column:
    """Round half to even to ``digits`` (0 to 10) decimals on the stored value; result is DOUBLE.

    NaN and infinities pass through; what rounds to nothing is a positive zero.
    From 2**53 units on, the nearest decimal of ``digits`` places is the double
    itself. The column stands some twenty times in the expression: pass a named
    column, not a long expression.
    """
    if not 0 <= digits <= MAX_DIGITS:
        raise ValueError(f"digits must be from 0 to {MAX_DIGITS}")
    x = col(c).cast("double")
    if not digits:
        return F.rint(x) + F.lit(0.0)
    power = F.lit(float(10**digits))
    high = x * power
    head = x.cast("float").cast("double")
    low = (x - head) * power - (high - head * power)  # what the product lost by rounding
    near = F.rint(high)
    off = high - near
    whole = near + (
        # a half that was none: the lost part says which way
        F.when((F.abs(off) == 0.5) & (off * low > 0), off * 2)
        # without a fraction of its own the product may still stand half a unit off an odd integer
        .when((off == 0) & (F.abs(low) == 0.5) & (high % 2 != 0), low * 2)
        .otherwise(F.lit(0.0)))
    # NaN counts as larger than any number
    return F.when(F.abs(high) >= F.lit(_WHOLE), x).otherwise(whole / power + F.lit(0.0))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


_LIMB = 10**9    # digits are held nine at a time
def _times(limbs: Column, factor: Column) -> Column:
    """A number in limbs, lowest first, times a small one."""
    limb, zero = F.lit(_LIMB).cast("bigint"), F.lit(0).cast("bigint")

    def step(done: Column, x: Column) -> Column:
        return _let(x * factor + done["carry"], lambda v: F.struct(
            F.call_function("div", v, limb).alias("carry"), F.concat(done["out"], F.array(v % limb)).alias("out")))

    start = F.struct(zero.alias("carry"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(limbs, start, step, lambda done: F.when(done["carry"] > 0, F.concat(done["out"], F.array(done["carry"]))).otherwise(done["out"]))


def _decimal(x: Column) -> Column:
    """All decimal digits of a positive double, and how many of them are behind the point.

    The hexadecimal text of a double is its exact value: an integer times a
    power of two. A negative power 2**-s is 5**s behind s decimal places.
    """
    def digits(parts: Column) -> Column:
        bits = F.conv(F.rpad(F.translate(parts[0], "x.", ""), 15, "0"), 16, 10).cast("bigint")
        limb = F.lit(_LIMB).cast("bigint")
        first = F.array(bits % limb, F.call_function("div", bits, limb))

        def expanded(power: Column) -> Column:
            # 2**29 and 5**12 are the largest powers below a limb: a carry is a limb again
            behind = power < 0
            base, chunk = F.when(behind, 5.0).otherwise(2.0), F.when(behind, 12).otherwise(29)
            times = F.abs(power)
            factors = F.concat(F.array_repeat(F.pow(base, chunk).cast("bigint"), F.call_function("div", times, chunk).cast("int")),
                               F.array(F.pow(base, times % chunk).cast("bigint")))
            limbs = F.reverse(F.aggregate(factors, first, _times))
            return F.struct(F.ltrim(F.concat_ws("", F.transform(limbs, lambda v: F.lpad(v.cast("string"), 9, "0"))), F.lit("0")).alias("digits"),
                            F.greatest(-power, F.lit(0)).alias("places"))

        return _let(parts[1].cast("int") - 52, expanded)

    return _let(F.split(F.format_string("%a", x), "p"), digits)


SIGNIFICANT = 15


def _rounded(exact: Column) -> Column:
    """To 15 significant digits, half to even: the digits without trailing zeros, and the first one's power of ten."""
    digits = exact["digits"]
    n, rest = F.length(digits), digits.substr(F.lit(SIGNIFICANT + 1), F.length(digits))
    head = digits.substr(F.lit(1), F.lit(SIGNIFICANT)).cast("bigint")
    tail = F.rtrim(rest, F.lit("0"))
    up = (tail > "5") | ((tail == "5") & (head % 2 == 1))
    kept = F.when(up, head + 1).otherwise(head).cast("string")
    return _let(kept, lambda k: F.struct(
        F.rtrim(k, F.lit("0")).alias("digits"),
        # one digit more where all nines were rounded up
        (n - 1 - exact["places"] + F.when(F.length(k) > F.least(n, F.lit(SIGNIFICANT)), 1).otherwise(0)).alias("exp")))


def _as_formatted(x: Column) -> Column:
    """The same from ``%.14e``, which rounds the text that Java writes the double with."""
    parts = F.split(F.format_string("%.14e", x), "e")
    return F.struct(F.rtrim(F.translate(parts[0], ".", ""), F.lit("0")).alias("digits"), parts[1].cast("int").alias("exp"))


def _undecided(x: Column) -> Column:
    """Whether the half between two 15-digit numbers reads back as the double, so that its text does not show the side it is on."""
    parts = F.split(F.format_string("%.16e", x), "e")
    return F.concat(parts[0].substr(1, SIGNIFICANT + 1), F.lit("5e"), parts[1]).cast("double") == x


def _written(rounded: Column) -> Column:
    """Fixed notation unless the scientific form is shorter."""
    digits, exp = rounded["digits"], rounded["exp"]
    n = F.length(digits)
    fixed = (
        F.when(exp >= n - 1, F.concat(digits, F.repeat(F.lit("0"), exp - n + 1)))
        .when(exp >= 0, F.concat(digits.substr(F.lit(1), exp + 1), F.lit("."), digits.substr(exp + 2, n)))
        .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits))
    )
    scientific = F.concat(
        digits.substr(F.lit(1), F.lit(1)),
        F.when(n > 1, F.concat(F.lit("."), digits.substr(F.lit(2), n - 1))).otherwise(F.lit("")),
        F.lit("e"), F.when(exp < 0, F.lit("-")).otherwise(F.lit("+")),
        pad_left(F.abs(exp).cast("string"), 2),
    )
    return F.when(F.length(fixed) <= F.length(scientific), fixed).otherwise(scientific)


def number_text(c: Column | str) -> Column:
    """A double as R's ``as.character`` writes it inside ``paste``.

    15 significant digits without trailing zeros, rounded on the stored value
    (``%.15g``); fixed notation unless the scientific form is shorter (R's
    default penalty of 0): ``1`` for 1.0, ``0.03``, ``123456``, ``1e+05``,
    ``1e-04``, ``0.001``; ``NaN``, ``Inf``. Exact for every double: where the
    text that Java writes does not decide the 15th digit (never for values of
    at most 15 digits, for some 6 % of arbitrary ones), the whole decimal
    expansion is built, nine digits at a time, with higher-order functions.
    """
    x = col(c).cast("double")

    def text(v: Column) -> Column:
        rounded = F.when(_undecided(v), _let(_decimal(v), _rounded)).otherwise(_as_formatted(v))
        return _let(rounded, _written)

    return (
        F.when(x.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(x), F.lit("NaN"))
        .when(x == F.lit(_INF), F.lit("Inf"))
        .when(x == F.lit(-_INF), F.lit("-Inf"))
        .when(x == 0, F.lit("0"))
        .otherwise(F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), _let(F.abs(x), text)))
    )


def with_number_texts(df: DataFrame) -> DataFrame:
    """``df`` with every floating column as its ``number_text``: one expression over all of them, whatever their number."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not floating:
        return df
    held = "_".join(["texts", *df.columns])  # no column has this name
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in floating])
    out = df.withColumn(held, F.transform(values, number_text))
    return out.select(*[F.col(f"`{held}`")[floating.index(c)].alias(c) if c in floating else F.col(f"`{c}`") for c in df.columns])


def to_text(c: Column | str) -> Column:
    """Cast to text (``as.character``)."""
    return col(c).cast("string")
