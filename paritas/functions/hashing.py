"""64-bit mixing, seeds and deterministic draws as column expressions.

Spark's BIGINT raises on overflow in ANSI mode, so products modulo 2^64 are put together from
halves that cannot overflow. All values are BIGINT columns holding the 64-bit pattern.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The constants of the splitmix64 mixer.
GOLDEN = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB

MASK32 = 0xFFFFFFFF


def signed(pattern: int) -> int:
    """The signed BIGINT with the bits of an unsigned 64-bit number."""
    pattern &= (1 << 64) - 1
    return pattern - (1 << 64) if pattern >= 1 << 63 else pattern


def _word(x: Column | int) -> Column:
    return F.lit(signed(x)).cast("bigint") if isinstance(x, int) else x.cast("bigint")


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body refers to it."""
    return F.transform(F.array(value), body)[0]


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(MASK32).cast("bigint"))


def _high(x: Column) -> Column:
    return F.shiftrightunsigned(x, 32)


def _join(high: Column, low: Column) -> Column:
    return F.shiftleft(_low(high), 32).bitwiseOR(_low(low))


def add64(a: Column | int, b: Column | int) -> Column:
    """a + b modulo 2^64."""
    pair = F.struct(_word(a).alias("a"), _word(b).alias("b"))
    return _let(pair, lambda w: _join(
        _high(w["a"]) + _high(w["b"]) + _high(_low(w["a"]) + _low(w["b"])), _low(w["a"]) + _low(w["b"])))


def _word_times(x: Column, factor: int) -> Column:
    """A 32-bit x times a 32-bit constant modulo 2^32, from two 48-bit products."""
    upper = F.shiftleft((x * F.lit(factor >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)
    return _low(x * F.lit(factor & 0xFFFF) + upper)


def mul64(x: Column, constant: int) -> Column:
    """x times a constant, modulo 2^64."""
    c_low, c_high = constant & MASK32, constant >> 32

    def product(w: Column) -> Column:
        lower, upper = _low(w) * F.lit(c_low & 0xFFFF), _low(w) * F.lit(c_low >> 16)
        first = lower + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16)
        cross = F.shiftrightunsigned(upper, 16) + _word_times(_low(w), c_high) + _word_times(_high(w), c_low)
        return _join(_high(first) + cross, first)

    return _let(_word(x), product)


def splitmix64(x: Column) -> Column:
    def fold(shift: int):
        return lambda z: z.bitwiseXOR(F.shiftrightunsigned(z, shift))

    z = mul64(_let(add64(x, GOLDEN), fold(30)), MIX_1)
    z = mul64(_let(z, fold(27)), MIX_2)
    return _let(z, fold(31))


def chunk_seed(seed: int, chunk: Column) -> Column:
    """(seed * 1000003 + chunk) modulo 2^63."""
    return add64(F.lit(signed(seed * 1000003)), chunk).bitwiseAND(F.lit((1 << 63) - 1))


def chunk_gamma_seed(seed: Column | int, chunk: Column) -> Column:
    mixed = splitmix64(chunk.cast("bigint") + 1)
    return splitmix64(_word(seed).bitwiseXOR(mixed))


def gamma_stream(shot: Column, window: Column, attempt: Column) -> Column:
    """shot + (window << 32) + (attempt << 56), modulo 2^64."""
    placed = add64(F.shiftleft(window.cast("bigint"), 32), F.shiftleft(attempt.cast("bigint"), 56))
    return add64(shot, placed)


def uniform_draw(*keys: Column) -> Column:
    """A draw in [0, 1) that depends on the keys alone, never on the partitioning."""
    digest = F.md5(F.concat_ws(":", *[k.cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def index_draw(size: Column, *keys: Column) -> Column:
    """A draw from 0 .. size - 1 that depends on the keys alone."""
    digest = F.md5(F.concat_ws(":", *[k.cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % size


def gamma_draw(seed: int, stream: Column, leg: Column, fault: Column, low: float, high: float) -> Column:
    """Memory strength of a fault in a leg: uniform in [low, high), a function of its four keys."""
    return F.lit(low) + uniform_draw(F.lit(seed), stream, leg, fault) * F.lit(high - low)
