"""Seeded permutations of 0 .. n-1 as column expressions.

A Feistel network over pairs (l, r) with ``l < a`` and ``r < b``: each round adds a keyed hash of
one half to the other, so every round can be undone and the network permutes the ``a * b`` pairs.
With ``a`` near the root of ``n`` and ``b = ceil(n / a)`` fewer than ``a`` pairs lie beyond ``n``;
a place that falls there is sent through the network again (cycle walking) until it lies below
``n``, which makes it a permutation of 0 .. n-1.

A place depends on the index, ``n`` and the key alone: no window, no shuffle, and any place can
be computed without the others, forwards and backwards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the round function, stated here so that other engines can repeat it: odd
# multipliers below 2^31, shifts, and the mask between the two products.
ROUNDS = 6
FIRST_FACTOR, SECOND_FACTOR = 1_640_531_527, 1_103_515_245
FIRST_SHIFT, SECOND_SHIFT = 17, 16
MASK = 2**31 - 1
#: Up to this ``n`` the product of a half and a factor fits a long.
MOST = 2**60
#: A walk visits pairs beyond ``n`` only. There are fewer than ``a`` of them, so up to this number
#: the walk is long enough for certain; beyond it, it would have to meet more than as many in a
#: row, each with a chance of at most 1 / 64.
LONGEST_WALK = 64


def round_keys(seed: int, *parts: Column | int) -> Column:
    """The keys of all rounds, 28 bits each, from a seed and further values such as the epoch."""
    texts = [F.lit(str(seed)), *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts]]
    digest = F.md5(F.concat_ws("|", *texts))
    second = F.md5(F.concat_ws("|", *texts, F.lit("more")))
    pieces = [F.substring(digest, 1 + 7 * i, 7) for i in range(4)]
    pieces += [F.substring(second, 1 + 7 * i, 7) for i in range(ROUNDS - 4)]
    return F.array(*[F.conv(p, 16, 10).cast("long") for p in pieces])


def _mixed(half: Column, key: Column) -> Column:
    first = F.shiftright(half.bitwiseXOR(key) * F.lit(FIRST_FACTOR), FIRST_SHIFT).bitwiseAND(F.lit(MASK))
    return F.shiftright(first.bitwiseXOR(key) * F.lit(SECOND_FACTOR), SECOND_SHIFT)


def _long(value: Column | int) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("long")


def _whole(value: Column, by: Column) -> Column:
    """The quotient without its fraction, exact for longs."""
    return F.call_function("div", value, by)


def _sides(n: Column | int) -> tuple[Column, Column, int | Column]:
    """``a``, ``b`` and the number of pairs beyond ``n``."""
    if isinstance(n, int):
        if n > MOST:
            raise ValueError(f"at most {MOST} places")
        a = max(1, math.isqrt(max(0, n - 1)) + 1)
        b = max(1, -(-n // a))
        return F.lit(a).cast("long"), F.lit(b).cast("long"), a * b - n
    a = F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double"))).cast("long"))
    b = F.greatest(F.lit(1), _whole(n.cast("long") + a - 1, a))
    return a, b, a * b - n.cast("long")


def _walked(index: Column, n: Column | int, once) -> Column:
    """``once`` until the place is below ``n``: at least once, and fails rather than stop short."""
    a, b, beyond = _sides(n)
    size = _long(n)
    steps = min(beyond, LONGEST_WALK) if isinstance(beyond, int) else F.least(beyond, F.lit(LONGEST_WALK))

    def step(at: Column, _: Column) -> Column:
        return F.when(at < size, at).otherwise(once(at, a, b))

    def finish(at: Column) -> Column:
        failed = F.raise_error(F.lit("permuted index out of range")).cast("long")
        return F.when(at < size, at).otherwise(failed)

    def place(first: Column) -> Column:
        # Nearly every first place is inside; only the others walk.
        walk = F.sequence(F.lit(1), _long(steps).cast("int"))
        return F.when(first < size, first).otherwise(F.aggregate(walk, first, step, finish))

    inside = (index >= 0) & (index < size)
    # An index that is not in the range has no place.
    return F.when(inside, F.get(F.transform(F.array(once(index.cast("long"), a, b)), place), F.lit(0)))


def permute(index: Column, n: Column | int, keys: Column) -> Column:
    """The place of ``index`` in the permutation of 0 .. n-1 with these ``round_keys``."""

    def once(value: Column, a: Column, b: Column) -> Column:
        start = F.struct(
            _whole(value, b).alias("l"), (value % b).alias("r"), a.alias("a"), b.alias("b")
        )

        def half(s: Column, key: Column) -> Column:
            moved = (s["l"] + _mixed(s["r"], key)) % s["a"]
            return F.struct(s["r"].alias("l"), moved.alias("r"), s["b"].alias("a"), s["a"].alias("b"))

        return F.aggregate(keys, start, half, lambda s: s["l"] * b + s["r"])

    return _walked(index, n, once)


def unpermute(place: Column, n: Column | int, keys: Column) -> Column:
    """The index whose place this is."""

    def once(value: Column, a: Column, b: Column) -> Column:
        start = F.struct(
            _whole(value, b).alias("l"), (value % b).alias("r"), a.alias("a"), b.alias("b")
        )

        def half(s: Column, key: Column) -> Column:
            back = F.pmod(s["r"] - _mixed(s["l"], key), s["b"])
            return F.struct(back.alias("l"), s["l"].alias("r"), s["b"].alias("a"), s["a"].alias("b"))

        return F.aggregate(F.reverse(keys), start, half, lambda s: s["l"] * b + s["r"])

    return _walked(place, n, once)

