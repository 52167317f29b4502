"""A keyed permutation of row numbers as DataFrame expressions.

A Feistel network over Z_a x Z_b with a * b >= n permutes a little more than n
numbers; cycle walking brings those that fall outside back into [0, n).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 6
WALK = 32


def hashed(*parts: Column) -> Column:
    """48 bits of a digest of the parts, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("long")


def sides(n: Column) -> tuple[Column, Column]:
    """(a, b) with a * b >= n and a * b - n < a, for n below 2^52."""
    a = F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double")))).cast("long")
    return a, F.greatest(F.lit(1), F.ceil(n / a)).cast("long")


def once(x: Column, a: Column, b: Column, key: Column) -> Column:
    """One pass of the network; every round can be undone, so it permutes [0, a * b)."""

    def step(v: Column, i: Column) -> Column:
        right = v % b
        left = ((v - right) / b).cast("long")
        even = ((left + hashed(key, i, right)) % a) * b + right
        odd = left * b + (right + hashed(key, i, left)) % b
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), x.cast("long"), step)


def walked(y: Column, n: Column, a: Column, b: Column, key: Column) -> Column:
    """Finish the walk of y = once(x): repeat the network until the number is below n.

    A cycle leaves [0, n) for at most a * b - n steps, so the second fold always
    ends below n; the first, short one spares nearly every row its long sequence.
    """

    def more(at: Column, steps: Column) -> Column:
        fold = F.aggregate(F.sequence(F.lit(1).cast("long"), steps), at, lambda v, _: F.when(v < n, v).otherwise(once(v, a, b, key)))
        return F.when(at < n, at).otherwise(fold)

    excess = a * b - n + 1
    return F.transform(F.array(more(y, F.least(excess, F.lit(WALK)))), lambda v: more(v, excess))[0]
