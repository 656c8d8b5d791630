"""A keyed bijection on whole numbers as a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS, MOST_WALKS = 4, 64
# A prime and two of its primitive roots, small enough that no product leaves 64 bits.
PRIME, ROOTS, SPREAD = 2147483647, (48271, 16807), (31, 7919, 104729)


def _mixed(x: Column, key: Column, salt: int) -> Column:
    """A number below ``PRIME`` that depends on all of its arguments."""
    out = (x * SPREAD[0] + key * SPREAD[1] + salt * SPREAD[2]) % (PRIME - 1) + 1
    for root in ROOTS:
        out = out * root % PRIME
    return out


def permuted(k: Column, n: Column, key: Column) -> Column:
    """The place of ``k`` in a permutation of 0 .. n - 1 that ``key`` (below 2**40) chooses.

    Feistel rounds on a grid of a * b cells, a little more than n: each half is shifted by a hash of the other, which can
    be undone. A cell at n or beyond walks on along its cycle until it is below n; fewer than a of them exist.
    """
    a = F.floor(F.sqrt(n.cast("double"))).cast("long") + 1
    b = F.floor((n + a - 1) / a).cast("long")

    def halves(v: Column) -> Column:
        low = v % b
        return F.struct(((v - low) / b).cast("long").alias("hi"), low.alias("lo"))

    def turn(h: Column, r: Column) -> Column:
        hi = (h["hi"] + _mixed(h["lo"], key, 2 * r)) % a
        return F.struct(hi.alias("hi"), ((h["lo"] + _mixed(hi, key, 2 * r + 1)) % b).alias("lo"))

    def step(v: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves(v), turn, lambda h: h["hi"] * b + h["lo"])

    walks = F.sequence(F.lit(1), F.least(a, F.lit(MOST_WALKS).cast("long")).cast("int"))
    return F.aggregate(walks, step(k.cast("long")), lambda v, _: F.when(v >= n, step(v)).otherwise(v))


def permuted_sql(source: str, columns: str) -> str:
    """A recursive CTE body over ``source``, which has ``columns`` and x (the place), n and key; ``v`` is the permuted place."""
    mixed = lambda x, salt: f"((({x} * {SPREAD[0]} + key * {SPREAD[1]} + {salt * SPREAD[2]}) % {PRIME - 1} + 1) * {ROOTS[0]} % {PRIME} * {ROOTS[1]} % {PRIME})"
    rounds, lo, hi = [], "lo0", "hi0"
    for r in range(ROUNDS):
        rounds += [f"({hi} + {mixed(lo, 2 * r)}) % a AS hi{r + 1}", f"({lo} + {mixed(f'hi{r + 1}', 2 * r + 1)}) % b AS lo{r + 1}"]
        lo, hi = f"lo{r + 1}", f"hi{r + 1}"
    step = lambda inner: f"SELECT {columns}, n, key, a, b, {hi} * b + {lo} AS v FROM (SELECT *, x // b AS hi0, x % b AS lo0, {', '.join(rounds)} FROM ({inner}))"
    first = f"SELECT {columns}, n, key, x, floor(sqrt(n))::bigint + 1 AS a, (n + floor(sqrt(n))::bigint) // (floor(sqrt(n))::bigint + 1) AS b FROM {source}"
    return f"{step(first)} UNION ALL {step(f'SELECT {columns}, n, key, a, b, v AS x FROM wk WHERE v >= n')}"
