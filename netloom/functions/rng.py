"""Counter-based random numbers as Column expressions: md5 of a seed and key columns, so that any engine gives the same draws."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 4503599627370496.0  # 2 ** 52


def uniform(seed: str, *keys: str | Column) -> Column:
    """A double in [0, 1) from the first 13 hexadecimal digits of md5(seed|key|...)."""
    text = F.concat_ws("|", F.lit(seed), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(SCALE)


def normal(seed: str, *keys: str | Column) -> Column:
    """Standard normal by Box-Muller from two uniforms of their own seeds."""
    u1 = F.greatest(uniform(seed + ":1", *keys), F.lit(1e-16))
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(F.lit(2 * math.pi) * uniform(seed + ":2", *keys))


def gamma(shape: Column, seed: str, *keys: str | Column, attempts: int = 8) -> Column:
    """Gamma(shape, 1), shape >= 1, by Marsaglia and Tsang; the first accepted of a fixed number of attempts, else the mode."""
    d = shape - 1.0 / 3.0
    c = 1.0 / F.sqrt(9.0 * d)
    out = d
    for k in range(attempts - 1, -1, -1):
        x, u = normal(f"{seed}:x{k}", *keys), F.greatest(uniform(f"{seed}:u{k}", *keys), F.lit(1e-16))
        v = F.pow(1.0 + c * x, 3)
        good = (v > 0) & (F.log(u) < 0.5 * x * x + d - d * v + d * F.log(F.greatest(v, F.lit(1e-300))))
        out = F.when(good, d * v).otherwise(out)
    return out
