"""``format_g`` against Python's ``%g`` on random doubles and on every kind of tie."""

import math
import random

from pyspark.sql import functions as F

from breachlens.functions.text import format_g


def doubles():
    rng = random.Random(6)
    out = [0.0, -0.0, 1.0, 100000.0, 999999.0, 999999.5, 1000000.0, 1234565.0, 1234575.0, 0.0001, 0.00001, 0.00012345650000000001, 1e22, 1e23,
           9.9999949999e-5, 99999.95, 999999.4999999999, 0.1, 1 / 3, 2.000005, 1.0000005, math.inf, -math.inf, math.nan, 5e-324, 1.7e308]
    for e in range(-30, 30):
        for near in (10.0 ** e, 10.0 ** e * (1 - 2 ** -53), 10.0 ** e * (1 + 2 ** -52), 9.999995 * 10.0 ** e, 9.9999949 * 10.0 ** e):
            out.append(near)
    for _ in range(20_000):
        out.append(float(f"{rng.randrange(10 ** 5, 10 ** 6)}5e{rng.randrange(-28, 17)}"))       # seven digits, the last a five
        out.append((rng.randrange(10 ** 5, 10 ** 6) + 0.5) * 2.0 ** rng.randrange(-30, 20))      # ties of the binary value
        out.append(rng.randrange(10 ** 6, 10 ** 9) + rng.choice([0.0, 0.5]))
        out.append(math.ldexp(rng.random(), rng.randrange(-78, 79)))
        out.append(rng.choice([-1, 1]) * rng.random() * 10 ** rng.randrange(0, 7))
    return out


def test_format_g_is_that_of_python(spark):
    values = doubles()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").repartition(8)
    got = {r["i"]: r["g"] for r in df.select("i", format_g(F.col("v")).alias("g")).collect()}
    exact = [i for i, v in enumerate(values) if v == 0 or not math.isfinite(v) or 1e-24 <= abs(v) < 1e24]
    assert len(exact) > 95_000
    wrong = [(values[i], got[i], f"{values[i]:g}") for i in exact if got[i] != f"{values[i]:g}"]
    assert not wrong, wrong[:10]
    far = sorted(set(got) - set(exact))
    assert sum(got[i] == f"{values[i]:g}" for i in far) > 0.7 * len(far)
    assert spark.range(1).select(format_g(F.lit(None).cast("double"))).first()[0] is None
