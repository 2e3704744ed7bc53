"""As-of joins and gutters in columns against plain Python."""

import random

import numpy as np
from pyspark.sql import functions as F

from gradeloom.operators import layout as L
from gradeloom.operators.nearest import nearest_left


def test_nearest_left_equals_a_search(spark):
    """Ties, repeated rows, rows without a position or key, keys of one side only."""
    rng = random.Random(3)
    left = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, *range(12)]), n % 7) for n in range(80)]
    right = [(rng.choice([None, 1, 2, 3, 5]), rng.choice([None, *range(12)]), rng.choice([None, *range(9)])) for _ in range(40)]
    a = spark.createDataFrame(left, "k int, p int, _x int")
    b = spark.createDataFrame(right, "k int, p int, v int")
    got = sorted((tuple(r) for r in nearest_left(a, b, ["k"], F.col("p") + 1, F.col("p"), F.col("v")).collect()), key=str)

    def nearest(k, p):
        found = [(q, v is not None, v or 0, v) for key, q, v in right if k is not None and key == k and p is not None and q is not None and q <= p + 1]
        return max(found)[3] if found else None

    assert got == sorted(((k, p, n, nearest(k, p)) for k, p, n in left), key=str)


def test_gutters_equal_page_by_page(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for page in range(60):
        width, columns = rng.choice([612.0, 595.3, 800.0]), rng.choice([1, 2, 2, 3])
        items = []
        for _ in range(rng.choice([8, 12, 30, 120])):
            col = rng.randrange(columns)
            x = width / columns * col + rng.choice([20, 25.5, 31]) + rng.random() * rng.choice([0, 3])
            w = rng.choice([30, 90.25, width / columns - 45])
            if rng.random() < 0.02:
                x, w = 10.0, width
            items.append((float(x), float(w)))
        rows += [(page % 7, page, width, x, w) for x, w in items]
        x, w = (np.array(c) for c in zip(*items))
        if (middle := L.gutter(x, w, width)) is not None:
            want[page % 7, page] = middle
    df = spark.createDataFrame(rows, "doc_id long, page int, page_width double, x double, w double")
    assert {(r.doc_id, r.page): r.middle for r in L.gutters(df).collect()} == want and 15 < len(want) < 60
