"""Golden arrays of the reference's corruption tests (masks supplied as input)."""

# The inputs and expected arrays below must equal the reference's own for right results.

from pyspark.sql import functions as F

from spanweave.functions.arrays import sentinel_ids_sql
from spanweave.operators.corrupt import corrupt

SENTINEL_GOLDEN = [
    ([0, 1, 1, 0, 0], [0, 32099, -1, 0, 0]),
    ([1, 0, 0, 0, 1, 1, 1, 0, 0, 1], [32099, 0, 0, 0, 32098, -1, -1, 0, 0, 32097]),
    ([0, 0, 0, 1, 1, 1, 1, 0, 0, 1], [0, 0, 0, 32099, -1, -1, -1, 0, 0, 32098]),
    ([0, 0, 1, 1, 1, 0, 0, 0, 0, 0], [0, 0, 32099, -1, -1, 0, 0, 0, 0, 0]),
    ([1, 0, 1, 1, 1, 1, 1, 1, 1, 1], [32099, 0, 32098, -1, -1, -1, -1, -1, -1, -1]),
]


def test_sentinels(spark):
    df = spark.createDataFrame([(m,) for m, _ in SENTINEL_GOLDEN], "mask array<int>")
    got = [r[0] for r in df.select(F.expr(sentinel_ids_sql("mask", 32100))).collect()]
    assert got == [s for _, s in SENTINEL_GOLDEN]


def _pad(xs, n, v=0):
    return (xs + [v] * n)[:n]


def _mask(positions, n):
    m = [0] * n
    for p in positions:
        m[p] = 1
    return m


PIPELINE = [
    ([8774, 296, 55, 1], [0], [32099, 296, 55, 1], [32099, 8774]),
    ([947, 19, 46, 677, 28, 3, 9, 1200, 7142, 1], [1, 8],
     [947, 32099, 46, 677, 28, 3, 9, 1200, 32098, 1], [32099, 19, 32098, 7142]),
    ([389, 677, 28, 1317, 16513, 58, 23840, 36, 16114, 233, 16990, 2505, 55, 1], [0, 1, 5, 6, 7, 12],
     [32099, 28, 1317, 16513, 32098, 16114, 233, 16990, 2505, 32097, 1],
     [32099, 389, 677, 32098, 58, 23840, 36, 32097, 55]),
    ([8774, 296, 55, 27, 183, 1036, 12, 169, 14145, 8585, 7, 5, 3963, 25, 214, 79, 33, 48, 1633, 1],
     [0, 2, 3, 5, 6, 15, 16, 17, 18],
     [32099, 296, 32098, 183, 32097, 169, 14145, 8585, 7, 5, 3963, 25, 214, 32096, 1],
     [32099, 8774, 32098, 55, 27, 32097, 1036, 12, 32096, 79]),
    ([978, 7177, 47, 78, 13006, 233, 27, 2654, 31, 17, 199, 68, 103, 776, 326, 5, 1],
     [0, 1, 3, 4, 5, 11, 12],
     [32099, 47, 32098, 27, 2654, 31, 17, 199, 32097, 776, 326, 5, 1],
     [32099, 978, 7177, 32098, 78, 13006, 233, 32097, 68, 103]),
    ([947, 19, 3, 9, 166, 7142, 55, 100, 19, 3, 9, 511, 5, 363, 81, 3, 9, 1025, 58, 1],
     [2, 3, 4, 5, 6, 13, 15, 16, 17, 18],
     [947, 19, 32099, 100, 19, 3, 9, 511, 5, 32098, 81, 32097, 1],
     [32099, 3, 9, 166, 7142, 55, 32098, 363, 32097, 3]),
]


def test_pipeline_golden(spark):
    rows = []
    for i, (ids, pos, _, _) in enumerate(PIPELINE):
        width = 14 if len(ids) <= 14 else 20
        rows.append((str(i), _pad(ids, width), _mask(pos, width)))
    df = spark.createDataFrame(rows, "k string, input_ids array<int>, mask array<int>")
    out = corrupt(df, "k", input_length=20, target_length=10, mask_col="mask").orderBy("k").collect()
    for r, (_, _, inp, lab) in zip(out, PIPELINE):
        assert r["input_ids"] == _pad(inp, 20)
        assert r["labels"] == _pad(lab, 10, -100)
        assert r["decoder_input_ids"] == [0] + [x if x != -100 else 0 for x in _pad(lab, 10, -100)][:9]
