import random

import numpy as np

from seriesloom.llm._bitmap import bitmap
from seriesloom.llm._kernel import mix


def test_bits_of_all_tasks_are_joined(spark):
    rng = random.Random(3)
    values = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(3000)] + [0, -1, 63, 64]
    df = spark.createDataFrame([(v,) for v in values], "h long").repartition(7)
    for spread in (None, mix):
        got = np.unpackbits(bitmap(df, 12, spread)).astype(bool)
        at = np.array(values, np.int64).view(np.uint64)
        want = np.zeros(1 << 12, bool)
        want[((spread(at) if spread else at) & np.uint64((1 << 12) - 1)).astype(int)] = True
        assert (got == want).all()
    assert not bitmap(df.limit(0), 12).any()
