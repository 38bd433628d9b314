"""What the driver's Python holds while tables of bounded size come to it."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from helixframe.llm import minhash


def test_word_frequencies_come_without_a_python_object_a_slot(spark):
    texts = spark.range(60_000).select(F.concat_ws(" ", *[F.concat(F.lit("w"), F.col("id") * 8 + k) for k in range(8)], F.lit("all all")).alias("t"))
    tracemalloc.start()
    df, n = minhash.word_df(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 60_000 and df.shape == (minhash.SLOTS,) and df.max() >= 60_000
    assert np.count_nonzero(df) > 0.8 * minhash.SLOTS
    assert 540_000 * 0.99 < df.sum() <= 540_000  # two words of a text in one slot count once
    assert peak < 32 << 20, f"{peak >> 20} MB"


def test_word_frequencies_of_no_text(spark):
    df, n = minhash.word_df(spark.createDataFrame([], "t string"))
    assert n == 0 and not df.any() and df.dtype == np.int64
