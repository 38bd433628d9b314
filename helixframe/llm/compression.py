"""Bounded deterministic samples and zstandard raw-content dictionaries shared by the two compression classifiers."""

from __future__ import annotations

import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most thresholds, of two numbers or so each, that go to every task; more are met by a shuffle.
BROADCAST_KEYS = 1 << 16


def smallest(rows: DataFrame, key: str, rank: Column, most: int, floor: int = 1) -> DataFrame:
    """Some of the smallest-ranked rows of each ``key``; ``rank`` is a hash, uniform over longs.

    All keys together get about ``most`` rows, each an equal part of them and
    ``floor`` at least: the result is bounded by ``2 * max(most, floor * keys)``
    and a little chance. Counts give each key a threshold that twice its part is
    expected below, so no key is sorted or gathered; the caller trims the rest.
    ``rank`` goes along as ``_rank``, the part as ``_part``.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("_count"))
    keys = counts.count()
    part = max(floor, most // max(keys, 1))
    top = (1 << 63) - 1
    below = F.least(F.lit(float(top)), F.lit(2.0 * top * part) / F.col("_count")).cast("long")
    limits = counts.select(F.col(key).alias("_key"), below.alias("_below"))
    limits = F.broadcast(limits) if keys <= BROADCAST_KEYS else limits
    ranked = rows.withColumn("_rank", F.shiftrightunsigned(rank, 1))
    kept = ranked.join(limits, (F.col(key) == F.col("_key")) & (F.col("_rank") <= F.col("_below")))
    return kept.drop("_key", "_below").withColumn("_part", F.lit(part))


class Coder:
    """Compressed size of a whole text under one raw-content dictionary (``None``: without)."""

    def __init__(self, content: bytes | None, level: int = 3, min_match: int = 3):
        params = zstandard.ZstdCompressionParameters.from_level(level, min_match=min_match, write_checksum=0, write_content_size=0, write_dict_id=0)
        kept = {}
        if content:
            kept["dict_data"] = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            kept["dict_data"].precompute_compress(compression_params=params)
        self.coder = zstandard.ZstdCompressor(compression_params=params, **kept)

    def size(self, text: bytes) -> int:
        return len(self.coder.compress(text))
