"""A one-sided membership filter of bounded size over 64-bit hashes.

Whatever was put in passes; of the rest a small share does as well, so an
exact join follows wherever it is used. It never holds more than MAX_WORDS
words, whatever the input: a fuller filter only lets more through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_WORDS = 1 << 20


def build(spark: SparkSession, hashes: DataFrame, column: str):
    """A broadcast of the filter over a column of well-mixed 64-bit hashes."""
    count = hashes.count()
    size = min(MAX_WORDS, 1 << max(8, (count // 4).bit_length()))
    slot = F.pmod(F.col(column), F.lit(size)).cast("int")
    bit = F.expr(f"shiftleft(1L, cast(pmod(shiftright(`{column}`, 40), 64) AS INT))")
    rows = hashes.select(slot.alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    flags = np.zeros(size, np.int64)
    flags[np.asarray(rows["slot"])] = np.asarray(rows["bits"])  # at most ``size`` rows
    return spark.sparkContext.broadcast(flags)


def passes(flags: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return (flags[hashes & (len(flags) - 1)] >> ((hashes >> 40) & 63)) & 1 == 1
