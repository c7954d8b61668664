"""Pseudo-random columns computed from keys, so that they depend neither on the
partitioning nor on a task being run again."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def uniform(seed: int, *keys: Column) -> Column:
    """Uniform on [0, 1): the first 52 bits of the MD5 of seed and keys joined by bars (a NULL key is empty), which
    other engines can compute as well. Keys are strings or integers."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") * F.lit(2.0**-52)


def normal(seed: int, *keys: Column) -> Column:
    """Standard normal by the Box-Muller transform."""
    u = F.lit(1.0) - uniform(seed, F.lit("radius"), *keys)
    v = uniform(seed, F.lit("angle"), *keys)
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2 * math.pi) * v)


def poisson_one(seed: int, *keys: Column) -> Column:
    """Poisson(1) draw: how often a row occurs in one bootstrap resample."""
    u = uniform(seed, F.lit("count"), *keys)
    out, below, mass = F.lit(0), 0.0, math.exp(-1.0)
    for k in range(12):
        below += mass
        out = F.when(u >= below, k + 1).otherwise(out)
        mass /= k + 1
    return out


def poisson_key(*keys: Column) -> Column:
    """The keys as :func:`poisson_counts` reads them."""
    return F.concat_ws("|", F.lit(""), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])


def poisson_counts(seed: int, replicates: int, keys: Sequence[str]) -> np.ndarray:
    """``poisson_one(seed, replicate, key..)`` for replicates 1, 2, .. of each key of :func:`poisson_key`, inside a task: one MD5 a draw."""
    steps = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(12)])
    heads = [f"{seed}|count|{i}".encode() for i in range(1, replicates + 1)]
    out = np.zeros((len(keys), replicates), np.uint8)
    for row, key in enumerate(keys):
        tail = key.encode()
        digests = b"".join([md5(h + tail, usedforsecurity=False).digest() for h in heads])
        u = (np.frombuffer(digests, ">u8")[::2] >> np.uint64(12)).astype(float) * 2.0**-52
        out[row] = np.searchsorted(steps, u, side="right")
    return out


def by_key(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` in parts by ``key``, equal keys next to each other: as many parts as there is work for, however few the bytes."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(n, key).sortWithinPartitions(key)


def with_counts(batches: Iterator[pd.DataFrame], key: str, seed: int, replicates: int, most: int = 1000) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Pieces of ``most`` rows with their counts in every replicate (rows x replicates); equal keys of a piece are drawn once."""
    for batch in batches:
        for start in range(0, len(batch), most):
            piece = batch.iloc[start : start + most]
            names, at = np.unique(piece[key].to_numpy(str), return_inverse=True)
            yield piece, poisson_counts(seed, replicates, names.tolist())[at]
