"""What the operators of this subpackage share: shared work folders, Arrow limits, words."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ..sources.work import removed as remove
from ..sources.work import work_dir, written

ARROW_ROWS, ARROW_BYTES = 2000, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by Spark's reader, so that any store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_limits(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows and bytes, so that very long texts don't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/strataloom-{name}-{uuid.uuid4().hex}"


def bucket(column: str, modulus: int) -> Column:
    """crc32 of a column as text, modulo modulus; the fold that contracts name. Null: null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def words(text: str | None) -> list[bytes]:
    r"""The words [^\x20\x09-\x0D]+ in UTF-8: bytes.split() splits at just these six bytes."""
    return text.encode().split() if text else []


def hashed(found: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    return np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, to spread sums and products over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of n-word shingles, A-Z lower-cased; fewer words: all of them as one; none: empty."""
    found = text.encode().lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    h = hashed(found)
    n = min(n, len(h))
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out = out * ODD + h[j : len(h) - n + 1 + j]
    return np.unique(mix(out + np.uint64(n)))


def lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """An Arrow list column from flat values and the rows' lengths."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values))


#: A sieve has so many bits at most; more keys than that would fill it.
SIEVE_BITS = 25


def parted(rows: DataFrame, column: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows whose column may be among keys (a one-column table), and the others, whose column surely isn't.

    A bit map of hashed places is broadcast: 2**(SIEVE_BITS - 6) rows at most, whatever the input. Beyond
    2**SIEVE_BITS keys there is none, and all rows go to the exact join that follows.
    """
    n = keys.count()
    if n > 1 << SIEVE_BITS:
        return rows, rows.filter("false")
    bits = min(SIEVE_BITS, max(12, (16 * n).bit_length()))
    place = F.pmod(F.xxhash64(F.col(keys.columns[0])), F.lit(1 << bits))
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    words_ = keys.select(place.alias("place")).select(F.expr("shiftright(place, 6)").alias("__word"), bit.alias("bit")).groupBy("__word").agg(F.bit_or("bit").alias("__bits"))
    own = rows.withColumn("__place", F.pmod(F.xxhash64(F.col(column)), F.lit(1 << bits)))
    own = own.withColumn("__at", F.expr("shiftright(__place, 6)")).withColumn("__mask", F.expr("shiftleft(1L, cast(__place & 63 as int))")).drop("__place")
    hit = (F.col("__at") == F.col("__word")) & (F.col("__bits").bitwiseAND(F.col("__mask")) != 0)
    return tuple(own.join(F.broadcast(words_), hit, how).select(*rows.columns) for how in ("left_semi", "left_anti"))  # type: ignore[return-value]


def sieved(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """rows less most of those whose column isn't among keys; none that is goes."""
    return parted(rows, column, keys)[0]


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    arrow_limits(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        free()

    return df.mapInArrow(run, schema)


def free() -> None:
    """Give freed memory back to the system: a worker stays for tasks of other operators, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
