"""Content-defined chunks of a sorted snapshot, found on all partitions at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.buzhash import WINDOW, ChunkSizes, cuts, hits, rolled
from ..functions.codec import pair_bytes
from ..sources.work import removed, written

FOUND = ["part", "size", "n", "head", "tail", "ends", "hits"]


def chunked(pairs: DataFrame, sizes: ChunkSizes | None = None, partitions: int | None = None) -> DataFrame:
    """pairs (key, value) with chunk: the number of bytes up to its chunk's end, so chunks ascend with keys.

    The sorted pairs are dealt to ranges. A window's hash depends on its 64 bytes only, so each range
    finds its hits alone, a batch at a time; those of windows across a border are found from the 63
    bytes on either side. Which hits end chunks depends on where the
    chunk before began. Each range first assumes that one begins with it; ranges whose guess was
    wrong are cut again from the true start, until none changes. Cuts soon meet again, so the rounds
    are few. The driver sees a few numbers per range, never one per pair. With a least size below
    the window the hash depends on the chunk's start, and one task rolls byte by byte.
    """
    sizes = sizes or ChunkSizes()
    spark = pairs.sparkSession
    small = sizes.least < WINDOW
    ranged = pairs.select("key", "value").repartition(1) if small else pairs.select("key", "value").repartitionByRange(*([partitions] if partitions else []), "key")
    base, at_base = written(ranged.withColumn("part", F.spark_partition_id().cast("long")), "ranges")
    if small:

        def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [(k, v) for b in batches for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            counts = rolled(rows, sizes)
            counts = [len(rows)] if len(counts) >= len(rows) else counts
            ends = np.repeat(np.cumsum(counts), counts) if rows else []
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), pa.array(ends, pa.int64())], ["key", "value", "chunk"])

        return base.select("key", "value").repartition(1).sortWithinPartitions("key").mapInArrow(roll, "key binary, value binary, chunk long")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per range: its size and number of pairs, its first and last bytes, and its pairs' ends and hits from its start on."""
        part, size, head, tail = None, 0, b"", b""
        ends: list[np.ndarray] = []
        inside: list[np.ndarray] = []

        def row() -> pa.RecordBatch:
            e, h = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (ends, inside))
            flat = [pa.array([part]), pa.array([size]), pa.array([len(e)]), pa.array([head], pa.binary()), pa.array([tail], pa.binary())]
            return pa.RecordBatch.from_arrays([*flat, *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in (e, h))], FOUND)

        for b in batches:
            p, col = b.column(0).to_numpy(), b.column(2).cast(pa.binary())
            at = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
            cut = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]).tolist() if len(p) else []
            for x, y in zip(cut, [*cut[1:], len(p)]):
                if p[x] != part:
                    if part is not None:
                        yield row()
                    part, size, head, tail, ends, inside = int(p[x]), 0, b"", b"", [], []
                data = col.buffers()[2][at[x] : at[y]].to_pybytes()
                inside.append(hits(tail + data, sizes.target) - len(tail) + size)
                ends.append(at[x + 1 : y + 1] - at[x] + size)
                head, tail, size = (head + data)[: WINDOW - 1], (tail + data)[-(WINDOW - 1) :], size + len(data)
        if part is not None:
            yield row()

    # Ranges are dealt by range, so that no task gets several of them while others have none.
    n_parts = max(1, base.select("part").distinct().count())
    dealt = base.select("part", "key", pair_bytes(F.col("key"), F.col("value")).alias("bytes")).repartitionByRange(n_parts, "part").sortWithinPartitions("part", "key")
    candidates, at_candidates = written(dealt.mapInArrow(found, "part long, size long, n long, head binary, tail binary, ends array<long>, hits array<long>"), "candidates")
    parts = sorted(map(tuple, candidates.select("part", "size", "n", "head", "tail").collect()))
    between: dict[int, np.ndarray] = {}  # hits of windows that a range shares with those before it
    offset: dict[int, int] = {}
    before, total, n_pairs = b"", 0, 0
    for part, size, n, head, tail in parts:
        h = hits(before + bytes(head), sizes.target) - len(before)
        between[part], offset[part] = h[(h > 0) & (h < WINDOW)] if before else h[:0], total
        before, total, n_pairs = (before + bytes(tail))[-(WINDOW - 1) :], total + size, n_pairs + n

    def cut_from(starts: dict[int, int]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part, ends, h in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                    if part in starts:
                        h = np.concatenate([between[part], h.values.to_numpy()])
                        c = cuts(ends.values.to_numpy() + offset[part], h + offset[part], starts[part], sizes)
                        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([c], pa.list_(pa.int64()))], ["part", "cuts"])

        return candidates.select("part", "ends", "hits").mapInArrow(run, "part long, cuts array<long>")

    starts = {p: offset[p] for p, *_ in parts}
    tables: dict[int, int] = {}  # the round that cut each part last
    rounds: list[DataFrame] = []
    paths = [at_base, at_candidates]
    summary: dict[int, tuple[int | None, int | None, int]] = {}
    todo = dict(starts)
    while todo:
        got, path = written(cut_from(todo), "cuts")
        paths.append(path)
        for part, first, last, n in got.select("part", F.get("cuts", F.lit(0)), F.try_element_at("cuts", F.lit(-1)), F.size("cuts")).collect():
            summary[part] = (first, last, n)
            tables[part] = len(rounds)
        rounds.append(got)
        todo, start = {}, 0
        for part, *_ in parts:
            if starts[part] != start:
                todo[part] = starts[part] = start
            start = summary[part][1] if summary[part][1] is not None else start
    n_chunks = sum(summary[p][2] for p, *_ in parts)
    last_cut = max((summary[p][1] or 0 for p, *_ in parts), default=0)
    n_chunks += last_cut < total
    following, end = {}, total
    for part, *_ in reversed(parts):
        following[part] = end
        end = summary[part][0] if summary[part][0] is not None else end
    one = n_chunks >= n_pairs
    final = None
    for k, got in enumerate(rounds):
        mine = got.filter(F.col("part").isin([p for p, t in tables.items() if t == k]))
        final = mine if final is None else final.unionByName(mine)
    tail_of = spark.sparkContext.broadcast((following, offset, total))

    def label(part_key: tuple, rows: pa.Table, found_: pa.Table) -> pa.Table:
        part = part_key[0].as_py()
        following_, offset_, total_ = tail_of.value
        rows = rows.sort_by("key")
        c = found_["cuts"][0].values.to_numpy() if found_.num_rows else np.zeros(0, np.int64)
        ends = np.cumsum(rows["size"].to_numpy()) + offset_[part]
        chunk = np.append(c, following_[part])[np.searchsorted(c, ends)]
        if one:
            chunk[:] = total_
        return pa.table({"key": rows["key"], "value": rows["value"], "chunk": chunk})

    rows = base.select("part", "key", "value", (F.octet_length("key").cast("long") + F.octet_length("value") + 8).alias("size"))
    if final is None:
        return spark.createDataFrame([], "key binary, value binary, chunk long")
    out, _ = written(rows.groupBy("part").cogroup(final.groupBy("part")).applyInArrow(label, "key binary, value binary, chunk long"), "chunks")
    removed(spark, *paths)
    return out
