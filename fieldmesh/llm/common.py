"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_libc = ctypes.CDLL(None)
#: Bytes of text that a task works on at once; a longer document is a piece of its own.
PIECE_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (long), text (string) and the named columns; whatever else the input has is left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors share. Only a local session may go without (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        at = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: What kept() wrote and nobody deleted yet.
_written: list[str] = []


def kept(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes what kept() wrote for these frames."""
    _delete(spark, {x.rsplit("/", 1)[0] for f in frames for x in f.inputFiles()})


def _delete(spark: SparkSession, paths) -> None:
    for at in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written() -> int:
    """A mark: how many tables kept() has written so far."""
    return len(_written)


def dropped_since(spark: SparkSession, mark: int, but: DataFrame) -> None:
    """Deletes the tables that kept() wrote since the mark, but for that of one frame."""
    stays = {x.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") for x in but.inputFiles()}
    gone = [at for at in _written[mark:] if at.split(":", 1)[-1].lstrip("/") not in stays]
    _delete(spark, gone)
    _written[mark:] = [at for at in _written[mark:] if at not in gone]


def crc_fold(doc_id: int | None, n: int) -> int:
    """crc32 of doc_id as text, modulo n; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def fold_column(n: int):
    """crc_fold as a column over doc_id."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def release() -> None:
    """Gives memory that was freed back to the system: workers live on, and allocators keep what a task was done with."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def lean(f):
    """f over batches, with freed memory given back at its end."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            release()

    return run


def one_each(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Of the rows with one of the ids (a bounded number), one for each id, that with the least hash of its text (then
    by the other columns): however often an id is repeated, a group keeps one row. Columns of ids come along."""
    rest = [c for c in docs.columns if c != "doc_id"]
    least = docs.join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("_hash"), *rest)).alias("_row"))
    return least.select("doc_id", *[F.col(f"_row.{c}").alias(c) for c in rest]).join(F.broadcast(ids), "doc_id")


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return ["" if x is None else x for x in batch.column(column).to_pylist()]


def pieces(batch: pa.RecordBatch, limit: int = PIECE_BYTES, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of at most limit bytes of text (one row may have more): first row, row after the last,
    the bytes, and where each row's bytes start and the last's end. Null texts are empty."""
    x = batch.column(column)
    x = x.fill_null("") if x.null_count else x
    x = x.cast(pa.large_string())
    n = len(x)
    if not n:
        return
    off = np.frombuffer(x.buffers()[1], np.int64, n + 1, x.offset * 8)
    data = np.frombuffer(x.buffers()[2], np.uint8) if x.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def packed(kind: np.dtype, *columns: np.ndarray) -> np.ndarray:
    """Columns as records."""
    out = np.empty(len(columns[0]), kind)
    for name, c in zip(kind.names, columns, strict=True):
        out[name] = c
    return out


def dealt(records: np.ndarray, bucket: np.ndarray, tag: int = 0) -> Iterator[pa.RecordBatch]:
    """Records as one blob for each bucket: rows (bucket int, tag int, blob binary). Shuffling blobs costs a task a
    few rows for each bucket rather than one for each record."""
    if not len(records):
        return
    order = np.argsort(bucket, kind="stable")
    bucket, records = bucket[order], records[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(bucket)]])
    for i in range(0, len(starts), 1000):
        part = [records[a:b].tobytes() for a, b in zip(starts[i : i + 1000], ends[i : i + 1000])]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[starts[i : i + 1000]].astype(np.int32)), pa.array([tag] * len(part), pa.int32()), pa.array(part, pa.binary())], ["bucket", "tag", "blob"])


BLOBS = "bucket int, tag int, blob binary"


def slices_of(places: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """A bitmap of so many bits (a power of two, 4,096 at least) with the places set, as blobs of up to 64 slices."""
    wide = bits // 64
    places = np.unique(places)
    for k in np.unique(places // wide).tolist():
        own, at = np.zeros(wide // 64, np.uint64), places[np.searchsorted(places, k * wide) : np.searchsorted(places, (k + 1) * wide)] - k * wide
        np.bitwise_or.at(own, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        yield from dealt(own.view("<i8"), np.full(len(own), k))


def bitmap(slices: DataFrame, bits: int) -> np.ndarray:
    """The bytes of a bitmap from the slices of all tasks."""
    words = bits // 64 // 64
    out = np.zeros(64 * words, "<i8")
    for k, x in merged_slices(slices, np.bitwise_or):
        out[k * words : (k + 1) * words] = x
    return out.view(np.uint8)


def gathered(batches, kinds: dict[int, np.dtype]) -> dict[int, np.ndarray]:
    """All records of a partition's blobs, by tag."""
    parts: dict[int, list[bytes]] = {t: [] for t in kinds}
    for b in batches:
        for t, x in zip(b.column("tag").to_pylist(), b.column("blob").to_pylist()):
            if t in parts:
                parts[t].append(x)
    return {t: np.frombuffer(b"".join(x), kinds[t]) for t, x in parts.items()}


def merged_slices(slices: DataFrame, how) -> list[tuple[int, np.ndarray]]:
    """The slices (BLOBS of 8-byte numbers, one size for each bucket, at most 64 buckets) of all tasks, merged in tasks, in two
    steps where tasks are many: one of each kind reaches the driver."""

    @lean
    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("bucket").to_pylist(), b.column("blob").to_pylist()):
                x = np.frombuffer(x, "<i8")
                total[k] = how(total[k], x) if k in total else x
        for k, x in total.items():
            yield from dealt(x, np.full(len(x), k))

    parts = partitions(slices.sparkSession)
    if parts > 128:
        some = F.pmod(F.spark_partition_id(), F.lit(parts // 64)).alias("some")
        slices = slices.select("*", some).repartition(parts, "bucket", "some").drop("some").mapInArrow(merge, BLOBS)
    got = slices.repartition(min(64, parts), "bucket").mapInArrow(merge, BLOBS).toArrow()
    return [(k, np.frombuffer(x, "<i8")) for k, x in zip(got.column("bucket").to_pylist(), got.column("blob").to_pylist())]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)
