"""What the operators of this folder share: cutting lineage, sizes and the byte kernels.

The kernels work on whole Arrow buffers with numpy: one call handles the words of
many documents, so there is no Python step per word.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel takes at once; one longer document is taken alone.
CHUNK_BYTES = 1 << 20

U64 = np.uint64
_MIX_A, _MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


#: Folders of staged tables that are still there.
_staged: dict[str, SparkSession] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where nothing is set: a temporary one if the master is local (tests), else an error.

    On a cluster a machine's own folder would hold each executor's part of a table where no other reads it.
    """
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="millrace-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: its lineage ends there.

    A lost executor costs the reader nothing, as the files are in the folder that
    the cluster names in spark.checkpoint.dir. drop_staged deletes a table that nothing reads any more; the driver deletes
    what is left when it ends.
    """
    spark = df.sparkSession
    folder = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{folder}/millrace-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged[path] = spark
    staged = spark.read.schema(df.schema).parquet(path)
    staged._millrace_path = path
    return staged


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def drop_staged(*tables: DataFrame) -> None:
    """Delete tables of stage_table that no plan refers to any more: those of rounds that are over."""
    for staged in tables:
        path = getattr(staged, "_millrace_path", None)
        if path in _staged:
            _delete(_staged.pop(path), path)


@atexit.register
def _drop_all() -> None:
    for path, spark in list(_staged.items()):
        with contextlib.suppress(Exception):  # the JVM may have ended before
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)


def broadcast_if_small(side: DataFrame, row_bytes: int, most: int = 8 << 20) -> DataFrame:
    """A staged table with a broadcast hint if its rows are counted to fit; else as it is, for a join by shuffle.

    A staged table is an exchange of its own in such a join, so adaptive execution may split a hot key's rows on the other side.
    """
    return F.broadcast(side) if side.count() * row_bytes <= most else side


def semi_join(rows: DataFrame, keys: DataFrame, on: str, row_bytes: int, salts: int = 16) -> DataFrame:
    """rows whose `on` is among keys (a staged table of distinct values). Large key sets join with a salt, so that the rows
    of a hot key are dealt over so many parts, also where a later aggregate by the key would keep them together."""
    small = broadcast_if_small(keys, row_bytes)
    if small is not keys:
        return rows.join(small, on, "left_semi")
    salt = fresh(rows, "_salt")
    left = rows.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    right = keys.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [on, salt], "left_semi").drop(salt)


def give_back() -> None:
    """Return freed memory of this Python worker to the system, so that the next stage's worker starts small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values over all bits."""
    h = (h ^ (h >> U64(30))) * _MIX_A
    h = (h ^ (h >> U64(27))) * _MIX_B
    return h ^ (h >> U64(31))


def _table(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


_BYTE_VALUE = _table(256, 17)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept and grown by doubling."""
    while len(_powers["up"]) < n:
        m = len(_powers["up"])
        up, down = U64(pow(_BASE, m, 1 << 64)), U64(pow(_BASE_INV, m, 1 << 64))
        with np.errstate(over="ignore"):
            _powers["up"] = np.concatenate([_powers["up"], _powers["up"] * up])
            _powers["down"] = np.concatenate([_powers["down"], _powers["down"] * down])
    return _powers["up"][:n], _powers["down"][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of values; equal spans have equal hashes wherever they lie."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that hold at most so many bytes, or one row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, min(to, n)
        row = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words are runs of bytes other than space and 0x09-0x0D, within a row.

    Returns the first byte, the byte after the last, and for each row the number of
    its first word (n + 1 values).
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets, side="left")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(_BYTE_VALUE[data], starts, ends)


_LANE = _table(64, 99) | U64(1)


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Of every k consecutive word hashes (also across rows; the caller drops those)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(n, U64)
    for j in range(k):
        total += hashes[j : j + n] * _LANE[j]
    return mix(total)


def within(firsts: np.ndarray, k: int) -> np.ndarray:
    """Positions of words that start a run of k words in one row. firsts: n + 1 word numbers."""
    counts = np.maximum(np.diff(firsts) - k + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.repeat(firsts[:-1] - before, counts) + np.arange(total)


def partitions_for(spark: SparkSession, nbytes: int, each: int = 8 << 20) -> int:
    """A number of tasks that keeps each near the given bytes; it follows the input."""
    return max(spark.sparkContext.defaultParallelism, -(-nbytes // each))
