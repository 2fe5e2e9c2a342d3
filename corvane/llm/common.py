"""What the training-data operators share: work tables, Arrow batches, byte-level words.

Work tables go to the folder that the cluster names in ``spark.checkpoint.dir``; only where that is
unset (tests, a laptop) a temporary folder of this process is used.
"""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = b" \t\n\x0b\x0c\r"
_own_folder: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Workspace:
    """Parquet tables that cut an operator's lineage, in the folder all executors share."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            if not _own_folder:
                _own_folder.append("file://" + tempfile.mkdtemp(prefix="corvane-"))
            base = _own_folder[0]
        self.spark, self.root = spark, f"{base.rstrip('/')}/corvane-{label}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        """Write ``df`` and return it as read back: later stages restart from these files."""
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Remove tables that no later result reads."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, *names: str) -> None:
        """Remove all tables but these."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(root):
            self.drop(*{s.getPath().getName() for s in fs.listStatus(root)}.difference(names))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of long texts small, unless the session already asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def grouped(batches: Iterable[pa.RecordBatch], size: int = 1 << 20) -> Iterator[pa.Table]:
    """Join or cut Arrow batches to tables of about ``size`` bytes: vector code gets enough rows, memory stays bounded.

    A table holds one row at least, so a text longer than ``size`` is a table of its own.
    """
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        step = max(1, batch.num_rows * size // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            held.append(part)
            total += part.nbytes
            if total >= size:
                yield pa.Table.from_batches(held)
                held, total = [], 0
    if held:
        yield pa.Table.from_batches(held)
    held.clear()
    pa.default_memory_pool().release_unused()  # the worker lives on; other stages need the memory


def unused(name: str, *frames: DataFrame) -> str:
    """``name`` with as many underscores before it as no column of ``frames`` has; Spark's names ignore case."""
    taken = {c.lower() for df in frames for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; 0 for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)), F.lit(0)).cast("int")


def crc_remainder(doc_id: int | None, modulus: int) -> int:
    """The same in Python."""
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % modulus


# ---- byte-level words in numpy ---------------------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(WHITE)] = True
#: Letters and digits; every byte beyond ASCII counts as a letter.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BYTE = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with full avalanche."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if buffers[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray, drop: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all rows, and how many words each row has.

    Words are runs of bytes outside ``drop``; A-Z count as a-z.
    """
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    inside = ~drop[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    start[first] = inside[first]
    starts = np.flatnonzero(start)
    counts = np.diff(np.searchsorted(starts, offsets))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    letters = _LOWER[data[inside]]
    at = (np.cumsum(inside) - 1)[starts]
    lengths = np.diff(np.append(at, len(letters)))
    place = np.arange(len(letters)) - np.repeat(at, lengths)
    powers = np.full(int(lengths.max()), _BASE, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.add.reduceat(_BYTE[letters] * powers[place], at)
    return mix64(sums + lengths.astype(np.uint64)), counts
