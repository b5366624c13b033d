"""Helpers the training-data operators share: stored tables, byte slices, word hashes, components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

# A word is a run of anything but these ASCII characters (JVM and Python regular expressions alike).
WORD = r"[^\x20\x09-\x0D]+"
# Spark drops a finished write's shuffle files at once, not when the driver next collects garbage.
CLEANING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and read again.

    Cuts the lineage like a checkpoint, but keeps column pruning and real sizes for the optimiser; a
    task lost with its executor rereads the files.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANING, None)
    try:
        spark.conf.set(CLEANING, "true")
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANING) if before is None else spark.conf.set(CLEANING, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(column: Column | str) -> Column:
    return F.translate(column, UPPER, LOWER)


def trimmed(run: Callable) -> Callable:
    """``run`` of mapInArrow, whose memory goes back to the system when its task ends.

    Spark keeps the Python workers of a finished task for the next one, more of them than an executor has cores where a task
    needs two; what they keep counts against whatever runs then.
    """

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
        if trim:
            trim(0)

    return ended


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``limit`` bytes of text (one row at least)."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < batch.num_rows:
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread 64-bit values over 64 bits (the finaliser of splitmix64)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
BYTE = mix64(np.arange(256, dtype=np.uint64), 7)
BASE, WORD_BASE = 0xD6E8FEB86659FD93, (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def _sums(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each range [start, end) its polynomial in ``base``: one prefix sum for all, modulo 2^64."""
    n = len(values)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * _powers(base, n), out=total[1:])
    inverse = _powers(pow(base, -1, 1 << 64), n + 1)
    return (total[ends] - total[starts]) * inverse[starts]


class Words:
    """The words of the texts of one batch, hashed together.

    ``hashes``: 64 bits a word; the words of row r are ``hashes[first[r]:first[r + 1]]``;
    ``starts`` and ``ends`` are their byte ranges in ``data``. A null text has no word.
    ``blank`` marks the bytes that separate words.
    """

    def __init__(self, column: pa.Array, fold: bool = False, blank: np.ndarray = SPACE):
        column = column.cast(pa.large_string())
        texts = pc.fill_null(column, "")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.data = FOLD[raw] if fold else raw
        self.blank = blank
        inner = self.offsets[(self.offsets > 0) & (self.offsets < len(raw))]
        solid = ~blank[raw]
        edge = solid.copy()
        edge[1:] &= ~solid[:-1]
        edge[inner] = solid[inner]
        self.starts = np.flatnonzero(edge)
        edge = solid.copy()
        edge[:-1] &= ~solid[1:]
        edge[inner - 1] = solid[inner - 1]
        self.ends = np.flatnonzero(edge) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.hashes = mix64(_sums(BYTE[self.data], BASE, self.starts, self.ends) + (self.ends - self.starts).astype(np.uint64))

    def ids(self) -> np.ndarray:
        """Of each word a number, equal for equal words only: words of one hash are compared byte by byte with the first of them."""
        order = np.argsort(self.hashes)
        new = np.ones(len(order), dtype=bool)
        new[1:] = self.hashes[order[1:]] != self.hashes[order[:-1]]
        ids = np.empty(len(order), dtype=np.int64)
        ids[order] = np.cumsum(new) - 1
        at = order[new]
        size = self.ends - self.starts
        same = bool((size == size[at][ids]).all())
        if same:
            # shift from each byte to its place in the first word of that hash
            shift = np.repeat(self.starts[at][ids] - self.starts, size)
            inside = np.flatnonzero(~self.blank[self.data])
            same = bool((self.data[inside] == self.data[inside + shift]).all())
        if not same:
            raw, known = self.data.tobytes(), {}
            for i in range(len(ids)):
                ids[i] = known.setdefault(raw[self.starts[i] : self.ends[i]], len(known))
        return ids

    def whole(self, row: int, which: int = 0) -> int:
        """Hash of all words of a row, with their number."""
        own = mix64(self.hashes[self.first[row] : self.first[row + 1]], which + 11)
        with np.errstate(over="ignore"):
            return int(mix64((own * _powers(WORD_BASE[which], len(own))).sum(dtype=np.uint64) + np.array([len(own)], dtype=np.uint64), which + 3).view(np.int64)[0])

    def windows(self, width: int, which: int = 0) -> np.ndarray:
        """Hash of the ``width`` words from each word on; the last ones of a row reach into the next row and are not to be used."""
        n = len(self.hashes)
        if n < width:
            return np.zeros(0, dtype=np.uint64)
        at = np.arange(n - width + 1)
        return mix64(_sums(mix64(self.hashes, which + 11), WORD_BASE[which], at, at + width), which + 3)


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key occurs twice or more.

    Two plain steps that stand any skew: a count with map-side combine, then a join on the key that
    the adaptive planner may split. No group is gathered.
    """
    return rows.join(rows.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n"), keys)


def components(links: DataFrame, label: str) -> DataFrame:
    """(id, component) of each node of ``links`` (a, b): the smallest id it reaches.

    Alternating stars: every node hands its larger neighbours, then its smaller ones, to the smallest
    neighbour. Only minima and distinct pairs are computed, so a node with very many links is
    no group in memory. The number of rounds is logarithmic in practice; the loop ends when nothing changes.
    """
    edges = stored(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(nearest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        nearest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(nearest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(nearest.select("a", F.col("m").alias("b")))
        edges = stored(small.distinct(), label)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
