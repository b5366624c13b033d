"""Line dedup: documents look their lines up in compact arrays behind a minimal perfect hash."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, mix64, stored, trimmed

BLANKS = " \t\n\x0b\x0c\r"
FOLDED = str.maketrans({c: c + 32 for c in range(65, 91)})
NO_ID = -(1 << 63)


def line_key(line: str) -> str:
    return line.strip(BLANKS).translate(FOLDED)


def key_hash(key: str) -> tuple[int, int]:
    digest = hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def shard_of(h2: np.ndarray, shards: int) -> np.ndarray:
    return (h2.view(np.uint64) >> np.uint64(33)).astype(np.int64) % shards


def _slots(h: np.ndarray, seed: np.ndarray | int, n: int) -> np.ndarray:
    return (mix64(h ^ mix64(np.atleast_1d(np.asarray(seed, dtype=np.uint64)), 5), 1) % np.uint64(n)).astype(np.int64)


def build_perfect_hash(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of a minimal perfect hash over distinct 64-bit ``h``, and each key's slot (a permutation of 0..n-1).

    Hash and displace: keys fall into about n/3 buckets; from the fullest on, each bucket gets the first seed
    that sends its keys to free slots; buckets of one key name their free slot directly (as -slot-1).
    """
    n = len(h)
    buckets = max(1, n // 3)
    home = _slots(h, 0, buckets)
    order = np.argsort(home, kind="stable")
    counts = np.bincount(home, minlength=buckets)
    first = np.concatenate(([0], np.cumsum(counts)))
    seeds, taken, slot = np.zeros(buckets, dtype=np.int32), np.zeros(n, dtype=bool), np.empty(n, dtype=np.int64)
    for b in np.argsort(-counts, kind="stable"):
        keys = order[first[b] : first[b + 1]]
        if len(keys) < 2:
            break
        begin, found = 1, False
        while not found:
            tried = np.arange(begin, begin + 64, dtype=np.uint64)
            places = _slots(h[keys][None, :], tried[:, None], n)
            lined = np.sort(places, axis=1)
            good = ~taken[places].any(axis=1) & (lined[:, 1:] != lined[:, :-1]).all(axis=1)
            if good.any():
                pick = int(good.argmax())
                seeds[b], slot[keys], found = begin + pick, places[pick], True
                taken[places[pick]] = True
            begin += 64
    free = np.flatnonzero(~taken)
    single = np.flatnonzero(counts == 1)
    keys = order[first[single]]
    slot[keys], seeds[single] = free[: len(single)], -free[: len(single)] - 1
    return seeds, slot


def find_slots(seeds: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    seed = seeds[_slots(h, 0, len(seeds))].astype(np.int64)
    return np.where(seed < 0, -seed - 1, _slots(h, np.maximum(seed, 0).astype(np.uint64), n))


SHARD = T.StructType(
    [T.StructField("shard", T.LongType())] + [T.StructField(c, T.BinaryType()) for c in ("seeds", "prints", "counts", "last")]
)


def _shard_arrays(keys: pd.DataFrame) -> pd.DataFrame:
    """One shard: the seeds, and by slot the fingerprint, the number of documents and the last document."""
    h = keys.h1.to_numpy(np.int64).view(np.uint64)
    seeds, slot = build_perfect_hash(h)
    at = np.empty(len(h), dtype=np.int64)
    at[slot] = np.arange(len(h))
    return pd.DataFrame(
        {
            "shard": keys.shard.iloc[:1].to_numpy(),
            "seeds": [seeds.astype("<i4").tobytes()],
            "prints": [keys.h2.to_numpy(np.int64)[at].astype("<i8").tobytes()],
            "counts": [keys.n.to_numpy(np.int64)[at].astype("<i8").tobytes()],
            "last": [keys["last"].to_numpy(np.int64)[at].astype("<i8").tobytes()],
        }
    )


def line_counts(docs: DataFrame, min_chars: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(h1, h2, n, last): each distinct long line's 128-bit hash, in how many documents it occurs, and the largest id.

    Lines are made distinct per row and counted per batch in the task, then summed with map-side combine: a
    line that is in a third of all documents arrives as a few rows. Only rows whose id occurs again take the longer way over
    distinct (line, id) pairs. Rows without an id are documents of their own.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias(doc_id), F.col(text).alias(text))
    again = stored(rows.where(F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.count("*").alias("n")).where("n > 1").select(doc_id), "repeated-ids")
    if again.isEmpty():
        return _row_counts(rows, min_chars, text, doc_id)
    single = _row_counts(rows.join(again, doc_id, "left_anti"), min_chars, text, doc_id)
    shared = _row_counts(rows.join(again, doc_id, "left_semi").repartition(doc_id), min_chars, text, doc_id, [doc_id]).select("h1", "h2", F.lit(1).cast("long").alias("n"), "last")
    return single.union(shared).groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def _row_counts(rows: DataFrame, min_chars: int, text: str, doc_id: str, by: list[str] | None = None) -> DataFrame:
    """Lines counted by row; with ``by`` once for every id (``last`` is that id)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, text, 16 << 20):
                seen: dict[str | tuple, list[int]] = {}
                for t, i in zip(batch.column(text).to_pylist(), batch.column(doc_id).to_pylist(), strict=True):
                    i = NO_ID if i is None else i
                    for key in {line_key(x) for x in (t or "").split("\n") if len(x) >= min_chars}:
                        if len(key) >= min_chars:
                            entry = seen.setdefault((key, i) if by else key, [0, i])
                            entry[0] += 1
                            entry[1] = max(entry[1], i)
                hashes = [key_hash(k[0] if by else k) for k in seen]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in hashes], pa.int64()), pa.array([x[1] for x in hashes], pa.int64()), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.int64())],
                    names=["h1", "h2", "n", "last"],
                )

    found = rows.select(doc_id, text).mapInArrow(trimmed(count), "h1 long, h2 long, n long, last long")
    return found.groupBy("h1", "h2", *(["last"] if by else [])).agg(F.sum("n").alias("n"), *([] if by else [F.max("last").alias("last")]))


def line_index(docs: DataFrame, min_chars: int, min_docs: int, shard_keys: int = 2000, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The sharded index over the lines found in ``min_docs`` rows: one row per shard of about ``shard_keys`` lines.

    A line below that count can never be dropped, so it has no slot; a probe for it fails on the fingerprint.
    """
    frequent = stored(line_counts(docs, min_chars, text, doc_id).where(F.col("n") >= min_docs), "lines")
    shards = max(1, math.ceil(frequent.count() / shard_keys))
    keys = frequent.withColumn("shard", F.shiftrightunsigned("h2", 33) % F.lit(shards))
    return stored(keys.groupBy("shard").applyInPandas(_shard_arrays, SHARD), "line-index").withColumn("of", F.lit(shards).cast("long"))


class LineProbe:
    """Some shards of the index in memory, and the test which lines of a document go."""

    def __init__(self, shards: list, min_docs: int):
        self.min_docs = min_docs
        self.shards = {shard: (np.frombuffer(seeds, "<i4"), *(np.frombuffer(x, "<i8") for x in arrays)) for shard, seeds, *arrays in shards}

    def dropped(self, shard: np.ndarray, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h1), dtype=bool)
        order = np.argsort(shard, kind="stable")
        names, first = np.unique(shard[order], return_index=True)
        for name, at in zip(names, np.split(order, first[1:]), strict=True):
            if name in self.shards:
                seeds, prints, counts, last = self.shards[name]
                slot = find_slots(seeds, h1[at].view(np.uint64), len(prints))
                out[at] = (prints[slot] == h2[at]) & (counts[slot] >= self.min_docs) & (last[slot] != ids[at])
        return out


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batch_mb: int = 64, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with repeated lines removed from ``text``, plus ``n_lines`` (before) and ``n_dropped``.

    A line's key is the line without blanks at both ends, A-Z lower-cased. Keys of at least ``min_chars`` code points
    found in at least ``min_docs`` documents (ids) lose all their lines except in the row(s) with the largest id that hold it.
    Null and empty texts are one empty line and stay as they are; a null id counts as smaller than any other;
    rows of one id are one document, rows without an id each one of their own. Other columns pass through; an input ``n_lines`` or
    ``n_dropped`` is replaced.

    The index is broadcast in batches of whole shards of at most ``batch_mb`` MB (28 bytes a line, lines below
    ``min_docs`` excluded). One batch is the usual case and needs no shuffle of the texts; with more,
    the documents are probed batch after batch, marking the lines to drop, with a stored table in between.
    """
    spark = docs.sparkSession
    index = line_index(docs, min_chars, min_docs, text=text, doc_id=doc_id)
    size = sum(F.octet_length(c) for c in ("seeds", "prints", "counts", "last"))
    total, of = index.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max("of"), F.lit(1))).first()
    batches = max(1, math.ceil(total / (batch_mb << 20)))
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(*keep).withColumn("__drop", F.array().cast("array<int>"))
    for b in range(batches):
        shards = index.where(F.pmod("shard", F.lit(batches)) == b).collect()
        probe = spark.sparkContext.broadcast([(r.shard, r.seeds, r.prints, r.counts, r.last) for r in shards])
        rows = _probed(rows if b == 0 else stored(rows, "probed"), probe, of, min_chars, min_docs, text, doc_id)
    return _rewritten(rows, keep, text)


def _probed(rows: DataFrame, probe, of: int, min_chars: int, min_docs: int, text: str, doc_id: str) -> DataFrame:
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = LineProbe(probe.value, min_docs)
        for whole in batches:
            for batch in byte_slices(whole, text, 16 << 20):
                row, at, hashes, ids = [], [], [], []
                known: dict[str, tuple[int, int]] = {}
                for r, (t, i) in enumerate(zip(batch.column(text).to_pylist(), batch.column(doc_id).to_pylist(), strict=True)):
                    for k, line in enumerate((t or "").split("\n")):
                        if len(line) >= min_chars and len(key := line_key(line)) >= min_chars:
                            if key not in known:
                                known[key] = key_hash(key)
                            row.append(r)
                            at.append(k)
                            hashes.append(known[key])
                            ids.append(NO_ID if i is None else i)
                drop = [list(x or ()) for x in batch.column("__drop").to_pylist()]
                if row:
                    h = np.array(hashes, dtype=np.int64).reshape(-1, 2)
                    gone = loaded.dropped(shard_of(h[:, 1].copy(), of), h[:, 0].copy(), h[:, 1], np.array(ids, dtype=np.int64))
                    for j in np.flatnonzero(gone):
                        drop[row[j]].append(at[j])
                k = batch.schema.get_field_index("__drop")
                yield batch.set_column(k, batch.schema.field(k), pa.array(drop, batch.schema.field(k).type))

    return rows.mapInArrow(trimmed(run), schema)


def _rewritten(rows: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The lines that are not listed in ``__drop``, joined again; a text that loses none stays as it is."""
    slim = rows.select(F.struct(*[F.col(c) for c in keep if c != text], F.lit(0).alias("__pad")).alias("__rest"), F.col(text).alias("text"), "__drop")
    schema = slim.select("__rest", "text").withColumns({"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text", 16 << 20):
                texts, drops, sizes = batch.column("text").to_pylist(), batch.column("__drop"), []
                for r, t in enumerate(texts):
                    drop = drops[r].values.to_numpy(zero_copy_only=False)
                    if not len(drop):
                        sizes.append((t or "").count("\n") + 1)
                        continue
                    lines = t.split("\n")
                    gone = bytearray(len(lines))
                    for k in drop.tolist():
                        gone[k] = 1
                    sizes.append(len(lines))
                    texts[r] = "\n".join([x for x, g in zip(lines, gone, strict=True) if not g])
                dropped = pa.array(np.diff(drops.offsets.to_numpy()), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("__rest"), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), dropped], names=["__rest", "text", "n_lines", "n_dropped"])

    done = slim.mapInArrow(trimmed(run), schema)
    return done.select(*[F.col("text").alias(c) if c == text else F.col(f"__rest.`{c}`") for c in keep], "n_lines", "n_dropped")
