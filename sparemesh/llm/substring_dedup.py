"""Substring dedup: windows of words repeated across documents, found by doubling their length level by level."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, byte_slices, repeated, stored

NO_ID = (1 << 63) - 1
KEY = ["doc", "sum"]


def level_lengths(window: int, shortest: int = 7) -> list[int]:
    """Window lengths from at most twice ``shortest`` - 1 halves up to ``window``: 7, 13 or 7, 13, 25, 50. Each level's two halves overlap or touch."""
    lengths = [window]
    while lengths[0] > shortest or len(lengths) == 1 and lengths[0] > 1:
        lengths.insert(0, (lengths[0] + 1) // 2)
    return lengths


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc, sum, text): a row is known by its id (null: after all others) and a hash of its text."""
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("sum"), F.col(text).alias("text"))


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(v) for v in values)]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int64, copy=False)))


def _seeds(short: int, window: int):
    """Of each text: number of words, hash of all words (two longs), and the seeds.

    Of the short windows inside each longer window the one with the smallest hash is its seed. Two equal longer windows
    have the same seed, so it is enough to compare seeds, about a quarter of all places.
    """
    within = window - short + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                words = Words(batch.column("text"))
                grams = words.windows(short).view(np.int64)
                n, a, b, seeds = [], [], [], []
                for r in range(batch.num_rows):
                    begin, end = words.first[r], words.first[r + 1]
                    n.append(int(end - begin))
                    a.append(words.whole(r, 0))
                    b.append(words.whole(r, 1))
                    if end - begin >= window:
                        own = grams[begin : end - short + 1]
                        least = np.lib.stride_tricks.sliding_window_view(own, within).argmin(axis=1)
                        seeds.append(np.unique(own[np.unique(least + np.arange(len(least)))]))
                    else:
                        seeds.append(np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("sum"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), _lists(seeds)], names=["doc", "sum", "n_words", "a", "b", "found"])

    return run


def _candidates(length: int, previous: int, seeded: bool):
    """Of each text the distinct windows of ``length`` words (a, b) whose parts repeat at the previous level.

    After the seeds a window is a candidate if its own seed repeats; later, if its first and its last ``previous`` words both do.
    """
    within = length - previous + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                words = Words(batch.column("text"))
                parts = words.windows(previous).view(np.int64)
                a, b = words.windows(length, 0).view(np.int64), words.windows(length, 1).view(np.int64)
                found = batch.column("found")
                out_a, out_b = [], []
                for r in range(batch.num_rows):
                    begin, end = words.first[r], words.first[r + 1]
                    starts = np.zeros(0, np.int64)
                    if end - begin >= length:
                        own = parts[begin : end - previous + 1]
                        known = np.isin(own, found[r].values.to_numpy(zero_copy_only=False))
                        if seeded:
                            least = np.lib.stride_tricks.sliding_window_view(own, within).argmin(axis=1)
                            starts = np.flatnonzero(known[least + np.arange(len(least))])
                        else:
                            starts = np.flatnonzero(known[: len(known) - within + 1] & known[within - 1 :])
                    _, first = np.unique(a[begin + starts], return_index=True)
                    out_a.append(a[begin + starts[first]])
                    out_b.append(b[begin + starts[first]])
                yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("sum"), _lists(out_a), _lists(out_b)], names=["doc", "sum", "a", "b"])

    return run


def _removed(window: int):
    """Mark and drop the words in the windows listed for the text; all words of a copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                words = Words(batch.column("text"))
                hashes = words.windows(window).view(np.int64)
                found, copies = batch.column("found"), batch.column("copy").to_pylist()
                raw = words.data.tobytes()
                n, gone, kept = [], [], []
                for r in range(batch.num_rows):
                    begin, end = int(words.first[r]), int(words.first[r + 1])
                    cover = np.zeros(end - begin, dtype=bool)
                    if end - begin >= window:
                        if copies[r]:
                            cover[:] = True
                        elif found[r].is_valid and len(found[r]):
                            hit = np.flatnonzero(np.isin(hashes[begin : end - window + 1], found[r].values.to_numpy(zero_copy_only=False)))
                            edge = np.zeros(end - begin + 1, dtype=np.int32)
                            np.add.at(edge, hit, 1)
                            np.add.at(edge, hit + window, -1)
                            cover = np.cumsum(edge[:-1]) > 0
                    n.append(end - begin)
                    gone.append(int(cover.sum()))
                    stay = begin + np.flatnonzero(~cover)
                    kept.append(b" ".join([raw[s:e] for s, e in zip(words.starts[stay].tolist(), words.ends[stay].tolist(), strict=True)]))
                columns = [c for c in batch.schema.names if c not in ("found", "copy", "text")]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in columns], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=[*columns, "text", "n_words", "n_removed"]
                )

    return run


def repeated_windows(docs: DataFrame, window: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc, sum, copy, found): of each row whether its words equal those of a smaller id, else its windows that also start in one.

    Level by level: short windows (seeds) that occur in one row only are out; what is left is extended to twice the
    length, and only windows whose parts repeat are hashed and compared there; it ends at ``window``, since no longer
    repeat could cover another word. Windows are distinct per row before they are shuffled, copies of a whole text are represented by
    one row, and each level is a count with map-side combine and a join: a passage in a third of all documents is no group in memory.
    The 13-word windows are compared by 128 bits.
    """
    lengths = level_lengths(window)
    rows = _keyed(docs, text, doc_id)
    if len(lengths) == 1:
        lengths = [window, window]
    schema = "doc long, sum long, n_words long, a long, b long, found array<long>"
    sketch = stored(rows.mapInArrow(_seeds(lengths[0], lengths[1]), schema), "seeds")
    slim = sketch.select(*KEY, "n_words", "a", "b")
    first = slim.groupBy("n_words", "a", "b").agg(F.min("doc").alias("first"))
    classes = stored(slim.join(first, ["n_words", "a", "b"]).select(*KEY, (F.col("doc") > F.col("first")).alias("copy")).distinct(), "copies")
    originals = classes.where(~F.col("copy")).select(*KEY)
    seeds = sketch.where(F.size("found") > 0).select(*KEY, "found").join(originals, KEY).select(*KEY, F.explode("found").alias("part"))
    found = stored(repeated(seeds, ["part"]).groupBy(*KEY).agg(F.collect_set("part").alias("found")), "level-0")
    for k in range(1, len(lengths)):
        candidates = rows.join(found, KEY).mapInArrow(_candidates(lengths[k], lengths[k - 1], k == 1), "doc long, sum long, a array<long>, b array<long>")
        listed = stored(candidates, f"windows-{k}").select(*KEY, F.explode(F.arrays_zip("a", "b")).alias("w")).select(*KEY, F.col("w.a").alias("a"), F.col("w.b").alias("b"))
        groups = listed.groupBy("a", "b").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most")
        kept = listed.join(groups, ["a", "b"])
        if k == len(lengths) - 1:
            kept = kept.where("doc > least")
        found = stored(kept.groupBy(*KEY).agg(F.collect_set("a").alias("found")), f"level-{k}")
    return classes.join(found, KEY, "left")


def remove_repeats(docs: DataFrame, window: int = 13, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``text`` reduced to the words not covered by a repeat, joined by one space, plus ``n_words`` and ``n_removed``.

    Words are runs of anything but ASCII blanks, unchanged. A word goes if a window of ``window`` consecutive words around it also starts in a
    row with a smaller id. Windows are judged on the input, not on what is left. Texts with fewer words keep all of them.
    Null text: no words, an empty text. Null id: larger than any other, so such a row never takes words from
    another one. Rows with the same id never take words from each other. Other columns pass through; input columns named
    ``n_words`` or ``n_removed`` are replaced.
    """
    keep = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    flags = repeated_windows(docs, window, text, doc_id).select(F.col("doc").alias("__doc"), F.col("sum").alias("__sum"), "copy", "found")
    rows = docs.select(F.struct(*[F.col(c) for c in keep if c != text], F.lit(0).alias("__pad")).alias("__rest"), F.col(text).alias("text"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("__doc"))
    joined = rows.withColumn("__sum", F.xxhash64(F.coalesce("text", F.lit("")))).join(flags, ["__doc", "__sum"], "left").select("__rest", "text", "copy", "found")
    schema = joined.select("__rest", "text").withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")}).schema
    done = joined.mapInArrow(_removed(window), schema)
    return done.select(*[F.col("text").alias(c) if c == text else F.col(f"__rest.`{c}`") for c in keep], "n_words", "n_removed")
