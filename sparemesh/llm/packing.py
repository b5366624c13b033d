"""Packing: token pieces of documents into fixed windows by multiway differencing."""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, trimmed

PIECES = "start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"


# How text is cut before the merges (a fixed value of this vocabulary's public definition).
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=4)
def encoders(path: str, plain_controls: bool = False):
    """(tokenizer, the same merges in the faster encoder, the control strings) of a byte-level BPE file, once per worker.

    ``plain_controls``: control strings inside a text are ordinary text; else the tokenizer gives them their own ids.
    """
    from tiktoken import Encoding
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.encode_special_tokens = plain_controls
    # The vocabulary writes each byte as a printable character: printable Latin-1 as itself, the rest from 256 on, in order.
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
    special = {t.content for t in loaded.get_added_tokens_decoder().values()}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in loaded.get_vocab(with_added_tokens=False).items() if token not in special}
    return loaded, Encoding("same", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={}), special


def token_ids(path: str, text: str, plain_controls: bool = False) -> bytes:
    """The ids of a text, little-endian, 32 bits each. Latin-1 texts without a control string take the fast encoder, others the tokenizer itself."""
    slow, fast, controls = encoders(path, plain_controls)
    try:
        text.encode("latin-1")
        simple = not any(c in text for c in controls)
    except UnicodeEncodeError:
        simple = False
    if not simple:
        return np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    return np.asarray(fast.encode_ordinary(text), dtype="<u4").tobytes()


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: items into ``windows`` lists with near-equal sums.

    Each item starts as a partial partition (itself and empty lists). The two with the largest spread are merged, the
    fullest list of one with the emptiest of the other, so that their imbalances cancel, until one is left.
    """
    # a partial partition: spread, sums in falling order less the smallest, content as nested pairs
    heap: list = []
    for i, size in enumerate(sizes):
        heap.append((-size, i, [(size, i)]))
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) + len(b) <= windows:  # opposing ends only meet empty lists
            merged = a + b
        else:
            # a's fullest meet b's emptiest; lists not written are empty
            meet = len(a) + len(b) - windows
            b_low = b[len(b) - meet :]
            merged = a[: len(a) - meet] + b[: len(b) - meet]
            merged += [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[len(a) - meet :], reversed(b_low), strict=True)]
        merged.sort(key=lambda x: -x[0])
        if len(merged) == windows and merged[-1][0]:
            least = merged[-1][0]
            merged = [(s - least, c) for s, c in merged]
            spread = merged[0][0]
        else:
            spread = merged[0][0]
        heapq.heappush(heap, (-spread, serial, merged))
        serial += 1
    out: list[list[int]] = []
    for _, content in heap[0][2] if heap else []:
        items, todo = [], [content]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo.extend(x)
            else:
                items.append(x)
        out.append(items)
    return out


def fill_windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """The fewest windows from ``sum / capacity`` on whose differencing keeps every window within ``capacity``."""
    if not sizes:
        return []
    windows = max(1, math.ceil(sum(sizes) / capacity))
    while True:
        packed = difference(sizes, windows)
        if max(sum(sizes[i] for i in w) for w in packed) <= capacity:
            return packed
        windows += 1


def cut_points(n: int, capacity: int, crumb: int) -> list[int]:
    """Ends of a document's pieces: whole windows first, the rest in pieces of ``crumb`` that differencing can balance."""
    whole = n // capacity * capacity
    return [*range(capacity, whole + 1, capacity), *range(whole + crumb, n, crumb), *([n] if n > whole else [])]


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = 1024, crumb: int = 128, group_windows: int = 64, end_id: int = 0, text: str = "text", doc_id: str = "doc_id", plain_controls: bool = False
) -> DataFrame:
    """Pieces of all documents in windows of ``capacity`` tokens: doc_id, start, length, doc_tokens, ids, sequence_id, offset.

    ``ids`` holds the piece's token ids (little-endian, 32 bits each). A document's tokens are its text's ids (null: none) and ``end_id``;
    each token is in exactly one piece (a control string in a text has the tokenizer's own id, or with ``plain_controls`` is ordinary text), pieces fill a sequence gapless from offset 0. A document's whole windows are
    sequences of their own; what is left of it is cut into crumbs, and the crumbs of a group of documents are packed
    together. Repeated rows are packed each; a null id is kept. Other columns are not used. An empty table gives no pieces.

    Documents are dealt into groups by a hash of their place in the scan, as many as the estimated tokens fill, so a
    group has some ``group_windows`` windows of crumbs however many documents share an id, a source or a text. Rows move once.
    """
    measured = docs.agg(F.count("*"), F.sum(F.least(F.coalesce(F.octet_length(text), F.lit(0)) / 3.0 + 1, F.lit(capacity / 2.0)))).first()
    groups = max(1, math.ceil(float(measured[1] or 0) / (capacity * group_windows)))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("place"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype="<u4").tobytes()
        for whole in batches:
            for batch in byte_slices(whole, "text", 1 << 20):
                ids = [token_ids(tokenizer_path, t or "", plain_controls) + end for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("place"), pa.array(ids, pa.binary())], names=["doc_id", "place", "ids"])

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        base = int(part.grp.iloc[0]) << 32
        out: list[tuple] = []
        crumbs: list[tuple] = []
        sequence = 0
        for doc, ids in zip(part.doc_id, part.ids, strict=True):
            n, begin = len(ids) // 4, 0
            for stop in cut_points(n, capacity, crumb):
                piece = (doc, begin, stop - begin, n, ids[4 * begin : 4 * stop])
                if stop - begin == capacity:
                    out.append((*piece, base + sequence, 0))
                    sequence += 1
                else:
                    crumbs.append(piece)
                begin = stop
        for window in fill_windows([c[2] for c in crumbs], capacity):
            at = 0
            for i in sorted(window):
                out.append((*crumbs[i], base + sequence, at))
                at += crumbs[i][2]
            sequence += 1
        frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"])
        frame["doc_id"] = pd.array(frame.doc_id, dtype="Int64")
        return frame

    encoded = rows.mapInArrow(trimmed(encode), "doc_id long, place long, ids binary").withColumn("grp", F.pmod(F.xxhash64("place"), F.lit(groups)).cast("long"))
    return encoded.groupBy("grp").applyInPandas(pack, "doc_id long, " + PIECES)
