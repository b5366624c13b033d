"""N-gram Jaccard join: PartEnum signatures bring together all sets similar enough; groups of links become components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, byte_slices, components, discard, mix64, repeated, stored, trimmed

# PartEnum: each first-level part of the domain is cut into two (of many parts) or three, and one of them may be left out.
MANY = 64
# Bits of a set's parity sketch: 64 for each of these columns.
ODD = [f"o{i}" for i in range(8)]
# Signatures are kept in so many columns by their first bits; one column after the other is shuffled, so the disk holds a part of them twice, not all.
SLICES = 8
# Up to so many ids of texts to be compared are broadcast to the texts; beyond it the join shuffles.
MOST_NAMED = 1_000_000


def most_apart(total: int, percent: int) -> int:
    """Largest symmetric difference of two sets with ``total`` elements together and a Jaccard similarity of ``percent``."""
    return (100 - percent) * total // (100 + percent)


@lru_cache(maxsize=100_000)
def band(size: int, percent: int) -> tuple[int, int]:
    """(number, largest size) of the size band of a set. A band spans three similarity steps, so a partner is in the same or the next one."""
    lo, number = 1, 0
    while True:
        hi = max(lo, lo * 100**3 // percent**3)
        if size <= hi:
            return number, hi
        lo, number = hi + 1, number + 1


def signatures(elements: np.ndarray, percent: int) -> np.ndarray:
    """The PartEnum signatures of a set of distinct hashes.

    For the band's largest sizes a similar pair differs in at most d elements. Elements are dealt by hash into d//2 + 2 first-level
    parts, so two of them at least hold one differing element at most; cut further, such a part agrees in all but one of
    its cuts. Each signature is the content of one part less one of its cuts. A set signs for its own band, and for the next one
    if a partner can be there.

    Empty content says nothing, so it is not signed: of the two agreeing parts one is not empty, unless both are. Only a
    set with empty content in two parts or more signs those pairs of places, so no pair is lost. With ``MANY`` parts
    that is left out: a pair at the very threshold agrees in some 40 percent of them, and the chance that all those are
    empty is below 10^-12, as rare as equal hashes of different words.
    """
    number, hi = band(len(elements), percent)
    bands = [(number, hi)]
    if 100 * len(elements) // percent > hi:
        bands.append(band(hi + 1, percent))
    out = []
    for number, hi in bands:
        apart = most_apart(2 * hi, percent)
        if apart < 1:
            continue  # only equal sets are similar, and those are one class already
        parts = apart // 2 + 2
        cuts = 2 if parts >= MANY else 3
        h = mix64(elements, number + 20)
        place = ((h >> np.uint64(34)) % np.uint64(parts)).astype(np.int64) * cuts + (h & np.uint64(0xFFFFFF)).astype(np.int64) % cuts
        sums = np.zeros(parts * cuts, dtype=np.uint64)
        np.add.at(sums, place, mix64(elements, 21))
        sums = sums.reshape(parts, cuts)
        counts = np.bincount(place, minlength=parts * cuts).reshape(parts, cuts)
        content = sums.sum(axis=1, dtype=np.uint64)[:, None] - sums
        filled = (counts.sum(axis=1)[:, None] - counts) > 0
        labels = np.arange(parts * cuts, dtype=np.uint64).reshape(parts, cuts) + np.uint64(number << 32)
        out.append(mix64(content + mix64(labels, 22), 23)[filled])
        if parts < MANY and (~filled).sum() > 1:
            empty = [(int(p), int(t)) for p, t in zip(*np.nonzero(~filled), strict=True)]
            twos = [p * cuts + s | (q * cuts + t) << 24 for (p, s), (q, t) in combinations(empty, 2) if p != q]
            out.append(mix64(np.array(twos, dtype=np.uint64) + np.uint64(number << 50), 24))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def parity_sketch(elements: np.ndarray) -> np.ndarray:
    """Parities of the number of elements in each of 512 cells: two sketches never differ in more bits than the sets in elements."""
    bits = np.bincount((mix64(elements, 25) % np.uint64(64 * len(ODD))).astype(np.int64), minlength=64 * len(ODD)) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def sized_sketch(elements: np.ndarray) -> bytes | None:
    """The same parities over cells in proportion to the set, three for four elements or more; none where ``parity_sketch`` has as many.

    In 512 cells long sets look alike: some 256 cells differ whatever the sets. The number of cells is a power of two, so the sketch of a larger
    set folds to the cells of a smaller one.
    """
    cells = 64 * len(ODD)
    while 4 * cells < 3 * len(elements):
        cells *= 2
    if cells == 64 * len(ODD):
        return None
    bits = np.bincount((mix64(elements, 25) % np.uint64(cells)).astype(np.int64), minlength=cells) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(x: bytes, y: bytes) -> int:
    """Differing cells of two sized sketches, the larger one folded to the cells of the other; never more than the sets differ in elements."""
    small, large = sorted((x, y), key=len)
    folded, bits = int.from_bytes(large, "little"), 8 * len(large)
    while bits > 8 * len(small):
        bits //= 2
        folded = (folded >> bits) ^ (folded & ((1 << bits) - 1))
    return (folded ^ int.from_bytes(small, "little")).bit_count()


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Of each text the distinct hashes of its ``width`` consecutive words, A-Z lower-cased; a shorter text is one shingle, none is empty."""
    words = Words(column, fold=True)
    hashes = words.windows(width)
    out = []
    for r in range(len(column)):
        begin, end = words.first[r], words.first[r + 1]
        if end - begin >= width:
            out.append(np.unique(hashes[begin : end - width + 1]))
        else:
            out.append(np.array([words.whole(r)] if end > begin else [], dtype=np.int64).view(np.uint64))
    return out


SIGNED = [f"signed{k}" for k in range(SLICES)]
SKETCH = "doc_id long, n long, a long, b long, " + ", ".join(f"{o} long" for o in ODD) + ", sized binary, " + ", ".join(f"{c} array<long>" for c in SIGNED)


def _sketch(width: int, percent: int):
    firsts = np.array([k * (1 << 64) // SLICES for k in range(SLICES)], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                sets = shingle_sets(batch.column("text"), width)
                a = np.array([mix64(s, 26).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
                b = np.array([mix64(s, 27).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
                odd = np.array([parity_sketch(s) for s in sets]).reshape(len(sets), len(ODD))
                sized = pa.array([sized_sketch(s) for s in sets], pa.binary())
                lists = [signatures(s, percent) if len(s) else np.zeros(0, np.uint64) for s in sets]  # each in order, so a slice is a range
                cuts = [np.searchsorted(x, firsts) for x in lists]
                signed = []
                for k in range(SLICES):
                    parts = [x[c[k] : c[k + 1] if k + 1 < SLICES else len(x)].view(np.int64) for x, c in zip(lists, cuts, strict=True)]
                    ends = np.cumsum([0, *(len(x) for x in parts)]).astype(np.int32)
                    signed.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(a), pa.array(b), *[pa.array(odd[:, i].copy()) for i in range(len(ODD))], sized, *signed],
                    names=["doc_id", "n", "a", "b", *ODD, "sized", *SIGNED],
                )

    return run


def _similar(width: int, percent: int):
    """The pairs whose sets are similar: the exact check."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                batch = whole.slice(begin, 500)
                sets: dict = {}
                for c in ("x", "y"):
                    texts = dict(zip(batch.column(f"{c}_sum").to_pylist(), range(batch.num_rows), strict=True))
                    new = {key: row for key, row in texts.items() if key not in sets}
                    for key, found in zip(new, shingle_sets(batch.column(f"{c}_text").take(pa.array(list(new.values()), pa.int64())), width), strict=True):
                        sets[key] = found
                keep = []
                for x, y in zip(batch.column("x_sum").to_pylist(), batch.column("y_sum").to_pylist(), strict=True):
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    keep.append(100 * both >= percent * (len(sets[x]) + len(sets[y]) - both))
                yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return run


def _may_be_similar(percent: int):
    """Sizes and parity sketches allow it. Never false for a similar pair."""
    differ = sum((F.bit_count(F.col(f"x_{o}").bitwiseXOR(F.col(f"y_{o}"))) for o in ODD), F.lit(0))
    sizes = 100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n")
    return sizes & (differ * (100 + percent) <= (100 - percent) * (F.col("x_n") + F.col("y_n")))


def _sized_may_be_similar(percent: int):
    """The pairs whose sized sketches allow it, and those without them. Never drops a similar pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(*(batch.column(c).to_pylist() for c in ("x_n", "y_n", "x_sized", "y_sized")), strict=True)
            keep = [x is None or y is None or sketch_distance(x, y) * (100 + percent) <= (100 - percent) * (m + n) for m, n, x, y in sides]
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return run


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, rounds: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Two rows link when the Jaccard similarity of their sets of ``width``-word shingles is at least ``percent`` / 100; ``component_id`` is the
    smallest id reachable by links. Texts of fewer words are one shingle; null and empty texts have no shingle, link
    with nothing and are their own component. Equal sets always link. An id that occurs with several texts stands for all of them.
    A row without id gets the component of an equal set with an id, else null. Other columns are ignored.

    Equal sets become one class first. Classes that share a PartEnum signature may be similar. Instead of all pairs
    of such a group, each member is compared with the group's hub: the member with the most shared signatures,
    then a random one. A last pass compares what the hubs did not connect: only members of different
    components, only those whose sizes and parity sketches allow a link. Each candidate is
    checked exactly on the texts. No link between different components is lost, and none inside a component is needed.

    Disk: signatures, several times the rest, are shuffled slice by slice and go as soon as the shared ones are known; only texts of candidates are copied.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketch = stored(rows.mapInArrow(trimmed(_sketch(width, percent)), SKETCH), "sets")
    classes = sketch.where("n > 0").groupBy("n", "a", "b").agg(F.min("doc_id").alias("id"))
    members = stored(sketch.select("doc_id", "n", "a", "b").join(classes, ["n", "a", "b"], "left").select("doc_id", "n", "id"), "members")
    sole = classes.where("id IS NOT NULL")
    one_each = lambda *columns: sketch.join(sole, ["n", "a", "b"]).where("doc_id = id").select("id", *columns)
    nodes = stored(one_each("n", *ODD, "sized"), "classes")
    shared = None
    for column in SIGNED:
        part = stored(repeated(one_each(F.explode(column).alias("sig")), ["sig"]), "shared")
        shared = part if shared is None else shared.union(part)
    discard(sketch)
    facts, sized = nodes.select("id", "n", *ODD), nodes.select("id", "n", "sized")
    weight = shared.groupBy("id").agg(F.count("*").alias("w"))

    links = component = tested = None
    for turn in range(rounds + 1):
        live = shared.join(weight, "id")
        if component is None:
            live = live.withColumn("component", F.col("id"))
        else:
            live = live.join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
        preference = F.struct(F.col("w") if turn == 0 else F.xxhash64("id", F.lit(turn)), -F.col("id"))
        groups = live.groupBy("sig").agg(F.max_by(F.struct("id", "component"), preference).alias("hub"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"))
        groups = groups.where("lo < hi" if turn == 0 else "lo < hi AND size > 2").select("sig", F.col("hub.id").alias("hub"), F.col("hub.component").alias("hub_component"))
        if turn < rounds:
            pairs = live.join(groups, "sig").where("component != hub_component").select(F.least("id", "hub").alias("x"), F.greatest("id", "hub").alias("y")).distinct()
            side = lambda c: facts.select(*[F.col(f).alias(f"{c}_{f}" if f != "id" else c) for f in facts.columns])
            pairs = pairs.join(side("x"), "x").join(side("y"), "y").where(_may_be_similar(percent)).select("x", "y")
        else:
            rest = live.join(groups.select("sig"), "sig").select("sig", "id", "component").join(facts, "id")
            side = lambda c: rest.select("sig", *[F.col(f).alias(f"{c}_{f}" if f != "id" else c) for f in ("id", "component", "n", *ODD)])
            apart = (F.col("x") < F.col("y")) & (F.col("x_component") != F.col("y_component")) & _may_be_similar(percent)
            left, right = side("x").alias("l"), side("y").alias("r")
            pairs = left.join(right, (F.col("l.sig") == F.col("r.sig")) & apart).select("x", "y").distinct()
        pairs = pairs if tested is None else pairs.join(tested, ["x", "y"], "left_anti")
        side = lambda c: sized.select(F.col("id").alias(c), F.col("n").alias(f"{c}_n"), F.col("sized").alias(f"{c}_sized"))
        pairs = stored(pairs.join(side("x"), "x").join(side("y"), "y").mapInArrow(trimmed(_sized_may_be_similar(percent)), "x long, y long"), f"pairs-{turn}")
        tested = pairs if tested is None else tested.union(pairs)
        named = pairs.select(F.col("x").alias("doc_id")).union(pairs.select("y")).distinct()
        named = F.broadcast(named) if named.count() <= MOST_NAMED else named
        texts = stored(rows.join(named, "doc_id", "left_semi").select("doc_id", "text", F.xxhash64("text", F.lit(1)).alias("sum")), "texts")
        text_of = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"{c}_text"), F.col("sum").alias(f"{c}_sum"))
        found = pairs.join(text_of("y"), "y").join(text_of("x"), "x").mapInArrow(trimmed(_similar(width, percent)), "x long, y long")
        found = stored(found.select(F.col("x").alias("a"), F.col("y").alias("b")), f"links-{turn}")
        discard(texts)
        links = found if links is None else links.union(found)
        component = components(links, "component")
    out = members.join(component, "id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "id", F.when(F.col("n") == 0, F.col("doc_id"))).alias("component_id"))
