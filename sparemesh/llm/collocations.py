"""Phrase collocations: n-grams known by Rabin-Karp fingerprints until the frequent ones are read back from the texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import SPACE, WORD_BASE, Words, _powers, _sums, byte_slices, mix64, stored

NO_ID = (1 << 63) - 1
BREAK = np.zeros(256, dtype=bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
APART = BREAK | SPACE
KEY = ["lang", "n", "print"]
PLACE = ["lang", "doc", "sum"]
PHRASES = "lang string, n long, a long, phrase string"
BATCH = 4 << 20  # bytes of text whose n-grams are counted together
BLOCK = 4096  # slots of the filter in one row


class Grams:
    """The n-grams of a batch of texts, A-Z lower-cased, none across a break.

    ``prints(n, at)`` gives the fingerprints of the n words from the places ``at`` on: differences of prefix polynomials over the words' hashes,
    which are themselves polynomials over bytes, mixed with the row's language.
    """

    def __init__(self, batch: pa.RecordBatch, bits: int = 64):
        self.words = words = Words(batch.column("text"), fold=True, blank=APART)
        self.langs = batch.column("lang").to_pylist()
        salt = np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs], dtype=np.uint64)
        self.rows = np.repeat(np.arange(batch.num_rows), np.diff(words.first))
        self.salt, self.bits = salt, bits
        # the byte before a word, or the bytes since the last word, hold a break
        broken = np.flatnonzero(BREAK[words.data])
        new = np.ones(len(words.starts), dtype=bool)
        before = np.searchsorted(broken, words.starts)
        new[1:] = (self.rows[1:] != self.rows[:-1]) | (before[1:] != before[:-1])
        self.joined = ~new  # in one piece with the word before
        n = len(words.hashes)
        self.total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mix64(words.hashes, 11) * _powers(WORD_BASE[0], n), out=self.total[1:])
        self.inverse = _powers(pow(WORD_BASE[0], -1, 1 << 64), n + 1)

    def longer(self, alive: np.ndarray, n: int) -> np.ndarray:
        """Places whose n words lie in one piece, both n - 1 words of which are alive."""
        return alive[:-1] & alive[1:] & self.joined[n - 1 :] if len(alive) else alive

    def prints(self, n: int, at: np.ndarray) -> np.ndarray:
        values = (self.total[at + n] - self.total[at]) * self.inverse[at]
        values = mix64(values ^ self.salt[self.rows[at]], 20 + n)
        return values if self.bits == 64 else values >> np.uint64(64 - self.bits)

    def grouped(self, n: int, at: np.ndarray, prints: np.ndarray, ids: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences ordered by fingerprint, the first of each, the group of each, and whether it has the words and language of that first one."""
        order = np.argsort(prints, kind="stable")
        new = np.ones(len(order), dtype=bool)
        new[1:] = prints[order[1:]] != prints[order[:-1]]
        begin, group = np.flatnonzero(new), np.cumsum(new) - 1
        at = at[order]
        first = at[begin][group]
        same = codes[self.rows[at]] == codes[self.rows[first]]
        for k in range(n):
            same &= ids[at + k] == ids[first + k]
        return order, begin, group, same

    def passing(self, lengths: tuple[int, ...], open_slots: np.ndarray | None, known: set[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, places, fingerprints) of the n-grams that may be frequent: every part of them of a length in ``known`` falls into an open slot."""
        alive = np.ones(len(self.words.hashes), dtype=bool)
        for n in range(1, max(lengths) + 1):
            alive = self.longer(alive, n) if n > 1 else alive
            if n not in lengths and n not in known:
                continue
            at = np.flatnonzero(alive)
            prints = self.prints(n, at)
            if n in known:
                slots = (prints & np.uint64(8 * len(open_slots) - 1)).astype(np.int64)
                fine = (open_slots[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0
                alive[at[~fine]] = False
                at, prints = at[fine], prints[fine]
            if n in lengths:
                yield n, at, prints


def _slot_counts(lengths: tuple[int, ...], slots: int, most: int, opened, known: set[int], bits: int):
    """Of each task how many n-grams fall into each slot, at most ``most``; one row per block of slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(slots, dtype=np.uint8)
        before = opened.value if opened else None
        for whole in batches:
            for batch in byte_slices(whole, "text", BATCH):
                grams = Grams(batch, bits)
                for _, _, prints in grams.passing(lengths, before, known):
                    found, times = np.unique((prints & np.uint64(slots - 1)).astype(np.uint32), return_counts=True)
                    found = found.astype(np.int64)
                    table[found] = np.minimum(table[found] + np.minimum(times, most), most)
        blocks = table.reshape(-1, min(BLOCK, slots))
        used = np.flatnonzero(blocks.any(axis=1))
        for part in np.array_split(used, max(1, len(used) // 512)):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([blocks[i].tobytes() for i in part], pa.binary())], names=["block", "counts"])

    return run


def _added(slots: int, most: int):
    """Counts of all tasks added up slot by slot; a slot that reaches ``most`` is one bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                own = total.setdefault(block, np.zeros(len(counts), dtype=np.uint16))
                np.minimum(own + np.frombuffer(counts, dtype=np.uint8), most, out=own)
        full = {k: np.packbits(v >= most, bitorder="little").tobytes() for k, v in total.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(full), pa.int64()), pa.array(list(full.values()), pa.binary())], names=["block", "open"])

    return run


def _open_slots(docs: DataFrame, lengths: tuple[int, ...], slots: int, most: int, opened, known: set[int], bits: int) -> np.ndarray:
    counts = docs.mapInArrow(_slot_counts(lengths, slots, most, opened, known, bits), "block long, counts binary")
    rows = counts.repartition("block").mapInArrow(_added(slots, most), "block long, open binary").toArrow()
    size = min(BLOCK, slots) // 8
    table = np.zeros(slots // 8, dtype=np.uint8)
    for block, part in zip(rows.column("block").to_pylist(), rows.column("open").to_pylist(), strict=True):
        table[block * size : (block + 1) * size] = np.frombuffer(part, dtype=np.uint8)
    return table


class Tally:
    """What a task has found so far: per language, length and fingerprints the number of occurrences and the place in the smallest id.

    Rows of equal fingerprints are added up whenever ``most`` have gathered; they go on when the task ends or more than half of those differ.
    """

    def __init__(self, most: int = 1_000_000):
        self.most, self.langs, self.parts, self.size = most, {}, [], 0

    def add(self, *columns: np.ndarray) -> None:
        """lang number, n, print, check, times, doc, sum, place"""
        self.parts.append(columns)
        self.size += len(columns[0])

    def full(self) -> bool:
        if self.size <= self.most:
            return False
        self.merge()
        return self.size > self.most // 2

    def merge(self) -> None:
        if not self.parts:
            return
        columns = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
        lang, n, prints, check, times, doc, *_ = columns
        order = np.lexsort((doc, n, lang, check, prints))
        new = np.ones(len(order), dtype=bool)
        new[1:] = False
        for x in (prints, check, lang, n):
            x = x[order]
            new[1:] |= x[1:] != x[:-1]
        begin = np.flatnonzero(new)
        kept = [x[order[begin]] for x in columns]
        kept[4] = np.add.reduceat(times[order], begin) if len(begin) else times
        self.parts, self.size = [tuple(kept)], len(begin)

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        names = np.array(list(self.langs), dtype=object)
        for lang, *rest in self.parts:
            for at in range(0, len(lang), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(names[lang[part]], pa.string()), *(pa.array(x[part], pa.int64()) for x in rest)], names=[*KEY, "check", "times", "doc", "sum", "place"])
        self.parts, self.size = [], 0


def _occurrences(longest: int, opened, bits: int):
    """(lang, n, print, check, times, doc, sum, place): how often a task meets a fingerprint and where.

    Each occurrence is held against the words at the first one of its batch; one that has other words gets a row of its own, with another
    ``check`` (a second polynomial of the same words). Length 0 counts all words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for whole in batches:
            for batch in byte_slices(whole, "text", BATCH):
                grams, (docs, sums) = Grams(batch, bits), (batch.column(c).to_numpy() for c in ("doc", "sum"))
                ids, known = grams.words.ids(), set(range(1, longest + 1))
                codes = np.array([tally.langs.setdefault(x, len(tally.langs)) for x in grams.langs], dtype=np.int64)
                first = np.asarray(grams.words.first)
                none = np.zeros(len(codes), dtype=np.int64)
                tally.add(codes, none, none, none, np.diff(first), none, none, none)
                for n, at, prints in grams.passing(tuple(sorted(known)), opened.value, known):
                    order, begin, group, same = grams.grouped(n, at, prints, ids, codes)
                    at, prints = at[order], prints[order]
                    times = np.bincount(group[same], minlength=len(begin))
                    rows = np.concatenate([begin, np.flatnonzero(~same)])
                    places, prints = at[rows], prints[rows]
                    check = _sums(mix64(grams.words.hashes, 12), WORD_BASE[1], places, places + n)
                    odd = slice(len(begin), None)
                    check[odd] += (check[odd] == check[: len(begin)][group[rows[odd]]]).astype(np.uint64)
                    times = np.concatenate([times, np.ones(len(rows) - len(begin), dtype=times.dtype)])
                    row = grams.rows[places]
                    tally.add(codes[row], np.full(len(row), n), prints.view(np.int64), check.view(np.int64), times, docs[row], sums[row], places - first[row])
                if tally.full():
                    yield from tally.rows()
        yield from tally.rows()

    return run


def _joined_words(words: Words, places: np.ndarray, n: np.ndarray) -> pa.Array:
    """The phrases of ``n`` words from ``places`` on. It unfolds the batch's words, so a batch calls it once, not once a row."""
    raw, starts, ends = words.data.tobytes(), words.starts.tolist(), words.ends.tolist()
    places, n = places.tolist(), n.tolist()
    return pa.array([b" ".join([raw[starts[i] : ends[i]] for i in range(p, p + k)]) for p, k in zip(places, n, strict=True)], pa.binary()).cast(pa.string())


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words at each listed place of a text."""
    for whole in batches:
        for batch in byte_slices(whole, "text"):
            words = Words(batch.column("text"), fold=True, blank=APART)
            places = batch.column("places")
            rows = np.repeat(np.arange(batch.num_rows), places.value_lengths().to_numpy())
            listed = places.flatten()
            n = listed.field("n")
            phrases = _joined_words(words, np.asarray(words.first)[rows] + listed.field("place").to_numpy(), n.to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(rows)), n, listed.field("a"), phrases], names=["lang", "n", "a", "phrase"])


def _recounted(longest: int, opened, shared, bits: int):
    """(lang, n, phrase, a): occurrences of the n-grams whose fingerprints are listed in ``shared``, by their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = np.frombuffer(shared.value, dtype=np.uint8)
        for whole in batches:
            for batch in byte_slices(whole, "text", BATCH):
                grams, known = Grams(batch, bits), set(range(1, longest + 1))
                for n, at, prints in grams.passing(tuple(sorted(known)), opened.value, known):
                    slots = (mix64(prints, n) & np.uint64(8 * len(listed) - 1)).astype(np.int64)
                    at = at[(listed[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0]
                    phrases = _joined_words(grams.words, at, np.full(len(at), n))
                    found = Counter(zip([grams.langs[r] for r in grams.rows[at].tolist()], phrases.to_pylist(), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([n] * len(found), pa.int64()), pa.array(list(found.values()), pa.int64()), pa.array([k[1] for k in found], pa.string())], names=["lang", "n", "a", "phrase"])

    return run


def _marked(keys: DataFrame, bits: int = 1 << 24) -> bytes:
    """A table of ``bits`` bits with those of the keys' 64-bit column ``h`` set, whatever their number."""
    rows = keys.select(F.pmod("h", F.lit(bits)).cast("int").alias("bit")).groupBy(F.floor(F.col("bit") / 4096).alias("block")).agg(F.collect_set(F.col("bit") % 4096).alias("set"))
    table = np.zeros(bits, dtype=bool)
    for r in rows.toLocalIterator():
        table[r.block * 4096 + np.array(r["set"])] = True
    return np.packbits(table, bitorder="little").tobytes()


def _holding(marks) -> object:
    """Only the texts whose hash is marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(marks.value, dtype=np.uint8)
        for batch in batches:
            slots = batch.column("sum").to_numpy().view(np.uint64) & np.uint64(8 * len(table) - 1)
            slots = slots.astype(np.int64)
            yield batch.filter(pa.array((table[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0))

    return run


def phrase_counts(docs: DataFrame, longest: int = 5, min_count: int = 100, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", slots: int = 1 << 24, bits: int = 64) -> DataFrame:
    """(lang, n, phrase, a): every phrase of 1 to ``longest`` words that occurs ``min_count`` times in a language, with its exact count; n = 0 has the number of all words.

    First all n-grams of all texts are counted by slot (fingerprint modulo ``slots``), one and two words long, then those longer
    ones whose parts are in open slots. A slot below ``min_count`` cannot hold a frequent n-gram, whatever shares it, so
    closed slots lose nothing; they only keep most rare n-grams out of the shuffle. The table is ``slots`` / 8 bytes
    (2 MB) at any size of the input.

    A task sends its slots and each frequent phrase it meets once, so the number of tasks follows the cores and not the input: else
    both would be sent as often as there are parts to read, and the frequent phrases themselves grow with the input.

    Then the fingerprints left are counted in one shuffle, each with one pointer (text, word number). Occurrences are held against the
    words at their batch's pointer, batches against each other by a second, independent 64-bit polynomial. Fingerprints found with different words
    are counted again by their words, in a pass that runs only if there are any. The pointers of the frequent ones are
    joined to their texts, and only those phrases are read. Tables of marks (2 MB) keep the other texts out of that join.
    """
    if min_count < 1 or longest < 1 or slots & (slots - 1) or slots < 8:
        raise ValueError("min_count and longest must be positive, slots a power of two from 8 on")
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(text, F.lit("")).alias("text")).coalesce(2 * spark.sparkContext.defaultParallelism)
    slim, most = rows.select("lang", "text"), min(min_count, 255)
    table = np.zeros(slots // 8, dtype=np.uint8)
    known: set[int] = set()
    for lengths in (tuple(range(1, min(longest, 2) + 1)), tuple(range(3, longest + 1))):
        if lengths:
            opened = spark.sparkContext.broadcast(table) if known else None
            # one table for all lengths: an n-gram's slot is open if its own length or another one filled it
            table = table | _open_slots(slim, lengths, slots, most, opened, known, bits)
            known |= set(lengths)
    opened = spark.sparkContext.broadcast(table)
    placed = rows.select("lang", "doc", F.xxhash64("text").alias("sum"), "text")
    schema = "lang string, n long, print long, check long, times long, doc long, sum long, place long"
    found = placed.mapInArrow(_occurrences(longest, opened, bits), schema)
    # pointers to small ids first, so that few texts hold them; the three columns follow one comparison and so stay together
    pointer = [F.min_by(c, "doc").alias(c) for c in ("doc", "sum", "place")]
    totals = found.groupBy(*KEY).agg(F.sum("times").alias("a"), (F.min("check") != F.max("check")).alias("shared"), *pointer)
    often = stored(totals.where((F.col("a") >= min_count) | (F.col("n") == 0)), "prints")
    sizes = often.where("n = 0").select("lang", "n", "a", F.lit("").alias("phrase"))
    single, shared = often.where("n > 0 AND NOT shared"), often.where("n > 0 AND shared")
    marks = spark.sparkContext.broadcast(_marked(single.select(F.col("sum").alias("h"))))
    listed = single.groupBy(*PLACE).agg(F.collect_list(F.struct("n", "place", "a")).alias("places"))
    # texts of one id, language and hash are one text
    texts = placed.mapInArrow(_holding(marks), placed.schema).join(listed, PLACE)
    phrases = texts.mapInArrow(_read_back, PHRASES).dropDuplicates(["lang", "n", "phrase"])
    if not shared.isEmpty():
        mixed = shared.select("n", "print").distinct().mapInArrow(_print_slots, "h long")
        counted = slim.mapInArrow(_recounted(longest, opened, spark.sparkContext.broadcast(_marked(mixed)), bits), PHRASES)
        counted = counted.groupBy("lang", "n", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= min_count).select("lang", "n", "a", "phrase")
        # the marks may let in others, whose full counts are then equal in both
        phrases = phrases.unionByName(counted).distinct()
    return stored(phrases.unionByName(sizes), "phrases").select("lang", "n", "phrase", "a")


def _print_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, prints = (batch.column(c).to_numpy() for c in ("n", "print"))
        out = prints.view(np.uint64).copy()
        for k in np.unique(n):
            out[n == k] = mix64(out[n == k], int(k))
        yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], names=["h"])


def collocations(docs: DataFrame, longest: int = 5, min_count: int = 100, absorb: int = 100, top: int = 2000, **columns) -> DataFrame:
    """The ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and cut into pieces at ``[.,;:!?]`` and line breaks, pieces into words at space and tab. Within a language
    (null: ``und``) n is the number of all words, f(phrase) that of its occurrences inside pieces. A candidate has 2 to ``longest``
    words and a = f >= ``min_count``. Of its cuts into l = f(first part) and r = f(rest) the one with the lowest
    floor(1000 a n / (l r)) counts, of equal ones the first. A candidate inside a longer one that occurs at least ``absorb`` % as
    often is left out. Order: score and a descending, phrase ascending by bytes. Null and blank texts add no words; repeated rows
    count each time; other columns are not read. No row where nothing is frequent.

    All parts of a candidate are frequent too, so both joins only meet frequent phrases. Products are decimals of 38 digits.
    """
    counts = phrase_counts(docs, longest, min_count, **columns)
    phrases = counts.where("n > 0").select("lang", F.col("n").alias("size"), "phrase", "a")
    words = counts.where("n = 0").select("lang", F.col("a").alias("n"))
    split = phrases.where("size > 1").withColumn("words", F.split("phrase", " "))
    part = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    cuts = split.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", part(F.lit(1), F.col("k").cast("int")).alias("head"), part((F.col("k") + 1).cast("int"), (F.col("size") - F.col("k")).cast("int")).alias("tail"))
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["lang", "head"])
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r")), ["lang", "tail"]).join(words, "lang")
    score = F.expr("(CAST(a AS DECIMAL(38,0)) * n * 1000) DIV (CAST(l AS DECIMAL(38,0)) * r)")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size").cast("int") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size").cast("int") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))
    inside = split.where("size > 2").select("lang", F.col("a").alias("longer"), F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < absorb * F.col("a")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    ranked = kept.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
