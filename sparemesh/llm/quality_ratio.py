"""Quality rules: text statistics and the log-likelihood ratio of hashed n-grams, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
# Characters the symbol count looks for (fixed values).
SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column | str) -> Column:
    """The words of a text (runs of anything but ASCII blanks); null: none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN, -1))


def pairs_hashed(left: Column, right: Column) -> Column:
    """Hash of each two neighbours: ``left[i]`` with ``right[i + 1]``."""
    n = F.greatest(F.size(right) - 1, F.lit(0))
    return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(2), n), lambda a, b: F.xxhash64(a, b))


def covered_words(windows: Column, width: int) -> Column:
    """How many words lie in a window that occurs twice or more; ``windows``: the hash of the window at each word."""

    def count(marked: Column) -> Column:
        # places of all windows in hash order; equal neighbours repeat
        n = F.size(marked)
        twins = F.zip_with(F.slice(marked, F.lit(1), n - 1), F.slice(marked, F.lit(2), n - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        starts = F.flatten(F.filter(twins, lambda t: t.isNotNull()))
        places = F.flatten(F.transform(starts, lambda i: F.array(*[i + k for k in range(width)])))
        return F.size(F.array_distinct(places)).cast("long")

    def sorted_places(w: Column) -> Column:
        return F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(sorted_places(w), count)))


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long), over the whole text; null: zeros.

    Words are runs of anything but ASCII blanks; a duplicate line holds a word and equals an earlier line of the
    text; repeated words lie in a window of three words found twice or more. Input columns of these names are replaced.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    keep = [F.col(c) for c in docs.columns if c not in names]
    full = F.coalesce(F.col(text), F.lit(""))
    hashed = docs.select(*keep, F.transform(words_of(text), lambda w: F.xxhash64(w)).alias("__w"))
    lines = F.filter(F.split(full, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return hashed.select(
        *keep,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.translate(full, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(full) - F.length(F.translate(full, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        covered_words(three_words(F.col("__w")), 3).alias("n_repeat_words"),
    )


def three_words(w: Column) -> Column:
    n = F.greatest(F.size(w) - 2, F.lit(0))
    return F.zip_with(F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.xxhash64(a, b)), F.slice(w, F.lit(3), n), lambda a, b: F.xxhash64(a, b))


def grams(words: Column) -> Column:
    """Hashes of all words and pairs of neighbours."""
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda w: F.concat(w, pairs_hashed(w, w)))


def gram_weights(docs: DataFrame, trusted: DataFrame, buckets: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(bucket, weight): log of the bucket's share in the trusted texts over its share in all texts, both smoothed by one.

    All documents are counted; ``trusted`` is a bounded table of ids and so can be broadcast.
    """
    marked = docs.join(F.broadcast(trusted.select(F.col(doc_id).alias("__trusted")).distinct()), F.col(doc_id) == F.col("__trusted"), "left")
    exploded = marked.select(F.col("__trusted").isNotNull().cast("long").alias("t"), F.explode(grams(words_of(text))).alias("h"))
    counts = exploded.groupBy(F.pmod("h", F.lit(buckets)).cast("int").alias("bucket")).agg(F.count("*").alias("raw"), F.sum("t").alias("trusted"))
    return stored(counts, "gram-counts")


def quality_filter(
    docs: DataFrame,
    labels: DataFrame,
    buckets: int = 1 << 16,
    max_trusted: int = 20_000,
    spread: float = 4.0,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    seed: int = 11,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """``docs`` with the text statistics, ``base_failed``, ``score`` and ``kept``.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat_percent`` percent of them in repeated windows.
    ``score``: sum over the words and word pairs of log(trusted share / raw share) of their hash bucket, divided by
    their number. The trusted target is fitted on the documents labelled ``quality = 1``, at most ``max_trusted`` of them,
    taken by a seeded hash of the id, of which one half is fitted; the raw corpus is every document. ``kept``: not base_failed, and the
    score is at least the mean of the other half, which the fit has not seen, less ``spread`` standard deviations (both rounded to
    9 digits); without trusted documents every score is 0 and passes. Null text: no words, so base_failed. A repeated row is
    judged each time. Other columns pass through; those named like a result are replaced.

    One pass counts, one scores; only (bucket, count) rows are shuffled. The weights, ``buckets`` numbers whatever the data, travel with the plan.
    """
    names = ("base_failed", "score", "kept")
    docs = docs.drop(*names)
    trusted = labels.where("quality = 1").select(doc_id).distinct().orderBy(F.xxhash64(doc_id, F.lit(seed)), doc_id).limit(max_trusted)
    trusted = stored(trusted, "trusted")
    # one half fits the target, the other, unseen by it, sets the threshold
    half = F.pmod(F.xxhash64(doc_id, F.lit(seed + 1)), F.lit(2))
    fitted, unseen = trusted.where(half == 0), trusted.where(half == 1)
    if unseen.isEmpty() or fitted.isEmpty():
        fitted = unseen = trusted
    counts = gram_weights(docs, fitted, buckets, text, doc_id)
    sums = counts.agg(F.coalesce(F.sum("trusted"), F.lit(0)), F.coalesce(F.sum("raw"), F.lit(0))).first()
    share = lambda c, total: (F.col(c) + 1) / F.lit(float(total + buckets))
    by_bucket = {r.bucket: r.w for r in counts.select("bucket", F.round(F.log(share("trusted", sums[0])) - F.log(share("raw", sums[1])), 9).alias("w")).collect()} if sums[0] else {}
    table = F.split(F.lit(",".join(repr(by_bucket.get(b, 0.0)) for b in range(buckets))), ",").cast("array<double>")
    found = grams(words_of(text))
    score = let(found, lambda g: F.when(F.size(g) == 0, F.lit(0.0)).otherwise(F.aggregate(g, F.lit(0.0), lambda s, h: s + F.get(table, F.pmod(h, F.lit(buckets)).cast("int"))) / F.size(g)))
    sample = docs.join(F.broadcast(unseen.select(F.col(doc_id).alias("__trusted"))), F.col(doc_id) == F.col("__trusted"), "left_semi")
    middle = sample.select(score.alias("s")).where(F.lit(bool(by_bucket))).agg(F.round(F.avg("s"), 9), F.round(F.coalesce(F.stddev_pop("s"), F.lit(0.0)), 9)).first()
    least = -1.0 if middle[0] is None else middle[0] - spread * middle[1]
    rows = text_statistics(docs.withColumn("score", F.round(score, 9)), text)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(least)))
