"""Language ID: a bidirectional gated recurrent network over the bytes of each word, trained in numpy."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import byte_slices, discard, stored, trimmed

# A word of more bytes is cut: the network never runs over more than this many steps.
MOST_BYTES = 32
LETTER = re.compile(r"[^\W\d_]")
BLANKS = re.compile(r"[^\x20\x09-\x0D]+")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def pack_words(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes by step (longest words first, 0 after the end) and the words' lengths."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    steps = np.zeros((int(lengths.max()), len(words)), dtype=np.uint8)
    flat = np.frombuffer(b"".join(words), dtype=np.uint8)
    rows = np.repeat(np.arange(len(words)), lengths)
    steps[np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths), rows] = flat
    return steps, lengths


@dataclass
class ByteGru:
    """Weights: per direction the byte table ``x`` (256, 3H: update, reset, candidate) and ``u`` (H, 3H); one output layer."""

    languages: list[str]
    hidden: int = 12
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, seed: int) -> None:
        rng, h = np.random.default_rng(seed), self.hidden
        for d in ("f", "b"):
            self.weights[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            self.weights[f"u{d}"] = (rng.normal(0, 1, (h, 3 * h)) / np.sqrt(h)).astype(np.float32)
        self.weights["o"] = rng.normal(0, 0.3, (2 * h, len(self.languages))).astype(np.float32)
        self.weights["c"] = np.zeros(len(self.languages), dtype=np.float32)

    def _run(self, steps: np.ndarray, lengths: np.ndarray, d: str, trace: list | None = None) -> np.ndarray:
        """States after each step, (steps, words, H). Backwards, a word starts at its own last byte. Words must be sorted, longest first."""
        h, x, u = self.hidden, self.weights[f"x{d}"], self.weights[f"u{d}"]
        n_steps, n = steps.shape
        out = np.zeros((n_steps, n, h), dtype=np.float32)
        state = np.zeros((n, h), dtype=np.float32)
        live = np.searchsorted(-lengths, -np.arange(n_steps), side="left")
        for t in range(n_steps) if d == "f" else range(n_steps - 1, -1, -1):
            m = live[t]
            s = state[:m]
            a = x[steps[t, :m]]
            g = _sigmoid(a[:, : 2 * h] + s @ u[:, : 2 * h])
            z, r = g[:, :h], g[:, h:]
            k = np.tanh(a[:, 2 * h :] + (r * s) @ u[:, 2 * h :])
            new = s + z * (k - s)
            if trace is not None:
                trace.append((t, m, s.copy(), z, r, k))
            state[:m] = new
            out[t, :m] = new
        return out

    def positions(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities of each language at each byte position summed per word, number of positions)."""
        order = np.argsort([-len(w) for w in words], kind="stable")
        steps, lengths = pack_words([words[i] for i in order])
        both = np.concatenate([self._run(steps, lengths, "f"), self._run(steps, lengths, "b")], axis=2)
        inside = np.arange(len(steps))[:, None] < lengths[None, :]
        logits = both[inside] @ self.weights["o"] + self.weights["c"]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        owner = np.broadcast_to(np.arange(len(words)), inside.shape)[inside]
        sums = np.stack([np.bincount(owner, weights=p[:, k], minlength=len(words)) for k in range(p.shape[1])], axis=1)
        result = np.empty_like(sums)
        result[order] = sums
        return result, np.array([len(w) for w in words])

    def train(self, words: list[bytes], labels: np.ndarray, copies: np.ndarray, steps: int, seed: int, rate: float = 0.02) -> None:
        """Backpropagation through time with Adam; each byte position of a word carries the word's label.

        The draws (``copies`` of each word) are shuffled and dealt into ``steps`` batches, so each is seen exactly once.
        """
        self.start(seed)
        rng = np.random.default_rng(seed + 1)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        draws = rng.permutation(np.repeat(np.arange(len(words)), copies))
        for step, pick in enumerate(np.array_split(draws, min(steps, len(draws))), 1):
            pick = pick[np.argsort([-len(words[i]) for i in pick], kind="stable")]
            grads = self._gradients([words[i] for i in pick], labels[pick])
            now = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                np.clip(g, -1, 1, out=g)
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                self.weights[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)

    def _gradients(self, words: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        h = self.hidden
        steps, lengths = pack_words(words)
        traces: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(steps, lengths, d, traces[d]) for d in ("f", "b")], axis=2)
        inside = np.arange(len(steps))[:, None] < lengths[None, :]
        logits = both @ self.weights["o"] + self.weights["c"]
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(len(words)), labels] -= 1
        p *= (inside / inside.sum())[:, :, None]
        out: dict[str, np.ndarray] = {"o": np.einsum("tnh,tnl->hl", both, p), "c": p.sum(axis=(0, 1))}
        above = p @ self.weights["o"].T
        for d, part in (("f", above[:, :, :h]), ("b", above[:, :, h:])):
            u = self.weights[f"u{d}"]
            dx, du = np.zeros_like(self.weights[f"x{d}"]), np.zeros_like(u)
            down = np.zeros((len(words), h), dtype=np.float32)
            for t, m, s, z, r, k in reversed(traces[d]):
                ds = down[:m] + part[t, :m]
                dk = ds * z * (1 - k * k)
                rs = dk @ u[:, 2 * h :].T
                dz = ds * (k - s) * z * (1 - z)
                dr = rs * s * r * (1 - r)
                dg = np.concatenate([dz, dr], axis=1)
                du[:, : 2 * h] += s.T @ dg
                du[:, 2 * h :] += (r * s).T @ dk
                np.add.at(dx, steps[t, :m], np.concatenate([dg, dk], axis=1))
                down[:m] = ds * (1 - z) + rs * r + dg @ u[:, : 2 * h].T
            out[f"x{d}"], out[f"u{d}"] = dx, du
        return {k: v.astype(np.float32) for k, v in out.items()}


def word_pieces(word: str) -> list[bytes]:
    raw = word.encode("utf-8", "surrogatepass")
    return [raw[i : i + MOST_BYTES] for i in range(0, len(raw), MOST_BYTES)]


def lettered(word: str) -> bool:
    return LETTER.search(word) is not None


def is_held_out(doc_id: Column | str) -> Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, per_language: int, seed: int) -> DataFrame:
    """(lang, text) of at most ``per_language`` labelled documents of each language outside the held-out fold.

    The sample is the lowest seeded hashes, taken in 16 parts of each language, so that no task ranks a language alone.
    """
    fit = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out("doc_id"))
    place = fit.select("doc_id", "lang", F.xxhash64("doc_id", F.lit(seed)).alias("h"))
    ranked = place.withColumn("r", F.row_number().over(Window.partitionBy("lang", F.pmod("h", F.lit(16))).orderBy("h", "doc_id")))
    chosen = stored(ranked.where(F.col("r") <= -(-per_language // 16)).select(F.col("doc_id").alias("__id"), F.col("lang").alias("__lang")), "language-sample")
    return docs.join(F.broadcast(chosen), (F.col("doc_id") == F.col("__id")) & (F.col("lang") == F.col("__lang")), "left_semi").select("lang", "text")


def counted_pieces(sample: DataFrame) -> DataFrame:
    """(lang, piece, n): how often each label's texts have each word with a letter; a longer word counts by its pieces."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                found.update((lang, piece) for w in BLANKS.findall(text) if lettered(w) for piece in word_pieces(w))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.binary()), pa.array(list(found.values()), pa.int64())], names=["lang", "piece", "n"])

    return sample.mapInArrow(trimmed(count), "lang string, piece binary, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def training_draws(counts: DataFrame, draws: int, seed: int) -> DataFrame:
    """(lang, piece, copies): about ``draws`` training examples, the same number for every label that has a word.

    Within a label a piece is expected ``draws`` / labels times its share of the square roots of the counts, so that rare words
    are seen too. A seeded hash rounds that up or down: every piece has its chance, however many there are.
    """
    # whole numbers: their sum does not depend on its order
    weighed = counts.withColumn("w", F.round(F.sqrt("n") * 65536).cast("long"))
    totals = weighed.groupBy("lang").agg(F.sum("w").alias("total")).collect()
    shares = counts.sparkSession.createDataFrame([(r.lang, draws / len(totals) / r.total) for r in totals], "lang string, share double")
    chance = F.pmod(F.xxhash64("lang", "piece", F.lit(seed)), F.lit(1 << 32)) / float(1 << 32)
    rounded = weighed.join(F.broadcast(shares), "lang").withColumn("copies", F.floor(F.col("w") * F.col("share") + chance).cast("long"))
    return rounded.where("copies > 0").select("lang", "piece", "copies")


def fit_languages(docs: DataFrame, per_language: int = 320, most_languages: int = 200, steps: int = 400, batch: int = 256, seed: int = 5) -> ByteGru | None:
    """Train on a bounded sample of labelled rows: ``per_language`` documents of each of the ``most_languages`` commonest labels.

    All words of the sample take part; the ``steps * batch`` examples of the training are drawn from them where they are
    counted, and only those reach the driver. None if no row is labelled.
    """
    common = [r.lang for r in docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out("doc_id")).groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()]
    if not common:
        return None
    counts = stored(counted_pieces(training_sample(docs.where(F.col("lang").isin(common)), per_language, seed)), "language-pieces")
    rows = training_draws(counts, steps * batch, seed).toArrow()
    discard(counts)
    drawn = sorted(zip(*(c.to_pylist() for c in rows.columns), strict=True))
    if not drawn:
        return None
    model = ByteGru(sorted(common))
    places = {lang: i for i, lang in enumerate(model.languages)}
    words = [piece for _, piece, _ in drawn]
    model.train(words, np.array([places[lang] for lang, _, _ in drawn]), np.array([n for _, _, n in drawn]), steps, seed)
    return model


class Pooling:
    """Documents' language probabilities; words met before in this task are not run again.

    Beyond ``most_kept`` words only those stay that were met again after they were learned; any other is run anew when it comes back.
    So a task's memory is bounded and common words are run once.
    """

    def __init__(self, model: ByteGru, most_kept: int = 150_000):
        self.model, self.most_kept = model, most_kept
        self.known: dict[str, int] = {}
        self.again: set[str] = set()
        self.table = np.zeros((0, len(model.languages) + 1))

    def _forget(self) -> None:
        kept = [w for w in self.known if w in self.again]
        kept = kept if len(kept) <= self.most_kept // 2 else []
        self.table = self.table[[self.known[w] for w in kept]]
        self.known, self.again = {w: i for i, w in enumerate(kept)}, set()

    def _learn(self, words: list[str]) -> None:
        good = [w for w in words if lettered(w)]
        rows = np.zeros((len(words), self.table.shape[1]))
        place = {w: i for i, w in enumerate(words)}
        pieces, owner = [], []
        for w in good:
            for piece in word_pieces(w):
                pieces.append(piece)
                owner.append(place[w])
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        for begin in range(0, len(order), 4096):
            part = order[begin : begin + 4096]
            sums, n = self.model.positions([pieces[i] for i in part])
            np.add.at(rows, [owner[i] for i in part], np.column_stack([sums, n]))
        for w in words:
            self.known[w] = len(self.known)
        self.table = np.concatenate([self.table, rows])

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        found = [BLANKS.findall(t) if t else [] for t in texts]
        if len(self.known) > self.most_kept:
            self._forget()
        met = {w for ws in found for w in ws}
        new = met - self.known.keys()
        self.again |= met - new
        if new:
            self._learn(sorted(new))
        languages, scores = [], []
        for ws in found:
            total = self.table[np.fromiter(map(self.known.__getitem__, ws), dtype=np.int64, count=len(ws))].sum(axis=0) if ws else None
            if total is None or not total[-1]:
                languages.append("und")
                scores.append(0.0)
                continue
            p = total[:-1] / total[-1]
            best = int(p.argmax())
            languages.append(self.model.languages[best])
            scores.append(float(min(1.0, p[best])))
        return languages, scores


def identify_languages(docs: DataFrame, mark: str | None = None, **fit) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score`` (0 to 1) for every row.

    The network reads the bytes of each word in both directions, its state starting anew at each blank (and after 32 bytes
    of a longer word), and labels every byte position; a document's probabilities are the mean over all positions
    of its words with a letter, the whole text counting. ``und`` with score 0: null text, no letter, or nothing to learn from. Text alone is
    the input of a prediction. A language label that only occurs in the held-out fold is never predicted. A null id is
    outside that fold. Repeated rows get equal results; columns named like a result are replaced.
    ``mark`` names one more column: whether the text has a letter, which ``und`` does not tell where nothing could be learned.

    The model (some 30 KB) is fitted on a bounded sample, see ``fit_languages``, and travels with the task; there is no shuffle of texts.
    """
    names = ("held_out", "lang_pred", "score")
    docs = docs.drop(*names, *([mark] if mark else []))
    model = fit_languages(docs.select("doc_id", "lang", "text"), **fit)
    schema = docs.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    schema = (schema.withColumn(mark, F.lit(False)) if mark else schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooling = Pooling(model) if model else None
        for whole in batches:
            # a text's words take some ten times its bytes
            for batch in byte_slices(whole, "text", 1 << 20):
                texts = batch.column("text").to_pylist()
                languages, scores = pooling.judge(texts) if pooling else (["und"] * len(texts), [0.0] * len(texts))
                columns = [*batch.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())]
                if mark:
                    columns.append(pa.array([t is not None and lettered(t) for t in texts], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "lang_pred", "score", *([mark] if mark else [])])

    return docs.mapInArrow(trimmed(run), schema).withColumn("held_out", is_held_out("doc_id"))
