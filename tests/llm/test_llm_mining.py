"""Toxicity, periodic runs and collocations against plain recomputation, edge rows included."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparemesh.llm import collocations as mining
from sparemesh.llm.collocations import collocations, phrase_counts
from sparemesh.llm.common import Words
from sparemesh.llm.operator_queries import looped, op12_periodic_runs
from sparemesh.llm.periodic_runs import SuffixArrays, collapse_runs, find_runs
from sparemesh.llm.toxicity import features, fit_toxicity, risk, score_toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- periodic runs ----------------------------------------------------------------------------------------


def plain_runs(words, least, times):
    out, n = set(), len(words)
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, times * p) and not any(all(words[x] == words[x + q] for x in range(i, j + p - q)) for q in range(1, p)):
                out.add((i, j + p - i, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_many_sequences():
    rng = random.Random(3)
    for _ in range(800):
        rows = []
        for _ in range(rng.randrange(1, 4)):
            w = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.choice([0, 1, 2, 5, 12, 30, 60]))]
            if rng.random() < 0.5 and w:
                w += w[: rng.randrange(1, 4)] * rng.randrange(1, 9)
            rows.append(w)
        least, times = rng.choice([(1, 2), (4, 2), (6, 3), (24, 3), (5, 3)])
        first = np.cumsum([0, *map(len, rows)])
        found = find_runs(np.array([x for w in rows for x in w], dtype=np.int64), first, least, times)
        assert list(zip(*(x.tolist() for x in found), strict=True)) == [(r, *x) for r, w in enumerate(rows) for x in plain_runs(w, least, times)]


def test_suffix_arrays_are_sorted():
    rng = np.random.default_rng(2)
    first = np.array([0, 40, 40, 41, 90])
    symbols = rng.integers(0, 2, 90)
    arrays = SuffixArrays(symbols, first, 100)
    for r in range(4):
        own = arrays.sa[first[r] : first[r + 1]]
        assert own.tolist() == sorted(range(first[r], first[r + 1]), key=lambda i: symbols[i : first[r + 1]].tolist())
    for a, b in rng.integers(0, 40, (50, 2)).tolist():
        if a != b:
            n = next(k for k in range(41) if max(a, b) + k == 40 or symbols[a + k] != symbols[b + k])
            assert arrays.common(np.array([a]), np.array([b]))[0] == n
            a, b = min(a, b), max(a, b)
            n = next(k for k in range(41) if a - k == 0 or symbols[a - k - 1] != symbols[b - k - 1])
            assert arrays.common_before(np.array([a]), np.array([b]))[0] == n


def test_collapse_runs(spark):
    rng = random.Random(8)
    loop = lambda n, k: " ".join(["w%d é" % (i % n) for i in range(k)])
    texts = [None, "", " \t\n", "one", "a " * 23, "a " * 24, "a\t" * 25 + "b", loop(4, 40) + " end", "x y z " * 7 + "x y", "start " + loop(3, 9) + " mid " + loop(3, 9), "日本 " * 50_000, "q" * 200_000]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(200))) for _ in range(40)]
    texts += [" ".join(f"w{rng.randrange(9000)}" for _ in range(60_000)) + " r s t" * 9]
    rows = [(i if i % 5 else None, t, "n", 1, 2) for i, t in enumerate(texts)] + [(3, texts[7], "n", 1, 2)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, runs int, start int").repartition(3)
    found = collapse_runs(docs)
    assert found.columns == ["doc_id", "text", "start", "n_words", "runs"]
    expected = Counter()
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        runs = plain_runs(w, 24, 3) if len(w) < 5000 else [(0, len(w), 1)] if w[0] == w[1] else [(len(w) - 27, 27, 3)]
        expected[i, collapsed(w, runs), len(w), tuple(runs)] += 1
    assert Counter((r.doc_id, r.text, r.n_words, tuple(map(tuple, r.runs))) for r in found.collect()) == expected
    assert collapse_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        collapse_runs(docs, min_exponent=1)


def test_runs_query_on_looped_texts(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 6000").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(None, "a " * 30), (9_000_001, None), (9_000_002, "")], "doc_id long, text string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in op12_periodic_runs(spark, str(tmp_path)).collect()}
    sha, seen = lambda x: hashlib.sha256(x.encode()).hexdigest(), 0
    for i, t in docs.collect():
        w, h = WORD.findall(t or ""), zlib.crc32(str(i).encode())
        g, n = h // 10, len(w)
        if i is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        runs = plain_runs(w, 24, 3)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        r = found[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(best or (None,) * 3))
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)) and r.collapsed_sha256 == sha(collapsed(w, runs))
        seen += len(runs)
    assert seen > 5
    assert looped(docs.limit(0)).collect() == []


# ---- collocations -----------------------------------------------------------------------------------------


def plain_collocations(rows, longest, least, absorb, top):
    f, total = Counter(), Counter()
    for _, lang, text in rows:
        lang = lang or "und"
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            f.update((lang, *w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1))
    found = []
    for (lang, *w), a in f.items():
        if a >= least and len(w) > 1:
            cuts = [(1000 * a * total[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found.append((lang, tuple(w), a, f[lang, *w[:k]], f[lang, *w[k:]], total[lang], score))
    inner = {(x[0], x[1][i:j]): 0 for x in found for i in range(len(x[1])) for j in range(i + 2, len(x[1]) + 1) if j - i < len(x[1])}
    for x in found:
        for i in range(len(x[1])):
            for j in range(i + 2, len(x[1]) + 1):
                if j - i < len(x[1]):
                    inner[x[0], x[1][i:j]] = max(inner[x[0], x[1][i:j]], x[2])
    kept = [x for x in found if 100 * inner.get(x[:2], -1) < absorb * x[2]]
    out = []
    for lang in {x[0] for x in kept}:
        own = sorted((x for x in kept if x[0] == lang), key=lambda x: (-x[6], -x[2], " ".join(x[1]).encode()))[:top]
        out += [(lang, k, " ".join(x[1]), *x[2:]) for k, x in enumerate(own, 1)]
    return sorted(out)


def phrase_rows():
    rng = random.Random(5)
    words = ["the", "The", "of", "é", "straße", "x", "y", "zz", "日本", "q#", "a\xa0b", "\x1c"]
    rows = [(i % 180 if i % 7 else None, rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" "] * 12 + [". ", ",", "\n", "\t ", "  ", " ; ", "\x0b"]) for _ in range(rng.randrange(60)))) for i in range(200)]
    return rows + rows[:20] + [(1, "en", None), (2, None, ""), (3, "de", " ,.; \n"), (4, "en", "the of " * 3000)]


@pytest.mark.parametrize("weak", [{}, {"bits": 9}, {"slots": 64, "bits": 14}])
def test_collocations(spark, weak):
    """Also with fingerprints so short that most phrases share theirs, and with a filter that lets all pass."""
    rows = phrase_rows()
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, lang string, text string, n int, phrase string").repartition(4)
    for least, absorb, top in ((4, 100, 2000), (20, 80, 7)):
        assert sorted(tuple(r) for r in collocations(docs, 5, least, absorb, top, **weak).collect()) == plain_collocations(rows, 5, least, absorb, top)


def test_collocations_of_rare_words_and_empty(spark):
    docs = spark.createDataFrame([(1, "en", "a b c")], "doc_id long, lang string, text string")
    assert collocations(docs).collect() == [] and collocations(docs.limit(0)).collect() == []
    assert sorted(tuple(r) for r in phrase_counts(docs, 1, 1).collect()) == [("en", 0, "", 3), ("en", 1, "a", 1), ("en", 1, "b", 1), ("en", 1, "c", 1)]
    with pytest.raises(ValueError):
        collocations(docs, min_count=0)


def test_tasks_follow_the_cores(spark, monkeypatch):
    """A task sends each frequent phrase once, so parts of the input must not each be a task of their own."""
    tasks, made = spark.sparkContext.accumulator(0), mining._occurrences

    def counted(*args):
        run = made(*args)

        def count(batches):
            tasks.add(1)
            yield from run(batches)

        return count

    monkeypatch.setattr(mining, "_occurrences", counted)
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("one two").alias("text")).repartition(60)
    found = {tuple(r) for r in phrase_counts(docs).collect()}
    assert found == {("en", 0, "", 1200), ("en", 1, "one", 600), ("en", 1, "two", 600), ("en", 2, "one two", 600)}
    assert 0 < tasks.value <= 2 * spark.sparkContext.defaultParallelism


def test_a_tally_is_full_of_different_rows_only():
    column = lambda x: np.array(x, dtype=np.int64)
    tally, none = mining.Tally(10), column([0] * 4)
    tally.langs["en"] = 0
    for _ in range(9):
        tally.add(none, none + 1, column([5, 6, 7, 8]), none, none + 2, none, none, none)
        assert not tally.full()
    (rows,) = tally.rows()
    assert rows.column("print").to_pylist() == [5, 6, 7, 8] and rows.column("times").to_pylist() == [18] * 4
    tally.add(*[column(range(11))] * 8)
    assert tally.full()


def test_phrases_are_read_back_batch_by_batch(monkeypatch):
    calls, joined = [], mining._joined_words
    monkeypatch.setattr(mining, "_joined_words", lambda *args: calls.append(1) or joined(*args))
    kind = pa.list_(pa.struct([("n", pa.int64()), ("place", pa.int64()), ("a", pa.int64())]))
    rows = [("de", "x y", []), ("en", "A b; c", [(1, 0, 7), (2, 0, 8), (1, 2, 9)]), ("fr", None, []), ("fr", "d e f", [(2, 1, 5)])]
    places = pa.array([[{"n": n, "place": p, "a": a} for n, p, a in r[2]] for r in rows], kind)
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.string()), places], names=["lang", "text", "places"])
    out = pa.Table.from_batches(mining._read_back(iter([batch.slice(1)]))).to_pylist()
    assert [tuple(r.values()) for r in out] == [("en", 1, 7, "a"), ("en", 2, 8, "a b"), ("en", 1, 9, "c"), ("fr", 2, 5, "e f")]
    assert len(calls) == 1


def test_word_numbers_hold_with_equal_hashes():
    words = Words(pa.array(["one two one", "three two  tw o", None]))
    words.hashes = words.hashes & np.uint64(1)
    raw = [words.data[s:e].tobytes() for s, e in zip(words.starts, words.ends, strict=True)]
    ids = words.ids()
    assert all((ids[i] == ids[j]) == (raw[i] == raw[j]) for i in range(len(raw)) for j in range(len(raw)))


# ---- toxicity ---------------------------------------------------------------------------------------------


def test_features_by_plain_counting():
    texts = ["Idiot, idiots! ÉTÉ été", None, "", "12 ab abc", "abcdefghij"]
    bounds, found, times, words = features(pa.array(texts))
    keys = {}
    for r, text in enumerate(texts):
        own = re.findall(r"[^\W\d_]+", (text or "").lower())
        plain = Counter()
        for w in own:
            raw = w.encode()
            plain[raw, "word"] += 1
            plain.update((raw[:k], "beginning") for k in range(3, 9) if len(raw) > k)
        assert words[r] == len(own) and sorted(times[bounds[r] : bounds[r + 1]]) == sorted(plain.values())
        keys[text] = set(found[bounds[r] : bounds[r + 1]].tolist())
    assert len(keys["Idiot, idiots! ÉTÉ été"] & set(features(pa.array(["idiot"]))[1].tolist())) == 3


@pytest.mark.parametrize("shift", [0.0, 6.0])
def test_risk_gradients(shift):
    """Gradients of the whole risk, and of the negative part alone once it is below zero."""
    rng = np.random.default_rng(1)
    p, u, prior = rng.normal(shift, 1, 5), rng.normal(-shift, 1, 7), 0.4
    up, down, gp, gu = risk(p, u, prior)
    assert (down < 0) == (shift > 0)
    value = (lambda a, b: sum(risk(a, b, prior)[:2])) if down >= 0 else (lambda a, b: -risk(a, b, prior)[1])
    for x, g, other in ((p, gp, 0), (u, gu, 1)):
        for i in range(len(x)):
            step = np.zeros(len(x))
            step[i] = 1e-5
            hi, lo = ((value(x + step, u), value(x - step, u)) if other == 0 else (value(p, x + step), value(p, x - step)))
            assert g[i] == pytest.approx((hi - lo) / 2e-5, abs=1e-6)


def toxic_rows(n=600):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["zzvile", "zzrude", "zznasty"]) + word())
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    return rows, labels


def test_toxic_documents_are_found(spark):
    rows, known = toxic_rows()
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(known, "doc_id long, toxic int")
    found = {r.doc_id: r for r in score_toxicity(docs, labels).collect()}
    right = [found[i].predicted == int(i % 5 == 0) for i in range(len(rows)) if found[i].held_out]
    assert len(right) > 100 and np.mean(right) > 0.95
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for i, r in found.items())
    # held-out labels and zeros change nothing but the share of toxic documents
    other = labels.where("toxic = 1").union(spark.createDataFrame([(i, 1 - y) for i, y in known if zlib.crc32(str(i).encode()) % 4 == 2], "doc_id long, toxic int"))
    fits = [fit_toxicity(docs.repartition(k), x, prior=0.2) for k, x in ((2, labels), (5, other))]
    assert fits[0].intercepts == fits[1].intercepts and all((a == b).all() for a, b in zip(fits[0].weights, fits[1].weights, strict=True))


def test_toxicity_edges(spark):
    rows, known = toxic_rows(120)
    odd = [(None, rows[0][1]), (9000, None), (9001, ""), (9002, "123 !!"), rows[0], rows[0], (9003, "zzvileab " * 40_000)]
    docs = spark.createDataFrame([(*r, 9, "x") for r in rows + odd], "doc_id long, text string, score int, predicted string")
    labels = spark.createDataFrame([*known, (None, 1), (9000, 1), (5, None), (0, 0), (77_777, 1)], "doc_id long, toxic int")
    found = score_toxicity(docs, labels).collect()
    assert len(found) == len(rows) + len(odd) and found[0].asDict().keys() == {"doc_id", "text", "score", "held_out", "predicted"}
    assert len({r.score for r in found if r.text in (None, "", "123 !!")}) == 1 and len({r.score for r in found if r.text == rows[0][1]}) == 1
    assert {r.held_out for r in found if r.doc_id is None} == {False}
    for none in (labels.where("toxic = 0"), labels.limit(0)):
        assert {(r.score, r.predicted) for r in score_toxicity(docs, none).collect()} == {(0.0, 0)}
    assert score_toxicity(docs.limit(0), labels).collect() == []


def test_toxicity_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = score_toxicity(docs.select("doc_id", "text"), labels.select("doc_id", "toxic")).join(labels, "doc_id").where("held_out")
    counts = {(r.toxic, r.predicted): r["count"] for r in scored.groupBy("toxic", "predicted").count().collect()}
    assert counts[1, 1] / (counts[1, 1] + counts[1, 0]) > 0.75 and counts.get((0, 1), 0) / counts[0, 0] < 0.01
    assert scored.where(F.col("score").isNull()).count() == 0
