"""URL filter, quality rules and language ID, edge rows included."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparemesh.llm.common import trimmed
from sparemesh.llm.language_id import ByteGru, Pooling, identify_languages, training_draws
from sparemesh.llm.quality_ratio import quality_filter, text_statistics
from sparemesh.llm.url_filter import GlobAutomaton, filter_urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]


def fits_glob(glob, text):
    """All places in the glob that the text can have reached, one character at a time."""

    def onward(places):
        places = set(places)
        for p in range(len(glob)):
            if p in places and glob[p] in "*~":
                places.add(p + 1)
        return places

    at = onward({0})
    for c in text:
        at = onward({p if glob[p] in "*~" else p + 1 for p in at if p < len(glob) and (glob[p] == "*" or glob[p] == "~" and c != "/" or glob[p] == c)})
        if not at:
            return False
    return len(glob) in at


def test_automaton_agrees_with_regular_expressions():
    rng = random.Random(2)
    globs = ["".join(rng.choice("ab/*~") for _ in range(rng.randint(0, 9))) for _ in range(60)] + ["é*", "a" * 70 + "*b", ""]
    urls = ["".join(rng.choice("ab/") for _ in range(rng.randint(0, 12))) for _ in range(400)] + ["éa", "a" * 90 + "b", "a" * 5000]
    found = GlobAutomaton(globs).match(urls)
    for g, glob in enumerate(globs):
        # a regular expression takes n^4 steps on the long texts, so those go place by place
        pattern = re.compile("".join({"*": ".*", "~": "[^/]*"}.get(c, re.escape(c)) for c in glob), re.S)
        assert found[:, g].tolist() == [pattern.fullmatch(u) is not None if len(u) <= 12 else fits_glob(glob, u) for u in urls]


def expected_verdict(url):
    m = re.search("://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    best = None
    for verdict, rule in RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    blocked = re.match(r"(.*\.)?spam-", host) is not None
    return (url, host, path, best[1] if best else None, best[0] if best else "block" if blocked else "allow")


def test_url_filter(spark):
    urls = [None, "", "nothing", "http://", "http://COM", "http://com/", "https://www.Example.com/en/x?y", "http://example.com/en/", "http://a.example.com/en", "http://myexample.com/en/",
            "http://evil.org/a.example.com/en/x", "http://x.net/es/1#z", "http://net/es/", "http://spam-a.org/", "http://a.spam-b.org", "x://y://com/", "http://é.com/ü", "http://a.com/" + "p" * 50_000, "http://a.com?://b.net/es/"]
    rows = [(i, u, "old", 1) for i, u in enumerate(urls + urls[:3])]
    found = filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string, __n int"), RULES, ("spam-~", "~.spam-~", "spam-~/*", "~.spam-~/*"))
    assert found.columns == ["page_id", "url", "host", "__n", "path", "rule", "verdict"]
    assert [tuple(r)[1:] for r in found.orderBy("page_id").select("page_id", "url", "host", "path", "rule", "verdict").collect()] == [expected_verdict(u) for _, u, _, _ in rows]
    assert filter_urls(spark.createDataFrame([], "url string"), RULES).collect() == []
    assert filter_urls(spark.createDataFrame([("a",)], "url string"), []).first().verdict == "allow"


def brute_statistics(text):
    w = WORD.findall(text or "")
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


EDGE_TEXTS = [None, "", " \t\n", "one", "a b", "a b c", "a b c a b c", "same " * 200, "x\nx\n\n \n\nx \nx", "#*$%&|<> ## é日", "\x0b a \x0c b \r\n", "w" * 60_000, " ".join(f"w{i % 977}" for i in range(40_000))]


def test_statistics_and_ratio(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["the", "and", "of", "ing", "er", "th"]) + rng.choice(["", "a", "on"]) for _ in range(80))
    junk = lambda: " ".join(f"{rng.choice('abcdef')}{rng.randrange(9)}***" for _ in range(80))
    texts = EDGE_TEXTS + [good() for _ in range(60)] + [junk() for _ in range(20)]
    rows = [(i, t, "old", True) for i, t in enumerate(texts)] + [(13, texts[13], "old", True), (None, texts[14], "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, kept boolean")
    labels = spark.createDataFrame([(i, 1) for i in range(13, 50)] + [(13, 1), (75, 0), (None, 1), (999, 1)], "doc_id long, quality int")
    found = quality_filter(docs, labels).collect()
    assert len(found) == len(rows)
    seen = {}
    for r in found:
        stats = brute_statistics(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == stats
        assert r.base_failed == (stats[0] < 50 or 100 * stats[4] > 50 * stats[0])
        assert not (r.base_failed and r.kept)
        if not r.base_failed and len(r.text) < 10_000:
            assert r.kept == ("***" not in r.text), r.text[:80]
        assert seen.setdefault(r.text, r.score) == r.score
    assert [r.score for r in found] == [r.score for r in quality_filter(docs, labels).collect()]


def test_ratio_is_the_plain_formula(spark):
    """Against a recomputation with the same hash, taken from Spark word by word."""
    rows = [(i, " ".join(f"w{(i * k) % 11}" for k in range(1, 60))) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, quality int")
    found = {r.doc_id: r.score for r in quality_filter(docs, labels, buckets=64).collect()}
    words = [(i, t.split(" ")) for i, t in rows]
    tokens = spark.createDataFrame([(w,) for w in sorted({w for _, t in words for w in t})], "w string").select("w", F.xxhash64("w").alias("h")).collect()
    h = {r.w: r.h for r in tokens}
    pairs = sorted({(h[a], h[b]) for _, t in words for a, b in zip(t, t[1:], strict=False)})
    h2 = {(r.a, r.b): r.h for r in spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    grams = {i: [h[w] % 64 for w in t] + [h2[h[a], h[b]] % 64 for a, b in zip(t, t[1:], strict=False)] for i, t in words}
    # the trusted rows of one hash parity are fitted, the others set the threshold
    trusted = spark.createDataFrame([(1,), (2,)], "i long").select("i", F.pmod(F.xxhash64("i", F.lit(12)), F.lit(2)).alias("half")).collect()
    assert {r.half for r in trusted} == {0, 1}
    fitted = [r.i for r in trusted if r.half == 0]
    raw, target = Counter(g for x in grams.values() for g in x), Counter(g for i in fitted for g in grams[i])
    weight = lambda g: np.log((target[g] + 1) / (target.total() + 64)) - np.log((raw[g] + 1) / (raw.total() + 64))
    plain = {i: sum(map(weight, x)) / len(x) for i, x in grams.items()}
    for i, x in grams.items():
        assert found[i] == pytest.approx(sum(map(weight, x)) / len(x), abs=1e-6)


    # one row sets the threshold, so it deviates from itself by nothing
    least = next(plain[r.i] for r in trusted if r.half == 1)
    for r in quality_filter(docs, labels, buckets=64, max_repeat_percent=100).collect():
        assert r.kept == (plain[r.doc_id] >= least - 1e-9), r.doc_id


def test_no_trusted_documents_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c " * 30), (2, " ".join(f"w{i}" for i in range(60)))], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.doc_id: (r.kept, r.score) for r in quality_filter(docs, none).collect()} == {1: (False, 0.0), 2: (True, 0.0)}
    assert quality_filter(docs.limit(0), none).collect() == []
    assert text_statistics(docs.limit(0)).collect() == []


def test_gradients_agree_with_differences():
    model = ByteGru(["a", "b"], hidden=3)
    model.start(1)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    words, labels = [b"abcab", b"ca", b"b"], np.array([0, 1, 1])

    def loss():
        sums = 0.0
        for word, label in zip(words, labels, strict=True):
            steps = np.frombuffer(word, dtype=np.uint8)[:, None]
            n = np.array([len(word)])
            both = np.concatenate([model._run(steps, n, "f"), model._run(steps, n, "b")], axis=2)[:, 0].astype(np.float64)
            z = both @ model.weights["o"] + model.weights["c"]
            sums -= (z - np.log(np.exp(z).sum(axis=1, keepdims=True)))[:, label].sum()
        return sums / sum(map(len, words))

    found = model._gradients(words, labels)
    for name, at in (("o", (1, 0)), ("c", (1,)), ("xf", (97, 4)), ("xb", (98, 7)), ("uf", (1, 2)), ("ub", (0, 8)), ("uf", (2, 5))):
        step = 1e-3
        model.weights[name][at] += step
        up = loss()
        model.weights[name][at] -= 2 * step
        down = loss()
        model.weights[name][at] += step
        assert found[name][at] == pytest.approx((up - down) / (2 * step), rel=0.02, abs=2e-4)


def test_forward_pass_and_pooling():
    """Each byte's label and a document's mean by plain loops over one byte at a time."""
    model = ByteGru(["a", "b", "c"], hidden=4)
    model.start(3)
    w, h = model.weights, 4
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def states(raw, d):
        s, out = np.zeros(h), {}
        for t in range(len(raw)) if d == "f" else reversed(range(len(raw))):
            x, u = w["x" + d][raw[t]], w["u" + d]
            z, r = sigmoid(x[:h] + s @ u[:, :h]), sigmoid(x[h : 2 * h] + s @ u[:, h : 2 * h])
            s = (1 - z) * s + z * np.tanh(x[2 * h :] + (r * s) @ u[:, 2 * h :])
            out[t] = s
        return out

    texts = ["the der schön 123 ###", "x", "straße of mañana " + "long" * 20]
    for text, lang, score in zip(texts, *Pooling(model).judge(texts), strict=True):
        labels = []
        for word in text.split(" "):
            if not re.search(r"[^\W\d_]", word):
                continue
            raw = word.encode()
            for piece in (raw[i : i + 32] for i in range(0, len(raw), 32)):
                f, b = states(piece, "f"), states(piece, "b")
                for t in range(len(piece)):
                    z = np.concatenate([f[t], b[t]]) @ w["o"] + w["c"]
                    labels.append(np.exp(z) / np.exp(z).sum())
        p = np.mean(labels, axis=0)
        assert lang == model.languages[int(p.argmax())] and score == pytest.approx(p.max(), abs=1e-5)


def test_pooling_keeps_common_words_only():
    """Words met once leave when the table is full, common ones are run once; the judgements stay."""
    model = ByteGru(["a", "b"], hidden=4)
    model.start(3)
    small, large, runs = Pooling(model, most_kept=40), Pooling(model), []
    learn = small._learn
    small._learn = lambda words: runs.append(words) or learn(words)
    for i in range(30):
        texts = ["the of and " + " ".join(f"w{i}x{k}" for k in range(20)), None, "and the"]
        (langs, scores), (wanted, exact) = small.judge(texts), large.judge(texts)
        assert langs == wanted and np.allclose(scores, exact)
        assert len(small.known) == len(small.table) <= 40 + 23
    assert sum(w == "the" for words in runs for w in words) == 1


def test_memory_goes_back_when_a_task_ends():
    """What a task held is free again, although its worker lives on."""
    def run(batches):
        held = [bytes(1000 + i % 7) for i in range(200_000)]
        yield from batches
        assert held

    def used():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 / 1e6

    before = used()
    batch = pa.RecordBatch.from_pydict({"x": [1]})
    assert list(trimmed(run)(iter([batch]))) == [batch]
    assert used() < before + 60


def test_language_edges(spark):
    rows = [(i, ("the thing of " if i % 2 else "der und schön ") * 8, "en" if i % 2 else "de", "old") for i in range(200)]
    rows += [(900, None, "en", "x"), (901, "", None, "x"), (902, "123 ### !", "en", "x"), (903, "the", None, None), (None, "und der", "de", None), (904, "thing" * 4000, None, "x"), rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    found = identify_languages(docs, steps=60, batch=64).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.text and re.search("[a-z]", r.text):
            assert r.lang_pred == ("en" if "th" in r.text else "de") and 0.5 < r.score <= 1
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0)
    blank = identify_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in blank} == {"und"} and len(blank) == len(rows)
    assert identify_languages(docs.limit(0)).collect() == []


def test_language_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify_languages(docs)
    right = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert right[1] > 20 and right[0] >= 0.95


def test_every_label_is_learned(spark):
    """Many labels with more words than any one list holds, and a script without blanks whose runs are all unique."""
    rng, rows = random.Random(4), []
    letters = "abcdefghijklmnopqrstuvwxyz"
    for k in range(12):
        own = letters[2 * k : 2 * k + 2] + chr(0x430 + k)
        rows += [(1000 * k + i, " ".join("".join(rng.choices(own, k=12)) for _ in range(50)), f"l{k:02}") for i in range(440)]
    rows += [(50_000 + i, "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(60)), "zh") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    found = identify_languages(docs, steps=150).where("held_out").groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right")).collect()
    assert len(found) == 13 and min(r.right for r in found) > 0.9


def test_draws_are_even_over_labels(spark):
    rows = [("a", f"w{i}".encode(), 1) for i in range(30_000)] + [("b", b"one", 7)] + [("c", f"w{i}".encode(), 1 + 99 * (i < 10)) for i in range(1000)]
    counts = spark.createDataFrame(rows, "lang string, piece binary, n long")
    drawn = training_draws(counts, 6000, 5).collect()
    total = Counter()
    for r in drawn:
        total[r.lang] += r.copies
    assert total["b"] == pytest.approx(2000, abs=1) and all(abs(total[k] - 2000) < 200 for k in "ac")
    often = {r.piece: r.copies for r in drawn if r.lang == "c"}
    assert all(often[f"w{i}".encode()] == pytest.approx(10 * 2000 / 1090, abs=1) for i in range(10))
    assert sorted(drawn) == sorted(training_draws(counts.repartition(7), 6000, 5).collect())
    assert training_draws(counts.limit(0), 6000, 5).collect() == []
