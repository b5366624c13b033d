"""Line dedup, Jaccard join and substring dedup against plain recomputation, edge rows included."""

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sparemesh.llm import jaccard_join
from sparemesh.llm.common import Words, components
from sparemesh.llm.jaccard_join import ODD, jaccard_components, most_apart, parity_sketch, signatures, sized_sketch, sketch_distance
from sparemesh.llm.line_dedup import build_perfect_hash, dedup_lines, find_slots, line_key
from sparemesh.llm.substring_dedup import level_lengths, remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
SCHEMA = "doc_id long, text string, n_words string, found int, copy int, __x int, size int"


def edge_rows(seed=1, n=60):
    """Texts with copies, near copies, shared passages and lines, nulls, empty and long texts, repeated rows and ids."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé日") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(40)]
    line = "A line of more than forty characters that many documents share"
    texts = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            words[5:5] = passage[rng.randint(0, 20) :]
        text = " ".join(words) if i % 2 else "\t ".join(words)
        if i % 4 == 0:
            text += f"\n {line.upper() if i % 8 else line}\r\nend"
        if i % 7 == 0 and texts:
            text = rng.choice(texts)
        elif i % 5 == 0 and texts and texts[-1]:
            parts = texts[-1].split(" ")
            parts[rng.randrange(len(parts))] = "Changed"
            text = " ".join(parts)
        texts.append(text)
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[3], (1000, None), (1001, ""), (1002, " \n\t"), (1003, "one"), (1004, "ONE"), (1005, "two words"), (None, texts[9]), (None, None), (None, "alone here " * 20)]
    rows += [(1006, " ".join(word() for _ in range(30_000))), (1007, "same " * 300), (1008, "same " * 300), (1009, "x" * 100_000)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4) for i, t in rows], SCHEMA)


def test_words_agree_with_the_pattern():
    rng = random.Random(5)
    texts = ["".join(rng.choice("aé日 \t\n\x0b\x1f\xa0B") for _ in range(rng.randint(0, 30))) for _ in range(500)] + [None, ""]
    words = Words(pa.array(texts).slice(3))
    seen = {}
    for r, text in enumerate(texts[3:]):
        found = WORD.findall(text or "")
        begin, end = words.first[r], words.first[r + 1]
        assert [words.data[s:e].tobytes().decode() for s, e in zip(words.starts[begin:end], words.ends[begin:end], strict=True)] == found
        for word, h in zip(found, words.hashes[begin:end], strict=True):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_perfect_hash_is_minimal():
    for n in (1, 2, 3, 10, 2000):
        h = np.random.default_rng(n).integers(0, 1 << 64, n, dtype=np.uint64)
        seeds, slot = build_perfect_hash(h)
        assert sorted(slot) == list(range(n))
        assert (find_slots(seeds, h, n) == slot).all()


@pytest.mark.parametrize("batch_mb", [64, 0])
def test_line_dedup(spark, batch_mb):
    rows = edge_rows()
    rows += [(2000 + k // 3, f"a long line that three rows of one document repeat, number {k % 3 % 2}\n own {k}") for k in range(12)]
    holders, documents = defaultdict(list), defaultdict(set)
    low = -1 << 63
    for n, (i, t) in enumerate(rows):
        for key in {line_key(x) for x in (t or "").split("\n")}:
            if len(key) >= 40:
                holders[key].append(low if i is None else i)
                documents[key].add(("row", n) if i is None else i)
    expected = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        drop = [len(k := line_key(x)) >= 40 and len(documents[k]) >= 5 and max(holders[k]) != (low if i is None else i) for x in lines]
        text = "\n".join(x for x, d in zip(lines, drop, strict=True) if not d) if any(drop) else t
        expected[i, text, len(lines), sum(drop)] += 1
    import sparemesh.llm.line_dedup as module

    found = module.dedup_lines(frame(spark, rows), batch_mb=batch_mb or 64)
    assert found.columns == ["doc_id", "text", "n_words", "found", "copy", "__x", "size", "n_lines", "n_dropped"]
    assert Counter(tuple(r) for r in found.select("doc_id", "text", "n_lines", "n_dropped").collect()) == expected
    assert sum(k[3] for k in expected) > 5


def test_line_dedup_in_several_batches(spark, monkeypatch):
    import sparemesh.llm.line_dedup as module

    rows = [(i, "\n".join(f"line number {k} that is shared by several of the documents" for k in range(i, i + 10))) for i in range(30)]
    one = module.dedup_lines(frame(spark, rows)).select("doc_id", "text").collect()
    index = module.line_index
    monkeypatch.setattr(module, "line_index", lambda *a, **b: index(*a, **b | {"shard_keys": 4}))
    monkeypatch.setattr(module.math, "ceil", lambda x, f=module.math.ceil: 3 if 0 < x < 0.01 else f(x))
    several = module.dedup_lines(frame(spark, rows)).select("doc_id", "text").collect()
    assert sorted(one) == sorted(several)


def test_one_text_of_many_lines(spark):
    """200,000 lines, half of them dropped, in time linear in the lines."""
    shared = [f"line number {k} that is shared by five of the documents" for k in range(20)]
    long = "\n".join(shared[k % 20] if k % 2 else f"own {k}" for k in range(200_000))
    rows = [(0, long)] + [(i, "\n".join(shared)) for i in range(1, 6)]
    begin = time.perf_counter()
    found = {r.doc_id: r for r in dedup_lines(frame(spark, rows)).collect()}
    assert time.perf_counter() - begin < 60
    assert found[0].n_dropped == 100_000 and found[0].text == "\n".join(f"own {k}" for k in range(0, 200_000, 2)) and found[5].n_dropped == 0


def test_signatures_meet():
    """Any two sets at the threshold share a signature, whatever their size."""
    rng = np.random.default_rng(3)
    for _ in range(600):
        n, percent = int(rng.integers(1, 400)), int(rng.choice([70, 80, 90]))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        apart = most_apart(2 * n, percent)
        drop = int(rng.integers(0, apart + 1))
        b = np.concatenate([a[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, apart + 1)), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        differ = sum(int(x ^ y).bit_count() if x ^ y >= 0 else int((x ^ y) + (1 << 64)).bit_count() for x, y in zip(parity_sketch(a).tolist(), parity_sketch(b).tolist(), strict=True))
        assert differ <= len(a) + len(b) - 2 * both and len(parity_sketch(a)) == len(ODD)
        if 100 * both >= percent * (len(a) + len(b) - both) and len(a) + len(b) > 2 * both:
            assert len(np.intersect1d(signatures(a, percent), signatures(b, percent)))


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute_components(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    group = list(range(len(rows)))
    named = {}
    for k, (i, _) in enumerate(rows):
        if i is not None and sets[k]:
            j = named.setdefault(i, k)
            group = [group[j] if g == group[k] else g for g in group]
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and group[a] != group[b] and (rows[a][0] is not None and rows[b][0] is not None or sets[a] == sets[b]):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    group = [group[b] if g == group[a] else g for g in group]
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[group[k]] = min(least.get(group[k], i), i)
    return Counter((i, len(sets[k]), least.get(group[k]) if sets[k] else i) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_jaccard_join(spark, width, percent):
    rows = edge_rows(width)
    rng = random.Random(width)
    base = [f"w{i}" for i in range(150)]
    for k in range(60):  # a group of near copies that no single hub connects
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(150)] = f"e{rng.randrange(40)}"
        rows.append((2000 + k, " ".join(words)))
    found = jaccard_components(frame(spark, rows), width=width, percent=percent).collect()
    assert Counter(tuple(r) for r in found) == brute_components(rows, width, percent)


def test_sized_sketches_bound_the_difference_and_tell_long_sets_apart():
    rng = np.random.default_rng(4)
    for n in (500, 800, 1500, 6000):
        a, rest = (np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64)) for _ in range(2))
        assert (sized_sketch(a) is None) == (n <= 682)
        for kept in (n, n - 9, n // 2, 0):
            b = np.concatenate([a[:kept], rest[: (n - kept) * 5 // 4]])
            if sized_sketch(a) and sized_sketch(b):
                differ = sketch_distance(sized_sketch(a), sized_sketch(b))
                assert differ == sketch_distance(sized_sketch(b), sized_sketch(a)) <= len(a) + len(b) - 2 * kept
                assert kept > n // 2 or differ * 180 > 20 * (len(a) + len(b))


def test_only_texts_of_candidates_are_copied(spark, monkeypatch):
    """Long texts with one passage in common share signatures; their texts are neither stored nor compared."""
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage = words(700)
    rows = [(i, " ".join(words(500) + passage + words(800))) for i in range(8)]
    rows += [(20, rows[0][1] + " end"), (21, rows[1][1] + " end")]
    copied, store = [], jaccard_join.stored

    def seen(df, label):
        out = store(df, label)
        if label == "texts":
            copied.extend(r["doc_id"] for r in out.select("doc_id").collect())
        return out

    monkeypatch.setattr(jaccard_join, "stored", seen)
    found = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(tuple(r) for r in found) == brute_components(rows, 5, 80)
    assert sorted(copied) == [0, 1, 20, 21]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 200), (100, 300), (300, 300)], "a long, b long")
    found = dict(components(links, "test").collect())
    assert found == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100}


def brute_repeats(rows, window):
    big = (1 << 63) - 1
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, big), big if i is None else i)
    out = Counter()
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = {j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < (big if i is None else i) for j in range(k, k + window)}
        out[i, " ".join(x for j, x in enumerate(w) if j not in gone), len(w), len(gone)] += 1
    return out


@pytest.mark.parametrize("window", [13, 8, 27])
def test_substring_dedup(spark, window):
    rows = edge_rows(window)
    found = remove_repeats(frame(spark, rows), window)
    assert found.columns == ["doc_id", "text", "found", "copy", "__x", "size", "n_words", "n_removed"]
    assert Counter(tuple(r) for r in found.select("doc_id", "text", "n_words", "n_removed").collect()) == brute_repeats(rows, window)


def test_level_lengths():
    assert level_lengths(13) == [7, 13] and level_lengths(50) == [7, 13, 25, 50] and level_lengths(7) == [4, 7] and level_lengths(1) == [1]


@pytest.mark.parametrize("operator", [dedup_lines, jaccard_components, remove_repeats])
def test_empty_tables(spark, operator):
    assert operator(frame(spark, [])).collect() == []
