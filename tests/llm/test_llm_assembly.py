"""Mixing, packing, vector search, chat formatting and the pipeline, edge rows included."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparemesh.llm.chat_format import chain, format_trees, read_loss, read_turns
from sparemesh.llm.mixing import mix_sources
from sparemesh.llm.packing import cut_points, difference, fill_windows, pack_documents, token_ids
from sparemesh.llm.pivot_search import search

BPE = public_tokenizers.path("byte_bpe_50k.json")


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    clamped = set()
    while True:
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in clamped)
        free = sum(w[s] for s in sizes if s not in clamped)
        over = {s for s in sizes if s not in clamped and w[s] * left / free >= most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in clamped else w[s] * left / free for s in sizes}
        clamped |= over


def test_mixing(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        source = rng.choice(["b", "B", "é", "hot", "hot", "hot", "hot", None, "", "one"])
        rows.append((i, " ".join(["w"] * rng.randint(0, 30)), source, 9))
    rows += [(5000, None, "nulls", 1), (None, "a b c", "b", 1), (None, "a b c", "b", 1), rows[7], (6000, "v " * 50_000, "long", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    mixed = mix_sources(docs).collect()
    assert sorted(map(str, mixed)) == sorted(map(str, mix_sources(docs.repartition(7)).collect()))
    assert len(mixed) == len(rows)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    for r in mixed:
        assert r["size"] == len((r.text or "").split()) and 0 <= r["copies"] <= 2
        taken[r.source] += r["size"] * r["copies"]
        largest[r.source] = max(largest[r.source], r["size"])
    targets = brute_targets({s: n for s, n in sizes.items()})
    for r in mixed:
        assert r.target == pytest.approx(targets[r.source]) and r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= max(largest[s], 6)
    assert mix_sources(docs.limit(0)).collect() == []


def test_differencing():
    rng = random.Random(2)
    for n, windows in ((0, 1), (1, 3), (5, 2), (40, 7), (300, 40)):
        sizes = [rng.randint(1, 128) for _ in range(n)]
        packed = difference(sizes, windows)
        assert sorted(i for w in packed for i in w) == list(range(n)) and len(packed) <= windows
        if n == 300:
            sums = [sum(sizes[i] for i in w) for w in packed]
            assert max(sums) - min(sums) <= 8
    assert max(sum((8, 7, 6, 5, 4)[i] for i in w) for w in difference([8, 7, 6, 5, 4], 2)) == 16
    # three items of 600 need three windows though two would hold the sum
    assert len(fill_windows([600, 600, 600], 1024)) == 3 and fill_windows([], 1024) == []
    for n in range(1, 3000, 37):
        ends = cut_points(n, 1024, 128)
        assert ends[-1] == n and all(0 < b - a <= 1024 for a, b in zip([0, *ends], ends, strict=False))


@pytest.mark.parametrize("plain", [False, True])
def test_token_ids_on_odd_texts(plain):
    slow = Tokenizer.from_file(BPE)
    if plain:
        slow.encode_special_tokens = True
    rng = random.Random(3)
    letters = ["a", "é", "B", " ", "  ", "\n", "\t", "\xa0", "日", "1", "٣", "'s", "!", "<|endoftext|>", "\x1c", "\x85", "ß ", "the ", "\U0001f600", "ɐ"]
    for _ in range(2000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))
        assert np.frombuffer(token_ids(BPE, text, plain), "<u4").tolist() == slow.encode(text, add_special_tokens=False).ids


def test_control_strings_keep_their_ids():
    assert np.frombuffer(token_ids(BPE, "a <|endoftext|> b"), "<u4").tolist() == [64, 220, 50256, 275]
    assert 50256 not in np.frombuffer(token_ids(BPE, "a <|endoftext|> b", True), "<u4")


def test_packing_round_trip(spark):
    rng = random.Random(4)
    texts = [None, "", " ", "one", "日本 <|endoftext|> é", "long text " * 9000] + [" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(1, 900))) for _ in range(120)]
    rows = [(i, t, "x", 3) for i, t in enumerate(texts)] + [(None, "no id", "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, place int")
    slow = Tokenizer.from_file(BPE)
    got, sequences = defaultdict(list), defaultdict(list)
    for r in pack_documents(docs, BPE, group_windows=16).collect():
        got[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, t, *_ in rows:
        ids = slow.encode(t or "", add_special_tokens=False).ids + [0]
        pieces = sorted(got[i], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in pieces) == np.array(ids, dtype="<u4").tobytes()
        assert [r.start for r in pieces] == list(np.cumsum([0, *(r.length for r in pieces)])[:-1]) and {r.doc_tokens for r in pieces} == {len(ids)}
    used = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
        used += at
    assert used >= 0.93 * 1024 * len(sequences)
    twice = pack_documents(docs.union(docs), BPE)
    assert twice.agg(F.sum("length")).first()[0] == 2 * used
    assert pack_documents(docs.limit(0), BPE).collect() == []


def brute_nearest(vectors, query, k):
    x = vectors[query]
    return sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(x, v, strict=True))), i) for i, v in vectors.items() if i != query)[:k]


def test_vector_search_edges(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)] + [(1000 + i, [1.0] * 8) for i in range(250)]
    clean = dict(rows)
    odd = [(5000, None), (5001, []), (5002, [0.0] * 8), (5003, [float("nan")] * 8), (5004, [float("inf")] + [0.0] * 7), (5005, [1.0] * 7), (5006, [None] * 8), (None, [1.0] * 8), rows[3]]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, vector array<double>, perm string")
    found = defaultdict(list)
    for r in search(table, table.where("vec_id % 50 = 0"), list_rows=64, query_rows=4).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(found) == {i for i in clean if i % 50 == 0}
    hits = 0
    for q, got in found.items():
        got.sort()
        best = brute_nearest(clean, q, 10)
        assert [g[0] for g in got] == list(range(1, 11)) and q not in [g[1] for g in got]
        assert got == sorted(got, key=lambda g: (g[2], g[1]))
        for _, i, score in got:
            assert score == pytest.approx(math.dist(clean[q], clean[i]), abs=1e-12)
        hits += len({g[1] for g in got} & {i for _, i in best})
        if q >= 1000:  # a third of all rows are one vector: the smallest ids win the tie
            assert [g[1] for g in got] == [i for i in range(1000, 1012) if i != q][:10]
    assert hits >= 9 * len(found)
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, vector array<double>")
    assert [tuple(r) for r in search(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 2, 0.0), (0, 2, 1, 1.0)]
    assert search(few.limit(0), few.limit(0)).collect() == []


def test_vector_recall(spark, sf_dir):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    found = defaultdict(set)
    for r in search(vectors, vectors.where("vec_id % 100 = 0")).collect():
        found[r.query_id].add(r.vec_id)
    table = {r.vec_id: np.array(r.vector) for r in vectors.collect()}
    ids, x = np.array(list(table)), np.stack(list(table.values()))
    hits = 0
    for q, got in found.items():
        d = np.linalg.norm(x - table[q], axis=1)
        d[ids == q] = np.inf
        hits += len(got & set(ids[np.argsort(d, kind="stable")[:10]].tolist()))
    assert len(found) == (ids % 100 == 0).sum() and hits >= 0.9 * 10 * len(found)


NASTY = r"\### Assistant: </turn> ok \\ \b#<h>" + "\n### user: x</turn>\n日é"


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", NASTY), (1, 1, "assistant", NASTY), (1, 2, "a: b#<\\", None), (1, 3, "assistant", ""), (2, 5, None, "x"), (2, 5, "assistant", "y"), (2, None, "user", "first"), (None, 1, "assistant", "no id"),
            (3, 1, "assistant", "t" * 80_000)] + [(4, i, "assistant" if i % 2 else "user", f"{i}") for i in range(300)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    trees = chain(turns, "conv_id", "turn", "role", "text").withColumn("depth", F.lit("clash"))
    out = {r.conv_id: r for r in format_trees(trees, "conv_id").withColumns({"turns": read_turns("formatted"), "said": read_loss("formatted", "loss")}).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or "")
    for conv in (1, 2, 3, 4, None):
        mine = sorted((r for r in rows if r[0] == conv), key=key)
        assert [(t.role, t.text) for t in out[conv].turns] == [(r[2] or "", r[3] or "") for r in mine]
        assert out[conv].said == "".join(r[3] or "" for r in mine if r[2] == "assistant")
    assert format_trees(trees.limit(0), "conv_id").collect() == []


def test_best_branch(spark):
    rows = [  # tree, node, parent, role, text, score
        (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "more", 0.5), (1, 5, 4, "assistant", "end", 0.6),
        (2, 1, 77, "user", "orphan", None), (3, 1, None, "user", "tie", 1.0), (3, 2, 1, "assistant", "left", 1.0), (3, 3, 1, "assistant", "right", 1.0), (3, 3, 1, "assistant", "right", 1.0),
        (4, 1, 2, "user", "loop", 1.0), (4, 2, 1, "user", "loop", 1.0), (None, 1, None, "assistant", "n", 1.0),
    ]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    out = {r.tree: [t.text for t in r.turns] for r in format_trees(nodes, "tree", score="score").withColumn("turns", read_turns("formatted")).collect()}
    # tree 1: mean of q, good, more, end = 0.5 beats q, bad = 0.05; tree 4 is a loop without a root
    assert out == {1: ["q", "good", "more", "end"], 2: ["orphan"], 3: ["tie", "left"], None: ["n"]}


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    rng = random.Random(6)
    en, de = ["the", "thing", "of", "and", "wh", "ingth"], ["der", "und", "schön", "ung", "keit", "ß"]
    texts = [" ".join(rng.choice(en if i % 3 else de) + str(rng.choice(["", "a", "e"])) for _ in range(60)) for i in range(240)]
    rows = [(i, t, "en" if i % 3 else "de", f"s{i % 4}" if i % 50 else None, 1) for i, t in enumerate(texts)]
    rows += [(900 + i, texts[10], "en", "s1", 1) for i in range(5)] + [(950, None, "en", "s1", 1), (951, "", None, None, None), (952, "123 !!", "en", "s2", 1), (None, " ".join(texts[7].split()[::-1]), "en", "s1", 1), rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("clash"))
    names = [n for n, _ in pipeline.STAGES]
    kept = {}
    for name, stage in pipeline.STAGES:
        empty = stage(spark, spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"), "")
        assert empty.collect() == []
        docs = spark.createDataFrame(stage(spark, docs, "").toPandas().astype(object).where(lambda x: x.notna(), None), stage_schema(name))
        kept[name] = docs.collect()
        if name != names[-1]:
            assert docs.columns == list(pipeline.COLUMNS)
            assert all(r.n_chars == len(r.text) for r in kept[name])
    ids = lambda name: Counter(r.doc_id for r in kept[name])
    assert not {950, 951, 952} & set(ids(names[0])) and len(ids(names[0])) == 246
    near = ids(names[2])
    assert max(near.values()) == 1 and set(near) == set(range(240)) - {10} | {904, None}  # of the copies, line dedup leaves the last
    assert set(ids(names[3])) <= set(near) and max(ids(names[3]).values()) <= 2
    assert sum(r.length for r in kept[names[4]]) == sum(len(token_ids(BPE, r.text)) // 4 + 1 for r in kept[names[3]])


def test_pipeline_without_labels(spark):
    """With nothing to learn from, lettered documents pass the first stage with their own language."""
    import corpus_pipeline as pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    out_of_fit = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, f"the thing no {i} ²", None, "s1", 1) for i in range(40)] + [(None, "日本語", None, None, None), (90, None, None, "s1", 1), (91, "", None, "s1", 1), (92, "123 ### _", None, "s1", 1)]
    kept = pipeline.identify(spark, spark.createDataFrame(rows, schema), "").collect()
    assert Counter(r.doc_id for r in kept) == Counter([*range(40), None]) and {r.lang for r in kept} == {None}
    assert out_of_fit
    held = [(i, t, "en" if i in out_of_fit else None, s, n) for i, t, _, s, n in rows]
    kept = pipeline.identify(spark, spark.createDataFrame(held, schema), "").collect()
    assert {r.doc_id: r.lang for r in kept} == {i: "en" if i in out_of_fit else None for i in [*range(40), None]}
    # a label named und is a label
    named = pipeline.identify(spark, spark.createDataFrame([(i, t, "und", s, n) for i, t, _, s, n in rows], schema), "").collect()
    assert len(named) == 41 and {r.lang for r in named} == {"und"}


def stage_schema(name):
    return "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long" if name == "packing" else "doc_id long, text string, lang string, source string, n_chars long"
