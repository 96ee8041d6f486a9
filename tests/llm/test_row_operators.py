"""Edge rows and brute-force comparisons of sharding, mixing, chats and vectors."""

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from listguard.llm import chat, graph, mixing, rows, sharding, topk, vector_dedup

NAN, INF = float("nan"), float("inf")


# --- sharding -------------------------------------------------------------------------------------------------------

def test_shards_are_exact_and_repeatable(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 8)  # ranges of a partition and of a shard
    data = [(i, None if i % 7 == 0 else f"t{i % 11}", "own") for i in range(500)] + [(1, "same", "own")] * 200
    docs = spark.createDataFrame(data, "doc_id long, text string, Shard string")
    out = sharding.shuffle_into_shards(docs, shards=7)
    got = out.collect()
    assert out.columns == ["doc_id", "text", "shard", "slot"]
    assert Counter((r.doc_id, r.text) for r in got) == Counter((a, b) for a, b, _ in data)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shuffle_into_shards(docs.repartition(5), shards=7).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert sharding.shuffle_into_shards(docs.limit(0)).count() == 0


def test_matrix_margins_and_law():
    counts = [5, 0, 30, 17, 1]
    sums = np.zeros((5, 4))
    for seed in range(400):
        m = sharding.communication_matrix(counts, 4, seed)
        assert m.sum(1).tolist() == counts and m.sum(0).tolist() == [14, 13, 13, 13] and m.min() >= 0
        sums += m
    assert np.allclose(sums / 400, np.outer(counts, [14, 13, 13, 13]) / 53, atol=0.35)


def test_large_hypergeometric(monkeypatch):
    rng = np.random.default_rng(1)
    small = [int(rng.hypergeometric(40, 60, 30)) for _ in range(4000)]
    monkeypatch.setattr(sharding, "POPULATION", 10)
    large = [sharding.hypergeometric(rng, 40, 60, 30) for _ in range(4000)]
    assert abs(np.mean(small) - np.mean(large)) < 0.2 and abs(np.std(small) - np.std(large)) < 0.15
    assert sharding.hypergeometric(rng, 3 * 10**9, 10**9, 4 * 10**9) == 3 * 10**9
    assert sharding.hypergeometric(rng, 0, 50, 20) == 0


# --- mixing ---------------------------------------------------------------------------------------------------------

def filled(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, full = {}, share * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        total = sum(w[s] for s in rest)
        over = [s for s in rest if left * w[s] / total > most * sizes[s]]
        if not over:
            return {**target, **{s: left * w[s] / total for s in rest}}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            full.add(s)


def test_mix_targets_and_copies(spark):
    rng = np.random.default_rng(7)
    data = [(i, ["b", "a", None, "é", "c", "d"][min(5, int(rng.integers(0, 9)))], int(rng.integers(0, 60))) for i in range(3000)]
    data += [(9, "a", 10)] * 50 + [(5000, "zero", 0), (5001, "zero", None)]
    docs = spark.createDataFrame(data, "doc_id long, source string, size long").withColumn("target", F.lit("own"))
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for _, s, n in data:
        sizes[s] += n or 0
    want, taken = filled(sizes), Counter()
    assert len(got) == len(data)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * (r.size or 0)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(120, 0.01 * t), s
    again = mixing.mix(docs.repartition(3)).collect()
    assert Counter((r.doc_id, r.source, r.size, r.copies) for r in again) == Counter(
        (r.doc_id, r.source, r.size, r.copies) for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_pivotal_rounding_is_fair(spark):
    docs = spark.range(1200).selectExpr("id as doc_id", "cast(id % 4 as string) as source", "1L as size")
    first = {r.doc_id for r in mixing.mix(docs, seed=1).where("copies > 0").collect()}
    second = {r.doc_id for r in mixing.mix(docs, seed=50).where("copies > 0").collect()}
    assert first != second


def test_mixture_repeats_rows(spark):
    data = [(i, "a", "one two three") for i in range(20)] + [(i, "b", None) for i in range(20, 24)]
    docs = spark.createDataFrame(data, "doc_id long, source string, text string")
    got = Counter(r.doc_id for r in mixing.mixture(docs).collect())
    assert sum(3 * n for i, n in got.items() if i < 20) == 90 and max(got.values()) <= 2


# --- chats ----------------------------------------------------------------------------------------------------------

def test_chats_keep_maximal_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat, "TURNS_PER_PART", 2)
    talks = {1: "ab", 2: "abc", 3: "abc", 4: "abd", 5: "a", 6: "xa", 7: "q", 8: "bb", 9: "b"}
    data = [(c, t, "user" if t % 2 else None, x, "own") for c, talk in talks.items() for t, x in enumerate(talk)]
    data += [(10, 0, "user", None, "own"), (11, 0, "user", "", "own"), (None, 0, "user", "lost", "own"),
             (12, 0, "a", "<|im_end|>x", "own"), (13, 5, "u", "dup", "own"), (13, 5, "u", "dup", "own")]
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, part string")
    got = defaultdict(dict)
    for r in chat.format_chats(turns).collect():
        got[r.conv_id][r.part] = r.text
        assert r.n_turns <= 2
    assert set(got) == {2, 4, 6, 7, 8, 10, 11, 12, 13, None}
    assert "".join(got[2][p] for p in sorted(got[2])) == (
        "<|im_start|>unknown\na<|im_end|>\n<|im_start|>user\nb<|im_end|>\n<|im_start|>unknown\nc<|im_end|>\n")
    assert got[12][0] == "<|im_start|>a\n<| im_end |>x<|im_end|>\n" and got[13][0].count("dup") == 2
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_turn_positions_of_one_long_conversation(spark):
    turns = spark.range(3000).selectExpr("1L as conv_id", "id % 1500 as turn", "'u' as role", "cast(id % 1500 as string) as text")
    got = chat.turn_prefixes(turns.repartition(6), partitions=9).collect()
    assert sorted(r.pos for r in got) == list(range(3000)) and {r.turns for r in got} == {3000}
    assert all(int(r.text) == r.pos // 2 for r in got)


# --- components and numbering -----------------------------------------------------------------------------------------

def test_components_of_paths_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    frame = spark.createDataFrame([(b, a) if a % 3 else (a, b) for a, b in links], "a long, b long")
    got = {r.node: r.root for r in graph.components(frame).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, **{i: 200 for i in range(200, 203)}}
    assert graph.components(frame.limit(0)).count() == 0


def test_stars_in_numpy():
    rng = np.random.default_rng(0)
    i, j = rng.integers(0, 400, (2, 300))
    stars = graph.Stars(400)
    stars.ROOM = 50
    for at in range(0, 300, 20):
        stars.add(i[at:at + 20], j[at:at + 20])
    label = np.arange(400)
    for _ in range(400):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
    a, b = stars.links()
    assert (label[a] == b).all() and set(a) == set(np.flatnonzero(label != np.arange(400)))


def test_numbers_have_no_gaps(spark):
    frame = spark.range(500).selectExpr("id", "id % 2 as g", "id div 90 as part")
    got = rows.numbered(frame, ["g"], "part", ["id"], "n").collect()
    assert all(r.n == r.id // 2 for r in got)


# --- vectors --------------------------------------------------------------------------------------------------------

SCHEMA = "vec_id long, embedding array<float>, label int, kept string, score string"


def vectors(spark, n=300, dim=6, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(20, dim))
    data = []
    for i in range(n):
        v = base[int(rng.integers(0, 20))] + rng.normal(size=dim) * rng.choice([0, 0.02, 0.1, 1])
        data.append((i, [float(np.float32(x)) for x in v], int(rng.integers(0, 3)) if i % 17 else None, "own", "own"))
    odd = [None, [], [0.0] * dim, [NAN] + [1.0] * (dim - 1), [INF] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0, 2.0], [2.0, 4.0]]
    data += [(n + i, v, 1, "own", "own") for i, v in enumerate(odd)]
    data += [(n + 50 + i, data[4][1], data[4][2], "own", "own") for i in range(30)]
    return data, spark.createDataFrame(data, SCHEMA)


def good(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def test_range_join_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "PART", 16)
    monkeypatch.setattr(vector_dedup, "BLOCK", 8)
    monkeypatch.setattr(vector_dedup, "PIVOTS", 5)
    data, frame = vectors(spark)
    live = [(i, np.array(v), l) for i, v, l, *_ in data if good(v) and any(v) and l is not None]
    links, parent = Counter(), {i: i for i, *_ in data}
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for k, (i, v, l) in enumerate(live):
        for j, w, m in live[k + 1:]:
            if l == m and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.98:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r.vec_id: r for r in vector_dedup.near_vectors(frame).collect()}
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {i: (links[i], find(i)) for i in parent}
    assert all(r.kept == (r.component_id == i) for i, r in got.items()) and got[0].score == "own"
    assert vector_dedup.near_vectors(frame.limit(0)).count() == 0


def test_top_k_against_all_products(spark, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", (20, 40))
    monkeypatch.setattr(topk, "QUERIES", 9)
    monkeypatch.setattr(topk, "LEAF", 4)
    data, frame = vectors(spark, seed=1)
    live = [(i, np.floor(1024 * np.array(v, dtype=float)).astype(int)) for i, v, *_ in data if good(v)]
    want = []
    for q, v in live:
        if q % 10 == 0:
            scores = sorted((-int(v @ w), i) for i, w in live if i != q and len(w) == len(v))[:10]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    got = topk.top_k(frame, F.col("vec_id") % 10 == 0).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(frame.limit(0), F.lit(True)).count() == 0
    few = frame.where("vec_id < 4")
    assert topk.top_k(few, F.col("vec_id") == 0).count() == 3


def test_cover_tree_covers_and_parts():
    points = np.random.default_rng(2).normal(size=(3000, 2))
    tree = topk.CoverTree(points)
    assert sorted(tree.order.tolist()) == list(range(3000)) and len(tree.centre) > 50
    for n, below in enumerate(tree.below):
        inside = tree.points[tree.start[n]:tree.end[n]]
        assert np.linalg.norm(inside - tree.centre[n], axis=1).max() <= tree.radius[n] + 1e-12
        centres = np.array([tree.centre[c] for c in below])
        for a in range(len(centres)):
            apart = np.linalg.norm(centres[a + 1:] - centres[a], axis=1)
            assert not len(apart) or apart.min() > tree.radius[n] / 2


def test_products_beyond_doubles_are_exact():
    a = np.array([[2.0**40 + 1, 3.0]])
    assert topk.products(a, a)[0, 0] == (2**40 + 1) ** 2 + 9


# --- tables on the way -----------------------------------------------------------------------------------------------

def test_clearing_spares_the_tables_of_other_jobs(spark):
    from listguard.llm import scratch

    kept = scratch.stage(spark.range(5), "own")
    with scratch.collected() as mine:
        gone = scratch.stage(spark.range(7), "other")
        assert gone.count() == 7
    scratch.clear(spark, mine)
    assert mine == [] and kept.count() == 5


def test_top_k_keeps_equal_vectors_of_other_ids_beside_a_repeated_id(spark):
    rows = [(100, [1.0, 2.0])] * 12 + [(200, [1.0, 2.0]), (300, [0.5, 0.5])] + [(50, [1.0, 2.0])] * 3
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted((r.query_id, r.rank, r.vec_id) for r in topk.top_k(frame, F.col("vec_id") == 100, k=3).collect())
    assert found == [(100, 1, 50), (100, 2, 50), (100, 3, 50)]
    found = sorted((r.rank, r.vec_id) for r in topk.top_k(frame, F.col("vec_id") == 100, k=10).collect())
    assert found == [(1, 50), (2, 50), (3, 50), (4, 200), (5, 300)]
    found = sorted((r.rank, r.vec_id) for r in topk.top_k(frame, F.col("vec_id") == 200, k=14).collect())
    assert found == [(i, 50 if i < 4 else 100) for i in range(1, 15)]
