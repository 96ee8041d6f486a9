"""Spelling variants, lexical search and token counts against brute force, and their edge rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from listguard.llm import lexical, spelling, token_counts

BYTES = public_tokenizers.path("byte_bpe_50k.json")
LONG = "word " * 40_000 + "a" * 100_000 + " Ünïque"
EDGE = [None, "", "  \n", "one", "one two one", "one two one", "ſ×÷ ÀÉ naïve naïve naïve", LONG,
        "<|endoftext|>x <|endoftext|> 's it's  　x\n\n  y", "\x00 \x1c odd\x85space", "a" * 20_000 + "!" * 20_000]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# --- spelling variants -----------------------------------------------------------------------------------------------

def plain_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            n[run if h % 97 else run[:at] + run[at + 1:]] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def plain_variants(rows):
    n, near = plain_words(rows), defaultdict(set)
    rest = defaultdict(list)
    for w in n:
        for i in range(len(w)):
            short = w[:i] + w[i + 1:]
            rest[i, short].append(w)
            if short in n:
                near[w].add(short)
                near[short].add(w)
    for same in rest.values():
        for w in same:
            near[w].update(x for x in same if x != w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def spelled(spark, rows):
    frame = spark.createDataFrame([(*r, "own", 1) for r in rows], "doc_id long, text string, word string, n int")
    found = spelling.spelling_variants(frame).collect()
    assert len({r.word for r in found}) == len(found)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found}


def misspelled(rng, words, repeats):
    out = []
    for w in words:
        out += [w] * int(rng.integers(3, repeats))
        for _ in range(4):
            at = int(rng.integers(0, len(w)))
            letter = "abcdeé"[int(rng.integers(0, 6))]
            wrong = [w[:at] + w[at + 1:], w[:at] + letter + w[at:], w[:at] + letter + w[at + 1:]][int(rng.integers(0, 3))]
            out += [wrong] * int(rng.integers(1, 6))
    return out


@pytest.mark.parametrize("cell", [4096, 3])
def test_spelling_variants_against_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(spelling, "CELL", cell)  # crowded signatures are cut into parts
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdé"), int(rng.integers(5, 12)))) for _ in range(120)]
    words += ["ab" * 40 + "c", "ab" * 40 + "cd", "ba" * 40 + "c"]  # longer than a table of letters is wide
    words += ["aabbc", "abab" + "c", "bbaac", "cbaab", "aabbcc"]  # the same letters in another order
    rows = list(enumerate(EDGE)) + [(None, "Listen listen LISTEN")]
    for i in range(60):
        rows.append((100 + i, " ".join(rng.permutation(misspelled(rng, words, 9))) if i < 6 else "silent tablet"))
    rows += [rows[-1]] * 3
    assert spelled(spark, rows) == plain_variants(rows)


def test_chains_of_forms_reach_their_root(spark):
    text = []
    for i in range(9):
        text += ["a" * (5 + i)] * (3 * 2 ** i)
    found = spelled(spark, [(1000 + i, " ".join(text)) for i in range(2)])
    assert found == plain_variants([(1000 + i, " ".join(text)) for i in range(2)])
    assert {r[1] for r in found.values()} == {"a" * 13}


def test_no_words_give_no_rows(spark):
    assert spelled(spark, [(1, None), (2, ""), (3, "abcd abcd abcd")]) == {}
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- lexical search --------------------------------------------------------------------------------------------------

def plain_terms(text):
    return re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))


def plain_search(docs, items, k):
    counted = [(i, Counter(t), len(t)) for i, text in docs if (t := plain_terms(text))]
    n, total = len(counted), sum(c[2] for c in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for doc_id, tf, length in counted:
            m = 25 + 75 * length * n // total
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) *
                    (10 ** 9 * tf[t] // (1000 * tf[t] + 8 * m))
                    for t, times in Counter(plain_terms(text)).items() if t in tf)
            if s > 0:
                scores.append((-s, doc_id is None, doc_id))
        out += [(item, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def ranked(spark, docs, items, k=10):
    frame = spark.createDataFrame([(*d, "own", 1) for d in docs], "doc_id long, text string, item_id string, rank int")
    asked = spark.createDataFrame([(*i, 5, 0) for i in items], "item_id long, text string, doc_id long, score int")
    return sorted([tuple(r) for r in lexical.search(frame, asked, k).select(
        "item_id", "rank", "doc_id", "score").collect()], key=repr)


def some_documents(rng, n):
    vocabulary = [f"t{i}" for i in range(300)]
    share = 1 / np.arange(1, 301)
    share /= share.sum()
    return [" ".join(rng.choice(vocabulary, int(rng.integers(1, 120)), p=share)) for _ in range(n)]


@pytest.mark.parametrize("together", [1 << 18, 200])
def test_search_against_all_scores(spark, monkeypatch, together):
    monkeypatch.setattr(lexical, "TOGETHER", together)  # several groups of items
    rng = np.random.default_rng(5)
    docs = list(enumerate(EDGE + some_documents(rng, 400)))
    docs += [(9000 + i, docs[40][1]) for i in range(30)] + [docs[41]] * 3 + [(None, docs[42][1])]  # ties, repeats
    items = [(i, t) for i, t in enumerate([docs[40][1], docs[41][1], docs[42][1], None, "", "nowhere", "t0 t0 t0", LONG,
                                           *some_documents(rng, 12)])]
    items += [items[0], (items[1][0], "t5 t6 naïve"), (None, "t7 t8")]
    assert ranked(spark, docs, items) == plain_search(docs, items, 10)


def test_few_documents_and_empty_tables(spark):
    docs = [(1, "a b"), (2, "b c"), (3, None)]
    assert ranked(spark, docs, [(1, "b a"), (2, "z")]) == plain_search(docs, [(1, "b a"), (2, "z")], 10)
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(none, asked).collect() == []
    assert lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), asked.where("false")).collect() == []


def test_blocks_are_skipped_and_summaries_hold(spark):
    """One segment by itself: summaries bound every member, and a high score leaves most documents unread."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    topics = [rng.choice(120, 9, replace=False) for _ in range(40)]  # a word belongs to three topics or so
    found = [Counter(b"w%d" % w for w in rng.choice(topics[i % 40], 15)) for i in range(3000)]
    known = pa.array(sorted({t for c in found for t in c}), pa.binary())
    table = pa.table({"doc_id": pa.array(range(3000)), "n": pa.array([sum(c.values()) for c in found]),
                      "terms": pa.array([list(c) for c in found], pa.list_(pa.binary())),
                      "tfs": pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))})
    statistics = lexical.Statistics(3000, sum(sum(c.values()) for c in found))
    df = Counter(t for c in found for t in c)
    weights = np.array([statistics.weight(df[t]) for t in known.to_pylist()], dtype=np.int64)
    segment = lexical.Segment(table, known, weights, statistics)
    asked = segment.term[segment.start[77]:segment.start[78]]
    largest = np.array([segment.posted_value[segment.list_start[t]:segment.list_start[t + 1]].max() for t in asked])
    query = lexical.Query(asked, weights[asked], largest)
    dense = np.zeros(len(known), dtype=np.int64)
    dense[asked] = weights[asked]
    scores = segment.scores(np.arange(3000), dense)
    least = int(np.sort(scores)[-10])
    segment.block(lexical.visitors([query], [least]))
    read = segment.search(query, dense, least)
    assert set(np.flatnonzero(scores >= least)) <= set(read)
    assert len(read) < len(np.unique(segment.members)) / 2 < np.count_nonzero(scores)
    for b in range(len(segment.member_start) - 1):
        summary = np.zeros(len(known), dtype=np.int64)
        part = slice(segment.summary_start[b], segment.summary_start[b + 1])
        summary[segment.summary_term[part]] = segment.summary[part]
        for d in segment.members[segment.member_start[b]:segment.member_start[b + 1]]:
            entries = slice(segment.start[d], segment.start[d + 1])
            used = np.isin(segment.term[entries], asked)
            assert (segment.value[entries] <= summary[segment.term[entries]])[used].all()


# --- token counts ----------------------------------------------------------------------------------------------------

def test_token_counts_equal_the_library(spark):
    rng = np.random.default_rng(2)
    odd = list("ab'st 09 \n\t\r  é漢字،<|>!?_-") + ["<|endoftext|>", "'ll", "  ", "\n\n"]
    texts = EDGE + ["".join(rng.choice(odd, int(rng.integers(0, 60_000)))) for _ in range(12)]
    texts += ["漢字" * 20_000, " " * 50_000 + "x", "x  " * 20_000, "1" * 50_000]
    frame = spark.createDataFrame([(i, t, 1, "own") for i, t in enumerate(texts)],
                                  "doc_id long, text string, N_Tokens int, n_bytes string")
    known = Tokenizer.from_file(BYTES)
    found = token_counts.count_tokens(frame, BYTES)
    assert found.columns == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"]
    for r in found.collect():
        expected = len(known.encode(texts[r.doc_id] or "", add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), expected, expected > 1024)
    assert token_counts.count_tokens(frame.where("false"), BYTES).count() == 0


def test_long_texts_are_cut_at_safe_places_only():
    text = "don't  stop\n\n me " * 5000
    cut = list(token_counts.pieces(text))
    assert len(cut) > 3 and "".join(cut) == text
    assert all(not a[-1].isspace() and b[0] in " \n" for a, b in zip(cut, cut[1:]))
    assert list(token_counts.pieces("x" * 100_000)) == ["x" * 100_000]
