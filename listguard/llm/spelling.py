"""Spelling variants: words one change apart, found by PartEnum signatures of their letters."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listguard.llm.batches import byte_batches
from listguard.llm.scratch import stage
from listguard.llm.simhash import slot_bits, whole_cells

#: Parts that a word's letters are dealt to, and how many of them may differ.
PARTS = 4
DIFFERENT = 2
ENUMERATED = list(combinations(range(PARTS), DIFFERENT))
#: Words that meet in one cell, candidate pairs compared together, and the longest words compared as rows of a table.
CELL = 4096
TOGETHER = 1 << 18
WIDE = 64
#: Distinct words that a task counts before it hands them on, and copies of root rows for a hub of many words.
COUNTED = 300_000
SALTS = 8
#: Every how many hashes a run loses a code point.
EVERY = 97

#: Bytes of Latin-1: letters as counted (only A-Z change), all else as a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str) -> list[bytes]:
    """The maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z in lower case, as Latin-1: a byte is a code point."""
    return text.encode("latin-1", "replace").translate(LETTERS).split()


def typed(run: bytes, seed: int) -> bytes:
    """The run, or for one in EVERY hashes the run without one code point; ``seed``: the crc32 of ``<doc_id>:``."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(df: DataFrame, text: str, doc_id: str, shortest: int, least: int) -> DataFrame:
    """(word, n): words of at least ``shortest`` code points that occur ``least`` times or more in all texts."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def handed_on() -> pa.RecordBatch:
            words = [w for w in seen if len(w) >= shortest]
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in words], pa.string()),
                                               pa.array([seen[w] for w in words], pa.int64())], names=["word", "n"])

        for batch in batches:
            for name, whole in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                seed = zlib.crc32(f"{name}:".encode())
                for run, n in Counter(runs(whole)).items():
                    seen[typed(run, seed)] += n
                if len(seen) >= COUNTED:
                    yield handed_on()
                    seen.clear()
        yield handed_on()

    byte_batches(df.sparkSession, texts=1 << 16)
    texts = df.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))
    found = texts.where("text is not null").mapInArrow(counted, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers whose every bit depends on all bits of ``x``."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words side by side: their letters with the number of the word and the place in it."""

    def __init__(self, words: list[bytes]) -> None:
        self.n, self.length = len(words), np.array([len(w) for w in words], dtype=np.int64)
        self.letter = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.uint64)
        self.word = np.repeat(np.arange(self.n), self.length)
        self.start = np.r_[0, np.cumsum(self.length)]
        self.place = np.arange(len(self.word)) - self.start[self.word]

    def parts(self) -> np.ndarray:
        """A sum of hashes for each word and part: the multiset of the letters that fall into the part.

        The word is a binary vector: one dimension for every letter and number of its occurrence in the word.
        A replaced letter changes two dimensions, an inserted or deleted one a single dimension. Equal
        multisets have equal sums.
        """
        key = self.word * 256 + self.letter.astype(np.int64)
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.diff(key[order], prepend=-1))
        occurrence = np.empty(len(key), dtype=np.uint64)
        occurrence[order] = np.arange(len(key)) - np.repeat(starts, np.diff(np.r_[starts, len(key)]))
        dimension = mixed(self.letter + np.uint64(256) * occurrence)
        sums = np.zeros((self.n, PARTS), dtype=np.uint64)
        np.add.at(sums, (self.word, (mixed(dimension) % np.uint64(PARTS)).astype(np.int64)), dimension)
        return sums

    def ends(self, taken: np.ndarray, last: bool) -> np.ndarray:
        """A hash of each word's first (or last) ``taken`` letters with their places."""
        place = (self.length[self.word] - 1 - self.place) if last else self.place
        inside = place < taken[self.word]
        sums = np.zeros(self.n, dtype=np.uint64)
        np.add.at(sums, self.word[inside], mixed(self.letter[inside] + np.uint64(256) * place[inside].astype(np.uint64)))
        return sums


def signatures(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Keys, a row for each word, and the shape of each column's key (longer, side, enumerated parts).

    PartEnum with one first-level part: of PARTS parts at most DIFFERENT differ between near words, so the
    multisets without some DIFFERENT parts agree. Each such signature is joined with the length of the shorter
    word and the half that must agree besides: of near words, the shorter of c letters, either the first c // 2 or
    the last c - c // 2 letters are the same. That keeps words of the same letters in another order apart.
    """
    sums = words.parts()
    left = [sums[:, [p for p in range(PARTS) if p not in gone]].sum(axis=1, dtype=np.uint64) for gone in ENUMERATED]
    keys, shapes = [], []
    for longer in (0, 1):
        shorter = words.length - longer
        half = shorter // 2
        for side in (0, 1):
            end = words.ends(shorter - half if side else half, bool(side))
            end = mixed(end ^ mixed(shorter.astype(np.uint64) * np.uint64(2) + np.uint64(side)))
            for number, rest in enumerate(left):
                keys.append(mixed(rest + np.uint64(number)) ^ end)
                shapes.append((longer, side, number))
    return np.stack(keys, axis=1).view(np.int64), np.array(shapes)


#: The first enumerated set that holds all differing parts, by the bits of these parts.
FIRST = np.array([next((i for i, gone in enumerate(ENUMERATED) if not mask & ~sum(1 << p for p in gone)), -1)
                  for mask in range(1 << PARTS)])


def agreement(a: np.ndarray, b: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Leading places, up to ``width``, in which rows agree."""
    differs = a != b
    return np.minimum(np.where(differs.any(axis=1), differs.argmax(axis=1), a.shape[1]), width)


def prefix(u: bytes, v: bytes) -> int:
    """Leading places in which two words agree, by halving."""
    low, high = 0, min(len(u), len(v))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if u[low:middle] == v[low:middle] else (low, middle - 1)
    return low


class Compared:
    """The words of some cells, ready to be compared pair by pair."""

    def __init__(self, words: list[bytes]) -> None:
        self.words, self.known = words, Words(words)
        self.length, self.sums = self.known.length, self.known.parts()
        short = self.length <= WIDE
        width = int(self.length[short].max(initial=0))
        self.left = np.zeros((len(words), width), dtype=np.uint8)
        self.right = np.zeros((len(words), width), dtype=np.uint8)
        inside = short[self.known.word]
        word, place, letter = self.known.word[inside], self.known.place[inside], self.known.letter[inside]
        self.left[word, place] = letter
        self.right[word, self.length[word] - 1 - place] = letter

    def near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether pairs of different words are one change apart, and the letters that agree at the front."""
        least = np.minimum(self.length[i], self.length[j])
        most = np.maximum(self.length[i], self.length[j])
        front, back = np.zeros(len(i), dtype=np.int64), np.zeros(len(i), dtype=np.int64)
        short = most <= WIDE
        front[short] = agreement(self.left[i[short]], self.left[j[short]], least[short])
        back[short] = agreement(self.right[i[short]], self.right[j[short]], least[short])
        for at in np.flatnonzero(~short):
            u, v = self.words[i[at]], self.words[j[at]]
            front[at], back[at] = prefix(u, v), prefix(u[::-1], v[::-1])
        return front + back >= most - 1, front


def near_in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word of whole cells: how many near words it meets here first, and the best of them.

    Near words share several signatures. They count only under the first one they share: the shorter word's
    length, the first half if it agrees, the first enumerated set that holds all differing parts.
    """
    for table, starts in whole_cells(batches, ["key", "cell"]):
        coded = table["word"].combine_chunks().dictionary_encode()
        column, word, n = coded.dictionary, coded.indices.to_numpy(), table["n"].to_numpy()
        rank = np.empty(len(column), dtype=np.int64)
        rank[pc.sort_indices(column).to_numpy()] = np.arange(len(column))
        compared = Compared([w.encode("latin-1") for w in column.to_pylist()])
        shape, mine = table["shape"].to_numpy(), table["mine"].to_numpy()
        longer, side, number = shape // (2 * len(ENUMERATED)), shape // len(ENUMERATED) % 2, shape % len(ENUMERATED)
        cell = table["cell"].to_numpy()
        one_part = (cell >> 31) == (cell & ((1 << 31) - 1))  # else only words of different parts meet here
        total = len(word)
        ends = np.repeat(np.r_[starts[1:], total], np.diff(np.r_[starts, total]))
        place = np.r_[0, np.cumsum(ends - np.arange(total) - 1)]
        sources, targets, at = [], [], 0
        while at < total:  # rows whose pairs fill the room, then those pairs
            stop = max(at + 1, int(np.searchsorted(place, place[at] + TOGETHER, side="right")) - 1)
            rows = np.arange(at, stop)
            later = ends[rows] - rows - 1
            i = np.repeat(rows, later)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.r_[0, np.cumsum(later)[:-1]], later)
            at = stop
            # Equal shapes but for the length; two words that are both the longer meet under their own length.
            meet = (side[i] == side[j]) & (number[i] == number[j]) & ((longer[i] == 0) | (longer[j] == 0))
            meet &= one_part[i] | (mine[i] != mine[j])
            i, j = i[meet], j[meet]
            close, front = compared.near(word[i], word[j])
            i, j, front = i[close], j[close], front[close]
            a, b = compared.length[word[i]], compared.length[word[j]]
            mask = ((compared.sums[word[i]] != compared.sums[word[j]]) << np.arange(PARTS)).sum(axis=1)
            first = (number[i] == FIRST[mask]) & (side[i] == (front < np.minimum(a, b) // 2))
            first &= longer[i] + longer[j] == abs(a - b)
            sources += [i[first], j[first]]
            targets += [j[first], i[first]]
        source, target = np.concatenate(sources or [np.zeros(0, int)]), np.concatenate(targets or [np.zeros(0, int)])
        order = np.lexsort((rank[word[target]], -n[target], word[source]))
        source, target = source[order], target[order]
        firsts = np.flatnonzero(np.diff(word[source], prepend=-1))  # a word may stand in several cells
        best = target[firsts]
        yield pa.RecordBatch.from_arrays(
            [column.take(pa.array(word[source[firsts]])), pa.array(np.diff(np.r_[firsts, len(source)]), pa.int64()),
             pa.array(n[best], pa.int64()), column.take(pa.array(word[best]))],
            names=["word", "n_near", "form_n", "form"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): the number of near words, and the best of them as (-n, word); words without are missing."""
    shapes = 4 * len(ENUMERATED)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, _ = signatures(Words([w.encode("latin-1") for w in batch["word"].to_pylist()]))
            rows = pa.array(np.repeat(np.arange(len(keys)), shapes))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), pa.array(np.tile(np.arange(shapes, dtype=np.int8), len(keys))),
                 batch["word"].take(rows), batch["n"].take(rows)], names=["key", "shape", "word", "n"])

    keyed = words.mapInArrow(signed, "key long, shape byte, word string, n long")
    # Slots bound the words under a key from above; a key in a crowded slot is cut into parts, every two of which
    # meet in a cell of their own.
    slot = F.shiftrightunsigned(F.xxhash64("key"), 64 - slot_bits(words.count() * shapes)).cast("int")
    keyed = keyed.withColumn("slot", slot)
    crowds = (keyed.groupBy("slot").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > CELL)
              .select("slot", F.ceil(F.col("__n") / CELL).cast("int").alias("parts")))
    crowds = F.broadcast(stage(crowds, "crowds"))  # at most a line for each of the slots, whose number is fixed
    parts = F.coalesce("parts", F.lit(1))
    dealt = keyed.join(crowds, "slot", "left").withColumn("mine", F.pmod(F.xxhash64("word"), parts).cast("int"))
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), parts - 1))).select(
        "key", (F.least("mine", "__other").cast("long") * (1 << 31) + F.greatest("mine", "__other")).alias("cell"),
        "shape", "mine", "word", "n")
    cells = dealt.repartition("key", "cell").sortWithinPartitions("key", "cell")
    found = cells.mapInArrow(near_in_cells, "word string, n_near long, form_n long, form string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"),
                                     F.min(F.struct((-F.col("form_n")).alias("m"), "form")).alias("best"))


def with_roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: the last form reached.

    Each round every word passes to the root of its root, so rounds are few: a form occurs at least twice as
    often as its word, so no chain is longer than the digits of the largest count in base two. Words are dealt to SALTS
    copies of the roots, as a frequent root may be that of very many words.
    """
    now = stage(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("__next"),
                             F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
        salted = now.withColumn("__salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int"))
        step = stage(salted.join(further, ["root", "__salt"], "left").select(
            "word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return now


def spelling_variants(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shortest: int = 5, least: int = 3,
                      times: int = 2) -> DataFrame:
    """One row per word: (word, form, root, n, n_near, form_n).

    Words are runs of Latin letters in the whole texts, with the deletion that ``typed`` states. Two words are
    near if they differ by exactly one inserted, deleted or replaced code point. ``form`` is the near word of
    largest n (ties: smallest in code-point order) if its n is at least ``times`` the word's, else null; ``root``
    follows forms to the last.

    Null texts and texts without letters have no words; null ids count as the empty text. Repeated rows count each
    for itself. Very long runs are words like others. An empty table, or one without a frequent word, gives an
    empty result. Other columns of ``df`` do not matter. No pair leaves its cell: cells hand on counts and the best.
    """
    words = stage(word_counts(df, text, doc_id, shortest, least), "words")
    near = near_words(words)
    enough = -F.col("best.m") >= times * F.col("n")
    forms = stage(words.join(near, "word", "left").select(
        "word", F.when(enough, F.col("best.form")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, -F.col("best.m")).alias("form_n")), "forms")
    roots = with_roots(forms)
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                                                    "n_near", "form_n")


#: DuckDB SQL for whole tables: crc32 by its table, near words by equal words without one code point.
SQL = r"""
WITH RECURSIVE polynomial AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
found AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
  FROM documents),
runs AS (SELECT id, run, count(*) AS n FROM found GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(flatten(list_transform(
      string_split(id || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [195, ord(x) - 64] END)),
      lambda b: b::BIGINT)), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM runs, polynomial),
typed AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
         n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
shorter AS (
  SELECT word, n, i AS place, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM words, unnest(range(1, length(word) + 1)) AS places(i)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.place = b.place
  WHERE a.word <> b.word
  UNION SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON s.rest = w.word
  UNION SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON s.rest = w.word),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place,
         count(*) OVER (PARTITION BY word) AS n_near FROM near),
forms AS (
  SELECT w.word, CASE WHEN r.other_n >= 2 * w.n THEN r.other END AS form, w.n, coalesce(r.n_near, 0) AS n_near,
         CASE WHEN r.other_n >= 2 * w.n THEN r.other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1),
followed AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT f.word, g.form FROM followed f JOIN forms g ON g.word = f.at WHERE g.form IS NOT NULL)
SELECT f.word, f.form, x.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN followed x ON x.word = f.word JOIN forms last ON last.word = x.at AND last.form IS NULL
"""
