"""BPE encoding and decoding with forced boundaries."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from operator import add
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from listguard.llm.batches import small_batches

#: Bytes of words and ids, with what Python adds to each entry, that a worker remembers before it starts afresh, and
#: the longest word or fragment among them.
REMEMBERED = 32 << 20
ENTRY = 200
LONGEST = 64
#: Symbols from which merges are drawn from a heap.
MANY = 128
WORD_END = "</w>"
#: Texts that normalise by lower case alone and whose words the plain pattern finds.
CHUNK = re.compile(r"[^\t-\r ]+")
PLAIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿ]*")


class Fragments(dict):
    """Packed ids of normalised words, looked up or encoded at first sight.

    ``inside`` holds the byte pairs (as the vocabulary writes bytes) that stand next to each other in
    some token. No merge can cross any other pair, so such a pair is a certain cut, and the fragments
    between cuts are encoded by themselves. White space is inside no token either.
    """

    def __init__(self, source: str) -> None:
        super().__init__()
        file = json.loads(source)
        self.library = Tokenizer.from_str(source)
        self.vocabulary: dict[str, int] = file["model"]["vocab"]
        self.rank = {tuple(pair): i for i, pair in enumerate(file["model"]["merges"])}
        bare = [t.removesuffix(WORD_END) for t in self.vocabulary]
        self.inside = {t[i:i + 2] for t in bare for i in range(len(t) - 1)}
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        # The file's own word pattern, written for lower-case letters of the plain alphabet.
        words = file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        words = words.replace(r"\s", r"\t-\r ").replace(r"\p{L}", "a-zß-öø-ÿ").replace(r"\p{N}", "0-9")
        self.words = re.compile(words)
        plain = [c for c in map(chr, range(256)) if PLAIN.fullmatch(c)]
        spelled = [self.library.pre_tokenizer.pre_tokenize_str(c) for c in plain]
        self.signs = {c: found[0][0] for c, found in zip(plain, spelled) if found}
        self.inner: dict[str, bytes] = {}
        self.held = 0

    def ids(self, text: str) -> bytes:
        """The packed ids of a whole text."""
        if PLAIN.fullmatch(text) and not self.marks.search(text):
            return b"".join(map(self.__getitem__, self.words.findall(text.lower())))
        return b"".join(map(self._chunk, CHUNK.findall(text)))

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a stretch without white space; beyond the plain alphabet the library finds the words."""
        out = []
        for piece in self.marks.split(chunk):
            if piece in self.special:
                out.append(np.uint32(self.special[piece]).tobytes())
            elif PLAIN.fullmatch(piece):
                out += map(self.__getitem__, self.words.findall(piece.lower()))
            else:
                found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
                out += [self._cut(word) for word, _ in found]
        return b"".join(out)

    def __missing__(self, word: str) -> bytes:
        found = self._cut(word if word.isascii() and word.isalnum() else self._written(word))
        if len(word) <= LONGEST:
            if self.held >= REMEMBERED:
                self.clear()
                self.held = 0
            self.held += len(word) + len(found) + ENTRY
            self[word] = found
        return found

    def _written(self, word: str) -> str:
        """The word's bytes as the vocabulary writes them."""
        return "".join([self.signs[c] for c in word])

    def _cut(self, word: str) -> bytes:
        inside = self.inside
        cuts = [i for i, pair in enumerate(map(add, word, word[1:]), 1) if pair not in inside]
        if not cuts:
            return self._encoded(word, True)
        parts = [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]
        return b"".join([*(self._fragment(part) for part in parts[:-1]), self._encoded(parts[-1], True)])

    def _fragment(self, fragment: str) -> bytes:
        """Ids of a fragment that does not end its word; these are few and come again and again."""
        known = self.inner.get(fragment)
        if known is None:
            known = self._encoded(fragment, False)
            if len(fragment) <= LONGEST:
                if len(self.inner) * (ENTRY + 2 * LONGEST) >= REMEMBERED:
                    self.inner.clear()
                self.inner[fragment] = known
        return known

    def _encoded(self, fragment: str, last: bool) -> bytes:
        symbols = self._merged([*fragment[:-1], fragment[-1] + WORD_END * last])
        return pack(f"<{len(symbols)}I", *map(self.vocabulary.__getitem__, symbols))

    def _merged(self, symbols: list[str]) -> list[str]:
        """The lowest merge first, the leftmost of equals, until none applies."""
        if len(symbols) > MANY:
            return self._merged_by_heap(symbols)
        rank, none = self.rank, len(self.rank)
        ranks = [rank.get(pair, none) for pair in zip(symbols, symbols[1:])]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank.get((symbols[at - 1], symbols[at]), none)
            if at < len(ranks):
                ranks[at] = rank.get((symbols[at], symbols[at + 1]), none)
        return symbols

    def _merged_by_heap(self, symbols: list[str]) -> list[str]:
        """The same in n log n: symbols linked to their neighbours, pairs waiting by rank and place."""
        rank, n = self.rank, len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        waiting = [(rank[pair], at, pair) for at, pair in enumerate(zip(symbols, symbols[1:])) if pair in rank]
        heapify(waiting)
        while waiting:
            _, at, pair = heappop(waiting)
            follower = after[at]
            if follower == n or (symbols[at], symbols[follower]) != pair:
                continue  # one of the two has been merged meanwhile
            symbols[at], symbols[follower] = symbols[at] + symbols[follower], ""
            after[at] = after[follower]
            if after[at] < n:
                before[after[at]] = at
            for left in (before[at], at):
                if left >= 0 and after[left] < n and (pair := (symbols[left], symbols[after[left]])) in rank:
                    heappush(waiting, (rank[pair], left, pair))
        return [s for s in symbols if s]


@lru_cache(maxsize=2)
def fragments(source: str) -> Fragments:
    """One for a Python worker: what a task has encoded helps the next."""
    return Fragments(source)


def share_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file at ``path`` on the driver, for all executors. Its size is fixed (about 2 MB)."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with ``ids``: the text's token ids as packed little-endian unsigned 32-bit numbers.

    Ids equal those of the tokenizers library for the same file, with special tokens recognised in the text
    and none added. Null and empty texts give empty ids. Texts of any length are encoded whole, in one pass and
    without a shuffle. A column named like ``ids`` is replaced; other columns pass through.
    """
    small_batches(df.sparkSession)
    source = share_vocabulary(df.sparkSession, path)

    @F.arrow_udf("binary")
    def packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = fragments(source.value)
        for batch in batches:
            yield pa.array([known.ids(t or "") for t in batch.to_pylist()], pa.binary())

    return df.withColumn(ids, packed(F.col(text)))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with ``text``: the tokens of packed ``ids``, as the library's decode gives them for a file without decoder.

    Tokens are joined by spaces, special ones kept. Null and empty ids give an empty text; ids outside the
    vocabulary are left out, as the library does.
    """
    small_batches(df.sparkSession)
    source = share_vocabulary(df.sparkSession, path)

    @F.arrow_udf("string")
    def joined(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        library = Tokenizer.from_str(source.value)
        token = {i: t for t, i in library.get_vocab(with_added_tokens=True).items()}
        for batch in batches:
            rows = (np.frombuffer(x or b"", dtype="<u4").tolist() for x in batch.to_pylist())
            yield pa.array([" ".join([token[i] for i in row if i in token]) for row in rows], pa.string())

    return df.withColumn(text, joined(F.col(ids)))
