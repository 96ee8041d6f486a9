"""Ranked lexical search: exact top documents by per-term lists of geometric blocks."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listguard.llm.batches import byte_batches
from listguard.llm.scratch import stage

#: Slots of the filter of wanted terms: its size is fixed, whatever the number of items.
SLOTS = 1 << 20
#: Postings and documents that a task indexes together, and documents in a block on average.
POSTINGS = 1 << 20
DOCUMENTS = 1 << 13
BLOCK = 8
#: Places of a document's sketch, by which the documents of a list are clustered.
SKETCH = 64
#: Terms of the items that are searched together, and documents tried for first scores by term.
TOGETHER = 1 << 18
TRIED_TERMS, TRIED = 4, 16

#: Bytes of UTF-8: ASCII letters (lower-cased) and digits and all bytes beyond ASCII belong to terms, all else parts them.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    """The maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z in lower case, as UTF-8."""
    return text.encode().translate(TERMS).split()


def slots_of(items: DataFrame, text: str) -> bytes:
    """A byte per slot: whether some item's term falls into it."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for whole in batch[0].to_pylist():
                seen.update(zlib.crc32(t) % SLOTS for t in set(terms(whole or "")))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.int32())], names=["slot"])

    wanted = bytearray(SLOTS)
    for row in items.select(text).mapInArrow(found, "slot int").distinct().toLocalIterator():  # at most SLOTS rows
        wanted[row.slot] = 1
    return bytes(wanted)


def vectors(docs: DataFrame, doc_id: str, text: str, wanted: bytes) -> DataFrame:
    """(doc_id, n, terms, tfs) of the documents that have a term: ``n`` counts all, the arrays hold the wanted."""
    schema = docs.select(F.col(doc_id).alias("doc_id"), F.lit(0).cast("long").alias("n"),
                         F.array(F.lit(b"")).alias("terms"), F.array(F.lit(0).cast("long")).alias("tfs")).schema
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, cut = shared.value, zlib.crc32
        for batch in batches:
            kept, lengths, offsets, names, times = [], [], [0], [], []
            for row, whole in enumerate(batch["__text"].to_pylist()):
                if whole and (all_terms := terms(whole)):
                    found = {t: tf for t, tf in Counter(all_terms).items() if inside[cut(t) % SLOTS]}
                    kept.append(row)
                    lengths.append(len(all_terms))
                    names += found.keys()
                    times += found.values()
                    offsets.append(len(names))
            places = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(kept, pa.int32())), pa.array(lengths, pa.int64()),
                 pa.ListArray.from_arrays(places, pa.array(names, pa.binary())),
                 pa.ListArray.from_arrays(places, pa.array(times, pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    byte_batches(docs.sparkSession)
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    return read.mapInArrow(counted, schema)


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, item_id, term, times): different items (id and text), numbered by hash, with their terms."""
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("term", pa.binary()), ("times", pa.int64())])
        for batch in batches:
            yield pa.array([[{"term": t, "times": n} for t, n in Counter(terms(whole or "")).items()]
                            for whole in batch.to_pylist()], pa.list_(kind))

    distinct = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).distinct()
    split = F.arrow_udf(counted, "array<struct<term:binary,times:bigint>>")(F.col("text"))
    # Two hashes of 64 bits name an item: its text need not travel on.
    name = F.concat_ws(":", F.xxhash64("item_id", "text"), F.xxhash64(F.lit(7), "text", "item_id"))
    return distinct.select(name.alias("item"), "item_id", F.explode(split).alias("t")).select(
        "item", "item_id", "t.term", "t.times")


@dataclass
class Statistics:
    """Corpus statistics: documents that have a term, and all their terms with repeats."""

    documents: int
    total: int

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """m of documents of ``n`` terms; in Python's integers, as the product may pass 64 bits."""
        return np.array([25 + 75 * x * self.documents // self.total for x in n.tolist()], dtype=np.int64)

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


@dataclass
class Query:
    """An item: terms (numbers in its block), their weights with repeats, and the largest impact of each anywhere."""

    terms: np.ndarray
    weights: np.ndarray
    largest: np.ndarray

    def needed(self, least: int) -> np.ndarray:
        """Terms one of which any document of score ``least`` has: the others together stay below."""
        order = np.argsort(self.weights * self.largest, kind="stable")
        return self.terms[order][np.cumsum((self.weights * self.largest)[order]) >= least]


def visitors(queries: list[Query], least: list[int]) -> dict[int, np.ndarray]:
    """By needed term, all terms of the queries that need it."""
    found: dict[int, list[np.ndarray]] = {}
    for query, bound in zip(queries, least):
        for t in query.needed(bound).tolist():
            found.setdefault(t, []).append(query.terms)
    return {t: np.unique(np.concatenate(each)) for t, each in found.items()}


class Segment:
    """The index of some thousand documents: their vectors, the posting lists, and blocks of lists."""

    def __init__(self, table: pa.Table, known: pa.Array, weights: np.ndarray, statistics: Statistics) -> None:
        self.ids = table["doc_id"].combine_chunks()
        lists = table["terms"].combine_chunks()
        doc = np.repeat(np.arange(len(self.ids)), pc.list_value_length(lists).to_numpy())
        term = pc.index_in(lists.flatten(), value_set=known)
        real = pc.is_valid(term).to_numpy(zero_copy_only=False)
        tf = table["tfs"].combine_chunks().flatten().to_numpy()[real]
        self.doc, self.term = doc[real], term.drop_null().to_numpy().astype(np.int64)
        self.value = impacts(tf, statistics.lengths(table["n"].to_numpy())[self.doc])
        self.weights, self.number_of_terms, documents = weights, len(known), len(self.ids)
        self.start = np.searchsorted(self.doc, np.arange(documents + 1))
        order = np.argsort(self.term, kind="stable")
        self.posted, self.posted_value = self.doc[order], self.value[order]
        self.list_start = np.searchsorted(self.term[order], np.arange(self.number_of_terms + 1))

    def entries(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the vectors' entries, document by document, and where each document's begin."""
        length = self.start[docs + 1] - self.start[docs]
        begin = np.r_[0, np.cumsum(length)]
        return np.repeat(self.start[docs] - begin[:-1], length) + np.arange(begin[-1]), begin

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Exact scores of documents under dense term weights."""
        at, begin = self.entries(docs)
        return np.diff(np.r_[0, np.cumsum(weight[self.term[at]] * self.value[at])][begin])

    def first_tries(self, query: Query) -> np.ndarray:
        """Documents likely to score well: those of most impact in the lists of most weight."""
        best = query.terms[np.argsort(-query.weights * query.largest, kind="stable")[:TRIED_TERMS]]
        found = [np.zeros(0, dtype=np.int64)]
        for t in best:
            low, high = self.list_start[t], self.list_start[t + 1]
            top = np.argsort(-self.posted_value[low:high], kind="stable")[:TRIED]
            found.append(self.posted[low:high][top])
        return np.unique(np.concatenate(found))

    def sketches(self) -> np.ndarray:
        """Random projections of the weighted vectors, of length one: similar documents have similar sketches."""
        mixed = (self.term.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        sign = np.where(mixed >> np.uint64(63), 1.0, -1.0)
        out = np.zeros((len(self.ids), SKETCH))
        np.add.at(out, (self.doc, ((mixed >> np.uint64(40)) % np.uint64(SKETCH)).astype(np.int64)), sign * self.value * self.weights[self.term])
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def block(self, visitors: dict[int, np.ndarray]) -> None:
        """Cuts lists into blocks of similar documents, each with its summary.

        ``visitors`` names the lists, by term, and for each all terms of the items that visit it. Some documents
        of a list, evenly spaced, stand for the blocks; every document joins the one most similar. A block's
        summary holds the largest impact among its documents of every term that a visitor has, so for none of
        them a document's score passes the summary's.
        """
        sketches, sizes = self.sketches(), []
        members, summary_terms, summaries, lengths = [], [], [], []
        self.blocks_of: dict[int, tuple[int, int]] = {}
        total, wanted = 0, np.zeros(self.number_of_terms, dtype=bool)
        for t, others in visitors.items():
            docs = self.posted[self.list_start[t]:self.list_start[t + 1]]
            if not len(docs):
                continue
            number = -(-len(docs) // BLOCK)
            heads = sketches[docs[np.arange(number) * len(docs) // number]]
            nearest = (sketches[docs] @ heads.T).argmax(axis=1)
            order = np.argsort(nearest, kind="stable")
            docs, nearest = docs[order], nearest[order]
            block = np.cumsum(np.diff(nearest, prepend=nearest[0]) != 0)
            places, begin = self.entries(docs)
            wanted[others] = True
            kept = wanted[self.term[places]]
            wanted[others] = False
            key = (np.repeat(block, np.diff(begin)) * self.number_of_terms + self.term[places])[kept]
            order = np.argsort(key, kind="stable")
            key, value = key[order], self.value[places[kept]][order]
            firsts = np.flatnonzero(np.diff(key, prepend=-1))
            key, blocks = key[firsts], int(block[-1]) + 1
            members.append(docs)
            sizes.append(np.bincount(block))
            summary_terms.append(key % self.number_of_terms)
            summaries.append(np.maximum.reduceat(value, firsts))
            lengths.append(np.bincount(key // self.number_of_terms, minlength=blocks))
            self.blocks_of[t] = total, total + blocks
            total += blocks
        none = [np.zeros(0, dtype=np.int64)]
        self.members, self.member_start = np.concatenate(none + members), np.r_[0, np.cumsum(np.concatenate(none + sizes))]
        self.summary_term, self.summary = np.concatenate(none + summary_terms), np.concatenate(none + summaries)
        self.summary_start = np.r_[0, np.cumsum(np.concatenate(none + lengths))]

    def search(self, query: Query, weight: np.ndarray, least: int) -> np.ndarray:
        """Documents in blocks whose summary reaches ``least``: all documents that do are among them."""
        ranges = [self.blocks_of[t] for t in query.needed(least).tolist() if t in self.blocks_of]
        if not ranges:
            return np.zeros(0, dtype=np.int64)
        blocks = np.concatenate([np.arange(a, b) for a, b in ranges])
        length = self.summary_start[blocks + 1] - self.summary_start[blocks]
        begin = np.r_[0, np.cumsum(length)]
        places = np.repeat(self.summary_start[blocks] - begin[:-1], length) + np.arange(begin[-1])
        bound = np.diff(np.r_[0, np.cumsum(weight[self.summary_term[places]] * self.summary[places])][begin])
        open_blocks = blocks[bound >= least]
        found = [self.members[self.member_start[b]:self.member_start[b + 1]] for b in open_blocks]
        return np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *found]))


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of ``vectors`` in tables of bounded size."""
    waiting, postings, documents = [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            waiting.append(part)
            documents += part.num_rows
            postings += pc.sum(pc.list_value_length(part["terms"])).as_py() or 0
            if postings >= POSTINGS or documents >= DOCUMENTS:
                yield pa.Table.from_batches(waiting)
                waiting, postings, documents = [], 0, 0
    if documents:
        yield pa.Table.from_batches(waiting)


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each item with their rank: highest score, then smallest doc_id, null ids last."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def searched(index: DataFrame, queries: list[Query], known: dict[bytes, int], statistics: Statistics, k: int,
             least: list[int] | None) -> DataFrame:
    """(item, doc_id, score): per segment the best ``k`` documents of each item (by number).

    ``known`` has the weight of every term. Without ``least``, of a few documents tried; with it, of all that reach the item's ``least``.
    """
    shared = index.sparkSession.sparkContext.broadcast((queries, known, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, names, bounds = shared.value
        weights, names = np.array(list(names.values()), dtype=np.int64), pa.array(list(names), pa.binary())
        weight = np.zeros(len(names), dtype=np.int64)
        visited = {} if bounds is None else visitors(asked, bounds)
        for table in segments(batches):
            segment = Segment(table, names, weights, statistics)
            if bounds is not None:
                segment.block(visited)
            items, docs, scores = [], [], []
            for number, query in enumerate(asked):
                weight[query.terms] = query.weights
                bound = 1 if bounds is None else bounds[number]
                found = segment.first_tries(query) if bounds is None else segment.search(query, weight, bound)
                score = segment.scores(found, weight)
                found, score = found[score >= bound], score[score >= bound]
                weight[query.terms] = 0
                if len(found) > k:
                    ranked = pc.sort_indices(pa.table({"s": score, "d": segment.ids.take(pa.array(found))}),
                                             sort_keys=[("s", "descending"), ("d", "ascending")])[:k].to_numpy()
                    found, score = found[ranked], score[ranked]
                items += [number] * len(found)
                docs.append(found)
                scores.append(score)
            docs = np.concatenate(docs) if docs else np.zeros(0, dtype=np.int64)
            scores = np.concatenate(scores) if scores else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), segment.ids.take(pa.array(docs)),
                                              pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])

    schema = F.struct(F.lit(0).alias("item"), "doc_id", F.lit(0).cast("long").alias("score"))
    return index.mapInArrow(run, index.select(schema.alias("s")).select("s.*").schema)


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id",
           text: str = "text") -> DataFrame:
    """The ``k`` documents of highest score above 0 for each item: (item_id, rank, doc_id, score).

    A term in df of N documents weighs w = floor(1000 ln((2N + 2) / (2 df + 1))). A document of n terms, of L in all,
    has m = 25 + (75 n N div L), and scores the sum over the item's terms, repeats included, of
    w * (10^9 tf div (1000 tf + 8 m)). Equal scores rank by doc_id, null ids last.

    Documents are indexed in segments of bounded size, so a term of very many documents has a list in every segment.
    A list is cut into blocks of similar documents, each with the largest impact of every term. First scores
    of a few documents per segment give each item a score that its k-th document reaches; then lists that cannot hold
    a document of that score, and blocks whose summary stays below it, are skipped: exactly, so no document is lost.
    Items are searched in groups of about TOGETHER terms. Lists are made for terms of the items only.

    Null and empty texts have no term: such documents count nowhere, such items give no row. Texts of any length
    count whole. Repeated documents rank each for itself; repeated items (same id and text) are
    answered once, different texts of one id each by itself. Empty tables give an empty result. Other
    columns do not matter.
    """
    spark = docs.sparkSession
    index = stage(vectors(docs, doc_id, text, slots_of(items, text)), "vectors")
    counted = index.agg(F.count(F.lit(1)), F.sum("n")).first()
    statistics = Statistics(counted[0], counted[1] or 1)

    # Per term: the documents that hold it, and its largest impact.
    m = F.expr(f"25 + CAST((CAST(n AS DECIMAL(38, 0)) * {75 * statistics.documents}) div {statistics.total} AS BIGINT)")
    impact = F.expr("(1000000000 * tf) div (1000 * tf + 8 * m)")
    posted = index.select(m.alias("m"), F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select(
        "m", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))
    known = posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max(impact).alias("largest"))
    asked = item_terms(items, item_id, text)
    asked = stage(asked.join(known, "term"), "items")

    answers = None
    groups = -(-asked.count() // TOGETHER)
    for group in range(groups):
        mine = asked.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == group)
        rows = mine.groupBy("item").agg(F.first("item_id").alias("item_id"), F.collect_list(
            F.struct("term", "times", "df", "largest")).alias("terms")).orderBy("item").collect()
        weight = {bytes(x.term): statistics.weight(x.df) for row in rows for x in row.terms}
        numbers = {t: i for i, t in enumerate(weight)}
        queries = []
        for row in rows:
            used = [(numbers[t], x.times * weight[t], x.largest) for x in row.terms if weight[t := bytes(x.term)]]
            queries.append(Query(*np.array(sorted(used), dtype=np.int64).reshape(-1, 3).T.copy()))
        first = best(searched(index, queries, weight, statistics, k, None), k)
        first = first.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).collect()
        reached = {row["item"]: row["least"] for row in first if row["n"] == k}
        least = [reached.get(i, 1) for i in range(len(queries))]
        found = best(searched(index, queries, weight, statistics, k, least), k)
        names = spark.createDataFrame([(i, row.item_id) for i, row in enumerate(rows)],
                                      mine.select(F.lit(0).alias("item"), "item_id").schema)
        part = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # one group's items
        answers = part if answers is None else answers.union(part)
    if answers is None:
        shape = items.select(F.col(item_id).alias("item_id"), F.lit(0).alias("rank")).schema
        for column in docs.select(F.col(doc_id).alias("doc_id"), F.lit(0).cast("long").alias("score")).schema:
            shape = shape.add(column)
        answers = spark.createDataFrame([], shape)
    return answers


#: DuckDB SQL for whole tables: every score by joins.
SQL = r"""
WITH words AS (
  SELECT rowid AS r, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
postings AS (SELECT r, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT r, count(*) AS n FROM words GROUP BY r),
total AS (SELECT count(*) AS all_docs, sum(n)::BIGINT AS all_terms FROM lengths),
measured AS (SELECT r, 25 + (75 * n * all_docs) // all_terms AS m FROM lengths, total),
frequent AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
items AS (SELECT item_id, text, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (
  SELECT i.item_id, i.text, i.term, count(*) * floor(1000 * ln((2 * any_value(t.all_docs) + 2) / (2 * any_value(f.df) + 1)))::BIGINT AS w
  FROM items i JOIN frequent f USING (term), total t GROUP BY ALL),
scored AS (
  SELECT a.item_id, a.text, p.r, any_value(p.doc_id) AS doc_id,
         sum(a.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * d.m)))::BIGINT AS score
  FROM asked a JOIN postings p USING (term) JOIN measured d ON d.r = p.r GROUP BY a.item_id, a.text, p.r),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
