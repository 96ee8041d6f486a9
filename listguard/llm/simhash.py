"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listguard.llm.batches import small_batches
from listguard.llm.graph import Stars, components
from listguard.llm.rows import quoted, row_hash, unpacked, without
from listguard.llm.scratch import stage

SEED = 42
#: Shingles hashed at a time, and rows of a signature's group that meet in one cell per side.
SHINGLES = 1 << 15
CELL = 1024
#: Shingle hashes in a sketch, and the like of CELL for groups whose sketches are compared.
SKETCH = 256
MATCHES = 256
#: Sketches rule pairs out this far below the wanted similarity: six standard errors at 0.8.
MARGIN = 0.15
#: Groups of least shingle hashes that make further candidates, and the share of pairs at ``least`` they may miss.
BANDS = 32
MISSED = 1e-5
#: Shared hashes of a cell compared at a time.
COLUMNS = 8192
#: Slots that signatures are counted in, as powers of two: one for about 256 signatures, within these bounds.
SLOT_BITS = (18, 22)


def hasher(bits: int) -> Callable[[bytes, int], bytes]:
    """XXH64 for 64 bits, XXH3 for 128."""
    return {64: xxhash.xxh64_digest, 128: xxhash.xxh3_128_digest}[bits]


def shingle_hashes(text: str, width: int, bits: int) -> Iterator[np.ndarray]:
    """Hashes of the text's word shingles as rows of bytes, SHINGLES at a time.

    A-Z count as a-z. Fewer words than ``width`` are one shingle; no words give nothing.
    """
    words = text.encode().lower().split()  # bytes: only A-Z change, only \x09-\x0D and \x20 part
    if not words:
        return
    width = min(width, len(words))
    joined, digest = b" ".join(words), hasher(bits)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    n = len(words) - width + 1
    for at in range(0, n, SHINGLES):
        some = range(at, min(at + SHINGLES, n))
        hashed = b"".join([digest(joined[starts[i]:starts[i + width] - 1], SEED) for i in some])
        yield np.frombuffer(hashed, dtype=np.uint8).reshape(-1, bits // 8)


def fingerprint(hashes: list[np.ndarray], bits: int) -> bytes:
    """The SimHash: a bit is 1 if over half the hashes have it; all zero without hashes."""
    total, n = np.zeros(bits, dtype=np.int64), 0
    for some in hashes:
        total += np.unpackbits(some, axis=1).sum(axis=0, dtype=np.int64)
        n += len(some)
    return np.packbits(total * 2 > n).tobytes()


def distinct(hashes: list[np.ndarray]) -> np.ndarray:
    """The different hashes among blocks (by their first eight bytes)."""
    every = np.concatenate(hashes)
    return every[np.unique(np.ascontiguousarray(every[:, :8]).view(np.uint64).ravel(), return_index=True)[1]]


def sketch(hashes: np.ndarray) -> bytes:
    """The SKETCH smallest 32-bit ends of the hashes, in order: of fewer shingles, all."""
    return np.unique(np.ascontiguousarray(hashes[:, 4:8]).view(np.uint32).ravel())[:SKETCH].tobytes()


def similarities(sketches: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarities of all pairs of shingle sets by their sketches; exact for sets below SKETCH.

    A full sketch knows its set up to its largest hash, any other its whole set, so two sets are compared
    up to the smaller of both limits: common hashes by products of 0/1 rows, sizes by binary search.
    """
    n = len(sketches)
    limit = np.array([x[-1] if len(x) == SKETCH else np.iinfo(np.uint32).max for x in sketches], dtype=np.uint32)
    below = np.array([np.searchsorted(x, limit, side="right") for x in sketches], dtype=np.float32)
    values, at = np.unique(np.concatenate(sketches), return_inverse=True)
    row = np.repeat(np.arange(n), [len(x) for x in sketches])
    shared = np.flatnonzero(np.bincount(at, minlength=len(values)) > 1)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    column = place[at]
    both = np.zeros((n, n), dtype=np.float32)
    for low in range(0, len(shared), COLUMNS):
        some = (column >= low) & (column < low + COLUMNS)
        has = np.zeros((n, min(COLUMNS, len(shared) - low)), dtype=np.float32)
        has[row[some], column[some] - low] = 1
        both += has @ has.T
    return both / np.maximum(below + below.T - both, 1)


def band_rows(least: float) -> int:
    """Least hashes in a band: as many as let BANDS miss no more than MISSED of the pairs at ``least``."""
    return max([r for r in range(1, 65) if (1 - least ** r) ** BANDS <= MISSED], default=1)


def bands(hashes: np.ndarray, rows: int) -> np.ndarray:
    """BANDS keys of a set of hashes: each of ``rows`` hashes least in an order of their own.

    Two sets of similarity s have a key in common with probability 1 - (1 - s ** rows) ** BANDS, long or short.
    """
    values = np.ascontiguousarray(hashes[:, :8]).view(np.uint64).ravel()
    random = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * rows), dtype=np.uint64)
    out = np.empty(BANDS * rows, dtype=np.uint64)
    for i, (mask, factor) in enumerate(zip(*random)):
        out[i] = ((values ^ mask) * (factor | np.uint64(1))).min()
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in out.reshape(BANDS, rows).T:
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def reach(bits: int, least: float) -> int:
    """Bits by which pairs of similarity ``least`` differ at most: five deviations above the mean of short texts."""
    share = min(0.5, 1.25 * np.arccos(2 * least / (1 + least)) / np.pi)
    return min(bits, int(np.ceil(bits * share + 5 * np.sqrt(bits * share * (1 - share)))))


def with_prints(df: DataFrame, text: str, width: int, bits: int, least: float | None) -> DataFrame:
    """``df`` with ``fp``, ``sketch`` and ``bands`` (both empty if shingles count with repeats) instead of ``text``."""
    small_batches(df.sparkSession)
    rows = band_rows(least) if least is not None else 0

    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("fp", pa.binary()), ("sketch", pa.binary()), ("bands", pa.list_(pa.int64()))])
        for batch in batches:
            out = []
            for text in batch.to_pylist():
                hashes, ends, keys = list(shingle_hashes(text or "", width, bits)), b"", []
                if hashes and rows:
                    hashes = [distinct(hashes)]
                    ends, keys = sketch(hashes[0]), bands(hashes[0], rows)
                out.append({"fp": fingerprint(hashes, bits), "sketch": ends, "bands": keys})
            yield pa.array(out, kind)

    found = df.withColumn("__p", F.arrow_udf(prints, "struct<fp:binary,sketch:binary,bands:array<bigint>>")(F.col(text)))
    return found.select(*without(df, text), "__p.fp", "__p.sketch", "__p.bands")


def segment_bounds(bits: int, segments: int) -> list[tuple[int, int]]:
    cuts = [bits * i // segments for i in range(segments + 1)]
    return list(zip(cuts, cuts[1:]))


def signatures(prints: np.ndarray, bits: int, segments: int) -> np.ndarray:
    """One key per fingerprint and bit: the bit's number, then its segment with that bit taken out."""
    unpacked_bits = np.unpackbits(prints.reshape(-1, bits // 8), axis=1)
    out = np.zeros((len(unpacked_bits), bits), dtype=np.int64)
    for low, high in segment_bounds(bits, segments):
        place = 1 << np.arange(high - low - 1, -1, -1, dtype=np.int64)
        value = unpacked_bits[:, low:high].astype(np.int64) @ place
        for b in range(low, high):
            out[:, b] = (value & ~place[b - low]) | (b << (high - low))
    return out


def whole_cells(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows as tables of whole cells (equal ``names``) with the first row of each cell.

    The rows of the last cell of a batch wait for the next batch; a cell holds two parts at most.
    """
    waiting: list[pa.RecordBatch] = []

    def changes(table: pa.Table | pa.RecordBatch) -> np.ndarray:
        differs = np.zeros(max(0, table.num_rows - 1), dtype=bool)
        for name in names:
            column = table[name]
            if isinstance(column, pa.ChunkedArray):
                column = column.combine_chunks()
            differs |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        return np.flatnonzero(differs) + 1

    def whole(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(parts)
        return table, np.r_[0, changes(table)]

    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = changes(batch)
        if waiting and any(waiting[-1][n][-1].as_py() != batch[n][0].as_py() for n in names):
            cuts = np.r_[0, cuts]
        if len(cuts):
            parts = [*waiting, batch.slice(0, int(cuts[-1]))]
            if sum(p.num_rows for p in parts):
                yield whole(parts)
            waiting = [batch.slice(int(cuts[-1]))]
        else:
            waiting.append(batch)
    if waiting:
        yield whole(waiting)


def print_rows(column: pa.Array, bits: int) -> np.ndarray:
    """Fingerprints as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), bits // 64)


def cell_links(batches: Iterator[pa.RecordBatch], bits: int, distance: int) -> Iterator[pa.RecordBatch]:
    """Links inside each signature's cells, as few stars; row by row with the next, the one after, and so on."""
    for table, starts in whole_cells(batches, ["key", "cell"]):
        column, n = table["fp"].combine_chunks(), table.num_rows
        words = print_rows(column, bits)
        ends = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n]))  # where each row's cell ends
        stars, i, lag = Stars(n), np.arange(n), 1
        while len(i := i[i + lag < ends[i]]):
            j = i + lag
            near = np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64) <= distance
            stars.add(i[near], j[near])
            lag += 1
        a, b = stars.links()
        yield pa.RecordBatch.from_arrays([column.take(pa.array(a)), column.take(pa.array(b))], names=["a", "b"])


def cell_matches(batches: Iterator[pa.RecordBatch], bits: int, least: float, first: bool) -> Iterator[pa.RecordBatch]:
    """Of each candidate group's cells, links (a, b, sure) among rows of different ``label``.

    Sure links connect what whole sketches (below SKETCH) prove similar. Others are pairs for the whole sets
    to decide: in the ``first`` round each row's best partner, afterwards every pair that sketches do not rule out.
    """
    for table, starts in whole_cells(batches, ["root", "cell"]):
        column, stars = table["fp"].combine_chunks(), Stars(table.num_rows)
        labels = print_rows(table["label"].combine_chunks(), bits)
        sketches = [np.frombuffer(x, dtype=np.uint32) for x in table["sketch"].to_pylist()]
        whole = np.array([len(x) < SKETCH for x in sketches])
        open_pairs = [np.zeros((2, 0), dtype=np.int64)]
        for low, high in zip(starts, [*starts[1:], table.num_rows]):
            of = labels[low:high]
            same = np.array([(of == row).all(axis=1) for row in of])
            like = similarities(sketches[low:high])
            known = whole[low:high, None] & whole[None, low:high]
            may = np.triu(~same, 1)
            i, j = np.nonzero(may & known & (like >= least))
            stars.add(low + i, low + j)
            may &= ~known & (like >= (least if first else least - MARGIN))
            if first:
                j = np.flatnonzero(may.any(axis=0))
                i = np.where(may, like, -1)[:, j].argmax(axis=0)
            else:
                i, j = np.nonzero(may)
            open_pairs.append(np.array([low + i, low + j]))
        a, b = stars.links()
        i, j = np.concatenate(open_pairs, axis=1)
        yield pa.RecordBatch.from_arrays([*[column.take(pa.array(np.r_[x, y])) for x, y in ((a, i), (b, j))],
                                          pa.array(np.arange(len(a) + len(i)) < len(a))], names=["a", "b", "sure"])


def in_cells(rows: DataFrame, key: str, parts, *columns: str) -> DataFrame:
    """Rows dealt to cells (``key``, ``cell``) in which every two parts of a key meet, sorted by cell."""
    mine = rows.withColumn("__parts", parts).withColumn("__mine", F.pmod(F.xxhash64("fp"), F.col("__parts")).cast("int"))
    others = F.when(F.col("__parts") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("__parts") - 1), lambda p: p != F.col("__mine")))
    dealt = mine.withColumn("__other", F.explode(others)).select(
        key, (F.least("__mine", "__other").cast("long") * (1 << 31) + F.greatest("__mine", "__other")).alias("cell"),
        *columns)
    return dealt.repartition(key, "cell").sortWithinPartitions(key, "cell")


def slot_bits(total: int) -> int:
    return min(max((total >> 8).bit_length(), SLOT_BITS[0]), SLOT_BITS[1])


def linked(prints: DataFrame, bits: int, segments: int, distance: int) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` as those at ``distance`` or less do.

    If two fingerprints differ by fewer than 2 ``segments`` bits, one segment differs by one bit at most,
    so they share the signature of that segment without that bit. Signatures meet by equality; each is
    verified. A signature in a slot of more than CELL is cut into parts by hash of the fingerprint, and every
    two parts meet in a cell of their own; cells yield spanning stars, never all pairs.
    """

    def keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            packed = np.frombuffer(b"".join(batch.to_pylist()), dtype=np.uint8)
            found = signatures(packed, bits, segments)
            offsets = np.arange(len(found) + 1, dtype=np.int32) * bits
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))

    signed = prints.select("fp", F.explode(F.arrow_udf(keys, "array<bigint>")(F.col("fp"))).alias("key"))
    return met(signed, prints.count() * bits, bits, distance)


def met(signed: DataFrame, total: int, bits: int, distance: int) -> DataFrame:
    """Links (a, b) that connect the fingerprints that share a key and differ by ``distance`` bits or less."""
    # Counts by slot of the key bound every key's count from above, whatever else falls into the slot.
    slot = F.shiftrightunsigned(F.xxhash64("key"), 64 - slot_bits(total)).cast("int")
    signed = signed.withColumn("slot", slot)
    crowds = (signed.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL)
              .select("slot", F.ceil(F.col("n") / CELL).cast("int").alias("parts")))
    crowds = F.broadcast(stage(crowds, "crowds"))  # at most 2 ** SLOT_BITS[1] lines, of crowded slots alone
    celled = in_cells(signed.join(crowds, "slot", "left"), "key", F.coalesce("parts", F.lit(1)), "fp")
    return celled.mapInArrow(lambda b: cell_links(b, bits, distance), "a binary, b binary").distinct()


def whole_sets(texts: DataFrame, wanted: DataFrame, width: int, bits: int) -> DataFrame:
    """(node, hashes): all different shingle hashes of the texts whose hash ``t`` is ``wanted`` (node, t)."""
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([np.ascontiguousarray(distinct(list(shingle_hashes(t, width, bits)))[:, :8]).view(np.int64).ravel()
                            for t in batch.to_pylist()], pa.list_(pa.int64()))

    found = texts.join(wanted.select("t").distinct(), "t", "left_semi").groupBy("t").agg(F.first("text").alias("text"))
    return found.select("t", F.arrow_udf(sets, "array<bigint>")(F.col("text")).alias("hashes")).join(wanted, "t").select("node", "hashes")


def verified(pairs: DataFrame, prints: DataFrame, texts: DataFrame, width: int, bits: int, least: float) -> DataFrame:
    """The pairs (a, b) whose whole sets of shingle hashes have the similarity ``least`` or more."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = stage(prints.join(nodes, F.col("fp") == F.col("node")).select("node", "t"), "wanted")
    sets = stage(whole_sets(texts, wanted, width, bits), "sets")
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b"))
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared / (F.size("x") + F.size("y") - shared) >= least).select("a", "b")


def matched(prints: DataFrame, roots: DataFrame, texts: DataFrame, width: int, bits: int, least: float) -> DataFrame:
    """Links (a, b) that connect what pairs of similarity ``least`` or more connect inside the groups ``roots`` (node, root).

    Sketches only rule pairs out, MARGIN below ``least``; whole sets decide. Best partners are decided first, so that
    of a large group of copies the second round meets only the pairs that are not connected yet.
    """
    members = prints.join(roots, F.col("fp") == F.col("node")).select("root", "fp", "sketch")
    crowds = (roots.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
              .select("root", F.ceil(F.col("n") / MATCHES).cast("int").alias("parts")))
    links = None
    for first in (True, False):
        if links is None:
            labelled = members.withColumn("label", F.col("fp"))
        else:
            known = components(links).select("node", F.col("root").alias("known"))
            labelled = members.join(known, F.col("fp") == F.col("node"), "left").select(
                *members.columns, F.coalesce("known", "fp").alias("label"))
        celled = in_cells(labelled.join(crowds, "root"), "root", F.col("parts"), "fp", "sketch", "label")
        found = stage(celled.mapInArrow(lambda b, first=first: cell_matches(b, bits, least, first),
                                        "a binary, b binary, sure boolean").distinct(), "pairs")
        right = found.where("sure").select("a", "b").union(
            verified(found.where("not sure").select("a", "b"), prints, texts, width, bits, least))
        links = stage(right if links is None else links.union(right), "matched")
    return links


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, bits: int = 128,
                    segments: int = 8, distance: int = 30, least: float | None = 0.8,
                    keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``df`` (all by default) with ``fingerprint`` (binary) and ``component_id``.

    Documents whose fingerprints differ by ``distance`` bits or less are candidates. All candidates are
    found if ``distance`` < 2 ``segments`` (4 of 64 bits in 3 segments); farther ones as likely as one
    segment keeps to one bit. With ``least``, documents that share one of BANDS keys of least shingle hashes are
    candidates too, so all but about MISSED of the pairs of that similarity are met, long or short. With ``least``, shingles count once each and candidates are linked if
    their Jaccard similarity reaches it, on their whole sets of shingle hashes (sketches of SKETCH hashes
    only rule pairs out, MARGIN below); with None, shingles count with repeats and candidates are links. component_id is the smallest ``doc_id`` reachable over links,
    the own included.

    Equal fingerprints are one node, so copies never meet in pairs. Null and empty texts have the zero
    fingerprint and are linked like others; rows with a null id are linked but give no component id; a component
    without any id has a null one. Repeated rows get equal results; an empty table stays empty; input
    columns named fingerprint or component_id are replaced.
    """
    names = [c for c in (keep or df.columns) if c.lower() not in ("fingerprint", "component_id")]
    narrow = df.select(F.struct(*[F.col(quoted(c)) for c in names]).alias("__in"), F.col(doc_id).alias("__id"),
                       F.xxhash64(F.col(text)).alias("__t"), F.col(text).alias("__text"))
    rows = stage(with_prints(narrow, "__text", width, bits, least), "prints")
    prints = rows.groupBy("fp").agg(F.min("__id").alias("first"), F.min(F.struct("sketch", F.col("__t").alias("t"), "bands")).alias("k"))
    prints = stage(prints.select("fp", "first", "k.*"), "distinct")
    links = linked(prints.select("fp"), bits, segments, distance)
    if least is not None:
        banded = prints.select("fp", F.explode("bands").alias("key"))
        links = links.union(met(banded, prints.count() * BANDS, bits, max(distance, reach(bits, least))))
    roots = components(links)
    if least is not None:
        texts = df.select(F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("text"))
        roots = components(matched(prints.select("fp", "sketch", "t"), roots, texts, width, bits, least))
    named = (prints.join(roots, F.col("fp") == F.col("node"), "left")
             .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = stage(named.join(smallest, "root").select(F.col("fp").alias("__fp"), "component_id"), "components")
    joined = rows.join(of_print, F.col("fp") == F.col("__fp"))
    return unpacked(joined.withColumnRenamed("fp", "fingerprint"), names, "fingerprint", "component_id")


def deduplicate(df: DataFrame, text: str = "text", doc_id: str = "doc_id", **settings) -> DataFrame:
    """``df`` with one row of each near-duplicate component: that of the smallest id.

    Of rows with that same id the one of the smallest row hash stays. Components without any id lose nothing.
    """
    rows = stage(df.select(F.monotonically_increasing_id().alias("__at"), row_hash(df).alias("__h"),
                           F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("__in")), "rows")
    flat = rows.select("__at", "__h", F.col("__in").getField(doc_id).alias("__id"), F.col("__in").getField(text).alias("__t"))
    found = near_duplicates(flat, "__t", "__id", keep=["__at", "__h", "__id"], **settings)
    best = (found.where(F.col("__id") == F.col("component_id")).groupBy("component_id")
            .agg(F.min(F.struct("__h", "__at")).alias("k")).select("k.__at"))
    nameless = found.where("component_id is null").select("__at")
    return unpacked(rows.join(best.union(nameless), "__at", "left_semi"), list(df.columns))
