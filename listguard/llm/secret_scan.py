"""Secret scans: patterns, and novelty against surrounding code and an identifier dictionary."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listguard.llm import spans
from listguard.llm.batches import small_batches
from listguard.llm.rows import quoted
from listguard.llm.scratch import stage

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "novel"]

# The base patterns.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are whole, so shorter ones need no match

#: Words after which a string may be a secret. Each starts with one of OPENINGS.
SENSITIVE = re.compile(r"passw|passphrase|pwd|secret|token|api[\x20_-]?key|auth|bearer|credential|private[\x20_-]?key|access[\x20_-]?key|signature",
                       re.I | re.A)
OPENINGS = ("passw", "passphrase", "pwd", "secret", "token", "api", "auth", "bearer", "credential", "private", "access",
            "signature")
LEAST, GAP = 16, 64
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
#: What may stand between candidates that follow each other (lines of a block, parts joined by dots or in
#: quotes), and the short last part of such a row: after a dot, or before the line that ends a block.
BETWEEN = re.compile(r"""[\s.,:;+"'\\]{1,%d}""" % GAP)
LAST = re.compile(r"""\.[A-Za-z0-9+/_=-]+|\s+[A-Za-z0-9+/_=]+(?=\s*-----END)""")
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]{3,63}"

#: Characters after a sensitive word in which candidates start, and those of the surroundings.
REACH = 64
AROUND = 256
#: Identifiers in the dictionary: the most frequent around candidates, a bounded model.
IDENTIFIERS = 4096
#: Marginal compressed bytes per character from which a string is new to its surroundings.
NOVELTY = 0.6

ARROW_SCAN = pa.struct([
    ("spans", pa.list_(spans.ARROW_SPAN)),
    ("candidates", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("before", pa.string()),
                                       ("value", pa.string()), ("after", pa.string())])))])
SCAN = ("struct<spans:" + spans.SPANS + ",candidates:array<struct<start:int,end:int,before:string,value:string,"
        "after:string>>>")


def base_spans(text: str, lowered: str) -> list[tuple[str, int, int]]:
    found = []
    if any(w in lowered for w in ("passw", "secret", "token", "api")):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def candidates(text: str, lowered: str, taken: list[tuple[str, int, int]]) -> list[dict]:
    """Strings of letters and digits after a sensitive word, outside the base spans.

    They start within REACH of the word or follow the candidate before them, however long the row is.
    """
    if not any(w in lowered for w in OPENINGS):
        return []
    out, at, starts = [], 0, sorted(s for _, s, _ in taken)
    ends = list(accumulate((e for _, _, e in sorted(taken, key=lambda x: x[1])), max))  # the last end so far

    def add(start: int, end: int, follows: bool = False) -> None:
        value = text[start:end]
        letters, turns = any(c.isalpha() for c in value), sum(a.islower() and b.isupper() for a, b in zip(value, value[1:]))
        mixed = letters and (follows or any(c.isdigit() for c in value) or turns * 6 > len(value))
        earlier = bisect_left(starts, end)
        if mixed and not (earlier and ends[earlier - 1] > start):
            out.append({"start": start, "end": end, "before": text[max(0, start - AROUND):start],
                        "value": value, "after": text[end:end + AROUND]})

    for word in SENSITIVE.finditer(text):
        reach = word.end() + REACH
        while True:
            # Nothing is looked for beyond the places where a candidate may start and its least length.
            last_start = max(reach, at + GAP) if at > word.start() else reach
            start = CANDIDATE.search(text, max(word.end(), at), last_start + LEAST)
            if start is None:
                break
            start = start.start()
            if start > reach and not BETWEEN.fullmatch(text, at, start):
                break
            at = CANDIDATE.match(text, start).end()
            add(start, at)
            while out and out[-1]["end"] == at and (last := LAST.match(text, at)):
                start = at + len(last[0]) - len(last[0].lstrip().removeprefix("."))
                at = last.end()
                add(start, at, follows=True)
    return out


def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        out = []
        for text in batch.to_pylist():
            text = text or ""
            lowered = text.lower()
            base = base_spans(text, lowered)
            out.append({"spans": spans.ordered(base, KINDS), "candidates": candidates(text, lowered, base)})
        yield pa.array(out, ARROW_SCAN)


def identifier_dictionary(scans: DataFrame) -> bytes:
    """The IDENTIFIERS most frequent identifiers around all candidates, the most frequent last.

    Counted over every document; at most IDENTIFIERS words of 64 characters reach the driver.
    """
    around = scans.select(F.explode("__scan.candidates").alias("c")).select(F.explode(F.flatten(F.array(
        *[F.regexp_extract_all(F.col(f"c.{side}"), F.lit(f"({IDENTIFIER})"), F.lit(1)) for side in ("before", "after")]
    ))).alias("name"))
    top = (around.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(IDENTIFIERS))
    return " ".join(r["name"] for r in reversed(top.collect())).encode()


class Novelty:
    """Marginal compressed bytes per character of a string after what stands around it."""

    def __init__(self, dictionary: bytes) -> None:
        settings = zstandard.ZstdCompressionParameters.from_level(9, write_content_size=0, write_checksum=0,
                                                                  write_dict_id=0)
        primed = {}
        if len(dictionary) >= 8:
            primed["dict_data"] = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(compression_params=settings, **primed)

    def of(self, before: str, value: str, after: str) -> float:
        around = (after + "\n" + before).encode()
        extra = len(self.compressor.compress(around + value.encode())) - len(self.compressor.compress(around))
        return extra / len(value)


def find_secrets(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``df`` (all by default) with ``secrets``: spans by start, in code points.

    Base kinds: ``assign`` (a named value of 6 characters or more), ``access`` (key ids of 20 or more),
    ``hex`` (runs of 24 or more). ``novel`` spans are strings of letters and digits shortly after a
    sensitive word whose marginal compressed bytes, after the surrounding text and primed with the
    corpus's identifiers, reach NOVELTY per character: neither the surroundings nor known identifiers
    explain them. They never overlap base spans.

    Null texts count as empty and have no spans. Texts are scanned whole, once. Repeated rows get the
    same spans; an empty table stays empty; a column named secrets is replaced. Between the scan and the
    novelty test the kept columns and the few candidates are written to the shared folder.
    """
    small_batches(df.sparkSession)
    names = [c for c in (keep or df.columns) if c.lower() != "secrets"]
    packed = df.select(F.struct(*[F.col(quoted(c)) for c in names]).alias("__in"), F.arrow_udf(scanned, SCAN)(F.col(text)).alias("__scan"))
    scans = stage(packed, "scans")
    dictionary = df.sparkSession.sparkContext.broadcast(identifier_dictionary(scans))

    @F.arrow_udf(spans.SPANS)
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        novelty = Novelty(dictionary.value)
        for batch in batches:
            out = []
            for scan in batch.to_pylist():
                found = [(s["kind"], s["start"], s["end"]) for s in scan["spans"]]
                before = False  # the short last part of a row is judged by the candidate before it as well
                for c in scan["candidates"]:
                    before = ((before or len(c["value"]) >= LEAST)
                              and novelty.of(c["before"], c["value"], c["after"]) >= NOVELTY)
                    if before:
                        found.append(("novel", c["start"], c["end"]))
                out.append(spans.ordered(found, KINDS))
            yield pa.array(out, pa.list_(spans.ARROW_SPAN))

    return scans.select(*[F.col("__in").getField(c).alias(c) for c in names], judged(F.col("__scan")).alias("secrets"))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every secret of ``text`` replaced by its kind in brackets; clean texts stay as they are."""
    found = find_secrets(df.withColumnRenamed("secrets", "__secrets"), text)
    out = found.withColumn(text, spans.masked(F.col(text), F.col("secrets"))).drop("secrets")
    return out.withColumnRenamed("__secrets", "secrets").select(*df.columns)
