"""Personal data: patterns, and a skip-chain conditional random field over numbers and addresses."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listguard.llm import spans
from listguard.llm.batches import small_batches
from listguard.llm.rows import quoted
from listguard.llm.scratch import stage

BASE = ["email", "ip", "card", "phone"]
#: Label 0 is no entity. Spans that the field adds have kinds of their own.
LABELS = ["", *BASE]
KINDS = [*BASE, *(f"linked_{k}" for k in BASE)]

# The base patterns. A match never starts inside a run of digits, so (?<![0-9]) changes
# no match and keeps long runs from being tried at every digit.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Buckets of token features, smoothing of counts, rounds of messages, and the least probability of a span.
BUCKETS = 4096
SMOOTHING = 1.0
ROUNDS = 12
CERTAIN = 0.5
#: Tokens further apart than this many characters are no neighbours in the chain.
NEAR = 3
#: Pair potentials stay within this many nats.
BOUND = 4.0

TOKEN = "struct<start:int,end:int,label:int,shape:int,context:int,key:bigint,near:boolean,alike:int>"
ARROW_TOKEN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.int32()), ("shape", pa.int32()),
                         ("context", pa.int32()), ("key", pa.int64()), ("near", pa.bool_()), ("alike", pa.int32())])


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[str, int, int]]:
    """Leftmost non-overlapping addresses, found from each @ outwards in linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        start = at
        if domain:
            while start > end and text[start - 1] in LOCAL:
                start -= 1
        if start < at:
            end = domain.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = list(emails(text))
    found += [("ip", *m.span()) for m in IP.finditer(text)
              if all(len(part := p.lstrip("0")) <= 3 and int(part or "0") <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
    return found


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


SPACE = frozenset(" \t\n\x0b\x0c\r")
STARTS = re.compile("[0-9@]")
WHITE = re.compile("[\x20\x09-\x0D]")
BEFORE = re.compile(r"([^\x20\x09-\x0D]{1,24})[\x20\x09-\x0D]*$")


def tokens(text: str, found: list[tuple[str, int, int]]) -> list[dict]:
    """The words that hold a digit or @, with label, features and links.

    ``near`` links a token with the one before it, ``alike`` is the place of the last token with the
    same key (-1: none): the last seven digits of a number, the part before @, else the word.
    """
    base = sorted((s, e, LABELS.index(k)) for k, s, e in found)
    out, last, at, b = [], {}, 0, 0
    while m := STARTS.search(text, at):
        start = m.start()
        while start > at and text[start - 1] not in SPACE:
            start -= 1
        stop = WHITE.search(text, m.end())
        at = stop.start() if stop else len(text)
        word = text[start:at]
        left = len(word) - len(word.lstrip("([{<\"'*#$%&!|,;:"))
        end = start + len(word.rstrip(")]}>\"'*#$%&!|,;:.?"))
        start = min(start + left, end)
        word = text[start:end]
        if not word:
            continue
        while b < len(base) and base[b][1] <= start:
            b += 1
        label = next((k for s, e, k in base[b:b + 4] if s < end and start < e), 0)
        digits = re.sub("[^0-9]", "", word)
        key = digits[-7:] if len(digits) >= 7 else word.partition("@")[0].lower() if "@" in word else word.lower()
        key = xxhash.xxh64_intdigest(key.encode()) >> 1
        valid = luhn(digits) if 12 <= len(digits) <= 19 else not any(len(p) > 3 or int(p) > 255
                                                                      for p in re.findall("[0-9]+", word[:64]))
        shape = re.sub("[A-Za-z]+", "a", re.sub("[0-9]", "9", word[:64])) + f" {len(digits)} {valid}"
        before = BEFORE.search(text[max(0, start - 32):start])
        out.append({"start": start, "end": end, "label": label, "shape": bucket("s" + shape),
                    "context": bucket("c" + (before[1].lower() if before else "")), "key": key,
                    "near": bool(out) and start - out[-1]["end"] <= NEAR, "alike": last.get(key, -1)})
        last[key] = len(out) - 1
    return out


def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([("spans", pa.list_(spans.ARROW_SPAN)), ("tokens", pa.list_(ARROW_TOKEN))])
    for batch in batches:
        out = []
        for text in batch.to_pylist():
            text = text or ""
            base = base_spans(text)
            out.append({"spans": spans.ordered(base, KINDS), "tokens": tokens(text, base)})
        yield pa.array(out, kind)


class Field:
    """Log potentials of the field, from counts over the whole corpus (piecewise training).

    Each potential is the smoothed log ratio of what was seen together to what chance would give.
    """

    def __init__(self, counts: dict[tuple[str, int, int], int]) -> None:
        n = len(LABELS)
        shape, context = np.zeros((BUCKETS, n)), np.zeros((BUCKETS, n))
        pairs = {"near": np.zeros((n, n)), "alike": np.zeros((n, n))}
        for (what, a, b), c in counts.items():
            table = {"shape": shape, "context": context, **pairs}[what]
            table[a, b] += c
        prior = shape.sum(0) + SMOOTHING
        prior /= prior.sum()
        self.prior = np.log(prior)

        def ratios(table: np.ndarray) -> np.ndarray:
            return np.log((table + SMOOTHING * prior) / (table.sum(1, keepdims=True) + SMOOTHING)) - self.prior

        self.shape, self.context = ratios(shape), ratios(context)
        self.pairs = {}
        for what, table in pairs.items():
            both = table + table.T
            lift = np.log((both + SMOOTHING * prior) / (both.sum(1, keepdims=True) + SMOOTHING)) - self.prior
            self.pairs[what] = np.clip((lift + lift.T) / 2, -BOUND, BOUND)

    def marginals(self, shape: np.ndarray, context: np.ndarray, label: np.ndarray, i: np.ndarray, j: np.ndarray,
                  alike: np.ndarray) -> np.ndarray:
        """Label probabilities of each token by loopy belief propagation over the edges (i, j).

        Tokens of base spans are observed. Messages are damped and run for ROUNDS rounds.
        """
        n = len(LABELS)
        node = self.prior + (self.shape[shape] + self.context[context]) / 2
        seen = label > 0
        node[seen] = -50.0
        node[seen, label[seen]] = 0.0
        pot = np.where(alike[:, None, None], self.pairs["alike"], self.pairs["near"])
        forth, back = np.zeros((len(i), n)), np.zeros((len(i), n))

        def summed(x: np.ndarray, axis: int) -> np.ndarray:
            top = x.max(axis=axis, keepdims=True)
            out = np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)
            return out - out.max(axis=1, keepdims=True)

        for round_ in range(ROUNDS + 1):
            belief = node.copy()
            np.add.at(belief, j, forth)
            np.add.at(belief, i, back)
            if round_ == ROUNDS or not len(i):
                break
            to_j = summed((belief[i] - back)[:, :, None] + pot, 1)
            to_i = summed((belief[j] - forth)[:, None, :] + pot, 2)
            forth, back = (forth + to_j) / 2, (back + to_i) / 2
        belief = np.exp(belief - belief.max(axis=1, keepdims=True))
        return belief / belief.sum(axis=1, keepdims=True)


def label_counts(scans: DataFrame) -> dict[tuple[str, int, int], int]:
    """What the field is trained on, over every document: at most (2 BUCKETS + 2 labels) x labels counts."""
    placed = scans.select(F.col("__scan.tokens").alias("ts")).where(F.size("ts") > 0)
    each = placed.select("ts", F.posexplode("ts").alias("at", "t"))
    prev = F.try_element_at("ts", F.col("at"))["label"]
    like = F.try_element_at("ts", F.col("t.alike") + 1)["label"]

    def seen(what: str, a, b):
        return F.struct(F.lit(what).alias("what"), a.cast("int").alias("a"), b.cast("int").alias("b"))

    label = F.col("t.label")
    facts = each.select(F.explode(F.array(
        seen("shape", F.col("t.shape"), label), seen("context", F.col("t.context"), label),
        F.when(F.col("t.near") & (F.col("at") > 0), seen("near", prev, label)),
        F.when(F.col("t.alike") >= 0, seen("alike", like, label)))).alias("f")).where("f is not null")
    rows = facts.groupBy("f.what", "f.a", "f.b").agg(F.count(F.lit(1)).alias("n")).collect()
    return {(r["what"], r["a"], r["b"]): r["n"] for r in rows}


def added(field: Field, rows: list[list[dict]]) -> list[list[tuple[str, int, int]]]:
    """The spans that the field adds to each text; the texts' graphs are solved side by side."""
    flat = [t for ts in rows for t in ts]
    if not flat:
        return [[] for _ in rows]
    i, j, alike, first = [], [], [], 0
    for ts in rows:
        for k, t in enumerate(ts):
            if t["near"]:
                i.append(first + k - 1), j.append(first + k), alike.append(False)
            if t["alike"] >= 0:
                i.append(first + t["alike"]), j.append(first + k), alike.append(True)
        first += len(ts)
    column = {c: np.array([t[c] for t in flat], dtype=np.int64) for c in ("shape", "context", "label")}
    p = field.marginals(column["shape"], column["context"], column["label"], np.array(i, dtype=np.int64),
                        np.array(j, dtype=np.int64), np.array(alike, dtype=bool))
    best = np.where((p.max(axis=1) >= CERTAIN) & (column["label"] == 0), p.argmax(axis=1), 0).tolist()
    out, first = [], 0
    for ts in rows:
        new: list[tuple[str, int, int]] = []
        for k, t in enumerate(ts):
            if kind := best[first + k]:
                name = f"linked_{LABELS[kind]}"
                if new and t["near"] and best[first + k - 1] == kind:
                    new[-1] = (name, new[-1][1], t["end"])
                else:
                    new.append((name, t["start"], t["end"]))
        out.append(new)
        first += len(ts)
    return out


def find_personal_data(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``df`` (all by default) with ``personal``: spans by start, in code points.

    Base kinds: ``email``, ``ip``, ``card``, ``phone`` by pattern. Words with digits or @ are the tokens of a
    skip-chain field: neighbours are linked, and so are distant tokens of the same number ending or the
    same name before @. Its potentials come from label counts over the whole corpus, tokens of base spans
    are observed, and loopy messages carry their labels along the links. Tokens outside base spans that
    end up as an entity with CERTAIN or more become spans of kind ``linked_...``, so that a number given
    in full once is also found where it stands without its prefix.

    Null texts count as empty and have no spans. Texts are scanned whole, once; each token links back to one
    alike, so links grow with the tokens. Repeated rows get the same spans; an empty table stays empty; a
    column named personal is replaced. Between scan and inference the kept columns and the tokens are
    written to the shared folder.
    """
    small_batches(df.sparkSession)
    names = [c for c in (keep or df.columns) if c.lower() != "personal"]
    scan = F.arrow_udf(scanned, f"struct<spans:{spans.SPANS},tokens:array<{TOKEN}>>")
    scans = stage(df.select(F.struct(*[F.col(quoted(c)) for c in names]).alias("__in"), scan(F.col(text)).alias("__scan")),
                  "scans")
    counts = df.sparkSession.sparkContext.broadcast(label_counts(scans))

    @F.arrow_udf(spans.SPANS)
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        field = Field(counts.value)
        for batch in batches:
            rows = batch.to_pylist()
            new = added(field, [r["tokens"] for r in rows])
            yield pa.array([spans.ordered([(s["kind"], s["start"], s["end"]) for s in r["spans"]] + more, KINDS)
                            for r, more in zip(rows, new)], pa.list_(spans.ARROW_SPAN))

    return scans.select(*[F.col("__in").getField(c).alias(c) for c in names], judged(F.col("__scan")).alias("personal"))
