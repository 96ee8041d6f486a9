"""Spans found in texts: their type, order, digests and removal."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:int,end:int>"
SPANS = f"array<{SPAN}>"
ARROW_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def ordered(spans: list[tuple[str, int, int]], kinds: list[str]) -> list[dict]:
    """Spans by start, then by the place of their kind in ``kinds``, then by end."""
    place = {k: i for i, k in enumerate(kinds)}
    return [{"kind": k, "start": s, "end": e} for k, s, e in sorted(spans, key=lambda x: (x[1], place[x[0]], x[2]))]


def written(spans: Column) -> Column:
    """The spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame, kinds: list[str], spans: str = "spans") -> list[Column]:
    """Counts of the base kinds, the digest of the base spans and all spans in writing."""
    all_spans = F.col(spans)
    base = F.filter(all_spans, lambda s: s["kind"].isin(kinds))

    def count(kind: str) -> Column:
        return F.size(F.filter(all_spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in kinds]
    return [*counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(all_spans).alias("spans")]


def masked(text: Column, spans: Column) -> Column:
    """The text with every span (overlapping ones as one) replaced by ``[KIND]`` of the first."""

    @F.arrow_udf("string")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, found in batches:
            out = []
            for t, each in zip(texts.to_pylist(), found.to_pylist()):
                if t and each:
                    parts, at = [], 0
                    for s in sorted(each, key=lambda s: (s["start"], -s["end"])):
                        if s["start"] >= at:
                            parts += [t[at:s["start"]], f"[{s['kind'].upper()}]"]
                        at = max(at, s["end"])
                    t = "".join([*parts, t[at:]])
                out.append(t)
            yield pa.array(out, pa.string())

    return cut(text, spans)
