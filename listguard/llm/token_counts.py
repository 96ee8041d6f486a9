"""Token counts of texts, without the tokens."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from listguard.llm.batches import byte_batches
from listguard.llm.bpe import share_vocabulary

#: Characters that a piece of a long text has at least, and bytes that are encoded together.
PIECE = 1 << 14
TOGETHER = 1 << 18
#: A place after a visible character and before a space or line break. The byte-level pattern matches from left to
#: right, no match that takes a visible character goes on into white space, and none looks back: what stands
#: on either side of such a place is cut into the same words whether or not the other side is there. No special
#: token holds white space or takes any beside it.
SAFE = re.compile(r"(?<=[\w!-~])(?=[ \n])")


def pieces(text: str) -> Iterator[str]:
    """The text in stretches of PIECE characters or more, cut at safe places alone; their tokens add up."""
    at = 0
    while len(text) - at > PIECE and (cut := SAFE.search(text, at + PIECE)):
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def groups(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Pieces with the number of their text, in groups of about TOGETHER bytes."""
    rows, group, size = [], [], 0
    for row, text in enumerate(texts):
        for piece in pieces(text or ""):
            rows.append(row)
            group.append(piece)
            size += len(piece) if piece.isascii() else len(piece.encode())
            if size >= TOGETHER:
                yield rows, group
                rows, group, size = [], [], 0
    if group:
        yield rows, group


@lru_cache(maxsize=2)
def library(source: str) -> Tokenizer:
    """One for a Python worker, single-threaded: Spark already fills the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    found = Tokenizer.from_str(source)
    found.no_truncation()
    found.no_padding()
    return found


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """``df`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of each text.

    Counts equal those of the tokenizers library for the byte-level vocabulary file at ``path``: special tokens are
    recognised in the text, none added, nothing truncated or padded. Only lengths come back from
    Python. Batches hold about equal bytes; long texts are cut at safe places and counted piece by piece, so no call
    holds more than one uncuttable stretch beyond its share.

    Null and empty texts have 0 bytes and 0 tokens. A text of any length counts whole; a stretch without a safe place
    (one very long word) stays one piece. Repeated rows count each for itself, an empty table gives an empty
    one. Columns named like a result are replaced, without regard to case; others pass through.
    """
    byte_batches(df.sparkSession)
    source = share_vocabulary(df.sparkSession, path)

    @F.arrow_udf("long")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = library(source.value)
        for batch in batches:
            counts = np.zeros(len(batch), dtype=np.int64)
            for rows, group in groups(batch.to_pylist()):
                np.add.at(counts, rows, list(map(len, known.encode_batch_fast(group, add_special_tokens=False))))
            yield pa.array(counts)

    whole = F.coalesce(F.col(text), F.lit(""))
    counted = df.withColumns({"__bytes": F.octet_length(whole).cast("long"), "__tokens": lengths(whole)})
    kept = [c for c in counted.columns if c.lower() not in ("n_bytes", "n_tokens", "over_limit", "__bytes", "__tokens")]
    return counted.select(*["`" + c.replace("`", "``") + "`" for c in kept], F.col("__bytes").alias("n_bytes"),
                          F.col("__tokens").alias("n_tokens"), (F.col("__tokens") > limit).alias("over_limit"))
