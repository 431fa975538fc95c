"""Token counts by a public tokenizer's rank file."""

from __future__ import annotations

import base64
import re
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CUT = 1_000_000  # longer texts are encoded in parts of about so many characters, which changes no count
# Where the pattern never joins two sides: before a single space or line end between word signs, and between a letter and wide punctuation.
_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{50000,}")
_SEAM = re.compile(r"(?<=\w)(?=[ \n]\w)|(?<=[^\W\d_])(?=[。，、！？；：])")


def has_content(c: Column | str) -> Column:
    """Neither null nor blank, whatever kind of space."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & c.rlike(r"(?U)\S")


def encoder(raw: bytes):
    """The encoder of a rank file, made once a worker process."""
    import tiktoken

    kept = sys.__dict__.setdefault("_weftline_encoders", {})
    k = (len(raw), hash(raw))
    if k not in kept:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        kept[k] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[k]


def counter(raw: bytes) -> Callable[[str], int]:
    enc = encoder(raw)

    def count(t: str) -> int:
        return sum(len(enc.encode_ordinary(x)) if plain else len(enc._encode_single_piece(x)) for plain, x in parts(t))

    return count


def parts(t: str) -> Iterator[tuple[bool, str]]:
    """(whether to apply the pattern, text): parts that are tokenized as in the whole.

    A part ends at the first seam behind ``CUT`` characters, if there is one. Very long runs of white
    space, on which the pattern's look-ahead would fail, are pieces by themselves, but for their last
    character where more text follows, as the pattern has it.
    """
    at = 0
    while at < len(t):
        seam = _SEAM.search(t, at + CUT) if len(t) - at > CUT else None
        end = seam.start() if seam else len(t)
        for run in _RUN.finditer(t, at, end):
            stop = run.end() - (run.end() < len(t))
            yield True, t[at : run.start()]
            yield False, t[run.start() : stop]
            at = stop
        yield True, t[at:end]
        at = end


def token_counts(df: DataFrame, id_column: str, text: str, *keep: str, ranks: str = RANKS) -> DataFrame:
    """(id, kept columns, tokens) of every row whose text has content; null and blank texts are left out.

    The rank file is read by the driver and broadcast (some 800 kB), so executors need no copy.
    """
    with open(ranks, "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())
    rows = df.select(id_column, *keep, F.col(text).alias("_text")).filter(has_content("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text") + ", tokens int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(raw.value)
        for b in batches:
            *cols, texts = b.columns
            n = [count(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int32())], names=[*b.schema.names[:-1], "tokens"])

    return rows.mapInArrow(run, schema)
