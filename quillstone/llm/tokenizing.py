"""Token ids of a whole corpus by a public byte-level BPE vocabulary.

Method: the tiktoken library with a local rank file. A long text is cut beforehand at boundaries
where the pre-splitting pattern cuts anyway, so that no call works on an unbounded piece, and the
ids of the parts are those of the whole. Ids decode to raw bytes (``decode_bytes``), of which the
text is the UTF-8 reading, whatever ids stand beside each other.

Null and empty texts have no tokens: their ids are an empty list, not null. Special tokens are
never produced; their strings in a text are ordinary text.

Scale: one narrow map over (id, text); the vocabulary is loaded once per Python worker from the
path given, which must exist on every node. No shuffle, unless the input has too few partitions.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.session import spread

LONG = 20_000
# The pattern always begins a piece at a single space between two characters that are no space, and
# at a full-width mark after a letter or digit.
_SAFE = re.compile(r"(?<=\S) (?=\S)|(?<=[^\W_])(?=[。、，！？])")


def vocabulary_path(name: str = "byte_bpe_50k") -> str:
    """Path of a rank file of the installed public vocabularies."""
    import public_tokenizers

    return str(public_tokenizers.path(f"{name}.tiktoken"))


@lru_cache(maxsize=4)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, size: int = LONG) -> list[str]:
    """``text`` cut at safe boundaries into parts of about ``size``; a part without one stays whole."""
    if len(text) <= size:
        return [text]
    parts, at = [], 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if not m:
            break
        parts.append(text[at : m.start()])
        at = m.start()
    return parts + [text[at:]]


def encode_text(enc, text: str | None) -> list[int]:
    if not text:
        return []
    if len(text) <= LONG:
        return enc.encode_ordinary(text)
    return [i for part in safe_parts(text) for i in enc.encode_ordinary(part)]


def _mapped(df: DataFrame, keep: Sequence[str], text: str, path: str | None, out: str, kind: str, arrow: pa.DataType, value) -> DataFrame:
    """``keep`` columns and ``out``, which is ``value(ids)`` of each text."""
    where = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(where)
        for batch in batches:
            last = batch.num_columns - 1
            made = pa.array([value(encode_text(enc, t)) for t in batch.column(last).to_pylist()], arrow)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(last)), made], names=[*names, "made"])

    names = [f"c{i}" for i in range(len(keep))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text).cast("string").alias("text"))
    rows = spread(rows)
    schema = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for c, n in zip(keep, names))
    done = rows.mapInArrow(run, f"{schema}, made {kind}")
    return done.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], F.col("made").alias(out))


def encode_corpus(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """Rows ``<key>, ids`` for every row of ``df``; repeated rows stay repeated."""
    return _mapped(df, [key], text, path, "ids", "array<int>", pa.list_(pa.int32()), lambda ids: ids)


def count_tokens(df: DataFrame, keep: Sequence[str], text: str, path: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``; the ids never leave the Python worker."""
    return _mapped(df, keep, text, path, "n_tokens", "long", pa.int64(), len)


def decode_ids(df: DataFrame, key: str, ids: str, path: str | None = None) -> DataFrame:
    """Rows ``<key>, raw`` with the bytes that the ids stand for."""
    where, kind = path or vocabulary_path(), df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(where)
        for batch in batches:
            raw = [enc.decode_bytes(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["key", "raw"])

    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, raw binary").withColumnRenamed("key", key)
