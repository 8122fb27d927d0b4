"""Problem 6: every text as its list of token ids of a public byte-level vocabulary.

Texts are read column-pruned and encoded in Arrow batches, one transducer per Python worker; no shuffle is needed
unless the scan has fewer partitions than the cluster has cores. The vocabulary (some 50,000 tokens, fixed) is read
on the driver from a path that is a parameter, and sent to the workers as a broadcast of its file's bytes.

Null and empty texts give an empty list. Ids of repeated rows are repeated; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.bpe import BpeTransducer, Utf8Machine, read_ranks
from auditlake.storage import spread

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

#: Ids after which a task hands rows on, so that long texts do not pile up.
FLUSH = 1_000_000

_machines: dict[str, BpeTransducer] = {}


def _machine(raw: bytes) -> BpeTransducer:
    """The transducer of this worker for the vocabulary file raw."""
    key = hashlib.sha1(raw).hexdigest()
    if key not in _machines:
        _machines[key] = BpeTransducer(read_ranks(raw))
    return _machines[key]


def vocabulary_file(df: DataFrame, path: str | None = None):
    """A broadcast of the bytes of the vocabulary file; its size is fixed by the vocabulary."""
    with open(path or os.path.join(TOKENIZERS, VOCABULARY), "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids): the ids of each row's text."""
    raw = vocabulary_file(df, path)
    src = spread(df.select(F.col(key).alias("_key"), F.col(text).alias("_text")))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(raw.value)
        for batch in batches:
            flat, ends, first = [], [0], 0
            for i, value in enumerate(batch.column(1).to_pylist(), 1):
                if value:
                    flat += machine.encode(value)
                ends.append(len(flat))
                if len(flat) >= FLUSH or i == batch.num_rows:
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int32)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, i - first), ids], [key, "ids"])
                    flat, ends, first = [], [0], i

    kind = df.schema[key].dataType.simpleString()
    return src.mapInArrow(encode, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, n_tokens): how many ids each row's text has; 0 for null and empty texts."""
    raw = vocabulary_file(df, path)
    src = spread(df.select(F.col(key).alias("_key"), F.col(text).alias("_text")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(raw.value)
        for batch in batches:
            sizes = [machine.count(value) for value in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], [key, "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return src.mapInArrow(count, f"`{key}` {kind}, n_tokens bigint")


def decoded(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, text): the text of each row's ids, decoded token by token; an empty or null list gives an empty text."""
    raw = vocabulary_file(df, path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _machine(raw.value).pieces
        for batch in batches:
            texts = []
            for row in batch.column(1).to_pylist():
                stream = Utf8Machine()
                texts.append("".join([stream.feed(pieces[i]) for i in row or ()]) + stream.close())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("_key"), F.col(ids).alias("_ids")).mapInArrow(decode, f"`{key}` {kind}, text string")


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, n_tokens, same): whether the decoded ids give the text again; null counts as empty."""
    raw = vocabulary_file(df, path)
    src = spread(df.select(F.col(key).alias("_key"), F.col(text).alias("_text")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(raw.value)
        pieces = machine.pieces
        for batch in batches:
            sizes, same = [], []
            for value in batch.column(1).to_pylist():
                found, stream = machine.encode(value), Utf8Machine()
                back = "".join([stream.feed(pieces[i]) for i in found]) + stream.close()
                sizes.append(len(found))
                same.append(back == (value or ""))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [key, "n_tokens", "same"])

    kind = df.schema[key].dataType.simpleString()
    return src.mapInArrow(compare, f"`{key}` {kind}, n_tokens bigint, same boolean")
