"""Problem 6: the whole corpus as token ids of a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm.bpe import VOCABULARY, vocabulary
from codeweft.llm.versions import ship_file, shipped_file


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """key and ids: each text as ids of the vocabulary at ``path``, without special tokens.

    Texts are encoded where they are read, without a shuffle, by a transducer that holds as
    many bytes as the vocabulary's sufficient lookahead needs.  Null, empty: an empty list.
    Blank texts and strings that look like special tokens are ordinary text.  Repeated rows
    stay.  Other columns are never read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shipped_file(path))
        for b in batches:
            offsets, flat = [0], []
            for t in b.column(1):
                flat += v.encode(t.as_py())
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], [key, "ids"])

    rows = documents.select(key, text)
    ship_file(documents.sparkSession, path)
    return rows.mapInArrow(encode, f"{key} {rows.schema[key].dataType.simpleString()}, ids array<int>")


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """key and n_tokens of each text; the ids never leave the task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shipped_file(path))
        for b in batches:
            n = [len(v.encode(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], [key, "n_tokens"])

    rows = documents.select(key, text)
    ship_file(documents.sparkSession, path)
    return rows.mapInArrow(count, f"{key} {rows.schema[key].dataType.simpleString()}, n_tokens long")


def round_trips(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """key, n_tokens and whether decoding the ids gives the text back (true for null and empty texts)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shipped_file(path))
        for b in batches:
            n, same = [], []
            for t in b.column(1):
                ids = v.encode(t.as_py())
                n.append(len(ids))
                same.append("".join(v.decode(ids)) == (t.as_py() or ""))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(same)], [key, "n_tokens", "same"])

    rows = documents.select(key, text)
    ship_file(documents.sparkSession, path)
    return rows.mapInArrow(check, f"{key} {rows.schema[key].dataType.simpleString()}, n_tokens long, same boolean")
