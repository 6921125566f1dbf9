"""BPE encoding and decoding by tree concatenation.

A text of more than `leaf` characters is cut into leaves, which are spread over all tasks and encoded in parallel; the
leaves of a text are then joined two by two, and at each join a window around it is encoded anew and grows until its
first and last tokens are those that stood there before (see bpe.py for why that is exact). Short texts are a tree of one
leaf: they are encoded where they are read, and nothing of them is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, common

LEAF = 16_384
_OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(ids: bytes, enc: bpe.Encoder) -> tuple[int, str, str]:
    numbers = np.frombuffer(ids, "<u4").tolist()
    return len(numbers), hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest(), hashlib.sha256(enc.decode(ids).encode()).hexdigest()


def encode_decode(docs: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of docs (doc_id, text); path names the tokenizer file.

    A null text is empty: no tokens, digests of the empty string. The special string of the vocabulary is the special
    id, as in the library. A null doc_id stays null, repeated rows give repeated answers, an empty table gives an empty
    result, other columns are not read. One text can be of any length that a row can hold: its leaves are encoded by
    different tasks, and only its own ids and text meet where they are joined.
    """
    path = path or bpe.tokenizer_path()
    rows = common.id_and_text(docs)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [_digests(ids, enc) for ids in enc.encode(part.column("text").to_pylist())]
                n, a, b = zip(*found, strict=True) if found else ((),) * 3
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, doc, text in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "text")), strict=True):
                for k in range(0, len(text), leaf * 64):
                    starts = range(k, min(len(text), k + leaf * 64), leaf)
                    n = len(starts)
                    yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array([doc] * n, pa.int64()), pa.array([s // leaf for s in starts], pa.int64()), pa.array([text[s : s + leaf] for s in starts], pa.string())], ["key", "doc_id", "at", "text"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(enc.encode(part.column("text").to_pylist()), pa.binary())], ["key", "doc_id", "at", "text", "ids"])

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        enc = bpe.encoder(path)
        frame = frame.sort_values("at")
        tree = bpe.concatenated([bpe.Piece(t, np.frombuffer(i, "<u4"), enc.sizes) for t, i in zip(frame.text, frame.ids, strict=True)], enc)
        doc = frame.doc_id.iloc[0]
        return pd.DataFrame([(None if pd.isna(doc) else int(doc), *_digests(tree.ids.astype("<u4").tobytes(), enc))], columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    is_long = F.char_length("text") > leaf
    short = rows.filter(~is_long).mapInArrow(whole, _OUT)
    pieces = rows.filter(is_long).select(F.monotonically_increasing_id().alias("key"), "doc_id", "text").mapInArrow(cut, "key long, doc_id long, at long, text string")
    encoded = pieces.repartition("key", "at").mapInArrow(leaves, "key long, doc_id long, at long, text string, ids binary")
    return short.unionByName(encoded.groupBy("key").applyInPandas(joined, _OUT))
