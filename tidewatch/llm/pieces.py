"""SentencePiece encoding and decoding by a table of distinct marked words.

When no piece crosses a white-space marker, each marked word is segmented on its
own. A task segments every distinct word of its rows once and joins the ids back
by position, which equals encoding the whole texts; a model with crossing pieces
is detected and encodes whole texts instead.

Defined results: null text counts as empty; empty text has no ids and decodes to
"". All columns of the input but those named in `encode` are carried along unless
they clash with an output name, in which case the output wins.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices
from .tokens import MarkedWordEncoder, encoder


def encode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """doc_id and `ids` (array of int), exactly as the library encodes, without begin or end ids."""

    def run(batches):
        enc = encoder(MarkedWordEncoder, model)
        for batch in batches:
            for part in slices(batch, text):
                ids = [np.frombuffer(enc(t or ""), "<u4") for t in part.column(text).to_pylist()]
                lengths = np.array([0, *map(len, ids)], np.int64)
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(np.cumsum(lengths).astype(np.int32)), pa.array(flat))], names=["doc_id", "ids"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and `text`, the library's decode(ids)."""

    def run(batches):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [sp.decode(x) if x else "" for x in part.column("ids").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, model: str) -> DataFrame:
    """Per document: number of ids, digest of the ids and of the text that decode(ids) gives, in one pass over the texts."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        enc = encoder(MarkedWordEncoder, model)
        names = np.array([str(i) for i in range(enc.model.get_piece_size())], dtype=object)
        for batch in batches:
            for part in slices(batch):
                rows = []
                for t in part.column("text").to_pylist():
                    ids = np.frombuffer(enc(t or ""), "<u4")
                    back = enc.model.decode(ids.tolist()) if len(ids) else ""
                    rows.append((len(ids), hashlib.sha256(",".join(names[ids].tolist()).encode()).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest()))
                n, a, b = zip(*rows) if rows else ((), (), ())
                yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
