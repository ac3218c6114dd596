"""Byte-level BPE encoding and decoding of documents.

Method: vectorised pre-tokenisation. Code points map to classes by one array;
the boundary rules are a small automaton whose transition functions are composed
associatively over blocks (no regular expression); the slices between boundaries
go through cached pair merging, and their byte offsets are kept.

Null and empty texts encode to no ids. Extra columns, repeated rows and null
keys pass through. Work is per row: no shuffle, and memory is bounded by a run
of texts of about 2 MB or one longer text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from affinity.llm import bpe_scan
from affinity.llm.common import text_slices

IDS_SCHEMA = "doc_id long, token_ids array<int>, piece_starts array<int>"
DIGEST_SCHEMA = "doc_id long, n_tokens long, n_pieces long, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base-64 bytes and a rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def code_point_classes() -> np.ndarray:
    """The class of every code point as the tokenizer library sees it.

    One-letter vocabularies whose pattern is a single class let all characters
    of the class through and drop the others.
    """
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    ranks = {bytes([b]): b for b in range(256)}
    classes = np.full(0x110000, bpe_scan.OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", bpe_scan.LETTER), (r"\p{N}", bpe_scan.NUMBER), (r"\s", bpe_scan.SPACE)):
        own = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        found = bytes(own.encode_ordinary(everything)).decode()
        classes[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return classes


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def encode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Each document's ids and the byte offsets of its pieces: doc_id, token_ids, piece_starts."""
    ranks, classes, key = load_ranks(ranks_path), code_point_classes(), f"bpe {ranks_path}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe_scan.in_process(key, lambda: bpe_scan.Codec(ranks, classes))
        for batch in batches:
            for part in text_slices(batch):
                done = codec.encode(_texts(part))
                ids = [np.frombuffer(i, "<i4") for i, _ in done]
                yield pa.RecordBatch.from_arrays(
                    [_column(part, "doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([o for _, o in done], pa.list_(pa.int32()))],
                    ["doc_id", "token_ids", "piece_starts"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, IDS_SCHEMA)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """The texts that ids stand for: doc_id, text. Bytes that aren't UTF-8 become U+FFFD."""
    ranks = load_ranks(ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe_scan.Codec(ranks, np.zeros(0, np.uint8))
        for batch in batches:
            ids = (np.array(x or [], "<u4").tobytes() for x in _column(batch, "token_ids").to_pylist())
            texts = [codec.decode(i).decode("utf-8", "replace") for i in ids]
            yield pa.RecordBatch.from_arrays([_column(batch, "doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Encode and decode each document and return digests of both: counts and SHA-256."""
    ranks, classes, key = load_ranks(ranks_path), code_point_classes(), f"bpe {ranks_path}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe_scan.in_process(key, lambda: bpe_scan.Codec(ranks, classes))
        for batch in batches:
            for part in text_slices(batch):
                done = codec.encode(_texts(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        _column(part, "doc_id"),
                        pa.array([len(i) // 4 for i, _ in done], pa.int64()),
                        pa.array([len(o) for _, o in done], pa.int64()),
                        pa.array([hashlib.sha256(i).hexdigest() for i, _ in done]),
                        pa.array([hashlib.sha256(codec.decode(i)).hexdigest() for i, _ in done]),
                    ],
                    ["doc_id", "n_tokens", "n_pieces", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, DIGEST_SCHEMA)
