"""Sequence packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the powers of two
that add up to n (as many of the longest as fit first). Each piece is a
sequence of its own; equal lengths share a bucket, so batches need no padding
and no sequence crosses documents. The plan is one pass without a shuffle.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONGEST = 2048
END_ID = 1
TOKENIZER = "byte_bpe_50k.json"
#: The same vocabulary as byte ranks, for the faster encoder; tests hold the two equal.
RANKS = "byte_bpe_50k.tiktoken"

_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """A function from a text to its ids, one for a file and process.

    With byte ranks, two kinds of text go to the tokenizer of the JSON file
    instead: those that contain one of its added tokens, whose id they get, and
    those that the faster encoder's pattern matcher gives up on (a very long run
    of blanks overflows its stack).
    """
    if path not in _loaded:
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

            with open(public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
                added = [x["content"] for x in json.load(f).get("added_tokens", ())]

            def encode(text: str) -> list[int]:
                if not any(x in text for x in added):
                    try:
                        return fast(text)
                    except BaseException as e:
                        if type(e).__name__ != "PanicException":
                            raise
                return tokenizer(public_tokenizers.path(TOKENIZER))(text)

            _loaded[path] = encode
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            _loaded[path] = lambda text: t.encode(text, add_special_tokens=False).ids
    return _loaded[path]


def lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Powers of two, none over ``longest`` (a power of two), largest first, that add up to ``n``."""
    out = [longest] * (n // longest)
    rest = n % longest
    return out + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, tokenizer_path: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece of every row of ``docs``: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (log2 of the length), and with ``with_ids`` the ids.

    A null or empty text is the end id alone. Rows that repeat an id are packed
    each by itself. sequence_id counts within the input partition and is unique;
    it is stable for a given input split. An empty table gives no rows. Other
    columns are ignored.
    """
    path = tokenizer_path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            encode, rows = tokenizer(path), []
            pieces: list[bytes] = []
            for doc, text in zip(ids, texts):
                raw = np.array([*encode(text or ""), end_id], "<u4").tobytes()
                total, at = len(raw) // 4, 0
                for n in lengths(total, longest):
                    piece = raw[4 * at : 4 * (at + n)]
                    rows.append((doc, at, n, zlib.crc32(piece), total, n.bit_length() - 1))
                    if with_ids:
                        pieces.append(piece)
                    at += n
                if len(rows) >= 20_000:
                    yield made(rows, pieces)
                    rows, pieces = [], []
            if rows:
                yield made(rows, pieces)

    def made(rows, pieces):
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()])]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket"]
        if with_ids:
            columns.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in pieces], pa.list_(pa.int32())))
            names.append("ids")
        return pa.record_batch(columns, names)

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, bucket int" + ", ids array<int>" * with_ids
    out = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    out = out.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")})
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", *["ids"] * with_ids)


def write_buckets(packed: DataFrame, path: str) -> None:
    """Packed sequences with their ids as Parquet, a folder for each length (bucket=log2 of it), so that a reader takes batches of equal length as they are."""
    packed.write.partitionBy("bucket").parquet(path)
