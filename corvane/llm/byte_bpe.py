"""Byte-level BPE: encoding whole texts in overlapping chunks, and decoding.

A text of up to ``chunk_chars`` characters is one chunk. A longer one is cut every ``chunk_chars``
characters, and each chunk is read ``overlap`` characters into the next. Chunks are pre-tokenised in
parallel. Where two neighbours agree on a pre-token boundary inside the overlap they have
resynchronised: from there on both would go on alike, so the text can be cut there. The pieces
between such cuts are encoded in parallel and their ids joined in order. Where neighbours agree
nowhere (one token longer than the overlap), what follows stays in one piece, so the ids are always
those of the whole text.

Defined cases: a null or empty text has no ids; ``null`` keys pass through; repeated rows give
repeated results; other columns of the input aren't looked at.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import sliced


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoder of a rank file; one for each worker process."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _packed(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def _decoded(codes: tiktoken.Encoding, packed: bytes) -> bytes:
    return codes.decode_bytes(np.frombuffer(packed, dtype="<u4").tolist())


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", chunk_chars: int = 1 << 16, overlap: int = 1 << 11) -> DataFrame:
    """Rows (key, n_tokens long, ids binary): ids as little-endian unsigned 32-bit integers."""
    return _encoded(docs, path, pattern, key, text, chunk_chars, overlap, decoded=False)


def _encoded(docs: DataFrame, path: str, pattern: str, key: str, text: str, chunk_chars: int, overlap: int, decoded: bool) -> DataFrame:
    """With ``decoded``, the bytes of the ids stand beside them (data binary)."""
    source = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    is_long = F.length("text") > chunk_chars

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = encoding(path, pattern)
        for batch in sliced(batches):
            ids = [_packed(codes.encode_ordinary(x)) for x in batch.column("text").to_pylist()]
            data = [_decoded(codes, x) if decoded else None for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(ids, pa.binary()), pa.array(data, pa.binary())], ["key", "ids", "data"])

    short = source.where(~is_long).mapInArrow(whole, f"key {kind}, ids binary, data binary")
    long = _encode_long(source.where(is_long).withColumn("row", F.monotonically_increasing_id()), kind, path, pattern, chunk_chars, overlap, decoded)
    count = F.expr("cast(octet_length(ids) / 4 as long)").alias("n_tokens")
    return short.unionByName(long).select(F.col("key").alias(key), count, "ids", *(["data"] if decoded else []))


def boundaries(text: str, pattern: regex.Pattern, start: int, stop: int) -> list[int]:
    """Ends of the pre-tokens of ``text`` in [start, stop)."""
    out = []
    for match in pattern.finditer(text):
        if match.end() >= stop:
            break
        if match.end() >= start:
            out.append(match.end())
    return out


def cuts(heads: list[set[int]], tails: list[list[int]]) -> list[int]:
    """Where the text can be cut, as offsets; heads[i] and tails[i] are chunk i's boundaries in its
    first and last characters, as offsets in the text.

    Chunk 0 starts where the text does, so its boundaries hold. Those of chunk i + 1 hold from its
    first one that chunk i has too, if chunk i's hold; after a disagreement none are known to.
    """
    out = []
    for tail, head in zip(tails, heads[1:], strict=False):
        common = next((x for x in tail if x in head), None)
        if common is None:
            break
        out.append(common)
    return out


def _encode_long(long: DataFrame, kind: str, path: str, pattern: str, chunk_chars: int, overlap: int, decoded: bool) -> DataFrame:
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, row, text in zip(batch.column("key"), batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                starts = range(0, len(text), chunk_chars)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key.as_py()] * len(starts), batch.schema.field("key").type), pa.array([row] * len(starts), pa.int64()), pa.array(range(len(starts)), pa.int64()), pa.array([text[i : i + chunk_chars + overlap] for i in starts], pa.string())],
                    ["key", "row", "no", "text"],
                )

    def pretokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        for batch in batches:
            heads, tails, cores = [], [], []
            for no, text in zip(batch.column("no").to_pylist(), batch.column("text").to_pylist(), strict=True):
                at = no * chunk_chars
                heads.append([at + x for x in boundaries(text, compiled, 0, overlap - 1)])
                # the last character may be half of a longer match's look at what follows
                tails.append([at + x for x in boundaries(text, compiled, chunk_chars, len(text) - 1)])
                cores.append(text[:chunk_chars])
            offsets = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("row"), batch.column("no"), pa.array(cores, pa.string()), pa.array(heads, offsets), pa.array(tails, offsets)], ["key", "row", "no", "text", "heads", "tails"])

    def stitch(group: pa.Table) -> pa.Table:
        group = group.sort_by("no")
        text = "".join(group.column("text").to_pylist())
        at = [0, *cuts([set(x) for x in group.column("heads").to_pylist()], group.column("tails").to_pylist()), len(text)]
        n = len(at) - 1
        return pa.table({"key": pa.array([group.column("key")[0].as_py()] * n, group.schema.field("key").type), "row": pa.array([group.column("row")[0].as_py()] * n, pa.int64()), "no": pa.array(range(n), pa.int64()), "text": pa.array([text[i:j] for i, j in zip(at, at[1:], strict=False)], pa.string())})

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text = encoding(path, pattern).encode_ordinary
        for batch in batches:
            ids = [_packed(encode_text(x)) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("row"), batch.column("no"), pa.array(ids, pa.binary())], ["key", "row", "no", "ids"])

    def joined(group: pa.Table) -> pa.Table:
        group = group.sort_by("no")
        ids = b"".join(group.column("ids").to_pylist())
        data = _decoded(encoding(path, pattern), ids) if decoded else None
        return pa.table({"key": group.column("key").slice(0, 1), "ids": pa.array([ids], pa.binary()), "data": pa.array([data], pa.binary())})

    cut = long.mapInArrow(chunks, f"key {kind}, row long, no long, text string").repartition("row", "no")
    marked = cut.mapInArrow(pretokens, f"key {kind}, row long, no long, text string, heads array<long>, tails array<long>")
    stitched = marked.groupBy("row").applyInArrow(stitch, f"key {kind}, row long, no long, text string").repartition("row", "no")
    encoded = stitched.mapInArrow(pieces, f"key {kind}, row long, no long, ids binary")
    return encoded.groupBy("row").applyInArrow(joined, f"key {kind}, ids binary, data binary")


def decode(tokens: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Rows (key, data binary): the bytes of the ids, joined. Null ids give no bytes."""
    kind = tokens.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = encoding(path, pattern)
        for batch in sliced(batches):
            data = [_decoded(codes, x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(data, pa.binary())], ["key", "data"])

    return tokens.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, data binary").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", chunk_chars: int = 1 << 16, overlap: int = 1 << 11) -> DataFrame:
    """Rows (key, n_tokens, ids, data): each text's ids and the bytes that they decode to, by the
    worker that encoded it, so no join and no second pass is needed to have both side by side."""
    return _encoded(docs, path, pattern, key, text, chunk_chars, overlap, decoded=True)
