"""Token files: Parquet with one list of ids a document, in ascending order of the key.

Documents are dealt to partitions by key range, sorted, encoded and written once; each partition is
one file. A column ``local_start`` counts the ids before a document in its file, so that a reader
needs only each file's total to know where any document starts in the whole stream. Row groups have
a bounded size; pages are small, with Parquet's column and offset indexes, so that one document's
ids, or the counts without the ids, can be read alone. Ids are dictionary-encoded where that pays,
counts delta-encoded (format version 2).

Defined cases: a null or empty text has the end id alone; equal keys stand beside each other, in
order of their text; null keys come first; an empty table gives files without rows; other columns
are carried only if asked for.
"""

from __future__ import annotations

import itertools
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from corvane.llm.common import parts_for, sliced
from corvane.llm.shingles import mix

#: In a run of two white-space characters before a word, the first is a pre-token; longer runs, and
#: those at the end of a text, aren't cut.
_UNSURE = re.compile(r"\s\s(?:\s|\Z)")
#: Pieces that are one pre-token: letters of the Latin blocks up to U+024F, or of ASCII alone.
_ASCII, _LATIN = re.compile(rb" ?[A-Za-z]+"), re.compile(" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")
#: White space besides spaces and line breaks; a text without it needs no search for long runs if it
#: has none of these pairs.
_ODD = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_PAIRS = ("  ", "\n\n", " \n", "\n ")
#: Distinct pieces whose ids a worker remembers (about 30 bytes each); then it starts anew.
REMEMBERED = 2_000_000
#: Rows that are encoded before they leave a worker.
ROWS = 500
#: Bytes of text whose pieces are looked at together, and the longest piece that is hashed.
AT_ONCE, LONGEST = 2 << 20, 64
_GAP, _LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, np.int8)
_GAP[[10, 32]], _LETTER[65:91], _LETTER[97:123], _MARK[46], _MARK[44] = True, True, True, 1, 2
_POWERS = np.multiply.accumulate(np.full(LONGEST, 0x9E3779B97F4A7C15, np.uint64))


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for
    the characters from U+0100 on, in order (a fixed rule of the vocabulary)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceEncoder:
    """Encodes texts by their pieces between spaces and line breaks, each distinct piece once.

    A byte-level pre-tokenizer never joins what stands before a space or line break with what
    follows, where white space runs no longer than two, so a text's ids are those of its pieces,
    joined. Pieces are told apart by 64-bit hashes, taken over many texts at once; a full stop or
    comma behind an ASCII letter is a piece of its own. Texts with longer runs, and all texts of
    other kinds of tokenizers, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = t = Tokenizer.from_file(path)
        self.by_piece = type(t.pre_tokenizer) is ByteLevel and not t.pre_tokenizer.add_prefix_space and t.normalizer is None and not any(" " in x.content for x in t.get_added_tokens_decoder().values())
        self.letters = _byte_letters()
        marks = [np.frombuffer(x, "<u4") for x in self.whole([".", ","])]
        self.by_piece &= all(len(x) == 1 for x in marks)
        self.marks = np.array([0, *(x[0] for x in marks)], "<u4")
        self._forget()

    def _forget(self) -> None:
        """Known pieces: ascending hashes, and where in the pool each one's ids stand."""
        self.keys, self.offset, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 20, "<u4"), 0

    def _learn(self, keys: np.ndarray, place: np.ndarray, ids: list[bytes]) -> None:
        """Put new pieces in their places of the order."""
        count = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        more = np.frombuffer(b"".join(ids), "<u4")
        if self.used + len(more) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(more)), "<u4")])
        self.pool[self.used : self.used + len(more)] = more
        self.keys = np.insert(self.keys, place, keys)
        self.offset = np.insert(self.offset, place, self.used + np.cumsum(count) - count)
        self.count = np.insert(self.count, place, count)
        self.used += len(more)

    @staticmethod
    def _unsure(text: str) -> bool:
        return (any(p in text for p in _PAIRS) or any(c in text for c in _ODD)) and _UNSURE.search(text) is not None

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, pieces: list[bytes]) -> list[bytes]:
        """A piece of common letters is one pre-token, which the model takes as it is."""
        tokenize, table, out, rest = self.tokenizer.model.tokenize, self.letters, [], []
        for i, p in enumerate(pieces):
            if _ASCII.fullmatch(p):
                word = "\u0120" + p[1:].decode() if p[0] == 32 else p.decode()
            elif _LATIN.fullmatch(p.decode("utf-8", "surrogatepass")):
                word = p.decode("latin-1").translate(table)
            else:
                rest.append(i)
                out.append(b"")
                continue
            out.append(array("I", [x.id for x in tokenize(word)]).tobytes())
        for i, ids in zip(rest, self.whole([pieces[i].decode("utf-8", "surrogatepass") for i in rest]), strict=True):
            out[i] = ids
        return out

    def _joined(self, texts: list[bytes]) -> list[bytes]:
        raw = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(x) for x in texts])
        cut = _GAP[raw]
        after = np.flatnonzero(raw == 10) + 1
        after = after[after < len(raw)]
        cut[after[raw[after] > 32]] = True  # a word behind a line break
        cut[0] = True
        cut[ends[:-1][ends[:-1] < len(raw)]] = True
        first = np.flatnonzero(cut)
        size = np.diff(np.concatenate([first, [len(raw)]]))
        last = first + size - 1
        mark = np.where((size > 1) & _LETTER[raw[np.maximum(last - 1, 0)]], _MARK[raw[last]], 0)
        inside = np.arange(len(raw)) - np.repeat(first, size)
        values = (raw.astype(np.uint64) + np.uint64(1)) * _POWERS[np.minimum(inside, LONGEST - 1)]
        values[last[mark > 0]] = 0
        names = mix(np.add.reduceat(values, first) + (size - (mark > 0)).astype(np.uint64))
        long = np.flatnonzero(size > LONGEST)
        names[long] = [hash(raw[first[i] : first[i] + size[i]].tobytes()) & (2**64 - 1) for i in long.tolist()]
        order = np.argsort(names, kind="stable")
        new = np.concatenate([[True], names[order[1:]] != names[order[:-1]]])
        at = order[new]
        which = np.empty(len(names), np.int64)
        which[order] = np.cumsum(new) - 1
        keys = names[at]  # ascending
        if len(self.keys) + len(keys) > REMEMBERED:
            self._forget()
        place = np.searchsorted(self.keys, keys)
        missing = np.ones(len(keys), bool)
        inside = place < len(self.keys)
        missing[inside] = self.keys[place[inside]] != keys[inside]
        if missing.any():
            data, starts, lengths = raw.tobytes(), first[at[missing]].tolist(), (size - (mark > 0))[at[missing]].tolist()
            self._learn(keys[missing], place[missing], self._new([data[i : i + n] for i, n in zip(starts, lengths, strict=True)]))
            place = np.searchsorted(self.keys, keys)
        # every piece's ids, and its mark's, side by side
        pool, offset, count = self.pool, self.offset[place], self.count[place]
        own = count[which]
        width = own + (mark > 0)
        begin = np.cumsum(width) - width
        out = np.empty(int(width.sum()), "<u4")
        step = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
        out[np.repeat(begin, own) + step] = pool[np.repeat(offset[which], own) + step]
        marked = mark > 0
        out[(begin + own)[marked]] = self.marks[mark[marked]]
        cuts = np.concatenate([begin, [len(out)]])[np.searchsorted(first, np.concatenate([[0], ends]))] * 4
        flat = out.tobytes()
        return [flat[i:j] for i, j in itertools.pairwise(cuts.tolist())]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        batch, some, size = [], [], 0
        for i, x in enumerate(texts):
            if not self.by_piece or self._unsure(x):
                out[i] = self.whole([x])[0]
            elif x:  # an empty text has no pieces
                some.append(x.encode("utf-8", "surrogatepass"))
                batch.append(i)
                size += len(some[-1])
            if some and (size >= AT_ONCE or i == len(texts) - 1):
                for k, ids in zip(batch, self._joined(some), strict=True):
                    out[k] = ids
                batch, some, size = [], [], 0
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> PieceEncoder:
    """One for each worker process, which serves task after task."""
    return PieceEncoder(path)


def write(docs: DataFrame, out: str, path: str, end_id: int, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), partitions: int | None = None, row_group_bytes: int = 32 << 20, page_bytes: int = 64 << 10) -> None:
    """Write ``docs`` as token files to the folder ``out``; ``carry`` names metadata columns to keep."""
    source = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), *[F.col(c).alias(f"meta_{c}") for c in carry])
    fields = [f for f in source.schema if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", part int, local_start long, n_tokens long, ids array<int>"
    n = partitions or parts_for(docs.sparkSession, source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, at, part = encoder(path), 0, TaskContext.get().partitionId()
        tail = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in sliced(batches, ROWS):
            ids = [x + tail for x in encode(batch.column("text").to_pylist())]
            counts = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            ends = np.cumsum(counts)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))
            rest = [batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(np.full(len(ids), part, np.int32)), pa.array(at + ends - counts), pa.array(counts), lists], [*[f.name for f in fields], "part", "local_start", "n_tokens", "ids"])
            at += int(ends[-1]) if len(ends) else 0

    dealt = source.repartitionByRange(n, "key").sortWithinPartitions("key", "text")
    options = {"parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": 2000, "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": 1 << 20, "compression": "zstd"}
    dealt.mapInArrow(run, schema).write.mode("overwrite").options(**{k: str(v) for k, v in options.items()}).parquet(out)


def read(spark: SparkSession, out: str, columns: tuple[str, ...] = ("ids",)) -> DataFrame:
    """Rows (key, start, n_tokens and the asked columns) of token files; only those columns are read.

    The one small table beside the files is a total for each file, as many rows as files.
    """
    files = spark.read.parquet(out)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_start"))
    return files.join(F.broadcast(starts), "part").select("key", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", *columns)


def checksums(tokens: DataFrame) -> DataFrame:
    """Rows (key, start, n_tokens, ids_crc32) of what ``read`` returns, from the ids as they stand in the files."""
    kind = tokens.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            lists = batch.column("ids")
            offsets = lists.offsets.to_numpy()
            data = memoryview(lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype("<i4").tobytes())
            sums = [zlib.crc32(data[4 * i : 4 * j]) for i, j in itertools.pairwise((offsets - offsets[0]).tolist())]
            counts = np.diff(offsets).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("start"), pa.array(counts), pa.array(sums, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"])

    return tokens.select("key", "start", "ids").mapInArrow(run, f"key {kind}, start long, n_tokens long, ids_crc32 long")
