"""Language identification by n-gram Bloom filters that are sliced by language.

The model is a table of slots, each a bit mask with one bit a language: column l of the table is the
Bloom filter of language l's n-grams. ANDing the slots that an n-gram hashes to gives all languages
that contain it at once. A text's hits are summed for each language, and what the fill of that
language's slice lets through by chance is taken off; the largest share decides.

An n-gram is four bytes of the lower-cased UTF-8 text, in which digits, ASCII punctuation and white
space count as a space and which is padded with spaces. A language contains the n-grams that at
least two of its sampled documents have and that are at least ``kept_ratio`` times as common in it
as in the language in which they are most common.

Learning takes a sample of about ``sample_docs`` documents a language, chosen by a hash of the key
(all documents of rarer languages); the model has ``2 ** slot_bits`` masks, whatever the corpus.

Defined cases: ``und`` with score 0 for a null text or one without a letter; a text whose n-grams no
language has gets the most common language with the score 1 / languages; ties go to the language
first in order; without any labelled document everything is ``und``. More than ``MAX_LANGUAGES``
languages are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NGRAM, MAX_LANGUAGES = 4, 62
#: Odd multipliers of the slot hashes (fixed values).
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Bytes handled at once, so that a worker's memory doesn't follow the size of a batch or text.
SEGMENT = 1 << 21

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32


@dataclass(frozen=True)
class Model:
    languages: list[str]
    slots: np.ndarray  # uint64 masks
    false_positive: np.ndarray  # by language
    default: int  # the most common language


def _slots(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    wide = grams.astype(np.uint64)
    return [(wide * np.uint64(m)) >> np.uint64(64 - bits) for m in MULTIPLIERS]


def _folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' folded bytes, each with a space before it and two behind it, and their offsets."""
    padded = pc.binary_join_element_wise(" ", pc.utf8_lower(pc.fill_null(texts, "")), "  ", "").cast(pa.large_string())
    _, offsets, data = padded.buffers()
    at = np.frombuffer(offsets, np.int64)[padded.offset : padded.offset + len(padded) + 1]
    return _FOLD[np.frombuffer(data, np.uint8)[at[0] : at[-1]]], at - at[0]


def _grams(data: np.ndarray) -> np.ndarray:
    wide = data.astype(np.uint32)
    return wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)


_BLANK = np.uint32(0x20202020)


def held_out(key: Column) -> Column:
    """True for the third of the keys that learning leaves aside."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = 600, slot_bits: int = 20, kept_ratio: float = 0.2) -> Model:
    """Learn from the rows of ``docs`` that have a text and a language."""
    labelled = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros(1 << slot_bits, np.uint64), np.zeros(0), 0)
    share = F.create_map(*[x for name in languages for x in (F.lit(name), F.lit(min(1.0, sample_docs / counts[name])))])
    draw = F.pmod(F.xxhash64(F.lit(11), "key"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    number = F.create_map(*[x for i, name in enumerate(languages) for x in (F.lit(name), F.lit(i))])
    sample = labelled.where(draw < share[F.col("lang")]).select(number[F.col("lang")].alias("no"), "text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, one in zip(batch.column("no").to_pylist(), range(batch.num_rows), strict=True):
                data, _ = _folded(batch.column("text").slice(one, 1))
                if len(data) < NGRAM:
                    continue
                found = np.unique(_grams(data))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), no, np.int32)), pa.array(found.astype(np.int64))], ["no", "gram"])

    sizes = F.array(*[F.lit(min(float(sample_docs), counts[name])) for name in languages])
    rates = sample.mapInArrow(grams, "no int, gram long").groupBy("gram", "no").agg(F.count("*").alias("n")).where("n > 1")
    rates = rates.groupBy("gram").agg(F.collect_list(F.struct("no", (F.col("n") / F.element_at(sizes, F.col("no") + 1)).alias("rate"))).alias("by"))
    top = F.array_max(F.col("by.rate"))
    mask = F.aggregate(F.filter("by", lambda x: x["rate"] >= kept_ratio * top), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x["no"])))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = batch.column("mask")
            for at in _slots(batch.column("gram").to_numpy(), slot_bits):
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), masks], ["slot", "mask"])

    # at most 2 ** slot_bits rows, whatever the corpus
    table = rates.select("gram", mask.alias("mask")).mapInArrow(slots, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    filled = np.zeros(1 << slot_bits, np.uint64)
    filled[table.column("slot").to_numpy()] = table.column("mask").to_numpy().astype(np.uint64)
    fill = np.array([float(((filled >> np.uint64(i)) & np.uint64(1)).mean()) for i in range(len(languages))])
    return Model(languages, filled, fill ** len(MULTIPLIERS), max(range(len(languages)), key=lambda i: (counts[languages[i]], -i)))


def hits(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text: its n-grams' number, and of these how many each language contains."""
    data, offsets = _folded(texts)
    bits = int(len(model.slots)).bit_length() - 1
    total = np.zeros(len(texts), np.int64)
    found = np.zeros((len(texts), len(model.languages)), np.int64)
    for start in range(0, len(data), SEGMENT):
        part = data[start : start + SEGMENT + NGRAM - 1]
        if len(part) < NGRAM:
            break
        grams = _grams(part)
        first, last = np.searchsorted(offsets, start, "right") - 1, np.searchsorted(offsets, start + len(grams), "left")
        counted = grams != _BLANK
        for back in range(1, NGRAM):  # n-grams that would run into the next text
            ends = offsets[first + 1 : last + 1] - back - start
            counted[ends[(ends >= 0) & (ends < len(grams))]] = False
        masks = np.where(counted, np.uint64(2**64 - 1), np.uint64(0))
        for at in _slots(grams, bits):
            masks &= model.slots[at]
        edges = np.maximum(offsets[first:last] - start, 0)
        total[first:last] += np.add.reduceat(counted, edges, dtype=np.int64)
        for i in range(len(model.languages)):
            found[first:last, i] += np.add.reduceat((masks >> np.uint64(i)) & np.uint64(1), edges).astype(np.int64)
    return total, found


def _right(model: Model, total: np.ndarray, found: np.ndarray) -> np.ndarray:
    """For each text, the n-grams that each language contains, less what the filters let through by chance."""
    chance = total[:, None] * model.false_positive[None, :]
    return np.maximum((found - chance) / (1 - np.minimum(model.false_positive, 0.999))[None, :], 0.0)


def decide(model: Model, total: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The language's number and its score for each text."""
    right = _right(model, total, found)
    every = right.sum(axis=1)
    best = np.where(every > 0, right.argmax(axis=1), model.default)
    return best, np.where(every > 0, right.max(axis=1) / np.where(every > 0, every, 1), 1.0 / len(model.languages))


def known_share(model: Model, total: np.ndarray, found: np.ndarray) -> np.ndarray:
    """For each text, the share of its n-grams that the language with most of them contains; 0 without n-grams."""
    return _right(model, total, found).max(axis=1) / np.maximum(total, 1)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, lang_pred string, score double), one for each row of ``docs``."""
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False)).alias("lettered"))
    if not model.languages:
        return source.select(F.col("key").alias(key), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        names = np.array(known.languages, object)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                lettered = some.column("lettered").to_numpy(zero_copy_only=False)
                best, score = decide(known, *hits(known, some.column("text")))
                yield pa.RecordBatch.from_arrays([some.column("key"), pa.array(np.where(lettered, names[best], "und"), pa.string()), pa.array(np.where(lettered, score, 0.0))], ["key", "lang_pred", "score"])

    return source.mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def identified(docs: DataFrame, model: Model, text: str = "text", least_share: float = 0.25) -> DataFrame:
    """The rows of ``docs`` whose text has a letter and a language that contains at least that share of its n-grams.

    The share doesn't depend on the number of languages: text in a learned language has 0.65 or more on
    labelled documents, chance gives next to nothing, and a text without any known n-gram is always rejected.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    position = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                share = known_share(known, *hits(known, some.column(position)))
                yield some.filter(pa.array((share >= least_share) & (share > 0)))

    lettered = docs.where(F.col(text).rlike("\\p{L}"))
    return lettered.mapInArrow(run, docs.schema) if model.languages else lettered.limit(0)
