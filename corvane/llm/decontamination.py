"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item's sketch is the bottom of its set of word shingles: the ``sketch`` least hashes, all of
them where it has fewer. Sketches are partitioned by the item's size, which fixes how many of a
sketch's hashes a document has to have: of a set that is contained to num / den, a sketch of s
hashes keeps all but those missing, s * num / den on average; ``_needed`` asks for so few that a
contained item falls short less than once in 10 ** 8. A document of fewer shingles than its
partition's share of the item can't contain it and is left out at once. Candidates are then verified
exactly, by the number of the item's shingles that the document has.

The documents' shingles meet the sketches in one join; sketches are broadcast only up to
``broadcast_rows`` hashes, and are shuffled beyond. Everything is DataFrame expressions.

Defined cases: null and empty texts and items have no shingles, contain and are contained in nothing;
a text or item of fewer than ``size`` words is one shingle; repeated rows give one result; null keys
are a key; extra columns aren't looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, ascii_lower, few, once, words


def shingles(tokens: Column, size: int) -> Column:
    """The distinct shingles' hashes."""

    def of(t: Column) -> Column:
        n = F.size(t)
        runs = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(t, i + k) for k in range(size)]))
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < size, F.array(F.xxhash64(F.lit(size), t))).otherwise(F.array_distinct(runs))

    return once(tokens, of)


def _hashed(rows: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, text_hash, tokens); the text's hash tells rows with equal keys apart."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return rows.select(F.col(key).alias("key"), F.xxhash64(whole).alias("text_hash"), words(ascii_lower(whole)).alias("tokens"))


def _needed(s: Column, missing: Column, num: int, den: int) -> Column:
    """Of a sketch of s hashes: at least those that stay if all ``missing`` ones are in it, and 6.5
    standard deviations below the mean."""
    share = num / den
    spread = F.floor(s * share - 6.5 * F.sqrt(s * (share * (1 - share))))
    return F.greatest(F.lit(1), s - missing, spread).cast("int")


def contained(docs: DataFrame, items: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", size: int = 5, num: int = 80, den: int = 100, sketch: int = 32, broadcast_rows: int = 2_000_000) -> DataFrame:
    """(key, item, n_shared, n_shingles): the items whose shingles a document has to num / den or more."""
    whole = _hashed(items, item_key, item_text, size).select("key", shingles(F.col("tokens"), size).alias("hashes")).where(F.size("hashes") > 0)
    table = scratch.table(whole.select(F.col("key").alias("item"), F.xxhash64("key", "hashes").alias("item_no"), "hashes", F.size("hashes").alias("q"), F.ceil(F.size("hashes") * F.lit(num) / F.lit(den)).cast("int").alias("least")).distinct(), "items")
    signed = table.withColumn("bottom", F.slice(F.sort_array("hashes"), 1, sketch)).withColumn("needed", _needed(F.size("bottom"), F.col("q") - F.col("least"), num, den))
    sketches = signed.select("item_no", "least", "needed", F.explode("bottom").alias("hash"))
    ceiling = signed.agg(F.max(F.element_at("bottom", -1)).alias("top"), F.sum(F.size("bottom")).alias("n"), F.sum("q").alias("all")).first()
    if ceiling["n"] is None:
        return docs.limit(0).select(F.col(key).alias(key), F.lit(None).cast(items.schema[item_key].dataType).alias("item"), F.lit(0).cast("long").alias("n_shared"), F.lit(0).cast("long").alias("n_shingles"), F.lit(0).cast("long").alias("text_hash"))
    small = ceiling["all"] <= broadcast_rows
    sized = lambda df: F.broadcast(df) if small else df

    texts = _hashed(docs, key, text, size)
    parts = texts.select("key", "text_hash", shingles(F.col("tokens"), size).alias("hashes"))
    # the outer form, since the optimizer would compute the shingles twice to leave out empty arrays
    looked = parts.select("key", "text_hash", F.size("hashes").alias("d"), F.explode_outer("hashes").alias("hash")).where(F.col("hash") <= ceiling["top"])
    met = looked.join(sized(sketches), "hash").where("d >= least").groupBy("key", "text_hash", "item_no", "needed").agg(F.count_distinct("hash").alias("n")).where("n >= needed")
    candidates = scratch.table(met.select("key", "text_hash", "item_no"), "candidates")

    some = candidates.select("key", "text_hash").distinct()
    if some.count() <= broadcast_rows // 4:
        some = F.broadcast(some)
    one, two = parts.alias("one"), some.alias("two")
    again = one.join(two, F.col("one.key").eqNullSafe(F.col("two.key")) & (F.col("one.text_hash") == F.col("two.text_hash")), "left_semi")
    exploded = again.select("key", "text_hash", F.explode_outer("hashes").alias("hash"))
    full = table.select("item_no", "item", "q", "least", F.explode("hashes").alias("hash"))
    shared = exploded.join(sized(full), "hash").groupBy("key", "text_hash", "item_no", "item", "q", "least").agg(F.count_distinct("hash").alias("n_shared")).where("n_shared >= least").alias("s")
    c = candidates.alias("c")
    verified = shared.join(c, F.col("s.key").eqNullSafe(F.col("c.key")) & (F.col("s.text_hash") == F.col("c.text_hash")) & (F.col("s.item_no") == F.col("c.item_no")), "left_semi")
    return verified.select(F.col("key").alias(key), "item", F.col("n_shared").cast("long").alias("n_shared"), F.col("q").cast("long").alias("n_shingles"), "text_hash").distinct()


def clean(docs: DataFrame, items: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that contain no item."""
    found = scratch.table(contained(docs, items, scratch, key, text, **options).select(F.col(key).alias("bad_key"), F.col("text_hash").alias("bad_text")).distinct(), "contaminated", stay=True)
    scratch.drop()
    rows = docs.withColumn("_text_hash", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    return rows.join(few(found), F.col(key).eqNullSafe(F.col("bad_key")) & (F.col("_text_hash") == F.col("bad_text")), "left_anti").drop("_text_hash")
