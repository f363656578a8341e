"""Secret scanning with corpus-wide ownership.

Patterns find candidates in each text. Every candidate value is hashed, and the corpus says who has
it: the number of distinct repositories and of distinct owners that hold the hash. A value that
many owners hold is a copied example; one that only ``max_owners`` or fewer hold, with the variety
of a real credential, is live-looking. Counting runs over (hash, owner, repository) first, so a
value that stands in a third of all rows reaches the count by hash as one row for each repository.

Everything is DataFrame expressions. A match's place comes from the lengths of the matches and of
the pieces between them, in code points.

Defined cases: a null text is empty and has no spans; a null repository counts as one owner of its
own; repeated rows are scanned each and counted once in ownership; extra columns aren't looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, few, once

#: Kind, pattern, the group with the value, least characters of the value, a string
#: without which there is no match. The first three are the base kinds.
KINDS = (
    ("assign", "(?i:(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?)([A-Za-z0-9+/_.=-]+)", 2, 8, ""),
    ("access", "AKIA[A-Z0-9]+", 0, 16, "AKIA"),
    ("hex", "[0-9a-f]{32,}", 0, 32, ""),  # a run shorter than 32 can't match, so runs stay whole
    ("provider", "(?:ghp|gho|ghs|glpat|sk_live|rk_live|xoxb|xoxp)[_-][A-Za-z0-9_-]{20,}", 0, 24, ""),
    ("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 0, 24, "eyJ"),
    ("pem", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1, "-----BEGIN "),
)
BASE = 3
_PEM = "PRIVATE KEY-----"
#: For redaction, pem is the key with its body, which is the value: to the END line, or else the lines of base64.
WHOLE = (*KINDS[:-1], ("pem", f"-----BEGIN [A-Z ]{{0,20}}{_PEM}((?:\\s*(?:Proc-Type|DEK-Info):[^\r\n]*){{0,2}}(?:[A-Za-z0-9+/=\\s\\\\]*-----END [A-Z ]{{0,20}}{_PEM}|(?:(?:\\s|\\\\[nr])*+[A-Za-z0-9+/=]{{16,}}+)*+))", 1, 16, "-----BEGIN "))
#: Kinds whose values redaction judges by ownership alone.
UNGATED = ("assign", "provider", "pem")


def _spans(text: Column, number: int, kinds: tuple = KINDS) -> Column:
    """array<struct<start, kind_no, end, kind, value>> of one kind, in order."""
    kind, pattern, group, least, needs = kinds[number]
    rx = F.lit(pattern)
    none = F.array().cast("array<struct<start:int,kind_no:int,end:int,kind:string,value:string>>")

    def placed(found: Column) -> Column:
        between = F.split(text, pattern, -1)
        values = F.regexp_extract_all(text, rx, F.lit(group)) if group else found
        zipped = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("whole"), values.alias("value"))
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))

        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + F.length(x["gap"])
            end = begin + F.length(x["whole"])
            one = F.struct(begin.alias("start"), F.lit(number).alias("kind_no"), end.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
            return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

        return F.when(F.size(found) > 0, F.aggregate(zipped, start, step, lambda acc: acc["out"])).otherwise(none)

    spans = once(F.regexp_extract_all(text, rx, F.lit(0)), placed)
    return F.when(F.contains(text, F.lit(needs)), spans).otherwise(none) if needs else spans


def joined(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def base(spans: Column) -> Column:
    return F.filter(spans, lambda x: x["kind_no"] < BASE)


def count(spans: Column, number: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind_no"] == number)).cast("long")


def _varied(value: Column) -> Column:
    """Whether a value looks made by chance: several distinct characters, digits among them."""
    return (F.size(F.array_distinct(F.split(value, ""))) >= 8) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def ownership(candidates: DataFrame, max_owners: int = 2) -> DataFrame:
    """(hash, n_repositories, n_owners, copied) from rows (hash, owner, repository)."""
    by_owner = candidates.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n")).groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    out = by_owner.groupBy("hash").agg(F.sum("repositories").alias("n_repositories"), F.count("*").alias("n_owners"))
    return out.withColumn("copied", F.col("n_owners") > max_owners)


def scan(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", repository: str = "source", max_owners: int = 2, keep: tuple[str, ...] = (), kinds: tuple = KINDS, ungated: tuple[str, ...] = ()) -> DataFrame:
    """A row for each row of ``docs``: key, spans (start, kind_no, end, kind, hash) in order, live and
    copied (the numbers of the spans in ``spans`` judged so), and the columns of ``keep``.

    The owner is the part of the repository's name before the first slash. Values of the kinds in
    ``ungated`` are live by ownership alone.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    found = F.array_sort(F.flatten(F.array(*[_spans(whole, i, kinds) for i in range(len(kinds))])))
    hashed = F.transform(found, lambda x: F.struct(x["start"], x["kind_no"], x["end"], x["kind"], F.xxhash64(F.when((x["kind"] == "pem") & F.lit(kinds is WHOLE), F.regexp_replace(x["value"], "-----END.*|\\s|\\\\[nr]", "")).otherwise(x["value"])).alias("hash"), (_varied(x["value"]) | x["kind"].isin(*ungated) if ungated else _varied(x["value"])).alias("varied")))
    table = scratch.table(docs.select(F.col(key).alias("key"), F.col(repository).cast("string").alias("repository"), *[F.col(c).alias(f"kept_{c}") for c in keep], hashed.alias("spans")).withColumn("row", F.monotonically_increasing_id()), "secret_spans")
    owner = F.coalesce(F.substring_index("repository", "/", 1), F.lit(""))
    spans = table.where(F.size("spans") > 0).select("row", F.coalesce("repository", F.lit("")).alias("repository"), owner.alias("owner"), F.posexplode("spans").alias("no", "span"))
    rows = spans.select("row", "no", "repository", "owner", F.col("span.hash").alias("hash"), F.col("span.varied").alias("varied"))
    # dealt out once more, so that Spark can split the join at a value that very many rows hold
    owned = ownership(rows.select("hash", "owner", "repository"), max_owners).repartition("hash", "copied")
    judged = rows.join(owned, "hash")
    pick = lambda when: F.array_sort(F.collect_list(F.when(when, F.col("no"))))
    by_row = judged.groupBy("row").agg(pick(F.col("copied")).alias("copied"), pick(~F.col("copied") & F.col("varied")).alias("live"))
    empty = F.array().cast("array<int>")
    out = table.join(few(scratch.table(by_row, "judged", stay=True)), "row", "left")
    return out.select(*([] if key in keep else [F.col("key").alias(key)]), *[F.col(f"kept_{c}").alias(c) for c in keep], "spans", F.coalesce("live", empty).alias("live"), F.coalesce("copied", empty).alias("copied"))


def redacted(text: Column, spans: Column, numbers: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with the numbered spans replaced; overlapping ones give one mark."""
    chosen = F.transform(numbers, lambda i: spans[i])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), gap.alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(numbers) > 0, F.aggregate(chosen, start, step, rest)).otherwise(text)


def without_live(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", repository: str = "source", n_chars: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs`` with the live-looking spans of the text replaced, and n_chars of what it is then."""
    found = scan(docs, scratch, key, text, repository, keep=tuple(docs.columns), kinds=WHOLE, ungated=UNGATED)
    clean = redacted(F.col(text), F.col("spans"), F.col("live"))
    out = found.select(*[clean.alias(c) if c == text else F.col(c) for c in docs.columns])
    return out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType)).select(docs.columns) if n_chars in docs.columns else out
