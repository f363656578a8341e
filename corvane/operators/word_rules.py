"""Word splitters by rules, for use batch by batch: treebank, phrase-based translation, and rules with exceptions.

Each returns (word, start, end) with places in the text, so nothing is lost where a written form changes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Span = tuple[str, int, int]

#: Treebank conventions (fixed values): contractions cut in two, and brackets' written forms.
CUT_AT = {"cannot": 3, "gonna": 3, "gotta": 3, "lemme": 3, "wanna": 3, "gimme": 3, "d'ye": 1, "more'n": 4, "'tis": 2, "'twas": 2}
BRACKETS = {"(": "-LRB-", ")": "-RRB-", "[": "-LSB-", "]": "-RSB-", "{": "-LCB-", "}": "-RCB-"}
CLITIC = re.compile(r"(?i)(n't|'ll|'re|'ve|'s|'m|'d|')$")
PUNCTUATION = re.compile(r"\.\.\.|--|``|''|[][(){}<>,;:@#$%&?!\"“”]")
#: Abbreviations that keep their full stop (fixed values).
ABBREVIATIONS = {"en": {"mr", "mrs", "ms", "dr", "prof", "st", "vs", "etc", "no", "jr", "sr", "inc", "ltd", "co", "gen", "rev", "fig"}, "de": {"dr", "prof", "nr", "bzw", "usw", "z.b", "hr", "fr"}, "fr": {"m", "mm", "dr", "av", "p"}, "es": {"sr", "sra", "dr", "dra", "ud", "uds"}}


def _chunks(text: str) -> Iterator[Span]:
    for m in re.finditer(r"\S+", text):
        yield m[0], m.start(), m.end()


def treebank(text: str, brackets: bool = False, quotes: bool = True) -> list[Span]:
    """Punctuation apart, clitics cut off, the last full stop of the text apart; double quotes are written as
    `` where they open (at a word's start or after an opening bracket) and as '' where they close."""
    out: list[Span] = []
    chunks = list(_chunks(text))
    for k, (chunk, start, _) in enumerate(chunks):
        at, parts = 0, []
        for m in PUNCTUATION.finditer(chunk):
            if m[0] in ",:" and 0 < m.start() < len(chunk) - 1 and chunk[m.start() - 1].isdigit() and chunk[m.end()].isdigit():
                continue  # a number's separator
            parts += [(chunk[at : m.start()], at), (m[0], m.start())]
            at = m.end()
        parts.append((chunk[at:], at))
        parts = [p for p in parts if p[0]]
        for i, (word, place) in enumerate(parts):
            pieces = [(word, place)]
            closing = all(not any(c.isalnum() for c in w) for w, _ in parts[i + 1 :])
            if word.endswith(".") and len(word) > 1 and k == len(chunks) - 1 and closing and word != "...":
                pieces = [(word[:-1], place), (".", place + len(word) - 1)]
            head, where = pieces[0]
            low = head.lower()
            if low in CUT_AT:
                pieces[:1] = [(head[: CUT_AT[low]], where), (head[CUT_AT[low] :], where + CUT_AT[low])]
            else:
                cut = CLITIC.search(head)
                if cut and cut.start() > 0:
                    pieces[:1] = [(head[: cut.start()], where), (head[cut.start() :], where + cut.start())]
                elif head.startswith("'") and len(head) > 1:
                    pieces[:1] = [("'", where), (head[1:], where + 1)]
            for w, p in pieces:
                shown = BRACKETS.get(w, w) if brackets else w
                if quotes and w in ('"', "“", "”"):
                    opens = w == "“" or (w == '"' and (p == 0 or chunk[p - 1] in "([{<"))
                    shown = "``" if opens else "''"
                out.append((shown, start + p, start + p + len(w)))
    return out


def translation(text: str, language: str = "en", split_hyphens: bool = False, escape: bool = False) -> list[Span]:
    """Other signs apart; full stops stay in abbreviations, single letters and before lower case; apostrophes by language."""
    out: list[Span] = []
    keep = ABBREVIATIONS.get(language, set())
    signs = re.compile(r"\.{2,}|[^\w\s.,'’-]|[,]" + (r"|(?<=\w)-(?=\w)" if split_hyphens else ""))
    chunks = list(_chunks(text))
    for k, (chunk, start, _) in enumerate(chunks):
        at, parts = 0, []
        for m in signs.finditer(chunk):
            if m[0] == "," and 0 < m.start() < len(chunk) - 1 and chunk[m.start() - 1].isdigit() and chunk[m.end()].isdigit():
                continue
            parts += [(chunk[at : m.start()], at), (m[0], m.start())]
            at = m.end()
        parts.append((chunk[at:], at))
        for word, place in parts:
            if not word:
                continue
            pieces = [(word, place)]
            if len(word) > 1 and word.endswith(".") and set(word) != {"."}:
                stem = word[:-1].lower()
                follows = chunks[k + 1][0][:1] if k + 1 < len(chunks) else ""
                if not (stem in keep or "." in stem and any(c.isalpha() for c in stem) or len(stem) == 1 and stem.isalpha() and follows or follows.islower()):
                    pieces = [(word[:-1], place), (".", place + len(word) - 1)]
            head, where = pieces[0]
            mark = re.search(r"(?<=\w)['’](?=\w)", head)
            if mark and language in ("fr", "it"):
                pieces[:1] = [(head[: mark.end()], where), (head[mark.end() :], where + mark.end())]
            elif mark:
                pieces[:1] = [(head[: mark.start()], where), (head[mark.start() :], where + mark.start())]
            out += [(w, start + p, start + p + len(w)) for w, p in pieces if w]
    if escape:
        table = str.maketrans({"&": "&amp;", "|": "&#124;", "<": "&lt;", ">": "&gt;", "'": "&apos;", '"': "&quot;", "[": "&#91;", "]": "&#93;"})
        out = [(w.translate(table), a, b) for w, a, b in out]
    return out


def with_exceptions(text: str, prefixes: Sequence[str] = (), suffixes: Sequence[str] = (), infixes: Sequence[str] = (), exceptions: Mapping[str, Sequence[str]] | None = None) -> list[Span]:
    """Affixes (regular expressions) are cut from each chunk until nothing changes; exceptions win at every step."""
    exceptions = exceptions or {}
    head = re.compile("|".join(f"(?:{p})" for p in prefixes)) if prefixes else None
    tail = re.compile("|".join(f"(?:{s})$" for s in suffixes)) if suffixes else None
    inner = re.compile("|".join(f"(?:{i})" for i in infixes)) if infixes else None
    out: list[Span] = []
    for chunk, start, end in _chunks(text):
        before, after = [], []
        while start < end:
            word = text[start:end]
            if word in exceptions:
                break
            m = head.match(word) if head else None
            if m and 0 < m.end() < len(word):
                before.append((m[0], start, start + m.end()))
                start += m.end()
                continue
            m = tail.search(word) if tail else None
            if m and 0 < m.start() < len(word):
                after.append((m[0], start + m.start(), end))
                end = start + m.start()
                continue
            break
        middle, word = [], text[start:end]
        if word in exceptions:
            for piece in exceptions[word]:
                middle.append((piece, start, start + len(piece)))
                start += len(piece)
        else:
            at = 0
            for m in inner.finditer(word) if inner else ():
                if 0 < m.start() and m.end() < len(word) and m[0]:
                    middle += [(word[at : m.start()], start + at, start + m.start()), (m[0], start + m.start(), start + m.end())]
                    at = m.end()
            middle.append((word[at:], start + at, end))
        out += [s for s in [*before, *middle, *after[::-1]] if s[0]]
    return out


def split(df: DataFrame, key: str, text: str, rule, **options) -> DataFrame:
    """(key, words array<struct<text, start, end>>) by one of the rules above; null texts have no words."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            words = [[{"text": w, "start": a, "end": b} for w, a, b in rule(x or "", **options)] for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(words, shape)], ["key", "words"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, words array<struct<text:string,start:int,end:int>>").withColumnRenamed("key", key)
