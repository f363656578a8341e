"""Word splitting, vocabularies and learned subword tokenizers.

Splitting, counting and vocabularies are DataFrame expressions. A learner works on word counts (one
row a distinct word, aggregated by Spark); its merges or pieces are then applied by an Arrow UDF,
word by word with a cache.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.errors import EmptyInputError
from corvane.scratch import written
from corvane.sources.model_store import persistable


def whitespace(text: Column) -> Column:
    """Runs without (Unicode) white space."""
    return F.regexp_extract_all(text, F.lit("(?U)\\S+"), F.lit(0))


def pattern(text: Column, expression: str) -> Column:
    """Every match of a regular expression that isn't empty."""
    return F.filter(F.regexp_extract_all(text, F.lit(expression), F.lit(0)), lambda w: w != "")


def spans(text: str, expression: str = r"\S+") -> list[tuple[str, int, int]]:
    """(word, start, end) in code points."""
    return [(m[0], m.start(), m.end()) for m in re.finditer(expression, text) if m[0]]


def unicode_words(text: str, keep_punctuation: bool = False) -> list[str]:
    """Runs of letters, marks and digits, with single joiners (' . , :) between two of a kind."""
    out = [m[0] for m in re.finditer(r"(?:[^\W_]|\w(?<=_))+(?:['’.:](?=[^\W\d_])[^\W_]+|[.,](?=\d)\d+)*|\S", text)]
    return out if keep_punctuation else [w for w in out if any(unicodedata.category(c)[0] in "LN" for c in w)]


def word_counts(df: DataFrame, words: str) -> DataFrame:
    return df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


#: Words that are numbered in one task.
NUMBERED = 500_000


def vocabulary(counts: DataFrame, least: int = 1, limit: int | None = None) -> DataFrame:
    """(word, n, id): by count, then word. Distinct words are numbered by ranges, each in a task of its own."""
    kept = counts.where(F.col("n") >= least)
    kept = written(kept.orderBy(F.desc("n"), "word").limit(limit) if limit else kept, "vocabulary_words")
    order = [F.desc("n"), F.col("word")]
    parts = -(-kept.count() // NUMBERED)
    if parts <= 1:
        return kept.withColumn("id", F.row_number().over(Window.orderBy(*order)) - 1)
    dealt = written(kept.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "vocabulary_ranges")
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    offsets = dealt.groupBy("part").agg(F.count("*").alias("size")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return dealt.withColumn("within", within).join(F.broadcast(offsets), "part").select(*kept.columns, (F.col("before") + F.col("within")).cast("int").alias("id"))


def id_sequences(df: DataFrame, key: str, words: str, vocab: DataFrame) -> DataFrame:
    """(key, ids): the words' numbers in order; unknown ones are left out and neighbours close up."""
    at = df.select(key, F.posexplode(words).alias("pos", "word")).join(vocab.select("word", "id"), "word")
    return at.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))


def decoded(ids: DataFrame, key: str, column: str, vocab: DataFrame) -> DataFrame:
    """(key, words): the words of the numbers, in order; numbers that aren't in the vocabulary are left out."""
    at = ids.select(key, F.posexplode(column).alias("pos", "id")).join(vocab.select("word", "id"), "id")
    return at.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("words"))


@persistable
@dataclass
class MergeModel:
    """Byte-pair or word-piece merges. ``mark`` closes a word's last symbol; ``prefix`` opens all but the first."""

    merges: list[list[str]]
    alphabet: list[str]
    mark: str = "</w>"
    prefix: str = ""
    unknown: str = "[UNK]"
    ranks: dict = field(default_factory=dict)

    def symbols(self, word: str) -> list[str]:
        return spell(word, self.mark, self.prefix)

    def pieces(self, word: str) -> list[str]:
        """The earliest merge first, everywhere, until none applies."""
        ranks = self.ranks or {(a, b): i for i, (a, b) in enumerate(self.merges)}
        self.ranks = ranks
        now = self.symbols(word)
        while len(now) > 1:
            best = min(range(len(now) - 1), key=lambda i: ranks.get((now[i], now[i + 1]), math.inf))
            pair = (now[best], now[best + 1])
            if pair not in ranks:
                break
            now = apply_merge(now, pair, self.prefix)
        known = set(self.alphabet)
        return [p if len(p) > 1 or p in known or self.mark and p.endswith(self.mark) else self.unknown for p in now]

    def tokens(self) -> list[str]:
        return [*self.alphabet, *(joined(a, b, self.prefix) for a, b in self.merges)]


def spell(word: str, mark: str = "</w>", prefix: str = "") -> list[str]:
    out = [c if i == 0 else prefix + c for i, c in enumerate(word)]
    return [*out[:-1], out[-1] + mark] if out else []


def joined(a: str, b: str, prefix: str = "") -> str:
    return a + (b[len(prefix):] if prefix and b.startswith(prefix) else b)


def apply_merge(symbols: Sequence[str], pair: tuple[str, str], prefix: str = "") -> list[str]:
    out, i = [], 0
    while i < len(symbols):
        if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
            out.append(joined(*pair, prefix))
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def pair_counts(counts: DataFrame, mark: str = "</w>") -> DataFrame:
    """(left, right, n): neighbouring symbols of the words, weighted by the words' counts."""
    letters = F.filter(F.split("word", ""), lambda c: c != "")
    marked = F.transform(letters, lambda c, i: F.when(i == F.size(letters) - 1, F.concat(c, F.lit(mark))).otherwise(c))
    spelled = counts.where(F.length("word") > 1).select(marked.alias("s"), "n")
    pairs = spelled.select(F.explode(F.arrays_zip(F.slice("s", 1, F.size("s") - 1).alias("left"), F.slice("s", 2, F.size("s") - 1).alias("right"))).alias("p"), "n")
    return pairs.groupBy("p.left", "p.right").agg(F.sum("n").alias("n"))


def learn_merges(words: dict[str, int], n_merges: int, least: int = 2, likelihood: bool = False, mark: str = "</w>", prefix: str = "") -> MergeModel:
    """Greedy merges of the most frequent pair (or the one with the greatest n / (n_left * n_right));
    ties go to the lesser pair. Only words with the merged pair are counted anew."""
    spelled = {w: spell(w, mark, prefix) for w in words}
    alphabet = sorted({s for x in spelled.values() for s in x})
    pairs: Counter = Counter()
    where: dict[tuple[str, str], set[str]] = {}
    single: Counter = Counter()
    for w, x in spelled.items():
        for s in x:
            single[s] += words[w]
        for p in zip(x, x[1:], strict=False):
            pairs[p] += words[w]
            where.setdefault(p, set()).add(w)
    merges = []
    while len(merges) < n_merges:
        score = (lambda p: pairs[p] / (single[p[0]] * single[p[1]])) if likelihood else (lambda p: pairs[p])
        fit = [p for p, n in pairs.items() if n >= least]
        if not fit:
            break
        top = max(map(score, fit))
        best = min(p for p in fit if score(p) == top)
        merges.append(list(best))
        for w in where.pop(best):
            old, n = spelled[w], words[w]
            new = apply_merge(old, best, prefix)
            for s in old:
                single[s] -= n
            for s in new:
                single[s] += n
            for p in zip(old, old[1:], strict=False):
                pairs[p] -= n
            for p in zip(new, new[1:], strict=False):
                pairs[p] += n
                where.setdefault(p, set()).add(w)
            spelled[w] = new
        pairs = Counter({p: n for p, n in pairs.items() if n > 0})
    return MergeModel(merges, alphabet, mark, prefix)


def learn(counts: DataFrame, n_merges: int, most_words: int = 200_000, **options) -> MergeModel:
    """From (word, n), all of them: up to ``most_words`` words on the driver, more by ``learn_spread``."""
    counts = written(counts.select("word", "n"), "words")
    n = counts.count()
    if not n:
        raise EmptyInputError("no words to learn from")
    if n > most_words:
        return learn_spread(counts, n_merges, **options)
    return learn_merges({r["word"]: r["n"] for r in counts.collect()}, n_merges, **options)


def learn_spread(counts: DataFrame, n_merges: int, least: int = 2, likelihood: bool = False, mark: str = "</w>", prefix: str = "", keep_every: int = 16) -> MergeModel:
    """The merges of ``learn_merges`` with the words left in Spark: an aggregation of pairs for each merge.

    A word is a string of symbols between two control characters, so a merge is one replacement; the
    words are written now and then, which cuts the lineage.
    """
    head, tail = "\x01", "\x02"
    letters = F.filter(F.split("word", ""), lambda c: c != "")
    last = F.size(letters) - 1
    symbols = F.transform(letters, lambda c, i: F.concat(F.when(i > 0, prefix).otherwise(""), c, F.when(i == last, mark).otherwise("")))
    now = written(counts.where(F.length("word") > 0).select(F.concat(F.lit(head), F.array_join(symbols, tail + head), F.lit(tail)).alias("s"), "n"), "spelled")
    split = lambda df: df.select(F.split(F.expr("substring(s, 2, length(s) - 2)"), tail + head).alias("x"), "n")
    alphabet = sorted(r["c"] for r in split(now).select(F.explode("x").alias("c")).distinct().collect())
    merges: list[list[str]] = []
    while len(merges) < n_merges:
        pairs = split(now).where(F.size("x") > 1).select(F.explode(F.arrays_zip(F.slice("x", 1, F.size("x") - 1).alias("l"), F.slice("x", 2, F.size("x") - 1).alias("r"))).alias("p"), "n").groupBy("p.l", "p.r").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        if likelihood:
            single = split(now).select(F.explode("x").alias("c"), "n").groupBy("c").agg(F.sum("n").alias("m"))
            pairs = pairs.join(single.select(F.col("c").alias("l"), F.col("m").alias("lm")), "l").join(single.select(F.col("c").alias("r"), F.col("m").alias("rm")), "r").withColumn("score", F.col("n") / (F.col("lm") * F.col("rm")))
        else:
            pairs = pairs.withColumn("score", F.col("n"))
        best = pairs.orderBy(F.desc("score"), "l", "r").first()
        if best is None:
            break
        a, b = best["l"], best["r"]
        merges.append([a, b])
        now = now.withColumn("s", F.replace("s", F.lit(f"{head}{a}{tail}{head}{b}{tail}"), F.lit(f"{head}{joined(a, b, prefix)}{tail}")))
        if len(merges) % keep_every == 0:
            now = written(now, "spelled")
    return MergeModel(merges, alphabet, mark, prefix)


def greedy_pieces(word: str, pieces: set[str], prefix: str = "##", unknown: str = "[UNK]", longest: int = 100) -> list[str]:
    """The longest known piece first; a word that can't be covered is unknown as a whole."""
    if len(word) > longest:
        return [unknown]
    out, i = [], 0
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if (prefix if i else "") + word[i:j] in pieces), None)
        if j is None:
            return [unknown]
        out.append((prefix if i else "") + word[i:j])
        i = j
    return out


def best_segmentation(word: str, log_p: dict[str, float], longest: int = 16, fewest: bool = False) -> list[str] | None:
    """The likeliest pieces (or the fewest), by a shortest path."""
    best: list[tuple[float, int]] = [(0.0, 0)] + [(-math.inf, -1)] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - longest), j):
            piece = word[i:j]
            if best[i][0] > -math.inf and piece in log_p:
                s = best[i][0] + (-1.0 if fewest else log_p[piece])
                if s > best[j][0]:
                    best[j] = (s, i)
    if best[-1][0] == -math.inf:
        return None
    out, j = [], len(word)
    while j:
        out.append(word[best[j][1]:j])
        j = best[j][1]
    return out[::-1]


def expected_pieces(words: Iterable[tuple[str, int]], now: dict[str, float], longest: int = 16) -> Counter:
    """How often each piece is expected in the words' segmentations, by the words' counts."""
    expected: Counter = Counter()
    for w, n in words:
        a = [0.0] + [-math.inf] * len(w)
        for j in range(1, len(w) + 1):
            terms = [a[i] + now[w[i:j]] for i in range(max(0, j - longest), j) if w[i:j] in now]
            top = max(terms, default=-math.inf)
            a[j] = top + math.log(sum(math.exp(t - top) for t in terms)) if top > -math.inf else top
        b = [-math.inf] * len(w) + [0.0]
        for i in range(len(w) - 1, -1, -1):
            terms = [now[w[i:j]] + b[j] for j in range(i + 1, min(len(w), i + longest) + 1) if w[i:j] in now]
            top = max(terms, default=-math.inf)
            b[i] = top + math.log(sum(math.exp(t - top) for t in terms)) if top > -math.inf else top
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + longest) + 1):
                if w[i:j] in now:
                    expected[w[i:j]] += n * math.exp(a[i] + now[w[i:j]] + b[j] - a[-1])
    return expected


def _pruned(letters: set[str], table: dict[str, float], expect: Callable[[dict[str, float]], dict[str, float]], size: int, shrink: float, rounds: int) -> dict[str, float]:
    """EM rounds over ``expect`` and pruning to ``size``."""

    def logs(t: dict[str, float]) -> dict[str, float]:
        whole = math.log(sum(t.values()))
        return {s: math.log(v) - whole for s, v in t.items()}

    now = logs(table)
    while True:
        for _ in range(rounds):
            expected = Counter(dict.fromkeys(sorted(letters), 1e-3))
            expected.update(expect(now))
            now = logs({s: v for s, v in expected.items() if v > 1e-9})
        if len(now) <= size:
            return now
        keep = max(size, int(len(now) * shrink))
        order = sorted((s for s in now if len(s) > 1), key=lambda s: (-now[s], s))
        now = logs({s: math.exp(now[s]) for s in [*letters, *order[: max(0, keep - len(letters))]] if s in now})
        if len(now) <= max(size, len(letters)):
            return now


def learn_unigram(words: dict[str, int], size: int, seed_size: int = 1000, longest: int = 16, shrink: float = 0.75, rounds: int = 2) -> dict[str, float]:
    """Pieces and log probabilities: from common substrings, EM rounds and pruning to ``size``; letters always stay."""
    subs: Counter = Counter()
    for w, n in words.items():
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + longest) + 1):
                subs[w[i:j]] += n
    letters = {s for s in subs if len(s) == 1}
    ranked = sorted((s for s in subs if len(s) > 1), key=lambda s: (-subs[s] * len(s), s))[:seed_size]
    return _pruned(letters, {s: float(subs[s]) for s in [*letters, *ranked]}, lambda now: expected_pieces(words.items(), now, longest), size, shrink, rounds)


def learn_unigram_from(counts: DataFrame, size: int, seed_size: int = 1000, longest: int = 16, shrink: float = 0.75, rounds: int = 2) -> dict[str, float]:
    """``learn_unigram`` from all rows (word, n): substrings are counted and each EM round is summed in
    Spark; the driver has the letters and ``seed_size`` pieces."""
    counts = written(counts.where(F.length("word") > 0).select("word", "n"), "unigram_words")
    cuts = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - i + 1)), lambda k: F.substr("word", i, k)))
    subs = written(counts.select(F.explode(F.flatten(cuts)).alias("piece"), "n").groupBy("piece").agg(F.sum("n").alias("n")), "unigram_substrings")
    letters = {r["piece"]: float(r["n"]) for r in subs.where(F.length("piece") == 1).orderBy("piece").collect()}
    if not letters:
        raise EmptyInputError("no words to learn from")
    ranked = subs.where(F.length("piece") > 1).orderBy(F.desc(F.col("n") * F.length("piece")), "piece").limit(seed_size).collect()

    def expect(now: dict[str, float]) -> dict[str, float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = expected_pieces(zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True), now, longest)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.float64())], ["piece", "n"])

        sums = counts.mapInArrow(run, "piece string, n double").groupBy("piece").agg(F.round(F.sum("n"), 9).alias("n"))  # whatever the order of the sum
        return {r["piece"]: r["n"] for r in sums.orderBy("piece").collect()}

    return _pruned(set(letters), letters | {r["piece"]: float(r["n"]) for r in ranked}, expect, size, shrink, rounds)


def encode_words(df: DataFrame, key: str, words: str, pieces, name: str = "pieces") -> DataFrame:
    """(key, pieces): ``pieces(word)`` of every word, each distinct word of a batch once."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        for batch in batches:
            if len(known) > 500_000:
                known = {}
            out = []
            for row in batch.column("words").to_pylist():
                for w in row or ():
                    if w not in known:
                        known[w] = pieces(w)
                out.append([p for w in row or () for p in known[w]])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.list_(pa.string()))], ["key", name])

    return df.select(F.col(key).alias("key"), F.col(words).alias("words")).mapInArrow(run, f"key {kind}, {name} array<string>").withColumnRenamed("key", key)


def maximum_matching(text: str, dictionary: set[str], backward: bool = False) -> list[str]:
    """The longest dictionary word at each place; a letter alone where none fits."""
    longest = max(map(len, dictionary), default=1)
    out, rest = [], text
    while rest:
        if backward:
            n = next((n for n in range(min(longest, len(rest)), 1, -1) if rest[-n:] in dictionary), 1)
            out.append(rest[-n:])
            rest = rest[:-n]
        else:
            n = next((n for n in range(min(longest, len(rest)), 1, -1) if rest[:n] in dictionary), 1)
            out.append(rest[:n])
            rest = rest[n:]
    return out[::-1] if backward else out


def bidirectional_matching(text: str, dictionary: set[str]) -> list[str]:
    """Of the matches from the front and from the back, the one of fewer words, then of fewer single letters,
    then the one from the back."""
    both = [maximum_matching(text, dictionary, True), maximum_matching(text, dictionary)]
    return min(both, key=lambda x: (len(x), sum(len(w) == 1 for w in x)))


def character_type(character: str) -> str:
    """digit, roman, hiragana, katakana, kanji, letter (of another script), space, punctuation or other."""
    kind, name = unicodedata.category(character), unicodedata.name(character, "")
    if kind == "Nd":
        return "digit"
    for start, found in (("LATIN", "roman"), ("FULLWIDTH LATIN", "roman"), ("HIRAGANA", "hiragana"), ("KATAKANA", "katakana"), ("HALFWIDTH KATAKANA", "katakana"), ("CJK UNIFIED", "kanji"), ("CJK COMPATIBILITY IDEOGRAPH", "kanji")):
        if name.startswith(start):
            return found
    return {"L": "letter", "Z": "space", "P": "punctuation"}.get(kind[0], "space" if character.isspace() else "other")


def token_count(word: str, pieces: set[str]) -> int | None:
    """The fewest pieces that spell the word; None where none do."""
    least: list[int | None] = [0] + [None] * len(word)
    longest = max(map(len, pieces), default=0)
    for j in range(1, len(word) + 1):
        ways = [least[i] + 1 for i in range(max(0, j - longest), j) if least[i] is not None and word[i:j] in pieces]
        least[j] = min(ways, default=None)
    return least[-1]


def corpus_token_count(words: dict[str, int], pieces: set[str]) -> int:
    """Over all words by their counts; a word that can't be spelled counts a token a letter."""
    return sum(n * (len(w) if (k := token_count(w, pieces)) is None else k) for w, n in words.items())


def token_count_increases(words: dict[str, int], pieces: set[str]) -> dict[str, int]:
    """By how much the corpus's tokens grow if one piece of several letters goes; only words that hold it count anew."""
    own = {w: corpus_token_count({w: n}, pieces) for w, n in words.items()}
    return {p: sum(corpus_token_count({w: n}, pieces - {p}) - own[w] for w, n in words.items() if p in w) for p in pieces if len(p) > 1}


def learn_shortest_path_pieces(words: dict[str, int], size: int, longest: int = 8, least: int = 2, share: float = 0.2) -> set[str]:
    """From all frequent substrings, those go whose loss costs the fewest tokens (ties: the greater piece first),
    a ``share`` of what is too many at a time, until ``size`` are left; single letters always stay."""
    seen: Counter = Counter()
    for w, n in words.items():
        for i in range(len(w)):
            for j in range(i + 2, min(len(w), i + longest) + 1):
                seen[w[i:j]] += n
    letters = {c for w in words for c in w}
    pieces = letters | {p for p, n in seen.items() if n >= least}
    while len(pieces) > max(size, len(letters)):
        cost = token_count_increases(words, pieces)
        n = max(1, math.ceil((len(pieces) - max(size, len(letters))) * share))
        order = sorted(cost, key=lambda p: (cost[p], [-ord(c) for c in p]))
        pieces -= set(order[:n])
    return pieces


#: The sign that stands for a space (fixed value).
MARKER = "▁"


def marked_words(text: Column) -> Column:
    """Raw text as words that begin with the marker, so that joining them gives the text with single spaces."""
    return F.transform(F.filter(F.split(text, "\\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(MARKER), w))


def unmarked(pieces: Sequence[str]) -> str:
    return "".join(pieces).replace(MARKER, " ").removeprefix(" ")


def sentence_pieces(df: DataFrame, key: str, text: str, n_merges: int, **options) -> DataFrame:
    """(key, pieces): merges learned over marked words of raw text, and each text in them."""
    rows = df.select(key, marked_words(F.col(text)).alias("words"))
    model = learn(word_counts(rows, "words"), n_merges, mark="", **options)
    return encode_words(rows, key, "words", model.pieces)


def lattice(text: str, frequencies: dict[str, int]) -> list[str]:
    """The path of dictionary words with the greatest probability; unknown letters cost one count."""
    whole = math.log(sum(frequencies.values()))
    logs = {w: math.log(n) - whole for w, n in frequencies.items() if n > 0}
    for c in text:
        logs.setdefault(c, -whole)
    return best_segmentation(text, logs, max(map(len, logs))) or []


#: Place tags of letters in words: begin, middle, end, single.
TAGS = "BMES"


def tag_counts(df: DataFrame, words: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(starts, steps, emissions) of letters tagged by their place in words of cut sentences."""
    letters = F.flatten(F.transform(words, lambda w: F.when(F.length(w) == 1, F.array(F.struct(w.alias("c"), F.lit("S").alias("t")))).otherwise(F.transform(F.filter(F.split(w, ""), lambda c: c != ""), lambda c, i: F.struct(c.alias("c"), F.when(i == 0, "B").when(i == F.length(w) - 1, "E").otherwise("M").alias("t"))))))
    tagged = df.select(letters.alias("x")).where(F.size("x") > 0)
    starts = tagged.groupBy(F.col("x")[0]["t"].alias("tag")).agg(F.count("*").alias("n"))
    pairs = tagged.where(F.size("x") > 1).select(F.explode(F.arrays_zip(F.slice("x.t", 1, F.size("x") - 1).alias("s"), F.slice("x.t", 2, F.size("x") - 1).alias("t"))).alias("p"))
    emitted = tagged.select(F.explode("x").alias("e")).groupBy("e.t", "e.c").agg(F.count("*").alias("n"))
    return starts, pairs.groupBy("p.s", "p.t").agg(F.count("*").alias("n")), emitted


def viterbi(text: str, starts: dict[str, float], steps: dict[tuple[str, str], float], emissions: dict[tuple[str, str], float], smoothing: float = 1.0) -> list[str]:
    """Words by the likeliest tags, counts smoothed by ``smoothing``."""
    if not text:
        return []
    tags, letters = TAGS, {c for _, c in emissions}
    log = lambda n, d, k: math.log((n + smoothing) / (d + smoothing * k))
    out_of = {s: sum(steps.get((s, t), 0) for t in tags) for s in tags}
    of = {s: sum(n for (t, _), n in emissions.items() if t == s) for s in tags}
    follows = {"B": "ME", "M": "ME", "E": "BS", "S": "BS"}
    emit = lambda t, c: log(emissions.get((t, c), 0), of[t], len(letters) + 1)
    now = {t: (log(starts.get(t, 0), sum(starts.values()), 2) + emit(t, text[0]), [t]) for t in "BS"}
    for c in text[1:]:
        now = {t: max((s + log(steps.get((p, t), 0), out_of[p], 2) + emit(t, c), [*path, t]) for p, (s, path) in now.items() if t in follows[p]) for t in tags if any(t in follows[p] for p in now)}
    path = max(v for t, v in now.items() if t in "ES")[1] if any(t in "ES" for t in now) else max(now.values())[1]
    words, word = [], ""
    for c, t in zip(text, path, strict=True):
        word += c
        if t in "ES":
            words.append(word)
            word = ""
    return [*words, word] if word else words
