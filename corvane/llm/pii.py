"""Personal data: candidate spans, boosted trees and calibrated thresholds.

Base patterns (e-mail, IP address, card, phone) give spans that always stay. Further generators
propose, with high recall, spans of other kinds, which may overlap each other and the base spans.
For each proposal, features of its format (digits, separators, check sums) and of the words around
it go through gradient-boosted trees, and a proposal becomes a span if its calibrated probability reaches
its kind's threshold and it overlaps no span before it. The trees learn from examples that
``examples`` writes from templates with a fixed seed, true data beside look-alikes (order numbers,
versions, dates); the thresholds are the least ones with a precision of ``precision`` on examples that
neither trees nor calibration saw.

Defined cases: a null text is empty; every row gives a row; extra columns aren't looked at.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import boosted_trees
from corvane.llm.common import sliced

BASE = ("email", "ip", "card", "phone")
#: Patterns of the base kinds (fixed values).
LOCAL, DOMAIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Generators of further kinds, and words that often stand before them (fixed values).
MORE = (
    ("national_id", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), ("ssn", "social", "security", "national", "insurance", "id")),
    ("iban", re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])"), ("iban", "account", "bank", "konto", "compte", "cuenta")),
    ("local_phone", re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9-])"), ("phone", "call", "tel", "mobile", "fax", "cell", "telefon", "appelez")),
    # card and account numbers that don't pass Luhn (mistyped ones, other schemes), where a word says so; those that do are base spans
    ("account", re.compile(r"(?<![0-9A-Za-z.-])[0-9]{4}(?:[\x20-]?[0-9]{4}){2}[\x20-]?[0-9]{1,7}(?![0-9A-Za-z-])"), ("card", "visa", "credit", "debit", "account", "pay", "konto", "tarjeta", "carte")),
)
KINDS = BASE + tuple(k for k, _, _ in MORE)
_DIGIT = re.compile("[0-9]")
#: Words before look-alikes (fixed values).
OTHER = ("order", "version", "part", "ticket", "item", "page", "ref", "build", "serial", "model")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def mod97(value: str) -> bool:
    value = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``: found from each @, so that a long
    run of letters without one costs nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start."""
    out = [(0, start, end) for start, end in emails(text)]
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def proposals(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the further kinds; they may overlap."""
    if not _DIGIT.search(text):
        return []
    return [(len(BASE) + i, m.start(), m.end()) for i, (_, pattern, _) in enumerate(MORE) for m in pattern.finditer(text)]


def features(text: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
    rows = []
    for kind, start, end in spans:
        value, before = text[start:end], text[max(0, start - 40) : start].lower()
        near = re.findall(r"[a-z]+", before)[-4:]
        digits = re.sub("[^0-9]", "", value)
        groups = re.findall("[0-9]+", value)
        cues = MORE[kind - len(BASE)][2]
        rows.append([
            kind, len(value), len(digits), len(value) - len(digits), len(set(digits)), float(any(w.startswith(c) for w in near for c in cues)), float(any(w.startswith(c) for w in near for c in OTHER)),
            float(text[start - 1 : start] in ("", " ", "\n", "(", ":")), float(text[end : end + 1] in ("", " ", "\n", ",", ".", ")", ";")), float(mod97(value)) if kind == len(BASE) + 1 else 0.5,
            float(groups[0] in ("000", "666") or groups[0][0] == "9") if groups else 0.0, float(digits[:1] in ("0", "1")), float("#" in before[-6:]),
        ])
    return np.array(rows, float).reshape(len(rows), 13)


def examples(n: int = 3000, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Features of written examples, and whether each is personal data."""
    draw = random.Random(seed)
    digits = lambda k: "".join(draw.choice("0123456789") for _ in range(k))
    x, y = [], []
    while len(y) < n:
        kind, true = draw.randrange(len(MORE)), draw.random() < 0.5
        cue = draw.choice(MORE[kind][2] if true else OTHER) if draw.random() < 0.8 else draw.choice(("the", "and", "with", "at"))
        if kind == 0:
            first = str(draw.randint(100, 665)) if true else draw.choice(("000", "666", digits(3), str(draw.randint(900, 999))))
            value = f"{first}-{digits(2)}-{digits(4)}"
        elif kind == 1:
            country, body = draw.choice(("DE", "FR", "ES", "GB")), digits(18)
            check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
            value = f"{country}{check if true else (check + draw.randint(1, 90)) % 97:02d}{body}"
            value = " ".join(value[i : i + 4] for i in range(0, len(value), 4)) if draw.random() < 0.5 else value
        elif kind == 3:
            # look-alikes are times in milliseconds, article numbers, dates with times, and any long number without a word that says otherwise
            value = digits(draw.choice((15, 16, 16, 16, 17, 18, 19))) if true else draw.choice((digits(16), digits(draw.randint(13, 19)), f"1{draw.randint(4, 7)}{digits(11)}", f"97{draw.choice('89')}{digits(10)}", f"20{draw.randint(10, 30)}{draw.randint(10, 12)}{draw.randint(10, 28)}{digits(6)}"))
            value = draw.choice((" ", "-")).join(value[i : i + 4] for i in range(0, len(value), 4)) if true and draw.random() < 0.3 else value
        else:
            a = str(draw.randint(201, 989)) if true else digits(3)
            mark = draw.choice("-. ")
            value = f"({a}) {digits(3)}-{digits(4)}" if true and draw.random() < 0.4 else f"{a}{mark}{digits(3)}{mark}{digits(4)}"
        text = f"{draw.choice(('', 'so it was '))}{cue}{draw.choice((': ', ' ', ' is ', ' no. ') if true else (' #', ' ', ' no. ', '/'))}{value}{draw.choice((' then', '.', ',', ''))}"
        found = [s for s in proposals(text) if s[0] == len(BASE) + kind]
        if len(found) == 1:
            x.append(features(text, found)[0])
            y.append(float(true))
    return np.array(x), np.array(y)


@lru_cache(maxsize=2)
def trained(precision: float = 0.98) -> tuple[boosted_trees.Model, np.ndarray]:
    """The trees and each kind's threshold, always the same ones."""
    x, y = examples()
    model = boosted_trees.fit(x, y)
    x, y = examples(seed=8)
    p, limits = model.probability(x), np.ones(len(KINDS)) * 2.0
    for kind in range(len(BASE), len(KINDS)):
        of = x[:, 0] == kind
        for limit in np.unique(np.round(p[of], 3)):
            if y[of][p[of] >= limit].mean() >= precision:
                limits[kind] = limit
                break
    return model, limits


def all_spans(text: str, model: boosted_trees.Model, limits: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), by kind, then start."""
    base = base_spans(text)
    more = proposals(text)
    if not more:
        return base, base
    p = model.probability(features(text, more))
    taken = [(s, e) for _, s, e in base]
    kept = list(base)
    for i in np.argsort(-p, kind="stable"):
        kind, start, end = more[i]
        if p[i] >= limits[kind] and all(e <= start or s >= end for s, e in taken):
            taken.append((start, end))
            kept.append(more[i])
    return base, sorted(kept)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", precision: float = 0.98) -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, n_spans, base string, spans string) for each row of ``docs``."""
    kind = docs.schema[key].dataType.simpleString()
    model, limits = trained(precision)
    shared = docs.sparkSession.sparkContext.broadcast((model, limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, limits = shared.value
        for batch in sliced(batches):
            found = [all_spans(x or "", model, limits) for x in batch.column("text").to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(BASE))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *counts, pa.array([len(a) for _, a in found], pa.int64()), pa.array([_joined(b) for b, _ in found], pa.string()), pa.array([_joined(a) for _, a in found], pa.string())], ["key", *[f"n_{k}" for k in BASE], "n_spans", "base", "spans"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, {', '.join(f'n_{k} long' for k in BASE)}, n_spans long, base string, spans string").withColumnRenamed("key", key)
