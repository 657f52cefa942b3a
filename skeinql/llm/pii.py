"""PII: exact patterns for four kinds, and a conditional random field for what they miss.

The field is trained at start from a small labelled table (pii_labels.tsv) and labels words by shape, as
the first or a later word of a span, so that neighbours of one kind stay apart.
Words without a digit or @ can only be O, so the best path falls apart into runs of the other words,
which Viterbi decodes in numpy batches by length.
A run that the patterns cover already, or in part, adds nothing.
"""

from __future__ import annotations

import hashlib
import pkgutil
import re
from collections import defaultdict
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import appended, id_text, named, plain, table
from .crf import CRF, KINDS, LABELS, SPECIAL, TRIM, luhn

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: The next three match what the plain patterns match, without going over a run of digits again.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DIGIT = re.compile("[0-9]")

#: The labelled table: a word a line, with its row and label.
TRAINING = "pii_labels.tsv"


def training_rows(table_text: str | None = None) -> list[list[tuple[str, str]]]:
    """Rows of (word, label) of a labelled table, the one that lies beside this module by default."""
    raw = table_text if table_text is not None else pkgutil.get_data(__package__, TRAINING).decode()
    rows: dict[str, list[tuple[str, str]]] = {}
    for line in raw.splitlines()[1:]:
        row, word, label = line.split("\t")
        rows.setdefault(row, []).append((word, label))
    return list(rows.values())


@lru_cache(maxsize=1)
def model() -> CRF:
    """The same in every worker: training has no randomness."""
    return CRF(training_rows())


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ from left to right with all local characters before it, back to the match before."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        before = text[floor:at]
        start = floor + len(before.rstrip(LOCAL))
        m = DOMAIN.match(text, at) if start < at else None
        floor = m.end() if m else at + 1
        if m:
            out.append((start, floor))
        at = text.find("@", floor)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost matches of each kind that don't overlap; those that fail a check are dropped."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if not DIGIT.search(text):
        return out
    if "." in text:
        out["ip"] = [m.span() for m in IP.finditer(text) if all(len(p := x.lstrip("0")) < 4 and int(p or 0) < 256 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= sum(map(m[0].count, "0123456789")) <= 15]
    return out


def runs_of(text: str) -> list[tuple[list[str | None], list[tuple[int, int]]]]:
    """Runs of words that have a digit or @: the words with a neighbour on either side, and the run's
    own places."""
    if not SPECIAL.search(text):
        return []
    at = [m.span() for m in WORD.finditer(text)]
    starts = np.array([a for a, _ in at])
    hit = np.unique(np.searchsorted(starts, [m.start() for m in SPECIAL.finditer(text)], "right") - 1)
    out = []
    for part in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1):
        a, b = int(part[0]), int(part[-1]) + 1
        words = [None if a == 0 else text[slice(*at[a - 1])], *(text[x:y] for x, y in at[a:b]), None if b == len(at) else text[slice(*at[b])]]
        out.append((words, at[a:b]))
    return out


def field_spans(texts: list[str], crf: CRF) -> list[list[tuple[int, int, str]]]:
    """Spans of the field's labels in each text: a first word and those that follow in it, without the
    punctuation around them."""
    by_length: dict[int, list] = defaultdict(list)
    for i, text in enumerate(texts):
        for words, at in runs_of(text):
            by_length[len(at)].append((i, words, at))
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for runs in by_length.values():
        labels = crf.viterbi(np.stack([crf.scores(w) for _, w, _ in runs]), np.array([w[0] is not None for _, w, _ in runs]), np.array([w[-1] is not None for _, w, _ in runs]))
        for (i, words, at), own in zip(runs, labels.tolist(), strict=True):
            k = 0
            while k < len(own):
                n = k + 1
                if own[k]:
                    kind = LABELS[own[k]][2:]
                    while n < len(own) and LABELS[own[n]] == f"I-{kind}":
                        n += 1
                    a, b = at[k][0], at[n - 1][1]
                    first, last = words[k + 1], words[n]
                    a += len(first) - len(first.lstrip(TRIM))
                    b -= len(last) - len(last.rstrip(TRIM))
                    a -= ")" in texts[i][a:b] and "(" not in texts[i][a:b] and texts[i][a - 1 : a] == "("
                    if a < b:
                        out[i].append((a, b, kind))
                k = n
    return out


def find(texts: list[str | None]) -> list[tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]]:
    """For each text: the patterns' spans by kind, and all spans by kind."""
    texts = [t or "" for t in texts]
    crf, out = model(), []
    for base, more in zip(map(base_spans, texts), field_spans(texts, crf), strict=True):
        taken = sorted(x for v in base.values() for x in v)
        every = {k: list(v) for k, v in base.items()}
        for a, b, kind in more:
            if not any(a < y and x < b for x, y in taken):
                every[kind].append((a, b))
        out.append((base, {k: sorted(v) for k, v in every.items()}))
    return out


def said(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def masked(text: str | None, spans: dict[str, list[tuple[int, int]]]) -> str | None:
    """text with [KIND] in place of each span; of spans that overlap, the first in order counts."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k in KINDS for a, b in spans[k]):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def scan(docs: DataFrame, text: str = "text", keep: bool = True) -> DataFrame:
    """docs with _n (counts of the patterns' spans by kind), _base, _spans and _masked, and without the
    column `text` unless it is to be kept.

    A null text has no spans and stays null; an empty one is empty; equal rows are alike; a null doc_id
    and columns of other names are carried along; an empty table gives none.
    """

    def start() -> Callable[[list], list[list]]:
        def make(texts: list) -> list[list]:
            found = find(texts)
            return [
                [[len(b[k]) for k in KINDS] for b, _ in found],
                [hashlib.sha256(said(b).encode()).hexdigest() for b, _ in found],
                [said(e) for _, e in found],
                [masked(t, e) for t, (_, e) in zip(texts, found, strict=True)],
            ]

        return make

    return appended(docs, text, "_n array<long>, _base string, _spans string, _masked string", start, keep)


def mask(docs: DataFrame) -> DataFrame:
    """docs (the same columns, whatever their names) with personal data masked, and n_chars, if there,
    to match. Nulls and empty tables as in scan()."""
    own, name = plain(docs)
    text = name["text"]
    out = scan(own.withColumn(text, F.col(text).cast("string")), text, keep=False).withColumn(text, F.col("_masked"))
    if "n_chars" in name:
        out = out.withColumn(name["n_chars"], F.when(F.col("_spans") != "", F.length("_masked")).otherwise(F.col(name["n_chars"])))
    return named(out, docs)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(id_text(table(spark, sf_dir, "documents")))
    return found.select("doc_id", *(F.col("_n")[i].alias(f"n_{k}") for i, k in enumerate(KINDS)), F.col("_base").alias("base_sha256"), F.col("_spans").alias("spans"))
