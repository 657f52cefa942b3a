"""Substring dedup by sliding sentence spans.

A span starts at each sentence and takes the least number of consecutive sentences that has at least
`sentences` of them and `words` words. Spans of all documents are hashed (words in lower case, joined
by blanks) and met globally; the first of a repeated span, by doc_id and then place, stays, and every
sentence that any other one covers is removed. Sentences end at . ! ? or a line end; one of more than
`LONG` words is cut after words whose hash is a multiple of `CUT`, so that text without punctuation
is cut alike wherever it stands.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import appended, named, plain, stored, table

SENTENCES, WORDS = 2, 20
LONG, CUT = 16, 4
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*|[.!?]+")
WORD = re.compile(r"\S+")


def cut(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words in lower case) of each sentence that has a word."""
    import xxhash

    out = []
    for m in SENTENCE.finditer(text):
        words = m[0].lower().split()
        if len(words) <= LONG:
            if words:
                out.append((m.start(), m.end(), words))
            continue
        held, start = [], m.start()
        for w in WORD.finditer(text, m.start(), m.end()):
            held.append(w[0].lower())
            if xxhash.xxh32_intdigest(held[-1]) % CUT == 0:
                out.append((start, w.end(), held))
                held, start = [], w.end()
        if held:
            out.append((start, m.end(), held))
    return out


def spans(found: list[tuple[int, int, list[str]]], sentences: int, words: int) -> tuple[list[int], list[int]]:
    """The hash of the span that starts at each sentence, and its sentences; shorter lists where the
    text ends before a span is full."""
    import xxhash

    said = [" ".join(w).encode() for _, _, w in found]
    n = [0, *accumulate(len(w) for _, _, w in found)]
    hashes, lengths, j = [], [], 0
    for i in range(len(found)):
        j = max(j, i + sentences)
        while j <= len(found) and n[j] - n[i] < words:
            j += 1
        if j > len(found):
            break
        hashes.append(xxhash.xxh3_64_intdigest(b" ".join(said[i:j])))
        lengths.append(j - i)
    return np.array(hashes, np.uint64).view(np.int64).tolist(), lengths


def removals(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """doc_id, _key (hash of the text), n_sentences, n_words, n_spans (repeated, not first), n_removed
    (sentences), n_removed_words and _cuts (starts and ends of what is removed, code points, in turn)
    for each row of docs.

    A null or empty text has no sentences; of repeated rows one counts as the first; a null doc_id
    comes after all others; an empty table gives none.
    """

    def start() -> Callable[[list], list[list]]:
        def make(texts: list) -> list[list]:
            out: list[list] = [[], [], [], [], []]
            for text in texts:
                found = cut(text or "")
                hashes, lengths = spans(found, sentences, words)
                for col, v in zip(out, ([a for a, _, _ in found], [b for _, b, _ in found], [len(w) for _, _, w in found], hashes, lengths), strict=True):
                    col.append(v)
            return out

        return make

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = appended(slim, "text", "_starts array<int>, _ends array<int>, _words array<int>, _hashes array<long>, _lengths array<int>", start)
    made = stored(made.withColumn("_key", F.xxhash64("text")).drop("text").withColumn("_row", F.monotonically_increasing_id()), "sentences")
    each = made.select("doc_id", "_row", F.posexplode("_hashes").alias("i", "hash"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row", "i")
    repeated = stored(each.groupBy("hash").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("hash", "first._row", "first.i"), "repeated").toDF("hash", "first_row", "first_i")
    again = each.join(repeated, "hash").filter((F.col("_row") != F.col("first_row")) | (F.col("i") != F.col("first_i")))
    taken = stored(again.groupBy("_row").agg(F.collect_list("i").alias("_again")), "again")

    def cover() -> Callable[[list], list[list]]:
        def make(rows: list) -> list[list]:
            out: list[list] = [[], [], []]
            for r in rows:
                gone = np.zeros(len(r["starts"]) + 1, np.int64)
                again = np.array(r["again"] or [], np.int64)
                np.add.at(gone, again, 1)
                np.add.at(gone, again + np.array(r["lengths"], np.int64)[again] if len(again) else again, -1)
                hit = np.cumsum(gone[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).tolist()
                out[0].append(int(hit.sum()))
                out[1].append(int(np.array(r["words"], np.int64)[hit].sum()))
                out[2].append([x for a, b in zip(edges[::2], edges[1::2], strict=True) for x in (r["starts"][a], r["ends"][b - 1])])
            return out

        return make

    both = made.join(taken, "_row", "left").select(
        "doc_id", "_key", F.size("_starts").cast("long").alias("n_sentences"), F.aggregate("_words", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_words"), F.coalesce(F.size("_again"), F.lit(0)).cast("long").alias("n_spans"),
        F.struct(F.col("_starts").alias("starts"), F.col("_ends").alias("ends"), F.col("_words").alias("words"), F.col("_lengths").alias("lengths"), F.col("_again").alias("again")).alias("_all"),
    )
    return appended(both, "_all", "n_removed long, n_removed_words long, _cuts array<int>", cover).drop("_all")


def without(text: str, cuts: list[int]) -> str:
    keep, at = [], 0
    for a, b in zip(cuts[::2], cuts[1::2], strict=True):
        keep.append(text[at:a])
        at = b
    return "".join([*keep, text[at:]])


def deduplicated(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """docs (the same columns, whatever their names) with the sentences that repeat others' taken out
    of text. Repeated rows (doc_id and text) can't be told apart, so of those the one with the fewest
    cuts speaks for all. Nulls and empty tables as in removals()."""
    cuts = removals(docs, sentences, words).select(F.xxhash64("doc_id", "_key").alias("_at"), "_cuts", F.size("_cuts").alias("n"))
    cuts = stored(cuts.groupBy("_at").agg(F.min_by("_cuts", "n").alias("_cuts")).filter(F.size("_cuts") > 0), "cuts")

    def start() -> Callable[[list], list[list]]:
        return lambda rows: [[without(r["text"], r["cuts"]) if r["cuts"] else r["text"] for r in rows]]

    own, name = plain(docs)
    text = F.col(name["text"]).cast("string")
    out = own.withColumn("_at", F.xxhash64(F.col(name["doc_id"]).cast("long"), F.xxhash64(text))).join(cuts, "_at", "left")
    out = out.withColumn("_both", F.struct(text.alias("text"), F.col("_cuts").alias("cuts"))).drop(name["text"], "_cuts")
    return named(appended(out, "_both", "_kept string", start, keep=False).withColumnRenamed("_kept", name["text"]), docs)


def op4_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """removed: start:end of each run of removed sentences, comma-joined."""
    pair = F.transform(F.sequence(F.lit(0), F.size("_cuts") - 2, F.lit(2)), lambda i: F.concat_ws(":", F.get("_cuts", i), F.get("_cuts", i + 1)))
    found = removals(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", "n_words", "n_spans", "n_removed", "n_removed_words", F.when(F.size("_cuts") > 0, F.array_join(pair, ",")).otherwise("").alias("removed"))
