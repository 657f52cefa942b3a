"""Benchmark decontamination: a generalised suffix automaton of the benchmark's words.

Texts are lower-cased (A-Z) and cut into words of ASCII letters, digits and all characters beyond
ASCII. The automaton streams a document's words and tracks the longest match that ends at each. A
match over the length limit (`window` words), or of the whole of an item shorter than that
(coverage), is a hit. Words that no item has break every match, so only stretches of known words
are streamed.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import appended, id_text, named, plain, stored, table

WINDOW = 10
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words of one automaton (some 100 MB), and automata that a worker holds; a larger benchmark takes
#: several passes over the documents.
BLOCK_WORDS, BLOCKS_AT_ONCE = 200_000, 2


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode().lower()) if text else []


class SuffixAutomaton:
    """Of items: lists of (item, words). feed() yields where words of a document are hit."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [self.ids.setdefault(w, len(self.ids)) for w in words]) for item, words in items if words]
        for _, seq in coded:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        self.shortest = min([window, *(len(seq) for _, seq in coded)])
        self._mark(coded)

    def _state(self, length: int, next_: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.next.append(next_)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state of p's strings followed by w: q, or a part split from it."""
        if self.length[q] == self.length[p] + 1:
            return q
        part = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = part
            p = self.link[p]
        self.link[q] = part
        return part

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w, self.next[last][w])
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, self.next[p][w])
        return new

    def _mark(self, coded: list[tuple[str, list[int]]]) -> None:
        """long[v]: the items that hold the last `window` words of v's strings. short[v]: (length,
        item) of whole short items that end v's strings."""
        held: list[set[str]] = [set() for _ in self.link]
        own: list[list[tuple[int, str]]] = [[] for _ in self.link]
        for item, seq in coded:
            v = 0
            for w in seq:
                v = self.next[v][w]
                u = v
                while u > 0 and item not in held[u]:
                    held[u].add(item)
                    u = self.link[u]
            if len(seq) < self.window:
                while self.length[self.link[v]] >= len(seq):
                    v = self.link[v]
                own[v].append((len(seq), item))
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        self.long: list[set[str] | None] = [None] * len(self.link)
        self.short: list[list[tuple[int, str]]] = [[] for _ in self.link]
        for v in order:
            up = self.link[v]
            self.short[v] = self.short[up] + own[v] if own[v] else self.short[up]
            if self.length[v] >= self.window:
                self.long[v] = self.long[up] if self.length[up] >= self.window else held[v]

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in a hit, and the items hit."""
        ids = np.fromiter(map(self.ids.get, words, [-1] * len(words)), np.int32, len(words))
        hit, items = np.zeros(len(words) + 1, np.int32), set()
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids >= 0).view(np.int8), [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= self.shortest:
                self._stream(ids[a:b].tolist(), a, hit, items)
        return np.cumsum(hit[:-1]) > 0, items

    def _stream(self, ids: list[int], at: int, hit: np.ndarray, items: set[str]) -> None:
        next_, link, length, window = self.next, self.link, self.length, self.window
        v = n = 0
        for i, w in enumerate(ids, at + 1):
            to = next_[v].get(w)
            while to is None and v:
                v = link[v]
                n = length[v]
                to = next_[v].get(w)
            if to is None:
                continue
            v, n = to, n + 1
            if n >= window:
                hit[i - window] += 1
                hit[i] -= 1
                items |= self.long[v]
            for m, item in self.short[v]:
                if m <= n:
                    hit[i - m] += 1
                    hit[i] -= 1
                    items.add(item)


def blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[SuffixAutomaton]:
    """Automata of the stated items, a bounded number of words each."""
    held, n, made = [], 0, False
    for item, text in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        words = words_of(text)
        held.append((item, words))
        n += len(words)
        if n >= block_words:
            yield SuffixAutomaton(held, window)
            held, n, made = [], 0, True
    if held or not made:
        yield SuffixAutomaton(held, window)


def runs_of(hit: np.ndarray) -> list[int]:
    """Starts and ends of runs of true, in turn."""
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).tolist() if hit.any() else []


def without_runs(text: str, runs: list[int]) -> str:
    """text without each run of hit words and what stands between its words."""
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw.lower())]
    kept, last = [], 0
    for a, b in zip(runs[::2], runs[1::2], strict=True):
        kept.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*kept, raw[last:]]).decode()


PASS = "_n_words long, _hit_runs array<long>, _items array<string>"


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, at_once: int = BLOCKS_AT_ONCE, clean: bool = False) -> DataFrame:
    """docs with _n_words, _hit_runs (starts and ends of runs of hit words, in turn), _items and, if
    clean, _clean: the column `text` without those runs, which then takes its place.

    Null or empty texts and items have no words; an item_id that is null is passed over in _items;
    equal items count each for itself; an empty benchmark hits nothing; a null doc_id and columns of
    other names are carried along. Workers hold at most `at_once` automata; a benchmark of more takes
    further passes, each over a stored table.
    """
    sc = docs.sparkSession.sparkContext
    todo = blocks(benchmark, window, block_words)
    group = list(itertools.islice(todo, at_once))
    found = None
    while group:
        shared = [sc.broadcast(a) for a in group]
        group = list(itertools.islice(todo, at_once))
        last = not group

        def start(shared: list = shared, before: bool = found is not None, cut: bool = clean and last) -> Callable[[list], list[list]]:
            automata = [b.value for b in shared]

            def one(text: str | None, runs: list[int], known: list[str]) -> list:
                words = words_of(text)
                hit, items = np.zeros(len(words), bool), set(known)
                for a, b in zip(runs[::2], runs[1::2], strict=True):
                    hit[a:b] = True
                for a in automata:
                    h, i = a.hits(words)
                    hit |= h
                    items |= i
                every = runs_of(hit)
                return [len(words), every, sorted(i for i in items if i is not None), *([without_runs(text, every) if every else text] if cut else [])]

            def make(rows: list) -> list[list]:
                out = [one(r["text"], r["runs"], r["items"]) if before else one(r, [], []) for r in rows]
                return [list(c) for c in zip(*out, strict=True)] or [[]] * (3 + cut)

            return make

        fields = PASS + ", _clean string" * (clean and last)
        if found is None:
            found = appended(docs, text, fields, start, keep=not (clean and last))
        else:
            both = F.struct(F.col(text).alias("text"), F.col("_hit_runs").alias("runs"), F.col("_items").alias("items")).alias("_both")
            rest = [c for c in found.columns if c not in ("_n_words", "_hit_runs", "_items") and not (c == text and clean and last)]
            found = appended(found.select(*rest, both), "_both", fields, start, keep=False)
        if not last:
            found = stored(found, "hits")
            for b in shared:
                b.unpersist()
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs (the same columns, whatever their names) with hit spans taken out of text, and n_chars, if
    there, to match. Nulls and empty tables as in scan()."""
    own, name = plain(docs)
    text = name["text"]
    out = scan(own.withColumn(text, F.col(text).cast("string")), benchmark, text, window, block_words, clean=True).withColumn(text, F.col("_clean"))
    if "n_chars" in name:
        out = out.withColumn(name["n_chars"], F.when(F.size("_hit_runs") > 0, F.length("_clean")).otherwise(F.col(name["n_chars"])))
    return named(out, docs)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(id_text(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.sequence(F.lit(1), F.size("_hit_runs"), F.lit(2)), F.lit(0).cast("long"), lambda n, i: n + F.get("_hit_runs", i) - F.get("_hit_runs", i - 1))
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.when(F.size("_hit_runs") > 0, n_hit).otherwise(F.lit(0).cast("long")).alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"),
        (F.size("_hit_runs") > 0).alias("contaminated"),
    )


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
it AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS k, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS i FROM it WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT DISTINCT r, i, k, item_id FROM dw JOIN win USING (k, s)),
hw AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + k)) AS j FROM hit) GROUP BY r),
hi AS (SELECT r, count(*) AS n, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hw.n, 0)::BIGINT AS n_hit, coalesce(hi.n, 0)::BIGINT AS n_items, coalesce(hi.s, sha256('')) AS items_sha256, coalesce(hw.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""
