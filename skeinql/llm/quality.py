"""Quality rules: fixed rules on each document, and lines that many documents of a host share.

Lines are normalised (A-Z in lower case, white space to one blank) and hashed. For each host
(`source`) the different documents that have a line are counted, exact copies of a text once. A host's
limit is `min_docs` documents, or `share` of its different documents if that is less, but at least
`least_docs`. Lines over the limit are counted once more, now only in documents of which at least
`min_left` is no such line: a group of near copies, however large, has nothing but shared lines and
doesn't vouch for them. Lines still over the limit are removed; a document is depleted, and rejected,
if fewer than `min_words` words or `min_left` of them are left.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import appended, named, plain, stored, table

MIN_WORDS, MAX_REPEATED, WINDOW = 20, 30, 8
MIN_DOCS, SHARE, LEAST_DOCS, MIN_LEFT = 20, 0.05, 4, 0.5
SEED = 42  # of xxhash64() in SQL
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that are found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed, span = h, 1
    for step in (1, 2, 4):  # of 2, 4 and 8 words
        mixed = mixed[:-step] * np.uint64(0x9E3779B97F4A7C15) ^ (mixed[step:] + (mixed[step:] >> np.uint64(29)))
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        span += step
    assert span == window
    s = np.sort(mixed)
    if not (again := s[1:][s[1:] == s[:-1]]).size:
        return 0
    hit = np.isin(mixed, again)
    cover = np.zeros(len(words) + 1, np.int64)
    cover[:n] += hit
    cover[window:] -= hit
    return int((np.cumsum(cover[:-1]) > 0).sum())


def line_hash(line: bytes) -> int:
    """Of the normalised line, as a signed number; 0 for a line without a word. line_column() is the
    same for lines with one."""
    import xxhash

    words = line.lower().split()
    return (xxhash.xxh64_intdigest(b" ".join(words), SEED) + (1 << 63)) % (1 << 64) - (1 << 63) if words else 0


def line_column(line: Column) -> Column:
    low = F.translate(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.xxhash64(low)


def features(text: str | None) -> tuple[list[int], list[int], list[int]]:
    """The base numbers; the hash of each line and its words."""
    text = text or ""
    raw = text.encode()
    words, lines = raw.split(), raw.split(b"\n")
    worded = [x for x in lines if x.strip()]
    base = [len(words), len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")), sum(map(text.count, "#*$%&|<>")), len(worded) - len(set(worded)), repeated_words(words)]
    return base, [line_hash(x) for x in lines], [len(x.split()) for x in lines]


def judged(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, least_docs: int = LEAST_DOCS, min_left: float = MIN_LEFT, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, source, the base numbers, base_failed, kept, n_removed_lines, n_removed_words, _key
    (hash of the text) and _removed (hashes of the lines to remove) for each row of docs.

    A null or empty text has no words and fails; a null source is a host of its own; equal rows are
    judged alike, and count as one document for the limits; a null doc_id stays null; an empty table
    gives none.
    """

    def start() -> Callable[[list], list[list]]:
        def make(texts: list) -> list[list]:
            found = [features(t) for t in texts]
            return [*([b[k] for b, _, _ in found] for k in range(5)), [x for _, x, _ in found], [x for _, _, x in found]]

        return make

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("_key"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    made = appended(slim, "text", f"{BASE}, _lines array<long>, _words array<int>", start, keep=False)
    made = stored(made.withColumn("_row", F.monotonically_increasing_id()), "lines")
    host = F.coalesce("source", F.lit("")).alias("_h"), F.col("source").isNull().alias("_null")
    pairs = F.explode(F.arrays_zip(F.col("_lines").alias("line"), F.col("_words").alias("w"))).alias("x")
    different = made.groupBy(*host, "_key").agg(F.first("_lines").alias("_lines"), F.first("_words").alias("_words"), F.first("n_words").alias("n_words"))
    limits = different.groupBy("_h", "_null").agg(F.least(F.lit(float(min_docs)), F.greatest(F.lit(float(least_docs)), share * F.count("*"))).alias("_limit"))

    def over(lines: DataFrame) -> DataFrame:
        counted = lines.groupBy("_h", "_null", "_line").agg(F.count("*").alias("_n")).filter(F.col("_n") > min(min_docs, least_docs))
        return counted.join(limits, ["_h", "_null"]).filter(F.col("_n") > F.col("_limit")).select("_h", "_null", "_line")

    shared = stored(over(different.select("_h", "_null", F.explode(F.array_distinct("_lines")).alias("_line")).filter("_line <> 0")), "shared")
    # The lines over the limit in each different document, and whether enough of it is its own.
    hits = different.select("_h", "_null", "_key", "n_words", pairs).select("_h", "_null", "_key", "n_words", F.col("x.line").alias("_line"), "x.w").join(shared, ["_h", "_null", "_line"])
    own = hits.groupBy("_h", "_null", "_key").agg(F.collect_set("_line").alias("_lines"), (F.first("n_words") - F.sum("w") >= min_left * F.first("n_words")).alias("own")).filter("own")
    frequent = stored(over(own.select("_h", "_null", F.explode("_lines").alias("_line"))), "frequent")
    each = made.select(*host, "_row", pairs).select("_h", "_null", "_row", F.col("x.line").alias("_line"), F.col("x.w").alias("_w"))
    taken = each.join(frequent, ["_h", "_null", "_line"]).groupBy("_row").agg(F.count("*").alias("n_removed_lines"), F.sum("_w").alias("n_removed_words"), F.collect_set("_line").alias("_removed"))
    out = made.drop("_lines", "_words").join(stored(taken, "taken"), "_row", "left").na.fill(0, ["n_removed_lines", "n_removed_words"])
    left = F.col("n_words") - F.col("n_removed_words")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    depleted = (F.col("n_removed_words") > 0) & ((left < min_words) | (left < min_left * F.col("n_words")))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted).drop("_row")


def filtered(docs: DataFrame, **limits: float) -> DataFrame:
    """The documents kept, with the columns of docs, whatever their names: lines over the limits are
    taken out of text, and n_chars, if there, follows. Verdicts belong to (doc_id, source, text).
    Nulls and empty tables as in judged()."""
    changed = judged(docs, **limits).filter(~F.col("kept") | (F.col("n_removed_lines") > 0))
    changed = stored(changed.select(F.xxhash64("doc_id", "source", "_key").alias("_verdict"), F.col("kept").alias("_kept"), "_removed").dropDuplicates(["_verdict"]), "changed")
    own, name = plain(docs)
    text = F.col(name["text"]).cast("string")
    # Both sides grow with the corpus, so neither is sent to all.
    key = F.xxhash64(F.col(name["doc_id"]).cast("long"), F.col(name["source"]).cast("string"), F.xxhash64(text))
    out = own.withColumn("_verdict", key).join(changed.hint("merge"), "_verdict", "left").filter(F.coalesce("_kept", F.lit(True)))
    less = F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains("_removed", line_column(x))), "\n")
    out = out.withColumn(name["text"], F.when(F.size("_removed") > 0, less).otherwise(text))
    if "n_chars" in name:
        out = out.withColumn(name["n_chars"], F.when(F.size("_removed") > 0, F.length(name["text"])).otherwise(F.col(name["n_chars"])))
    return named(out, docs)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "n_removed_words")


_W = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, {_W} AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + k AS j FROM again, range(0, 8) AS t(k)) GROUP BY r),
line AS (SELECT r, doc_id, source, text, x, regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+') AS lw FROM (SELECT r, doc_id, source, text, unnest(lines) AS x FROM d)),
worded AS (SELECT r, doc_id, source, text, x, len(lw) AS k, {_LOW.format("array_to_string(lw, ' ')")} AS line FROM line WHERE len(lw) > 0),
dup AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM worded GROUP BY r),
host AS (SELECT source, count(DISTINCT coalesce(text, chr(0))) AS docs FROM d GROUP BY source),
lim AS (SELECT source, least({MIN_DOCS}, greatest({LEAST_DOCS}, {SHARE} * docs)) AS most FROM host),
shared AS (SELECT l.source, line FROM (SELECT source, line, count(DISTINCT text) AS n FROM worded GROUP BY source, line) l JOIN lim h ON l.source IS NOT DISTINCT FROM h.source WHERE n > most),
own AS (
  SELECT source, text, list(DISTINCT line) AS ls FROM (
    SELECT w.source, w.text, w.line, w.k, w.r, min(w.r) OVER (PARTITION BY w.source, w.text) AS r1 FROM worded w JOIN shared s ON w.source IS NOT DISTINCT FROM s.source AND w.line = s.line)
  JOIN (SELECT r, len(w) AS nw FROM d) USING (r) WHERE r = r1 GROUP BY source, text HAVING any_value(nw) - sum(k) >= {MIN_LEFT} * any_value(nw)),
freq AS (SELECT l.source, line FROM (SELECT source, line, count(*) AS n FROM (SELECT source, unnest(ls) AS line FROM own) GROUP BY source, line) l JOIN lim h ON l.source IS NOT DISTINCT FROM h.source WHERE n > most),
gone AS (SELECT r, count(*) AS n, sum(k) AS gw FROM worded l JOIN freq f ON l.source IS NOT DISTINCT FROM f.source AND l.line = f.line GROUP BY r),
t AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_lines, coalesce(gone.gw, 0)::BIGINT AS n_removed_words
  FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r))
SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words)
  AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < {MIN_WORDS} OR n_words - n_removed_words < {MIN_LEFT} * n_words)) AS kept
FROM t
"""
