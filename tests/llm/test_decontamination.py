import hashlib
import re

import duckdb
import pytest

from pyspark.sql import functions as F

from skeinql.llm import decontamination as D

ITEMS = [(1, "The quick brown fox jumps over the lazy dog and runs far away from home today"), (2, "short item here"), (3, None), (4, ""), (5, "a b c d e f g h i j"), (6, "short item here"), (7, "B a B a B a b a b a b")]
TEXTS = [
    "xx the Quick, brown fox jumps over the lazy dog and? then SHORT item  here.",
    None,
    "",
    "a b c d e f g h i j k a b c d e f g h i",
    "quick brown fox jumps over the lazy dog and stops",
    "short item",
    "a b a b a b a b a b a b a b a b short item here short item here",
    "größe short item here größe",
    "word " * 5000 + "a-b-c-d-e-f-g-h-i-j",
    "a b c d e f g h i j k a b c d e f g h i",
]


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        for win in {tuple(iw[i : i + 10]) for i in range(max(1, len(iw) - 9))} if iw else ():
            for at in range(len(w) - len(win) + 1):
                if tuple(w[at : at + len(win)]) == win:
                    hit |= set(range(at, at + len(win)))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.fixture()
def folder(spark, tmp_path):
    spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, _items int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_query_against_brute_force(spark, folder):
    for r in D.op8_decontamination(spark, folder).collect():
        assert tuple(r)[1:] == brute(TEXTS[r.doc_id], ITEMS), TEXTS[r.doc_id]


def test_sql_gives_the_same(spark, folder):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    out = c.execute(D.OP8_SQL)
    names = [x[0] for x in out.description]
    got = D.op8_decontamination(spark, folder)
    assert sorted(out.fetchall()) == sorted(map(tuple, got.select(*names).collect()))


def test_blocks_give_the_same(spark, folder):
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    docs = docs.drop("_items")
    a, b, c = (sorted(map(tuple, D.scan(docs, bench, block_words=n, at_once=k).select("doc_id", "_n_words", "_hit_runs", "_items").collect())) for n, k in ((1, 100), (1, 2), (1000, 1)))
    assert a == b == c
    a, b = (sorted(map(tuple, D.scan(docs, bench, block_words=n, at_once=1, clean=True).select("doc_id", "_items", "_clean").collect())) for n in (1, 1000))
    assert a == b


def test_hit_spans_are_taken_out(spark, folder):
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    docs = docs.withColumns({c: F.lit(c) for c in ("_clean", "_hit_runs", "_both", "c0", "runs")})
    rows = D.decontaminate(docs, bench).collect()
    assert all(r[c] == c for r in rows for c in ("_clean", "_hit_runs", "_both", "c0", "runs")) and rows[0].__fields__ == docs.columns
    out = {r.doc_id: r.text for r in rows}
    assert out[0] == "xx ? then ." and out[1] is None and out[2] == "" and out[5] == "short item"
    assert out[7] == "größe  größe"


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [r._n_words for r in D.scan(docs, bench).collect()] == [2]
    assert D.decontaminate(docs.limit(0), bench).collect() == []
