import re
from collections import Counter, defaultdict

import duckdb

from skeinql.llm import quality as Q

LONG = " ".join(f"w{i}" for i in range(40))
ROWS = (
    [(i, f"Menu  HOME about\nbody {i} " + " ".join(f"v{i}x{k}" for k in range(25)), "a") for i in range(14)]
    + [(100 + i, "menu home about\nmenu home about\n" + " ".join(f"u{i}x{k}" for k in range(21)), "a") for i in range(3)]
    + [(200 + i, "menu home about \n" + " ".join(f"z{i}x{k}" for k in range(18)), "a") for i in range(2)]
    + [(500 + i, "\n".join(f"near copy line {k} of the group" if k != i % 9 else f"edited {i}" for k in range(9)), "n") for i in range(60)]
    + [(300 + i, LONG + "\nsame line", "b") for i in range(40)]
    + [(400, None, "b"), (401, "", None), (402, " \n\t\n", None), (403, "a b # $$ <é>", "c"), (404, (LONG + " ") * 2, "c"), (405, LONG + "\nx y\nx y\nx  y", None), (None, LONG, None), (407, "one " * 30000, "d"), (3, ROW3 := "repeated row " + LONG, "a"), (3, ROW3, "a")]
)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def norm(x):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in " ".join(words(x)))


def removed(rows):
    """Of rows (doc_id, text, source): whether a host's line goes."""
    docs, have = defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        docs[s].add(t)
        for x in (t or "").split("\n"):
            if words(x):
                have[s, norm(x)].add(t)
    limit = lambda s: min(Q.MIN_DOCS, max(Q.LEAST_DOCS, Q.SHARE * len(docs[s])))
    own = defaultdict(int)
    for s, ts in docs.items():
        for t in ts:
            shared = [x for x in (t or "").split("\n") if words(x) and len(have[s, norm(x)]) > limit(s)]
            if len(words(t)) - sum(len(words(x)) for x in shared) >= 0.5 * len(words(t)):
                for x in set(map(norm, shared)):
                    own[s, x] += 1
    return lambda s, x: bool(words(x)) and own[s, norm(x)] > limit(s)


def brute(rows):
    goes = removed(rows)
    out = []
    for i, t, s in rows:
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        wins = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        rep = {k + j for k in range(len(w) - 7) if wins[tuple(w[k : k + 8])] > 1 for j in range(8)}
        gone = [x for x in lines if goes(s, x)]
        gw = sum(len(words(x)) for x in gone)
        failed = len(w) < 20 or 100 * len(rep) > 30 * len(w)
        depleted = gw > 0 and (len(w) - gw < 20 or len(w) - gw < 0.5 * len(w))
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep), failed, not failed and not depleted, len(gone), gw))
    return sorted(out, key=str)


def test_query_against_brute_force_and_sql(spark, tmp_path):
    spark.createDataFrame([(*r, 1, 2) for r in ROWS], "doc_id long, text string, source string, n_words int, _key int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in Q.op2_quality(spark, str(tmp_path)).collect()), key=str)
    want = brute(ROWS)
    assert got == want
    assert {r[0] for r in want if not r[6] and not r[7]} == {200, 201}  # depleted
    assert not any(r[8] for r in want if r[0] and 500 <= r[0] < 600)  # a group of near copies vouches for nothing
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = [x[0] for x in c.execute(Q.OP2_SQL).description]
    order = [names.index(n) for n in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "n_removed_words")]
    assert sorted((tuple(r[k] for k in order) for r in c.execute(Q.OP2_SQL).fetchall()), key=str) == want


def test_filter(spark):
    df = spark.createDataFrame([(*r, len(r[1] or ""), "v", "w", 3) for r in ROWS], "doc_id long, text string, source string, n_chars long, _verdict string, _removed string, _clean int")
    out = Q.filtered(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert sorted((r.doc_id for r in rows), key=str) == sorted((r[0] for r in brute(ROWS) if r[7]), key=str)
    assert {(r["_verdict"], r["_removed"], r["_clean"]) for r in rows} == {("v", "w", 3)}
    by = {r.doc_id: r for r in rows}
    assert by[5].text.startswith("body 5 v5x0") and by[5].n_chars == len(by[5].text)
    assert by[300].text == LONG + "\nsame line"
    assert Q.filtered(df.limit(0)).collect() == []


def test_lines_of_the_test_tables_go(spark):
    out = Q.op2_quality(spark, "/root/testdata/sf0.01").collect()
    assert sum(r.n_removed_lines > 0 for r in out) > 50
    assert sum(not r.base_failed and not r.kept for r in out) > 0
