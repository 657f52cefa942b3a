import random
import re

from skeinql.llm import sentences as S

P = "This passage has many words. It is said in two or three documents. Each time it stands among others! Does it go on? It does, for a while."
BARE = " ".join(f"bare{i % 37}word{i}" for i in range(70))
ROWS = [
    (3, f"Opening words here. {P} The end of three.", "a"),
    (1, f"Something else. {P.upper()} And more text follows it.", "a"),
    (2, None, "b"),
    (4, "", "b"),
    (5, "Too short. To be. A span.", "b"),
    (6, "Too short. To be. A span.", "b"),
    (7, f"alpha beta {BARE} gamma delta", None),
    (8, f"one two three four five {BARE} six", None),
    (9, f"{P}\n{P}", "c"),
    (None, P, "c"),
    (10, "x " * 20000, "c"),
    (11, "Repeated row. " + P[::-1], "d"),
    (11, "Repeated row. " + P[::-1], "d"),
]


def brute(rows, n=S.SENTENCES, words=S.WORDS):
    all_ = [S.cut(t or "") for _, t, _ in rows]
    key = lambda r: (rows[r][0] is None, rows[r][0] or 0, r)
    seen, gone = set(), [set() for _ in rows]
    for r in sorted(range(len(rows)), key=key):
        found = all_[r]
        for i in range(len(found)):
            for j in range(i + n, len(found) + 1):
                if sum(len(w) for _, _, w in found[i:j]) >= words:
                    said = " ".join(x for _, _, w in found[i:j] for x in w)
                    if said in seen:
                        gone[r] |= set(range(i, j))
                    seen.add(said)
                    break
    return sorted(((rows[r][0], len(all_[r]), len(gone[r]), sum(len(all_[r][i][2]) for i in gone[r])) for r in range(len(rows))), key=str)


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, 5, "at", "cuts") for r in rows], "doc_id long, text string, source string, _row int, _at string, _cuts string").coalesce(1)


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.randrange(1, 12))) + rng.choice(".!?\n") for _ in range(12)]
    more = [(100 + k, " ".join(rng.choices(pool, k=rng.randrange(1, 15))), "e") for k in range(40)]
    rows_of(spark, ROWS + more).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id, r.n_sentences, r.n_removed, r.n_removed_words) for r in S.op4_sentences(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(ROWS + more)


def test_the_first_stays_and_others_go(spark):
    rows = S.deduplicated(rows_of(spark, ROWS)).collect()
    assert {(r["_row"], r["_at"], r["_cuts"]) for r in rows} == {(5, "at", "cuts")}
    out = {r.doc_id: r.text for r in rows}
    assert out[1] == ROWS[1][1] and out[3] == "Opening words here. The end of three." and out[7] == ROWS[6][1]
    assert out[9].strip() == "" and out[None] == "" and out[2] is None and out[6] == ROWS[5][1]
    assert 50 <= len(re.findall(r"bare\d", ROWS[7][1])) - len(re.findall(r"bare\d", out[8]))
    assert S.deduplicated(rows_of(spark, ROWS).limit(0)).collect() == []


def test_passages_at_random_places_are_caught(spark):
    """Passages of 55 words, cut from anywhere, that another text has too."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(3, 8)))
    text = lambda n: " ".join(word() + (rng.choice(".!?") if rng.random() < 0.1 else "") for _ in range(n)).split()
    rows, source = [], [text(400) for _ in range(100)]
    rows += [(i, " ".join(w), "s") for i, w in enumerate(source)]
    for i, w in enumerate(source):
        at, to = rng.randrange(300), rng.randrange(60)
        own = text(100)
        rows.append((1000 + i, " ".join(own[:to] + w[at : at + 55] + own[to:]), "s"))
    rows += [(2000 + i, " ".join(text(150)), "s") for i in range(100)]
    hit = {r.doc_id for r in S.removals(rows_of(spark, rows)).collect() if r.n_spans}
    assert not any(i < 1000 or i >= 2000 for i in hit) and len(hit) >= 95
