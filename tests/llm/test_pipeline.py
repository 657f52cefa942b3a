import random
from collections import defaultdict


import corpus_pipeline
from skeinql.llm import pii, tokens
from skeinql.llm.decontamination import WORD
from tests.llm import test_decontamination, test_quality, test_simhash

ITEMS = [(1, " ".join(f"item{i}" for i in range(14))), (2, "short bench item"), (3, None)]


def documents():
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))) for _ in range(n))
    base = text(300)
    rows = [(i, text(rng.randrange(25, 80)) + "\n" + text(10), f"s{i % 3}") for i in range(30)]
    rows += [(40 + i, base + (" end" if i else ""), "s0") for i in range(4)]
    rows += [(60 + i, "Shared MENU line\n" + text(40), "menu") for i in range(12)]
    rows += [(80, text(30) + " " + ITEMS[0][1].upper() + " " + text(30), "s1"), (81, text(40) + " Short bench, item. " + text(5), "s2"), (82, ITEMS[1][1], "s2")]
    rows += [(90, text(30) + " mail jo@a.example or +49 30 1234567 and 10.1.2.3 ok " + text(5), "s1"), (91, None, "s1"), (92, "", None), (93, "word " * 100, "s2")]
    return [(i, t, "en", s, len(t) if t is not None else None, "more") for i, t, s in rows]


def brute(rows):
    """Texts by doc_id after all stages but packing."""
    goes = test_quality.removed([(i, t, s) for i, t, _, s, *_ in rows])
    verdicts = {r[0]: r for r in test_quality.brute([(i, t, s) for i, t, _, s, *_ in rows])}
    texts = {}
    for i, t, _, s, *_ in rows:
        if verdicts[i][7]:
            texts[i] = "\n".join(x for x in t.split("\n") if not goes(s, x))
    ids = sorted(texts)
    group = test_simhash.brute_groups([test_simhash.brute_print(texts[i]) for i in ids])
    texts = {i: texts[i] for k, i in enumerate(ids) if group[k] == k}
    for i, t in texts.items():
        w = test_decontamination.words(t)
        hit = set()
        for _, item in ITEMS:
            iw = test_decontamination.words(item)
            for k in range(max(1, len(iw) - 9)) if iw else ():
                win = iw[k : k + 10]
                hit |= {a + j for a in range(len(w) - len(win) + 1) if w[a : a + len(win)] == win for j in range(len(win))}
        raw, out, last = t.encode(), [], 0
        at = [m.span() for m in WORD.finditer(raw.lower())]
        for k in sorted(hit):
            if k - 1 not in hit:
                out.append(raw[last : at[k][0]])
            last = at[k][1]
        texts[i] = b"".join([*out, raw[last:]]).decode()
    return {i: pii.masked(t, pii.find([t])[0][1]) for i, t in texts.items()}


def test_pipeline_against_brute_force(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _key string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = brute(rows)
    assert 41 not in want and 66 in want and 93 not in want and "item5" not in want[80] and "MENU" not in want[60] and "[EMAIL]" in want[90]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    got = {r.doc_id: r for r in docs.collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) and r["_key"] == "more" for r in got.values())
    tok = tokens.tokenizer(tokens.default_path())
    total = defaultdict(int)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        total[r.doc_id] += r.length
    assert total == {i: len(tok.ids(t)) + 1 for i, t in want.items()}


def test_pipeline_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
