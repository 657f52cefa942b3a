import hashlib
import itertools
import re
from pathlib import Path

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from skeinql.llm import pii
from skeinql.llm.crf import CRF, LABELS


def brute(text):
    out = {}
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    out["email"] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@1 +-(%5é\n", max_size=60))
def test_patterns_against_plain_ones(text):
    assert pii.base_spans(text) == brute(text)


def test_known_cases():
    for text in ("x 4111 1111-1111 1111 y", "a@b.c_x@d.com@e.f", "0001.002.3.255 256.1.1.1", "+1 (269) 555-3296 4524132264652876", "+49 30 1234 567-8"):
        assert pii.base_spans(text) == brute(text)


def test_viterbi_against_all_paths():
    crf = pii.model()
    e = np.random.default_rng(0).normal(size=(20, 4, len(LABELS)))
    got = crf.viterbi(e, np.ones(20, bool), np.zeros(20, bool))
    for x, path in zip(e, got, strict=True):
        score = lambda p, x=x: crf.transition[0, p[0]] + sum(x[i, y] for i, y in enumerate(p)) + sum(crf.transition[a, b] for a, b in itertools.pairwise(p))
        assert abs(score(path) - max(map(score, itertools.product(range(len(LABELS)), repeat=4)))) < 1e-9


def test_field_on_rows_it_was_not_trained_on():
    """Of the labelled table in folds: rows that have personal data or none, told apart."""
    right = 0
    rows = pii.training_rows()
    for fold in range(5):
        crf = CRF([r for i, r in enumerate(rows) if i % 5 != fold], rounds=150)
        for r in (r for i, r in enumerate(rows) if i % 5 == fold):
            got = pii.field_spans([" ".join(w for w, _ in r)], crf)[0]
            right += bool(got) == any(y != "O" for _, y in r)
    assert right / len(rows) >= 0.8


def test_precision_and_recall_on_forms_that_the_patterns_miss():
    rows = [line.split("\t") for line in (Path(__file__).parent / "pii_held_out.tsv").read_text().splitlines()[1:]]
    right = got = wanted = by_patterns = 0
    for text, spans in rows:
        want = {tuple(x.split(":", 1)) for x in spans.split("|") if x}
        [(base, every)] = pii.find([text])
        found, patterns = ({(k, text[a:b]) for k in pii.KINDS for a, b in x[k]} for x in (every, base))
        right, got, wanted, by_patterns = right + len(found & want), got + len(found), wanted + len(want), by_patterns + len(patterns & want)
    assert right / got >= 0.9 and right / wanted >= 0.85 and by_patterns <= 2, (right, got, wanted)


def test_neighbours_of_one_kind_are_two_spans():
    text = "cards 4111111111111111 5500005555555559 were used"
    [(base, every)] = pii.find([text])
    assert base["card"] == [] and [text[a:b] for a, b in every["card"]] == ["4111111111111111", "5500005555555559"]


def test_field_adds_and_patterns_stay():
    [(base, every)] = pii.find(["please call (555) 010-7788 or mail a@b.example"])
    assert base["phone"] == [] and every["phone"] == [(12, 26)] and every["email"] == base["email"] == [(35, 46)]
    clean = "on 12 May 2024 about 1,500 people; version 3. of 4.0 under the License, Version 2.0."
    assert pii.said(pii.find([clean])[0][1]) == ""


TEXTS = [None, "", "mail a@b.example now", "mail a@b.example now", "x " * 30000 + "10.1.2.3", "1" * 20000 + "a" * 20000 + "@", "größe +49 30 1234567"]


def test_query(spark, tmp_path):
    spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)], "doc_id long, text string, _n int").write.parquet(f"{tmp_path}/documents.parquet")
    for r in pii.op6_pii(spark, str(tmp_path)).collect():
        want = brute(TEXTS[r.doc_id] or "") if r.doc_id != 5 else pii.base_spans(TEXTS[5])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(want[k]) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(pii.said(want).encode()).hexdigest()


def test_mask(spark):
    df = spark.createDataFrame([(1, "a@b.example ok", 14, "x", 7, "z"), (2, None, None, "y", 8, None)], "doc_id long, text string, n_chars long, _n string, _masked int, _spans string")
    out = pii.mask(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [(1, "[EMAIL] ok", 10, "x", 7, "z"), (2, None, None, "y", 8, None)]
    assert [tuple(r) for r in pii.mask(spark.createDataFrame([(None, "at 10.1.2.3")], "doc_id long, text string")).collect()] == [(None, "at [IP]")]
    assert pii.mask(df.limit(0)).collect() == []
