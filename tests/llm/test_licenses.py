from skeinql.llm import licenses as L


def found(text):
    return [(j[0], text[a:b]) for a, b in L.candidates(text) if (j := L.judged(text[a:b]))]


def test_each_template_is_found_in_other_text():
    for name, text in L.TEMPLATES.items():
        got = found(f"Some words stand before it.\nmore text\n{text}\nAnd words that follow, a few more of them.")
        assert [g[0] for g in got] == [name], (name, got)


def test_wordings_that_differ():
    assert found("Licensed under CC BY-NC 4.0. Text")[0][0] == "CC-BY-NC-4.0-notice"
    assert found("Licensed under CC BY-NC 3.0.") == [] and found("licensed under the Apache License, Version 1.1.") == []
    assert found("This work is licensed under the GNU General Public License, version 2.")[0][0] == "GPL-2.0-notice"
    assert found("This work isn't licensed. We have no copyright to speak of, nor permission.") == []
    mit = L.TEMPLATES["MIT"].replace("hereby ", "").replace("persons", "people")
    name, _, lacks, more = L.judged(mit)
    assert (name, lacks, more) == ("MIT", 2, 1)


def test_reductions_against_plain_compression():
    import zstandard

    block = "Released under the MIT License."
    alone = len(zstandard.ZstdCompressor(level=9, write_content_size=False).compress(block.encode()))
    assert 0.25 < L.judged(block)[1] < 1 - 1 / alone


def test_query(spark, tmp_path):
    texts = [None, "", "plain text", "x " * 30000 + "\nAll rights reserved.\n" + "y " * 30000, "All rights reserved.", "All rights reserved."]
    spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_found int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_blocks, r.n_found, r.licenses) for r in L.op10_licenses(spark, str(tmp_path)).collect()}
    one = (1, 1, "Proprietary-notice")
    assert got == {0: (0, 0, ""), 1: (0, 0, ""), 2: (0, 0, ""), 3: one, 4: one, 5: one}
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_notices_near_other_cues():
    names = lambda text: [(x[2], text[a:b][x[0] : x[1]]) for a, b in L.candidates(text) for x in L.notices(text[a:b])]
    line = "Copyright 2021 The Example Project Authors."
    assert names(f"{line} All rights reserved.") == [("Proprietary-notice", "All rights reserved.")]
    assert names(f"{line}\nReleased under the MIT License.") == [("MIT-notice", "Released under the MIT License.")]
    assert names("Licensed under CC BY 4.0. It was first said here. No permission is asked of anyone who reads it.") == [("CC-BY-4.0-notice", "Licensed under CC BY 4.0.")]
    both = f"{L.TEMPLATES['Apache-2.0']}\n{line} All rights reserved.\nReleased under the MIT License."
    assert [n for n, _ in names(both)] == ["Apache-2.0", "Proprietary-notice", "MIT-notice"]
    every = "\n".join(L.TEMPLATES.values())
    assert [n for n, _ in names(every)] == list(L.TEMPLATES)


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""


def test_a_license_with_a_numbered_list():
    found = [x[2] for a, b in L.candidates(BSD) for x in L.notices(BSD[a:b])]
    assert found == ["BSD-2-Clause"]
    flat = " ".join(BSD.split())
    assert [x[2] for a, b in L.candidates(flat) for x in L.notices(flat[a:b])] == ["BSD-2-Clause"]
