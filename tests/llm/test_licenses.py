from __future__ import annotations

import re

import pytest

from lakeproof.llm import licenses
from tests.llm import cases

MIT = licenses.TEMPLATES[0][1]
TEXTS = [
    "Released under the MIT License. Under, the mit-license!",
    "Apache License, Version 2.0 and CC BY NC and cc by nc nc",
    "under the mit licenses; apache license version 3",
    MIT,
    MIT.replace("any person", "any other natural person"),  # words put in
    MIT.replace("of charge to", ""),  # words left out
    " ".join(MIT.split()[:9]),  # too little of it
    "This work is licensed under the GNU General Public License, version 3.",
    "cc by",
    None,
    "",
]


def places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    out = []
    for label, phrase in licenses.PHRASES:
        own = phrase.split()
        out += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    return words, sorted(out)


def test_phrases_are_brute_force(spark):
    pairs = list(enumerate(TEXTS)) + [(100 + k, t) for k, (_, t) in enumerate(cases.TEXTS)]
    for r in licenses.report(cases.texts(spark, pairs)).collect():
        words, found = places(dict(pairs)[r.doc_id])
        assert (r.n_words, r.n_base) == (len(words), len(found))
        assert (r.first_word, r.last_word) == ((found[0][0], found[-1][0]) if found else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in found}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1 and (not found or r.score == 1)


def test_templates(spark):
    got = {r.doc_id: r for r in licenses.report(cases.texts(spark, enumerate(TEXTS))).collect()}
    assert [got[k].labels for k in (3, 4, 5)] == ["mit"] * 3
    assert got[3].score == 1 and 0.8 <= got[4].score < 1 and 0.8 <= got[5].score < 1
    assert got[6].labels == "" and 0 < got[6].score < 0.8
    assert got[7].labels == "gpl-3" and got[7].n_base == 0
    assert got[8].score == got[9].score == got[10].score == 0


def test_many_templates_need_no_broadcast(spark):
    docs = cases.texts(spark, enumerate(TEXTS))
    few, many = (sorted(map(str, licenses.report(docs, max_grams=n).collect())) for n in (licenses.MAX_GRAMS, 0))
    assert few == many


def test_edge_cases(spark):
    rows = licenses.report(cases.frame(spark)).collect()
    assert len(rows) == len(cases.TEXTS)
    words = sorted((str(i), len(places(t)[0])) for i, t in cases.TEXTS)
    assert sorted((str(r.doc_id), r.n_words) for r in rows) == words
    assert licenses.report(cases.frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        licenses.template_grams(spark, (), (("short", "two words"),))


def test_one_word_put_in(spark):
    texts = [
        "licensed under the GNU General Public License (GPL) version 3", "This is free and totally unencumbered software released into the public domain",
        "licensed under a creative commons attribution and sharealike 4.0 international license", "This is free software", "licensed under the public license",
    ]
    got = {r.doc_id: r for r in licenses.report(cases.texts(spark, enumerate(texts))).collect()}
    assert [got[k].labels for k in range(5)] == ["gpl-3", "unlicense", "cc-by-sa", "", ""]
    assert all(0.75 <= got[k].score < 1 for k in range(3))


def test_whole_license_texts(spark):
    whole = " ".join(f"clause{i % 37} term{i % 101} word{i}" for i in range(110))
    words = whole.split()
    assert len(words) > 300
    texts = [
        f"before it {whole} after it", " ".join(words[:150] + ["put", "in"] + words[150:]), " ".join(words[:100] + words[102:]), " ".join(words[:200]), " ".join(words[::2]),
    ]
    got = {r.doc_id: r for r in licenses.report(cases.texts(spark, enumerate(texts)), templates=(("whole", whole),)).collect()}
    assert [got[k].labels for k in range(5)] == ["whole"] * 3 + [""] * 2
    assert got[0].score == 1 and got[0].n_spans == 1 and abs(got[3].score - 200 / 330) < 1e-9


def test_main_path_is_native(spark):
    plan = licenses.report(cases.frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct"))
