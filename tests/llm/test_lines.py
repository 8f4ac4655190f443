from __future__ import annotations

import hashlib
import random

from lakeproof.llm import lines
from tests.llm import cases


def brute_force(docs):
    seen, out = set(), {}
    for doc, text in sorted(docs):
        every = (text or "").split("\n")
        gone = set()
        for i in range(len(every) - 2):
            window = tuple(every[i : i + 3])
            if window in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(window)
        kept = "\n".join(s for i, s in enumerate(every) if i not in gone)
        out[doc] = (len(every), len(gone), sum(1 for i in gone if i - 1 not in gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_report_is_brute_force(spark):
    rng = random.Random(2)
    docs = [(i, "\n".join(rng.choice(["", "a", "b", "c", "é"]) for _ in range(rng.randint(1, 14)))) for i in range(70)]
    docs += [(200, None), (201, ""), (202, "\n\n\n\n"), (-1, docs[0][1])]
    got = lines.report(cases.texts(spark, docs)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute_force(docs)


def test_edge_cases(spark):
    docs = cases.frame(spark)
    got = lines.deduplicate(docs)
    assert got.schema.names == docs.schema.names and got.count() == len(cases.TEXTS)
    assert {r.doc_id: r.text for r in got.collect()}[9] == "line five"
    assert lines.deduplicate(cases.frame(spark, [])).collect() == []
    text = "a\nb\nc\nd"
    rows = cases.texts(spark, [(1, text), (1, text), (2, text), (None, text)])
    assert sorted((r.doc_id or 0, r.n_removed) for r in lines.report(rows).collect()) == [(0, 0), (1, 4), (1, 4), (2, 4)]
