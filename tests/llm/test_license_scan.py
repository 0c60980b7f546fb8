import re

from flowlake.llm import license_scan as L
from tests.llm.conftest import AWKWARD


def brute(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(k, label) for p, label in L.PHRASES for k in range(len(ws)) if ws[k:k + len(p.split())] == p.split()]
    at = [k for k, _ in hits]
    return len(ws), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


TEXTS = [*AWKWARD, "Released under the MIT License.", "mit\n-- LICENSE mit license. Apache License", "CC BY-NC 4.0 cc by", "the gnu general public",
         "GNU general,public license" * 3, "unit license", "x " * 30_000 + "the MIT license", "Licensed under the GNU General Pubic Licence"]


def test_base_against_brute_force(make_docs):
    out = {r["doc_id"]: r for r in L.scan(make_docs(list(enumerate(TEXTS)) + [(None, TEXTS[8]), (8, TEXTS[8])])).collect()}
    for i, t in enumerate(TEXTS):
        r = out[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t), t[:50]
        assert 0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
    assert L.scan(make_docs([])).count() == 0


def test_fuzzy_notices_with_bounded_edits(make_docs):
    texts = ["Lines. Licensed under CC BY-NC 4.0. More", "Lisensed under the Apache-License, version 2.0", "Permission is herby granted, free of charge, to any person obtaning a copy",
             "permission is granted", "All right reserved", "all reserved", "Licensed under the GNU General Pubic Licence"]
    out = {r["doc_id"]: r for r in L.scan(make_docs(list(enumerate(texts)))).collect()}
    assert [out[i]["labels"] for i in range(7)] == ["cc-by,cc-by-nc", "apache", "mit", "", "all-rights-reserved", "", "gpl"]
    m = [x for x in out[0]["matches"] if x["label"] == "cc-by-nc"][0]
    assert (m["start"], m["end"], m["edits"]) == (1, 8, 0)
    assert out[1]["score"] == 1 > out[2]["score"] > 0.9 and out[3]["score"] == 0


def test_every_edit_within_the_bound_is_found():
    import numpy as np
    book = L.Notices()
    for raw, label, k, _ in book.items:
        for at in range(1, len(raw) - 1, 3):
            for bad in (raw[:at] + raw[at + 1:], raw[:at] + "q" + raw[at:], raw[:at] + "q" + raw[at + 1:]):
                text = "some words " + bad + " more"
                found = book.search(text, np.array([0, len(text)]))
                assert any(book.items[i][1] == label for *_, i, _ in found), (raw, bad)
