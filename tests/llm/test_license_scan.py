import re

import pytest

from veldspar.llm.license_scan import BASE, SuffixAutomaton, license_scan

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text):
    w = WORD.findall(lowered(text))
    places = []
    for label, phrase in BASE.items():
        p = phrase.split()
        places += [(k, label) for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
    at = [k for k, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_places_equal_brute_force(docs):
    got = license_scan(docs).collect()
    assert len(got) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    for r in got:
        if r["id"] is not None:
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(texts[r["id"]])
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    by_id = {r["id"]: r for r in got}
    assert "mit-notice" in by_id[0]["labels"] and "apache-2.0" in by_id[19]["labels"]
    assert by_id[4]["labels"] == "" and by_id[4]["score"] == 0


def test_long_template_is_chained_over_a_change(spark):
    text = "zzz this program is free software you can freely redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
    r = license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert "gpl-notice" in r["labels"] and "gpl" in r["labels"] and r["score"] == 1


def test_empty_table(no_docs):
    assert license_scan(no_docs).count() == 0


@pytest.mark.parametrize("tokens", [[1, 2, 3, 1, 2, 9, 2, 3, 4], [5, 5, 5, 5], [4, 3, 2, 1]])
def test_matching_statistics(tokens):
    seqs = [[1, 2, 3, 4], [2, 3, 1, 2], [5, 5]]
    subs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    want = [max((n for n in range(1, k + 2) if tuple(tokens[k + 1 - n : k + 1]) in subs), default=0) for k in range(len(tokens))]
    assert [n for _, n in SuffixAutomaton(seqs).stream(tokens)] == want


def test_template_spans_come_out(spark):
    notice = "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
    text = f"zzz yyy {notice} " + "other words here " * 20 + notice
    r = license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    n = len(notice.split())
    assert [(s["first_word"], s["last_word"]) for s in r["spans"] if s["label"] == "gpl-notice"] == [(2, n + 1), (n + 62, 2 * n + 61)]
    assert {s["label"] for s in r["spans"]} <= set(r["labels"].split(","))


def test_short_templates_must_be_whole():
    from veldspar.llm.license_scan import Scanner

    labels = [r[5] for r in Scanner().scan(["The book was released under the MIT Press imprint", "It is released under the MIT License.", "Licensed under the Apache License, Version 2.1"])]
    assert labels == ["", "mit,mit-notice", "apache"]


def test_matching_statistics_and_spans_equal_brute_force():
    """Longest matches that end at each word, told by looking for them; and spans whose words are
    those of their template."""
    import random

    from veldspar.llm.license_scan import Scanner, SuffixAutomaton, needed

    rng = random.Random(8)
    sequences = [[rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(5)]
    inside = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    tokens = [rng.randrange(5) for _ in range(400)]
    for k, (_, length) in enumerate(SuffixAutomaton(sequences).stream(tokens)):
        assert length == max((n for n in range(1, 13) if n <= k + 1 and tuple(tokens[k + 1 - n : k + 1]) in inside), default=0)
    templates = {f"t{k}": " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randint(4, 25))) for k in range(6)}
    scanner = Scanner({"b": "zz yy"}, templates)
    for _ in range(60):
        name = rng.choice(sorted(templates))
        own = templates[name].split()
        cut = own[: rng.randint(1, len(own))]
        text = [*(f"x{rng.randrange(50)}" for _ in range(rng.randint(0, 9))), *cut, *(f"q{rng.randrange(50)}" for _ in range(rng.randint(0, 9)))]
        spans = scanner.scan([" ".join(text)])[0][7]
        found = {s["label"] for s in spans}
        if len(cut) >= 2 and len(cut) >= needed(len(own)) * len(own):
            assert name in found
        for s in spans:
            covered = sum(w in templates[s["label"]].split() for w in text[s["first_word"] : s["last_word"] + 1])
            assert s["covered"] >= needed(len(templates[s["label"]].split())) and covered >= round(s["covered"] * len(templates[s["label"]].split()))
