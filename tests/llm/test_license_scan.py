import random
import re

from sylva.llm import license_scan as m

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def base_places(w):
    return [(label, i) for phrase, label in m.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]


def documents(spark, odd):
    rng = random.Random(1)
    rows = []
    parts = ["cc by", "CC-BY", "general public license", "All Rights\nReserved.", "all rights", "reserved", "Licensed under the Apache License, Version 2.0", "mit license", "Général Public License", "x", "y z", "general", "public license"]
    for i in range(300):
        rows.append((1000 + i, " ".join(rng.choice(parts) for _ in range(rng.randrange(12)))))
    rows.append((2000, "Permission is hereby gladly granted, free of charge, to any person obtaining one copy of this software"))
    rows.append((2001, "Permission is what any person wants, free software of charge"))
    rows.append((2002, "filler words " * 30_000 + "all rights reserved"))
    return spark.createDataFrame(rows, "doc_id long, text string").union(odd.select("doc_id", "text"))


def test_base_against_brute_force(spark, odd):
    docs = documents(spark, odd)
    rows = m.scan(docs).collect()
    texts = docs.collect()
    assert len(rows) == len(texts)
    want = sorted((str(t.doc_id), len(w := split(t.text)), tuple(sorted(base_places(w)))) for t in texts)
    got = sorted((str(r.doc_id), r.n_words, tuple(sorted((s.label, s.start) for s in r.spans if s.exact))) for r in rows)
    assert got == want


def test_altered_passages(spark, odd):
    spans = {r.doc_id: {s.label: s.cover for s in r.spans} for r in m.scan(documents(spark, odd)).collect()}
    assert 0.6 <= spans[2000]["mit"] < 1 and spans[2001] == {} and spans[2002] == {"reserved": 1.0}


def labels(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: [(s.label, s.start) for s in sorted(r.spans, key=lambda s: s.start) if not s.exact] for r in m.scan(df).collect()}


def test_licences_that_differ_in_a_word(spark):
    kinds = ["by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"]
    lines = [f"This work is licensed under CC {k.upper()} 4.0." for k in kinds] + [f"It is licensed under the GNU {x}General Public License." for x in ("", "Lesser ", "Affero ")]
    got = labels(spark, [*lines, "x " * 50 + ". ".join(lines), "released under the BSD licence"])
    want = ["cc-by-only", *(f"cc-{k}" for k in kinds[1:]), "gnu", "lgpl", "agpl"]
    assert [got[i] for i in range(9)] == [[(w, 3 if i < 6 else 2)] for i, w in enumerate(want)]
    assert [x for x, _ in got[9]] == want and got[10] == []


def test_whole_texts_in_order(spark):
    rng = random.Random(5)
    texts = [t for t, _ in m.TEMPLATES if len(t.split()) > 40]
    altered = [" ".join(w for w in t.split() if rng.random() > 0.05) for t in texts]
    shuffled = []
    for t in texts:
        parts = [t.split()[i : i + 8] for i in range(0, len(t.split()), 8)]
        rng.shuffle(parts)
        shuffled.append(" ".join(sum(parts, [])))
    got = labels(spark, texts + altered + shuffled)
    for i, t in enumerate(texts):
        label = dict(m.TEMPLATES)[t]
        assert got[i] == [(label, 0)] and {x for x, _ in got[len(texts) + i]} == {label}
    # parts out of order aren't the text, though its grams are there; a sentence left whole may still be named
    assert sum(len(got[2 * len(texts) + i]) for i in range(len(texts))) <= 2


def test_odd(clashing, empty):
    assert m.scan(clashing).count() == clashing.count()
    assert m.scan(empty).count() == 0
