import re
from itertools import permutations

import pytest
from hearthway.llm.filter_audit import audit_documents, lattice

DOCS = "doc_id long, text string, lang string, quality int, part string"


def failed(text, earlier):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    found = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
    found += "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
    return set(found) | ({"E"} if earlier else set())


def brute(rows, labels):
    """Each order applied to each document."""
    docs = {}
    for i, text, lang, *_ in rows:
        text = text or ""
        earlier = i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in rows)
        good, toxic = (any(a == i and a is not None and b[k] == 1 for a, *b in labels) for k in (0, 1))
        docs.setdefault(lang or "", []).append((failed(text, earlier), good, toxic))
    out = []
    for part, own in docs.items():
        removed_by = dict.fromkeys("ABCDE", 0)
        rows_of = []
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order):
                gone = [d for d in left if name in d[0]]
                left = [d for d in left if name not in d[0]]
                fails = [d for d in own if name in d[0]]
                removed_by[name] += len(gone)
                rows_of.append(["".join(order), step + 1, len(left), len(gone), len(fails) - len(gone), sum(d[0] == {name} for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone)])
        out += [(part, *r, removed_by[r[0][r[1] - 1]]) for r in rows_of]
    return sorted(out)


def test_audit_matches_each_order_by_hand(spark):
    long = " ".join(f"word{k}" for k in range(250))
    rows = [(k, f"{long} {k % 7}", ["en", "de", None][k % 3], 0, "x") for k in range(40)]
    rows += [(100 + k, "SHOUT # " * (k % 4), "en", 1, "y") for k in range(20)]
    rows += [(200 + k, "same\x0bsame same " * 90, "de", 1, "y") for k in range(20)]
    rows += [(None, long, "en", 0, None), (None, long, "en", 0, None), (3, long, "fr", 0, None), (3, long, "fr", 0, None), (4, None, "", 0, None), (5, "", None, 0, None), (7, "A" * 200_000 + " b" * 100_000, "es", None, None)]
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 230, 2)] + [(2, 0, 1), (2, 1, 0), (None, 1, 1), (3, None, 1)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit_documents(df, marks)
    assert got.columns[:3] == ["part", "filter_order", "step"]
    assert sorted(map(tuple, got.collect())) == brute(rows, labels)
    assert sorted(map(tuple, audit_documents(df, marks.limit(0)).collect())) == brute(rows, [])
    assert audit_documents(df.limit(0), marks).count() == 0


def test_every_order_is_a_path():
    edges, steps = lattice("ABCD")
    assert len(edges) == 4 * 8 and len(steps) == 24 * 4
    for state, _, name, orders in edges:
        assert orders == sum(s == state and f == name for _, _, f, s in steps)
    with pytest.raises(ValueError):
        lattice("ABCDEFGHI")
