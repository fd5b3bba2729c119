import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from hearthway.llm import fuse
from hearthway.llm.exact_dedup import drop_copies, exact_dedup

SCHEMA = "doc_id long, text string, keep_id string, digest string, _own int"
WHITE = " \t\n\x0b\x0c\r"


def brute(rows):
    groups = {}
    for k, (i, t, *_) in enumerate(rows):
        groups.setdefault("".join(c for c in t or "" if c not in WHITE), []).append(k)
    out = []
    for plain, members in groups.items():
        best = min(members, key=lambda k: (-len(rows[k][1] or ""), rows[k][0] is None, rows[k][0] or 0))
        for k in members:
            out.append((rows[k][0], rows[best][0], len(members), hashlib.sha256(plain.encode()).hexdigest()))
    return sorted(out, key=str)


def test_filters_hold_all_keys_and_few_others():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 100, 20_000):
        keys = rng.integers(0, 2**63, n).astype(np.uint64)
        data = fuse.build(np.concatenate([keys, keys[:1]]))
        assert fuse.contains(data, keys).all()
        assert fuse.contains(data, rng.integers(0, 2**63, 20_000).astype(np.uint64)).mean() < 0.01
    assert not fuse.contains(fuse.build(np.zeros(0, np.uint64)), np.arange(5, dtype=np.uint64)).any()


def test_edge_cases_match_brute_force(spark):
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, " \t"), (None, "a b"), (4, "ab"), (5, "a  b"), (6, "é́ x"), (7, "e x"), (8, "ab\x1c"), (9, "a b")]
    rows += [(10, "ab"), (10, "ab"), (11, "long " * 60_000), (12, "long" * 60_000), (None, None)]
    rows += [(k, "".join(rng.choice("ab \n") for _ in range(rng.randint(0, 6)))) for k in range(20, 220)]
    rows = [(i, t, "x", None, 1) for i, t in rows]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = exact_dedup(df, F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=str) == brute(rows)
    assert sum(r["kept"] for r in got) == len({r["text_sha256"] for r in got})
    kept = drop_copies(df, F.lit(True))
    assert kept.columns == df.columns
    assert kept.count() == len({r["text_sha256"] for r in got})


def test_empty_table_and_one_sided_batches(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup(empty, F.lit(False)).count() == 0
    assert drop_copies(empty, F.lit(False)).count() == 0
    rows = spark.createDataFrame([(k, "same", None, None, 0) for k in range(50)], SCHEMA)
    for stored in (F.lit(True), F.lit(False), F.col("doc_id") < 10):
        got = exact_dedup(rows, stored).collect()
        assert {(r["keep_id"], r["group_size"]) for r in got} == {(0, 50)}
        assert [r["doc_id"] for r in got if r["kept"]] == [0]


def test_the_longest_text_of_an_id_stays(spark):
    for rows in ([(5, "ab"), (5, "a   b"), (6, "a b")], [(6, "a b"), (5, "a   b"), (5, "ab")]):
        df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _own string").coalesce(1)
        for stored in (F.lit(True), F.lit(False), F.col("doc_id") == 5):
            left = drop_copies(df, stored)
            assert left.columns == df.columns and [r["text"] for r in left.collect()] == ["a   b"]
    assert drop_copies(df.limit(0), F.lit(True)).count() == 0
