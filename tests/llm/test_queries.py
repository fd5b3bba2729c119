"""The registered queries against their SQL, and digests of the others against plain Python."""

import hashlib
import zlib

import duckdb
import pytest
import test_hidden_markov
import test_jaccard
import test_packing
import test_scans
from hearthway.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def base():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from read_parquet('{SMALL}/{name}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_gives_the_same_rows(spark, base, name):
    want = base.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, want.fetchall()))


@pytest.fixture(scope="module")
def documents(base):
    return base.execute("select doc_id, text from documents").fetchall()


def test_other_queries_cover_all_documents(spark, documents):
    texts = dict(documents)
    test_packing.check(QUERIES["op3_mixture_packing"](spark, SMALL).collect(), texts)
    pieces = {r["doc_id"]: r for r in QUERIES["op4_piece_dropout"](spark, SMALL).collect()}
    assert {i: r["decoded_sha256"] for i, r in pieces.items()} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in texts.items()}
    spans = {r["doc_id"]: r["base_sha256"] for r in QUERIES["op7_secret_scan"](spark, SMALL).collect()}
    for i, text in texts.items():
        listed = ",".join(f"{kind}:{a}:{b}" for a, b, kind in test_scans.base_spans(text or ""))
        assert spans[i] == hashlib.sha256(listed.encode()).hexdigest()
    joined = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in QUERIES["op9_jaccard_join"](spark, SMALL).collect()), key=str)
    assert joined == test_jaccard.brute(documents, 3, 90)
    for name in ("op6_language_id", "op8_quality", "op10_toxicity"):
        rows = QUERIES[name](spark, SMALL).collect()
        assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
        assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    scored = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in QUERIES["op13_hidden_markov"](spark, SMALL).collect()), key=str)
    assert scored == [(*x[:5], round(x[5], 6)) for x in test_hidden_markov.base_rows(documents)]
