"""The stages of the pipeline against brute force, each on its own input."""

import hashlib

import corpus_pipeline
import test_jaccard
import test_packing
from hearthway.llm.language_id import identify
from hearthway.llm.secret_scan import redacted

SMALL = "/root/testdata/sf0.001"


def test_each_stage_matches_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = [(90001, None, "en", "s", 0), (90002, "12 34", "en", "s", 5), (90003, "the token=0123456789abcdefX of the", "en", "s", 34), (90003, "the token=0123456789abcdefX of the", "en", "s", 34)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    rows = {}
    frame = docs
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, frame, SMALL).write.parquet(out)
        before, frame = frame, spark.read.parquet(out)
        rows[name] = (before.collect(), frame.collect())
        if name != "packing":
            assert frame.columns == docs.columns

    told = {r["doc_id"]: r for r in identify(docs).collect()}
    before, after = rows["language ID"]
    assert sorted(map(str, after)) == sorted(str(r) for r in before if told[r["doc_id"]]["lang_pred"] != "und" and told[r["doc_id"]]["score"] >= 0.5)
    assert {90001, 90002}.isdisjoint(r["doc_id"] for r in after)

    before, after = rows["exact dedup"]
    groups = {}
    for r in before:
        plain = "".join(c for c in r["text"] if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(hashlib.sha256(plain.encode()).hexdigest(), []).append(r)
    assert sorted(map(str, after)) == sorted(str(min(g, key=lambda r: (-len(r["text"]), r["doc_id"]))) for g in groups.values())

    before, after = rows["n-gram Jaccard join"]
    least = {i: c for i, _, c in test_jaccard.brute([(r["doc_id"], r["text"]) for r in before], 5, 80)}
    assert sorted(map(str, after)) == sorted(str(r) for r in before if least[r["doc_id"]] == r["doc_id"])

    before, after = rows["secret scans"]
    clean = {r["doc_id"]: redacted(r["text"]) for r in before}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in after} == {i: (t, len(t)) for i, t in clean.items()}
    assert len(after) == len(before) and "0123456789abcdef" not in clean[90003]

    before, after = rows["packing"]
    test_packing.check(after, {r["doc_id"]: r["text"] for r in before})


def test_run_applies_the_stages(spark):
    packed = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(packed.columns) and packed.count() > 0
