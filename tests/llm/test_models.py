import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from hearthway.llm import language_id, quality, topk, toxicity
from hearthway.llm.language_id import Model, identify, keep_identified
from hearthway.llm.shared import column_chunks
from hearthway.llm.topk import top_k

SMALL = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, score string"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def brute_top(rows, k):
    vectors = {n: (i, np.floor(256 * np.array(v, float)).astype(int)) for n, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for n, (i, q) in vectors.items():
        if i % 50 == 0:
            found = sorted((-int(q @ x), j) for m, (j, x) in vectors.items() if m != n and len(x) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def test_top_k_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "PIVOTS", 6)
    monkeypatch.setattr(topk, "BLOCK", 60)
    monkeypatch.setattr(topk, "GROUP", 4)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 8))
    rows = [(int(k), [float(x) for x in centres[k % 5] * 3 + rng.normal(size=8) * 0.1]) for k in range(700)]
    rows += [(k, rows[50][1]) for k in range(700, 800)]  # one vector many times: ties
    rows += [(50, rows[50][1]), (None, rows[0][1]), (1000, None), (1050, [1.0, None] * 4), (1100, [float("nan")] * 8), (1150, [float("inf")] * 8), (1200, []), (1250, [1.0, 2.0]), (1251, [0.5, 2.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(3)
    got = sorted(map(tuple, top_k(df, F.col("vec_id") % 50 == 0).collect()))
    assert got == brute_top(rows, 5)
    assert top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = spark.createDataFrame([(0, [0.1, 0.2], 1), (1, [0.3, 0.1], 1)], df.schema)
    assert [tuple(r)[:3] for r in top_k(few, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1)]


def test_top_k_of_large_components_is_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "PIVOTS", 4)
    monkeypatch.setattr(topk, "BLOCK", 20)
    rng = np.random.default_rng(9)
    rows = [(0, [1.0, 1.0]), (1, [9e6, 0.0]), (2, [1e7, 0.0]), (3, [1.2e7, 0.0]), (50, [-3e12, 7.0]), (100, [1e300, 0.0]), (150, [-1.7e308, 0.0])]
    rows += [(int(k), [float(x) for x in rng.normal(size=2) * 10.0 ** rng.integers(0, 14)]) for k in range(200, 500)]
    rows += [(k, [2.0**40 + k, 2.0**41]) for k in range(501, 530)]
    vectors = {i: [int(np.floor(256 * x)) if abs(x) < 1e305 else int(np.copysign(np.finfo(float).max, x)) for x in v] for i, v in rows}
    wanted = []
    for i, q in vectors.items():
        if i % 50 == 0:
            score = {j: max(topk.LOWEST, min(topk.HIGHEST, sum(a * b for a, b in zip(q, x)))) for j, x in vectors.items() if j != i}
            wanted += [(i, rank + 1, j, score[j]) for rank, j in enumerate(sorted(score, key=lambda j: (-score[j], j))[:5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(map(tuple, top_k(df, F.col("vec_id") % 50 == 0).collect())) == sorted(wanted)
    few = top_k(df.where("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert [tuple(x) for x in few] == [(0, 1, 3, 256**2 * 12_000_000), (0, 2, 2, 256**2 * 10_000_000), (0, 3, 1, 256**2 * 9_000_000)]


def test_dual_trees_drop_pairs():
    rng = np.random.default_rng(1)
    import pandas as pd

    def pack(points, start):
        frame = pd.DataFrame({"row": np.arange(start, start + len(points)), "vec_id": np.arange(start, start + len(points)), "dim": points.shape[1], "vec": [x.astype(np.int32).tobytes() for x in points]})
        return topk.pickle.loads(topk.packed(frame))

    # Tight groups far apart: most node pairs can be ruled out.
    centres = rng.normal(size=(20, 4)) * 1000
    points = np.concatenate([c + rng.normal(size=(60, 4)) * 5 for c in centres])
    calls = []
    offer = topk.Best.offer
    topk.Best.offer = lambda self, *a: (calls.append(a[2].size), offer(self, *a))[1]
    try:
        topk.dual_search(pack(points[::5], 10_000), pack(points, 0), 5, np.full(240, -(2**62)))
    finally:
        topk.Best.offer = offer
    assert sum(calls) < 0.5 * 240 * len(points)


def test_language_edge_cases(spark):
    rows = [(k, f"the quick dog and the cat number{k}" if k % 2 else f"der schnelle hund und die katze nummer{k}", "en" if k % 2 else "de", None, "x") for k in range(200)]
    odd = [(1000, None, "en", None, None), (1001, "", "de", None, None), (1002, "123 !! ²", "en", None, None), (1003, "die katze", None, None, None), (None, "the dog", "en", None, None), (1004, "the dog " * 50_000, "en", None, None), (1005, "hundekatzen", None, None, None)]
    df = spark.createDataFrame(rows + odd, DOCS).repartition(3)
    got = {r["doc_id"]: r for r in identify(df).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang, *_ in rows)
    assert all(got[i]["held_out"] == held(i) for i, *_ in rows)
    assert [(got[k]["lang_pred"], got[k]["score"]) for k in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003]["lang_pred"] == "de" and got[None]["lang_pred"] == "en" and got[1004]["lang_pred"] == "en" and got[1005]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = keep_identified(df)
    assert kept.columns == df.columns and kept.count() == len(rows) + 4
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in identify(unlabelled).collect()} == {"und"}
    assert identify(df.limit(0)).count() == 0


def test_backoff_takes_the_longest_known_ngram():
    model = Model(["a", "b"], {"word": [9, 1]}, {"x": [1, 1], "xy": [1, 30], "_": [5, 5], "y": [2, 1]}, [1, 1])
    assert np.array_equal(model.word("word"), model.words["word"])
    expected = (model.grams["_"] + model.grams["xy"] + model.grams["y"]) / 3
    assert np.allclose(model.word("xy"), expected)


def test_a_rare_language_is_learned_beside_a_frequent_one(spark, monkeypatch):
    monkeypatch.setattr(language_id, "KEPT_WORDS", 40)
    monkeypatch.setattr(language_id, "KEPT_GRAMS", 200)
    rng = np.random.default_rng(5)
    often = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    seldom = ["".join(rng.choice(list("stuvwxyz"), 5)) for _ in range(15)]
    rows = [(k, " ".join(rng.choice(often, 40)), "aa", None, None) for k in range(3000)]
    rows += [(k, " ".join(rng.choice(seldom, 40)), "zz", None, None) for k in range(3000, 3006)]
    df = spark.createDataFrame(rows, DOCS)
    languages, words, _, texts = language_id.fit(df, F.lit(True), rows=60)
    assert languages == ["aa", "zz"] and texts == [3000, 6] and len(words) <= 40
    assert sum(n[1] > 0 for n in words.values()) == 15
    asked = spark.createDataFrame([(1, " ".join(seldom[:6]), "aa", None, None)], DOCS)
    assert [r["lang_pred"] for r in language_id.predict(asked.select("doc_id", "text"), (languages, words, {}, texts)).collect()] == ["zz"]


def test_text_of_an_unlearned_language_scores_low(spark):
    rows = [(k, "the quick dog and the cat" if k % 2 else "der schnelle hund und die katze", "en" if k % 2 else "de", None, None) for k in range(200)]
    foreign = [(1000, "быстрая собака и кошка", None, None, None), (1001, "nopea koira ja kissa juoksivat ulos pihalle", None, None, None), (1002, "the dog and быстрая", None, None, None)]
    df = spark.createDataFrame(rows + foreign, DOCS)
    got = {r["doc_id"]: r["score"] for r in identify(df).collect()}
    assert got[1000] == 0 and got[1001] < 0.5 < got[1002] <= 0.75 and got[1] > 0.9
    assert {r["doc_id"] for r in keep_identified(df).where("doc_id >= 1000").collect()} == {1002}


def test_scores_match_a_plain_reading(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(200)
    languages, words, grams, texts = language_id.fit(docs, ~language_id.held_out())
    logs = {}
    for table in [words] + [{g: c for g, c in grams.items() if len(g) == n} for n in range(1, 5)]:
        sums = [sum(c[k] + 0.5 for c in table.values()) for k in range(len(languages))]
        logs |= {(table is words, x): [np.log((c[k] + 0.5) / sums[k]) for k in range(len(languages))] for x, c in table.items()}
    for row in language_id.predict(docs.select("doc_id", "text"), (languages, words, grams, texts)).collect():
        total, evidence, n = [np.log(t / sum(texts)) for t in texts], 0.0, 0
        for word in language_id.WORD.findall((row["text"] or "").lower()):
            if not any(c.isalpha() for c in word):
                continue
            n += 1
            if word in words:
                found, sure = [logs[True, word]], 1.0
            else:
                marked = f"_{word}_"
                longest = [next((g for g in (marked[k : k + m] for m in (4, 3, 2, 1) if k + m <= len(marked)) if g in grams), None) for k in range(len(marked) - 1)]
                found = [logs[False, g] for g in longest if g]
                sure = sum(len(g) >= 3 for g in longest if g) / max(1, len(marked) - 2)
            total = [t + (sum(f[k] for f in found) / len(found) if found else 0.0) for k, t in enumerate(total)]
            evidence += sure
        best = int(np.argmax(total))
        score = evidence / n / sum(np.exp(t - total[best]) for t in total) if n else 0.0
        assert row["lang_pred"] == (languages[best] if n else "und") and abs(row["score"] - score) < 1e-9


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    lang = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in lang]) > 0.97
    good = quality.classify(docs, labels, F.col("source"), F.col("lang")).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["quality"] == r["predicted"] for r in good]) > 0.93


def test_toxicity_edge_cases(spark):
    rng = np.random.default_rng(0)
    words = [f"w{k}rd" for k in range(60)]
    rows, marks = [], []
    for k in range(600):
        text = " ".join(rng.choice(words, 30))
        bad = k % 6 == 0
        rows.append((k, text + " horribleword" * bad, None, None, "x"))
        if k < 300:
            marks.append((k, int(bad), "y"))
    rows += [(2000, None, None, None, None), (2001, "", None, None, None), (None, "horribleword", None, None, None), (2002, "w1rd " * 50_000, None, None, None)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    labels = spark.createDataFrame(marks + [(None, 1, "y"), (3, None, "y"), (0, 0, "y")], "doc_id long, toxic int, text string")
    got = {r["doc_id"]: r for r in toxicity.classify(df, labels).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert np.mean([got[k]["predicted"] == (k % 6 == 0) for k in range(600)]) > 0.97
    assert got[2000]["score"] == got[2001]["score"] < 0.5
    none = toxicity.classify(df, labels.where("toxic = 0")).collect()
    assert {r["score"] for r in none} == {0.0}
    assert toxicity.classify(df.limit(0), labels).count() == 0


def test_risk_correction_ignores_toxic_among_unlabelled():
    rng = np.random.default_rng(2)
    positive = np.zeros((200, 2), np.uint8)
    positive[:, 0] = 1
    unlabelled = np.zeros((1000, 2), np.uint8)
    unlabelled[:300, 0] = 1
    unlabelled[:, 1] = rng.random(1000) < 0.5
    weight, bias = toxicity.train(positive, unlabelled, 0.3)
    assert weight[0] + bias > 0 > bias


def test_sparse_sites_shrink_to_their_priors(spark):
    rows = []
    for k in range(400):
        host = "good" if k % 2 else "bad"
        rows.append((k, "Fine words in a sentence. " * 3 if (k % 2 or k % 10 == 0) else "@@ !! || " * 9, None, host, None))
    rows += [(5000, "Fine words in a sentence. " * 3, None, "rare", None), (5001, None, None, None, None), (5002, "", "p", None, None)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, int(bool(k % 2 or k % 10 == 0)), 0) for k in range(400)], "doc_id long, quality int, text int")
    got = {r["doc_id"]: r for r in quality.classify(df, labels, F.col("source"), F.col("lang")).collect()}
    assert len(got) == len(rows)
    assert got[1]["host_rate"] > got[5000]["host_rate"] > got[0]["host_rate"]
    assert np.mean([got[k]["predicted"] == int(bool(k % 2 or k % 10 == 0)) for k in range(400)]) > 0.95
    assert quality.classify(df.limit(0), labels, F.col("source"), F.col("lang")).count() == 0
    assert {r["own_score"] for r in quality.classify(df, labels.limit(0), F.col("source"), F.col("lang")).collect()} == {0.5}


def test_a_worker_holds_little_more_than_its_batch(spark, monkeypatch):
    """Texts are strings a step at a time, and the model that travels is the only copy of its tables."""
    monkeypatch.setattr(language_id, "STEP_BYTES", 100)
    column = pa.array(["ä" * 30, None, "x" * 90, "", "y" * 500, "z"])
    assert [(x.start, x.stop) for x in column_chunks(column, 100)] == [(0, 2), (2, 4), (4, 5), (5, 6)]
    assert [(x.start, x.stop) for x in column_chunks(column[1:], 100)] == [(0, 3), (3, 4), (4, 5)]
    assert list(column_chunks(column[:0], 100)) == []
    sent = []
    broadcast = spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(value) or broadcast(value))
    model = (["aa", "bb"], {"one": [9, 1], "two": [1, 9]}, {"o": [3, 1]}, [1, 1])
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["one " * 100, None, "two one two " * 40, "", "12 ²", "oo one"])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert [got[k]["lang_pred"] for k in range(6)] == ["aa", "und", "bb", "und", "und", "aa"]
    assert [round(got[k]["score"], 6) for k in (0, 1, 2, 3, 4)] == [1, 0, 1, 0, 0]
    plain = Model(*model)
    for k, text in ((0, "one " * 100), (2, "two one two " * 40), (5, "oo one")):
        assert np.isclose(plain.score([text])[1][0], got[k]["score"], rtol=1e-12)
    assert len(sent) == 1 and isinstance(sent[0], Model) and sent[0].words.table.shape == (2, 2)
