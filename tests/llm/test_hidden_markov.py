import math
import re
import zlib

import numpy as np
import pytest
from hearthway.llm import hidden_markov as hm
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, score string, learned int"


def learn():
    return F.crc32(F.col("doc_id").cast("string")) % 5 != 1


def learns(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 != 1


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def base_rows(rows):
    """(id, held out, tokens, known, train tokens, base score) by plain counting."""
    counts = {}
    for i, text in rows:
        for w in [*words(text), None] if learns(i) else []:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, text in rows:
        own = [*words(text), None]
        base = sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        out.append((i, not learns(i), len(own), sum(w in counts for w in own), n, base))
    return sorted(out, key=str)


def plain_pass(model, classes):
    """Likelihood and expected counts of one sequence, without scaling."""
    states, n = len(model.start), len(classes)
    forward = [[model.start[s] * model.emit[classes[0], s] for s in range(states)]]
    for c in classes[1:]:
        forward.append([sum(forward[-1][r] * model.move[r, s] for r in range(states)) * model.emit[c, s] for s in range(states)])
    backward = [[1.0] * states]
    for c in reversed(classes[1:]):
        backward.insert(0, [sum(model.move[s, r] * model.emit[c, r] * backward[0][r] for r in range(states)) for s in range(states)])
    total = sum(forward[-1])
    start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros_like(model.emit)
    for t in range(n):
        for s in range(states):
            chance = forward[t][s] * backward[t][s] / total
            emit[classes[t], s] += chance
            start[s] += chance * (t == 0)
            for r in range(states if t else 0):
                move[r, s] += forward[t - 1][r] * model.move[r, s] * model.emit[classes[t], s] * backward[t][s] / total
    return math.log(total), start, move, emit


def some_model(classes, states, seed):
    rng = np.random.default_rng(seed)
    emit = rng.random((classes, states)) + 0.01
    return hm.Model(hm.unit(rng.random(states)), hm.unit(rng.random((states, states))), emit / emit.sum(axis=0))


@pytest.mark.parametrize("segment,group", [(1, 2), (3, 2), (7, 50), (256, 1)])
def test_segments_give_what_whole_sequences_give(monkeypatch, segment, group):
    monkeypatch.setattr(hm, "SEGMENT", segment)
    monkeypatch.setattr(hm, "GROUP", group)
    model = some_model(6, 3, 1)
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 6, n).tolist() for n in (1, 2, 3, 7, 20, 1, 41)]
    made = hm.Segments(model, np.concatenate(texts), np.array([len(x) for x in texts]))
    one = [plain_pass(model, x) for x in texts]
    assert np.allclose(made.log_likelihood(len(texts)), [x[0] for x in one], rtol=1e-12)
    for got, k in zip(made.expected(), (1, 2, 3)):
        assert np.allclose(got, sum(x[k] for x in one), rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("lone,group", [(1, 1), (2, 3), (4, 2), (7, 50)])
def test_heads_and_tails_give_what_whole_sequences_give(monkeypatch, lone, group):
    monkeypatch.setattr(hm, "SEGMENT", 3)
    monkeypatch.setattr(hm, "GROUP", group)
    monkeypatch.setattr(hm, "LONE", lone)
    model = some_model(6, 3, 6)
    rng = np.random.default_rng(7)
    texts = [rng.integers(0, 6, n).tolist() for n in (1, 30, 5, 17, 30, 1, 41, 17)]
    made = hm.Segments(model, np.concatenate(texts), np.array([len(x) for x in texts]))
    one = [plain_pass(model, x) for x in texts]
    assert np.allclose(made.log_likelihood(len(texts)), [x[0] for x in one], rtol=1e-12)
    for got, k in zip(made.expected(), (1, 2, 3)):
        assert np.allclose(got, sum(x[k] for x in one), rtol=1e-9, atol=1e-12)


def test_long_texts_side_by_side_need_no_products(monkeypatch):
    """A product of moves costs as much as a vector per state; only the few texts that are longer than the others pay it."""
    tokens = []
    product = hm.Segments.product
    monkeypatch.setattr(hm.Segments, "product", lambda self, group: tokens.append(int(self.length[group].sum())) or product(self, group))
    model, rng = some_model(6, 3, 8), np.random.default_rng(9)
    sizes = np.array([1000] * 200 + [3000])
    made = hm.Segments(model, rng.integers(0, 6, sizes.sum()), sizes)
    made.log_likelihood(len(sizes))
    made.expected()
    assert sum(tokens) == 2 * 2000


def test_long_sequences_do_not_underflow():
    model = some_model(6, 3, 3)
    tiny = hm.Model(model.start, model.move, model.emit * 1e-25)
    classes = np.random.default_rng(4).integers(0, 6, 3000)
    logs = [hm.Segments(m, classes, np.array([3000])).log_likelihood(1)[0] for m in (model, tiny)]
    assert np.isclose(logs[1], logs[0] + 3000 * math.log(1e-25), rtol=1e-12)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    kinds = [[f"a{k}" for k in range(30)], [f"b{k}" for k in range(30)]]
    rows = [(k, " ".join(rng.choice(kinds[k % 2], rng.integers(1, 60)))) for k in range(300)]
    odd = [(900, None), (901, ""), (902, " \t\x0b\n"), (903, "Ünder ÀB Cd\x00e"), (904, "never" * 40_000 + " x"), (905, "a1 b2 " * 30_000), (None, "a1 only"), (None, None)]
    return rows + odd + [(5, rows[5][1])] * 3 + [(901, "")]


def test_base_is_that_of_plain_counts(spark, rows, monkeypatch):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], DOCS).repartition(3)
    want = base_rows(rows)
    for size in (300, 8 << 20):
        monkeypatch.setattr(hm, "BLOCK_BYTES", size)
        monkeypatch.setattr(hm, "STEP_BYTES", min(size, 1 << 20))
        made = hm.blocks(df, learn(), "doc_id", "text")
        classed, totals = hm.count_words(made)
        coded = hm.code_texts(made, classed, totals)
        got = sorted(((r["id"], not r["learned"], r["n_tokens"], r["n_known"], totals.tokens, r["base_score"]) for r in coded.collect()), key=str)
        assert [x[:5] for x in got] == [x[:5] for x in want]
        assert np.allclose([x[5] for x in got], [x[5] for x in want], rtol=1e-12)


def test_scores_are_probabilities_of_the_trained_model(spark, rows):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], DOCS).repartition(3)
    made = hm.blocks(df, learn(), "doc_id", "text")
    classed, totals = hm.count_words(made)
    coded = hm.code_texts(made, classed, totals)
    first = hm.first_model(totals, 1)
    texts = {r["id"]: np.frombuffer(r["classes"], np.uint16).tolist() for r in coded.where("id < 300").collect()}
    learned = [np.frombuffer(r["classes"], np.uint16).tolist() for r in coded.where("learned and length(classes) < 2000").collect()]
    # One round over all learned texts, by hand.
    one = hm.learn_round(coded.where("learned and length(classes) < 2000"), first, totals)
    passes = [plain_pass(first, x) for x in learned]
    hand = hm.estimate(*(sum(x[k] for x in passes) for k in (1, 2, 3)), totals)
    assert np.allclose(one.emit, hand.emit) and np.allclose(one.move, hand.move) and np.allclose(one.start, hand.start)
    model = hm.fit(coded, totals)
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1) and np.isclose(model.start.sum(), 1)
    scored = {r["doc_id"]: r for r in hm.score(coded, model, totals, "doc_id").collect()}
    within = {r["id"]: r["within"] for r in coded.collect()}
    for i, classes in texts.items():
        assert np.isclose(scored[i]["score"], plain_pass(model, classes)[0] / math.log(10) + within[i], rtol=1e-10)
    # Two kinds of texts: the states tell them apart, held-out texts included.
    held = [r for i, r in scored.items() if r["held_out"] and i is not None and i < 300]
    assert len(held) > 30 and sum(r["score"] for r in held) > 0.85 * sum(r["base_score"] for r in held)


def test_shares_within_classes_add_up(spark, monkeypatch):
    df = spark.createDataFrame([(2, " ".join(f"w{k}" for k in range(5000)) + " the" * 5000, "", 1)], DOCS)
    monkeypatch.setattr(hm, "OWN", 100)
    monkeypatch.setattr(hm, "SHARED", 7)
    monkeypatch.setattr(hm, "CLASSES", 108)
    classed, totals = hm.count_words(hm.blocks(df, learn(), "doc_id", "text"))
    table = classed.toPandas()
    assert table[table["class"] <= 100]["word"].tolist() == ["the"]
    share = 10.0 ** totals.within(table["count"].to_numpy(), table["class"].to_numpy())
    for k in range(101, 108):
        unseen = 10.0 ** totals.within(np.array([0]), np.array([k]))[0]
        assert np.isclose(share[table["class"] == k].sum() + unseen, 1)
    assert np.isclose(totals.class_mass().sum(), totals.all + 0.5 * 6)


def test_defined_results_without_texts(spark):
    df = spark.createDataFrame([(6, "held out", "", 1), (6, None, "", None)], DOCS)
    got = hm.score_texts(df, F.lit(False)).collect()
    assert {(r["held_out"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got} == {(True, 0, 0, 0.0)}
    assert all(np.isfinite(r["score"]) for r in got)
    assert hm.score_texts(df.limit(0), learn()).count() == 0
    assert hm.score_texts(df, F.lit(True)).columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def test_every_learned_text_moves_the_start(spark, rows, monkeypatch):
    """Without the rounds behind it, the start has read each learned text exactly once and nothing else."""
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], DOCS).repartition(3)
    made = hm.blocks(df, learn(), "doc_id", "text")
    classed, totals = hm.count_words(made)
    coded = hm.code_texts(made, classed, totals)
    read = []
    count = hm.expected_counts
    monkeypatch.setattr(hm, "expected_counts", lambda some, model: read.append(sorted(bytes(r[0]) for r in some.collect())) or count(some, model))
    monkeypatch.setattr(hm, "ROUNDS", 0)
    hm.fit(coded, totals)
    assert sorted(sum(read, [])) == sorted(bytes(r["classes"]) for r in coded.where("learned").collect())
