import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthway.llm import jaccard, shared
from hearthway.llm.jaccard import Parts, drop_near_duplicates, link_sets, near_duplicates
from hearthway.llm.shared import components
from hearthway.session import cut_lineage, free_shuffles

SCHEMA = "doc_id long, text string, cluster string, component_id int"


def brute(rows, words, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()})
    known = [k for k, (i, _) in enumerate(rows) if i is not None and sets[k]]
    label = {k: k for k in known}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for n, a in enumerate(known):
        for b in known[n + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                label[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k in known:
        least[root(k)] = min(least.get(root(k), rows[k][0]), rows[k][0])
    return sorted(((i, len(sets[k]), least[root(k)] if k in label else i) for k, (i, _) in enumerate(rows)), key=str)


def texts(seed, bases=25, copies=12):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    out = []
    for _ in range(bases):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([4, 12, 30, 90, 300]))] + passage * rng.randint(0, 1)
        for _ in range(rng.randint(1, copies)):
            changed = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
            out.append(" ".join(changed))
    return out


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80), (1, 50)])
def test_components_match_brute_force(spark, words, percent):
    rows = list(enumerate(texts(words)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two"), (None, rows[0][1]), (0, rows[0][1]), (906, "w " * 30_000), (907, "É a b"), (908, "é a b")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(6)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(df, words=words, percent=percent).collect()), key=str)
    assert got == brute(rows, words, percent)


def test_one_id_on_two_texts_with_near_copies(spark):
    rng = random.Random(12)
    rows = []
    for k in range(0, 40, 2):
        for side in (0, 1):
            words = [f"v{rng.randrange(400)}" for _ in range(120)]
            rows += [(k, " ".join(words)), (1000 + k + side, " ".join([*words[:-1], "other"]))]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(df, words=3, percent=90).collect()), key=str)
    assert got == brute(rows, 3, 90)


def test_blocks_of_large_clusters_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 900)
    rows = list(enumerate(texts(11, bases=6, copies=60)))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(df, words=3, percent=90).collect()), key=str)
    assert got == brute(rows, 3, 90)


def test_linked_sets_share_a_part():
    rng = np.random.default_rng(1)
    for percent in (90, 80, 50):
        parts = Parts(percent)
        for _ in range(400):
            size = int(rng.integers(1, 400))
            a = rng.integers(0, 2**64, size, dtype=np.uint64)
            drop, put = rng.integers(0, size // 6 + 1, 2)
            b = np.concatenate([a[drop:], rng.integers(0, 2**64, int(put), dtype=np.uint64)])
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= percent * (len(a) + len(b) - both) and not np.array_equal(a, b):
                assert np.intersect1d(parts.keys(a), parts.keys(b)).size


def test_trees_prune_no_link():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**64, int(rng.integers(3, 200)), dtype=np.uint64)
        for _ in range(int(rng.integers(1, 8))):
            keep = rng.random(len(base)) > 0.06
            sets.append(np.unique(np.append(base[keep], rng.integers(0, 2**64, 1, dtype=np.uint64))))
    label = list(range(len(sets)))

    def root(k):
        return k if label[k] == k else root(label[k])

    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                label[max(root(a), root(b))] = min(root(a), root(b))
    found = link_sets(sets, 80)
    assert len(found) == sum(label[k] != k for k in range(len(sets)))
    assert all(root(a) == root(b) for a, b in found)
    asked = np.arange(len(sets)) % 3 == 0
    assert all(root(a) == root(b) for a, b in link_sets(sets, 80, asked=asked))


def test_empty_table_and_dropping(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).count() == 0
    base = "the quick brown fox jumps over the lazy dog again and again until night"
    rows = spark.createDataFrame([(3, base, "x", 1), (2, base, "y", 2), (5, "other words", None, None), (None, base, "z", 0), (6, None, None, 1)], SCHEMA)
    kept = drop_near_duplicates(rows)
    assert kept.columns == rows.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([2, 5, 6, None], key=str)


def test_long_chains_take_few_rounds(spark):
    edges = spark.range(600).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).repartition(7)
    got = components(edges).collect()
    assert len(got) == 601 and {r["root"] for r in got} == {0}


def test_dropping_judges_each_text_of_an_id(spark):
    base = [f"w{k}" for k in range(40)]
    near, other, third = " ".join([*base, "more"]), " ".join(f"x{k}" for k in range(30)), " ".join(f"y{k}" for k in range(30))
    rows = [(3, " ".join(base), 1), (5, near, 2), (5, other, 3), (7, third, 4), (7, third + " end", 5), (None, other, 6), (8, None, 7), (9, "", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark int").repartition(3)
    left = jaccard.drop_near_duplicates(df)
    assert left.columns == df.columns
    kept = {r["mark"] for r in left.collect()}
    assert kept >= {1, 3, 6, 7, 8} and 2 not in kept and len(kept & {4, 5}) == 1
    assert jaccard.drop_near_duplicates(df.limit(0)).count() == 0


def test_buckets_are_worked_on_one_by_one(spark, monkeypatch):
    """More buckets than partitions, several to a task: the same clusters."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 60, 30)) for _ in range(80)]
    rows = [(k, t + f" a{k % 3}") for k, t in enumerate(texts * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = sorted(map(tuple, jaccard.near_duplicates(df).collect()), key=str)
    monkeypatch.setattr(jaccard, "BUCKET_SHINGLES", 40)
    assert sorted(map(tuple, jaccard.near_duplicates(df).collect()), key=str) == want == brute(rows, 3, 90)


def test_a_stage_has_one_python_step(spark, monkeypatch):
    """Two steps in a stage would start twice the Python workers, which stay in the executors' memory for all later stages."""
    plans = []
    for module in (jaccard, shared):
        monkeypatch.setattr(module, "cut_lineage", lambda df, write=cut_lineage: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    # One large cluster in several blocks, with sets outside its main component.
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 40)
    rng = np.random.default_rng(12)
    body = [f"w{k}" for k in range(60)]
    texts = [" ".join(body[:-1] + [f"x{k}"]) for k in range(8)] + [" ".join(rng.permutation(body)) for _ in range(4)]
    rows = list(enumerate(texts))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=90)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == sorted(brute(rows, 3, 90))
    # What is shuffled is a stage of its own.
    steps = [sum("InArrow" in x or "InPandas" in x for x in part.split("\n")) for plan in plans for part in re.split(r".*Exchange.*", plan)]
    assert max(steps) == 1


def test_shuffles_of_written_steps_are_freed(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {found.apply(k).getName() for k in range(found.size())}

    def step():
        before = files()
        cut_lineage(spark.range(1000).repartition(2, "id"))
        return {x for x in files() - before if x.startswith("shuffle_")}

    first = step()
    step()
    free_shuffles(spark)
    until = time.time() + 30
    while first & files() and time.time() < until:
        time.sleep(0.1)
    assert first and not first & files()


def test_texts_of_a_crowd_without_links_are_not_sent_to_every_block(spark, monkeypatch):
    """Texts tied by common words alone, each with words of its own: before, every block of them met every other one."""
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 300)
    rng = np.random.default_rng(5)
    bodies = [[f"c{x}" for x in rng.choice(60, 30, replace=False)] + [f"own{k}x{j}" for j in range(20)] for k in range(80)]
    bodies += [[*body[:-1], f"changed{k}"] for k, body in enumerate(bodies[:6])]
    rows = [(k, " ".join(x)) for k, x in enumerate(bodies)]
    sent = []
    monkeypatch.setattr(jaccard, "_linked", lambda rows, *a, f=jaccard._linked: sent.append(rows.count()) or f(rows, *a))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), words=1, percent=80)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == sorted(brute(rows, 1, 80))
    assert 12 <= sum(sent) <= len(rows)
