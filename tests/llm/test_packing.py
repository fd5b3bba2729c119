import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hearthway.llm import packing
from hearthway.llm.packing import Schedule, muldiv, muldiv_negative, pack
from hearthway.llm.tokens import encoder

PATH, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, source string, start int, queue string"
ODD = ["", "  a  b\n\n c   d", "x  y", "\n\n", "a\x1cb \x1c c", "<|endoftext|> hi", "a　 b  ", "don't  'll", "tab\t\tx  y ", "日本 語", "x" * 3000]


def test_ids_are_those_of_the_tokenizer():
    for ranks in (RANKS, None):
        own = encoder(PATH, ranks)
        assert [x.tolist() for x in own.encode([t.encode() for t in ODD])] == [own.plain(t) for t in ODD]
        assert own.encode([]) == []


def check(rows, texts, window=1024):
    own = Tokenizer.from_file(PATH)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids = np.array(own.encode(texts[i] or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for k, pieces in by_sequence.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == window if k < len(by_sequence) - 1 else 0 < at <= window


def test_pieces_cover_documents_and_fill_sequences(spark):
    texts = dict(enumerate([None, *ODD, *("some words to pack " * (k % 90) for k in range(120)), "long text " * 20_000]))
    rows = [(i, t, None if i % 7 == 0 else f"s{i % 3}", 5, "x") for i, t in texts.items()]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    check(pack(df, PATH, RANKS).collect(), texts)
    check(pack(df, PATH, RANKS, weights={"s0": 0.7, "s1": 0.3}).collect(), texts)
    assert pack(df.limit(0), PATH, RANKS).count() == 0
    one = spark.createDataFrame([(None, "a b", None, 0, None), (2**60 + 1, "a b", None, 0, None)], SCHEMA)
    assert {r["doc_id"] for r in pack(one, PATH).collect()} == {None, 2**60 + 1}


def test_schedule_carries_deficits():
    tokens = [256 * 1000, 256 * 317 + 5, 256 * 11, 100]
    schedule = Schedule(tokens, 1024)
    ranks = [schedule.ranks(q, np.arange(schedule.chunks[q])) for q in range(4)]
    assert sorted(np.concatenate(ranks)) == list(range(1328))
    # After any number of chunks each queue has its share, but for a round's worth.
    for q, own in enumerate(ranks):
        for cut in range(0, 1328, 97):
            assert abs((own < cut).sum() - cut * schedule.chunks[q] / 1328) <= 5
    # Given proportions hold while the queues last.
    weighted = Schedule([256 * 1000, 256 * 1000], 1024, [3.0, 1.0])
    first = weighted.ranks(0, np.arange(1000))
    assert abs((first < 400).sum() - 300) <= 5
    assert sorted(np.concatenate([first, weighted.ranks(1, np.arange(1000))])) == list(range(2000))


@pytest.mark.parametrize("x,y,z", [(2**39, 2**37 + 3, 2**37 + 11), (12345, 7, 3), (2**36 + 5, 2**36 + 7, 3), (5, 2**37, 2**38 - 1)])
def test_products_do_not_overflow(x, y, z):
    if x * y // z < 2**62:
        assert muldiv(np.array([x]), y, z)[0] == x * y // z
        assert muldiv_negative(np.array([x]), y, z)[0] == -(-(-x * y // z))


def test_more_sources_than_tasks_know_keep_their_proportions(spark, monkeypatch):
    rows = [(k, "some words to pack " * (40 + 13 * k % 301), f"s{k % 7 if k % 3 else 0}", 0, "x") for k in range(150)] + [(150, "long text " * 3000, "", 0, "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).cache()
    weights = {"s1": 0.5, "s6": 0.3, "": 0.2}
    want = [sorted(map(tuple, pack(df, PATH, RANKS, weights=w).collect())) for w in (None, weights)]
    monkeypatch.setattr(packing, "MOST_QUEUES", 3)
    monkeypatch.setattr(packing, "RUN", 10)
    got = [sorted(map(tuple, pack(df, PATH, RANKS, weights=w).collect())) for w in (None, weights)]
    assert got == want and want[0] != want[1]
