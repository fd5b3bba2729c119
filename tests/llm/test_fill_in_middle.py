import hashlib
import re

import pyarrow as pa
import pytest
from hearthway.llm import fill_in_middle as fim
from hypothesis import given, settings
from hypothesis import strategies as st


def brute(doc_id, text, seed=1):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = [None, "", "<", "<P", "a<S>b", "<<S", "P>", "\n\r\x00 \x0b", "ÀÉ kéy ß", "日本 語ab😀c", "\x80\x81\x82 x", "one", "Aa" * 90_000, "é " * 90_000, "a b c " * 900]


def test_matches_brute_force_in_any_batches(spark, monkeypatch):
    texts = ODD * 30 + ["the cat < sat <P on > the S> mat. <"] * 200
    rows = [(k, t, "x", 0) for k, t in enumerate(texts)] + [(None, "no id here", None, 1), (7, "twice", "x", None), (7, "twice", "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(3)
    for size in (1, 2 << 20):
        monkeypatch.setattr(fim, "BATCH_BYTES", size)
        made = fim.fill_in_middle(df)
        assert made.columns == ["doc_id", "text", "form", "n", "n_", "form_", "prefix_chars", "middle_chars", "output"]
        back = fim.restore(made, form_col="form_").collect()
        assert len(back) == len(rows)
        for r in back:
            assert (r["n_"], r["form_"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute(r["doc_id"], r["text"])
            assert r["restored"] == (r["text"] or "")
        assert {r["form_"] for r in back} == {"plain", "psm", "spm"}
    assert fim.restore(fim.fill_in_middle(df.limit(0)), form_col="form_").count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab<PSM>\x00\x80é😀 "), *[st.integers(0, 2**32 - 1)] * 4), min_size=1, max_size=6))
def test_any_text_and_cut_is_lossless(rows):
    texts = pa.array([r[0] for r in rows], pa.large_string())
    made = fim.transform(texts, [pa.array([r[k] for r in rows], pa.int64()) for k in range(1, 5)], 90, 20)
    assert fim.restored(made["output"], made["form"]).to_pylist() == texts.to_pylist()


@pytest.mark.parametrize("share", [0, 100])
def test_shares_are_parameters(spark, share):
    df = spark.createDataFrame([(k, "some words here") for k in range(200)], "doc_id long, text string")
    forms = {r["form"] for r in fim.fill_in_middle(df, plain_from=100, spm_below=share).collect()}
    assert forms == {"spm" if share else "psm"}
    assert {r["form"] for r in fim.fill_in_middle(df, plain_from=0).collect()} == {"plain"}
