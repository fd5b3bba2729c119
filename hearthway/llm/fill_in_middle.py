"""Fill-in-middle: documents cut into prefix, middle and suffix, and their pieces put in another order.

A text is a row of units, runs of the letters A-Z and a-z or single other characters. Two cuts between units, drawn from a hash of the id, part
it. The output is the plain text, or its pieces behind their marks in the order prefix, suffix, middle (psm) or suffix, prefix, middle (spm).
Texts that hold a mark stay plain, so no mark in an output is part of a text and `restore` gives back the exact text.

Each batch of texts runs through one pipeline of Arrow kernels: a separator that no text of the batch holds is put behind every unit and the texts
are split there; the lists of units are flattened together with the row they come from; the place of a unit within its row tells its role; units
of a role are filtered out, made into lists again and joined. Nothing is shuffled. Batches are cut to about `BATCH_BYTES` of text, so memory
follows the largest single text.

Null and empty texts give a plain empty output of 0 units, a null id is hashed as the empty text. Rows with null ids and repeated rows are formatted like
others. An empty table gives an empty result. All columns of the input stay; a result column whose name is taken gets underscores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthway.llm.shared import free_name

UNIT = r"([A-Za-z]+|[^A-Za-z])"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARK = "<[PSM]>"
#: Text that is worked on at a time.
BATCH_BYTES = 2 << 20
DRAWS = ("_h1", "_h2", "_h3", "_h4")
RESULTS = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}


def draws(id_col: str, seed: int) -> list[Column]:
    """Four integers of 32 bits from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(name) for k, name in enumerate(DRAWS)]


def separator(texts: pa.Array) -> str:
    """A character beyond ASCII that none of the texts holds."""
    characters = (chr(k) for k in range(0x80, 0x110000) if not 0xD800 <= k < 0xE000)
    return next(c for c in characters if not pc.any(pc.match_substring(texts, c)).as_py())


def units(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """All units of all texts, the row of each, and how many each row has."""
    mark = separator(texts)
    lists = pc.split_pattern(pc.replace_substring_regex(texts, UNIT, rf"\1{mark}"), mark)
    # Behind the last separator there is always one empty piece.
    flat, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(real), rows.filter(real), pc.subtract(pc.list_value_length(lists), 1).cast(pa.int64())


def offsets(sizes: pa.Array) -> pa.Array:
    return pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(sizes)])


def transform(texts: pa.Array, drawn: list[pa.Array], plain_from: int, spm_below: int) -> dict[str, pa.Array]:
    """The columns of `RESULTS` for the texts (large strings without nulls) and their draws."""
    flat, rows, n = units(texts)
    h1, h2, h3, h4 = drawn
    ways = pc.add(n, 1)
    cuts = [pc.subtract(h, pc.multiply(pc.divide(h, ways), ways)) for h in (h1, h2)]
    low, high = pc.min_element_wise(*cuts), pc.max_element_wise(*cuts)
    place = pc.subtract(pa.array(np.arange(len(flat))), pc.take(offsets(n), rows))
    before, behind = pc.less(place, pc.take(low, rows)), pc.greater_equal(place, pc.take(high, rows))
    roles = ((before, low), (pc.invert(pc.or_(before, behind)), pc.subtract(high, low)), (behind, pc.subtract(n, high)))
    prefix, middle, suffix = (pc.binary_join(pa.LargeListArray.from_arrays(offsets(size), flat.filter(role)), pa.scalar("", pa.large_string())) for role, size in roles)
    of_hundred = [pc.subtract(h, pc.multiply(pc.divide(h, 100), 100)) for h in (h3, h4)]
    plain = pc.or_(pc.or_(pc.equal(n, 0), pc.match_substring_regex(texts, MARK)), pc.greater_equal(of_hundred[0], plain_from))
    spm = pc.less(of_hundred[1], spm_below)
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    mark = {x: pa.scalar(x, pa.large_string()) for x in (PREFIX, SUFFIX, MIDDLE, "")}
    pieces = {PREFIX: prefix, SUFFIX: suffix, MIDDLE: middle}
    join = lambda *order: pc.binary_join_element_wise(*(x for m in order for x in (mark[m], pieces[m])), mark[""])
    output = pc.if_else(plain, texts, pc.if_else(spm, join(SUFFIX, PREFIX, MIDDLE), join(PREFIX, SUFFIX, MIDDLE)))
    none = pa.scalar(None, pa.int64())
    sizes = [pc.if_else(plain, none, pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
    return dict(zip(RESULTS, (n, form, *sizes, output)))


def restored(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    """The texts that the outputs (large strings) were made from."""
    formatted = pc.not_equal(forms, "plain")
    parts = pc.split_pattern_regex(pc.if_else(formatted, outputs, pa.scalar(PREFIX + SUFFIX + MIDDLE, pa.large_string())), MARK)
    one, two, middle = (pc.list_element(parts, k) for k in (1, 2, 3))
    spm = pc.equal(forms, "spm")
    text = pc.binary_join_element_wise(pc.if_else(spm, two, one), middle, pc.if_else(spm, one, two), pa.scalar("", pa.large_string()))
    return pc.if_else(formatted, text, outputs)


def byte_slices(texts: pa.Array, limit: int) -> Iterator[slice]:
    """Slices of consecutive rows of about `limit` bytes, one row at least."""
    ends = pc.cumulative_sum(pc.binary_length(texts).cast(pa.int64())).to_numpy()
    begin = 0
    while begin < len(texts):
        before = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield slice(begin, stop)
        begin = stop


def whole(column: pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.large_string()), "")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """All rows and columns, with the columns of `RESULTS` behind them.

    `plain_from` percent of the documents are cut, `spm_below` percent of these into spm order. The sizes of the pieces are null where a text stays plain.
    """
    names = [free_name(docs, c) for c in RESULTS]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(name, kind) for name, kind in zip(names, RESULTS.values()))])
    place, width = docs.columns.index(text_col), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(whole(batch.column(place)), BATCH_BYTES):
                rows = batch.slice(part.start, part.stop - part.start)
                made = transform(whole(rows.column(place)), rows.columns[width:], plain_from, spm_below)
                made["output"] = made["output"].cast(pa.string())
                yield pa.RecordBatch.from_arrays([*rows.columns[:width], *made.values()], names=schema.names)

    return docs.select(*(F.col(f"`{c}`") for c in docs.columns), *draws(id_col, seed)).mapInArrow(run, schema)


def restore(formatted: DataFrame, output_col: str = "output", form_col: str = "form", name: str = "restored") -> DataFrame:
    """All rows and columns, with the text that each output was made from."""
    schema = T.StructType([*formatted.schema.fields]).add(name, "string")
    place, form = formatted.columns.index(output_col), formatted.columns.index(form_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(whole(batch.column(place)), BATCH_BYTES):
                rows = batch.slice(part.start, part.stop - part.start)
                texts = restored(whole(rows.column(place)), rows.column(form))
                yield pa.RecordBatch.from_arrays([*rows.columns, texts.cast(pa.string())], names=schema.names)

    return formatted.mapInArrow(run, schema)
