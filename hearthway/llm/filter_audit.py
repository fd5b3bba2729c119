"""How filters of a corpus depend on the order in which they are applied.

A state is the set of filters applied so far; the states of k filters form a lattice, whose edges each apply one more
filter. Every order of the filters is a path from the empty state to the full one. Documents are counted once per part and set
of failed filters. From these counts follow the documents kept in each state and, as the difference along an edge, those removed by
its filter there. Forward counts say how many orders reach a state, backward counts how many lead on from it, so the two at
the ends of an edge tell how many orders take that edge: weighted with it, the removals of a filter add up to its Shapley
sum. The steps of a single order are read from the same edges.

Only narrow rows are shuffled: identity, digest, part and the failed filters of a document, not its text. The lattice grows with the number of filters, which
is at most `MOST_FILTERS`, and not with the data.

Null texts count as empty, a null language is the part with the empty name. Rows with null ids are never later copies and have no
labels; of rows with equal id and text none is earlier. Where labels of an id differ, one mark is enough. Repeated rows count
each. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthway.session import cut_lineage

#: Orders grow with the factorial of the filters: 40,320 for eight.
MOST_FILTERS = 8
#: Characters between words.
WHITE = r"\x20\x09-\x0D"


def fails_short(text: Column, least: int = 200) -> Column:
    return F.regexp_count(text, F.lit(f"[^{WHITE}]+")) < least


def fails_repetitive(text: Column, percent: int = 50) -> Column:
    """Fewer distinct words than this share of all words."""
    words = F.array_remove(F.split(text, f"[{WHITE}]+"), "")
    return F.size(F.array_distinct(words)) * 100 < F.size(words) * percent


def fails_capitals(text: Column, percent: int = 3) -> Column:
    return F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * percent


def fails_signs(text: Column, signs: str = "#$%&*|") -> Column:
    return text.rlike(f"[{signs}]")


def lattice(names: str) -> tuple[list[tuple], list[tuple]]:
    """Edges (state, next, filter, orders through it) and steps (order, step, filter, state) of filters with one-letter names."""
    if len(names) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters")
    full = (1 << len(names)) - 1
    # States in numeric order: a state's subsets stand before it.
    reaching, leaving = [1] + [0] * full, [0] * full + [1]
    moves = [(s, s | 1 << f, f) for s in range(full + 1) for f in range(len(names)) if not s >> f & 1]
    for s, after, _ in moves:
        reaching[after] += reaching[s]
    for s, after, _ in reversed(moves):
        leaving[s] += leaving[after]
    edges = [(s, after, names[f], reaching[s] * leaving[after]) for s, after, f in moves]
    steps = []
    for order in permutations(names):
        state = 0
        for k, name in enumerate(order):
            steps.append(("".join(order), k + 1, name, state))
            state |= 1 << names.index(name)
    return edges, steps


def failure_counts(docs: DataFrame, labels: DataFrame, rules: dict[str, Column], copies: str, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Documents per (part, failed): n, good, toxic. Bit k of `failed` is the k-th rule; the last bit, named `copies`, marks later copies of a text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    failed = sum((F.when(rule, 1 << k).otherwise(0) for k, rule in enumerate(rules.values())), F.lit(0))
    narrow = cut_lineage(own.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), failed.cast("int").alias("failed")))
    marks = labels.where(F.col(id_col).isNotNull() & ((F.col("quality") == 1) | (F.col("toxic") == 1)))
    marks = marks.groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic")
    )
    # Equal texts fail the same rules but that on copies, so all rows of a text come down to a few: per id first, then per part and labels.
    each = narrow.where("id is not null").groupBy("id", "digest", "part", "failed").agg(F.count("*").alias("n"))
    each = each.join(marks, "id", "left").na.fill(0, ["good", "toxic"])
    grouped = each.groupBy("digest", "part", "failed", "good", "toxic").agg(F.sum("n").alias("n"), F.min("id").alias("first"), F.min_by("n", "id").alias("at_first"))
    least = grouped.groupBy("digest").agg(F.min("first").alias("least"))
    split = grouped.join(least, "digest").withColumn("at_first", F.when(F.col("first") == F.col("least"), F.col("at_first")).otherwise(F.lit(0)))
    bit = 1 << len(rules)
    nameless = narrow.where("id is null").select("part", "failed", F.lit(1).cast("long").alias("n"), F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    kinds = F.explode(F.array(F.struct(F.col("failed").alias("failed"), F.col("at_first").alias("n")), F.struct((F.col("failed") + bit).alias("failed"), (F.col("n") - F.col("at_first")).alias("n"))))
    named = split.select("part", "good", "toxic", kinds.alias("x")).select("part", "x.failed", "x.n", "good", "toxic")
    total = named.where("n > 0").union(nameless).groupBy("part", "failed")
    return total.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def audit(counts: DataFrame, names: str) -> DataFrame:
    """A row per part, order and step from the documents per (part, failed) with n, good and toxic; see the module text."""
    spark = counts.sparkSession
    edges, steps = lattice(names)
    full = (1 << len(names)) - 1
    # The literal tables hold at most 4 ** k, k * 2 ** k and k * k! rows for k filters.
    pairs = spark.createDataFrame([(m, s, int(not m & s)) for m in range(full + 1) for s in range(full + 1)], "failed int, state int, alive int")
    moves = spark.createDataFrame(edges, "state int, next int, filter string, orders long")
    walks = spark.createDataFrame(steps, "filter_order string, step int, filter string, state int")
    alive = [F.sum(F.col(c) * F.col("alive")).alias(c) for c in ("n", "good", "toxic")]
    states = cut_lineage(counts.join(F.broadcast(pairs), "failed").groupBy("part", "state").agg(*alive))
    after = states.select("part", F.col("state").alias("next"), *(F.col(c).alias(f"{c}_after") for c in ("n", "good", "toxic")))
    lost = [(F.col(c) - F.col(f"{c}_after")).alias(name) for c, name in (("n", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost"))]
    passed = states.join(F.broadcast(moves), "state").join(after, ["part", "next"]).select("part", "state", "next", "filter", "orders", F.col("n_after").alias("kept"), *lost)
    passed = cut_lineage(passed)
    first, last = F.col("state") == 0, F.col("next") == full
    totals = passed.groupBy("part", "filter").agg(
        F.sum(F.when(first, F.col("removed"))).alias("failing"), F.sum(F.when(last, F.col("removed"))).alias("unique_fails"), F.sum(F.col("removed") * F.col("orders")).alias("shapley")
    )
    told = passed.join(F.broadcast(walks), ["state", "filter"]).join(totals, ["part", "filter"])
    return told.select("part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The audit of the filters A (short), B (repetitive), C (capitals), D (signs) and E (copies of a smaller id's text)."""
    text = F.col("text")
    rules = {"A": fails_short(text), "B": fails_repetitive(text), "C": fails_capitals(text), "D": fails_signs(text)}
    return audit(failure_counts(docs, labels, rules, "E", id_col, text_col, part_col), "ABCDE")
