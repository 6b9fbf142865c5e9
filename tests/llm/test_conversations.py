"""Repair of conversations against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from usageledger.llm import conversation_repair, entries, turn_edits

SF = "/root/testdata/sf0.001"
ROWS = "conv_id long, turn long, role string, text string"


def test_edits_of_all_short_conversations():
    signs = [(r, f) for r in "suao" for f in ("", "truncated")] + [("u", "blank")]
    for n in range(4):
        for rows in itertools.product(signs, repeat=n):
            symbols = "".join(turn_edits.symbol(r, f) for r, f in rows)
            assert turn_edits.repair(symbols) == brute.cheapest_edits(rows), symbols


def test_edits_of_long_runs():
    rng = random.Random(3)
    for _ in range(300):
        rows = []
        for _ in range(rng.randint(1, 9)):
            rows += [(rng.choice("suao"), rng.choice(["", "truncated", "duplicate"]))] * rng.choice([1, 2, 5, 33])
        symbols = "".join(turn_edits.symbol(r, f) for r, f in rows)
        assert turn_edits.repair(symbols) == brute.cheapest_edits(rows), symbols


def test_powers_of_a_run():
    for sign in "suaoSUAO-":
        product = turn_edits.IDENTITY
        for n in range(1, 70):
            product = turn_edits.multiply(product, turn_edits.power(sign, 0))
            assert turn_edits.matrix(sign * n) == product


@pytest.fixture(scope="module")
def awkward():
    """Nulls, blank and long texts, gaps, ties, repeated rows, strange roles, one conversation
    with most of the rows, and one without a row left."""
    rng = random.Random(13)
    texts = ["Yes.", "No!", "Well?", "cut off", "", " \n\t", None, "\x1c", "ok. \x0b\x0c", "dot.\x85", "😀.", "é"]
    roles = ["user", "assistant", "system", None, "", "tool", "User"]
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(roles) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            text = rng.choice(texts) if rng.random() < 0.4 else f"Turn {conv} {turn}."
            rows.append((conv, turn * rng.choice([1, 1, 1, 2]), role, text))
    for turn in range(900):
        rows.append((77, turn, ("user", "assistant", "user")[turn % 3], "Same." if turn % 2 else f"Row {turn}."))
    rows += [(78, 5, "user", "Again and again.")] * 300
    rows += [(79, None, rng.choice(roles), f"No turn {k}.") for k in range(200)]
    rows += [(None, k, "user", f"No id {k}") for k in range(30)] + [(None, None, None, None)]
    rows += [(80, 1, "user", "long " * 50_000 + "."), (80, 2, "assistant", "x" * 300_000)]
    rows += [(k, 0, "user", "Alone.") for k in range(100, 160)]  # some lose their only row
    rng.shuffle(rows)
    return rows


def expected_of(rows):
    return sorted(str((conv, *brute.repaired(kept))) for conv, kept in brute.damaged_rows(rows).items())


@pytest.mark.parametrize("bounds", [{}, {"held_rows": 3, "held_bytes": 64}, {"held_rows": 40}])
def test_repair_of_awkward_rows(spark, awkward, bounds):
    table = spark.createDataFrame(awkward, ROWS).repartition(4)
    for name in ("part", "place", "dropped", "letters", "state", "symbols", "audit", "cost", "copies", "_tie"):
        table = table.withColumn(name, F.lit("clash"))
    found = conversation_repair.repair(conversation_repair.damage(table), **bounds)
    assert sorted(str(tuple(row)) for row in found.collect()) == expected_of(awkward)


def test_conversation_over_many_tasks(spark):
    """One conversation in all of 40 tasks, with equal rows on both sides of an edge."""
    rows = [(1, k // 7, ("user", "assistant", "system")[k % 3], f"Text {k % 50}.") for k in range(1200)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = conversation_repair.repair(conversation_repair.damage(spark.createDataFrame(rows, ROWS))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [str(tuple(row)) for row in found] == expected_of(rows)


def test_repair_query(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    found = entries.op13_conversation_repair(spark, SF)
    assert sorted(str(tuple(row)) for row in found.collect()) == expected_of([tuple(r) for r in rows])


def test_repair_of_no_rows(spark):
    empty = conversation_repair.damage(spark.createDataFrame([], ROWS))
    assert conversation_repair.repair(empty).count() == 0
