"""Very many copies of a row, bytes that are no UTF-8, and columns whose names an operator might use."""

import pytest
from pyspark.sql import functions as F

from tagloom.llm import chat_repair, near_copies, pii, simhash_trie, substring_dedup
from tests.llm.test_contracts import PROSE

LONG = PROSE + " " + " ".join(f"w{k}" for k in range(40))


def test_many_copies_of_a_row_hold_their_ranges_once(spark):
    scratch = substring_dedup.Scratch(spark, "test")
    docs = spark.createDataFrame([(1, LONG)], "doc_id long, text string").union(spark.range(50).select(F.lit(2).cast("long"), F.lit("a b " + LONG)))
    ranges = substring_dedup.repeated_ranges(docs.repartition(4), scratch)
    assert ranges.count() == ranges.distinct().count() < 15


def test_twenty_thousand_copies_of_a_row(spark):
    copies = spark.range(20000).select(F.lit(2).cast("long").alias("doc_id"), F.lit("a b " + LONG).alias("text"))
    docs = spark.createDataFrame([(1, LONG), (3, "other words")], "doc_id long, text string").union(copies).repartition(8)
    got = {tuple(r)[:5] for r in substring_dedup.dedup_substrings(docs).groupBy("doc_id", "n_words", "n_removed", "kept").count().collect()}
    n = len(LONG.split())
    assert got == {(1, n, 0, LONG, 1), (2, n + 2, n, "a b", 20000), (3, 2, 0, "other words", 1)}


@pytest.mark.parametrize("keep", [simhash_trie.keep_one, near_copies.keep_near])
def test_all_columns_stay(spark, keep):
    rows = [(1, LONG, 5, "x", 7, "m"), (1, LONG, 5, "x", 7, "m"), (2, LONG, 6, "y", 8, "m"), (None, "other", 9, "z", 1, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id int, __key string, key int, `row` string")
    got = keep(docs)
    assert got.schema == docs.schema and sorted(map(tuple, got.collect()), key=repr) == sorted({rows[0], rows[3]}, key=repr)


def test_bytes_that_are_no_text(spark):
    broken = "concat('mail a@b.org ', cast(X'FF' as string), ' and 10.0.0.1')"
    docs = spark.range(2).select(F.col("id").alias("doc_id"), F.expr(broken).alias("text"))
    found = pii.find(docs).first().spans
    assert [(s.kind, s.start, s.end) for s in found] == [("email", 5, 12), ("ip", 19, 27)]
    assert pii.redact(docs).first().text == "mail [EMAIL] � and [IP]"
    kept = substring_dedup.dedup_substrings(docs).where("doc_id = 1").first()
    assert (kept.n_words, kept.n_removed, kept.kept) == (5, 0, "mail a@b.org � and 10.0.0.1")


def total_cost(rows):
    each = {"keep": chat_repair.KEEP, "relabel": chat_repair.RELABEL, "merge": chat_repair.MERGE}
    return sum(each[r.action] + chat_repair.INSERT * (len(r.inserted) + len(r.closing)) for r in rows)


def test_equal_turns_are_dealt_to_many_parts(spark, monkeypatch):
    turns = [(1, 1, "user", "same")] * 900 + [(1, 2, "assistant", "same")] * 700 + [(2, k, ("user", "assistant")[k % 2], "t") for k in range(300)] + [(None, None, None, None)] * 50
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
    whole = chat_repair.repair_chats(frame).collect()
    monkeypatch.setattr(chat_repair, "PART_TURNS", 60)
    parts = []
    number = chat_repair.boundaries
    monkeypatch.setattr(chat_repair, "boundaries", lambda p: parts.append(len(p)) or number(p))
    split = chat_repair.repair_chats(frame).collect()
    assert max(parts) > 15 and len(split) == len(whole) == len(turns)
    assert total_cost(split) == total_cost(whole)
    one = [(r["code"]) for r in ({"code": chat_repair.code(t[2])} for t in turns if t[0] == 1)]
    best = chat_repair.repair(one)
    cost = sum({"keep": 0, "relabel": chat_repair.RELABEL, "merge": chat_repair.MERGE}[a] + chat_repair.INSERT * len(i) for a, _, i in best) + chat_repair.INSERT * len(chat_repair.closing(best[-1][1]))
    assert total_cost([r for r in split if r.conv_id == 1]) == cost
