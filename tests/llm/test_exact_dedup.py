import re
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from shoebox.llm import exact_dedup
from tests.llm.fixtures import DOCS, documents


def brute(rows):
    """(id, keep_id, group_size, kept, sha) of (id, text) rows, with how often each comes."""
    normal = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for at, ((i, _), t) in enumerate(zip(rows, normal)):
        groups.setdefault(t, []).append((i is None, i or 0, at))
    out = []
    for at, ((i, _), t) in enumerate(zip(rows, normal)):
        first = min(groups[t])
        out.append((i, rows[first[2]][0], len(groups[t]), first[2] == at, sha256(t.encode()).hexdigest()))
    return Counter(out)


@pytest.fixture(scope="module")
def rows():
    rows = [(r[0], r[1]) for r in documents(7, 60)]
    shared = " ".join(r[1] for r in rows if r[1] and len(r[1]) < 600)
    rows += [(900 + i, t) for i, t in enumerate(("a b", "a  b", "a\t\r\nb", " a b", "a b ", "a b", "\n", "\x0b", shared, shared.replace(" ", "\n"), shared + "!", "y" * 9000, "y" * 9001, "y" * 9000))]
    return rows + [(5, "another text of the id"), (900, "a b"), (899, "a   b"), (None, "only without id"), (None, "only  without id")]


@pytest.mark.parametrize("bits", [64, 3])
def test_groups_are_those_of_brute_force(spark, rows, bits):
    """With 3 bits nearly all chunks share their hash with others and are told apart by content."""
    docs = spark.createDataFrame([(i, t, "c", 1, 2) for i, t in rows], "doc_id long, text string, keep_id string, row int, hash int")
    got = exact_dedup.exact_groups(docs, bits=bits)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == brute(rows)


def test_equal_passages_give_equal_chunks(spark):
    passage = documents(3, 90)[60][1] + " " + " ".join(r[1] for r in documents(4, 40)[12:40])
    docs = spark.createDataFrame([(f"one two three {passage}",), (f"other words before it {passage} and after",)], "text string")
    a, b = (set(r.c) for r in docs.select(exact_dedup._chunks(exact_dedup._marked(F.col("text"))).alias("c")).collect())
    assert len(a) > 4 and len(a & b) >= len(a) - 2
    assert all(len(c) <= exact_dedup.LONGEST for c in a)


def test_carried_columns_and_empty_tables(spark, rows):
    docs = spark.createDataFrame(documents(7, 60), DOCS).withColumn("kept", F.lit("clash"))
    got = exact_dedup.exact_groups(docs, carry=("text", "kept"))
    assert got.columns == ["doc_id", "text", "kept", "keep_id", "group_size", "kept_", "text_sha256"]
    assert {r.kept for r in got.collect()} == {"clash"} and got.where("kept_").count() == got.select("text_sha256").distinct().count()
    assert exact_dedup.exact_groups(docs.limit(0)).collect() == []
    words = spark.createDataFrame([("b", "x"), ("a", "x "), ("c", "x")], "doc_id string, text string")
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_groups(words).collect()) == [("a", "a", True), ("b", "b", True), ("c", "b", False)]
