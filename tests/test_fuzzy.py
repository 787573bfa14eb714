"""Nearest spellings against the standard library's, over all pairs."""

import difflib
import random

import pytest

from shoebox.operators.fuzzy import closest


def mutated(rng, word):
    for _ in range(rng.choice([0, 1, 1, 2, 3])):
        at = rng.randrange(len(word) + 1)
        word = rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice("abcé z") + word[at:], word[:at] + rng.choice("abc") + word[at + 1 :], word[at:] + word[:at]])
    return word


@pytest.mark.parametrize("cutoff", [0.6, 0.75, 0.85, 0.9])
def test_equals_the_library_over_all_pairs(spark, cutoff):
    rng = random.Random(int(cutoff * 100))
    options = {"".join(rng.choices("abcde", k=rng.choice([1, 2, 3, 4, 5, 7, 9, 14]))) for _ in range(120)} | {"aaaa", "aaaaaaaa", "New York", "new yorks"}
    asked = {mutated(rng, w) for w in rng.choices(sorted(options), k=200)} | {"Aaaaa", "NEW YORK", "x", "a"}
    got = closest(
        spark.createDataFrame([(w,) for w in [*asked, None, "", "x"]], "w string").selectExpr("w", "'clash' as word"), "w",
        spark.createDataFrame([(w,) for w in [*options, None, "", "aaaa"]], "o string").selectExpr("o", "1 as option"), "o", cutoff,
    ).collect()
    low = {o.lower(): o for o in sorted(options)}
    want = {}
    for w in asked - {""}:
        near = difflib.get_close_matches(w.lower(), list(low), n=1, cutoff=cutoff)
        want[w] = low[near[0]] if near else None
    assert len(got) == len(want) and {r.word: r.match for r in got} == want
    assert all((r.score is None) == (r.match is None) for r in got)
    assert None in want.values() and sum(v not in (None, w) for w, v in want.items()) > 20


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "w string"), spark.createDataFrame([("abc",)], "w string")
    assert closest(none, "w", one, "w").count() == 0
    assert [tuple(r) for r in closest(one, "w", none, "w").collect()] == [("abc", None, None)]
