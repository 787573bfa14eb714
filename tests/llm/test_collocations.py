import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shoebox.llm import collocations
from shoebox.llm.hashing import word_hashes
from tests.llm.fixtures import documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, per_language=2000, subsumed=80):
    counts = {}
    for text, lang in rows:
        own = counts.setdefault(lang or "und" if lang is not None else "und", [Counter() for _ in range(5)])
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, 5):
                own[m].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, own in counts.items():
        n, kept = sum(own[1].values()), []
        for m in (2, 3, 4):
            for g, a in own[m].items():
                longer = [f for k in range(m + 1, 5) for h, f in own[k].items() if f >= least and 100 * f >= subsumed * a and any(h[i : i + m] == g for i in range(k - m + 1))] if a >= least else [0]
                if not longer:
                    score, k, l, r = min((2_000_000 * a // (own[k][g[:k]] + own[m - k][g[k:]]), k, own[k][g[:k]], own[m - k][g[k:]]) for k in range(1, m))
                    kept.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (score, a, g, l, r) in enumerate(sorted(kept)[:per_language]):
            out.append((lang, rank + 1, g.decode(), -a, l, r, n, -score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = ["a", "the", "New", "york", "Ünder", "x-ray", "b\tc", "of", "city", "日本"]
    fixed = ["new york city", "the city of New York", "x-ray of the", "a a a a a", "日本 city;"]
    out = []
    for i in range(150):
        parts = [rng.choice(fixed) if rng.random() < 0.5 else rng.choice(words) for _ in range(rng.randint(0, 40))]
        out.append(("".join(p + rng.choice([" ", " ", "  ", ". ", "\n", ", ", "!"]) for p in parts), rng.choice(["en", "en", "de", None, "und"])))
    out += [(None, "en"), ("", None), (" \t\n ", "fr"), ("one two", "es"), ("new york " * 4000, "en")]
    return out + out[:9] + [(r[1], r[2]) for r in documents(5, 40)]


@pytest.mark.parametrize("least", [30, 3])
def test_phrases_are_those_of_brute_force(spark, rows, least):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "text string, lang string, phrase string, n int").repartition(4)
    got = sorted(tuple(r) for r in collocations.collocations(df, least=least).collect())
    assert got == brute(rows, least) and len(got) > 20
    few = sorted(tuple(r) for r in collocations.collocations(df, least=least, per_language=5).collect())
    assert few == [r for r in brute(rows, least) if r[1] <= 5]


def test_nothing_to_count(spark):
    df = spark.createDataFrame([(None, None), ("a b", "en")], "text string, lang string")
    assert collocations.collocations(df.limit(0)).collect() == [] and collocations.collocations(df).collect() == []


def test_long_texts_are_read_in_overlapping_parts(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["ab", "c", "ddd.", "e" * 50, "\n", "ff,"]) for _ in range(3000))
    batch = [pa.RecordBatch.from_pylist([{"text": text, "lang": "en"}, {"text": "Last words here", "lang": "en"}])]
    bits, heavy = type("sent", (), {"value": np.full(2**collocations.FILTER_BITS // 8, 255, np.uint8)}), type("sent", (), {"value": (np.zeros(0, np.int64), np.zeros(0, np.int64))})

    def count(m):
        found = Counter()
        for out in collocations._stripes(m, bits, heavy, 3)(iter(batch)):
            for r in pa.Table.from_batches(list(collocations._merge(1)(iter([out])))).to_pylist():
                counted = dict(zip(r["next"], r["n"]))
                for following, n in (counted | {0: r["total"] - sum(counted.values())}).items():
                    found[r["p1"], r["p2"], r["p3"], following] += n
        return found

    whole = {m: count(m) for m in (1, 2, 3)}
    words = Counter({r["word"]: r["n"] for out in collocations._count_words(iter(batch)) for r in out.to_pylist()})
    monkeypatch.setattr(collocations, "PIECE", 97)
    assert {m: count(m) for m in whole} == whole and sum(whole[1].values()) == sum(words.values())
    assert words == Counter(re.findall(r"[^\s.,;:!?]+", (text + "\nLast words here").lower()))


def test_stripes_of_common_words_are_sliced_and_merge():
    n, heavy = 500, (np.array([3, 7]), np.array([2, 64]))
    parts = [collocations._batch([np.full(n, 7), np.arange(1, n + 1), np.full(n, c)], heavy, 1000) for c in (1, 2)]
    assert 50 < parts[0].num_rows <= 64 and collocations._batch([np.full(n, 8), np.arange(1, n + 1), np.full(n, 1)], heavy, 1000).num_rows == 1
    both = pa.Table.from_batches(parts).sort_by([("bundle", "ascending")]).combine_chunks()
    merged = pa.Table.from_batches(list(collocations._merge(3)(iter(both.to_batches(max_chunksize=7)))))
    assert 1 < merged.num_rows <= parts[0].num_rows and sum(merged.column("total").to_pylist()) == 3 * n
    assert {c for row in merged.column("n").to_pylist() for c in row} == {3} and sum(len(x) for x in merged.column("next").to_pylist()) == n


def test_words_hash_as_before():
    text = b"One two\tTHREE four"
    data, starts, ends, _ = next(collocations._segments(text))
    assert (collocations.span_hashes(data, starts, ends) == word_hashes([text])[0]).all()
