import re
from sys import getsizeof

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from shoebox.llm import bpe, components, hashing, jaccard_join, line_templates, mixture, quality, sharding, toxicity
from shoebox.llm.bpe import ByteBPE, Vocabulary
from shoebox.llm.unigram_count import Counts, UnigramCounter, sentencepiece_vocabulary
from tests.llm.fixtures import DOCS, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumn("id", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("size", F.lit(2))


# ---- BPE


def test_bpe_is_the_librarys(spark, rows, docs):
    bpe, library = ByteBPE(spark, PATH), Tokenizer.from_file(PATH)
    got = docs.select("text", bpe.encode("text").alias("ids"), bpe.round_trip("text").alias("both")).select("text", "ids", "both", bpe.decode("ids").alias("back")).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == r.both.ids == ids and r.both.decoded == r.back
        assert r.back == library.decode(ids, skip_special_tokens=False) == (r.text or "")
    assert docs.limit(0).select(bpe.encode("text")).count() == 0


def test_bpe_of_odd_strings():
    own, library = Vocabulary(open(PATH, "rb").read()), Tokenizer.from_file(PATH)
    rng = np.random.default_rng(4)
    odd = ["a<|endoftext|>b<|endoftext|>", "aaaaaaaaaaaaaaaaaaaa", " " * 90 + "x", "\n\n \t\r\n", "'s're I'LL don't", "the" * 300, "\x00\x01", "=-" * 200 + "!!!!!!!!!!"]
    odd += ["".join(rng.choice(list("aabbcde thE  ñé\n.,123_-'<|>"), rng.integers(1, 40))) for _ in range(800)]
    assert own.encode_batch(odd) == [e.ids for e in library.encode_batch(odd, add_special_tokens=False)]


def test_bpe_keeps_a_bounded_store(monkeypatch):
    """Of words met once a worker keeps two generations, each of a bound and one batch; words met again stay, and all ids are right."""
    own, library = Vocabulary(open(PATH, "rb").read()), Tokenizer.from_file(PATH)
    for bound, batches, words in ((50, 40, 30), (bpe.WORDS_KEPT, 30, 6_000)):
        monkeypatch.setattr(bpe, "WORDS_KEPT", bound)
        for i in range(batches):
            texts = [f"often seen{'<|endoftext|>' * (i % 3)}", " ".join("".join(chr(97 + (i * words + j) // 26**k % 26) for k in range(6)) for j in range(words))]
            assert own.encode_batch(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
            assert len(own.words) + len(own.older) <= 2 * (bound + words + 4) and " seen" in own.words
    held = [(w, ids) for kept in (own.words, own.older) for w, ids in kept.items()]
    assert sum(getsizeof(w) + getsizeof(ids) for w, ids in held) < 120 * len(held)
    longest = pa.array(["word " * 1_000] * 1_000 + ["word " * 200_000])
    assert [len(p) for p in bpe._pieces(longest)] == [50] * 20 + [1]


def test_bpe_walks_words_that_come_again_once():
    """A word that comes again after some ten thousand others keeps its ids, so the work grows with new words, not with all."""
    own, library, walked = Vocabulary(open(PATH, "rb").read()), Tokenizer.from_file(PATH), 0
    walk = own.encode_words

    def counted(words):
        nonlocal walked
        walked += len(words)
        return walk(words)

    own.encode_words = counted
    texts = ["".join(" " + "".join(chr(97 + i // 26**k % 26) for k in range(5)) for i in range(at, at + 5_000)) for at in range(0, 55_000, 5_000)]
    for text in texts * 3:
        assert own.encode_batch([text]) == [library.encode(text, add_special_tokens=False).ids]
    assert walked == 55_000


def test_bpe_decodes_any_ids(spark, monkeypatch):
    """Ids of no vocabulary and nulls decode to nothing; what a cut leaves of a character is replaced as the library does."""
    own, library = ByteBPE(spark, PATH), Tokenizer.from_file(PATH)
    ids = library.encode("größe ñandú 漢字 🙂<|endoftext|>", add_special_tokens=False).ids
    rows = [ids, [-1, *ids, None, 10**6], [], None, *([i] for i in ids)]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "n int, ids array<int>").select("n", own.decode("ids").alias("text")).orderBy("n").collect()
    whole = library.decode(ids, skip_special_tokens=False)
    assert [r.text for r in got] == [whole, whole, "", "", *(library.decode([i], skip_special_tokens=False) for i in ids)]
    monkeypatch.setattr(bpe, "PART_IDS", 3)
    assert Vocabulary(open(PATH, "rb").read()).decode(np.array(ids + ids), [0, len(ids), 2 * len(ids)]) == [whole, whole]


# ---- unigram counts


def test_counts_are_the_librarys(spark, rows, docs):
    pieces, unknown = sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram(pieces, unknown, True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    for r in docs.select("text", UnigramCounter(spark, pieces).count("text").alias("n")).collect():
        assert r.n == len(library.encode(r.text or "", add_special_tokens=False).ids)


def test_counts_without_byte_pieces_and_with_ties():
    pieces = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁", -1.0), ("▁a", -2.0), ("bc", -2.5), ("abc", -3.5)]
    library = Tokenizer(models.Unigram(pieces, 0, False))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    own, rng = Counts(pieces), np.random.default_rng(5)
    for text in ("".join(rng.choice(list("abcx "), rng.integers(1, 12))) for _ in range(500)):
        assert own.text(text) == len(library.encode(text, add_special_tokens=False).ids), text


# ---- n-gram Jaccard join


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard_brute(rows):
    sets = {}
    for r in rows:
        sets[r[0]] = shingles(r[1])
    ids = sorted(i for i in sets if i is not None)
    least = {i: i for i in ids}
    links = [(a, b) for x, a in enumerate(ids) for b in ids[:x] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in ids:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return sets, least


def test_jaccard_components_match_all_pairs(rows, docs):
    sets, least = jaccard_brute(rows)
    got = jaccard_join.jaccard_components(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), least[r.doc_id])
    assert len(set(least.values())) < len(least) - 10


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_of_groups_that_need_every_round(spark, seed, monkeypatch):
    """Chains of near copies around shared passages, small blocks: pivots alone don't settle them."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(3000)]
    rows, passage = [], " ".join(words[:70])
    for g in range(6):
        text = list(rng.choice(words, 90))
        for _ in range(12):
            text = text.copy()
            for _ in range(2):
                text[rng.integers(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + i, f"{passage} {' '.join(rng.choice(words, rng.integers(3, 40)))}") for i in range(25)]
    sets, least = jaccard_brute(rows)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == least


def test_keys_bring_every_similar_pair_together():
    """Pigeonhole: all pairs over the threshold share a key in some band, whatever the order of parts."""
    rng = np.random.default_rng(8)
    missed = 0
    for n in [*range(1, 40), 64, 100, 300]:
        for _ in range(20):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            drop = rng.integers(0, n // 4 + 1)
            add = rng.integers(0, max(0, (4 * (n - drop)) // 3 - n) + 1)
            b = np.unique(np.concatenate((a[drop:], rng.integers(0, 2**63, add).astype(np.uint64))))
            a = np.unique(a)
            union = len(np.union1d(a, b))
            if not len(b) or 100 * len(np.intersect1d(a, b)) < 75 * union:
                continue
            members = np.sort(rng.choice(a, min(3, len(a)), replace=False))
            keys = [{int(k) for band in jaccard_join.bands(len(s)) for k in jaccard_join.part_keys(s, band, members, np.full(len(members), 5))} for s in (a, b)]
            missed += not keys[0] & keys[1]
    assert not missed


def test_jaccard_of_nothing(docs):
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0
    assert {r.n_shingles for r in jaccard_join.jaccard_components(docs.where("doc_id < 3")).collect()} == {0}


def test_an_id_with_two_texts_is_one_document(spark):
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (2, "a b c d e f"), (None, "a b c d e f")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles) for r in got) == [(0, 2), (1, 2), (1, 2), (2, 2)]
    assert {r.component_id for r in got if r.doc_id} == {1}


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 9), (7, 7), (20, 5)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 20: 1, 8: 8, 9: 8, 7: 7}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    texts = [t.encode() for t in ("a b  c\td\ne f", "", " ", "x" * 3000, "Ab cD " * 700)]
    before = hashing.shingle_sets(texts)
    monkeypatch.setattr(hashing, "PIECE", 64)
    assert all((a == b).all() for a, b in zip(before, hashing.shingle_sets(texts)))


# ---- line templates


def lines_brute(rows, least=2):
    held = {}
    for i, text, *_ in rows:
        for at, line in enumerate((text or "").split("\n") if text is not None else []):
            tokens = re.sub("[0-9]+", "0", re.sub(r"[ \t\n\x0B\f\r]+", " ", line)).strip(" ").split(" ")
            if re.search(r"[^ \t\n\x0B\f\r]", line):
                keys = [("w", *tokens)] + ([(c, len(tokens), *tokens[:3], "|", *tokens[c::3]) for c in range(3)] if len(tokens) >= 9 else [])
                for k in keys:
                    held.setdefault(k, []).append((2**63 - 1 if i is None else i, text, at))
    gone = {}
    for where in held.values():
        if len({t for _, t, _ in where}) >= least:
            first = min(i for i, _, _ in where)
            for i, t, at in where:
                if i != first:
                    gone.setdefault((i, t), set()).add(at)
    return gone


def test_lines_match_brute_force(spark, rows, docs):
    extra = [(900 + i, f"visited {i} times on day {i}\nkeep {'abcdefgh'[i]} {'hgfedcba'[i]}\nthe log of host{'abcdefgh'[i]} says that all is well with it today", "en", "a", 1) for i in range(8)]
    both = rows + extra
    gone = lines_brute(both)
    out = line_templates.drop_recurring_lines(docs.select(*DOCS.replace(",", "").split()[::2]).union(spark.createDataFrame(extra, DOCS)))
    got = out.collect()
    assert len(got) == len(both)
    for r in got:
        own = next(t for i, t, *_ in both if i == r.doc_id and (t is None) == (r.lines_n == 0))
        drop = gone.get((2**63 - 1 if r.doc_id is None else r.doc_id, own), set())
        assert r.lines_dropped == len(drop)
        assert r.text == (None if own is None else "\n".join(x for at, x in enumerate(own.split("\n")) if at not in drop))
    assert any(r.lines_dropped == 2 for r in got if r.doc_id and r.doc_id > 900)
    assert line_templates.drop_recurring_lines(docs.limit(0)).count() == 0


# ---- sharding


def test_shards_are_even_and_gapless(rows, docs):
    got = sharding.shard_by_bytes(docs, 4).collect()
    assert len(got) == len(rows)
    from zlib import crc32

    expected = sorted((-1 if i is None else i, len((t or "").encode()) + 1, crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32) for r in got) == expected
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values())
    total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
    assert all(abs(sum(r["size"] for r in rs) - total / 4) <= most for rs in by.values())
    assert sharding.shard_by_bytes(docs.limit(0), 4).count() == 0


def test_a_hot_text_is_spread(spark, monkeypatch):
    rows = [(i, "the same text" if i % 3 else f"text {i}") for i in range(6000)] + [(10000 + i, None) for i in range(3000)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 8).groupBy("shard").agg(F.sum("size").alias("b"), F.max("slot").alias("m"), F.count("*").alias("n")).collect()
    sizes = [r.b for r in got]
    assert len(got) == 8 and max(sizes) - min(sizes) <= sum(sizes) / 8 / 32 and all(r.m == r.n - 1 for r in got)


# ---- mixing


def test_mix_meets_its_targets(spark):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 10 < 8 else "mid" if i % 10 < 9 or i % 50 else "small") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixture.mix(docs, entropy_fraction=0.5, max_repeats=4.0).collect()
    tokens = {}
    for i, t, s in rows:
        tokens[s] = tokens.get(s, 0) + len(t.split())
    total = sum(tokens.values())
    share = {s: n / total for s, n in tokens.items()}
    weight = {r.source: r.mix_weight for r in out}
    exponents = {s: np.log(weight[s] / weight["big"]) / np.log(share[s] / share["big"]) for s in share if s != "big"}
    assert max(exponents.values()) - min(exponents.values()) < 1e-6
    entropy = lambda w: -sum(x * np.log(x) for x in w.values())
    assert abs(entropy(weight) - (entropy(share) + np.log(len(share))) / 2) < 1e-6 or abs(max(weight[s] / share[s] for s in share) - 4) < 1e-6
    assert max(weight[s] / share[s] for s in share) <= 4 + 1e-6
    got = {}
    for r in out:
        got[r.source] = got.get(r.source, 0) + r.mix_tokens
    assert all(abs(got[s] / total - weight[s]) < 0.01 for s in share)
    # whole epochs hold every document once, and any stretch has about the weights
    for s in share:
        whole = [r.doc_id for r in out if r.source == s and r.mix_epoch == 0]
        assert len(whole) == len(set(whole))
        if weight[s] / share[s] >= 1:
            assert len(whole) == sum(1 for x in rows if x[2] == s)
    head = [r for r in out if r.mix_position < 0.5]
    half = sum(r.mix_tokens for r in head)
    assert all(abs(sum(r.mix_tokens for r in head if r.source == s) / half - weight[s]) < 0.05 for s in share)


def test_mix_of_odd_tables(rows, docs):
    out = mixture.mix(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    assert 0 < out.count() < 6 * len(rows)
    assert mixture.mix(docs.limit(0)).count() == 0
    assert mixture.mix(docs.where("text is null")).count() == 0
    natural = mixture.mix(docs, entropy_fraction=0.0, max_repeats=None)
    assert natural.where("mix_epoch > 0").count() == 0


# ---- classifiers


def labelled(spark, bad, n=300, seed=6):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("", "n", "r", "sh")]
    rows = [(i, bad(rng, list(rng.choice(words, rng.integers(5, 60)))) if i % 4 == 0 else " ".join(rng.choice(words, rng.integers(5, 60))), "x" if i % 3 else None, "p") for i in range(n)]
    return spark.createDataFrame(rows + [(9000, None, None, None), (9001, "", "x", "p")], "doc_id long, text string, source string, lang string"), rows


def test_toxicity_finds_held_out_documents(spark):
    def insulted(rng, words):
        words[rng.integers(len(words))] = "zounder" + rng.choice(["ly", "ed", "s"])
        return " ".join(words)

    docs, rows = labelled(spark, insulted)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, *_ in rows if i % 5] + [(1, None), (77777, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.s for r in docs.select("doc_id", model.score(docs).alias("s")).collect()}
    held = [i for i, *_ in rows if i % 5 == 0]
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in held)
    assert 0 <= got[9000] == got[9001] < 0.5
    one = toxicity.train(docs, labels.where("toxic = 0"))
    assert max(r.s for r in docs.select(one.score(docs).alias("s")).collect()) < 1e-9
    none = toxicity.train(docs.limit(0), labels.limit(0))
    assert docs.select(none.score(docs).alias("s")).where("s >= 0.5").count() == 0


def test_quality_finds_held_out_documents(spark):
    docs, rows = labelled(spark, lambda rng, words: "!! ".join(words).upper() if rng.random() < 0.5 else " ".join(w for w in words for _ in range(9)))
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i, *_ in rows if i % 5] + [(1, None)], "doc_id long, quality int")
    out = quality.score_quality(docs, labels)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == docs.count() and out.columns[:4] == docs.columns
    assert sum(got[i].quality_keep == (i % 4 != 0) for i, *_ in rows if i % 5 == 0) >= 0.95 * 60
    assert all(got[i].quality_keep for i, *_ in rows if i % 4)
    blind = quality.score_quality(docs, labels.limit(0)).collect()
    assert all(r.quality_keep and r.quality_evidence == 0 for r in blind)
    assert quality.score_quality(docs.limit(0), labels).count() == 0


def test_sparse_sites_are_shrunk_towards_their_host(spark):
    rows = [(i, "WORD!! WORD!!" if i % 2 else "just some plain words here", "bad" if i % 2 else "good", str(i % 3)) for i in range(600)]
    rows += [(1000, "just some plain words here", "bad", "new"), (1001, "just some plain words here", "fresh", "new")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(600)], "doc_id long, quality int")
    prior = {r.doc_id: r.quality_prior for r in quality.score_quality(docs, labels).collect()}
    assert prior[1] < prior[1000] <= prior[1001] < prior[0]


# ---- names that clash, models against brute force, odd tables


def test_columns_that_are_there_keep_their_names(spark):
    names = ["quality", "quality_keep", "Quality_Prior", "lines_id", "lines_n", "lines_text", "mix_weight", "mix_source", "mix_block"]
    rows = [(i, f"some words {i}\nshared line", "en", "a") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for n in names:
        docs = docs.withColumn(n, F.lit(f"own {n}"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    for out in (quality.score_quality(docs, labels), line_templates.drop_recurring_lines(docs), mixture.mix(docs)):
        assert out.columns[: len(docs.columns)] == docs.columns and len({c.lower() for c in out.columns}) == len(out.columns)
        assert {r[n] for r in out.collect() for n in names} == {f"own {n}" for n in names}
    assert {"quality_", "quality_keep_", "quality_prior_", "quality_evidence"} <= set(quality.score_quality(docs, labels).columns)


def test_a_mix_of_one_source_is_the_table(spark):
    rows = [(i, "w " * (i % 5 + 1), None) for i in range(60)]
    out = mixture.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), blocks=16).collect()
    assert sorted(r.doc_id for r in out) == list(range(60)) and {(r.mix_weight, r.mix_repeats, r.mix_epoch) for r in out} == {(1.0, 1.0, 0)}


def n_grams(text):
    """Places of n-grams, one n-gram at a time."""
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    out = set()
    for order in toxicity.ORDERS:
        for i in range(len(data) - order + 1):
            h = 2166136261 + order
            for b in data[i : i + order]:
                h = (h ^ b) * 16777619 % 2**32
                h ^= h >> 15
            out.add(h >> (32 - toxicity.BITS))
    return out


def test_toxicity_ratios_and_scores_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FEATURES", 40)
    docs, rows = labelled(spark, lambda rng, words: " ".join(["zounder", *words]), n=80)
    docs = docs.union(spark.createDataFrame([(5000, "Long " * 30_000, "x", "p"), rows[0], rows[0]], docs.schema)).withColumn("score", F.lit("clash"))
    labels = {i: int(i % 4 == 0) for i, *_ in rows if i % 5}
    model = toxicity.train(docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    places = {i: n_grams(t) for i, t, *_ in rows}
    n = {y: sum(v == y for v in labels.values()) for y in (0, 1)}
    have = {y: {} for y in (0, 1)}
    for i, y in labels.items():
        for p in places[i]:
            have[y][p] = have[y].get(p, 0) + 1
    every = set(have[0]) | set(have[1])
    ratio = {p: np.log((1 + have[1].get(p, 0)) / (2 + n[1])) - np.log((1 + have[0].get(p, 0)) / (2 + n[0])) for p in every}
    strong = sorted(every, key=lambda p: (-round(abs(ratio[p]) * (have[1].get(p, 0) + have[0].get(p, 0)) ** 0.5, 9), p))[:40]
    assert set(np.flatnonzero(model.own)) <= set(strong) and set(np.flatnonzero(model.rest)) <= every - set(strong)
    scale = [model.rest[p] / ratio[p] for p in every - set(strong) if abs(ratio[p]) > 1e-6]
    assert max(scale) - min(scale) < 1e-9 * max(1, abs(scale[0]))
    got = {r.doc_id: r.s for r in docs.select("doc_id", model.score(docs).alias("s")).collect()}
    for i, t, *_ in [*rows, (5000, "Long " * 30_000), (9000, None)]:
        at = sorted(n_grams(t)) if i == 5000 or i == 9000 else sorted(places[i])
        others = [model.rest[p] for p in at if model.rest[p]]
        z = model.intercept + sum(model.own[p] for p in at) + (sum(others) / len(others) if others else 0)
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-4


def test_quality_by_brute_force(spark):
    import xxhash

    docs, rows = labelled(spark, lambda rng, words: " ".join(f"{w}**" for w in words), n=160)
    rows = [*rows, (5000, "long " * 40_000, "x", "p"), rows[1], rows[1], (9000, None, None, None), (9001, "", "x", "p")]
    docs = spark.createDataFrame(rows, docs.schema)
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i, *_ in rows[:160] if i % 5], "doc_id long, quality int")
    prior, ratios, tables, offset = quality.learn(docs, labels, "doc_id", "text", "quality", quality.MAX_TRAIN)
    share = lambda x: int(np.ceil(np.sqrt(min(x, 1.0)) * (quality.BINS - 1)))

    def evidence(text):
        text = text or ""
        tokens, distinct = text.split(" "), dict.fromkeys(text.lower().split(" "))
        against = [min(max(-float(f"{ratios[xxhash.xxh64(w.encode(), seed=42).intdigest() % 2**64 % quality.PLACES]:.12g}"), 0), quality.AGAINST) / quality.AGAINST for w in distinct]
        words = re.findall(r"\S+", text)
        again = sum(a == b for a, b in zip(words, words[1:]))
        bins = {
            "words": share(sum(against) / (len(distinct) + quality.FEW)), "upper": share(sum(c.isupper() for c in text) / max(1, len(text))), "symbol": share(sum(c in "|*%#&$!@^~_=<>{}\\" for c in text) / max(1, len(text))),
            "again": share(again / max(1, len(words))), "distinct": share(len(set(tokens)) / max(1, len(words))),
        }
        return offset + sum(tables[n][b] for n, b in bins.items())

    logit = lambda p: np.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    e = [evidence(t) for _, t, *_ in rows]
    p = [1 / (1 + np.exp(-(x + logit(prior)))) for x in e]
    sites = [(r[2], r[3]) for r in rows]

    def strength(groups):
        spread = sum(n * (m - a) ** 2 for n, m, a in groups)
        within, total = sum(a * (1 - a) for _, _, a in groups), sum(n * a * (1 - a) for n, _, a in groups)
        return 100.0 if len(groups) < 2 or not total else min(max(1 / max((spread - within) / max(total - within, 1e-9), 1e-6) - 1, 1.0), 1e6)

    of = lambda key: {k: [x for x, s in zip(p, sites) if key(s) == k] for k in {key(s) for s in sites}}
    mean, hosts, paths = sum(p) / len(p), of(lambda s: s[0]), of(lambda s: s)
    a = strength([(len(x), np.mean(x), mean) for x in hosts.values()])
    host_mean = {h: (sum(x) + a * mean) / (len(x) + a) for h, x in hosts.items()}
    b = strength([(len(x), np.mean(x), host_mean[h]) for (h, _), x in paths.items()])
    expected = {}
    for (i, *_), x, own, s in zip(rows, e, p, sites):
        prior_of = (sum(paths[s]) - own + b * host_mean[s[0]]) / (len(paths[s]) - 1 + b)
        expected[i] = (x, prior_of, 1 / (1 + np.exp(-(x + logit(prior_of)))))
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert np.allclose((r.quality_evidence, r.quality_prior, r.quality), expected[r.doc_id], atol=5e-3, rtol=5e-3)


def test_the_least_text_of_an_id_links(spark):
    rows = [(1, "u v w x y z"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "u v w x y z")]
    got = {(r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 3)}


def test_counts_and_codes_of_nothing(spark, docs):
    pieces, _ = sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    none = docs.limit(0)
    assert none.select(UnigramCounter(spark, pieces).count("text").alias("n")).collect() == []
    assert none.select(ByteBPE(spark, PATH).round_trip("text").alias("b")).collect() == []


def test_rows_that_share_text_and_id_are_cut(spark):
    rows = [(7, "the same")] * 4000 + [(None, None)] * 4000 + [(i, f"text {i}") for i in range(4000)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 4).groupBy("shard").agg(F.sum("size").alias("b"), F.max("slot").alias("m"), F.count("*").alias("n")).collect()
    assert len(got) == 4 and max(r.b for r in got) - min(r.b for r in got) <= 20 and all(r.m == r.n - 1 for r in got)
