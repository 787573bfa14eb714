"""The stored index of words: stems against the published examples, searches against a scan of all texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from shoebox.functions.english import english_stem
from shoebox.functions.text import STOP_WORDS
from shoebox.sources.word_index import WordIndex

#: Examples that are published with the rules, and words with stems of their own.
EXAMPLES = """caresses caress ponies poni ties tie cats cat agreed agre feed feed plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size
hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valency valenc
digitizer digit conformably conform differently differ vilely vile analogously analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis
hopefulness hope callousness callous formality formal sensitivity sensit sensibility sensibl triplicate triplic formative format formalize formal electricity electr
electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt communism communism activate activ angularity angular homologous homolog effective effect bowdlerize bowdler
probate probat rate rate cease ceas controlling control rolling roll generously generous generate generat generic generic consigning consign consistency consist
consolations consol consolatory consolatori consolingly consol consonant conson conspicuously conspicu conspiracy conspiraci conspirators conspir constables constabl
constancy constanc knackeries knackeri kneading knead kneels kneel knightly knight knitting knit knives knive knockers knocker skis ski dying die news news innings inning
exceeding exceed gas gas this this gaps gap kiwis kiwi cries cri tied tie by by say say cry cri luxuriated luxuri hoped hope youth youth boy boy bed bed embed emb beds bed""".split()


def test_stems_are_the_published_ones(spark):
    want = dict(zip(EXAMPLES[::2], EXAMPLES[1::2]))
    more = {None: None, "": "", "a1s": "a1s", "für": "für", "is": "is", "yes": "yes", "sayings": "say", "singly": "singl"}
    df = spark.createDataFrame([(w,) for w in [*want, *more]], "w string").select("w", english_stem(F.col("w")).alias("s"))
    assert {r.w: r.s for r in df.collect()} == want | more


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rng = random.Random(4)
    vocabulary = ["run", "running", "runs", "happy", "happily", "house", "houses", "the", "of", "relational", "cat", "cats", "zürich", "42"]
    rows = [(i % 180, " ".join(rng.choices(vocabulary, k=rng.randrange(40))), rng.choice([None, "", "Cats, of the HOUSE!", "running"])) for i in range(200)]
    rows.append((None, "cat", "cat"))
    rows.append((500, "cat " * 30_000, None))
    df = spark.createDataFrame(rows, "doc long, body string, keys string").withColumn("token", F.lit("clash")).withColumn("bucket", F.lit(1))
    path = str(tmp_path_factory.mktemp("words"))
    return rows, df, path, WordIndex.build(df, path, "doc", {"body": "body", "keys": "keys"}, 16)


STEM = {"running": "run", "runs": "run", "houses": "hous", "house": "hous", "cats": "cat", "happy": "happi", "relational": "relat"}


def scan(rows, asked, weights):
    said = {STEM.get(w, w) for w in re.findall(r"\w+", asked.lower()) if w not in STOP_WORDS}
    score = {}
    for i, *texts in rows:
        for text, weight in zip(texts, weights):
            hits = sum(STEM.get(w, w) in said for w in re.findall(r"\w+", (text or "").lower()) if w not in STOP_WORDS)
            if hits and i is not None:
                score[i] = score.get(i, 0) + hits * weight
    return sorted(score.items(), key=lambda x: (-x[1], x[0]))


def test_searches_are_those_of_a_scan(spark, built):
    rows, _, _, index = built
    for asked in ("cat", "Running houses", "the relational of ZÜRICH 42", "absent"):
        got = [(r.id, r.score) for r in index.search(asked, 25, {"keys": 0.5}).collect()]
        assert got == scan(rows, asked, (1.0, 0.5))[:25]
    some = spark.range(0, 90)
    got = [(r.id, r.score) for r in index.search("cats", 10, within=some).collect()]
    assert got == [x for x in scan(rows, "cats", (1.0, 1.0)) if x[0] < 90][:10]
    for asked in ("the of", "", "?!"):
        assert index.search(asked, 5).count() == 0


def test_many_queries_are_the_single_ones(spark, built):
    rows, _, _, index = built
    asked = {"a": "cat cats house", "b": "happy", "c": "the", "d": "relational zürich"}
    queries = spark.createDataFrame([*asked.items(), ("e", None)], "query string, words string")
    got = {}
    for r in index.search_many(queries, 7, {"keys": 0.5}).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.id, r.score))
    assert got == {q: scan(rows, w, (1.0, 0.5))[:7] for q, w in asked.items() if q != "c"}


def test_only_the_tokens_buckets_are_read(spark, built):
    index = built[3]
    rows = index.table(["cat"])
    plan = rows._jdf.queryExecution().executedPlan()
    assert rows.count()
    plan.executeCollect()
    scan = plan.collectLeaves().apply(0)
    assert scan.metrics().apply("numPartitions").value() == len({r.bucket for r in index.forms(["cat"]).collect()}) <= 2  # the folders of cat and cats
    assert "word" in scan.metadata().apply("PushedFilters")


def test_a_new_version_and_an_empty_table(spark, built):
    _, df, path, old = built
    assert old.search("cat", 1).count() == 1
    new = WordIndex.build(df.limit(0), path, "doc", {"body": "body"})
    assert new.search("cat", 1).count() == 0 and WordIndex(spark, path).at == new.at
    assert old.search("cat", 1).count() == 1  # what was opened before stays readable
