from hashlib import sha256

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from shoebox.llm import quality, tables
from tests.llm.fixtures import DOCS, documents
from tests.llm.test_texts import jaccard_brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = documents(2, 80)
    junk = [(5000 + i, "BUY!! NOW!! " * (20 + i), "en", "hot", 1) for i in range(40)]
    spark.createDataFrame(rows + junk, DOCS).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], 1, 0) for r in rows if r[0] is not None and r[0] > 9] + [(r[0], 0, 0) for r in junk] + [(11, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_one_by_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, folder)
        before = {r.doc_id: r for r in docs.collect()}
        rows = out.collect()
        seen.append((name, len(rows)))
        assert {r.doc_id for r in rows} <= set(before)
        if name != "encode":
            assert tuple(out.columns) == pipeline.COLUMNS
        if name == "quality_filter":
            assert not {r.doc_id for r in rows if r.doc_id} & set(range(5000, 5040))
            assert {r.doc_id for r in rows if r.doc_id and r.doc_id > 9} == {i for i in before if i and 9 < i < 5000}
        if name == "near_dedup":
            texts = [(i, r.text) for i, r in before.items()]
            _, least = jaccard_brute(texts)
            assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted({i for i in least.values()})
        if name == "encode":
            library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            for r in (r for r in rows if r.doc_id is not None):
                text = before[r.doc_id].text or ""
                assert r.ids == library.encode(text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)
                assert r.decoded_sha256 == sha256(text.encode()).hexdigest()
        path = f"{folder}/after-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    assert seen[-1][1] > 30


def test_whole_run_and_empty_input(spark, folder, tmp_path):
    assert pipeline.run(spark, folder).select(F.count_distinct("doc_id")).first()[0] > 30
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_passage_in_two_documents_stays_in_the_first(spark, folder):
    passage = "these words are planted in exactly two different documents " * 6
    rows = [(1, f"first alone\n{passage}"), (2, f"{passage}\nsecond alone"), (3, "a copy\nof a text"), (4, "a copy\nof a text")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], DOCS)
    got = {r.doc_id: r.text for r in pipeline.line_dedup(spark, docs, folder).collect()}
    assert got == {1: rows[0][1], 2: "second alone", 3: rows[2][1], 4: rows[3][1]}


@pytest.mark.parametrize("parts", [1, 2, 3, 5])
def test_of_an_id_with_two_texts_the_least_stays(spark, folder, parts):
    a, b = "a text that stands alone in here", "by others this text is held too"
    rows = [(1, b), (2, b), (2, a), (3, None), (3, "c text"), (4, "c text"), (None, b)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], DOCS).repartition(parts)
    got = sorted(((r.doc_id or 0), r.text) for r in pipeline.near_dedup(spark, docs, folder).collect())
    assert got == [(0, b), (1, b), (2, a), (3, "c text")]


@pytest.mark.parametrize("sent", [0, 500_000])
def test_rejected_rows_are_told_by_id_and_digest(spark, folder, monkeypatch, sent):
    """Null ids, id 0, repeated rows, and nulls that trade places between text and site."""
    monkeypatch.setattr(tables, "SENT", sent)
    junk = "BUY!! NOW!! " * 25
    odd = [(None, junk, "en", "hot", 1), (None, "plain words stand here", "en", "hot", 1), (0, junk, "en", "hot", 1), (0, "plain words stand here", None, None, 1)]
    odd += [(5000, "plain words stand here", "en", "hot", 1), (7000, None, "en", junk, 1), (7000, junk, "en", None, 1), (7001, "", "en", "a", 1)] * 2
    docs = spark.read.parquet(f"{folder}/documents.parquet").unionByName(spark.createDataFrame(odd, DOCS)).select(*pipeline.COLUMNS)
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(~pipeline.held_out())
    want = quality.score_quality(docs, labels).where("quality_keep").select(*pipeline.COLUMNS)
    got = pipeline.quality_filter(spark, docs, folder)
    assert 40 < want.count() == got.count() < docs.count() - 40
    assert not got.exceptAll(want).count()


def test_stages_leave_no_texts_and_shuffle_none_for_few_ids(spark, folder):
    once = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    spark.createDataFrame(list(once.values()), DOCS).write.parquet(f"{folder}/once.parquet")
    docs = spark.read.parquet(f"{folder}/once.parquet")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for stage in (pipeline.quality_filter, pipeline.near_dedup):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            with tables.collecting() as made:
                out = stage(spark, docs, folder)
            assert not [t.columns for t in made if t in tables._paths and set(t.columns) - {"doc_id", "row_id", "row_digest"}]
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            assert "hashpartitioning" not in out._jdf.queryExecution().toString()
            spark.conf.set("spark.sql.adaptive.enabled", "true")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
