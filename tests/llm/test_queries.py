"""Every query of the subpackage over a small folder of tables: columns, types and what its contract says of its rows."""

from hashlib import sha256
from zlib import crc32

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shoebox.llm.queries import ORACLE, QUERIES
from tests.llm.fixtures import DOCS, documents

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [r for r in dict((r[0], r) for r in documents(3, 60)).values() if r[0] is not None]
    toxic = [(3000 + i, f"{r[1] or 'a b c'} zounderly zoundered", "en", "hot", 1) for i, r in enumerate(rows[10:50])]
    junk = [(5000 + i, "BUY!! NOW!! " * (20 + i), "en", "hot", 1) for i in range(40)]
    spark.createDataFrame(rows + toxic + junk, DOCS).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], 1, 0) for r in rows if r[0] > 9] + [(r[0], 1, 1) for r in toxic] + [(r[0], 0, 0) for r in junk]
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    rng = np.random.default_rng(9)
    base = rng.normal(size=(150, 16))
    base[40:70] = base[0] + rng.normal(size=(30, 16)) * 0.05
    vectors = [(i, [float(x) for x in v], int(i % 3)) for i, v in enumerate(base)] + [(500, None, 1), (501, [0.0] * 16, 1), (550, [1.0, 2.0], 1), (551, [2.0, 1.0], 1), (552, [1.0, 0.0], 2)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="module")
def texts(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def types(df) -> dict:
    return dict(df.dtypes)


def held(i: int) -> bool:
    return crc32(str(i).encode()) % 5 == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_gives_the_same(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    out = QUERIES[name](spark, folder)
    relation = con.sql(ORACLE[name])
    assert sorted(relation.columns) == sorted(out.columns)
    own = sorted(repr([r[c] for c in relation.columns]) for r in out.collect())
    assert own == sorted(repr(list(r)) for r in relation.fetchall())


def test_op1_links(spark, folder):
    out = QUERIES["op1_pivot_permutations"](spark, folder)
    assert list(types(out).items())[:4] == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    got = {r.vec_id: r for r in out.collect()}
    assert len(got) == 155 and all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert sum(r.n_links for r in got.values()) > 200  # the SQL test compares every row of these


def test_op2_mix(spark, folder, texts):
    rows = QUERIES["op2_temperature_mix"](spark, folder).collect()
    assert {r.doc_id for r in rows} <= set(texts) and len({(r.doc_id, r.mix_epoch) for r in rows}) == len(rows)
    assert all(r.mix_tokens == len((texts[r.doc_id] or "").split()) for r in rows)
    weights = {r.source: r.mix_weight for r in rows}
    assert abs(sum(weights.values()) - 1) < 1e-6 and all(0 <= r.mix_position < 1 and r.mix_repeats <= 4 + 1e-6 for r in rows)


def test_op3_scores(spark, folder, texts):
    out = QUERIES["op3_nb_ngrams"](spark, folder)
    assert types(out) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == set(texts)
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    asked = [i for i in texts if held(i) and (i > 9)]
    assert all(got[i].predicted == (3000 <= i < 4000) for i in asked) and any(i >= 3000 for i in asked)


def test_op4_is_the_librarys(spark, folder, texts):
    out = QUERIES["op4_bpe_trie"](spark, folder)
    assert types(out) == {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = out.collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(decoded.encode()).hexdigest())


def test_op5_neighbours(spark, folder):
    out = QUERIES["op5_posting_lists"](spark, folder)
    assert types(out) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r.embedding and any(r.embedding)}
    unit = {i: v / np.linalg.norm(v) for i, v in vectors.items()}
    got = {}
    for r in out.orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
        assert abs(r.score - float(unit[r.query_id] @ unit[r.vec_id])) < 1e-9
    assert set(got) == {0, 50, 100, 550}
    # a length that few vectors have is searched whole
    assert got[550] == [(1, 551), (2, 552)] and all([k for k, _ in got[i]] == [1, 2, 3, 4, 5] for i in (0, 50, 100))
    true = {i: sorted((j for j in unit if j != i and len(unit[j]) == 16), key=lambda j: (-float(unit[i] @ unit[j]), j))[:5] for i in (0, 50, 100)}
    assert sum(len({j for _, j in got[i]} & set(true[i])) for i in true) >= 0.9 * 15


def test_op6_quality(spark, folder, texts):
    got = {r.doc_id: r for r in QUERIES["op6_site_bayes"](spark, folder).collect()}
    assert set(got) == set(texts) and all(r.held_out == held(i) and r.predicted == (r.score >= 0.5) for i, r in got.items())
    assert all(got[i].predicted == (i < 5000) for i in got if held(i) and i > 9)


def test_op8_counts(spark, folder, texts):
    got = {r.doc_id: r.n_tokens for r in QUERIES["op8_viterbi_counts"](spark, folder).collect()}
    assert set(got) == set(texts) and all(n >= 0 for n in got.values()) and got[1] == 0  # tests of the operator compare with the library


def test_op10_shards(spark, folder, texts):
    out = QUERIES["op10_sampled_splitters"](spark, folder)
    assert types(out) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    rows = out.collect()
    assert {(r.doc_id, r["size"], r.text_crc32) for r in rows} == {(i, len((t or "").encode()) + 1, crc32((t or "").encode())) for i, t in texts.items()}
    slots = {}
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op11_columns(spark, folder):
    out = QUERIES["op11_cholesky_jacobi"](spark, folder)
    assert types(out) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    got = {}
    for r in out.collect():
        got.setdefault(r.vec_id, set()).add((r.component, r.n))
    # 151 rows of 16 numbers, and three of 2; the null vector is dropped
    assert got[0] == {(k, 151) for k in range(1, 17)} and got[501] == got[0] and got[550] == {(1, 3), (2, 3)} and 500 not in got and len(got) == 154


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, run in QUERIES.items():
        assert run(spark, str(tmp_path)).collect() == [], name

