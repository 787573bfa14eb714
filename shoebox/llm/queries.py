"""The queries of the operators in this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.llm import collocations, exact_dedup, jaccard_join, line_templates, mixture, near_vectors, posting_search, quality, sharding, toxicity, whitening
from shoebox.llm.bpe import ByteBPE
from shoebox.llm.tables import read_table, short_batches
from shoebox.llm.unigram_count import UnigramCounter, sentencepiece_vocabulary


def tokenizer_path(name: str) -> str:
    """Where an installed public vocabulary file lies on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pivot_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(read_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op2_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixture.mix(docs, entropy_fraction=0.5, max_repeats=4.0)
    return mixed.select("doc_id", "source", "mix_tokens", "mix_epoch", "mix_block", *[F.round(c, 9).alias(c) for c in ("mix_weight", "mix_repeats", "mix_position")])


def held_out(doc_id: str = "doc_id"):
    """Every fifth document by a hash of its id is kept from training."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def op3_nb_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(~held_out())
    model = toxicity.train(docs.where(~held_out()), labels)
    scored = docs.select("doc_id", held_out().alias("held_out"), model.score(docs).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    bpe = ByteBPE(spark, tokenizer_path("byte_bpe_50k.json"))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", bpe.round_trip("text").alias("bpe"))
    return docs.select(
        "doc_id",
        F.size("bpe.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("bpe.ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("bpe.decoded", 256).alias("decoded_sha256"),
    )


def op5_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return posting_search.nearest(vectors, F.col("vec_id") % 50 == 0, k=5)


def op6_site_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labels = read_table(spark, sf_dir, "labels").where(~held_out())
    rated = quality.score_quality(docs, labels, carry=("doc_id",))
    return rated.select("doc_id", held_out().alias("held_out"), "quality_evidence", "quality_prior", F.col("quality").alias("score"), F.col("quality_keep").cast("int").alias("predicted"))


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.drop_recurring_lines(docs)


def op8_viterbi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    pieces, _ = sentencepiece_vocabulary(tokenizer_path("piece_bpe_32k.model"))
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", UnigramCounter(spark, pieces).count("text").alias("n_tokens"))


def op9_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.jaccard_components(docs)


def op10_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    dealt = sharding.shard_by_bytes(docs, n_shards=16)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_cholesky_jacobi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return collocations.collocations(read_table(spark, sf_dir, "documents").select("text", "lang"))


def op13_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_pivot_permutations, op2_temperature_mix, op3_nb_ngrams, op4_bpe_trie, op5_posting_lists, op6_site_bayes, op7_line_templates, op8_viterbi_counts, op9_parity_join, op10_sampled_splitters, op11_cholesky_jacobi, op12_stripes, op13_chunk_recipes)}

ORACLE = {
    "op1_pivot_permutations": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), link AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
            WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98
        ), reach AS (
            SELECT DISTINCT a, a AS b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
        ), component AS (
            SELECT a, min(b) AS least FROM reach GROUP BY a
        ), number AS (
            SELECT a, count(*) AS n FROM link GROUP BY a
        )
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(least, vec_id) AS component_id, coalesce(least, vec_id) = vec_id AS kept
        FROM embeddings LEFT JOIN component ON vec_id = component.a LEFT JOIN number ON vec_id = number.a
    """,
    "op2_temperature_mix": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, coalesce('=' || source, '') AS src, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS tokens, ('0x' || md5(concat_ws('|', doc_id::VARCHAR, text, '17'))[1:15])::BIGINT % 256 AS block FROM documents
        ), b AS (
            SELECT src, block, sum(tokens)::BIGINT AS tokens FROM d GROUP BY src, block
        ), s AS (
            SELECT src, sum(tokens)::BIGINT AS held, sum(tokens)::DOUBLE / (SELECT sum(tokens) FROM b) AS p FROM b GROUP BY src HAVING sum(tokens) > 0
        ), target AS (
            SELECT (ln(count(*)) - sum(p * ln(p))) / 2 AS h FROM s
        ), entropy AS (
            SELECT 0 AS n, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
            UNION ALL
            SELECT n + 1, CASE WHEN ln(z) - t * l / z <= h + 1e-12 THEN lo ELSE t END, CASE WHEN ln(z) - t * l / z <= h + 1e-12 THEN t ELSE hi END
            FROM (SELECT n, lo, hi, t, h, (SELECT sum(power(p, t)) FROM s) AS z, (SELECT sum(power(p, t) * ln(p)) FROM s) AS l FROM (SELECT *, (lo + hi) / 2 AS t FROM entropy WHERE n < 44), target)
        ), repeats AS (
            SELECT 0 AS n, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
            UNION ALL
            SELECT n + 1, CASE WHEN r / z <= 4 * (1 + 1e-12) THEN lo ELSE t END, CASE WHEN r / z <= 4 * (1 + 1e-12) THEN t ELSE hi END
            FROM (SELECT n, lo, hi, t, (SELECT sum(power(p, t)) FROM s) AS z, (SELECT max(power(p, t) / p) FROM s) AS r FROM (SELECT *, (lo + hi) / 2 AS t FROM repeats WHERE n < 44))
        ), t AS (
            SELECT greatest((SELECT max_by(CASE WHEN lo = 0 THEN 0 ELSE hi END, n) FROM entropy), (SELECT max_by(CASE WHEN lo = 0 THEN 0 ELSE hi END, n) FROM repeats)) AS t
        ), w AS (
            SELECT src, held, power(p, t) / (SELECT sum(power(p, t)) FROM s, t) AS weight, power(p, t) / (SELECT sum(power(p, t)) FROM s, t) * (SELECT sum(tokens) FROM b) / held AS repeats FROM s, t
        ), e AS (
            SELECT *, unnest(range(0, ceil(repeats)::BIGINT)) AS epoch FROM w
        ), o AS (
            SELECT src, block, tokens, held, weight, repeats, epoch,
                sum(tokens) OVER (PARTITION BY src, epoch ORDER BY ('0x' || md5(concat_ws('|', src, block::VARCHAR, epoch::VARCHAR, '17'))[1:15])::BIGINT, block ROWS UNBOUNDED PRECEDING) - tokens AS before FROM b JOIN e USING (src)
        )
        SELECT doc_id, source, d.tokens AS mix_tokens, epoch::INT AS mix_epoch, block::INT AS mix_block, round(weight, 9) AS mix_weight, round(repeats, 9) AS mix_repeats, round((epoch + before / held) / repeats, 9) AS mix_position
        FROM d JOIN o USING (src, block) WHERE epoch + (before + o.tokens / 2) / held < repeats
    """,
    "op9_parity_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)] END) AS s FROM w
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), link AS (
            SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
            GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 75 * (nx.n + ny.n - count(*))
        ), reach AS (
            SELECT DISTINCT a, a AS b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
        ), component AS (
            SELECT a, min(b) AS least FROM reach GROUP BY a
        )
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least, d.doc_id) AS component_id
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN component ON component.a = d.doc_id
    """,
    "op7_line_templates": r"""
        WITH line AS (
            SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL
        ), parsed AS (
            SELECT doc_id, text, pos, string_split(trim(regexp_replace(regexp_replace(line, '[\s\x0B]+', ' ', 'g'), '[0-9]+', '0', 'g')), ' ') AS t FROM line WHERE regexp_matches(line, '\S')
        ), held AS (
            SELECT doc_id, text, pos, unnest(CASE WHEN len(t) >= 9 THEN [
                concat('w', chr(9), array_to_string(t, ' ')),
                concat('0', chr(9), len(t), chr(9), array_to_string(t[1:3], ' '), chr(9), array_to_string([t[i] for i in range(1, len(t) + 1) if (i - 1) % 3 = 0], ' ')),
                concat('1', chr(9), len(t), chr(9), array_to_string(t[1:3], ' '), chr(9), array_to_string([t[i] for i in range(1, len(t) + 1) if (i - 1) % 3 = 1], ' ')),
                concat('2', chr(9), len(t), chr(9), array_to_string(t[1:3], ' '), chr(9), array_to_string([t[i] for i in range(1, len(t) + 1) if (i - 1) % 3 = 2], ' '))
            ] ELSE [concat('w', chr(9), array_to_string(t, ' '))] END) AS template FROM parsed
        ), recurring AS (
            SELECT template, min(doc_id) AS first FROM held GROUP BY template HAVING count(DISTINCT text) >= 2
        ), gone AS (
            SELECT doc_id, text, list(DISTINCT pos) AS gone FROM held JOIN recurring USING (template) WHERE doc_id <> first GROUP BY doc_id, text
        )
        SELECT d.doc_id,
            CASE WHEN gone IS NULL THEN d.text ELSE array_to_string([string_split(d.text, chr(10))[i] for i in range(1, len(string_split(d.text, chr(10))) + 1) if NOT list_contains(gone, i)], chr(10)) END AS text,
            coalesce(len(string_split(d.text, chr(10))), 0)::INT AS lines_n,
            coalesce(len(gone), 0)::INT AS lines_dropped
        FROM documents d LEFT JOIN gone ON d.doc_id = gone.doc_id AND d.text = gone.text
    """,
    "op10_sampled_splitters": """
        WITH crc AS MATERIALIZED (
            SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
        ), r AS MATERIALIZED (
            SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b,
                ('0x' || md5(coalesce(text, ''))[1:15])::BIGINT AS key, ('0x' || md5(doc_id::VARCHAR)[1:15])::BIGINT AS tie FROM documents
        ), o AS (
            SELECT *, sum(size) OVER (ORDER BY key, tie) AS upto, sum(size) OVER (PARTITION BY key) AS held, sum(size) OVER () AS total FROM r
        ), g AS (
            SELECT *, min(upto - size) OVER (PARTITION BY key) AS start FROM o
        ), s AS (
            SELECT *, least(15, floor((CASE WHEN held * 1024 <= total THEN start + held / 2 ELSE upto - size / 2 END) * 16 / total))::INT AS shard FROM g
        )
        SELECT doc_id, size::BIGINT AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1])), 4294967295) AS text_crc32,
            'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY key, tie) - 1 AS slot, NULL::INT AS grown_shard FROM s, crc
    """,
    "op12_stripes": r"""
        WITH piece AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
        ), w AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece
        ), gram AS (
            SELECT lang, m, unnest([w[i : i + m - 1] for i in range(1, len(w) - m + 2)]) AS g FROM w, (SELECT unnest([1, 2, 3, 4]) AS m)
        ), f AS (
            SELECT lang, m, g, count(*) AS f FROM gram GROUP BY ALL HAVING count(*) >= 30
        ), size AS (
            SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang
        ), longer AS (
            SELECT lang, g[i:j] AS g, max(f) AS longest FROM f JOIN (VALUES (1, 2), (2, 3), (3, 4), (1, 3), (2, 4)) AS inside(i, j) ON j <= m AND j - i + 1 < m GROUP BY ALL
        ), cut AS (
            SELECT c.lang, c.g, c.f AS a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f // (x.f + y.f))::BIGINT AS score
            FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1) c JOIN f x ON x.lang = c.lang AND x.g = c.g[1 : k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1 : c.m]
        ), least AS (
            SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
        ), ranked AS (
            SELECT least.lang, row_number() OVER (PARTITION BY least.lang ORDER BY score DESC, a DESC, array_to_string(least.g, ' ')) AS rank, array_to_string(least.g, ' ') AS phrase, a, l, r, score
            FROM least LEFT JOIN longer ON longer.lang = least.lang AND longer.g = least.g WHERE longest IS NULL OR 100::HUGEINT * longest < 80::HUGEINT * a
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN size USING (lang) WHERE rank <= 2000
    """,
    "op13_chunk_recipes": r"""
        WITH t AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
        )
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256 FROM t
    """,
}
