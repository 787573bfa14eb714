"""More queries with their SQL: organisation by ids of any type, training pairs, tuning, resampling, files and upkeep."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoebox.functions import english, text, vector
from shoebox.operators import aggregate, density, groups, pairs, timeline, tuning, upkeep
from shoebox.plans import filters as flt
from shoebox.plans.catalogue import BUCKET, GAPS, ORACLE, QUERIES, RANKED, query
from shoebox.plans.search import Engine, SearchRequest
from shoebox.schema import Catalog, schema_of
from shoebox.session import ensure_checkpoint_dir
from shoebox.sources import files
from shoebox.sources.vector_index import VectorIndex
from shoebox.sources.word_index import WordIndex
from shoebox.streaming import incremental

__all__ = ["ORACLE", "QUERIES"]


# ---- imports


@query("""
    WITH w AS (SELECT o_orderkey, o_orderpriority AS p, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus <> 'F'),
    t AS (SELECT DISTINCT o_orderpriority AS p, o_custkey AS n FROM orders WHERE o_orderstatus = 'F' AND o_custkey > 0),
    c AS (SELECT p, unnest(range(0, max(k) + (SELECT count(*) FROM t))) AS n FROM w GROUP BY p),
    f AS (SELECT p, n, row_number() OVER (PARTITION BY p ORDER BY n) AS k FROM c ANTI JOIN t USING (p, n))
    SELECT o_orderkey, concat(p, CASE WHEN n = 0 THEN '' ELSE concat('-', n) END, '.jpg') AS free_name FROM w JOIN f USING (p, k)
""")
def import_names(c: Catalog) -> DataFrame:
    """Orders that want a file named after their priority, beside names with numbers that others have."""
    orders = c["orders"].select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey")
    wanted = orders.where("o_orderstatus <> 'F'").select("o_orderkey", F.concat("o_orderpriority", F.lit(".jpg")).alias("name"))
    taken = orders.where("o_orderstatus = 'F'").select(F.concat_ws("-", "o_orderpriority", "o_custkey").alias("name")).select(F.concat("name", F.lit(".jpg")).alias("name")).distinct()
    return upkeep.free_names(wanted, taken, "name", [F.col("o_orderkey")]).select("o_orderkey", "free_name")


# ---- a stored index of vectors


@query("""
    WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e AS q FROM v WHERE vec_id = 7),
    s AS (SELECT vec_id, label, e, list_dot_product(e, q) / sqrt(list_dot_product(e, e) * list_dot_product(q, q)) AS score FROM v, q),
    f AS (SELECT 'all' AS kept, * FROM s UNION ALL SELECT 'label' AS kept, * FROM s WHERE label = 2 UNION ALL SELECT 'few' AS kept, * FROM s WHERE e[1] > 0.3)
    SELECT kept, row_number() OVER (PARTITION BY kept ORDER BY score DESC, vec_id)::INT AS rank, vec_id, round(score, 6) AS score FROM f
    QUALIFY row_number() OVER (PARTITION BY kept ORDER BY score DESC, vec_id) <= 10
""")
def vector_index_topk(c: Catalog) -> DataFrame:
    """The ten nearest of all rows, of one label's and of a few, from an index in cells."""
    ensure_checkpoint_dir(c.spark)
    path = f"{c.spark.sparkContext.getCheckpointDir().rstrip('/')}/vector-index-{uuid.uuid4().hex}"
    index = VectorIndex.build(c["embeddings"].select("vec_id", "label", "embedding"), path, "vec_id", "embedding")
    (asked,) = c["embeddings"].where("vec_id = 7").select("embedding").first()
    filters = {"all": None, "label": F.col("label") == 2, "few": F.element_at("embedding", 1) > 0.3}
    hits = [index.search(asked, 10, where, exact=True).hits.withColumn("kept", F.lit(kept)) for kept, where in filters.items()]
    order = Window.partitionBy("kept").orderBy(F.desc("score"), "vec_id")  # ten rows each
    return reduce(DataFrame.unionByName, hits).select("kept", F.row_number().over(order).alias("rank"), "vec_id", F.round("score", 6).alias("score"))


# ---- many searches in one plan


@dataclass(frozen=True)
class Frames(Catalog):
    """A catalogue of frames that are made from other tables; tables that are not given are empty."""

    frames: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, table: str) -> DataFrame:
        schema, given = schema_of(table), self.frames.get(table)
        if given is None:
            return self.spark.createDataFrame([], schema)
        return given.select(*[(F.col(f.name) if f.name in given.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


@query("""
    WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    r AS (SELECT q.vec_id AS query, x.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.e, x.e), 12) DESC, x.vec_id)::INT AS rank
    FROM v q JOIN v x ON x.label = q.label WHERE q.vec_id % 20 = 0)
    SELECT query, rank, vec_id, round(1.0 / (60 + rank), 12) AS score FROM r WHERE rank <= 20
""")
def batch_search(c: Catalog) -> DataFrame:
    """Each stated query's page among the rows of its label: one request for each, all in one plan."""
    rows = c["embeddings"].select(F.format_string("%012d", "vec_id").alias("id"), "label", "embedding")
    photos = rows.select("id", F.lit("image").alias("media_type"), F.col("label").alias("iso"))
    library = Frames(c.spark, c.root, {"photos": photos, "image_embeddings": rows.select(F.col("id").alias("photo_id"), F.lit("default").alias("model"), "embedding")})
    asked = c["embeddings"].where("vec_id % 20 = 0").select("vec_id", "label", "embedding").toLocalIterator()  # requests, as a caller would have them
    requests = {str(r.vec_id): SearchRequest(query_vector=tuple(r.embedding), filters=flt.SearchFilters(iso_min=r.label, iso_max=r.label)) for r in asked}
    found = Engine(library).search_many(requests)
    return found.select(F.col("query").cast("long").alias("query"), "rank", F.col("id").cast("long").alias("vec_id"), F.round("score", 12).alias("score"))


# ---- listings and filters


@query("""
    WITH r AS (SELECT p_partkey, p_size * 25 AS w, p_retailprice AS h FROM part)
    SELECT p_partkey, CASE WHEN abs(w - h) <= 0.05 * greatest(w, h) THEN 'square' WHEN w > 1.05 * h THEN 'landscape' ELSE 'portrait' END AS shape
    FROM r WHERE abs(w - h) <= 0.05 * greatest(w, h) OR w > 1.05 * h OR h > 1.05 * w
""")
def filter_orientation(c: Catalog) -> DataFrame:
    rows = c["part"].select("p_partkey", (F.col("p_size") * 25).alias("w"), F.col("p_retailprice").alias("h"))
    is_ = {kind: flt.oriented(F.col("w"), F.col("h"), kind) for kind in ("square", "landscape", "portrait")}
    shape = F.when(is_["square"], "square").when(is_["landscape"], "landscape").when(is_["portrait"], "portrait")
    return rows.select("p_partkey", shape.alias("shape")).where("shape is not null")


@query("""
    SELECT event_id, ts, count(*) OVER () AS total FROM events
    WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-09' ORDER BY ts DESC, event_id LIMIT 25
""")
def range_newest(c: Catalog) -> DataFrame:
    from datetime import date

    rows = c["events"].select("event_id", "ts")
    return aggregate.range_newest(rows, "ts", "event_id", flt.date_range(F.col("ts"), date(2024, 1, 2), date(2024, 1, 8)), 25)


@query("""
    WITH p AS (SELECT c_custkey AS cluster_id, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS name FROM customer),
    f AS (SELECT o_custkey AS cluster_id, o_orderkey AS id, o_orderdate::DATE AS photo_id, o_totalprice AS det_score FROM orders)
    SELECT cluster_id, name, count(*) AS n_faces, count(DISTINCT photo_id) AS n_photos, array_to_string((array_agg(id
    ORDER BY det_score DESC NULLS LAST, id))[1:6], ',') AS sample_faces
    FROM p JOIN f USING (cluster_id) GROUP BY cluster_id, name
""")
def people_list(c: Catalog) -> DataFrame:
    people = c["customer"].select(F.col("c_custkey").alias("cluster_id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("name"), F.lit(False).alias("hidden"))
    faces = c["orders"].select(F.col("o_custkey").alias("cluster_id"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("photo_id"), F.col("o_totalprice").alias("det_score"))
    return aggregate.people_list(people, faces).withColumn("sample_faces", F.array_join("sample_faces", ","))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def counts_by_model(c: Catalog) -> DataFrame:
    return c["embeddings"].groupBy("label").agg(F.count("*").alias("n"))


# ---- approximate search


@query("""
    SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q), 6) AS score FROM embeddings, (SELECT embedding::DOUBLE[] AS q FROM embeddings
    WHERE vec_id = 7)
    ORDER BY list_dot_product(embedding::DOUBLE[], q) DESC, vec_id LIMIT 20
""")
def vector_topk_codes(c: Catalog) -> DataFrame:
    """Approximate by rule; with ten times as many candidates it finds on these tables what the exact search finds."""
    rows = c["embeddings"].select("vec_id", "embedding", vector.codes("embedding").alias("codes"))
    asked = list(c["embeddings"].where("vec_id = 7").first().embedding)
    return vector.top_k_by_codes(rows, "embedding", "codes", asked, 20, "vec_id").withColumn("score", F.round("score", 6))


# ---- groups, with ids that are text

CHAINED = """
    e AS (SELECT o_orderkey::VARCHAR AS a, before::VARCHAR AS b FROM (
        SELECT o_orderkey, o_orderdate, lag(o_orderkey) OVER w AS before, lag(o_orderdate) OVER w AS was
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
    ) WHERE before IS NOT NULL AND epoch(o_orderdate) - epoch(was) <= 90 * 86400),
    b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    reach AS (SELECT a, b FROM b UNION SELECT reach.a, b.b FROM reach JOIN b ON reach.b = b.a)
"""


@query(f"WITH RECURSIVE {CHAINED} SELECT a AS node, least(a, min(b)) AS component FROM reach GROUP BY a")
def components_of_text_ids(c: Catalog) -> DataFrame:
    """Orders of a customer at most 90 days after the one before are of one component."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = c["orders"].select("o_orderkey", "o_orderdate", F.lag("o_orderkey").over(w).alias("before"), F.lag("o_orderdate").over(w).alias("at"))
    near = rows.where(timeline.seconds_between(F.col("o_orderdate"), F.col("at")) <= 90 * 86400)
    return groups.components(near.select(F.col("o_orderkey").cast("string").alias("a"), F.col("before").cast("string").alias("b")))


@query(f"""
    WITH {GAPS.format(gap=6 * 3600)}
    SELECT user_id, segment AS burst, count(*) AS size, (array_agg('e' || event_id
    ORDER BY value DESC NULLS LAST, 'e' || event_id))[1] AS best_id, min(ts) AS started FROM s GROUP BY ALL HAVING count(*) > 1
""")
def bursts_of_text_ids(c: Catalog) -> DataFrame:
    ids = F.lpad(F.col("event_id").cast("string"), 12, "0").alias("order_id"), F.concat(F.lit("e"), F.col("event_id")).alias("event_id")
    rows = c["events"].select("user_id", "ts", "value", *ids)
    found = timeline.gap_segments(rows, ["user_id"], "ts", "order_id", 6 * 3600, "burst").groupBy("user_id", "burst")
    found = found.agg(F.count("*").alias("size"), aggregate.best_id("event_id", "value").alias("best_id"), F.min("ts").alias("started"))
    return found.where("size > 1")


@query("""
    WITH v AS (SELECT e.*, m.embedding::DOUBLE[] AS v FROM events e JOIN embeddings m ON m.vec_id = e.event_id % 100),
    g AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) <= 86400 AND list_dot_product(v, lag(v) OVER w) >= 0.05 THEN 0 ELSE 1 END AS starts
    FROM v WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS burst FROM g)
    SELECT user_id, burst, count(*) AS size, (array_agg(event_id ORDER BY value DESC NULLS LAST, event_id))[1] AS best_id, min(ts) AS started FROM s
    GROUP BY user_id, burst HAVING count(*) > 1
""")
def bursts_alike(c: Catalog) -> DataFrame:
    rows = c["events"].withColumn("vec_id", F.col("event_id") % 100).join(c["embeddings"].select("vec_id", "embedding"), "vec_id")
    return timeline.bursts(rows, "user_id", "ts", "event_id", "value", 86400, alike=("embedding", 0.05))


@query("""SELECT md5(text) AS key, count(*) AS size, (array_agg('d' || doc_id ORDER BY n_chars DESC, 'd' || doc_id))[1] AS best_id FROM documents
    WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def copies_of_text_ids(c: Catalog) -> DataFrame:
    rows = c["documents"].where("text is not null").withColumn("id", F.concat(F.lit("d"), F.col("doc_id")))
    return groups.equal_groups(rows, F.md5("text"), "id", F.col("n_chars"))


@query("""
    WITH RECURSIVE v AS (SELECT 'v' || vec_id AS id, vec_id, embedding::DOUBLE[] AS v, label, vec_id * 1000003 AS h FROM embeddings),
    near AS (SELECT q.id AS a, e.id AS b, list_dot_product(q.v, e.v) AS s, bit_count(xor(q.h, e.h)) AS bits FROM v q JOIN v e ON q.id <> e.id
        QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY list_dot_product(q.v, e.v) DESC, e.id) <= 10),
    e AS (SELECT a, b FROM near WHERE s >= 0.3 AND bits <= 10 UNION SELECT b, a FROM near WHERE s >= 0.3 AND bits <= 10),
    reach AS (SELECT DISTINCT a, a AS b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a), g AS (SELECT a AS id, min(b) AS "group"
    FROM reach GROUP BY a)
    SELECT id, "group", count(*) OVER (PARTITION BY "group") AS size, row_number() OVER (PARTITION BY "group"
    ORDER BY label DESC NULLS LAST, id) = 1 AS is_best FROM g JOIN v USING (id)
""")
def near_duplicates_hashed(c: Catalog) -> DataFrame:
    """Near by vector and by hash, over all rows, with ids that are text."""
    rows = c["embeddings"].select(F.concat(F.lit("v"), F.col("vec_id")).alias("id"), "embedding", "label", (F.col("vec_id") * 1000003).alias("h"))
    return groups.near_duplicates(groups.nearest_to_queries(rows, rows, "id", "embedding", 10), rows, "id", "h", F.col("label"), 0.3, 10)


# ---- training pairs

WORDS = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+'))"
SENTENCES = r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"
SAID = rf"list_transform(list_filter({SENTENCES.format('text')}, lambda s: len(string_split_regex(trim(s), '\s+')) >= 3), lambda s: regexp_replace(s, '^(the|this) (image|photo|picture) (shows|is|depicts|features) ', '', 'i'))[1:2]"


def _photos(c: Catalog) -> DataFrame:
    """Documents as photos, seven minutes apart, of the camera `source`."""
    taken = F.timestamp_seconds(F.lit(1577836800) + F.col("doc_id") * 420).cast("timestamp_ntz")
    return c["documents"].select(
        F.concat(F.lit("p"), F.col("doc_id")).alias("id"), F.col("source").alias("camera"), taken.alias("taken_at"), F.array("lang", "source", F.lit("Photo")).alias("keywords"),
        F.lit("image").alias("media_type"), F.lit("t").alias("thumb_path"), F.lit(None).cast("string").alias("error"), F.md5("text").alias("copy"),
    )


PHOTOS = "photos AS (SELECT 'p' || doc_id AS id, source AS camera, TIMESTAMP '2020-01-01' + to_seconds(doc_id * 420) AS taken_at, lang, source, md5(text) AS copy FROM documents)"
EXCLUDED = """
    judged AS (SELECT DISTINCT 'p' || doc_id AS id FROM labels WHERE toxic = 1 AND 'p' || doc_id IN (SELECT id FROM photos)),
    near AS (SELECT id FROM photos WHERE copy IN (SELECT copy FROM photos SEMI JOIN judged USING (id))),
    scene AS (SELECT DISTINCT p.id FROM photos p JOIN photos j ON p.camera IS NOT DISTINCT
    FROM j.camera AND p.id <> j.id AND p.taken_at BETWEEN j.taken_at - INTERVAL 10 MINUTE AND j.taken_at + INTERVAL 10 MINUTE SEMI
    JOIN judged ON judged.id = j.id),
    out AS (SELECT id, min(n) AS n FROM (SELECT id, 1 AS n FROM judged UNION ALL SELECT id, 2 FROM near UNION ALL SELECT id, 3 FROM scene)
    GROUP BY id)
"""


def _excluded(c: Catalog) -> tuple[DataFrame, DataFrame, DataFrame]:
    photos = _photos(c)
    judged = c["labels"].where("toxic = 1").select(F.concat(F.lit("p"), F.col("doc_id")).alias("id")).join(photos, "id", "left_semi")
    copies = photos.where("copy is not null").select(F.lit("duplicate").alias("kind"), F.col("copy").alias("group_id"), F.col("id").alias("photo_id"))
    return photos, judged, copies


@query(f"WITH {PHOTOS}, {EXCLUDED} SELECT id, ['judged', 'group', 'scene'][n] AS why FROM out")
def pairs_excluded(c: Catalog) -> DataFrame:
    return pairs.excluded(*_excluded(c))


@query(rf"""
    WITH {PHOTOS}, {EXCLUDED}, used AS (SELECT * FROM photos WHERE id NOT IN (SELECT id FROM out)),
    told AS (SELECT 'p' || conv_id AS id, unnest({SAID}) AS text, 'caption' AS source FROM conversations),
    named AS (SELECT id, 'a photo of ' || array_to_string(k[1:4], ', ') AS text, 'keywords' AS source
    FROM (SELECT id, list_filter([lang, source], lambda k: len(k) > 1) AS k FROM used) WHERE len(k) > 0),
    judged_query AS (SELECT regexp_replace(text, '\s+\S+\s*$', '') AS q FROM benchmark),
    liked AS (SELECT 'p' || item_id AS id, text FROM benchmark UNION ALL SELECT 'p' || conv_id, text FROM conversations WHERE role = 'user'),
    w AS (SELECT text, {WORDS.format('text')} AS w FROM (SELECT DISTINCT text FROM liked)), v AS (SELECT {WORDS.format('q')} AS v FROM judged_query),
    seen AS (SELECT DISTINCT text FROM w, v WHERE len(list_intersect(w, v)) >= 0.6 * (len(w) + len(v) - len(list_intersect(w, v)))),
    every AS (SELECT * FROM told UNION ALL SELECT * FROM named UNION ALL SELECT id, text, 'feedback' FROM liked WHERE text NOT IN (SELECT text
    FROM seen))
    SELECT id, text, every.source, CASE WHEN {BUCKET.format('taken_at::DATE::VARCHAR')} < 50 THEN 'val' ELSE 'train' END AS split FROM every
    JOIN used USING (id)
""")
def training_pairs(c: Catalog) -> DataFrame:
    photos, judged, copies = _excluded(c)
    captions = c["conversations"].select(F.concat(F.lit("p"), F.col("conv_id")).alias("photo_id"), F.col("text").alias("caption"))
    liked = c["benchmark"].select(F.concat(F.lit("p"), F.col("item_id")).alias("photo_id"), F.col("text").alias("query"))
    liked = liked.unionByName(c["conversations"].where("role = 'user'").select(F.concat(F.lit("p"), F.col("conv_id")).alias("photo_id"), F.col("text").alias("query")))
    asked = c["benchmark"].select(F.regexp_replace("text", r"\s+\S+\s*$", "").alias("query"))
    return pairs.training_pairs(photos, captions, liked.withColumn("label", F.lit(1)), copies, judged, asked)


@query(rf"""
    WITH d AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest({SENTENCES.format('text')}) AS s
    FROM documents)), b AS (SELECT DISTINCT unnest({SENTENCES.format('text')}) AS s FROM benchmark),
    dw AS (SELECT doc_id, {WORDS.format('s')} AS w FROM d), bw AS (SELECT DISTINCT {WORDS.format('s')} AS v FROM b),
    x AS (SELECT doc_id, w FROM dw WHERE len(w) >= 4), y AS (SELECT v FROM bw WHERE len(v) >= 4),
    met AS (SELECT DISTINCT doc_id, w, v FROM (SELECT doc_id, w, unnest(w) AS word FROM x) JOIN (SELECT v, unnest(v) AS word FROM y) USING (word))
    SELECT DISTINCT doc_id FROM met WHERE len(list_intersect(w, v)) >= 0.6 * (len(w) + len(v) - len(list_intersect(w, v)))
""")
def leak_jaccard(c: Catalog) -> DataFrame:
    """Documents with a sentence of four or more words much like one of a judged text."""
    def said(df: DataFrame) -> DataFrame:
        rows = df.withColumn("s", F.explode(pairs.sentences("text"))).drop("text")
        return rows.where(F.size(F.array_distinct(F.regexp_extract_all(F.lower("s"), F.lit(r"[\p{L}\p{N}]+"), 0))) >= 4)

    return pairs.alike_texts(said(c["documents"].select("doc_id", "text")), "doc_id", "s", said(c["benchmark"].select("text")), "s", 0.6)


# ---- tuning and resampling


@query(f"""
    WITH {RANKED}, w AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0])::DOUBLE AS w_short),
    l AS (SELECT lang AS query, doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents
    WHERE lang IS NOT NULL QUALIFY rank <= 50),
    t AS (SELECT lang AS query, doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS rank FROM documents
    WHERE lang IS NOT NULL QUALIFY rank <= 50),
    f AS (SELECT query, w_short, id, coalesce(1.0::DOUBLE / (60 + l.rank), 0) + coalesce(w_short / (60 + t.rank), 0) AS score FROM l FULL
    JOIN t USING (query, id), w),
    p AS (SELECT query, w_short, id, row_number() OVER (PARTITION BY query, w_short ORDER BY round(score, 12) DESC, id::VARCHAR) AS rank FROM f
    WHERE score > 0 QUALIFY rank <= 100),
    g AS (SELECT query, w_short, sum(CASE WHEN rank <= 10 THEN (power(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg FROM p
    JOIN j USING (query, id) GROUP BY ALL),
    n AS (SELECT i.query, w.w_short, coalesce(dcg / ideal, 0) AS ndcg, {BUCKET.format('i.query')} % 5 AS fold FROM i CROSS JOIN w LEFT
    JOIN g ON g.query = i.query AND g.w_short = w.w_short),
    overall AS (SELECT w_short, avg(ndcg) AS mean FROM n GROUP BY 1), o AS (SELECT fold, w_short, sum(ndcg) AS s, count(ndcg) AS c FROM n
    GROUP BY ALL), a AS (SELECT w_short, sum(ndcg) AS s, count(ndcg) AS c FROM n GROUP BY 1),
    chosen AS (SELECT fold, w_short, o.s, o.c, CASE WHEN a.c > o.c THEN (a.s - o.s) / (a.c - o.c) END AS mean FROM o JOIN a USING (w_short)
    QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(mean, 6) DESC NULLS LAST, w_short) = 1)
    SELECT 1.0::DOUBLE AS w_long, w_short, round(mean, 9) AS in_sample, (SELECT round(sum(s) / sum(c), 9) FROM chosen) AS cross_validated,
    (SELECT round(mean, 9) FROM overall WHERE w_short = 1) AS equal_weights, (SELECT round(mean, 9) FROM overall WHERE w_short = 0) AS pinned_alone
    FROM overall ORDER BY round(mean, 6) DESC, w_short LIMIT 1
""")
def tune_fusion(c: Catalog) -> DataFrame:
    docs = c["documents"].select(F.col("lang").alias("query"), F.col("doc_id").alias("id"), "n_chars").where("lang is not null")

    def first(order) -> DataFrame:
        return docs.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(order, "id"))).where("rank <= 50").select("query", "id", "rank")

    judged = docs.join(c["labels"].withColumnRenamed("doc_id", "id"), "id").select("query", "id", (F.col("quality") + 2 * F.col("toxic")).alias("grade")).where("grade > 0")
    row = tuning.tune({"long": first(F.desc("n_chars")), "short": first(F.col("n_chars"))}, judged, "long")
    return row.select("w_long", "w_short", *[F.round(x, 9).alias(x) for x in ("in_sample", "cross_validated", "equal_weights", "pinned_alone")])


ROUNDS = 100
RESAMPLED = f"""
    x AS (SELECT doc_id, quality::DOUBLE AS a, (1 - toxic)::DOUBLE AS b FROM labels WHERE doc_id IS NOT NULL),
    d AS (SELECT x.*, r, {BUCKET.format("doc_id || '|' || r")} AS u
    FROM x, range(1, {ROUNDS + 1}) t(r)),
    t AS (SELECT *, (u >= 368)::INT + (u >= 736)::INT + (u >= 920)::INT + (u >= 981)::INT + (u >= 996)::INT + (u >= 999)::INT AS n FROM d)
"""


@query(f"""WITH {RESAMPLED}, m AS (SELECT r, sum(a * n) / sum(CASE WHEN a IS NOT NULL THEN n END) AS m FROM t GROUP BY r)
    SELECT round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM m""")
def bootstrap_interval(c: Catalog) -> DataFrame:
    scores = c["labels"].where("doc_id is not null").select("doc_id", F.col("quality").cast("double").alias("a"))
    return tuning.bootstrap_mean(scores, "doc_id", "a", ROUNDS).select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query(f"""WITH {RESAMPLED}, m AS (SELECT r, sum((b - a) * n) / sum(CASE WHEN b - a IS NOT NULL THEN n END) AS m FROM t GROUP BY r)
    SELECT avg((m <= 0)::INT) AS p FROM m""")
def paired_bootstrap(c: Catalog) -> DataFrame:
    scores = c["labels"].where("doc_id is not null").select("doc_id", F.col("quality").cast("double").alias("a"), (1 - F.col("toxic")).cast("double").alias("b"))
    return tuning.paired_p(scores, "doc_id", "a", "b", ROUNDS)


# ---- files and upkeep

EXTENSIONS = ("JPG", "heif", "tif", "nrw", "m2ts", "txt", "Png", "3gp")


@query(f"""
    WITH e AS (SELECT p_partkey, lower({list(EXTENSIONS)}[p_partkey % {len(EXTENSIONS)} + 1]) AS e FROM part)
    SELECT p_partkey, CASE WHEN e IN ('jpg', 'heif', 'tif', 'png') THEN 'image' WHEN e = 'nrw' THEN 'raw' WHEN e IN ('m2ts', '3gp') THEN 'video' END AS kind,
    CASE e WHEN 'jpg' THEN 'jpeg' WHEN 'heif' THEN 'heic' WHEN 'tif' THEN 'tiff' ELSE e END AS format FROM e
""")
def media_formats(c: Catalog) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("p_partkey") % len(EXTENSIONS) + 1).cast("int"))
    path = F.concat(F.lit("/lib/"), F.col("p_name"), F.lit("."), ext)
    return c["part"].select("p_partkey", files.media_kind(path).alias("kind"), files.file_format(path).alias("format"))


@query("""
    SELECT p_partkey, CASE WHEN p_size >= 25 THEN (p_size - 24)::INT || 's' WHEN p_size = 1 THEN '1s' ELSE '1/' || p_size END AS shutter,
    CASE WHEN p_partkey % 2 = 0 THEN 'Acme ' || p_type ELSE p_brand || ' ' || p_name END AS camera FROM part
""")
def exif_values(c: Catalog) -> DataFrame:
    seconds = F.when(F.col("p_size") >= 25, F.col("p_size") - 24).otherwise(1.0 / F.col("p_size"))
    even = F.col("p_partkey") % 2 == 0
    name = files.camera_name(F.when(even, "ACME CORPORATION").otherwise(F.col("p_brand")), F.when(even, F.col("p_type")).otherwise(F.concat("p_brand", F.lit(" "), "p_name")))
    return c["part"].select("p_partkey", files.shutter(seconds).alias("shutter"), name.alias("camera"))


@query("""
    SELECT '/v/' || l_orderkey || '#t=' || printf('%.2f', l_linenumber * 1.5) AS path, md5(l_orderkey::VARCHAR) || ':' || printf('%.2f', l_linenumber * 1.5) AS file_hash,
    o_orderdate + to_milliseconds((l_linenumber * 1500)::BIGINT) AS taken_at, l_orderkey AS source_video_id, l_linenumber * 1.5::DOUBLE AS frame_ts, o_orderpriority AS camera, l_quantity AS sharpness
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey
""")
def video_child_rows(c: Catalog) -> DataFrame:
    key = F.col("o_orderkey")
    videos = c["orders"].select(
        key.alias("id"), F.concat(F.lit("/v/"), key).alias("path"), F.md5(key.cast("string")).alias("file_hash"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("taken_at"), F.col("o_orderpriority").alias("camera"),
    )
    frames = c["lineitem"].select(F.col("l_orderkey").alias("video_id"), (F.col("l_linenumber") * 1.5).cast("double").alias("frame_ts"), F.col("l_quantity").alias("sharpness"))
    return upkeep.video_frames(videos, frames, ["camera"]).select("path", "file_hash", "taken_at", "source_video_id", "frame_ts", "camera", "sharpness")


@query("""
    WITH p AS (SELECT page_id, url || '#t=' || page_id AS path, url FROM pages), m AS (SELECT DISTINCT url AS old, '/to/' || md5(url) AS new
    FROM pages WHERE md5(url) < '8')
    SELECT page_id, CASE WHEN new IS NULL THEN path ELSE new || '#t=' || page_id END AS path FROM p LEFT JOIN m ON url = old
""")
def moved_paths(c: Catalog) -> DataFrame:
    rows = c["pages"].select("page_id", F.concat("url", F.lit("#t="), "page_id").alias("path"))
    moves = c["pages"].where(F.md5("url") < "8").select(F.col("url").alias("old"), F.concat(F.lit("/to/"), F.md5("url")).alias("new"))
    return incremental.apply_moves(rows, moves)[0]


@query("SELECT doc_id, '/api/photos/' || doc_id || '/thumb?size=256' || CASE WHEN text IS NULL THEN '' ELSE '&v=' || md5(text)[1:12] END AS url FROM documents")
def media_urls(c: Catalog) -> DataFrame:
    return c["documents"].select("doc_id", files.media_url(F.col("doc_id").cast("string"), "thumb", F.md5("text")).alias("url"))


# ---- density clusters


@query("""
    WITH RECURSIVE n AS (SELECT q.vec_id AS a, e.vec_id AS b, round(sqrt(greatest(0, 2 - 2 * list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 9) AS d
        FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id
        QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) DESC, e.vec_id) <= 10),
    core AS (SELECT a, d AS core FROM n QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = 2),
    p AS (SELECT least(a, b) AS a, greatest(a, b) AS b, min(d) AS d FROM n GROUP BY 1, 2),
    u AS (SELECT p.a, p.b, greatest(d, x.core, y.core) AS w FROM p JOIN core x ON x.a = p.a JOIN core y ON y.a = p.b),
    e AS (SELECT a, b, w FROM u UNION ALL SELECT b, a, w FROM u),
    l AS MATERIALIZED (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY a ORDER BY w, b) <= 3),
    s1 AS (SELECT a AS id, [a, b] AS part, w AS birth FROM l QUALIFY row_number() OVER (PARTITION BY a ORDER BY w, b) = 1),
    s2 AS (SELECT id, list_append(part, b) AS part, greatest(birth, w) AS birth FROM s1 JOIN l ON list_contains(part, a) AND NOT list_contains(part, b)
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY w, b) = 1),
    s3 AS MATERIALIZED (SELECT id, greatest(birth, w) AS birth FROM s2 JOIN l ON list_contains(part, a) AND NOT list_contains(part, b)
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY w, b) = 1),
    f AS MATERIALIZED (SELECT e.a, e.b, x.birth AS ba, y.birth AS bb, greatest(w, x.birth, y.birth) AS w FROM e JOIN s3 x ON x.id = e.a JOIN s3 y ON y.id = e.b),
    reach AS (SELECT id AS a, id AS b FROM s3 UNION SELECT reach.a, f.b FROM reach JOIN f ON f.a = reach.b WHERE f.ba = f.bb AND f.w = f.ba),
    level AS MATERIALIZED (SELECT a AS id, min(b) AS plateau FROM reach GROUP BY a),
    down AS MATERIALIZED (SELECT x.plateau, first(y.plateau ORDER BY bb, y.plateau) AS parent FROM f JOIN level x ON x.id = f.a JOIN level y ON y.id = f.b
        WHERE bb < ba AND w = ba GROUP BY 1),
    up AS (SELECT DISTINCT plateau, plateau AS root FROM level UNION SELECT up.plateau, down.parent FROM up JOIN down ON down.plateau = up.root),
    held AS MATERIALIZED (SELECT id, birth, root FROM s3 JOIN level USING (id) JOIN up USING (plateau) WHERE root NOT IN (SELECT plateau FROM down)),
    ends AS (SELECT x.root, min(w) AS ends FROM f JOIN held x ON x.id = f.a JOIN held y ON y.id = f.b WHERE x.root <> y.root GROUP BY 1)
    SELECT vec_id, CASE WHEN birth < coalesce(ends, 'inf'::DOUBLE) AND (SELECT count(DISTINCT root) FROM held) > 1 THEN root END AS cluster
    FROM (SELECT DISTINCT a AS vec_id FROM n) v LEFT JOIN held ON id = vec_id LEFT JOIN ends USING (root)
""")
def density_leaves(c: Catalog) -> DataFrame:
    """Density clusters of all vectors' graph of ten nearest; what belongs to none has a null."""
    near = groups.nearest_to_queries(c["embeddings"], c["embeddings"], "vec_id", "embedding", 10)
    distance = F.round(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))), 9)
    found = density.density_clusters(near.select("query_id", "id", distance.alias("distance")))
    return found.select(F.col("id").alias("vec_id"), "cluster")


# ---- a stored index of words

ASKED = {"insults": "idiots and morons", "licence": "Licensing, licensed or a license", "generations": "generations of relational happiness", "none": "the of and"}


def _stem_sql(words: str) -> str:
    """CTEs that end in `stem` (word, token): the stems of a table of distinct `word`s, rule by rule."""
    first, short, double = r"[^aeiouy]*[aeiouy]+[^aeiouy]", "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", "(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"

    def table(endings: dict[str, str]) -> str:
        return "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in endings.items()) + "}"

    def swapped(before: str, after: str, endings: dict[str, str], allowed: str) -> str:
        return f"""{after} AS (SELECT word, r1, r2, still, CASE WHEN NOT still AND e <> '' AND {allowed} THEN base || {table(endings)}[e] ELSE w END AS w
            FROM (SELECT *, w[:len(w) - len(e)] AS base FROM (SELECT *, regexp_extract(w, '{english.ending(endings)}', 1) AS e FROM {before})))"""

    return f"""
    y AS (SELECT word, regexp_replace(word, '(^|[aeiouy])y', '\\1Y', 'g') AS w FROM ({words}) WHERE regexp_full_match(word, '[a-z]{{3,}}') AND word NOT IN {english.KEPT}),
    f AS (SELECT *, CASE WHEN regexp_matches(w, '^(gener|commun|arsen)') THEN len(regexp_extract(w, '^(gener|commun|arsen)')) ELSE len(regexp_extract(w, '^{first}')) END AS n FROM y),
    g AS (SELECT word, w, CASE WHEN n > 0 THEN n ELSE len(w) END AS r1 FROM f),
    h AS (SELECT *, len(regexp_extract(w[r1 + 1:], '^{first}')) AS m FROM g),
    a AS (SELECT word, r1, CASE WHEN m > 0 THEN r1 + m ELSE len(w) END AS r2, CASE WHEN w LIKE '%sses' THEN w[:len(w) - 2]
        WHEN regexp_matches(w, '(ied|ies)$') THEN w[:len(w) - CASE WHEN len(w) > 4 THEN 2 ELSE 1 END] WHEN regexp_matches(w, '(us|ss)$') THEN w
        WHEN regexp_matches(w, '[aeiouy].+s$') THEN w[:len(w) - 1] ELSE w END AS w FROM h),
    b AS (SELECT *, w IN {english.KEPT_SINGULAR} AS still, regexp_extract(w, '{english.ending(english.PAST)}', 1) AS e FROM a),
    b1 AS (SELECT *, w[:len(w) - len(e)] AS base FROM b),
    b2 AS (SELECT word, r1, r2, still, CASE WHEN still OR e = '' THEN w WHEN e LIKE 'ee%' THEN CASE WHEN len(base) >= r1 THEN base || 'ee' ELSE w END
        WHEN NOT regexp_matches(base, '[aeiouy]') THEN w WHEN regexp_matches(base, '(at|bl|iz)$') THEN base || 'e' WHEN regexp_matches(base, '{double}') THEN base[:len(base) - 1]
        WHEN len(base) <= r1 AND regexp_matches(base, '{short}') THEN base || 'e' ELSE base END AS w FROM b1),
    c AS (SELECT word, r1, r2, still, CASE WHEN NOT still AND regexp_matches(w, '^.+[^aeiouy][yY]$') THEN w[:len(w) - 1] || 'i' ELSE w END AS w FROM b2),
    {swapped("c", "d", english.DERIVED, "len(base) >= r1 AND (e <> 'ogi' OR base LIKE '%l') AND (e <> 'li' OR regexp_matches(base, '[cdeghkmnrt]$'))")},
    {swapped("d", "k", english.FURTHER, "len(base) >= r1 AND (e <> 'ative' OR len(base) >= r2)")},
    {swapped("k", "l", dict.fromkeys(english.DROPPED, ""), "len(base) >= r2 AND (e <> 'ion' OR regexp_matches(base, '[st]$'))")},
    z AS (SELECT word, CASE WHEN NOT still AND (w LIKE '%e' AND (len(w) > r2 OR (len(w) > r1 AND NOT regexp_matches(w[:len(w) - 1], '{short}'))) OR w LIKE '%ll' AND len(w) > r2) THEN w[:len(w) - 1] ELSE w END AS w FROM l),
    stem AS MATERIALIZED (SELECT word, coalesce({table(english.OWN)}[word], replace(w, 'Y', 'y'), word) AS token FROM ({words}) LEFT JOIN z USING (word))"""


SPOKEN = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


@query(f"""
    WITH said AS MATERIALIZED (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({SPOKEN.format("text")}) AS word FROM documents) GROUP BY ALL),
    asked AS (SELECT query, unnest({SPOKEN.format("words")}) AS word FROM (VALUES {", ".join(str(x) for x in ASKED.items())}) v(query, words)),
    {_stem_sql("SELECT word FROM said UNION SELECT word FROM asked")},
    q AS (SELECT DISTINCT query, token FROM asked JOIN stem USING (word) WHERE word NOT IN {text.STOP_WORDS}),
    s AS (SELECT query, doc_id AS id, sum(n)::DOUBLE AS score FROM said JOIN stem USING (word) JOIN q USING (token) WHERE word NOT IN {text.STOP_WORDS} GROUP BY ALL)
    SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INT AS rank, id, score FROM s
    QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 50
""")
def word_index_topk(c: Catalog) -> DataFrame:
    """Some requests against a stored index of the stems of all documents."""
    ensure_checkpoint_dir(c.spark)
    path = f"{c.spark.sparkContext.getCheckpointDir().rstrip('/')}/word-index-{uuid.uuid4().hex}"
    index = WordIndex.build(c["documents"].select("doc_id", "text"), path, "doc_id", {"text": "text"})
    return index.search_many(c.spark.createDataFrame([*ASKED.items()], "query string, words string"), 50)


@query(f"""
    WITH said AS MATERIALIZED (SELECT unnest({SPOKEN.format("text")}) AS word FROM documents), {_stem_sql("SELECT DISTINCT word FROM said WHERE word IS NOT NULL")}
    SELECT token, count(*) AS forms, sum(n)::BIGINT AS n FROM stem JOIN (SELECT word, count(*) AS n FROM said GROUP BY 1) USING (word) GROUP BY 1
""")
def stem_families(c: Catalog) -> DataFrame:
    """How many words, and how many of their occurrences, fall under each stem."""
    counted = c["documents"].select(F.explode(text.words("text")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.groupBy(english.english_stem(F.col("word")).alias("token")).agg(F.count("*").alias("forms"), F.sum("n").alias("n"))
