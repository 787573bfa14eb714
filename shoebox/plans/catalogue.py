"""The operators as queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from shoebox.functions import text, vector
from shoebox.operators import aggregate, groups, pairs, ranking, timeline, tuning, upkeep
from shoebox.operators.geo import reverse_geocode
from shoebox.plans import filters as flt
from shoebox.schema import Catalog
from shoebox.sources import files
from shoebox.streaming.incremental import session_windows, tumbling_counts

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    """Register a function of a Catalog under its own name."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Catalog(spark, sf_dir))

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def places(c: Catalog) -> DataFrame:
    """Orders with the place names of their customers, as photos of a collection."""
    hierarchy = c["nation"].join(c["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    customers = c["customer"].join(hierarchy, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c["orders"].join(customers, F.col("o_custkey") == F.col("c_custkey"))
    names = {"o_orderkey": "id", "o_orderdate": "taken_at", "n_name": "place_name", "c_mktsegment": "admin1", "r_name": "country", "o_totalprice": "iso", "n_nationkey": "nation"}
    return rows.select(*[F.col(c).alias(n) for c, n in names.items()])


PLACES = """(SELECT o_orderkey AS id, o_orderdate AS taken_at, n_name AS place_name, c_mktsegment AS admin1, r_name AS country, o_totalprice AS iso, n_nationkey AS nation
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


# ---- aggregates and listings


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS value, count(*) AS n, arg_max(o_orderkey, {'p': o_totalprice, 'k': -o_orderkey}) AS best_id FROM orders
    GROUP BY 1 ORDER BY n DESC, value LIMIT 50""")
def agg_by_month(c: Catalog) -> DataFrame:
    return aggregate.group_counts(c["orders"].withColumnRenamed("o_orderdate", "taken_at"), aggregate.dimension("month"), 50, ("o_orderkey", "o_totalprice"))


@query("SELECT dayname(ts) AS weekday, hour(ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def agg_by_weekday_hour(c: Catalog) -> DataFrame:
    return c["events"].groupBy(aggregate.dimension("weekday", "ts").alias("weekday"), F.hour("ts").alias("hour"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT p_brand AS value, count(*) AS n, (array_agg(p_partkey ORDER BY p_retailprice DESC NULLS LAST, p_partkey))[1] AS best_id FROM part GROUP BY p_brand")
def agg_representative(c: Catalog) -> DataFrame:
    return aggregate.group_counts(c["part"], F.col("p_brand"), 50, ("p_partkey", "p_retailprice"))


@query("""SELECT o_orderstatus, count(*) AS total, count(*) FILTER (WHERE o_totalprice > 100000) AS dear, count(DISTINCT o_custkey) AS customers, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE 1 END)::BIGINT AS known
    FROM orders GROUP BY 1""")
def agg_total_with_null(c: Catalog) -> DataFrame:
    known = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority"))
    dear = F.count_if(F.col("o_totalprice") > 100000).alias("dear")
    return c["orders"].groupBy("o_orderstatus").agg(F.count("*").alias("total"), dear, F.count_distinct("o_custkey").alias("customers"), F.count(known).alias("known"))


@query("""SELECT names, count(*) AS n FROM (SELECT l_orderkey, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS names FROM lineitem
    JOIN part ON l_partkey = p_partkey GROUP BY 1) GROUP BY names""")
def agg_name_set(c: Catalog) -> DataFrame:
    rows = c["lineitem"].select("l_orderkey", "l_partkey").join(c["part"].select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return aggregate.name_sets(rows, "l_orderkey", "p_type")


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, count(DISTINCT user_id) AS users, min(ts) AS first_at, max(ts) AS last_at
    FROM events""")
def overview_conditional_counts(c: Catalog) -> DataFrame:
    errors, users = F.count_if(F.col("event_type") == "error").alias("errors"), F.count_distinct("user_id").alias("users")
    return c["events"].agg(F.count("*").alias("n"), errors, users, F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


STATS = ("customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations")


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {t}" for t in STATS))
def stats_scalar(c: Catalog) -> DataFrame:
    return aggregate.row_counts({t: c[t] for t in STATS})


@query("""SELECT value, sum(n)::BIGINT AS n FROM (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT p_type, count(*) FROM part
    GROUP BY 1 UNION ALL SELECT c_mktsegment, count(*) FROM customer GROUP BY 1) GROUP BY value ORDER BY n DESC, value LIMIT 2000""")
def vocab_top(c: Catalog) -> DataFrame:
    return aggregate.vocabulary([(c["part"], "p_brand"), (c["part"], "p_type"), (c["customer"], "c_mktsegment")], 2000)


@query("""WITH g AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1 ORDER BY size DESC, o_custkey LIMIT 20 OFFSET 5)
    SELECT o_custkey, size, o_orderkey FROM g JOIN orders USING (o_custkey)""")
def top_groups_members(c: Catalog) -> DataFrame:
    return aggregate.top_groups(c["orders"], "o_custkey", "o_orderkey", 20, 5)


@query("SELECT c_custkey, c_mktsegment, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def left_join_counts(c: Catalog) -> DataFrame:
    customers = c["customer"].select(F.col("c_custkey"), "c_mktsegment")
    return aggregate.count_members(customers, c["orders"].select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), "c_custkey", "o_orderkey")


@query("""SELECT l_partkey, array_to_string((array_agg(l_orderkey * 10 + l_linenumber
    ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber))[1:6], ',') AS members, count(*) AS total FROM lineitem GROUP BY 1""")
def top_k_array(c: Catalog) -> DataFrame:
    rows = c["lineitem"].select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), "l_extendedprice")
    return aggregate.top_members(rows, "l_partkey", "line", "l_extendedprice", 6).withColumn("members", F.array_join("members", ","))


@query("""SELECT event_type, (array_agg(event_id ORDER BY ts, event_id))[1] AS first_id, (array_agg(event_id
    ORDER BY ts DESC, event_id DESC))[1] AS last_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n FROM events GROUP BY 1""")
def first_last(c: Catalog) -> DataFrame:
    return aggregate.first_last(c["events"], "event_type", "ts", "event_id")


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC NULLS LAST, event_id LIMIT 60 OFFSET 120")
def browse_page(c: Catalog) -> DataFrame:
    return aggregate.page(c["events"].select("event_id", "ts", "event_type"), [F.desc_nulls_last("ts"), F.col("event_id")], 120, 60)


@query("""SELECT o_orderkey, o_orderdate FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100)
    ORDER BY o_orderdate DESC NULLS LAST, o_orderkey""")
def newest_of_best(c: Catalog) -> DataFrame:
    rows = aggregate.newest_of_best(c["orders"], [F.desc("o_totalprice"), F.col("o_orderkey")], [F.desc_nulls_last("o_orderdate"), F.col("o_orderkey")], 100)
    return rows.select("o_orderkey", "o_orderdate")


@query(f"SELECT country, admin1, count(*) AS n, sum(iso)::DECIMAL(38,2)::DOUBLE AS total FROM {PLACES} GROUP BY CUBE (country, admin1)")
def cube_places(c: Catalog) -> DataFrame:
    return places(c).cube("country", "admin1").agg(F.count("*").alias("n"), F.round(F.sum("iso"), 2).alias("total"))


# ---- filters


@query(f"SELECT id, place_name, country FROM {PLACES} WHERE lower(place_name) = 'asia' OR lower(admin1) = 'asia' OR lower(country) = 'asia'")
def filter_place(c: Catalog) -> DataFrame:
    return places(c).where(flt.place_is("asia", "place_name", "admin1", "country")).select("id", "place_name", "country")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= DATE '1996-03-01' AND o_orderdate < DATE '1996-04-16'")
def filter_date_inclusive(c: Catalog) -> DataFrame:
    return c["orders"].where(flt.date_range(F.col("o_orderdate"), date(1996, 3, 1), date(1996, 4, 15))).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey FROM orders WHERE month(o_orderdate) IN (6, 7, 8) AND year(o_orderdate) IN (1997, 1998)")
def filter_months(c: Catalog) -> DataFrame:
    f = flt.SearchFilters(months=(6, 7, 8, 13), years=(1997, 1998))
    return c["orders"].withColumnRenamed("o_orderdate", "taken_at").where(flt.both(flt.predicates(f))).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 12 AND l_discount >= 0 AND l_discount <= 0.02")
def filter_numeric(c: Catalog) -> DataFrame:
    return c["lineitem"].where(flt.between(F.col("l_quantity"), 10, 12) & flt.between(F.col("l_discount"), 0, 0.02)).select("l_orderkey", "l_linenumber")


LAT, LON = "(nation * 5.5 - 60)", "(nation * 11.0 - 130)"


@query(f"""SELECT id, round(sqrt(power(({LAT} - 20) * 111.32, 2) + power(({LON} - 30) * 111.32 * cos(radians(20)), 2)), 6) AS km FROM {PLACES}
    WHERE sqrt(power(({LAT} - 20) * 111.32, 2) + power(({LON} - 30) * 111.32 * cos(radians(20)), 2)) <= 1500""")
def filter_near(c: Catalog) -> DataFrame:
    lat, lon = F.col("nation") * 5.5 - 60, F.col("nation") * 11.0 - 130
    rows = places(c).where(flt.near(lat, lon, 20.0, 30.0, 1500.0))
    return rows.select("id", F.round(flt.distance_km(lat, lon, 20.0, 30.0), 6).alias("km"))


@query(r"""SELECT p_partkey FROM part WHERE regexp_matches('RF' || p_size || '-' || (p_size + 50) || 'mm', '(^|[^0-9.\-])25(\.0)?\s?mm', 'i') OR regexp_matches('RF' || p_size || 'mm', '(^|[^0-9.\-])25(\.0)?\s?mm', 'i')""")
def filter_lens_prime(c: Catalog) -> DataFrame:
    zoom, prime = F.concat(F.lit("RF"), F.col("p_size"), F.lit("-"), F.col("p_size") + 50, F.lit("mm")), F.concat(F.lit("RF"), F.col("p_size"), F.lit("mm"))
    return c["part"].where(flt.lens_is(zoom, "25mm") | flt.lens_is(prime, "25 mm")).select("p_partkey")


@query("SELECT p_partkey, p_name FROM part WHERE list_has_any(list_transform(string_split(p_name, ' '), lambda w: lower(w)), ['red', 'gizmo'])")
def filter_keywords_any(c: Catalog) -> DataFrame:
    return c["part"].where(flt.any_keyword(F.split("p_name", " "), ("Red", "GIZMO"))).select("p_partkey", "p_name")


@query("""SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE l_orderkey = o_orderkey AND upper(p_type) LIKE '%SMALL%') AND EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE l_orderkey = o_orderkey AND upper(p_type) LIKE '%LARGE%')""")
def filter_people_all(c: Catalog) -> DataFrame:
    rows = c["lineitem"].select("l_orderkey", "l_partkey").join(c["part"].select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    kinds = [F.upper("p_type").contains(k) for k in ("SMALL", "LARGE")]
    return flt.with_all(c["orders"].select("o_orderkey"), "o_orderkey", rows, "l_orderkey", kinds)


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def filter_bridge_semi(c: Catalog) -> DataFrame:
    return c["documents"].select("doc_id", "lang").join(c["labels"].where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)")
def exclude_anti(c: Catalog) -> DataFrame:
    return c["documents"].select("doc_id", "lang").join(c["labels"].where("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events) OR o_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def pending_anti(c: Catalog) -> DataFrame:
    derived = [c["events"].select(F.col("user_id").alias("o_custkey")), c["supplier"].select(F.col("s_suppkey").alias("o_custkey"))]
    return upkeep.pending(c["orders"], "o_custkey", derived)


@query("""SELECT o_orderkey FROM orders WHERE (o_orderstatus IS DISTINCT
    FROM 'F') AND abs(o_totalprice - o_custkey * 20) <= 0.05 * greatest(o_totalprice, o_custkey * 20)""")
def filter_null_safe(c: Catalog) -> DataFrame:
    square = flt.oriented(F.col("o_totalprice"), F.col("o_custkey") * 20, "square")
    return c["orders"].where(~F.col("o_orderstatus").eqNullSafe("F") & square).select("o_orderkey")


# ---- ranked retrieval


def _vectors(c: Catalog, *ids: int) -> list[list[float]]:
    """The vectors of a few rows, in one read; an id that isn't there is an error that names it."""
    found = {r.vec_id: list(r.embedding) for r in c["embeddings"].where(F.col("vec_id").isin(*ids)).select("vec_id", "embedding").collect()}
    return [found[i] for i in ids]


def _vector(c: Catalog, i: int) -> list[float]:
    return _vectors(c, i)[0]


@query("""SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 6) AS score FROM embeddings
    ORDER BY list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) DESC, vec_id LIMIT 50""")
def vector_topk(c: Catalog) -> DataFrame:
    return vector.top_k(c["embeddings"], "embedding", vector.literal(_vector(c, 7)), 50, "vec_id").withColumn("score", F.round("score", 6))


@query("""SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 6) AS score FROM embeddings
    WHERE label IN (1, 3) ORDER BY list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings
    WHERE vec_id = 7)) DESC, vec_id LIMIT 50""")
def vector_topk_filtered(c: Catalog) -> DataFrame:
    rows = c["embeddings"].where(F.col("label").isin(1, 3))
    return vector.top_k(rows, "embedding", vector.literal(_vector(c, 7)), 50, "vec_id").withColumn("score", F.round("score", 6))


@query("""WITH v AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id IN (1, 2, 3, 7)),
    q AS (SELECT i, sum(CASE WHEN vec_id = 7 THEN x ELSE 0 END) + 0.75 * avg(CASE WHEN vec_id IN (1, 2) THEN x END) - 0.25 * avg(CASE WHEN vec_id = 3 THEN x END) AS x
    FROM v GROUP BY i),
    u AS (SELECT list(x / n ORDER BY i) AS q FROM q, (SELECT sqrt(sum(x * x)) AS n FROM q))
    SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q), 6) AS score FROM embeddings, u WHERE vec_id <> 3
    ORDER BY list_dot_product(embedding::DOUBLE[], q) DESC, vec_id LIMIT 50""")
def rocchio_topk(c: Catalog) -> DataFrame:
    asked, one, two, three = _vectors(c, 7, 1, 2, 3)
    moved = vector.rocchio(asked, [one, two], [three])
    return vector.top_k(c["embeddings"].where("vec_id <> 3"), "embedding", vector.literal(moved), 50, "vec_id").withColumn("score", F.round("score", 6))


@query("""SELECT label, i, round(avg(x), 9) AS mean FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS i
    FROM embeddings) GROUP BY ALL""")
def label_centroids(c: Catalog) -> DataFrame:
    rows = c["embeddings"].select("label", F.posexplode("embedding").alias("i", "x"))
    return rows.groupBy("label", F.col("i").cast("bigint").alias("i")).agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("mean"))


HITS = r"len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: w IN ('idiot', 'moron', 'licensed')))"


@query(f"SELECT doc_id, {HITS} AS hits FROM documents WHERE {HITS} > 0")
def text_or_match(c: Catalog) -> DataFrame:
    hits = F.size(F.filter(text.words("text"), lambda w: w.isin("idiot", "moron", "licensed")))
    return c["documents"].select("doc_id", hits.cast("bigint").alias("hits")).where("hits > 0")


@query(f"""SELECT id, sum(score) AS score FROM (SELECT doc_id AS id, {HITS} * 1.0::DOUBLE AS score FROM documents WHERE {HITS} > 0
    UNION ALL SELECT conv_id, len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: w = 'the')) * 0.5::DOUBLE
    FROM conversations WHERE len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: w = 'the')) > 0) GROUP BY id
    ORDER BY score DESC, id LIMIT 200""")
def keyword_signal(c: Catalog) -> DataFrame:
    docs = c["documents"].select(F.col("doc_id").alias("id"), F.size(F.filter(text.words("text"), lambda w: w.isin("idiot", "moron", "licensed"))).alias("hits"))
    talks = c["conversations"].select(F.col("conv_id").alias("id"), F.size(F.filter(text.words("text"), lambda w: w == "the")).alias("hits"))
    return ranking.keyword_signal([(docs, 1.0), (talks, 0.5)], 200)


@query("SELECT event_id AS id, row_number() OVER (ORDER BY ts DESC NULLS LAST, event_id)::INT AS rank FROM events QUALIFY rank <= 200")
def recency_rank(c: Catalog) -> DataFrame:
    return ranking.ranked(c["events"], "event_id", [F.desc_nulls_last("ts"), F.col("event_id")], 200)


SIGNALS = """a AS (SELECT vec_id AS id, row_number() OVER (ORDER BY list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings
    WHERE vec_id = 7)) DESC, vec_id) AS rank FROM embeddings QUALIFY rank <= 200),
    b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 200),
    d AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 200)"""


def _signals(c: Catalog) -> dict[str, DataFrame]:
    query_vector = vector.literal(_vector(c, 7))
    scored = c["embeddings"].select("vec_id", vector.dot("embedding", query_vector).alias("score"))
    return {
        "clip": ranking.ranked(scored, "vec_id", [F.desc("score"), F.col("vec_id")], 200),
        "text": ranking.ranked(c["documents"].select("doc_id", "n_chars"), "doc_id", [F.desc("n_chars"), F.col("doc_id")], 200),
        "price": ranking.ranked(c["orders"].select("o_orderkey", "o_totalprice"), "o_orderkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 200),
    }


@query(f"""WITH {SIGNALS} SELECT id, round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(0.5 / (60 + b.rank), 0), 12) AS score, least(coalesce(a.rank, 2147483647), coalesce(b.rank, 2147483647))::INT AS best
    FROM a FULL JOIN b USING (id)""")
def rrf_fusion(c: Catalog) -> DataFrame:
    return ranking.rrf(_signals(c), {"clip": 1.0, "text": 0.5, "price": 0.0}).withColumn("score", F.round("score", 12))


@query(f"""WITH {SIGNALS} SELECT id, min(rank)::INT AS best, string_agg(system || ':' || rank, ',' ORDER BY system) AS found_by FROM
    (SELECT id, rank, 'clip' AS system FROM a UNION ALL SELECT id, rank, 'text' FROM b UNION ALL SELECT id, rank, 'price' FROM d) GROUP BY id""")
def pooled_candidates(c: Catalog) -> DataFrame:
    entries = F.transform(F.map_entries("found_by"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return ranking.pooled(_signals(c)).withColumn("found_by", F.array_join(entries, ","))


@query("""SELECT l_orderkey, l_linenumber, o_orderstatus, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) = 1""")
def hydrate_collapse(c: Catalog) -> DataFrame:
    best = ranking.collapse(c["lineitem"].select("l_orderkey", "l_linenumber", "l_extendedprice"), F.col("l_orderkey"), [F.desc("l_extendedprice"), F.col("l_linenumber")])
    return best.join(c["orders"].select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderstatus", "l_extendedprice")


@query("""WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < 12),
    s AS (SELECT e.vec_id, p.vec_id AS prompt, 100 * list_dot_product(e.embedding::DOUBLE[], v) AS s FROM embeddings e, p),
    m AS (SELECT vec_id, max(s) AS m FROM s GROUP BY 1)
    SELECT vec_id, round(sum(exp(s - m)) FILTER (WHERE prompt < 6) / sum(exp(s - m)), 6) AS likelihood FROM s JOIN m USING (vec_id) GROUP BY vec_id""")
def text_gate(c: Catalog) -> DataFrame:
    prompts = {r.vec_id: vector.literal(list(r.embedding)) for r in c["embeddings"].where("vec_id < 12").collect()}  # twelve prompts
    share = vector.softmax_share("embedding", [prompts[i] for i in range(6)], [prompts[i] for i in range(6, 12)])
    return c["embeddings"].select("vec_id", F.round(share, 6).alias("likelihood"))


# ---- time lines

GAPS = """g AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= {gap} THEN 0 ELSE 1 END AS starts
    FROM events),
    s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM g)"""


@query(f"""WITH {GAPS.format(gap=6 * 3600)} SELECT user_id, segment AS burst, count(*) AS size, (array_agg(event_id
    ORDER BY value DESC NULLS LAST, event_id))[1] AS best_id, min(ts) AS started FROM s GROUP BY ALL HAVING count(*) > 1""")
def bursts(c: Catalog) -> DataFrame:
    return timeline.bursts(c["events"], "user_id", "ts", "event_id", "value", 6 * 3600)


SEGMENTS = f"{GAPS.format(gap=8 * 3600)}, seg AS (SELECT user_id, segment, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY ALL)"


def _segments(c: Catalog) -> DataFrame:
    rows = timeline.gap_segments(c["events"].select("user_id", "event_id", "ts", "event_type"), ["user_id"], "ts", "event_id", 8 * 3600)
    return rows.groupBy("user_id", "segment").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"))


@query(f"WITH {SEGMENTS} SELECT * FROM seg")
def segments(c: Catalog) -> DataFrame:
    return _segments(c)


@query(f"""WITH {SEGMENTS}, f AS (SELECT *, n >= 2 AS away, lag(n >= 2) OVER w AS before_away, epoch(started) - epoch(lag(ended) OVER w) AS gap
    FROM seg WINDOW w AS (PARTITION BY user_id ORDER BY started, ended)),
    t AS (SELECT *, sum(CASE WHEN away AND before_away AND gap <= 172800 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id
    ORDER BY started, ended ROWS UNBOUNDED PRECEDING)::BIGINT AS trip FROM f)
    SELECT user_id, trip, min(started) AS started, max(ended) AS ended, sum(n)::BIGINT AS n FROM t GROUP BY ALL""")
def trips(c: Catalog) -> DataFrame:
    rows = timeline.trips(_segments(c), ["user_id"], "started", "ended", F.col("n") >= 2)
    return rows.groupBy("user_id", "trip").agg(F.min("started").alias("started"), F.max("ended").alias("ended"), F.sum("n").alias("n"))


@query("""WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day, event_type FROM events), n AS (SELECT user_id, event_type, count(*) AS n, min(day) AS seen FROM d
    GROUP BY ALL)
    SELECT user_id, event_type, n FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, seen, event_type DESC) = 1""")
def home_region(c: Catalog) -> DataFrame:
    days = c["events"].select("user_id", F.to_date("ts").cast("timestamp_ntz").alias("day"), "event_type").distinct()
    return timeline.mode(days, ["user_id"], "event_type", "day")


@query(f"""WITH {SEGMENTS} SELECT user_id, segment, 'User ' || user_id || ' · ' || CASE WHEN started::DATE = ended::DATE THEN strftime(started, '%b %-d, %Y')
    WHEN strftime(started, '%Y-%m') = strftime(ended, '%Y-%m') THEN strftime(started, '%b %-d') || '–' || strftime(ended, '%-d, %Y')
    ELSE strftime(started, '%b %Y') || ' – ' || strftime(ended, '%b %Y') END AS title FROM seg WHERE n >= 2""")
def album_titles(c: Catalog) -> DataFrame:
    title = timeline.title(F.concat(F.lit("User "), F.col("user_id")), F.col("started"), F.col("ended"))
    return _segments(c).where("n >= 2").select("user_id", "segment", title.alias("title"))


@query("""SELECT user_id, event_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id
    ORDER BY ts, event_id)) AS since, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events""")
def as_of_previous(c: Catalog) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return c["events"].select("user_id", "event_id", timeline.seconds_between(F.col("ts"), F.lag("ts").over(w)).alias("since"), F.lag("event_type").over(w).alias("before"))


# ---- groups and graphs


@query("""WITH h AS (SELECT min(o_orderkey) AS id, h FROM (SELECT o_orderkey, o_custkey * 4294967296 + o_custkey * 1000 + dayofyear(o_orderdate) AS h
    FROM orders) GROUP BY h),
    k AS (SELECT id, h, 0 AS band, h % 4294967296 AS part FROM h UNION ALL SELECT id, h, 1, h // 4294967296 FROM h)
    SELECT DISTINCT x.id AS a, y.id AS b, bit_count(xor(x.h, y.h))::INT AS bits FROM k x
    JOIN k y ON x.band = y.band AND x.part = y.part AND x.id < y.id WHERE bit_count(xor(x.h, y.h)) <= 1""")
def hamming_pairs(c: Catalog) -> DataFrame:
    """Orders of one customer whose days differ in one bit."""
    hashed = F.col("o_custkey") * 2**32 + F.col("o_custkey") * 1000 + F.dayofyear("o_orderdate")
    return groups.hamming_pairs(c["orders"].select("o_orderkey", hashed.alias("h")), "o_orderkey", "h", 1)


@query("""SELECT md5(text) AS key, count(*) AS size, arg_max(doc_id, {'n': n_chars, 'k': -doc_id}) AS best_id FROM documents WHERE text IS NOT NULL GROUP BY 1
    HAVING count(*) > 1""")
def exact_duplicates(c: Catalog) -> DataFrame:
    return groups.equal_groups(c["documents"].where("text is not null"), F.md5("text"), "doc_id", F.col("n_chars"))


@query("""SELECT query_id, rank, id, score FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) DESC, e.vec_id)::INT AS rank
    FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id) WHERE rank <= 10""")
def knn_graph(c: Catalog) -> DataFrame:
    """The graph of all rows: the ten nearest of each."""
    near = groups.nearest_to_queries(c["embeddings"], c["embeddings"], "vec_id", "embedding", 10)
    return near.withColumn("score", F.round("score", 6))


def _chained(c: Catalog) -> DataFrame:
    """Each order and the one before it of its customer, if it came at most 120 days earlier."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = c["orders"].select("o_orderkey", "o_orderdate", F.lag("o_orderkey").over(w).alias("before"), F.lag("o_orderdate").over(w).alias("at"))
    near = timeline.seconds_between(F.col("o_orderdate"), F.col("at")) <= 120 * 86400
    return rows.where(near).select(F.col("o_orderkey").alias("a"), F.col("before").alias("b"))


@query("""WITH RECURSIVE e AS (SELECT o_orderkey AS a, before AS b FROM (SELECT o_orderkey, o_orderdate, lag(o_orderkey) OVER w AS before, lag(o_orderdate) OVER w AS was
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
    WHERE before IS NOT NULL AND epoch(o_orderdate) - epoch(was) <= 120 * 86400),
    b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT a, b FROM b UNION SELECT reach.a, b.b FROM reach JOIN b ON reach.b = b.a)
    SELECT a AS node, least(a, min(b)) AS component FROM reach GROUP BY a""")
def union_find_components(c: Catalog) -> DataFrame:
    return groups.components(_chained(c))


@query("""WITH g AS (SELECT md5(text) AS k, min(doc_id) AS cluster FROM documents WHERE text IS NOT NULL GROUP BY 1
    HAVING count(*) > 1), r AS (SELECT cluster, lang AS truth FROM documents LEFT JOIN g ON md5(text) = k),
    t AS (SELECT cluster, truth, count(*) AS n FROM r GROUP BY ALL), x AS (SELECT * FROM t WHERE cluster IS NOT NULL),
    cl AS (SELECT sum(n) AS clustered, sum(most) AS pure, sum(n * (n - 1) / 2) AS sc FROM (SELECT sum(n) AS n, max(n) AS most FROM x
    GROUP BY cluster)),
    tr AS (SELECT sum(most) AS complete, sum(n * (n - 1) / 2) AS st FROM (SELECT sum(n) AS n, max(n) AS most FROM x
    GROUP BY truth)), b AS (SELECT sum(n * (n - 1) / 2) AS sb FROM x)
    SELECT clustered::BIGINT AS clustered, round(pure / clustered, 9) AS purity, round(complete / clustered, 9) AS completeness, round(clustered / (SELECT sum(n)
    FROM t), 9) AS coverage,
    round(sb / sc, 9) AS pair_precision, round(sb / st, 9) AS pair_recall, round(2 * (sb / sc) * (sb / st) / (sb / sc + sb / st), 9) AS pair_f1
    FROM cl, tr, b""")
def cluster_purity(c: Catalog) -> DataFrame:
    docs = c["documents"].select("doc_id", F.md5("text").alias("k"), F.col("lang").alias("truth"))
    clusters = docs.where("k is not null").groupBy("k").agg(F.min("doc_id").alias("cluster"), F.count("*").alias("size")).where("size > 1").select("k", "cluster")
    row = groups.purity(docs.join(clusters, "k", "left"), "cluster", "truth")
    return row.select("clustered", *[F.round(x, 9).alias(x) for x in row.columns[1:]])


@query("""WITH r AS (SELECT (length(regexp_replace(text, '[^A-Z]', '', 'g')) * 10 > length(text))::INT AS p, 1 - quality AS a FROM documents
    JOIN labels USING (doc_id)),
    n AS (SELECT count(*) FILTER (WHERE p = 1 AND a = 1) AS tp, count(*) FILTER (WHERE p = 1 AND a = 0) AS fp, count(*) FILTER (WHERE p = 0 AND a = 1) AS fn, count(*) FILTER (WHERE p = 0 AND a = 0) AS tn
    FROM r)
    SELECT tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1
    FROM n""")
def dup_confusion(c: Catalog) -> DataFrame:
    loud = (F.regexp_count("text", F.lit("[A-Z]")) * 10 > F.length("text")).cast("int")
    rows = c["documents"].select("doc_id", loud.alias("p")).join(c["labels"].select("doc_id", (1 - F.col("quality")).alias("a")), "doc_id")
    out = groups.confusion(rows, "p", "a")
    return out.select("tp", "fp", "fn", "tn", *[F.round(x, 9).alias(x) for x in ("precision", "recall", "f1")])


@query(r"""WITH r AS (SELECT p_size AS new, regexp_extract(p_brand, '(\d+)', 1)::INT AS old FROM part), n AS (SELECT new, old, count(*) AS n FROM r
    GROUP BY ALL), z AS (SELECT new, count(*) AS size FROM r GROUP BY 1),
    cl AS (SELECT new, old, size FROM n JOIN z USING (new) WHERE n >= 0.05 * size QUALIFY row_number() OVER (PARTITION BY new
    ORDER BY n DESC, old) = 1),
    w AS (SELECT new, old FROM cl QUALIFY row_number() OVER (PARTITION BY old ORDER BY size DESC, new) = 1) SELECT new, old AS label FROM z LEFT
    JOIN w USING (new)""")
def label_carry_over(c: Catalog) -> DataFrame:
    """New clusters by size of part, old ones by brand number."""
    rows = c["part"].select(F.col("p_size").alias("new"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("old"))
    return groups.carry_labels(rows, "new", "old", 0.05)


# ---- evaluation


RANKED = """r AS (SELECT lang AS query, doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents
    WHERE lang IS NOT NULL QUALIFY rank <= 100),
    j AS (SELECT lang AS query, doc_id AS id, quality + 2 * toxic AS grade FROM documents JOIN labels USING (doc_id)
    WHERE lang IS NOT NULL AND quality + 2 * toxic > 0),
    i AS (SELECT query, count(*) AS relevant, sum(CASE WHEN place <= 10 THEN (power(2, grade) - 1) / log2(place + 1) ELSE 0 END) AS ideal
    FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, id) AS place FROM j) GROUP BY 1),
    h AS (SELECT query, count(*) FILTER (WHERE rank <= 10) AS hits, min(rank) AS first, sum(CASE WHEN rank <= 10 THEN (power(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg
    FROM r JOIN j USING (query, id) GROUP BY 1),
    m AS (SELECT query, coalesce(hits, 0) / relevant AS recall, coalesce(hits, 0) / 10 AS precision, coalesce(1.0 / first, 0)::DOUBLE AS mrr, coalesce(dcg / ideal, 0) AS ndcg
    FROM i LEFT JOIN h USING (query))"""


def _scores(c: Catalog) -> DataFrame:
    docs = c["documents"].select("doc_id", "lang", "n_chars").where("lang is not null")
    w = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    ranking_rows = docs.withColumn("rank", F.row_number().over(w)).where("rank <= 100").select(F.col("lang").alias("query"), F.col("doc_id").alias("id"), "rank")
    judged = docs.join(c["labels"], "doc_id").select(F.col("lang").alias("query"), F.col("doc_id").alias("id"), (F.col("quality") + 2 * F.col("toxic")).alias("grade")).where("grade > 0")
    return ranking.recall_precision_mrr_ndcg(ranking_rows, judged, 10, 100)


@query(f"WITH {RANKED} SELECT query, round(recall, 9) AS recall, round(precision, 9) AS precision, round(mrr, 9) AS mrr, round(ndcg, 9) AS ndcg FROM m")
def recall_mrr_ndcg(c: Catalog) -> DataFrame:
    return _scores(c).select("query", *[F.round(x, 9).alias(x) for x in ("recall", "precision", "mrr", "ndcg")])


@query(f"""WITH {RANKED} SELECT CASE WHEN query = 'en' THEN 'english' ELSE 'other' END AS category, round(avg(ndcg), 9) AS mean_ndcg, count(*) AS n FROM m
    GROUP BY 1""")
def metric_by_category(c: Catalog) -> DataFrame:
    rows = _scores(c).withColumn("category", F.when(F.col("query") == "en", "english").otherwise("other"))
    return ranking.mean_by(rows, "category", "ndcg").withColumn("mean_ndcg", F.round("mean_ndcg", 9))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.95), 9) AS p95 FROM events GROUP BY 1")
def latency_percentiles(c: Catalog) -> DataFrame:
    rows = ranking.percentiles(c["events"], "event_type", "value", {"p50": 0.5, "p95": 0.95})
    return rows.select("event_type", F.round("p50", 9).alias("p50"), F.round("p95", 9).alias("p95"))


@query("""WITH r AS (SELECT n, agree, pa * pb + (1 - pa) * (1 - pb) AS chance
    FROM (SELECT count(*) AS n, avg((quality = 1 - toxic)::INT) AS agree, avg(quality) AS pa, avg(1 - toxic) AS pb FROM labels))
    SELECT n, round(agree, 9) AS agree, round((agree - chance) / (1 - chance), 9) AS kappa FROM r""")
def judge_kappa(c: Catalog) -> DataFrame:
    row = ranking.kappa(c["labels"].select("quality", (1 - F.col("toxic")).alias("judge")), "quality", "judge")
    return row.select("n", F.round("agree", 9).alias("agree"), F.round("kappa", 9).alias("kappa"))


BUCKET = "(" + " + ".join(f"(('0x' || sha1({{0}})[{8 * i + 1}:{8 * i + 8}])::BIGINT % 1000) * {pow(2**32, 4 - i, 1000)}" for i in range(5)) + ") % 1000"


@query(f"SELECT item_id, CASE WHEN {BUCKET.format('item_id::VARCHAR')} < 300 THEN 'test' ELSE 'dev' END AS split FROM benchmark")
def split_assign(c: Catalog) -> DataFrame:
    return c["benchmark"].select("item_id", pairs.split_by_hash(F.col("item_id").cast("string"), 0.3).alias("split"))


@query(f"SELECT CASE WHEN {BUCKET.format('ts::DATE::VARCHAR')} < 100 THEN 'val' ELSE 'train' END AS split, event_type, count(*) AS n FROM events GROUP BY ALL")
def train_val_split(c: Catalog) -> DataFrame:
    split = pairs.split_by_hash(F.to_date("ts").cast("string"), 0.1, ("val", "train"))
    return c["events"].select(split.alias("split"), "event_type").groupBy("split", "event_type").agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT a.event_id AS anchor_id, e.event_id AS id FROM events a JOIN events e ON a.user_id IS NOT DISTINCT
    FROM e.user_id AND e.ts BETWEEN a.ts - INTERVAL 10 MINUTE AND a.ts + INTERVAL 10 MINUTE AND a.event_id <> e.event_id WHERE a.event_type = 'error'""")
def scene_range_join(c: Catalog) -> DataFrame:
    return pairs.same_scene(c["events"], c["events"].where("event_type = 'error'"), "user_id", "ts", "event_id")


SAID = r"""SELECT DISTINCT {key}, trim(regexp_replace(lower(s), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS s
    FROM (SELECT {key}, unnest(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM {table})"""


@query(f"""WITH d AS ({SAID.format(key='doc_id', table='documents')}), b AS ({SAID.format(key='item_id', table='benchmark')})
    SELECT DISTINCT doc_id AS id, item_id AS judged_id FROM d JOIN b USING (s) WHERE len(string_split(s, ' ')) >= 4""")
def leak_sentences(c: Catalog) -> DataFrame:
    return pairs.leaked(c["documents"], "doc_id", "text", c["benchmark"], "item_id", "text")


@query("SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 90)")
def group_neighbours(c: Catalog) -> DataFrame:
    events = c["events"].select("event_id", "user_id", "event_type", "value")
    return pairs.group_neighbours(events.select("event_id", "user_id"), events.where("event_type = 'signup' and value > 90"), "user_id", "event_id")


@query("""WITH a AS (SELECT lang AS query, doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents
    WHERE lang IS NOT NULL QUALIFY rank <= 50),
    b AS (SELECT lang AS query, doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS rank FROM documents
    WHERE lang IS NOT NULL QUALIFY rank <= 50),
    w AS (SELECT unnest([0.0, 0.25, 0.5, 1.0, 1.5, 2.0, 3.0])::DOUBLE AS w_short),
    s AS (SELECT query, w_short, id, coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(w_short / (60 + b.rank), 0) AS score FROM a FULL
    JOIN b USING (query, id), w)
    SELECT query, w_short, id, row_number() OVER (PARTITION BY query, w_short ORDER BY round(score, 12) DESC, id::VARCHAR)::INT AS rank FROM s
    WHERE score > 0""")
def tune_grid(c: Catalog) -> DataFrame:
    docs = c["documents"].select(F.col("lang").alias("query"), F.col("doc_id").alias("id"), "n_chars").where("lang is not null")

    def first(order) -> DataFrame:
        return docs.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(order, "id"))).where("rank <= 50").select("query", "id", "rank")

    signals = {"long": first(F.desc("n_chars")), "short": first(F.col("n_chars"))}
    return tuning.fuse_grid(signals, {"long": [1.0], "short": [0.0, 0.25, 0.5, 1.0, 1.5, 2.0, 3.0]}).select("query", "w_short", "id", "rank")


# ---- upkeep

LISTINGS = """b AS (SELECT url || '#' || page_id AS path, md5(html) AS h, page_id AS m FROM pages),
    a AS (SELECT CASE WHEN page_id % 11 = 0 THEN '/moved' ELSE '' END || url || '#' || page_id AS path, CASE WHEN page_id % 7 = 0 THEN md5(html || '!') ELSE md5(html) END AS h, CASE WHEN page_id % 5 = 0 THEN page_id + 1 ELSE page_id END AS m
    FROM pages WHERE page_id % 10 <> 0)"""


@query(f"""WITH {LISTINGS}, known AS (SELECT path, a.h AS file_hash, CASE WHEN a.h <> b.h THEN 'changed' WHEN a.m = b.m THEN 'unchanged' ELSE 'touched' END AS status, NULL AS old_path
    FROM a JOIN b USING (path)),
    gone AS (SELECT path AS old_path, h, row_number() OVER (PARTITION BY h ORDER BY path) AS turn FROM b WHERE path NOT IN (SELECT path
    FROM a)), come AS (SELECT path, h, row_number() OVER (PARTITION BY h ORDER BY path) AS turn FROM a WHERE path NOT IN (SELECT path FROM b))
    SELECT * FROM known UNION ALL SELECT coalesce(path, old_path), h, CASE WHEN path IS NULL THEN 'deleted' WHEN old_path IS NULL THEN 'new' ELSE 'moved' END, CASE WHEN path IS NOT NULL THEN old_path END
    FROM come FULL JOIN gone USING (h, turn)""")
def listing_diff(c: Catalog) -> DataFrame:
    pages = c["pages"]
    path = F.concat("url", F.lit("#"), "page_id")
    before = pages.select(path.alias("path"), F.md5("html").alias("file_hash"), F.col("page_id").cast("double").alias("mtime"))
    after = pages.where("page_id % 10 <> 0").select(
        F.concat(F.when(F.col("page_id") % 11 == 0, "/moved").otherwise(""), path).alias("path"),
        F.when(F.col("page_id") % 7 == 0, F.md5(F.concat("html", F.lit("!")))).otherwise(F.md5("html")).alias("file_hash"),
        (F.col("page_id") + F.when(F.col("page_id") % 5 == 0, 1).otherwise(0)).cast("double").alias("mtime"),
    )
    return upkeep.listing_diff(before, after)


@query("""WITH d AS (SELECT doc_id, md5(text) AS file_hash, source FROM documents), seen AS (SELECT DISTINCT file_hash FROM d WHERE source = 'src1'),
    r AS (SELECT d.*, row_number() OVER (PARTITION BY file_hash ORDER BY source, doc_id) AS turn FROM d WHERE source <> 'src1')
    SELECT doc_id, file_hash, source, CASE WHEN file_hash IN (SELECT file_hash
    FROM seen) THEN 'already_seen' WHEN turn = 1 THEN 'imported' ELSE 'duplicate' END AS status FROM r""")
def import_ledger(c: Catalog) -> DataFrame:
    docs = c["documents"].select("doc_id", F.md5("text").alias("file_hash"), "source")
    ledger = docs.where("source = 'src1'").select("file_hash", F.lit("imported").alias("status"))
    return upkeep.import_new(docs.where("source <> 'src1'"), ledger, [F.col("source"), F.col("doc_id")])


@query("""WITH i AS (SELECT user_id, event_id, value FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id
    ORDER BY ts DESC, event_id DESC) = 1),
    x AS (SELECT user_id, min(event_id) AS event_id, 0.0::DOUBLE AS value FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT * FROM i
    UNION ALL SELECT * FROM x WHERE user_id NOT IN (SELECT user_id FROM i)""")
def upsert_latest(c: Catalog) -> DataFrame:
    events = c["events"]
    existing = events.where("event_type = 'signup'").groupBy("user_id").agg(F.min("event_id").alias("event_id")).withColumn("value", F.lit(0.0))
    incoming = events.where("event_type = 'purchase'").select("user_id", "event_id", "value", "ts")
    w = [F.desc("ts"), F.desc("event_id")]
    latest = incoming.withColumn("turn", F.row_number().over(Window.partitionBy("user_id").orderBy(*w))).where("turn = 1")
    return upkeep.upsert(existing, latest.select("user_id", "event_id", "value"), ["user_id"], [F.desc("event_id")])


@query("""SELECT page_id, CASE WHEN url = 'https://site1.example' OR starts_with(url, 'https://site1.example/') THEN 'file:///moved' || substr(url, 22) ELSE url END AS url
    FROM pages""")
def relink_paths(c: Catalog) -> DataFrame:
    return upkeep.relink(c["pages"].select("page_id", "url"), "url", "https://site1.example/", "file:///moved")


@query(r"""SELECT page_id, trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')) AS title, regexp_extract(html, '<html[^>]*\slang=["'']?([A-Za-z-]+)', 1, 'i') AS page_lang
    FROM pages""")
def html_extract(c: Catalog) -> DataFrame:
    return c["pages"].select("page_id", *[x.alias(n) for n, x in files.html_fields("html").items()])


@query("SELECT event_type, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def props_json(c: Catalog) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return c["events"].groupBy("event_type").agg(F.sum(k).alias("k"), F.count("*").alias("n"))


# ---- places

POINTS = """p AS (SELECT c_custkey AS id, (c_custkey * 37 % 1201) / 10.0::DOUBLE - 60 AS lat, (c_custkey * 91 % 3401) / 10.0::DOUBLE - 170 AS lon FROM customer),
    g AS (SELECT n_name AS name, n_nationkey * 4.7::DOUBLE - 57 AS lat, (n_nationkey * 67 % 340)::DOUBLE - 170 AS lon FROM nation),
    k AS (SELECT id, name, 2 * 6371.0088 * asin(sqrt(least(1.0, power(sin(radians(g.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(g.lat)) * power(sin(radians(g.lon - p.lon) / 2), 2)))) AS km
    FROM p, g)"""


@query(f"""WITH {POINTS}, n AS (SELECT id, name, km FROM k WHERE km <= 150 QUALIFY row_number() OVER (PARTITION BY id ORDER BY km, name) = 1)
    SELECT p.id, n.name AS place_name, round(n.km, 6) AS km FROM p LEFT JOIN n USING (id)""")
def geocode_nearest(c: Catalog) -> DataFrame:
    points = c["customer"].select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") * 37 % 1201) / 10 - 60).alias("lat"), ((F.col("c_custkey") * 91 % 3401) / 10 - 170).alias("lon"))
    lat, lon = (F.col("n_nationkey") * 4.7 - 57).alias("lat"), ((F.col("n_nationkey") * 67 % 340).cast("double") - 170).alias("lon")
    unknown = [F.lit(None).cast("string").alias(x) for x in ("admin1", "country")]
    nation = c["nation"].select(F.col("n_name").alias("name"), *unknown, lat, lon, F.lit(100000.0).alias("population"))
    return reverse_geocode(points, nation).select("id", "place_name", F.round("distance_km", 6).alias("km"))


@query("""WITH p AS (SELECT c_custkey AS id, 38 + (c_custkey * 53 % 2003) / 2003.0::DOUBLE * 7 AS lat, (c_custkey * 29 % 1999) / 1999.0::DOUBLE * 10 AS east FROM customer),
    q AS (SELECT id, lat, CASE WHEN east < 4 THEN 176 + east ELSE east - 184 END AS lon FROM p),
    g AS (SELECT 'N' || s_nationkey || CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE ' ' || s_suppkey END AS name, 40 + (s_suppkey * 37 % 1009) / 1009.0::DOUBLE * 3 AS lat,
        (s_suppkey * 91 % 997) / 997.0::DOUBLE * 3 AS east, abs(s_acctbal) * CASE WHEN s_suppkey % 10 = 0 THEN 1000 ELSE 1 END AS population FROM supplier),
    k AS (SELECT id, name, population, 2 * 6371.0088 * asin(sqrt(least(1.0, power(sin(radians(g.lat - q.lat) / 2), 2)
        + cos(radians(q.lat)) * cos(radians(g.lat)) * power(sin(radians(CASE WHEN east < 1 THEN 179 + east ELSE east - 181 END - q.lon) / 2), 2)))) AS km FROM q, g),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, name) AS turn FROM k), n AS (SELECT * FROM r WHERE turn = 1 AND km <= 150),
    c AS (SELECT r.id, r.name, r.km FROM r JOIN n USING (id) WHERE r.turn <= 50 AND r.km <= 1.5 + 3.5 * log10(greatest(r.population, 1000) / 1000)
        AND ((n.population < 25000 AND r.population >= 20 * greatest(n.population, 1000)) OR (starts_with(n.name, r.name || ' ') AND r.population > n.population))
        QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY r.population DESC, r.km) = 1)
    SELECT q.id, coalesce(c.name, n.name) AS place_name, round(coalesce(c.km, n.km), 6) AS km FROM q LEFT JOIN n USING (id) LEFT JOIN c USING (id)""")
def geocode_cities(c: Catalog) -> DataFrame:
    """Customers and suppliers set down on both sides of the date line: districts give way to their cities."""
    east = F.col("c_custkey") * 29 % 1999 / 1999 * 10
    points = c["customer"].select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 53 % 2003 / 2003 * 7 + 38).alias("lat"), F.when(east < 4, east + 176).otherwise(east - 184).alias("lon"))
    city, east = F.col("s_suppkey") % 10 == 0, F.col("s_suppkey") * 91 % 997 / 997 * 3
    name = F.concat(F.lit("N"), "s_nationkey", F.when(city, "").otherwise(F.concat(F.lit(" "), "s_suppkey"))).alias("name")
    unknown = [F.lit(None).cast("string").alias(x) for x in ("admin1", "country")]
    lat, lon = (F.col("s_suppkey") * 37 % 1009 / 1009 * 3 + 40).alias("lat"), F.when(east < 1, east + 179).otherwise(east - 181).alias("lon")
    places = c["supplier"].select(name, *unknown, lat, lon, (F.abs("s_acctbal") * F.when(city, 1000).otherwise(1)).alias("population"))
    return reverse_geocode(points, places).select("id", "place_name", F.round("distance_km", 6).alias("km"))


# ---- streams, run over what is available


@query("""WITH g AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 28800 THEN 0 ELSE 1 END AS starts
    FROM events), s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM g)
    SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY user_id, segment""")
def event_sessions(c: Catalog) -> DataFrame:
    return session_windows(c["events"], "ts", "user_id", "8 hours").select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n")


@query("SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS started, count(*) AS n FROM events GROUP BY ALL")
def event_windows(c: Catalog) -> DataFrame:
    return tumbling_counts(c["events"], "ts", "event_type", "6 hours").select("event_type", F.col("started").cast("timestamp_ntz").alias("started"), "n")


# ---- compositions


NEAR = """WITH RECURSIVE near AS (SELECT q.vec_id AS a, e.vec_id AS b, list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS s FROM embeddings q
    JOIN embeddings e ON q.vec_id <> e.vec_id
    QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) DESC, e.vec_id) <= 10),
    e AS (SELECT a, b FROM near WHERE s >= {least} UNION SELECT b, a FROM near WHERE s >= {least}),
    reach AS (SELECT DISTINCT a, a AS b FROM e UNION SELECT reach.a, e.b FROM reach
    JOIN e ON reach.b = e.a), g AS (SELECT a AS vec_id, min(b) AS "group" FROM reach GROUP BY a)
    SELECT vec_id, "group", count(*) OVER (PARTITION BY "group") AS size, row_number() OVER (PARTITION BY "group"
    ORDER BY label DESC, vec_id) = 1 AS is_best FROM g JOIN embeddings USING (vec_id)"""


def _near_duplicates(c: Catalog, least: float) -> DataFrame:
    rows = c["embeddings"]
    return groups.near_duplicates(groups.nearest_to_queries(rows, rows, "vec_id", "embedding", 10), rows, "vec_id", None, F.col("label"), least)


@query(NEAR.format(least=0.4))
def near_duplicates_cc(c: Catalog) -> DataFrame:
    """Rows joined by their ten nearest, over all rows; groups stay small at this likeness."""
    return _near_duplicates(c, 0.4)


@query(NEAR.format(least=0.38))
def near_duplicates_all(c: Catalog) -> DataFrame:
    return _near_duplicates(c, 0.38)


@query("""WITH g AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 28800 THEN 0 ELSE 1 END AS starts
    FROM events),
    s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment
    FROM g), z AS (SELECT user_id, segment, min(ts) AS started, max(ts) AS ended FROM s GROUP BY ALL),
    m AS (SELECT user_id, segment, event_type AS region FROM s GROUP BY user_id, segment, event_type
    QUALIFY row_number() OVER (PARTITION BY user_id, segment ORDER BY count(*) DESC, min(ts), event_type DESC) = 1),
    f AS (SELECT *, region <> 'view' AS away, lag(region <> 'view') OVER w AS before_away, epoch(started) - epoch(lag(ended) OVER w) AS gap FROM z
    JOIN m USING (user_id, segment) WINDOW w AS (PARTITION BY user_id ORDER BY started, ended)),
    t AS (SELECT *, sum(CASE WHEN away AND before_away AND gap <= 172800 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id
    ORDER BY started, ended ROWS UNBOUNDED PRECEDING)::BIGINT AS trip FROM f),
    p AS (SELECT s.user_id, trip, s.ts, s.event_id, s.event_type, s.value FROM s JOIN t USING (user_id, segment)),
    r AS (SELECT user_id, trip, event_type FROM p GROUP BY user_id, trip, event_type QUALIFY row_number() OVER (PARTITION BY user_id, trip
    ORDER BY count(*) DESC, min(ts), event_type DESC) = 1)
    SELECT user_id, trip, min(ts) AS started, max(ts) AS ended, count(*) AS n, any_value(r.event_type) AS region, (array_agg(event_id
    ORDER BY value DESC NULLS LAST, event_id))[1] AS cover_id FROM p JOIN r USING (user_id, trip) GROUP BY user_id, trip HAVING count(*) >= 3""")
def albums(c: Catalog) -> DataFrame:
    rows = timeline.albums(c["events"], ["user_id"], "ts", "event_id", "event_type", F.col("event_type") == "view", "value", least=3)
    return rows.select("user_id", "trip", "started", "ended", "n", F.col("event_type").alias("region"), "cover_id")


@query("""SELECT lang, count(*) FILTER (WHERE quality = 1) / count(*) AS good, avg(quality) FILTER (WHERE toxic = 0) AS calm, avg(quality) FILTER (WHERE toxic = 1) AS rude
    FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def quality_pivot(c: Catalog) -> DataFrame:
    rows = c["documents"].select("doc_id", "lang").join(c["labels"], "doc_id").withColumn("kind", F.when(F.col("toxic") == 1, "rude").otherwise("calm"))
    table = ranking.by_system(rows.withColumn("quality", F.col("quality").cast("double")), "lang", "kind", "quality", ["calm", "rude"])
    return table.join(rows.groupBy("lang").agg(F.avg("quality").alias("good")), "lang").select("lang", "good", "calm", "rude")


@query("""WITH t AS (SELECT event_type AS answer, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, answer LIMIT 2) SELECT first(answer
    ORDER BY n DESC) AS answer, max(n) AS n FROM t HAVING count(*) = 1 OR max(n) > min(n)""")
def answerable_fact(c: Catalog) -> DataFrame:
    return ranking.facts(c["events"], F.col("event_type"))


@query(f"""WITH {RANKED}, n AS (SELECT query, mrr - precision AS change, precision AS before, mrr AS after FROM m)
    SELECT query, round(before, 9) AS before, round(after, 9) AS after, round(change, 9) AS change FROM n""")
def run_changes(c: Catalog) -> DataFrame:
    scores = _scores(c)
    rows = ranking.compare_runs(scores.select("query", F.col("precision").alias("m")), scores.select("query", F.col("mrr").alias("m")), "m")
    return rows.select("query", *[F.round(x, 9).alias(x) for x in ("before", "after", "change")])


@query("""WITH w AS (SELECT conv_id, turn, ('0x' || md5(w)[25:32])::BIGINT % 16 AS place
    FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM conversations)),
    n AS (SELECT conv_id, turn, place, count(*) AS n FROM w GROUP BY ALL)
    SELECT conv_id, turn, place::INT AS place, round(n / sqrt(sum(n * n) OVER (PARTITION BY conv_id, turn)), 6) AS weight FROM n""")
def hashed_bag_of_words(c: Catalog) -> DataFrame:
    rows = c["conversations"].select("conv_id", "turn", F.posexplode(vector.hashed_words("text", 16)).alias("place", "weight"))
    return rows.where("weight > 0").withColumn("weight", F.round("weight", 6))
