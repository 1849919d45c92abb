"""Relational operators bound to the driver's tables, each with its SQL.

Bindings: a paper is an order (included if its status is F), an entity is a part's brand or type, a mention is a line item, a dataset is
a supplier, a project is a market segment or all orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entities, fdr, filters, links, scoring, stats, topology, upsert

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- entities ---------------------------------------------------------------------------------------------------------


def papers(spark, sf):
    return t(spark, sf, "orders").select(F.col("o_orderkey").alias("paper_id"), (F.col("o_orderstatus") == "F").alias("included"))


def mentions(spark, sf):
    line = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper_id"), "l_partkey", F.col("l_quantity").cast("long").alias("mention_count"), (F.col("l_linenumber") == 1).alias("is_major"), F.col("l_returnflag").alias("qualifier"))
    part = t(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"), F.col("p_type").alias("descriptor"))
    return line.join(part, "l_partkey")


MENTIONS = """mentions AS (SELECT l_orderkey AS paper_id, p_brand AS symbol, p_type AS descriptor, l_partkey, CAST(l_quantity AS BIGINT) AS n, l_linenumber = 1 AS is_major,
 l_returnflag AS qualifier FROM lineitem JOIN part ON l_partkey = p_partkey), papers AS (SELECT o_orderkey AS paper_id, o_orderstatus = 'F' AS included FROM orders)"""


def _list_sql(key: str, extra: str = "", where: str = "true", having: str = "true") -> str:
    return f"""WITH {MENTIONS} SELECT {key}, count(DISTINCT paper_id) AS total_papers, count(DISTINCT paper_id) FILTER (included) AS included_papers,
 CAST(sum(n) AS BIGINT) AS mentions{extra} FROM mentions JOIN papers USING (paper_id) WHERE {where} GROUP BY {key} HAVING {having}"""


@query(_list_sql("symbol", ", max(l_partkey) AS entrez_id"))
def e1_gene_list(spark, sf):
    return entities.entity_list(mentions(spark, sf), papers(spark, sf), "symbol", {"entrez_id": F.col("l_partkey")})


@query(_list_sql("descriptor", ", max(symbol) AS drug_name", where="contains(lower(descriptor), 'e')"))
def e2_drug_list(spark, sf):
    return entities.entity_list(mentions(spark, sf), papers(spark, sf), "descriptor", {"drug_name": F.col("symbol")}, q="E")


@query(_list_sql("l_partkey", having="count(DISTINCT paper_id) FILTER (included) > 0"))
def e3_variant_list(spark, sf):
    return entities.entity_list(mentions(spark, sf), papers(spark, sf), "l_partkey", included_only=True)


@query(_list_sql("descriptor", ", count(DISTINCT paper_id) FILTER (included AND is_major) AS major_topic_count"))
def e4_mesh_list(spark, sf):
    return entities.entity_list(mentions(spark, sf), papers(spark, sf), "descriptor", major="is_major")


@query(f"""WITH {MENTIONS} SELECT symbol, count(DISTINCT paper_id) AS total_papers, count(DISTINCT paper_id) FILTER (included) AS included_papers, CAST(sum(n) AS BIGINT) AS mentions,
 string_agg(DISTINCT qualifier, ',' ORDER BY qualifier) AS qualifiers FROM mentions JOIN papers USING (paper_id) WHERE symbol = 'Brand#11' GROUP BY symbol""")
def e5_mesh_detail(spark, sf):
    return entities.entity_detail(mentions(spark, sf), papers(spark, sf), "symbol", "Brand#11", "qualifier")


# --- statistics -------------------------------------------------------------------------------------------------------


def seg_orders(spark, sf):
    customer = t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return t(spark, sf, "orders").join(customer, "o_custkey")


@query("""SELECT c_mktsegment AS segment, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o,
 count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def e6_status_counts(spark, sf):
    return stats.status_counts(seg_orders(spark, sf), "segment", "o_orderstatus", ["F", "O", "P"])


@query("""WITH said AS (SELECT c_nationkey AS nation, CAST(coalesce(sum(CASE WHEN c_acctbal > 0 THEN 1 END), 0) AS BIGINT) AS said FROM customer GROUP BY 1),
 real AS (SELECT s_nationkey AS nation, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
 SELECT nation, CASE WHEN coalesce(n, 0) > 0 THEN n ELSE said END AS total_samples FROM said LEFT JOIN real USING (nation)""")
def e7_total_samples(spark, sf):
    declared = t(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.when(F.col("c_acctbal") > 0, 1).alias("n_samples"))
    samples = t(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation"))
    return stats.sample_totals(declared, samples, "nation")


@query("""SELECT c_mktsegment AS segment, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def e8_by_year(spark, sf):
    return seg_orders(spark, sf).groupBy("segment", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT c_mktsegment AS segment, CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS journal FROM orders JOIN customer ON o_custkey = c_custkey),
 n AS (SELECT segment, journal, count(*) AS n FROM c GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY segment ORDER BY n DESC, journal) AS INTEGER) AS rank FROM n)
 SELECT * FROM r WHERE rank <= 8 AND journal <> ''""")
def e8_top_journals(spark, sf):
    rows = seg_orders(spark, sf).withColumn("journal", F.when(F.col("nation") % 5 == 0, "").otherwise(F.col("nation").cast("string")))
    return stats.top_groups(rows, "segment", "journal", 8)


@query("""WITH n AS (SELECT o_orderstatus, p_brand, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY n DESC, p_brand) AS INTEGER) AS rank FROM n) SELECT * FROM r WHERE rank <= 20""")
def e9_top_entities(spark, sf):
    line = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"), "l_quantity")
    rows = line.join(t(spark, sf, "part").select("p_partkey", "p_brand"), "p_partkey").join(t(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    return stats.top_groups(rows, "o_orderstatus", "p_brand", 20, F.col("l_quantity").cast("long"))


@query("""SELECT n_nationkey AS nation, n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_papers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_datasets FROM nation""")
def e23_project_counts(spark, sf):
    nations = t(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), "n_name")
    return stats.child_counts(nations, "nation", n_papers=t(spark, sf, "customer").withColumnRenamed("c_nationkey", "nation"), n_datasets=t(spark, sf, "supplier").withColumnRenamed("s_nationkey", "nation"))


@query("""WITH r AS (SELECT l_suppkey, CASE WHEN l_quantity > 49 AND l_suppkey % 2 = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS size, l_returnflag FROM lineitem)
 SELECT l_suppkey, CASE WHEN count(*) = count(size) THEN CAST(sum(size) AS BIGINT) END AS total_bytes, count(*) FILTER (l_returnflag = 'R') AS n_marked, count(*) AS n_rows FROM r GROUP BY 1""")
def e30_known_bytes(spark, sf):
    rows = t(spark, sf, "lineitem").withColumn("size", F.when((F.col("l_quantity") > 49) & (F.col("l_suppkey") % 2 == 0), None).otherwise(F.col("l_quantity").cast("long")))
    return stats.known_total(rows, "l_suppkey", "size", F.col("l_returnflag") == "R")


@query("""SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 20""")
def g1_page(spark, sf):
    rows = t(spark, sf, "customer").select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"))
    return stats.page(rows, "no such ordering", {"-balance": F.desc("c_acctbal"), "name": F.asc("c_name")}, "-balance", "c_custkey", number=2, size=20)


# --- filters ----------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND contains(lower(o_orderpriority), 'u') AND o_totalprice >= 1000 AND o_totalprice <= 150000
 AND o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE lower(p_brand) = 'brand#11')""")
def c1_dataset_filters(spark, sf):
    rows = filters.apply(
        t(spark, sf, "orders"), {"o_orderstatus": "O", "o_orderpriority": "U", "min": "1000", "max": 150000, "bad": "x"},
        equal=("o_orderstatus",), contains=("o_orderpriority",), at_least={"min": "o_totalprice", "bad": "o_totalprice"}, at_most={"max": "o_totalprice"},
    )
    genes = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey")).join(t(spark, sf, "part").where(F.lower("p_brand") == "brand#11").select("p_partkey"), "p_partkey")
    return filters.with_match(rows, genes, "o_orderkey").select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("""SELECT event_id, user_id FROM events WHERE CAST(props->>'$.k' AS DOUBLE) >= 50 AND event_type IN ('click', 'view', 'purchase')""")
def c1f_json_threshold(spark, sf):
    return filters.apply(t(spark, sf, "events"), {"score": 50, "kinds": ["click", "view", "purchase"]}, one_of={"kinds": "event_type"}, scores={"score": ("props", "k")}).select("event_id", "user_id")


@query("""WITH u AS (SELECT user_id, list(DISTINCT event_type) AS layers FROM events GROUP BY 1) SELECT user_id FROM u WHERE list_contains(layers, 'click')""")
def c1e_array_contains(spark, sf):
    users = t(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("layers"))
    return filters.apply(users, {"layer": "click"}, has={"layer": "layers"}).select("user_id")


@query("""SELECT event_id, ts FROM events WHERE event_type = 'view' AND CAST(props->>'$.k' AS DOUBLE) < 50 ORDER BY ts, event_id""")
def c5_curation_queue(spark, sf):
    rows = t(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("added_at"), F.when(F.col("event_type") == "view", "unknown").otherwise("set").alias("axis"), "props")
    return filters.curation_queue(rows, "axis", "props", "k", 50).select(F.col("id").alias("event_id"), F.col("added_at").alias("ts"))


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN 'mixed' ELSE 'discordance' END AS reason FROM events WHERE event_type = 'click' OR (event_type <> 'purchase' AND CAST(props->>'$.k' AS INT) > 90)""")
def c6_high_value_queue(spark, sf):
    axis = F.when(F.col("event_type") == "click", "mixed").when(F.col("event_type") == "purchase", "monogenic").otherwise(F.col("event_type"))
    k = F.get_json_object("props", "$.k").cast("int")
    none = F.when(k % 3 == 0, '{"contract": {"monogenic_gene_hit": {"genes": [ ]}}}').when(k % 3 == 1, '{"contract": {"monogenic_gene_hit": null}}').otherwise('{"contract": {}}')
    metadata = F.when(k > 90, F.concat(F.lit('{"contract": {"monogenic_gene_hit": {"genes": ["G'), k.cast("string"), F.lit('"], "n": 1}}}'))).otherwise(none)
    rows = t(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("added_at"), axis.alias("axis"), metadata.alias("metadata"))
    return filters.high_value_queue(rows).select(F.col("id").alias("event_id"), "reason")


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS resolved FROM customer""")
def c7_resolved_flag(spark, sf):
    runs = t(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return filters.flagged(t(spark, sf, "customer").select("c_custkey"), runs, "c_custkey", "resolved")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'included' ELSE o_orderstatus END AS curation_status, CASE WHEN o_totalprice > 200000 THEN 'large' ELSE o_orderpriority END AS curation_reason FROM orders""")
def c8_bulk_update(spark, sf):
    rows = t(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("curation_status"), F.col("o_orderpriority").alias("curation_reason"))
    return filters.bulk_update(rows, "o_orderkey", "included", "large", condition=F.col("o_totalprice") > 200000).drop("o_totalprice")


@query("""WITH c AS (SELECT o_custkey AS k, min(o_orderdate) AS c FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), p AS (SELECT o_custkey AS k, max(o_orderdate) AS u FROM orders GROUP BY 1)
 SELECT k AS paper_id, c IS NULL OR c < u AS computing FROM p LEFT JOIN c USING (k)""")
def c18_stale(spark, sf):
    o = t(spark, sf, "orders").withColumnRenamed("o_custkey", "paper_id")
    return entities.stale(o.groupBy("paper_id").agg(F.max("o_orderdate").alias("updated_at")), o.where("o_orderstatus = 'F'").select("paper_id", F.col("o_orderdate").alias("computed_at")))


# --- links ------------------------------------------------------------------------------------------------------------


def part_links(spark, sf):
    return t(spark, sf, "lineitem").select(F.col("l_partkey").alias("paper_id"), F.col("l_suppkey").alias("dataset_id"))


@query("""SELECT DISTINCT CAST(l_partkey % 3 AS BIGINT) AS project_id, l_partkey AS paper_id, l_suppkey AS dataset_id FROM lineitem WHERE l_partkey % 3 = l_suppkey % 3""")
def d1_materialised_links(spark, sf):
    p = t(spark, sf, "part").select((F.col("p_partkey") % 3).alias("project_id"), F.col("p_partkey").alias("paper_id"))
    d = t(spark, sf, "supplier").select((F.col("s_suppkey") % 3).alias("project_id"), F.col("s_suppkey").alias("dataset_id"))
    return links.materialise(part_links(spark, sf), p, d)


@query("""WITH l AS (SELECT DISTINCT l_partkey AS paper_id, l_suppkey AS dataset_id FROM lineitem)
 SELECT 'dataset' AS kind, * FROM l WHERE paper_id % 4 = 0 AND NOT dataset_id % 3 = 0 UNION ALL SELECT 'paper', * FROM l WHERE dataset_id % 3 = 0 AND NOT paper_id % 4 = 0""")
def d2_orphan_links(spark, sf):
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("paper_id")).where("paper_id % 4 = 0")
    d = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("dataset_id")).where("dataset_id % 3 = 0")
    return links.orphans(part_links(spark, sf), p, d)


@query("""WITH l AS (SELECT DISTINCT l_partkey AS pmid, l_suppkey AS accession, min(l_returnflag) AS source FROM lineitem GROUP BY 1, 2)
 SELECT pmid, accession, source FROM l WHERE NOT (pmid % 2 = 0 AND accession % 2 = 0)""")
def b7_pending_links(spark, sf):
    found = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("pmid"), F.col("l_suppkey").alias("accession"), F.col("l_returnflag").alias("source"))
    d = t(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("accession"), F.col("s_suppkey").alias("dataset_id"))
    p = t(spark, sf, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("pmid"), F.col("p_partkey").alias("paper_id"))
    return links.resolve_pending(links.store_pending(found), d, p)[1].select("pmid", "accession", "source")


@query("""SELECT DISTINCT l_suppkey AS dataset_id, 'pending' AS curation_status FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def b8_link_missing(spark, sf):
    return links.link_missing(part_links(spark, sf), t(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("dataset_id")), "dataset_id")


@query("""WITH s AS (SELECT DISTINCT user_id, event_type FROM events) SELECT x.event_type AS a, y.event_type AS b, count(*) AS n_groups FROM s x JOIN s y ON x.user_id = y.user_id AND x.event_type < y.event_type GROUP BY 1, 2""")
def d4_co_occurring(spark, sf):
    return links.co_occurring(t(spark, sf, "events"), "user_id", "event_type")


# --- false discovery rate and its report ------------------------------------------------------------------------------


def scores(spark, sf):
    """Scores from orders: pathway = nation, sample = customer, p a ratio of whole numbers, some families without variance."""
    o = seg_orders(spark, sf)
    return o.select(
        F.col("nation").alias("pathway_id"), F.col("o_custkey").alias("sample_id"), F.col("o_orderkey").alias("id"),
        ((F.col("o_orderkey") * 7 % 1000 + 1) / F.lit(1001.0)).alias("p_empirical"), F.when(F.col("o_orderkey") % 9 == 0, 0.0).otherwise(1.0).alias("null_sd"), (F.col("o_orderkey") % 13).cast("double").alias("z_score"),
    )


SCORES = """scores AS (SELECT c_nationkey AS pathway_id, o_custkey AS sample_id, o_orderkey AS id, (o_orderkey * 7 % 1000 + 1) / 1001.0 AS p, o_orderkey % 9 = 0 AS degenerate, o_orderkey % 13 AS z
 FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _bh(part: str) -> str:
    return f"""e AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY p, id) AS rk, count(*) OVER (PARTITION BY {part}) AS m FROM scores WHERE NOT degenerate),
 q AS (SELECT id, m, min(least(CAST(p AS DOUBLE) * m / rk, 1.0)) OVER (PARTITION BY {part} ORDER BY rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM e)"""


@query(f"""WITH {SCORES}, {_bh("pathway_id")} SELECT s.id, round(q, 9) AS q, coalesce(m, 0) AS m FROM scores s LEFT JOIN q USING (id)""")
def f_bh_population(spark, sf):
    return fdr.adjust(scores(spark, sf), "population").select("id", F.round("q_value_across_samples", 9).alias("q"), F.col("fdr_n_tests_across_samples").alias("m"))


@query(f"""WITH {SCORES}, {_bh("sample_id")} SELECT s.id, round(q, 9) AS q, coalesce(m, 0) AS m FROM scores s LEFT JOIN q USING (id)""")
def f_bh_individual(spark, sf):
    return fdr.adjust(scores(spark, sf), "individual").select("id", F.round("q_value_across_pathways", 9).alias("q"), F.col("fdr_n_tests_across_pathways").alias("m"))


def _reported(spark, sf):
    return scores(spark, sf).withColumn("q_value_across_samples", F.when(F.col("null_sd") != 0, F.col("p_empirical"))).withColumn("q_value_across_pathways", F.when(F.col("null_sd") != 0, F.col("p_empirical")))


def _pathways(spark, sf):
    return t(spark, sf, "nation").select(F.col("n_nationkey").alias("pathway_id"), F.col("n_name").alias("name"))


@query(f"""WITH {SCORES}, r AS (SELECT pathway_id + CASE WHEN pathway_id % 4 = 0 THEN 1 ELSE 0 END AS pathway_id, count(*) AS n, count(*) FILTER (NOT degenerate) AS e, count(*) FILTER (NOT degenerate AND p < 0.002) AS h FROM scores GROUP BY 1)
 SELECT CASE WHEN n IS NULL THEN 'no_readout' WHEN e = 0 THEN 'no_seed' WHEN h > 0 THEN 'attributable' ELSE 'not_attributable' END AS class, count(*) AS n_pathways
 FROM nation LEFT JOIN r ON n_nationkey = pathway_id GROUP BY 1""")
def d5_taxonomy(spark, sf):
    # every fourth pathway's rows are its neighbour's, so some pathways have none
    moved = F.col("pathway_id") + F.when(F.col("pathway_id") % 4 == 0, 1).otherwise(0)
    return fdr.taxonomy(_pathways(spark, sf), _reported(spark, sf).withColumn("pathway_id", moved), 0.002)


@query(f"""WITH {SCORES}, e AS (SELECT n_nationkey AS pathway_id, avg(CASE WHEN c_custkey % 3 = 0 THEN 1.0 ELSE 0.0 END) AS u FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
 SELECT s.pathway_id, n_name AS name, count(*) FILTER (NOT degenerate AND p < 0.05) AS n_attributable, count(*) FILTER (NOT degenerate) AS n_evaluable,
 CAST(quantile_cont(z, 0.5) FILTER (NOT degenerate) AS DOUBLE) AS z_median, round(CAST(min(p) FILTER (NOT degenerate) AS DOUBLE), 9) AS q_min, round(any_value(u), 9) AS unsigned_fraction
 FROM scores s JOIN nation ON pathway_id = n_nationkey LEFT JOIN e ON e.pathway_id = s.pathway_id GROUP BY 1, 2 HAVING count(*) FILTER (NOT degenerate AND p < 0.05) > 0""")
def d6_population_report(spark, sf):
    edges = t(spark, sf, "customer").select(F.col("c_nationkey").alias("pathway_id"), F.when(F.col("c_custkey") % 3 == 0, 0).otherwise(1).alias("sign"))
    out = fdr.population(_pathways(spark, sf), _reported(spark, sf), edges)
    return out.withColumn("q_min", F.round("q_min", 9)).withColumn("unsigned_fraction", F.round("unsigned_fraction", 9))


@query(f"""WITH {SCORES} SELECT sample_id, count(*) AS n_pathways, round(CAST(min(p) AS DOUBLE), 9) AS q_min, string_agg(CAST(pathway_id AS VARCHAR), ',' ORDER BY CAST(pathway_id AS VARCHAR)) AS pathways
 FROM scores WHERE NOT degenerate AND p < 0.05 GROUP BY 1""")
def e13_individual_report(spark, sf):
    return fdr.individual(_reported(spark, sf)).withColumn("q_min", F.round("q_min", 9))


@query(f"""WITH {SCORES} SELECT count(*) FILTER (p < 0.05) AS q_5, count(*) FILTER (p < 0.10) AS q_10, count(*) FILTER (p < 0.25) AS q_25, count(DISTINCT sample_id) FILTER (p < 0.05) AS n_samples FROM scores WHERE NOT degenerate""")
def e24_sensitivity(spark, sf):
    return fdr.sensitivity(_reported(spark, sf))


# --- pathway graphs ---------------------------------------------------------------------------------------------------


def edges(spark, sf):
    """Edges customer nation -> supplier nation within a return flag's pathway, signed by the flag and line."""
    line = t(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_linestatus", "l_linenumber")
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus")
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("source"))
    s = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("target"))
    rows = line.join(o, "l_orderkey").join(c, "o_custkey").join(s, "l_suppkey")
    pathway = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3).cast("long")
    # a third of the nations stand in for their neighbour, so some nodes have no edges out
    source = F.col("source") - F.when(F.col("source") % 3 == 1, 1).otherwise(0)
    return rows.select(pathway.alias("pathway_id"), source.alias("source"), "target", F.when(F.col("l_linenumber") == 2, 0).when(F.col("l_linestatus") == "F", 1).otherwise(-1).alias("sign")).distinct()


EDGES = """edges AS (SELECT DISTINCT CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS pathway_id, c_nationkey - CASE WHEN c_nationkey % 3 = 1 THEN 1 ELSE 0 END AS source, s_nationkey AS target,
 CASE WHEN l_linenumber = 2 THEN 0 WHEN l_linestatus = 'F' THEN 1 ELSE -1 END AS sign FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""
CLASSED = f"""{EDGES}, nodes AS (SELECT CAST(r AS BIGINT) AS pathway_id, CAST(n_nationkey AS BIGINT) AS node_id, upper(n_name) AS gene FROM nation, (VALUES (1), (2), (3)) v(r)),
 seeds AS (SELECT upper(n_name) AS gene, count(*) AS n_seeds FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1),
 deg AS (SELECT pathway_id, source, count(*) AS o, count(*) FILTER (sign <> 0) AS s FROM edges GROUP BY 1, 2),
 cl AS (SELECT n.pathway_id, node_id, gene, n_seeds, CASE WHEN o IS NULL THEN 'no_out' WHEN s = 0 THEN 'blind' ELSE 'useful' END AS category FROM nodes n JOIN seeds USING (gene) LEFT JOIN deg d ON d.pathway_id = n.pathway_id AND d.source = node_id)"""


def nodes(spark, sf):
    n = t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("node_id"), F.col("n_name").alias("gene_symbol"), F.lit("gene").alias("node_type"))
    return n.withColumn("pathway_id", F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)])))


def _classified(spark, sf):
    c = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    seeds = c.select(F.lower("n_name").alias("gene_symbol"), F.when(F.col("c_acctbal") > 0, "activator").otherwise("neutral").alias("direction"))
    return topology.connectivity(nodes(spark, sf), edges(spark, sf), seeds)


@query(f"""WITH {EDGES} SELECT n_nationkey AS pathway_id, count(source) AS n_edges, count(source) FILTER (sign <> 0) AS n_signed, CASE WHEN count(source) = 0 THEN 'no_edges' WHEN count(source) < 20 THEN 'few_edges'
 WHEN count(source) FILTER (sign <> 0) / count(source) < 0.5 THEN 'low_signed' END AS reason FROM nation LEFT JOIN edges ON n_nationkey = pathway_id GROUP BY 1""")
def c10_topology_quality(spark, sf):
    return topology.quality(t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("pathway_id")), edges(spark, sf), 20).withColumn("pathway_id", F.col("pathway_id").cast("int"))


@query(f"""WITH {CLASSED} SELECT pathway_id, node_id, gene, n_seeds, category FROM cl""")
def d7_connectivity(spark, sf):
    return _classified(spark, sf)


@query(f"""WITH {CLASSED}, g AS (SELECT pathway_id, gene, max(n_seeds) AS n_seeds FROM cl GROUP BY 1, 2), p AS (SELECT pathway_id, CAST(sum(n_seeds) AS BIGINT) AS n_seeds FROM g GROUP BY 1)
 SELECT pathway_id, count(*) AS n_nodes, count(*) FILTER (category = 'no_out') AS n_no_out, count(*) FILTER (category = 'blind') AS n_blind, count(*) FILTER (category = 'useful') AS n_useful,
 round(count(*) FILTER (category = 'no_out') / count(*), 9) AS no_out_share, any_value(p.n_seeds) AS n_seeds FROM cl JOIN p USING (pathway_id) GROUP BY 1""")
def e14_connectivity_by_pathway(spark, sf):
    return topology.connectivity_by_pathway(_classified(spark, sf)).withColumn("no_out_share", F.round("no_out_share", 9))


@query(f"""WITH {CLASSED}, g AS (SELECT gene, n_seeds, pathway_id, bool_and(category = 'no_out') AS iso FROM cl GROUP BY 1, 2, 3)
 SELECT gene, n_seeds, count(*) AS n_pathways, count(*) FILTER (iso) AS n_isolated FROM g GROUP BY 1, 2 HAVING count(*) FILTER (iso) > 0""")
def e12_connectivity_by_gene(spark, sf):
    return topology.connectivity_by_gene(_classified(spark, sf))


@query(f"""WITH {CLASSED} SELECT count(*) AS n_total, count(*) FILTER (category = 'no_out') AS n_no_out, count(*) FILTER (category = 'blind') AS n_blind, count(*) FILTER (category = 'useful') AS n_useful,
 count(*) FILTER (category = 'useful') / count(*) < 0.6 AS warn FROM cl""")
def j13_verdict(spark, sf):
    return topology.verdict(_classified(spark, sf))


@query(f"""WITH {EDGES}, w AS (SELECT *, CASE WHEN sign = 0 THEN 0.3 ELSE sign END AS w FROM edges WHERE source % 5 <> 3 AND target % 5 <> 3) SELECT CAST(pathway_id AS BIGINT) AS pathway_id, CAST(source AS BIGINT) AS source, CAST(target AS BIGINT) AS target, sign,
 round(CAST(w AS DOUBLE) / sum(abs(CAST(w AS DOUBLE))) OVER (PARTITION BY pathway_id, source), 9) AS weight FROM w""")
def j1_adjacency(spark, sf):
    """Every fifth nation is a node of type map, which leaves the graph before edges get weights."""
    kind = F.when(F.col("node_id") % 5 == 3, "map").otherwise("gene")
    inner = scoring.inner_edges(scoring.graph_nodes(nodes(spark, sf).select("pathway_id", "node_id", F.col("gene_symbol").alias("gene"), kind.alias("node_type"))), edges(spark, sf))
    return topology.adjacency(inner).select("pathway_id", "source", "target", "sign", F.round("weight", 9).alias("weight"))


@query(f"""WITH {EDGES}, n AS (SELECT CAST(r AS BIGINT) AS pathway_id, CAST(n_nationkey AS BIGINT) AS node_id FROM nation, (VALUES (1), (2), (3)) v(r)), d AS (SELECT pathway_id, source, count(*) AS d FROM edges GROUP BY 1, 2)
 SELECT n.pathway_id, node_id, coalesce(d, 0) AS degree, CAST(floor((row_number() OVER (PARTITION BY n.pathway_id ORDER BY coalesce(d, 0), node_id) - 1) * 4 / count(*) OVER (PARTITION BY n.pathway_id)) AS INTEGER) AS quartile
 FROM n LEFT JOIN d ON d.pathway_id = n.pathway_id AND source = node_id""")
def f4_quartiles(spark, sf):
    return topology.out_degree_quartiles(nodes(spark, sf), edges(spark, sf))


# --- merges -----------------------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT lang || ':' || source AS pmid, doc_id, text, row_number() OVER (PARTITION BY lang, source ORDER BY length(text) DESC, doc_id) AS n FROM documents) SELECT pmid, doc_id, length(text) AS chars FROM r WHERE n = 1""")
def b4_longest_wins(spark, sf):
    rows = t(spark, sf, "documents").select(F.concat_ws(":", "lang", "source").alias("pmid"), "doc_id", "text")
    return upsert.longest_wins(rows, ["pmid"], "text", "doc_id").select("pmid", "doc_id", F.length("text").cast("long").alias("chars"))


@query("""WITH o AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg, CAST(c_nationkey AS VARCHAR) AS types FROM customer WHERE c_custkey % 3 <> 0),
 n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_name || '+' ELSE 'x' END AS name, CASE WHEN c_custkey % 5 = 0 THEN 'unknown' ELSE lower(c_mktsegment) END AS seg, CAST(c_nationkey % 7 AS VARCHAR) AS types FROM customer WHERE c_custkey % 4 <> 0)
 SELECT k, CASE WHEN o.name IS NULL THEN n.name WHEN n.name IS NULL THEN o.name WHEN length(n.name) > length(o.name) THEN n.name ELSE o.name END AS name,
 CASE WHEN o.name IS NULL THEN n.seg WHEN n.name IS NULL OR n.seg = 'unknown' THEN o.seg ELSE n.seg END AS seg,
 CASE WHEN o.name IS NULL THEN n.types WHEN n.name IS NULL OR n.types = o.types THEN o.types ELSE least(n.types, o.types) || ',' || greatest(n.types, o.types) END AS types FROM o FULL JOIN n USING (k)""")
def b3_upsert(spark, sf):
    c = t(spark, sf, "customer")
    key = F.col("c_custkey")
    stored = c.where("c_custkey % 3 <> 0").select(key.alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").cast("string").alias("types"))
    new = c.where("c_custkey % 4 <> 0").select(
        key.alias("k"), F.when(key % 2 == 0, F.concat("c_name", F.lit("+"))).otherwise("x").alias("name"), F.when(key % 5 == 0, "unknown").otherwise(F.lower("c_mktsegment")).alias("seg"), (F.col("c_nationkey") % 7).cast("string").alias("types")
    )
    return upsert.upsert(stored, new, ["k"], {"name": "longer", "seg": "known", "types": "united"})


@query("""SELECT lang AS accession, min_by(doc_id, (-length(text), doc_id)) AS title, string_agg(DISTINCT source, ',' ORDER BY source) AS omic_type, CAST(max(doc_id) AS VARCHAR) AS last FROM documents GROUP BY 1""")
def b2_batch_merge(spark, sf):
    # the document's number stands at the end of its title, in as many characters for all, so that the longest title tells which it is
    title = F.concat(F.coalesce("text", F.lit("")), F.lpad(F.col("doc_id").cast("string"), 20, " "))
    r = t(spark, sf, "documents").select(
        F.col("lang").alias("accession"), F.col("doc_id").alias("seq"), title.alias("title"), F.lit("").alias("summary"), F.col("source").alias("omic_type"), F.array("source").alias("omics_layers"),
        F.create_map(F.lit("last"), F.col("doc_id").cast("string")).alias("metadata"), F.lit(1).alias("omics_count"), F.lit("unknown").alias("organism"),
    )
    return upsert.batch_merge(r).select("accession", F.trim(F.right("title", F.lit(20))).cast("long").alias("title"), "omic_type", F.col("metadata")["last"].alias("last"))


@query("""SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT DISTINCT l_orderkey, 'new' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)""")
def b5_insert_missing(spark, sf):
    stored = t(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    return upsert.insert_missing(stored, t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.lit("new").alias("s")), ["k"])


@query("""WITH o AS (SELECT l_partkey AS k, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS k, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
 SELECT k, coalesce(b.n, o.n) AS mention_count FROM o FULL JOIN b USING (k)""")
def b6_mention_upsert(spark, sf):
    rows = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_quantity").cast("long").alias("mention_count"), "l_returnflag")
    stored = rows.where("l_returnflag = 'A'").groupBy("k").agg(F.sum("mention_count").alias("mention_count"))
    return upsert.mention_counts(stored, rows.where("l_returnflag = 'R'"), ["k"])


@query("""SELECT l_suppkey, max(l_orderkey * 100000 + l_partkey) AS seq, max_by(l_partkey, l_orderkey * 100000 + l_partkey) AS l_partkey FROM lineitem GROUP BY 1""")
def e18_last_wins(spark, sf):
    rows = t(spark, sf, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("seq"), "l_partkey")
    return topology.last_wins(rows, ["l_suppkey"], "seq")
