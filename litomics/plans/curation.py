"""Merges, filters, listings and classifiers bound to the driver's tables, each with its SQL.

Bindings: a sample is a customer, a run an order, a dataset a supplier, a paper an order or a document, a category a line's ship mode."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify
from ..operators import curation, filters, links, matrices, stats, upsert
from ..sources import sinks, tables
from .relational import query, t

# --- merges -----------------------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT s_suppkey AS accession, s_name AS storage_key, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 10 END AS size_bytes, md5(s_name) AS checksum_md5, 'queued' AS download_status FROM supplier),
 n AS (SELECT s_suppkey + 3 AS accession, lower(s_name) AS storage_key, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey END AS size_bytes, CASE WHEN s_suppkey % 5 = 0 THEN 'x' END AS checksum_md5, 'done' AS download_status FROM supplier)
 SELECT coalesce(n.accession, o.accession) AS accession, CASE WHEN n.accession IS NULL THEN o.storage_key ELSE n.storage_key END AS storage_key, coalesce(n.size_bytes, o.size_bytes) AS size_bytes, coalesce(n.checksum_md5, o.checksum_md5) AS checksum_md5,
 CASE WHEN n.accession IS NULL THEN o.download_status ELSE n.download_status END AS download_status FROM o FULL JOIN n ON o.accession = n.accession""")
def b9_dataset_files(spark, sf):
    s = t(spark, sf, "supplier")
    k, none = F.col("s_suppkey"), F.lit(None).cast("string")
    rest = [F.lit(None).cast("long").alias("bytes_downloaded"), none.alias("error_message")]
    stored = s.select(k.alias("accession"), F.col("s_name").alias("storage_key"), F.when(k % 2 == 0, k * 10).alias("size_bytes"), F.md5(F.col("s_name").cast("binary")).alias("checksum_md5"), F.lit("queued").alias("download_status"), *rest)
    new = s.select((k + 3).alias("accession"), F.lower("s_name").alias("storage_key"), F.when(k % 3 == 0, k).alias("size_bytes"), F.when(k % 5 == 0, "x").alias("checksum_md5"), F.lit("done").alias("download_status"), *rest)
    return upsert.upsert(stored, new, ["accession"], upsert.FILE_RULES).drop("bytes_downloaded", "error_message")


@query("""WITH o AS (SELECT c_custkey AS accession, c_name AS title, c_mktsegment AS organism, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS tax_id, 'old' || c_custkey AS v FROM customer),
 r AS (SELECT o_custkey AS accession, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN repeat('t', 30) ELSE 't' END AS title, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderstatus END AS organism, CASE WHEN o_orderkey % 5 = 0 THEN 7 END AS tax_id, 'new' || o_orderkey AS v FROM orders),
 n AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY accession ORDER BY seq) = 1)
 SELECT coalesce(o.accession, n.accession) AS accession, CASE WHEN n.accession IS NULL THEN o.title WHEN o.accession IS NULL OR length(n.title) > length(o.title) THEN n.title ELSE o.title END AS title,
 CASE WHEN o.accession IS NULL THEN n.organism ELSE coalesce(nullif(n.organism, ''), o.organism) END AS organism, coalesce(n.tax_id, o.tax_id) AS tax_id, coalesce(n.v, o.v) AS a, CASE WHEN o.accession IS NOT NULL THEN o.v END AS b FROM o FULL JOIN n ON o.accession = n.accession""")
def b10_samples(spark, sf):
    none = F.lit(None).cast("string")
    c, o = t(spark, sf, "customer"), t(spark, sf, "orders")
    k, e = F.col("c_custkey"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    old, v = F.concat(F.lit("old"), k.cast("string")), F.concat(F.lit("new"), F.col("o_orderkey").cast("string"))
    stored = c.select(k.alias("accession"), F.col("c_name").alias("title"), none.alias("source_name"), F.col("c_mktsegment").alias("organism"), F.when(k % 2 == 0, F.col("c_nationkey")).cast("long").alias("tax_id"), none.alias("platform"), F.create_map(F.lit("a"), old, F.lit("b"), old).alias("characteristics"), e.alias("extra_metadata"))
    s = F.col("o_orderkey")
    batch = o.select(F.col("o_custkey").alias("accession"), s.alias("seq"), F.when(s % 3 == 0, F.lit("t" * 30)).otherwise("t").alias("title"), none.alias("source_name"), F.when(s % 2 == 0, "").otherwise(F.col("o_orderstatus")).alias("organism"), F.when(s % 5 == 0, 7).cast("long").alias("tax_id"), none.alias("platform"), F.create_map(F.lit("a"), v).alias("characteristics"), e.alias("extra_metadata"))
    return upsert.sample_upsert(stored, batch).select("accession", "title", "organism", "tax_id", F.col("characteristics")["a"].alias("a"), F.col("characteristics")["b"].alias("b"))


@query("""WITH o AS (SELECT p_partkey AS variant_key, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS raw_magnitude, p_brand AS raw_class, p_name AS oncogenicity FROM part),
 n AS (SELECT p_partkey + 5 AS variant_key, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS raw_magnitude, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type END AS raw_class, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_type END AS oncogenicity FROM part)
 SELECT coalesce(n.variant_key, o.variant_key) AS variant_key, coalesce(n.raw_magnitude, o.raw_magnitude) AS raw_magnitude, CASE WHEN n.variant_key IS NULL THEN o.raw_class ELSE n.raw_class END AS raw_class,
 CASE WHEN o.variant_key IS NULL THEN n.oncogenicity ELSE coalesce(nullif(n.oncogenicity, ''), o.oncogenicity) END AS oncogenicity FROM o FULL JOIN n ON o.variant_key = n.variant_key""")
def b11_variants(spark, sf):
    p, k = t(spark, sf, "part"), F.col("p_partkey")
    rest = [F.lit(None).cast("string").alias(c) for c in ("clinvar_significance", "am_pathogenicity", "confidence", "source_version")]
    stored = p.select(k.alias("variant_key"), F.when(k % 2 == 0, F.col("p_size")).alias("raw_magnitude"), F.col("p_brand").alias("raw_class"), F.col("p_name").alias("oncogenicity"), *rest)
    new = p.select((k + 5).alias("variant_key"), F.when(k % 3 == 0, F.col("p_size")).alias("raw_magnitude"), F.when(k % 4 != 0, F.col("p_type")).alias("raw_class"), F.when(k % 2 == 0, "").otherwise(F.col("p_type")).alias("oncogenicity"), *rest)
    return upsert.upsert(stored, new, ["variant_key"], upsert.VARIANT_RULES).select("variant_key", "raw_magnitude", "raw_class", "oncogenicity")


@query("""WITH o AS (SELECT o_custkey AS sample_id, CAST(o_orderkey AS VARCHAR) AS run, o_orderpriority AS url FROM orders WHERE o_orderstatus <> 'O'), n AS (SELECT o_custkey AS sample_id, CAST(o_orderkey AS VARCHAR) AS run, 'new' AS url FROM orders WHERE o_orderstatus <> 'F')
 SELECT coalesce(n.sample_id, o.sample_id) AS sample_id, coalesce(n.run, o.run) AS run, coalesce(n.url, o.url) AS url FROM o FULL JOIN n ON o.sample_id = n.sample_id AND o.run = n.run""")
def b20_sample_runs(spark, sf):
    rows = t(spark, sf, "orders").select(F.col("o_custkey").alias("sample_id"), F.col("o_orderkey").cast("string").alias("run"), F.col("o_orderpriority").alias("url"), F.lit(None).cast("long").alias("size_bytes"), F.lit(None).cast("string").alias("md5"), "o_orderstatus")
    stored = rows.where("o_orderstatus <> 'O'").drop("o_orderstatus")
    return upsert.run_upsert(stored, rows.where("o_orderstatus <> 'F'").withColumn("url", F.lit("new"))).select("sample_id", "run", "url")


@query("""WITH a AS (SELECT n_name AS feature, CAST(round(sum(c_acctbal) FILTER (c_mktsegment = 'BUILDING'), 2) AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS y FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
 b AS (SELECT n_name AS feature, CAST(count(*) AS DOUBLE) AS z FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) SELECT feature, x AS "T_x", y AS "T_y", z AS "N_z" FROM a JOIN b USING (feature)""")
def b13_paired_matrix(spark, sf):
    n = t(spark, sf, "nation")
    c = t(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    s = t(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    building = F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal"))
    tumor = c.groupBy(F.col("n_name").alias("feature")).agg(F.round(F.sum(building), 2).cast("double").alias("x"), F.count("*").cast("double").alias("y"))
    return tables.paired_matrix(tumor, s.groupBy(F.col("n_name").alias("feature")).agg(F.count("*").cast("double").alias("z")))


# --- views ------------------------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), p AS (SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0)
 SELECT o_orderkey AS paper_id, count(s_name) AS n_linked, coalesce(string_agg(s_suppkey || ':' || s_name, ',' ORDER BY s_suppkey), '') AS linked FROM orders LEFT JOIN (SELECT * FROM l JOIN p ON l_suppkey = s_suppkey) ON o_orderkey = l_orderkey GROUP BY 1""")
def b22_linked(spark, sf):
    papers = t(spark, sf, "orders").select(F.col("o_orderkey").alias("paper_id"))
    pairs = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("dataset_id"))
    s = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("dataset_id"), "s_name", "s_acctbal")
    out = links.with_linked(papers, "paper_id", pairs, s.drop("s_acctbal"), "dataset_id", s.where("s_acctbal > 0"))
    return out.select("paper_id", F.size("linked").cast("long").alias("n_linked"), F.array_join(F.transform("linked", lambda x: F.concat_ws(":", x["dataset_id"].cast("string"), x["s_name"])), ",").alias("linked"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 <> 0 THEN 'p' || s_suppkey END AS pointer, s_suppkey % 3 <> 0 AS has_contract, s_suppkey % 2 = 0 AS access_controlled FROM supplier""")
def b23_contract(spark, sf):
    k = F.col("s_suppkey")
    held = F.concat(F.lit('{"contract": {"matrix_pointer": "p'), k.cast("string"), F.lit('", "secret": 1}, "other": 2}'))
    meta = F.when(k % 3 == 1, held).when(k % 3 == 2, held).when(k % 2 == 0, '{"contract": {}}').otherwise('{"other": 1}')
    rows = t(spark, sf, "supplier").select(k.alias("id"), sinks.contract(meta, F.when(k % 2 == 0, "controlled").otherwise("public")).alias("c"))
    return rows.select("id", F.col("c.contract.matrix_pointer").alias("pointer"), F.col("c.contract").isNotNull().alias("has_contract"), F.col("c.access_controlled").alias("access_controlled"))


@query("""SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 3 = 1""")
def c1h_nested_key(spark, sf):
    k = F.col("s_suppkey")
    meta = F.when(k % 3 == 0, '{"contract": {"a": 1}}').when(k % 6 == 1, '{"contract": {"monogenic_gene_hit": null}}').when(k % 3 == 1, '{"contract": {"monogenic_gene_hit": {"x": 1}}}').otherwise('{"monogenic_gene_hit": 1}')
    return t(spark, sf, "supplier").where(filters.json_has(meta, "$.contract", "monogenic_gene_hit")).select(k.alias("id"))


@query("""SELECT o_orderkey AS paper_id FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) BETWEEN 1996 AND 1999 AND contains(lower(o_orderpriority), 'high') AND o_totalprice >= 1000 AND o_totalprice <= 200000
 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def c2_paper_filters(spark, sf):
    rows = t(spark, sf, "orders").select(F.col("o_orderkey").alias("paper_id"), F.col("o_orderstatus").alias("curation_status"), F.year("o_orderdate").alias("pub_year"), F.col("o_orderpriority").alias("journal"), F.lit("Review").alias("pub_type"), F.col("o_orderstatus").alias("abstract"), F.lit("PMC1").alias("pmc_id"), F.col("o_totalprice").alias("relevance_score"), F.lit(1).alias("ingestion_job"))
    categories = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_returnflag").alias("slug"))
    asked = {"curation_status": "F", "pub_year_min": "1996", "pub_year_max": "1999", "journal": "HIGH", "pub_type": "Review", "has_abstract": "true", "free_full_text": "true", "relevance_min": 1000, "relevance_max": "200000", "ingestion_job": 1, "clinical_category": "R"}
    return filters.paper_filters(rows, asked, categories).select("paper_id")


@query("""SELECT c_custkey AS id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND contains(lower(c_name), '#0') AND contains(lower(c_name), '1')""")
def c3_sample_filters(spark, sf):
    rows = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("curation_status"), F.col("c_name").alias("organism"), F.col("c_name").alias("platform"))
    return filters.sample_filters(rows, {"curation_status": ["BUILDING", "MACHINERY"], "organism": "#0", "platform": "1"}).select("id")


@query("""WITH e AS (SELECT l_linenumber AS pathway_id, l_partkey AS source, l_suppkey AS target FROM lineitem), n AS (SELECT p_partkey AS id FROM part WHERE p_size > 10)
 SELECT CAST(pathway_id AS BIGINT) AS pathway_id, count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) AS n_edges, count(*) FILTER (a.id IS NULL OR b.id IS NULL) AS n_dropped FROM e LEFT JOIN n a ON a.id = source LEFT JOIN n b ON b.id = target GROUP BY 1""")
def d22_edge_counts(spark, sf):
    e = t(spark, sf, "lineitem").select(F.col("l_linenumber").cast("long").alias("pathway_id"), F.col("l_partkey").cast("long").alias("source"), F.col("l_suppkey").cast("long").alias("target"))
    known = t(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").cast("long").alias("entry_id"), F.col("p_partkey").alias("node_id"))
    ends = e.select("pathway_id", F.col("source").alias("entry_id")).union(e.select("pathway_id", "target")).distinct()
    nodes = ends.join(known, "entry_id")
    return links.edge_counts(links.resolved_edges(e, nodes))


_PAPERS = "p AS (SELECT o_orderkey AS paper_id, o_orderpriority AS project FROM orders WHERE o_orderstatus = 'F')"


@query(f"""WITH {_PAPERS}, c AS (SELECT project, n_name AS country, count(*) AS n FROM p JOIN lineitem ON l_orderkey = paper_id JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE l_linenumber = 1 AND n_name <> 'NATION_5' GROUP BY 1, 2)
 SELECT project, country, n FROM c QUALIFY row_number() OVER (PARTITION BY project ORDER BY n DESC, country) <= 5""")
def e8_countries(spark, sf):
    papers = t(spark, sf, "orders").select(F.col("o_orderkey").alias("paper_id"), F.col("o_orderpriority").alias("project"), (F.col("o_orderstatus") == "F").alias("included"))
    of = t(spark, sf, "supplier").join(t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.when(F.col("n_name") == "NATION_5", "").otherwise(F.col("n_name")).alias("country"))
    authors = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("position"), "l_suppkey").join(of, "l_suppkey")
    return stats.first_author_countries(authors, papers, "project", 5).select("project", "country", "n")


@query(f"""WITH {_PAPERS}, c AS (SELECT DISTINCT l_orderkey AS paper_id, l_returnflag AS category FROM lineitem) SELECT project, category, count(*) AS n FROM p JOIN c USING (paper_id) GROUP BY 1, 2""")
def e8_categories(spark, sf):
    papers = t(spark, sf, "orders").select(F.col("o_orderkey").alias("paper_id"), F.col("o_orderpriority").alias("project"), (F.col("o_orderstatus") == "F").alias("included"))
    return stats.category_counts(t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_returnflag").alias("category")).distinct(), papers, "project")


@query("""SELECT c_nationkey AS axis, count(*) AS n, round(avg(CAST(c_acctbal AS DOUBLE)), 6) AS mean_score FROM customer GROUP BY 1""")
def e27_run_summary(spark, sf):
    return curation.summary(t(spark, sf, "customer").select(F.col("c_nationkey").alias("axis"), F.col("c_acctbal").cast("double").alias("score")), "axis")


@query("""SELECT o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 40""")
def g4_newest(spark, sf):
    """The first page of the newest papers: the limit is the feature."""
    return stats.newest_first(t(spark, sf, "orders"), "o_orderdate", "o_orderkey").limit(40).select("o_orderkey", "o_orderdate")


@query("""SELECT l_partkey, n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, l_partkey) AS r FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)) WHERE r <= 15""")
def g5_report_slice(spark, sf):
    """The top of a report: the limit is the feature."""
    return stats.report_slice(t(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")), 15, F.desc("n"), F.asc("l_partkey"))


@query("""SELECT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0""")
def h3_scope(spark, sf):
    return links.scope(t(spark, sf, "orders").select(F.col("o_custkey").alias("id")), t(spark, sf, "customer").where("c_acctbal < 0").select("c_custkey"))


# --- classifiers ------------------------------------------------------------------------------------------------------


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN 'processed' WHEN 1 THEN 'raw' WHEN 2 THEN 'unknown' WHEN 3 THEN 'raw' WHEN 4 THEN 'unknown' ELSE 'unknown' END AS data_format FROM supplier""")
def i12_data_format(spark, sf):
    k = F.col("s_suppkey") % 6
    files = F.when(k == 0, F.array(F.lit("fastq"), F.lit("cel"))).when(k == 1, F.array(F.lit("sra"))).when(k == 2, F.array(F.lit("readme"))).when(k == 5, F.array(F.lit("cel"))).otherwise(F.lit(None))
    found = classify.data_format(F.when(k == 3, "raw").otherwise("unknown"), F.when(k == 5, "pride_archive").otherwise("geo"), files)
    return t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), found.alias("data_format"))


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 8 WHEN 0 THEN 'public' WHEN 1 THEN 'public' WHEN 2 THEN 'controlled' WHEN 3 THEN 'controlled' WHEN 4 THEN 'unknown' WHEN 5 THEN 'unknown' WHEN 6 THEN 'restricted' ELSE 'controlled' END AS access_type FROM supplier""")
def i13_access_type(spark, sf):
    k = F.col("s_suppkey") % 8
    source = F.when(k == 0, "geo").when(k == 1, "arrayexpress").when(k == 5, "gwas_catalog").when(k == 6, "geo").otherwise("sra")
    found = classify.access_type(F.when(k == 6, "restricted").otherwise("unknown"), source, F.when(k == 2, "PHS000001").otherwise("SRP1"), F.when(k == 3, '{"note": "dbGaP study"}').when(k == 7, "Controlled Access").otherwise("{}"))
    return t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), found.alias("access_type"))


@query("""SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents""")
def i26_hashes(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5(F.col("text").cast("binary")).alias("md5"))


@query("""WITH s AS (SELECT c_nationkey, stddev_samp(CAST(c_acctbal AS DOUBLE)) AS sd FROM customer GROUP BY 1) SELECT c_custkey AS id, round(CAST(c_acctbal AS DOUBLE) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 9) AS scaled FROM customer JOIN s USING (c_nationkey)""")
def i27_scaled(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", "c_nationkey", F.col("c_acctbal").cast("double").alias("x"))
    sd = c.groupBy("c_nationkey").agg(F.stddev_samp("x").alias("sd"))
    return c.join(sd, "c_nationkey").select(F.col("c_custkey").alias("id"), F.round(matrices.scaled(F.col("x"), F.col("sd")), 9).alias("scaled"))
