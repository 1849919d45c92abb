"""Exports, identifiers and checks bound to the driver's tables, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import genomics, ids, text
from ..sources import sinks
from .relational import edges, query, t, EDGES  # noqa: F401


@query("""WITH g AS (SELECT l_orderkey AS k, to_json(list({'part': l_partkey, 'n': CAST(l_quantity AS BIGINT)} ORDER BY l_partkey, CAST(l_quantity AS BIGINT))) AS j FROM lineitem GROUP BY 1)
 SELECT o_orderkey AS paper_id, md5('{"paper_id":' || o_orderkey || ',"status":"' || o_orderstatus || '","genes":' || coalesce(j, '[]') || '}') AS digest FROM orders LEFT JOIN g ON k = o_orderkey""")
def b15_nested_export(spark, sf):
    papers = t(spark, sf, "orders").select(F.col("o_orderkey").alias("paper_id"), F.col("o_orderstatus").alias("status"))
    genes = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("long").alias("n"))
    return sinks.nested(papers, "paper_id", genes=genes).select("paper_id", F.md5(F.col("doc").cast("binary")).alias("digest"))


@query("""SELECT o_orderkey AS paper_id, o_orderstatus AS status, coalesce((SELECT string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) FROM lineitem WHERE l_orderkey = o_orderkey), '') AS category FROM orders""")
def b16_flat_export(spark, sf):
    papers = t(spark, sf, "orders").select(F.col("o_orderkey").alias("paper_id"), F.col("o_orderstatus").alias("status"))
    return sinks.flat(papers, "paper_id", t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_returnflag").alias("category")), "category")


@query("""WITH u AS (SELECT user_id, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS layers, count(*) AS n, count(*) FILTER (event_type = 'view') AS v FROM events GROUP BY 1)
 SELECT CAST(user_id AS VARCHAR) AS accession, layers, 'total=' || n || ';views=' || v AS extra, CAST(n AS VARCHAR) AS n FROM u""")
def b17_dataset_export(spark, sf):
    views = F.count_if(F.col("event_type") == "view")
    u = t(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("accession")).agg(F.array_sort(F.collect_set("event_type")).alias("layers"), F.create_map(F.lit("views"), views, F.lit("total"), F.count("*")).alias("extra"), F.count("*").alias("n"))
    return sinks.export_rows(u, ["accession", "layers", "extra", "n"])


@query("""WITH d AS (SELECT p_type AS axis, p_brand AS access, p_size > 25 AS k FROM part) SELECT 'total' AS what, '' AS value, count(*) AS n FROM d UNION ALL SELECT 'axis', axis, count(*) FROM d GROUP BY axis UNION ALL SELECT 'access', access, count(*) FROM d GROUP BY access UNION ALL SELECT 'keys', '', count(*) FROM d WHERE k""")
def b18_provenance(spark, sf):
    d = t(spark, sf, "part").select(F.col("p_type").alias("axis"), F.col("p_brand").alias("access"), F.when(F.col("p_size") > 25, F.array("p_name")).otherwise(F.array().cast("array<string>")).alias("keys"))
    return sinks.provenance(d, "axis", "access", "keys")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 3 WHEN 0 THEN 'C' || l_partkey WHEN 1 THEN 'S' || l_partkey ELSE 'X' || l_partkey END AS case_id FROM lineitem""")
def i22_case_ids(spark, sf):
    k, p = F.col("l_linenumber") % 3, F.col("l_partkey").cast("string")
    marks = F.when(k == 0, F.create_map(F.lit("case_id"), F.concat(F.lit(" C"), p))).otherwise(F.create_map(F.lit("tissue"), F.lit("x")))
    accession = F.when(k == 1, F.concat(F.lit("S"), p, F.lit("-T1"))).otherwise(F.concat(F.lit("X"), p))
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", genomics.case_id(marks, accession).alias("case_id"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) END AS pmid, CASE WHEN p_partkey % 3 = 0 THEN '10.1234/ab.' || p_partkey END AS doi, CASE WHEN p_partkey % 5 = 0 THEN 'PRJNA' || p_partkey END AS bioproject FROM part""")
def i24_ids(spark, sf):
    k = F.col("p_partkey")
    p = t(spark, sf, "part").select(k, F.when(k % 2 == 0, F.concat(F.lit(" PMID:"), k)).otherwise("no id").alias("a"), F.when(k % 3 == 0, F.concat(F.lit("DOI: 10.1234/AB."), k)).otherwise("11.1/x").alias("b"), F.when(k % 5 == 0, F.concat(F.lit("see prjna"), k, F.lit("."))).alias("c"))
    return p.select("p_partkey", text.pmid(F.col("a")).alias("pmid"), text.doi(F.col("b")).alias("doi"), text.bioproject(F.col("c")).alias("bioproject"))


@query("""SELECT page_id, 'https://' || regexp_replace(url, '^https?://', '') AS secure, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS name, 'https://ftp.ncbi.nlm.nih.gov/geo/series/' || CASE WHEN page_id + 1 > 999 THEN 'GSE' || CAST(floor((page_id + 1) / 1000) AS BIGINT) || 'nnn' ELSE 'GSEnnn' END || '/GSE' || (page_id + 1) || '/suppl/' AS suppl FROM pages""")
def i25_links(spark, sf):
    accession = ids.series((F.col("page_id") + 1).cast("string"))
    return t(spark, sf, "pages").select("page_id", ids.secure(F.col("url")).alias("secure"), ids.file_name(F.col("url")).alias("name"), ids.supplementary_url(accession).alias("suppl"))


@query("""SELECT event_id, 'SRX' || user_id || ',ERX' || event_id AS experiments FROM events""")
def a13a_experiments(spark, sf):
    relation = F.concat(F.lit("see SRX"), F.col("user_id"), F.lit("; ERX"), F.col("event_id"), F.lit(" and SRX"), F.col("user_id"))
    return t(spark, sf, "events").select("event_id", F.array_join(ids.relation_experiments(relation), ",").alias("experiments"))


@query(f"""WITH {EDGES} SELECT DISTINCT n_name AS tf FROM edges JOIN nation ON source = n_nationkey WHERE sign <> 0""")
def e33_factors(spark, sf):
    names = t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("source"), F.col("n_name").alias("tf"))
    return edges(spark, sf).where("sign <> 0").select("source").distinct().join(names, "source").select("tf").distinct().orderBy("tf")


@query("""SELECT count(*) FILTER (event_type = 'click') AS n_mixed, count(*) FILTER (event_type NOT IN ('click', 'purchase') AND CAST(props->>'$.k' AS INT) > 90) AS n_discordance FROM events""")
def e28_queue_counts(spark, sf):
    hits = F.get_json_object("props", "$.k").cast("int") > 90
    return t(spark, sf, "events").agg(F.count_if(F.col("event_type") == "click").alias("n_mixed"), F.count_if(~F.col("event_type").isin("click", "purchase") & hits).alias("n_discordance"))


@query("""SELECT (SELECT count(*) FROM part) AS n_expected, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS n_found, (SELECT count(*) FROM part) = (SELECT count(DISTINCT l_partkey) FROM lineitem) AS equal""")
def e31_catalogue_check(spark, sf):
    found = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"), F.lit(False).alias("expected")).distinct()
    both = found.union(t(spark, sf, "part").select("p_partkey", F.lit(True)))
    counts = both.agg(F.count_if("expected").alias("n_expected"), F.count_if(~F.col("expected")).alias("n_found"))
    return counts.withColumn("equal", F.col("n_expected") == F.col("n_found"))


@query("""SELECT CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS estimated_bytes FROM lineitem WHERE l_returnflag = 'R'""")
def e32_estimated_bytes(spark, sf):
    return t(spark, sf, "lineitem").where("l_returnflag = 'R'").agg(F.coalesce(F.sum(F.col("l_quantity").cast("long")), F.lit(0)).alias("estimated_bytes"))
