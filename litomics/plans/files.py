"""File sources and sinks: each query writes one of the driver's tables as a file of the format and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matrices
from ..session import scratch
from ..sources import block_gzip, matrix_files, tables
from .relational import query, t


@query("""SELECT l_linenumber || ':' || l_orderkey || ':A:G' AS variant_key, l_returnflag || l_linestatus AS gene_symbol, CASE WHEN l_quantity > 25 THEN 'Pathogenic' ELSE '' END AS clinvar_significance, count(*) AS n
 FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL""")
def a17_block_gzip(spark, sf):
    line = t(spark, sf, "lineitem")
    info = F.concat(F.lit("GENEINFO="), "l_returnflag", "l_linestatus", F.lit(":1|OTHER:2"), F.when(F.col("l_quantity") > 25, ";CLNSIG=Pathogenic").otherwise(""))
    value = F.concat_ws("\t", F.concat(F.lit("chr"), F.col("l_linenumber").cast("string")), F.col("l_orderkey").cast("string"), F.lit("."), F.lit("A"), F.when(F.col("l_returnflag") == "A", "G,T").otherwise("G"), F.lit("."), F.lit("."), info)
    path = scratch(spark, "blocks.gz")
    block_gzip.write_lines(line.select(value.alias("value")), path)
    return tables.clinvar(spark, path).groupBy("variant_key", "gene_symbol", "clinvar_significance").agg(F.count("*").alias("n"))


def _reports(key: str) -> str:
    """The SQL of a run report's files, by the report's key."""
    return f"""WITH l AS (SELECT '{key}' || user_id AS run, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
 SELECT run || '_' || i AS accession, run, 'https://host/f' || event_id AS url, 'ab' || event_id AS md5, CASE WHEN event_id % 5 > 0 THEN event_id END AS size_bytes FROM l"""


def _report(spark, sf):
    """A run report: for each user the lists of files, digests and sizes of all events."""
    lists = lambda text: F.array_join(F.transform("e", lambda x: text(x.cast("string"), x)), ";")
    e = t(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("e"))
    rows = e.select(
        F.concat(F.lit("ERX"), F.col("user_id").cast("string")).alias("experiment_accession"), F.concat(F.lit("ERR"), F.col("user_id").cast("string")).alias("run_accession"), lists(lambda s, x: F.concat(F.lit("ftp://host/f"), s)).alias("fastq_ftp"),
        lists(lambda s, x: F.concat(F.lit("AB"), s)).alias("fastq_md5"), lists(lambda s, x: F.when(x % 5 > 0, s).otherwise("")).alias("fastq_bytes"),
    )
    path = scratch(spark, "report")
    rows.write.option("header", True).option("sep", "\t").csv(path)
    return path


@query(_reports("ERR"))
def a12_run_files(spark, sf):
    return tables.run_files(spark, _report(spark, sf))


@query(_reports("ERX"))
def a13_experiment_files(spark, sf):
    return tables.run_files(spark, _report(spark, sf), key="experiment_accession")


def _in_order(spark, sf, path, columns, sep):
    """Orders by key, as a text table of several files."""
    rows = t(spark, sf, "orders").repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").select(*columns)
    rows.write.option("header", True).option("sep", sep).option("emptyValue", "").csv(path)
    return path


@query("""SELECT feature, arg_max(a, k) AS a, arg_max(b, k) AS b FROM (SELECT o_orderkey AS k, 'G' || (o_custkey % 60) AS feature, CAST(o_totalprice AS FLOAT) AS a, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE CAST(o_custkey AS FLOAT) END AS b FROM orders) GROUP BY 1""")
def a14_last_rows(spark, sf):
    feature = F.concat(F.lit("G"), (F.col("o_custkey") % 60).cast("string"))
    b = F.when(F.col("o_orderkey") % 3 == 0, "-1").otherwise(F.col("o_custkey").cast("string"))
    path = _in_order(spark, sf, scratch(spark, "matrix"), [feature.alias("gene"), F.col("o_totalprice").alias("a"), b.alias("b")], "\t")
    return tables.last_of_feature(tables.matrix(spark, path)).select("feature", "v.a", "v.b")


@query("""SELECT feature, row_number() OVER (ORDER BY k) - 1 AS row_index, CASE WHEN k % 5 > 0 THEN CAST(o_totalprice AS FLOAT) END AS a FROM (SELECT o_orderkey AS k, o_orderpriority AS feature, o_totalprice FROM orders)""")
def a15_rows_in_order(spark, sf):
    a = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice").cast("string")).otherwise("NA")
    return tables.matrix(spark, _in_order(spark, sf, scratch(spark, "copies"), [F.col("o_orderpriority").alias("gene"), a.alias("a")], "\t")).select("feature", "row_index", "a")


@query("""WITH r AS (SELECT o_orderkey AS k, upper('g' || (o_custkey % 40)) AS gene_symbol, o_orderpriority AS disease, CASE WHEN o_orderkey % 2 = 0 THEN 'HGNC:' || o_orderkey ELSE '' END AS hgnc_id, CASE o_orderstatus WHEN 'F' THEN 'Strong' WHEN 'O' THEN 'limited' ELSE 'odd' END AS raw FROM orders)
 SELECT disease, gene_symbol, hgnc_id, CASE raw WHEN 'Strong' THEN 'strong' WHEN 'limited' THEN 'limited' ELSE 'unknown' END AS confidence, raw AS confidence_raw FROM r QUALIFY row_number() OVER (PARTITION BY disease, gene_symbol ORDER BY k) = 1""")
def a24_gene_disease(spark, sf):
    confidence = F.when(F.col("o_orderstatus") == "F", "Strong").when(F.col("o_orderstatus") == "O", "limited").otherwise("odd")
    hgnc = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("HGNC:"), F.col("o_orderkey").cast("string"))).when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).otherwise("")
    columns = [F.concat(F.lit(" g"), (F.col("o_custkey") % 40).cast("string")).alias("Gene symbol"), F.col("o_orderpriority").alias("disease name"), hgnc.alias("HGNC ID"), confidence.alias("Confidence")]
    return tables.gene_disease(spark, _in_order(spark, sf, scratch(spark, "genes"), columns, ","), raw_too=True)


def _quantities(spark, sf):
    """feature, sample, value: summed quantities of each part on each line number, of parts and line numbers that occur."""
    line = t(spark, sf, "lineitem")
    return line.groupBy(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("feature"), F.concat(F.lit("T_"), F.col("l_linenumber").cast("string")).alias("sample")).agg(F.sum("l_quantity").alias("value"))


SAMPLES = [f"T_{k}" for k in range(1, 9)]
_QUANTITIES = "q AS (SELECT 'P' || l_partkey AS feature, CAST(l_linenumber AS VARCHAR) AS case_id, CAST(sum(l_quantity) AS FLOAT) AS value FROM lineitem GROUP BY ALL)"


@query(f"WITH {_QUANTITIES} SELECT feature, case_id, value, true AS same_digest FROM q")
def b13_matrix_round_trip(spark, sf):
    """The same matrix from one task and from eight has one digest."""
    matrix = matrix_files.wide(_quantities(spark, sf), SAMPLES)
    paths = [scratch(spark, "matrix") for _ in range(2)]
    for path, n in zip(paths, (1, 8), strict=True):
        matrix_files.write_matrix(matrix.repartition(n), path, group_bytes=1 << (14 + n))
    same = matrix_files.digest(spark, paths[0]) == matrix_files.digest(spark, paths[1])
    return matrices.melt(matrix_files.read_matrix(spark, paths[1])).where("value is not null").select("feature", "case_id", "value", F.lit(same).alias("same_digest"))


@query(f"""WITH {_QUANTITIES}, f AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS row_index FROM (SELECT DISTINCT feature FROM q))
 SELECT feature, row_index, case_id, value FROM f JOIN q USING (feature) WHERE row_index IN (SELECT s_suppkey * 3 FROM supplier)""")
def a25_matrix_rows(spark, sf):
    """The rows that suppliers point at."""
    path = scratch(spark, "matrix")
    matrix_files.write_matrix(matrix_files.wide(_quantities(spark, sf), SAMPLES), path, group_bytes=1 << 14)
    rows = matrix_files.rows_at(spark, path, t(spark, sf, "supplier").select((F.col("s_suppkey") * 3).alias("row_index")))
    return rows.unpivot(["feature", "row_index"], SAMPLES, "column", "value").where("value is not null").select("feature", "row_index", F.regexp_replace("column", "^T_", "").alias("case_id"), "value")


BURDEN_SAMPLES = ("RF", "AF", "NO", "NF", "none")


@query("""WITH o AS (SELECT p_brand AS gene, l_returnflag || l_linestatus AS sample, l_suppkey AS v FROM lineitem JOIN part ON l_partkey = p_partkey)
 SELECT gene AS feature, CAST(nullif(count(DISTINCT v) FILTER (sample = 'AF'), 0) AS FLOAT) AS "AF", CAST(nullif(count(DISTINCT v) FILTER (sample = 'NF'), 0) AS FLOAT) AS "NF", CAST(nullif(count(DISTINCT v) FILTER (sample = 'NO'), 0) AS FLOAT) AS "NO",
 CAST(nullif(count(DISTINCT v) FILTER (sample = 'RF'), 0) AS FLOAT) AS "RF", CAST(NULL AS FLOAT) AS "none" FROM o GROUP BY 1""")
def e16_burden_matrix(spark, sf):
    line, part = t(spark, sf, "lineitem"), t(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("gene"))
    occurrences = line.join(part, "l_partkey").select("gene", F.concat("l_returnflag", "l_linestatus").alias("sample"), F.col("l_suppkey").alias("variant_key"))
    path = scratch(spark, "burden")
    matrix_files.write_matrix(matrix_files.burden_matrix(matrices.burden(occurrences), list(BURDEN_SAMPLES)), path)
    return matrix_files.read_matrix(spark, path)
