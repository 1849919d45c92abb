"""Readers of public formats, over files that each query writes from one of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import disease, topology
from ..session import scratch
from ..sources import archives, documents, sinks, tables
from .relational import query, t


#: Records of an XML document that a query writes; every file costs the driver a listing, a folder and a rename, so documents are of some MB.
XML_RECORDS = 20_000


def _text(rows: DataFrame, *parts: str | Column) -> str:
    """Rows as a text file, each the parts one after the other: texts as they stand, columns as text."""
    path = scratch(rows.sparkSession, "lines")
    value = F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    rows.select(value.alias("value")).write.text(path)
    return path


def _xml(rows: DataFrame, order: str, *parts: str | Column) -> str:
    """Rows as XML documents of XML_RECORDS records, in order of a number, one document a file; the files' names keep the order. Records are written one by one, so that no document is held whole."""
    path = scratch(rows.sparkSession, "xml")
    value = F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    each = rows.withColumn("_chunk", F.lpad(F.floor(F.col(order) / XML_RECORDS).cast("string"), 12, "0")).withColumn("_tie", F.xxhash64(value))
    in_order = Window.partitionBy("_chunk").orderBy(order, "_tie")
    ends = each.withColumn("_head", F.lag(F.lit("")).over(in_order)).withColumn("_foot", F.lead(F.lit("")).over(in_order))
    text = F.concat(F.coalesce("_head", F.lit("<Set>")), value, F.coalesce("_foot", F.lit("</Set>")))
    ends.sortWithinPartitions("_chunk", order, "_tie").select(F.col("_chunk").alias("chunk"), text.alias("value")).write.partitionBy("chunk").text(path)
    return path


def _table(rows: DataFrame) -> str:
    path = scratch(rows.sparkSession, "table")
    rows.write.option("header", True).option("sep", "\t").option("emptyValue", "").csv(path)
    return path


@query("""SELECT p_partkey AS pmid, p_name AS title, 'J ' || p_brand AS journal, CAST(1960 + p_size AS INTEGER) AS year, CASE p_size % 3 WHEN 0 THEN 3 WHEN 1 THEN 11 END AS month, 'AIM: of ' || p_type || ' and more' AS abstract,
 CASE WHEN p_size % 2 = 0 THEN 'Review' ELSE 'Journal Article' END AS pub_type, CASE p_size % 4 WHEN 0 THEN 'Brazil' WHEN 1 THEN 'United States' WHEN 2 THEN '' ELSE 'UK' END AS country, '10.1/' || p_partkey AS doi, p_type AS descriptor, p_size > 25 AS is_major, 'k' || p_brand AS keyword FROM part""")
def a1_articles(spark, sf):
    s, c = F.col("p_size"), F.col
    month = F.when(s % 3 == 0, "Mar").when(s % 3 == 1, "11").otherwise("x")
    land = F.when(s % 4 == 0, "Brazil").when(s % 4 == 1, "United States").when(s % 4 == 2, "Nowhere").otherwise("UK")
    path = _xml(
        t(spark, sf, "part"), "p_partkey", '<PubmedArticle><MedlineCitation><PMID Version="1">', c("p_partkey"), "</PMID><Article><Journal><Title>J ", c("p_brand"), "</Title><JournalIssue><PubDate><Year>", s + 1960, "</Year><Month>", month,
        "</Month></PubDate></JournalIssue></Journal><ArticleTitle>", c("p_name"), '</ArticleTitle><Abstract><AbstractText Label="AIM">of ', c("p_type"), '</AbstractText><AbstractText Label="">and more</AbstractText></Abstract><AuthorList><Author><LastName>L</LastName><Initials>I</Initials>'
        "<AffiliationInfo><Affiliation>Dept, City, ", land, '</Affiliation></AffiliationInfo></Author></AuthorList><PublicationTypeList><PublicationType UI="a">Journal Article</PublicationType>', F.when(s % 2 == 0, '<PublicationType UI="b">Review</PublicationType>'),
        '</PublicationTypeList></Article><KeywordList><Keyword MajorTopicYN="N">k', c("p_brand"), '</Keyword></KeywordList><MeshHeadingList><MeshHeading><DescriptorName MajorTopicYN="', F.when(s > 25, "Y").otherwise("N"), '">', c("p_type"),
        '</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="pubmed">1</ArticleId><ArticleId IdType="doi">10.1/', c("p_partkey"), "</ArticleId></ArticleIdList></PubmedData></PubmedArticle>",
    )
    rows = documents.articles(spark, path)
    head = F.col("mesh")[0]
    return rows.select("pmid", "title", "journal", "year", "month", "abstract", "pub_type", "country", "doi", head["descriptor"].alias("descriptor"), head["is_major"].alias("is_major"), F.col("keywords")[0].alias("keyword"))


@query("""SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'PRJNA' || s_suppkey ELSE 'GSE' || s_suppkey END AS accession, s_name AS title, s_suppkey * 2 AS n_samples, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_nationkey AS INTEGER) END AS tax_id, s_suppkey + 100 AS pmid FROM supplier""")
def a3_series_datasets(spark, sf):
    k = F.col("s_suppkey")
    entry = F.struct(
        F.col("s_name").alias("title"), F.concat(F.lit("GSE"), k.cast("string"), F.lit(";GSE0")).alias("accession"), (k * 2).alias("n_samples"), F.when(k % 2 == 0, F.col("s_nationkey").cast("string")).otherwise("many").alias("taxon"),
        F.when(k % 3 == 0, F.concat(F.lit("PRJNA"), k.cast("string"), F.lit(";x"))).otherwise("").alias("bioproject"), F.array((k + 100).cast("string"), F.lit("none")).alias("pubmed_ids"),
    )
    # 25 entries a file, as the service gives them
    batch = F.floor(k / 25).alias("batch")
    files = t(spark, sf, "supplier").select(batch, k.cast("string").alias("uid"), F.to_json(entry).alias("entry")).groupBy("batch").agg(F.concat_ws(",", F.collect_list(F.concat(F.lit('"'), "uid", F.lit('":'), "entry"))).alias("e"))
    path = scratch(spark, "summaries")
    files.select("batch", F.concat(F.lit('{"result": {"uids": ["1"],'), "e", F.lit("}}")).alias("value")).repartition("batch").write.partitionBy("batch").text(path)
    rows, links = archives.series_datasets(spark, path)
    return rows.select("accession", "title", F.col("n_samples").cast("long").alias("n_samples"), "tax_id").join(links, "accession")


@query("""SELECT 'GSM' || c_custkey AS accession, c_name AS title, c_mktsegment AS organism, CAST(c_nationkey AS VARCHAR) AS nation, 'plain ' || c_custkey AS second FROM customer""")
def a9_soft_samples(spark, sf):
    c = F.col
    path = _text(t(spark, sf, "customer"), "^SAMPLE = GSM", c("c_custkey"), "\n!Sample_title = ", c("c_name"), "\n!Sample_organism_ch1 = ", c("c_mktsegment"), "\n!Sample_characteristics_ch1 = nation: ", c("c_nationkey"), "\n!Sample_characteristics_ch1 = plain ", c("c_custkey"))
    return documents.soft_samples(spark, path).select("accession", "title", "organism", c("characteristics")["nation"].alias("nation"), c("characteristics")["characteristic_2"].alias("second"))


@query("""SELECT 'S' || o_custkey AS accession, arg_min(o_orderpriority, o_orderkey) AS title, CAST(arg_min(o_orderkey, o_orderkey) % 1000 AS INTEGER) AS tax_id, 'last ' || min(o_orderkey) AS tissue FROM orders GROUP BY o_custkey""")
def a10_sequence_samples(spark, sf):
    """Customers' first orders: of a repeated accession the first in the file counts, of a repeated tag the last."""
    k = F.col("o_orderkey")
    path = _xml(
        t(spark, sf, "orders"), "o_orderkey", '<SAMPLE accession="S', F.col("o_custkey"), '"><TITLE>', F.col("o_orderpriority"), "</TITLE><SAMPLE_NAME><TAXON_ID>", k % 1000, "</TAXON_ID><SCIENTIFIC_NAME>h</SCIENTIFIC_NAME></SAMPLE_NAME><SAMPLE_ATTRIBUTES><SAMPLE_ATTRIBUTE><TAG>Tissue</TAG><VALUE>first</VALUE></SAMPLE_ATTRIBUTE>"
        "<SAMPLE_ATTRIBUTE><TAG>tissue</TAG><VALUE>last ", k, "</VALUE></SAMPLE_ATTRIBUTE></SAMPLE_ATTRIBUTES></SAMPLE>",
    )
    return archives.sequence_samples(spark, path).select("accession", "title", "tax_id", F.col("characteristics")["tissue"].alias("tissue"))


@query("""SELECT s_name || ' ' || s_suppkey || '.txt.gz' AS name FROM supplier""")
def a11_listing(spark, sf):
    k = F.col("s_suppkey")
    return documents.listing(spark, _text(t(spark, sf, "supplier"), '<a href="../">up</a><a href="', F.regexp_replace("s_name", "#", "%23"), "%20", k, '.txt.gz">file</a><a href="?C=M;O=A">sort</a> <a href="dir', k, '/">dir</a>'))


@query("""SELECT 'G' || p_partkey AS gene_symbol, p_partkey AS entrez_id, CASE p_size % 5 WHEN 0 THEN 'oncogene' WHEN 1 THEN 'tsg' WHEN 2 THEN 'oncogene_and_tsg' WHEN 3 THEN 'neither' ELSE 'unknown' END AS role, p_size > 25 AS is_census, p_size % 2 = 0 AS is_vogelstein, 'v1' AS source_version FROM part""")
def a16_gene_roles(spark, sf):
    s = F.col("p_size")
    kind = F.when(s % 5 == 0, "ONCOGENE").when(s % 5 == 1, "tsg").when(s % 5 == 2, "ONCOGENE_AND_TSG").when(s % 5 == 3, "NEITHER").otherwise("")
    rows = t(spark, sf, "part").select(F.lit("x").alias("Extra"), kind.alias("Gene Type"), F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("Hugo Symbol"), F.col("p_partkey").alias("Entrez Gene ID"), F.when(s > 25, "Yes").otherwise("No").alias("COSMIC CGC (v99)"), F.when(s % 2 == 0, "yes").otherwise("").alias("Vogelstein"))
    return tables.gene_roles(spark, _table(rows), "v1")


@query("""SELECT l_linenumber || ':' || l_orderkey || ':A:T' AS variant_key, upper(p_brand) AS gene_symbol, CAST(l_quantity / 50 AS DOUBLE) AS raw_magnitude, l_returnflag AS raw_class FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity <> 7""")
def a18_alphamissense(spark, sf):
    line, c = t(spark, sf, "lineitem"), F.col
    score = F.when(c("l_quantity") == 7, "x").otherwise((c("l_quantity") / 50).cast("string"))
    value = F.concat_ws("\t", F.concat(F.lit("chr"), c("l_linenumber").cast("string")), c("l_orderkey").cast("string"), F.lit("A"), F.lit("T"), F.lit("hg38"), F.concat(F.lit("P"), c("l_partkey").cast("string")), F.lit("t"), F.lit("v"), score, c("l_returnflag"))
    head = spark.range(1).select(F.explode(F.array(F.lit("# Copyright"), F.lit("#CHROM\tPOS\tREF\tALT\tgenome\tuniprot_id\ttranscript_id\tprotein_variant\tam_pathogenicity\tam_class"))).alias("value"))
    path = _text(head.union(line.select(value.alias("value"))), c("value"))
    part = t(spark, sf, "part")
    return tables.alphamissense(spark, path, part.select(F.concat(F.lit("P"), c("p_partkey").cast("string")).alias("uniprot_id"), F.lower("p_brand").alias("gene_symbol")), part.select(c("p_brand").alias("gene_symbol")))


@query("""SELECT 'S1' AS sample, upper(p_brand) AS gene, l_linenumber || ':' || l_orderkey || ':' || CASE WHEN l_quantity > 25 THEN 'A' ELSE '' END || ':T' AS variant_key, CASE WHEN l_linenumber = 1 THEN 'Missense_Mutation' ELSE 'Nonsense_Mutation' END AS classification
 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <> 2 AND p_brand IN (SELECT p_brand FROM part WHERE p_size > 49)""")
def a19_mutations(spark, sf):
    c = F.col
    kind = F.when(c("l_linenumber") == 1, "Missense_Mutation").when(c("l_linenumber") == 2, "Silent").otherwise("Nonsense_Mutation")
    rows = t(spark, sf, "lineitem").join(t(spark, sf, "part").select(c("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").select(
        F.lit("T").alias("Tumor_Seq_Allele2"), F.lower("p_brand").alias("Hugo_Symbol"), F.concat(F.lit("chr"), c("l_linenumber").cast("string")).alias("Chromosome"), c("l_orderkey").alias("Start_Position"), kind.alias("Variant_Classification"), F.when(c("l_quantity") > 25, "A").otherwise("-").alias("Reference_Allele"),
    )
    return tables.mutations(spark, _table(rows), "S1", t(spark, sf, "part").where("p_size > 49").select(c("p_brand").alias("gene_symbol")))


@query("""SELECT 'hsa' || s_nationkey AS pathway_id, CAST(s_suppkey AS VARCHAR) AS source, CAST(s_suppkey + 1 AS VARCHAR) AS target, CASE s_suppkey % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS sign, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE upper('g' || s_suppkey) END AS gene_symbol,
 CASE WHEN s_suppkey % 5 = 0 THEN 'map' WHEN s_suppkey % 5 = 1 THEN 'gene' ELSE 'ortholog' END AS node_type FROM supplier""")
def a20_pathways(spark, sf):
    k = F.col("s_suppkey")
    s = k.cast("string")
    kind = F.when(k % 5 == 0, "map").when(k % 5 == 1, "new kind").otherwise("ortholog")
    sub = F.when(k % 4 == 0, '<subtype name="activation" value="a"/><subtype name="phosphorylation" value="p"/>').when(k % 4 == 1, '<subtype name="repression" value="r"/>').when(k % 4 == 2, '<subtype name="inhibition" value="i"/><subtype name="expression" value="e"/>').otherwise("")
    entry = F.concat(F.lit('<entry id="'), s, F.lit('" name="n" type="'), kind, F.lit('"><graphics name="g'), s, F.lit(', other..."/></entry>'))
    relation = F.concat(F.lit('<relation entry1="'), s, F.lit('" entry2="'), (k + 1).cast("string"), F.lit('" type="PPrel">'), sub, F.lit("</relation>"))
    per = t(spark, sf, "supplier").groupBy("s_nationkey").agg(F.array_join(F.collect_list(entry), "").alias("e"), F.array_join(F.collect_list(relation), "").alias("r"))
    nodes, edges = documents.pathways(spark, _xml(per, "s_nationkey", '<pathway name="path:hsa', F.col("s_nationkey"), '" title="t">', F.col("e"), F.col("r"), "</pathway>"))
    return edges.join(nodes.select("pathway_id", F.col("entry_id").alias("source"), "gene_symbol", "node_type"), ["pathway_id", "source"]).select("pathway_id", "source", "target", "sign", "gene_symbol", "node_type")


@query("""SELECT upper('tf' || o_custkey) AS tf, upper('t' || o_orderkey) AS target, CASE o_orderkey % 4 WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS sign, CAST(o_orderkey % 3 AS INTEGER) AS n_references FROM orders""")
def a21_regulons(spark, sf):
    k = F.col("o_orderkey")
    refs = F.when(k % 3 == 0, "; ").when(k % 3 == 1, "a:1").otherwise("a:1;b:2;")
    rows = t(spark, sf, "orders").select(
        F.concat(F.lit("tf"), F.col("o_custkey").cast("string")).alias("source_genesymbol"), F.concat(F.lit("t"), k.cast("string")).alias("target_genesymbol"), F.when(k % 4 == 1, "True").when(k % 4 == 3, "1").otherwise("0").alias("is_stimulation"), F.when(k % 4 >= 2, "1").otherwise("False").alias("is_inhibition"), refs.alias("references"),
    )
    return tables.regulons(spark, _table(rows))


@query("""SELECT 'Disorder ' || c_custkey AS disease, upper('g' || c_nationkey) AS gene_symbol, CASE WHEN c_custkey % 2 = 0 THEN 'assessed' ELSE 'not_assessed' END AS confidence FROM customer""")
def a22_disorders(spark, sf):
    c = F.col
    path = _xml(
        t(spark, sf, "customer"), "c_custkey", '<Disorder id="', c("c_custkey"), '"><Name lang="en">Disorder ', c("c_custkey"), "</Name><DisorderGeneAssociationList><DisorderGeneAssociation><SourceOfValidation>", F.when(c("c_custkey") % 2 == 0, "1[PMID]").otherwise(""),
        "</SourceOfValidation><Gene><Symbol>g", c("c_nationkey"), "</Symbol></Gene></DisorderGeneAssociation></DisorderGeneAssociationList></Disorder>",
    )
    return documents.disorders(spark, path)


@query("""SELECT DISTINCT p_name AS name FROM part""")
def a23_trait_names(spark, sf):
    return tables.trait_names(spark, _table(t(spark, sf, "part").select(F.col("p_partkey").alias("DATE"), F.concat(F.lit("  "), "p_name").alias("DISEASE/TRAIT"), F.col("p_type").alias("MAPPED"))))


@query("""SELECT 'S' || o_custkey AS sample_accession, CAST(o_orderkey AS VARCHAR) AS variant_key, o_orderpriority AS gene_symbol, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END AS variant_classification FROM orders""")
def b14_occurrences(spark, sf):
    rows = t(spark, sf, "orders").select(F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("sample_accession"), F.col("o_orderkey").cast("string").alias("variant_key"), F.col("o_orderpriority").alias("gene_symbol"), F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus")).alias("variant_classification"))
    path = scratch(spark, "occurrences")
    sinks.write_occurrences(rows, path)
    back = tables.read_tsv(spark, path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in back.columns])


@query("""WITH r AS (SELECT l_suppkey % 3 AS pathway_id, l_partkey AS source, l_linenumber AS target, (l_orderkey, l_linenumber, l_suppkey, l_quantity, l_returnflag, l_linestatus) AS seq, 'r' || l_returnflag AS relation, l_returnflag AS a, l_linestatus AS b FROM lineitem),
 s AS (SELECT pathway_id, source, target, x, min((seq, i)) AS first FROM (SELECT pathway_id, source, target, seq, 0 AS i, a AS x FROM r UNION ALL SELECT pathway_id, source, target, seq, 1, b FROM r) GROUP BY ALL)
 SELECT * FROM (SELECT pathway_id, source, target, arg_min(relation, seq) AS relation, CAST(count(*) - 1 AS INTEGER) AS n_collapsed FROM r GROUP BY ALL) JOIN (SELECT pathway_id, source, target, string_agg(x, ',' ORDER BY first) AS subtypes FROM s GROUP BY ALL) USING (pathway_id, source, target)""")
def e17_merged_edges(spark, sf):
    c = F.col
    e = t(spark, sf, "lineitem").select((c("l_suppkey") % 3).alias("pathway_id"), c("l_partkey").alias("source"), c("l_linenumber").alias("target"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus").alias("seq"), F.concat(F.lit("r"), "l_returnflag").alias("relation"), F.array("l_returnflag", "l_linestatus").alias("subtypes"))
    return topology.merge_edges(e).withColumn("subtypes", F.array_join("subtypes", ","))


@query("""WITH h AS (SELECT DISTINCT o_custkey AS id, o_orderpriority AS p, o_orderstatus AS s FROM orders), n AS (SELECT id, p AS name FROM h UNION SELECT id, p || ' ' || s FROM h UNION SELECT id, s FROM h)
 SELECT id, name FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE a.id = b.id AND length(b.name) > length(a.name) AND contains(b.name, a.name))""")
def i16_longest_hits(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_custkey").alias("id"), "o_orderpriority", "o_orderstatus")
    names = F.array("o_orderpriority", F.concat_ws(" ", "o_orderpriority", "o_orderstatus"), "o_orderstatus")
    return disease.longest_only(o.select("id", F.explode(names).alias("name")).distinct())
