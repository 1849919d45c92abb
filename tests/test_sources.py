import gzip

from pyspark.sql import functions as F

from litomics.operators import topology
from litomics.sources import documents, sinks, tables
from litomics.streaming import mentions


def put(tmp_path, name, text):
    p = tmp_path / name
    if name.endswith(".gz"):
        p.write_bytes(gzip.compress(text.encode()))
    else:
        p.write_text(text)
    return str(p)


def test_matrices(spark, tmp_path):
    a = tables.matrix(spark, put(tmp_path, "t.cct", "gene\tC1\tC2\nTP53\t1.5\tNA\nEGFR\t\t-2\n\t1\t1\nONLY\t.\tnull\n"))
    assert {r["feature"]: (r["C1"], r["C2"]) for r in a.collect()} == {"TP53": (1.5, None), "EGFR": (None, -2.0), "ONLY": (None, None)}
    b = tables.matrix(spark, put(tmp_path, "n.cct", "gene\tC1\nEGFR\t4\nTP53\t2\n"))
    both = tables.paired_matrix(a, b)
    assert both.columns == ["feature", "T_C1", "T_C2", "N_C1"]
    assert [tuple(r) for r in both.collect()] == [("EGFR", None, -2.0, 4.0), ("TP53", 1.5, None, 2.0)]


def test_roles_and_effects(spark, tmp_path):
    roles = tables.gene_roles(spark, put(tmp_path, "g.tsv", "Extra\tHugo Symbol\tGene Type\tEntrez Gene ID\tCOSMIC CGC (v1)\tVogelstein\nx\ttp53\tTSG\t7157\tYes\tno\nx\tNEW\t\t\t\t\n"), "v1")
    assert {tuple(r) for r in roles.collect()} == {("TP53", 7157, "tsg", True, False, "v1"), ("NEW", None, "unknown", False, False, "v1")}
    vcf = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n17\t5\t.\tG\tA\t.\t.\tGENEINFO=TP53:7157|WRAP53:1;CLNSIG=Pathogenic\n17\t6\t.\tG\tA,T\t.\t.\tGENEINFO=TP53:7157\n17\t7\t.\tGC\tG\t.\t.\tFLAG;GENEINFO=EGFR:1;ONC=Oncogenic\n1\t2\t.\tA\tC\t.\t.\tCLNSIG=Benign\n"
    rows = {tuple(r) for r in tables.clinvar(spark, put(tmp_path, "c.vcf.gz", vcf)).collect()}
    assert rows == {("17:5:G:A", "TP53", "Pathogenic", ""), ("17:8:C:", "EGFR", "", "Oncogenic")}
    am = "# preamble\n# more\n#CHROM\tPOS\tREF\tALT\tgenome\tuniprot_id\ttranscript_id\tprotein_variant\tam_pathogenicity\tam_class\nchr1\t5\tA\tT\thg38\tP1\tt\tv\t0.9\tlikely_pathogenic\nchr1\t6\tA\tT\thg38\tP9\tt\tv\t0.1\tbenign\nchr1\t7\tA\tT\thg38\tP1\tt\tv\tx\tbenign\n"
    proteins, genes = spark.createDataFrame([("P1", "tp53")], "uniprot_id string, gene_symbol string"), spark.createDataFrame([("TP53",)], "gene_symbol string")
    assert [tuple(r) for r in tables.alphamissense(spark, put(tmp_path, "am.tsv", am), proteins, genes).collect()] == [("1:5:A:T", "TP53", 0.9, "likely_pathogenic")]
    maf = "#v\nTumor_Seq_Allele2\tHugo_Symbol\tChromosome\tStart_Position\tVariant_Classification\tReference_Allele\nT\tTP53\tchr17\t9\tMissense_Mutation\tC\n-\ttp53\t17\t12\tFrame_Shift_Del\tAG\nT\tTP53\t17\t9\tSilent\tC\nT\tXYZ\t1\t1\tMissense_Mutation\tC\n"
    assert {tuple(r) for r in tables.mutations(spark, put(tmp_path, "m.maf.gz", maf), "S1", genes).collect()} == {("S1", "TP53", "17:9:C:T", "Missense_Mutation"), ("S1", "TP53", "17:12:AG:", "Frame_Shift_Del")}


def test_regulons_and_reports(spark, tmp_path):
    reg = "source_genesymbol\ttarget_genesymbol\tis_stimulation\tis_inhibition\treferences\nMYC\tCDK4\tTrue\tFalse\ta;b;\nmyc\tP21\t0\t1\t\nTP53\tMDM2\t1\t1\tx\n"
    rows = {tuple(r) for r in tables.regulons(spark, put(tmp_path, "r.tsv", reg), spark.createDataFrame([("MYC",)], "symbol string")).collect()}
    assert rows == {("MYC", "CDK4", 1, 2), ("MYC", "P21", -1, 0)}
    ena = "run_accession\tfastq_bytes\tfastq_ftp\tfastq_md5\nR1\t10;20\tftp.x/a_1.gz;ftp.x/a_2.gz\tAB;CD\nR2\t-\t-\t-\n"
    files = {tuple(r) for r in tables.run_files(spark, put(tmp_path, "e.tsv", ena)).collect()}
    assert files == {("R1_1", "R1", "https://ftp.x/a_1.gz", "ab", 10), ("R1_2", "R1", "https://ftp.x/a_2.gz", "cd", 20)}


def test_pubmed(spark, tmp_path):
    xml = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version="1">12</PMID><Article><Journal><JournalIssue><PubDate><Year>2020</Year><Month>Mar</Month></PubDate></JournalIssue><Title>J One</Title></Journal>
<ArticleTitle>A title</ArticleTitle><Abstract><AbstractText Label="AIM">To see.</AbstractText><AbstractText Label="END">Seen.</AbstractText></Abstract><AuthorList><Author><LastName>Doe</LastName><Initials>J</Initials><AffiliationInfo><Affiliation>Dept, Sao Paulo, Brazil.</Affiliation></AffiliationInfo></Author></AuthorList>
<PublicationTypeList><PublicationType UI="x">Journal Article</PublicationType><PublicationType UI="y">Review</PublicationType></PublicationTypeList></Article><MeshHeadingList><MeshHeading><DescriptorName MajorTopicYN="Y">Neoplasms</DescriptorName><QualifierName MajorTopicYN="N">genetics</QualifierName></MeshHeading></MeshHeadingList></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/x</ArticleId><ArticleId IdType="pmc">PMC1</ArticleId></ArticleIdList></PubmedData></PubmedArticle></PubmedArticleSet>"""
    r = documents.articles(spark, put(tmp_path, "p.xml", xml)).first()
    assert (r["pmid"], r["year"], r["month"], r["journal"], r["pub_type"], r["country"], r["doi"], r["pmc_id"]) == (12, 2020, 3, "J One", "Review", "Brazil", "10.1/x", "PMC1")
    assert r["abstract"] == "AIM: To see. END: Seen." and r["mesh"][0]["descriptor"] == "Neoplasms" and r["mesh"][0]["is_major"] and r["mesh"][0]["qualifiers"] == ["genetics"]


def test_pathway_files(spark, tmp_path):
    xml = """<pathway name="path:hsa01" title="T"><entry id="1" name="hsa:1" type="gene"><graphics name="tp53, P53"/></entry><entry id="2" name="x" type="strange"><graphics name="EGFR..."/></entry><entry id="3" name="c" type="compound"><graphics name="C1"/></entry>
<relation entry1="1" entry2="2" type="PPrel"><subtype name="activation" value="--&gt;"/><subtype name="inhibition" value="--|"/></relation><relation entry1="1" entry2="2" type="GErel"><subtype name="expression" value="x"/></relation><relation entry1="2" entry2="3" type="PCrel"/></pathway>"""
    nodes, edges = documents.pathways(spark, put(tmp_path, "k.xml", xml))
    assert {(r["entry_id"], r["node_type"], r["gene_symbol"]) for r in nodes.collect()} == {("1", "gene", "TP53"), ("2", "gene", "EGFR"), ("3", "compound", "")}
    assert sorted((r["seq"], r["sign"]) for r in edges.collect()) == [(0, 0), (1, 1), (2, 0)]
    merged = {(r["source"], r["target"]): (r["relation"], r["subtypes"], r["n_collapsed"]) for r in topology.merge_edges(edges).collect()}
    assert merged[("1", "2")] == ("PPrel", ["activation", "inhibition", "expression"], 1)


def test_soft_and_listing(spark, tmp_path):
    soft = "^SERIES = G\n^SAMPLE = GSM1\n!Sample_title = one\n!Sample_organism_ch1 = Homo sapiens\n!Sample_characteristics_ch1 = tissue: liver\n!Sample_characteristics_ch1 = plain\n^SAMPLE = GSM2\n!Sample_title = two\n"
    rows = {r["accession"]: (r["title"], r["characteristics"]) for r in documents.soft_samples(spark, put(tmp_path, "s.soft", soft)).collect()}
    assert rows == {"GSM1": ("one", {"tissue": "liver", "characteristic_2": "plain"}), "GSM2": ("two", {})}
    html = '<a href="../">up</a><a href="a%20b.txt.gz">x</a><a href="?C=N">s</a><a href="dir/">d</a>'
    assert [r["name"] for r in documents.listing(spark, put(tmp_path, "l.html", html)).collect()] == ["a b.txt.gz"]


def test_exports(spark, tmp_path):
    papers = spark.createDataFrame([(1, "t"), (2, "u")], "paper_id int, title string")
    genes = spark.createDataFrame([(1, "B", 2), (1, "A", 1)], "paper_id int, symbol string, n int")
    docs = {r["paper_id"]: r["doc"] for r in sinks.nested(papers, "paper_id", genes=genes).collect()}
    assert docs[1] == '{"paper_id":1,"title":"t","genes":[{"symbol":"A","n":1},{"symbol":"B","n":2}]}' and docs[2].endswith('"genes":[]}')
    assert {r["paper_id"]: r["symbol"] for r in sinks.flat(papers, "paper_id", genes, "symbol").collect()} == {1: "A|B", 2: ""}
    d = spark.createDataFrame([("b", ["x", "y"], {"k2": "v", "k1": "w"}, None), ("a", None, None, 3)], "accession string, layers array<string>, extra map<string,string>, n int")
    assert [tuple(r) for r in sinks.export_rows(d, ["accession", "extra", "layers", "n"]).collect()] == [("a", "", "", "3"), ("b", "k1=w;k2=v", "x;y", "")]
    path = str(tmp_path / "v")
    sinks.write_version(spark.createDataFrame([(1, "v1"), (2, "v2")], "id int, version string"), path, "version")
    sinks.write_version(spark.createDataFrame([(9, "v2")], "id int, version string"), path, "version")
    assert sorted((r["id"], r["version"]) for r in spark.read.parquet(path).collect()) == [(1, "v1"), (9, "v2")]


def test_stream_of_mentions(spark, tmp_path):
    landing, table, checkpoint = (str(tmp_path / x) for x in ("landing", "table", "checkpoint"))
    spark.createDataFrame([(1, "A", 2), (1, "A", 3), (2, "B", 1)], "paper_id long, symbol string, mention_count long").withColumn("ts", F.current_timestamp()).coalesce(1).write.mode("append").parquet(landing)
    mentions.merge_files(spark, landing, table, checkpoint).awaitTermination()
    spark.createDataFrame([(1, "A", 7)], "paper_id long, symbol string, mention_count long").withColumn("ts", F.current_timestamp()).coalesce(1).write.mode("append").parquet(landing)
    mentions.merge_files(spark, landing, table, checkpoint).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(f"{table}/v=1").collect()) == [(1, "A", 7), (2, "B", 1)]


def test_windows_of_mentions(spark, tmp_path):
    """Windows close behind the watermark; a row later than it is not counted in any."""
    landing, out, checkpoint = (str(tmp_path / x) for x in ("landing", "out", "checkpoint"))

    def arrive(rows):
        frame = spark.createDataFrame(rows, "paper_id long, symbol string, mention_count long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        frame.coalesce(1).write.mode("append").parquet(landing)
        stream = mentions.windowed(spark.readStream.schema(mentions.SCHEMA).parquet(landing))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    arrive([(1, "A", 2, "2026-01-01 00:01:00"), (2, "A", 3, "2026-01-01 00:04:00"), (3, "B", 1, "2026-01-01 00:06:00")])
    arrive([(4, "A", 5, "2026-01-01 01:00:00")])
    arrive([(5, "A", 9, "2026-01-01 00:02:00"), (6, "A", 1, "2026-01-01 02:00:00")])
    closed = spark.read.parquet(out).select(F.date_format("window.start", "HH:mm").alias("at"), "symbol", "mentions")
    assert sorted(tuple(r) for r in closed.collect()) == [("00:00", "A", 5), ("00:05", "B", 1), ("01:00", "A", 5)]
