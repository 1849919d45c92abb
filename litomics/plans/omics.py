"""Matrices, seeds, effects, texts and scores bound to the driver's tables, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, genomics, text
from ..operators import curation, disease, entities, matrices, readouts, scoring, seeds
from ..session import written
from .relational import SCORES, edges, mentions, nodes, papers, query, t, EDGES, MENTIONS, QUERIES, ORACLES  # noqa: F401

# --- texts ------------------------------------------------------------------------------------------------------------

_HELD = r"regexp_replace(trim(text), '(?i)(^|[^\p{L}\p{M}\p{N}_])(" + "|".join(text.ABBREVIATIONS) + r")\.', '\1\2' || chr(57344), 'g')"
_SPLIT = r"""regexp_replace(regexp_replace(regexp_replace(""" + _HELD + r""", '([0-9])\.([0-9])', '\1' || chr(57344) || '\2', 'g'), '([0-9])\.([0-9])', '\1' || chr(57344) || '\2', 'g'), '([.!?;])\s+', '\1' || chr(57345), 'g')"""


@query(f"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split({_SPLIT}, chr(57345)), lambda x: trim(replace(x, chr(57344), '.'))), lambda x: x <> '') AS s FROM documents)
 SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, CAST(list_sum(list_transform(s, lambda x: length(x))) AS BIGINT) AS chars, md5(array_to_string(s, '|')) AS digest FROM s""")
def i1_sentences(spark, sf):
    s = t(spark, sf, "documents").select("doc_id", text.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"), F.md5(F.array_join("s", "|").cast("binary")).alias("digest"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(57345), 'g'), chr(57345)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)
 SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, md5(array_to_string(s, '|')) AS digest FROM s""")
def i2_plain_sentences(spark, sf):
    s = t(spark, sf, "documents").select("doc_id", text.plain_sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "|").cast("binary")).alias("digest"))


@query(f"""WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(string_split({_SPLIT}, chr(57345)), lambda x: trim(replace(x, chr(57344), '.'))), lambda x: x <> '')) AS sentence,
 unnest(range(len(list_filter(list_transform(string_split({_SPLIT}, chr(57345)), lambda x: trim(replace(x, chr(57344), '.'))), lambda x: x <> '')))) AS position FROM documents),
 w AS (SELECT unnest(['idiot', 'clown', 'scum']) AS symbol), p AS (SELECT DISTINCT doc_id, symbol FROM documents, w),
 m AS (SELECT p.doc_id, symbol, position, sentence FROM p JOIN s USING (doc_id) WHERE contains(lower(sentence), symbol) AND regexp_matches(sentence, '(?i)(^|[^\\p{{L}}\\p{{N}}_])' || symbol || '($|[^\\p{{L}}\\p{{N}}_])'))
 SELECT doc_id AS paper_id, symbol, CAST(coalesce(position, -1) AS BIGINT) AS position, length(sentence) AS chars FROM p LEFT JOIN m USING (doc_id, symbol)""")
def i3_contexts(spark, sf):
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), "text")
    pairs = d.select("paper_id", F.explode(F.array(*[F.lit(w) for w in ("idiot", "clown", "scum")])).alias("symbol"))
    return entities.contexts(d, pairs, "symbol").select("paper_id", "symbol", F.col("position").cast("long").alias("position"), F.length("sentence").cast("long").alias("chars"))


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}\-]+')) AS w FROM documents), d AS (SELECT unnest(['THE', 'AND', 'ERTION', 'HAING', 'SCHEN', 'CIÓNDE', 'EN', 'ON']) AS symbol)
 SELECT doc_id AS paper_id, symbol, count(*) AS mention_count FROM w JOIN d ON upper(w) = symbol WHERE length(w) BETWEEN 2 AND 15 AND length(w) > 3 GROUP BY 1, 2""")
def i4_gene_recognition(spark, sf):
    """Without biomedical context in these texts, symbols of up to 3 characters do not count."""
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), "text")
    names = spark.createDataFrame([(x,) for x in ("THE", "AND", "ERTION", "HAING", "SCHEN", "CIÓNDE", "EN", "ON")], "symbol string")
    return entities.recognise_genes(d, names)


@query()
def i5_drug_recognition(spark, sf):
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), "text")
    names = spark.createDataFrame([(x,) for x in ("of the", "that the", "the", "on the of", "apache license", "haing")], "name string")
    return entities.recognise_phrases(d, names)


@query(r"""SELECT event_id, array_to_string(list_transform(regexp_extract_all(event_type || ' rs' || user_id || ' RS' || event_id || ' xrs1', '(?i)\brs[0-9]+\b'), lambda x: lower(x)), ',') AS rs FROM events""")
def i6_rs_numbers(spark, sf):
    e = t(spark, sf, "events").select("event_id", F.concat(F.col("event_type"), F.lit(" rs"), F.col("user_id"), F.lit(" RS"), F.col("event_id"), F.lit(" xrs1")).alias("x"))
    return e.select("event_id", F.array_join(text.rs_numbers(F.col("x")), ",").alias("rs"))


_TITLE = "p_name || ' ' || CASE p_partkey % 6 WHEN 0 THEN 'single-cell RNA-seq of healthy controls' WHEN 1 THEN 'Bulk RNA-seq, case-control' WHEN 2 THEN 'microbiome 16S and quality control' WHEN 3 THEN 'ChIP seq; whole genome; control group vs control' WHEN 4 THEN 'microarray gene expression' ELSE 'nothing' END"


def titles(spark, sf):
    return t(spark, sf, "part").select("p_partkey", F.expr(_TITLE).alias("title"))


def _by_kind(columns: str, *rows: str) -> str:
    """SQL of what each of the six kinds of title is, spelt out."""
    return f"SELECT p_partkey, {columns} FROM part JOIN (VALUES {', '.join(f'({k}, {r})' for k, r in enumerate(rows))}) v(kind, a, b) ON p_partkey % 6 = kind"


@query(_by_kind("a AS omic_types", "'transcriptomic', 0", "'transcriptomic', 0", "'microbiome', 0", "'epigenomic,genomic', 0", "'transcriptomic', 0", "'other', 0"))
def i7_omic_types(spark, sf):
    return titles(spark, sf).select("p_partkey", F.array_join(classify.omic_types(F.col("title")), ",").alias("omic_types"))


_CLINIC = ("Biomarker and drug", "Incidence of SYMPTOM", "pathway mechanism", "diagnostic therapies", "manifestation; prevalence; detect", "nothing")


@query(_by_kind("a AS categories", "'diagnosis:0.8,treatment:0.8', 0", "'epidemiology:0.9,signs_symptoms:0.7', 0", "'mechanism:0.8', 0", "'', 0", "'diagnosis:0.8,epidemiology:0.9,signs_symptoms:0.7', 0", "'', 0"))
def i8_clinical(spark, sf):
    title = F.concat_ws(" ", "p_name", F.get(F.array(*map(F.lit, _CLINIC)), (F.col("p_partkey") % 6).cast("int")))
    return t(spark, sf, "part").select("p_partkey", F.array_join(F.transform(classify.clinical_categories(title), lambda c: F.concat_ws(":", c["category"], c["score"].cast("string"))), ",").alias("categories"))


@query(_by_kind("CAST(a AS DOUBLE) AS score, b AS value", "0.5, 'yes'", "0.5, 'yes'", "0, 'unknown'", "0.6667, 'yes'", "0, 'unknown'", "0, 'unknown'"))
def i9_control_group(spark, sf):
    return titles(spark, sf).select("p_partkey", classify.control_group(F.col("title")).alias("c")).select("p_partkey", "c.score", "c.value")


@query(_by_kind("CAST(a AS DOUBLE) AS score, b AS value", "0.9, 'single_cell'", "0.75, 'bulk'", "0, 'unknown'", "0, 'unknown'", "0.75, 'bulk'", "0, 'unknown'"))
def i10_single_cell(spark, sf):
    return titles(spark, sf).select("p_partkey", classify.single_cell(F.col("title")).alias("c")).select("p_partkey", "c.score", "c.value")


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s\-]', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents""")
def i14_normal_names(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.md5(text.normal_name(F.col("text")).cast("binary")).alias("digest"))


@query("WITH p AS (SELECT p_partkey, " + _TITLE + r""" AS title FROM part), w AS (SELECT p_partkey, regexp_extract_all(lower(title), '[a-z0-9_''\-]+') AS w FROM p),
 g AS (SELECT p_partkey, n, w[i:i + n - 1] AS g FROM w, unnest([1, 2, 3, 4]) a(n), unnest(range(1, 40)) b(i) WHERE i + n - 1 <= len(w)),
 k AS (SELECT DISTINCT p_partkey, array_to_string(g, ' ') AS g FROM g WHERE NOT list_has_all(['study', 'control', 'analysis'], g) AND (n > 1 OR length(g[1]) >= 6))
 SELECT p_partkey, string_agg(g, '|' ORDER BY g) AS grams FROM k GROUP BY 1""")
def i15_ngrams(spark, sf):
    return titles(spark, sf).select("p_partkey", F.array_join(F.array_sort(text.ngrams(F.col("title"), blocked=("study", "control", "analysis"))), "|").alias("grams"))


@query()
def d18_fuzzy_hits(spark, sf):
    terms = t(spark, sf, "customer").select(F.concat(F.col("c_name"), F.lit(" syndrome "), F.col("c_mktsegment")).alias("term"))
    names = t(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, "monogenic").otherwise("complex").alias("axis"), F.concat(F.regexp_replace("s_name", "Supplier", "Customer"), F.lit(" syndrom machinery")).alias("name"))
    return disease.fuzzy_hits(terms, names, 0.8)


@query("""SELECT c_name AS term, CASE WHEN s_suppkey % 2 = 0 THEN 'monogenic' ELSE 'complex' END AS axis, count(*) AS n FROM customer JOIN supplier ON regexp_replace(lower(c_name), '[^a-z0-9\\-]+', ' ', 'g') = replace(regexp_replace(lower(s_name), '[^a-z0-9\\-]+', ' ', 'g'), 'supplier', 'customer') GROUP BY 1, 2""")
def d17_exact_hits(spark, sf):
    terms = t(spark, sf, "customer").select(F.col("c_name").alias("term"))
    names = t(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, "monogenic").otherwise("complex").alias("axis"), F.regexp_replace("s_name", "Supplier", "CUSTOMER").alias("name"))
    return disease.exact_hits(terms, names).groupBy("term", "axis").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT upper(p_brand || CASE WHEN p_size > 25 THEN '' ELSE 'x' END) AS symbol, max(CASE WHEN p_size > 45 THEN 2 ELSE 1 END) AS level, max(p_size) AS score FROM part GROUP BY 1),
 g AS (SELECT DISTINCT l_suppkey AS dataset_id, upper(p_brand || CASE WHEN l_quantity > 45 THEN '' ELSE 'y' END) AS symbol FROM lineitem JOIN part ON l_partkey = p_partkey)
 SELECT dataset_id, string_agg(symbol, ',' ORDER BY symbol) AS genes, count(*) AS n_hits, CASE WHEN max(level) = 2 THEN 'assessed' ELSE 'not_assessed' END AS confidence, max(score) AS score FROM g JOIN m USING (symbol) GROUP BY 1""")
def d16_monogenic_hits(spark, sf):
    part = t(spark, sf, "part")
    # small quantities and sizes name genes that the other side lacks
    genes = t(spark, sf, "lineitem").join(part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").select(F.col("l_suppkey").alias("dataset_id"), F.concat("p_brand", F.when(F.col("l_quantity") > 45, "").otherwise("y")).alias("gene_symbol"))
    mendelian = part.select(F.concat("p_brand", F.when(F.col("p_size") > 25, "").otherwise("x")).alias("symbol"), F.when(F.col("p_size") > 45, "assessed").otherwise("not_assessed").alias("confidence"), F.col("p_size").alias("score"))
    return disease.monogenic_hits(genes, mendelian)


# --- keys and effects -------------------------------------------------------------------------------------------------

_ALLELES = """v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'chr' ELSE '' END || (l_suppkey % 22 + 1) AS c, CAST(l_partkey AS VARCHAR) AS p, CASE l_quantity % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'AG' ELSE 'AGT' END AS r,
 CASE l_orderkey % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'AG' WHEN 2 THEN 'C' WHEN 3 THEN 'A,T' WHEN 4 THEN '*' ELSE 'AGTC' END AS a FROM lineitem)"""


@query(f"""WITH {_ALLELES}, k AS (SELECT l_orderkey, l_linenumber, replace(c, 'chr', '') AS c, CAST(p AS BIGINT) AS p, r, a, r[1] = a[1] AND (length(r) > 1 OR length(a) > 1) AS s FROM v)
 SELECT l_orderkey, l_linenumber, CASE WHEN contains(a, ',') OR a = '*' THEN NULL WHEN s THEN c || ':' || (p + 1) || ':' || r[2:] || ':' || a[2:] ELSE c || ':' || p || ':' || r || ':' || a END AS variant_key FROM k""")
def i18_variant_keys(spark, sf):
    o, q = F.col("l_orderkey") % 6, F.col("l_quantity") % 3
    v = t(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.when(F.col("l_linenumber") % 2 == 0, "chr").otherwise(""), (F.col("l_suppkey") % 22 + 1).cast("string")).alias("c"), F.col("l_partkey").cast("string").alias("p"),
        F.when(q == 0, "A").when(q == 1, "AG").otherwise("AGT").alias("r"), F.when(o == 0, "A").when(o == 1, "AG").when(o == 2, "C").when(o == 3, "A,T").when(o == 4, "*").otherwise("AGTC").alias("a"),
    )
    return v.select("l_orderkey", "l_linenumber", genomics.variant_key(F.col("c"), F.col("p"), F.col("r"), F.col("a")).alias("variant_key"))


def raw_effects(spark, sf):
    """Effects from parts: three sources for each (variant, gene), by the part's size."""
    p = t(spark, sf, "part")
    s = F.col("p_size") % 5
    sig = F.when(s == 0, "Pathogenic").when(s == 1, "Uncertain significance").when(s == 2, "Likely benign").when(s == 3, "").otherwise("Likely pathogenic")
    # a third of the variants of one source and half of the other's are not the other's
    named = lambda absent, mark: F.concat(F.col("p_partkey").cast("string"), F.when(absent, mark).otherwise("")).alias("variant_key")
    clin = p.select(named(F.col("p_partkey") % 3 == 0, "x"), F.col("p_brand").alias("gene_symbol"), F.lit("clinvar").alias("source"), F.lit("").alias("oncogenicity"), sig.alias("clinvar_significance"), F.lit(None).cast("double").alias("raw_magnitude"))
    am = p.select(named(F.col("p_partkey") % 2 == 1, "y"), F.col("p_brand").alias("gene_symbol"), F.lit("alphamissense").alias("source"), F.lit("").alias("oncogenicity"), F.lit("").alias("clinvar_significance"), (F.col("p_size") / 40.0).alias("raw_magnitude"))
    return clin.unionByName(am)


def roles(spark, sf):
    b = t(spark, sf, "part").select("p_brand").distinct()
    n = F.substring("p_brand", -1, 1)
    return b.select(F.col("p_brand").alias("gene_symbol"), F.when(n == "1", "oncogene").when(n == "2", "tsg").when(n == "3", "oncogene_and_tsg").otherwise("neither").alias("role"))


_ROLE = "CASE right(p_brand, 1) WHEN '1' THEN 'oncogene' WHEN '2' THEN 'tsg' WHEN '3' THEN 'oncogene_and_tsg' ELSE 'neither' END"
_EFFECTS = f"""e AS (SELECT variant_key, gene_symbol, role, max(c) AS c, max(a) AS a FROM (
  SELECT p_partkey || CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE '' END AS variant_key, p_brand AS gene_symbol, {_ROLE} AS role, CASE p_size % 5 WHEN 0 THEN 1.0 WHEN 2 THEN 0.1 WHEN 4 THEN 0.9 END AS c, NULL AS a FROM part
  UNION ALL SELECT p_partkey || CASE WHEN p_partkey % 2 = 1 THEN 'y' ELSE '' END, p_brand, {_ROLE}, NULL, p_size / 40.0 FROM part) GROUP BY ALL), r AS (SELECT *, CASE WHEN c IS NOT NULL THEN 'clinvar' ELSE 'alphamissense' END AS source, CAST(least(1.0, coalesce(c, a)) AS DOUBLE) AS magnitude FROM e WHERE coalesce(c, a) IS NOT NULL)"""


@query(f"""WITH {_EFFECTS} SELECT variant_key, gene_symbol, source, round(magnitude, 9) AS magnitude, CAST(CASE source WHEN 'clinvar' THEN 0.9 ELSE 0.7 END AS DOUBLE) AS confidence,
 CASE WHEN magnitude >= 0.8 THEN 'damaging' WHEN magnitude <= 0.3 THEN 'benign' ELSE 'uncertain' END AS effect_class,
 CASE WHEN magnitude < 0.5 THEN 'neutral' WHEN role = 'tsg' THEN 'inactivator' WHEN role = 'oncogene' THEN 'activator' ELSE 'neutral' END AS direction, role = 'oncogene_and_tsg' AND magnitude >= 0.5 AS dual FROM r""")
def i21_resolved_effects(spark, sf):
    return seeds.resolve_effects(raw_effects(spark, sf), roles(spark, sf)).withColumn("magnitude", F.round("magnitude", 9))


# --- seeds ------------------------------------------------------------------------------------------------------------


def copy_values(spark, sf):
    line = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sample"), F.col("l_partkey").alias("p_partkey"), "l_quantity")
    both = line.join(t(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("gene")), "p_partkey")
    return both.groupBy("sample", "gene").agg(((F.max("l_quantity") - 25) / 25.0).alias("value"))


_COPY = f"""v AS (SELECT l_orderkey AS sample, upper(p_brand) AS gene, (max(l_quantity) - 25) / 25.0 AS value, {_ROLE} AS role FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, p_brand),
 cnv AS (SELECT sample, gene, CASE WHEN role = 'oncogene' THEN 'activator' ELSE 'inactivator' END AS direction, CAST(abs(value) AS DOUBLE) AS magnitude FROM v WHERE (role = 'oncogene' AND value >= 0.3) OR (role = 'tsg' AND value <= -0.3))"""


@query(f"""WITH {_COPY} SELECT sample, gene, direction, round(magnitude, 9) AS magnitude, CAST(0.6 AS DOUBLE) AS confidence FROM cnv""")
def d10_copy_number_seeds(spark, sf):
    return seeds.copy_number_seeds(copy_values(spark, sf), roles(spark, sf)).select("sample", "gene", "direction", F.round("magnitude", 9).alias("magnitude"), "confidence")


def occurrences(spark, sf):
    n = F.col("l_linenumber")
    kind = F.when(n == 2, "Nonsense_Mutation").when(n == 3, "Missense_Mutation").when(n == 4, "Silent").otherwise("Frame_Shift_Del")
    line = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sample"), F.col("l_partkey").alias("p_partkey"), kind.alias("classification"), F.col("l_linenumber").alias("seq"))
    return line.join(t(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("gene")), "p_partkey").select("sample", "gene", F.col("p_partkey").cast("string").alias("variant_key"), "classification", "seq")


def resolved(spark, sf):
    return seeds.resolve_effects(raw_effects(spark, sf), roles(spark, sf)).withColumn("resolution_version", F.lit("v1"))


_SNV = f"""{_EFFECTS}, rd AS (SELECT variant_key, upper(gene_symbol) AS gene, magnitude, CASE source WHEN 'clinvar' THEN 0.9 ELSE 0.7 END AS confidence,
 CASE WHEN magnitude < 0.5 THEN 'neutral' WHEN role = 'tsg' THEN 'inactivator' WHEN role = 'oncogene' THEN 'activator' ELSE 'neutral' END AS direction FROM r),
 oc AS (SELECT l_orderkey AS sample, upper(p_brand) AS gene, CAST(l_partkey AS VARCHAR) AS variant_key, l_linenumber AS seq, {_ROLE} AS role FROM lineitem JOIN part ON l_partkey = p_partkey),
 sn AS (SELECT oc.sample, oc.gene, oc.variant_key, seq, CASE WHEN seq <> 3 THEN CASE WHEN role = 'tsg' THEN 'inactivator' ELSE 'neutral' END ELSE rd.direction END AS direction, CAST(CASE WHEN seq <> 3 THEN 0.9 ELSE rd.magnitude END AS DOUBLE) AS magnitude,
 CAST(CASE WHEN seq <> 3 THEN 0.9 ELSE rd.confidence END AS DOUBLE) AS confidence FROM oc LEFT JOIN rd ON oc.variant_key = rd.variant_key AND oc.gene = rd.gene WHERE seq NOT IN (3, 4) OR (seq = 3 AND rd.direction IS NOT NULL)),
 snv AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY sample, gene, variant_key ORDER BY seq) AS n FROM sn) WHERE n = 1)"""


@query(f"""WITH {_SNV} SELECT sample, gene, variant_key, direction, round(magnitude, 9) AS magnitude, confidence FROM snv""")
def d12_mutation_seeds(spark, sf):
    return seeds.mutation_seeds(occurrences(spark, sf), roles(spark, sf), resolved(spark, sf)).select("sample", "gene", "variant_key", "direction", F.round("magnitude", 9).alias("magnitude"), "confidence")


_ALLELE = """al AS (SELECT cnv.sample, cnv.gene, h.gene IS NOT NULL AS hit, direction AS d, magnitude AS m FROM cnv LEFT JOIN (SELECT DISTINCT sample, gene FROM snv WHERE direction = 'inactivator' OR magnitude >= 0.9) h ON cnv.sample = h.sample AND cnv.gene = h.gene),
 v2 AS (SELECT sample, gene, CASE WHEN d = 'inactivator' THEN d WHEN hit THEN 'neutral' ELSE 'activator' END AS direction, CASE WHEN d = 'inactivator' AND hit THEN greatest(m, 0.9) ELSE m END AS magnitude,
 CAST(CASE WHEN d = 'inactivator' AND hit THEN 0.95 WHEN d = 'inactivator' THEN 0.60 WHEN hit THEN 0.40 ELSE 0.70 END AS DOUBLE) AS confidence FROM al)"""


@query(f"""WITH {_COPY}, {_SNV}, {_ALLELE} SELECT sample, gene, direction, round(magnitude, 9) AS magnitude, confidence FROM v2""")
def d11_allele_seeds(spark, sf):
    copy = seeds.copy_number_seeds(copy_values(spark, sf), roles(spark, sf))
    snv = seeds.mutation_seeds(occurrences(spark, sf), roles(spark, sf), resolved(spark, sf))
    return seeds.allele_seeds(copy, snv).select("sample", "gene", "direction", F.round("magnitude", 9).alias("magnitude"), "confidence")


def all_seeds(spark, sf):
    """Both kinds of seeds go into the third, so they are worked out once."""
    copy = written(seeds.copy_number_seeds(copy_values(spark, sf), roles(spark, sf)), "copy")
    snv = written(seeds.mutation_seeds(occurrences(spark, sf), roles(spark, sf), resolved(spark, sf)), "snv")
    return copy.unionByName(snv).unionByName(seeds.allele_seeds(copy, snv))


@query(f"""WITH {_COPY}, {_SNV}, {_ALLELE}, a AS (SELECT sample, gene, '' AS variant_key, direction, magnitude, confidence, 0 AS rank FROM v2 UNION ALL SELECT sample, gene, variant_key, direction, magnitude, confidence, 1 FROM snv UNION ALL SELECT sample, gene, '', direction, magnitude, 0.6, 2 FROM cnv),
 n AS (SELECT *, row_number() OVER (PARTITION BY sample, gene ORDER BY rank, abs(magnitude * confidence) DESC, variant_key) AS n, count(*) FILTER (direction <> 'neutral') OVER (PARTITION BY sample, gene) AS d FROM a)
 SELECT sample, gene, CASE rank WHEN 0 THEN 'cnv-v2' WHEN 1 THEN 'snv-v1' ELSE 'cnv-v1' END AS method_version, direction, round(CASE direction WHEN 'activator' THEN 1 WHEN 'inactivator' THEN -1 ELSE 0 END * magnitude * confidence, 6) AS weight,
 direction = 'neutral' AND rank = 0 AND d > 0 AS masked FROM n WHERE n = 1""")
def f5_effective_seeds(spark, sf):
    return seeds.effective(all_seeds(spark, sf)).withColumn("weight", F.round("weight", 6))


# --- matrices ---------------------------------------------------------------------------------------------------------


def line_samples(spark, sf):
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linestatus", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("sample"))


@query("""WITH p AS (SELECT l_orderkey, count(*) FILTER (l_linestatus = 'O') AS o, count(*) FILTER (l_linestatus = 'F') AS f, max(CASE WHEN l_linestatus = 'O' THEN l_orderkey || '-' || l_linenumber END) AS tumor_sample,
 max(CASE WHEN l_linestatus = 'F' THEN l_orderkey || '-' || l_linenumber END) AS normal_sample FROM lineitem GROUP BY 1) SELECT l_orderkey, tumor_sample, normal_sample FROM p WHERE o = 1 AND f = 1""")
def d8_pairs(spark, sf):
    return matrices.pairs(line_samples(spark, sf), "l_orderkey", "l_linestatus", "sample", "O", "F")


@query("""WITH p AS (SELECT count(*) FILTER (l_linestatus = 'O') AS o, count(*) FILTER (l_linestatus = 'F') AS f FROM lineitem GROUP BY l_orderkey)
 SELECT CASE WHEN o = 1 AND f = 1 THEN 'paired' WHEN o > 1 OR f > 1 THEN 'several' WHEN o = 1 THEN 'tumor_only' WHEN f = 1 THEN 'normal_only' ELSE 'none' END AS kind, count(*) AS n_cases FROM p GROUP BY 1""")
def d8_unpaired(spark, sf):
    return matrices.unpaired(line_samples(spark, sf), "l_orderkey", "l_linestatus", "O", "F")


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 25), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity <= 25)
 SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS n_common, count(*) FILTER (a.k IS NULL OR b.k IS NULL) AS n_discarded FROM a FULL JOIN b USING (k)""")
def d9_alignment(spark, sf):
    rows = t(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "feature")
    return matrices.aligned(rows.where("l_quantity > 25"), rows.where("l_quantity <= 25"))


@query("""SELECT p_brand AS gene, o_orderstatus AS sample, CAST(count(DISTINCT l_suppkey) AS INTEGER) AS burden FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def e16_burden(spark, sf):
    line = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("variant_key"))
    rows = line.join(t(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("gene")), "p_partkey").join(t(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("sample")), "o_orderkey")
    return matrices.burden(rows)


@query("""SELECT upper(p_name) AS feature_key, min(p_partkey) AS row_index FROM part GROUP BY 1""")
def e19_catalogue(spark, sf):
    return matrices.catalogue(t(spark, sf, "part").select(F.col("p_name").alias("feature"), F.col("p_partkey").alias("row_index")))


def matrix(spark, sf):
    return t(spark, sf, "lineitem").select(F.col("l_partkey").alias("feature"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("sample"), F.col("l_quantity").cast("float").alias("value"), F.col("l_orderkey").alias("case"), F.col("l_linestatus").alias("role"))


@query("""WITH f AS (SELECT l_suppkey AS feature, o_custkey AS tumor_sample, l_quantity - 10 AS delta FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT feature, round(coalesce(stddev_samp(delta), 0), 6) AS sd FROM f GROUP BY 1""")
def e20_cohort_sd(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    rows = t(spark, sf, "lineitem").join(o, "l_orderkey").select(F.col("l_suppkey").alias("feature"), (F.col("l_quantity") - 10).alias("delta"))
    return matrices.cohort_sd(rows).withColumn("sd", F.round("sd", 6))


@query("""WITH p AS (SELECT l_orderkey, max(CASE WHEN l_linestatus = 'O' THEN l_linenumber END) AS o, max(CASE WHEN l_linestatus = 'F' THEN l_linenumber END) AS f FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_linestatus = 'O') = 1 AND count(*) FILTER (l_linestatus = 'F') = 1),
 x AS (SELECT l_orderkey AS c, l_linenumber AS n, l_suppkey % 5 AS feature, l_quantity AS q FROM lineitem)
 SELECT t.feature, t.c || '-' || t.n AS tumor_sample, CAST(t.q - n.q AS DOUBLE) AS delta FROM p JOIN x t ON t.c = p.l_orderkey AND t.n = p.o JOIN x n ON n.c = p.l_orderkey AND n.n = p.f AND n.feature = t.feature""")
def j5_deltas(spark, sf):
    paired = matrices.pairs(line_samples(spark, sf), "l_orderkey", "l_linestatus", "sample", "O", "F").select("tumor_sample", "normal_sample")
    values = t(spark, sf, "lineitem").select((F.col("l_suppkey") % 5).alias("feature"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("sample"), F.col("l_quantity").cast("float").alias("value"))
    return matrices.deltas(values, paired)


@query("""WITH r AS (SELECT l_suppkey AS tf, CAST(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END AS DOUBLE) AS x, CAST(l_quantity AS DOUBLE) AS y FROM lineitem),
 s AS (SELECT tf, count(*) AS n, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy FROM r GROUP BY 1)
 SELECT tf, n AS n_targets, CASE WHEN n >= 5 AND sxx > 1e-12 THEN round((sxy / sxx) / sqrt(((syy - sxy * sxy / sxx) / (n - 2)) / sxx), 6) END AS t FROM s""")
def e21_ulm(spark, sf):
    rows = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("tf"), F.when(F.col("l_linenumber") % 2 == 0, 1.0).otherwise(-1.0).alias("x"), F.col("l_quantity").cast("double").alias("y"))
    return matrices.ulm(rows, ["tf"], "x", "y").withColumn("t", F.round("t", 6))


# --- scores -----------------------------------------------------------------------------------------------------------


@query()
def j2_pathway_scores(spark, sf):
    """Walk, projection and permutation null over the nation graph; seeds by customer, readouts by nation."""
    n = nodes(spark, sf).select("pathway_id", "node_id", F.col("gene_symbol").alias("gene"))
    c = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    s = c.select(F.col("c_custkey").alias("sample_id"), F.col("n_name").alias("gene"), (F.col("c_acctbal") / 10000).alias("weight"))
    readouts = t(spark, sf, "customer").select((F.col("c_custkey") % 2 + 1).alias("pathway_id"), ((F.col("c_nationkey") + 1) % 25).cast("long").alias("node_id"), F.col("c_custkey").alias("sample_id"), (F.col("c_acctbal") / 5000).alias("value"))
    return scoring.score(n, edges(spark, sf), s, readouts, t(spark, sf, "customer").select(F.col("c_custkey").alias("sample_id")), n_permutations=100)


# --- readouts and curation --------------------------------------------------------------------------------------------


@query("""SELECT CAST(r AS BIGINT) AS pathway_id, CAST(n_nationkey AS BIGINT) AS node_id, upper(n_name) AS feature_key FROM nation, (VALUES (1), (2), (3)) v(r) WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000)""")
def d13_symbol_readouts(spark, sf):
    features = t(spark, sf, "supplier").where("s_acctbal > 3000").join(t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.lower("n_name").alias("feature_key"))
    return readouts.by_symbol(nodes(spark, sf), features)


@query("""WITH g AS (SELECT a.n_name AS tf, b.n_name AS target, max(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END) AS sign FROM customer JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON c_custkey % 25 = b.n_nationkey GROUP BY 1, 2)
 SELECT CAST(1 AS BIGINT) AS pathway_id, CAST(n_nationkey AS BIGINT) AS node_id, upper(target) AS feature_key, sign FROM g JOIN nation ON tf = n_name WHERE target IN (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0)""")
def d14_regulon_readouts(spark, sf):
    n = t(spark, sf, "nation")
    c = t(spark, sf, "customer").join(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("tf")), "c_nationkey").withColumn("k", F.col("c_custkey") % 25)
    regulon = c.join(n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("target")), "k").select("tf", "target", F.when(F.col("c_custkey") % 2 == 0, 1).otherwise(-1).alias("sign"))
    return readouts.by_regulon(nodes(spark, sf), regulon, n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("feature_key")))


@query(f"""WITH {MENTIONS}, g AS (SELECT paper_id, symbol, sum(n) AS m FROM mentions GROUP BY 1, 2), l AS (SELECT DISTINCT l_orderkey AS paper_id, l_suppkey AS dataset_id FROM lineitem)
 SELECT dataset_id, symbol AS gene_symbol, CAST(sum(m) AS BIGINT) AS mention_count, count(*) AS n_papers FROM g JOIN l USING (paper_id) GROUP BY 1, 2""")
def d15_dataset_genes(spark, sf):
    found = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("dataset_id"))
    return readouts.genes_of_datasets(mentions(spark, sf).withColumnRenamed("symbol", "gene_symbol"), found)


@query("""WITH p AS (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50) SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM p LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 2 = 0""")
def d19_annotated_page(spark, sf):
    page = t(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_custkey")
    notes = t(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return readouts.annotated_page(page, notes, "o_custkey")


@query("""SELECT CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS used_bytes FROM lineitem WHERE (l_linenumber % 2 = 0 AND l_suppkey % 3 = 0) OR (l_linenumber % 2 = 1 AND l_partkey % 5 = 0)""")
def d20_used_bytes(spark, sf):
    even = F.col("l_linenumber") % 2 == 0
    files = t(spark, sf, "lineitem").select(F.when(even, F.col("l_suppkey")).alias("dataset_id"), F.when(~even, F.col("l_partkey")).alias("sample_id"), F.col("l_quantity").cast("long").alias("size_bytes"))
    return readouts.used_bytes(files, t(spark, sf, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("dataset_id")), t(spark, sf, "part").where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("sample_id")))


@query()
def e26_manifest(spark, sf):
    return readouts.manifest(j2_pathway_scores(spark, sf))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'complex' ELSE c_mktsegment END AS axis, CASE WHEN c_custkey % 4 = 0 THEN '1.0' ELSE '0.2' END AS score, CASE WHEN c_custkey % 4 = 0 THEN c_name || chr(10) || '[2026-01-02 03:04 ann] seen' ELSE c_name END AS notes FROM customer""")
def c20_resolved(spark, sf):
    c = t(spark, sf, "customer")
    rows = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("axis"), F.create_map(F.lit("score"), F.lit("0.2")).alias("confidence"), F.col("c_name").alias("notes"))
    decisions = c.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("id"), F.lit("complex").alias("axis"), F.lit("seen").alias("note"), F.lit("ann").alias("user"), F.lit("2026-01-02 03:04:00").cast("timestamp").alias("at"))
    return curation.resolve(rows, "id", decisions).select("id", "axis", F.col("confidence")["score"].alias("score"), "notes")


@query("""WITH d AS (SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'sra' WHEN 1 THEN 'geo' ELSE 'pride' END AS db FROM supplier), n AS (SELECT l_suppkey - CASE WHEN l_suppkey % 7 = 0 THEN 1 ELSE 0 END AS id, count(*) AS n, max(CASE WHEN l_orderkey % 997 = 0 THEN 1 ELSE 0 END) AS r FROM lineitem GROUP BY 1)
 SELECT id AS dataset_id, CASE WHEN db = 'sra' THEN 'fastq' WHEN db = 'geo' AND r = 1 THEN 'fastq' WHEN db = 'geo' THEN 'supplementary' ELSE 'processed' END AS kind, n AS n_samples FROM d JOIN n USING (id)""")
def c21_download_targets(spark, sf):
    k = F.col("s_suppkey") % 3
    d = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("dataset_id"), F.when(k == 0, "sra").when(k == 1, "geo").otherwise("pride").alias("source_db"))
    # every seventh dataset's samples are its neighbour's, so some datasets have none
    owner = F.col("l_suppkey") - F.when(F.col("l_suppkey") % 7 == 0, 1).otherwise(0)
    s = t(spark, sf, "lineitem").select(owner.alias("dataset_id"), F.col("l_orderkey").alias("sample_id"))
    return curation.download_targets(d, s, t(spark, sf, "orders").where("o_orderkey % 997 = 0").select(F.col("o_orderkey").alias("sample_id")))


@query("""SELECT DISTINCT l_orderkey AS paper_id, l_returnflag AS category FROM lineitem WHERE l_linenumber < 3 AND NOT (l_orderkey, l_returnflag) IN (SELECT (l_orderkey, l_returnflag) FROM lineitem WHERE l_quantity > 48)""")
def c22_categories(spark, sf):
    rows = t(spark, sf, "lineitem").withColumnsRenamed({"l_orderkey": "paper_id", "l_returnflag": "category"})
    return curation.categorise(rows.where("l_linenumber = 1"), rows.where("l_linenumber = 2"), rows.where("l_quantity > 48"))


@query("""SELECT s_suppkey AS dataset_id, 'included' AS curation_status FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT DISTINCT l_suppkey, 'pending' FROM lineitem WHERE l_quantity > 49 AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def c23_accepted_suggestions(spark, sf):
    have = t(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("dataset_id"), F.lit("included").alias("curation_status"))
    return curation.accept_suggestion(have, t(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("dataset_id")), "dataset_id")


@query("""WITH d AS (SELECT s_suppkey AS dataset_id, CASE WHEN s_suppkey % 3 = 0 THEN 'PRJNA' || s_suppkey END AS b, CASE WHEN s_suppkey % 4 = 0 THEN '10.1000/x' || s_suppkey END AS o FROM supplier), k AS (SELECT dataset_id, b AS k, 0.9 AS s FROM d UNION ALL SELECT dataset_id, o, 0.65 FROM d UNION ALL
 SELECT DISTINCT l_suppkey, CAST(l_orderkey AS VARCHAR), 0.7 FROM lineitem WHERE l_quantity > 49) SELECT dataset_id, string_agg(DISTINCT k, ',' ORDER BY k) AS keys, CAST(max(s) AS DOUBLE) AS score FROM k WHERE k IS NOT NULL GROUP BY 1""")
def i11_sample_join_keys(spark, sf):
    k = F.col("s_suppkey")
    d = t(spark, sf, "supplier").select(k.alias("dataset_id"), F.when(k % 3 == 0, F.concat(F.lit("prjna"), k)).alias("bioproject"), F.when(k % 4 == 0, F.concat(F.lit("https://doi.org/10.1000/X"), k)).alias("doi"), F.lit("none").alias("summary"))
    pmids = t(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("dataset_id"), F.concat(F.lit("PMID: "), F.col("l_orderkey")).alias("pmid"))
    return curation.sample_join_keys(d, pmids)


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'genomics' WHEN 1 THEN 'proteomics,genomics' WHEN 2 THEN '' ELSE 'transcriptomics' END AS layers FROM part""")
def i31_omics_layers(spark, sf):
    k = F.col("p_partkey") % 4
    p = t(spark, sf, "part").select("p_partkey", F.when(k == 0, "Genomic, genomic").when(k == 1, "proteomic,genomic,other").when(k == 2, "other").otherwise(" transcriptomic").alias("o"))
    return p.select("p_partkey", F.array_join(curation.omics_layers(F.col("o")), ",").alias("layers"))


@query("""SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY 2, 3""")
def b24_first_of_repeats(spark, sf):
    return curation.first_of_repeats(t(spark, sf, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id")


@query("""SELECT DISTINCT user_id AS sample_id, trim(r) AS run FROM (SELECT user_id, unnest([event_type || ' ', ' SRR' || event_id, ' ']) AS r FROM events) WHERE trim(r) <> ''""")
def b25_run_rows(spark, sf):
    runs = F.to_json(F.array(F.concat("event_type", F.lit(" ")), F.concat(F.lit(" SRR"), F.col("event_id").cast("string")), F.lit(" ")))
    return curation.run_rows(t(spark, sf, "events").select(F.col("user_id").alias("sample_id"), runs.alias("sra_runs")))
