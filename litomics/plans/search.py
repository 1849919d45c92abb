"""Full-text search bound to the driver's documents. A document's title is its first line, its abstract the rest.

The SQL names the word forms of each lexeme that the documents have, as the language's rules give them: it has no stemmer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import axis
from ..operators.search import build_index, matching, search
from ..session import scratch
from .relational import query, t

FORMS = {
    "ere": "ere ered eres ering eredly eringly",
    "one": "one oned ones oning onedly oningly",
    "idiot": "idiot idiots",
    "tion": "tion tions tioned tioning tiones tionly tionedly tioningly tionlying tionlyed",
}
WORDS = """w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS words, regexp_extract_all(lower(split_part(text, chr(10), 1)), '[\\p{L}\\p{N}]+') AS title FROM documents WHERE text IS NOT NULL)"""


def _has(lexeme: str, where: str = "words") -> str:
    return f"list_has_any({where}, [{', '.join(f"'{f}'" for f in FORMS[lexeme].split())}])"


@query(f"WITH {WORDS} SELECT doc_id FROM w WHERE {_has('ere')} AND {_has('one')}")
def c4_full_text(spark, sf):
    return matching(t(spark, sf, "documents"), "doc_id", ["text"], "The ering of the ones")


#: Number of each query, its text, and the field that it is restricted to.
SEARCHES = ((1, "The ering of the ones", None), (2, "IDIOTS!", None), (3, "tioned", 0), (4, "is of the", None), (5, "idiots, tioning", None))


@query(f"""WITH {WORDS} SELECT 1 AS query, doc_id FROM w WHERE {_has('ere')} AND {_has('one')} UNION ALL SELECT 2, doc_id FROM w WHERE {_has('idiot')}
 UNION ALL SELECT 3, doc_id FROM w WHERE {_has('tion', 'title')} UNION ALL SELECT 5, doc_id FROM w WHERE {_has('idiot')} AND {_has('tion')}""")
def c4_index(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.expr("substring(text, locate('\n', concat(text, '\n')) + 1)").alias("abstract"))
    path = scratch(spark, "index")
    build_index(docs, "doc_id", ["title", "abstract"], path)
    found = [search(spark, path, text, field).select(F.lit(k).alias("query"), F.col("id").alias("doc_id")) for k, text, field in SEARCHES]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


@query()
def i17_disease_axis(spark, sf):
    """Parts as datasets, their names and types as titles; names of parts as names of diseases, on either axis by their length. Similarity has no SQL; a test holds it against a plain version."""
    p = t(spark, sf, "part")
    title = F.concat_ws(" ", F.lit("A study of"), "p_name", F.lit("in"), F.lower("p_type"), F.lit("cells"))
    raw = F.when(F.col("p_size") % 5 == 0, F.array(F.concat(F.upper("p_name"), F.lit("s"))))
    datasets = p.select(F.col("p_partkey").alias("id"), title.alias("title"), F.concat_ws(", ", "p_brand", "p_type").alias("summary"), raw.alias("disease_raw"))
    subjects = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.concat(F.lit("Disease "), "l_returnflag", "l_linestatus").alias("descriptor"), (F.col("l_quantity") > 25).alias("is_major"))
    names = p.select(F.when(F.length("p_name") % 2 == 0, "monogenic").otherwise("multifactorial").alias("axis"), F.initcap("p_name").alias("name")).distinct()
    return axis.classify(datasets, subjects, names)
