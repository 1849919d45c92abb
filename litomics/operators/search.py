"""Full-text search by lexemes: a match on columns, and an inverted index that is built once and answers queries without reading a text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stemming import lexemes

#: Ids of one block of postings. A term that most documents have is as many rows as there are blocks.
BLOCK_IDS = 1 << 16
#: Folders of an index; a query reads those of its terms.
FOLDERS = 64
#: Words that a task remembers the lexemes of.
MEMO = 50_000
#: Rows whose terms leave a task at once, and bytes of a batch of texts that comes to it: a task's memory doesn't grow with its rows.
ROWS, BATCH_BYTES = 200, 4 << 20


def term_batches(batches: Iterator[pa.RecordBatch], key: str, fields: list[str]) -> Iterator[pa.RecordBatch]:
    """The terms of a task's rows, of ROWS rows at a time."""
    memo: dict[str, str | None] = {}
    for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
        ids, terms, bits = [], [], []
        for i, texts in enumerate(zip(*(batch.column(f).to_pylist() for f in fields), strict=True)):
            found: dict[str, int] = {}
            for b, text in enumerate(texts):
                for x in lexemes(text or "", memo):
                    found[x] = found.get(x, 0) | 1 << b
            if len(memo) > MEMO:
                memo.clear()
            ids += [i] * len(found)
            terms += found
            bits += found.values()
        yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(ids, pa.int64())), pa.array(terms, pa.string()), pa.array(bits, pa.int32())], [key, "term", "fields"])


def terms_of(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, term, fields: the distinct lexemes of each row with a bit for each of `fields` that has it, the first field lowest. Null texts are empty."""
    kind = dict(rows.dtypes)[key]
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return rows.select(key, *fields).mapInArrow(lambda batches: term_batches(batches, key, fields), f"`{key}` {kind}, term string, fields int")


def folder(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


def build_index(rows: DataFrame, key: str, fields: list[str], path: str) -> None:
    """Writes the postings of `rows` (integer `key`, unique and not null) by term: for each block of ids the sorted ids, and the bits of their fields.

    A row of the index holds at most BLOCK_IDS ids, whatever the term, so no list grows with the corpus; rows of a folder are sorted by term, so a query's filter skips row groups."""
    block = F.floor(F.col(key) / BLOCK_IDS).cast("long")
    postings = (
        terms_of(rows.where(F.col(key).isNotNull()), key, fields).groupBy("term", block.alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col(key).cast("long").alias("id"), "fields"))).alias("p"))
        .select("term", "block", F.col("p.id").alias("ids"), F.col("p.fields").alias("fields"), folder(F.col("term")).alias("folder"))
    )
    # a term's blocks are dealt over files, so that a common term is not one task
    postings.repartition("folder", "block").sortWithinPartitions("folder", "term", "block").write.mode("overwrite").partitionBy("folder").parquet(path)


def search(spark: SparkSession, path: str, query: str, field: int | None = None) -> DataFrame:
    """id of every row that has all lexemes of `query` (in the field of that number, if one is given); a query without lexemes finds nothing.

    Blocks are intersected one by one: a block of a term meets the same block of the other terms, and is at most BLOCK_IDS ids."""
    wanted = sorted(set(lexemes(query)))
    index = spark.read.parquet(path)
    if not wanted:
        return index.select(F.explode("ids").alias("id")).limit(0)
    folders = [r[0] for r in spark.range(1).select(F.explode(F.array(*[folder(F.lit(w)) for w in wanted]))).distinct().collect()]
    rows = index.where(F.col("folder").isin(folders) & F.col("term").isin(wanted))
    ids = F.col("ids") if field is None else F.transform(F.filter(F.arrays_zip("ids", "fields"), lambda p: p["fields"].bitwiseAND(1 << field) != 0), lambda p: p["ids"])
    by_block = rows.select("term", "block", ids.alias("ids")).groupBy("block").agg(F.collect_list("ids").alias("lists")).where(F.size("lists") == len(wanted))
    both = F.aggregate(F.slice("lists", 2, len(wanted)), F.col("lists")[0], lambda a, x: F.array_intersect(a, x))
    return by_block.select(F.explode(both).alias("id"))


def matching(rows: DataFrame, key: str, fields: list[str], query: str) -> DataFrame:
    """key of every row that has all lexemes of `query`, by reading the texts: for one query over rows that have no index."""
    wanted = sorted(set(lexemes(query)))
    if not wanted:
        return rows.select(key).limit(0)
    found = terms_of(rows, key, fields).where(F.col("term").isin(wanted))
    return found.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select(key)
