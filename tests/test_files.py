import gzip

import pytest
from pyspark.sql import functions as F

from litomics.sources import matrix_files, tables
from litomics.sources.rows import first_rows, numbered

from .test_block_gzip import blocks_of


def test_numbers_follow_file_order_in_many_splits(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.tsv").write_text("a\tb\n" + "".join(f"{k * 1000 + i}\t{'x' * (i % 50)}\n" for i in range(1000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = numbered(tables.read_tsv(spark, str(tmp_path)))
        assert rows.rdd.getNumPartitions() > 4
        got = rows.select(F.col("a").cast("int"), "row_index").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(tuple, got)) == [(i, i) for i in range(3000)]


@pytest.mark.parametrize("packed", ["", ".gz", ".blocks.gz"])
def test_last_and_first_row_of_a_feature_over_many_tasks(spark, tmp_path, packed):
    """Features repeat thousands of lines apart, so in different splits; the file order decides, not the values."""
    lines = ["gene\tC1\tC2"] + [f"G{i % 40}\t{(i * 7919) % 1009}\t{'NA' if i % 3 else i}" for i in range(4000)]
    text = ("\n".join(lines) + "\n").encode()
    path = tmp_path / f"m.cct{packed}"
    path.write_bytes(text if not packed else gzip.compress(text) if packed == ".gz" else blocks_of(text, 2000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        m = tables.matrix(spark, str(path))
        rows = {r["row_index"]: (r["feature"], r["C1"], r["C2"]) for r in m.collect()}
        last = {r["feature"]: (r["v"]["C1"], r["v"]["C2"]) for r in tables.last_of_feature(m).collect()}
        first = {r["feature"]: (r["C1"], r["C2"]) for r in first_rows(m, "feature").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    value = lambda i: (float((i * 7919) % 1009), None if i % 3 else float(i))
    assert rows == {i: (f"G{i % 40}", *value(i)) for i in range(4000)}
    assert last == {f"G{i % 40}": value(i) for i in range(4000)}
    assert first == {f"G{i}": value(i) for i in range(40)}


def test_first_gene_disease_row_counts_whole(spark, tmp_path):
    text = "gene symbol,hgnc id,disease name,confidence\n" + "tp53,11998,Li,limited\nTP53,HGNC:1,Li,strong\nbrca1,,B,Moderate\nBRCA1,2,B,limited\nx,hgnc:9,C,both RD and IF\n,1,D,strong\ny,1,,strong\n"
    (tmp_path / "g.csv").write_text(text)
    rows = {tuple(r) for r in tables.gene_disease(spark, str(tmp_path / "g.csv"), raw_too=True).collect()}
    assert rows == {("Li", "TP53", "HGNC:11998", "limited", "limited"), ("B", "BRCA1", "", "moderate", "Moderate"), ("C", "X", "hgnc:9", "unknown", "both RD and IF")}
    (tmp_path / "bad.csv").write_text("gene,disease name\n")
    with pytest.raises(ValueError):
        tables.gene_disease(spark, str(tmp_path / "bad.csv"))


def big(spark, n=10_000):
    return spark.range(n).select(F.format_string("F%05d", "id").alias("feature"), *[(F.xxhash64("id", F.lit(k)) % 1000).cast("float").alias(f"T_{k}") for k in range(20)])


def scanned(frame):
    """Rows that the scan of a frame's plan put out."""
    frame.collect()
    leaf = frame._jdf.queryExecution().executedPlan()
    while not leaf.children().isEmpty():
        leaf = leaf.children().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_reading_rows_skips_row_groups(spark, tmp_path):
    path = str(tmp_path / "m")
    matrix_files.write_matrix(big(spark).repartition(5), path, group_bytes=16_000)
    wanted = spark.createDataFrame([("F00007",), ("F05000",), ("F09999",), ("absent",), (None,)], "feature string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = matrix_files.rows_of(spark, path, wanted)
        assert sorted(r["feature"] for r in rows.collect()) == ["F00007", "F05000", "F09999"]
        assert scanned(matrix_files.rows_of(spark, path, wanted)) < 2500 < 10_000 == scanned(matrix_files.read_matrix(spark, path))
        plan = matrix_files.features(spark, path)._jdf.queryExecution().toString()
        assert "ReadSchema: struct<feature:string>" in plan and "T_1" not in plan.split("Physical Plan")[-1]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    at = matrix_files.rows_at(spark, path, spark.createDataFrame([(0,), (5000,), (9999,), (10_000,)], "row_index long"))
    assert sorted((r["feature"], r["row_index"]) for r in at.collect()) == [("F00000", 0), ("F05000", 5000), ("F09999", 9999)]
    assert matrix_files.rows_of(spark, path, wanted.limit(0)).collect() == []


def test_many_wanted_rows_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(matrix_files, "MOST_LISTED", 3)
    path = str(tmp_path / "m")
    matrix_files.write_matrix(big(spark, 500), path)
    wanted = spark.range(0, 500, 9).select(F.format_string("F%05d", "id").alias("feature"))
    assert {r["feature"] for r in matrix_files.rows_of(spark, path, wanted).collect()} == {f"F{i:05d}" for i in range(0, 500, 9)}


def test_digest_depends_on_content_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(matrix_files, "PART_ROWS", 64)
    rows, found = big(spark, 1000), []
    for n, group in ((1, 1 << 20), (8, 4096), (3, 1 << 14)):
        path = str(tmp_path / f"m{n}")
        matrix_files.write_matrix(rows.repartition(n), path, group_bytes=group)
        found.append(matrix_files.digest(spark, path))
        assert [r["row_index"] for r in matrix_files.features(spark, path).orderBy("feature").collect()] == list(range(1000))
        assert matrix_files.digests(spark, path).count() == 16
    assert len(set(found)) == 1
    for k, other in enumerate((rows.where("feature <> 'F00500'"), rows.withColumn("T_3", F.when(F.col("feature") != "F00007", F.col("T_3"))), rows.withColumnRenamed("T_3", "T_x"))):
        matrix_files.write_matrix(other, str(tmp_path / f"o{k}"))
        assert matrix_files.digest(spark, str(tmp_path / f"o{k}")) != found[0]


def test_first_column_must_be_the_feature(spark, tmp_path):
    with pytest.raises(ValueError, match="first column"):
        matrix_files.write_matrix(spark.createDataFrame([(1.0, "a")], "T_1 float, feature string"), str(tmp_path / "x"))
    spark.createDataFrame([(1.0, "a")], "T_1 float, feature string").write.parquet(str(tmp_path / "y"))
    with pytest.raises(ValueError, match="first column"):
        matrix_files.read_matrix(spark, str(tmp_path / "y"))
    spark.createDataFrame([("a", 1)], "feature string, T_1 int").write.parquet(str(tmp_path / "z"))
    with pytest.raises(ValueError, match="no float"):
        matrix_files.rows_of(spark, str(tmp_path / "z"), spark.createDataFrame([("a",)], "feature string"))


def test_wide_keeps_absent_apart_from_zero(spark):
    long = spark.createDataFrame([("g1", "s1", 0), ("g1", "s2", 3), ("g2", "other", 4), ("g3", "s1", None)], "gene string, sample string, burden int")
    m = matrix_files.burden_matrix(long, ["s2", "s1", "s9"])
    assert m.columns == ["feature", "s1", "s2", "s9"]
    assert {tuple(r) for r in m.collect()} == {("g1", 0.0, 3.0, None), ("g2", None, None, None), ("g3", None, None, None)}
