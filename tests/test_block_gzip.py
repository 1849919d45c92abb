import gzip
import random

import pytest

from litomics.sources import block_gzip as B
from litomics.sources import tables


def blocks_of(text, size):
    return b"".join(B.packed(text[k : k + size]) for k in range(0, len(text), size)) + B.LAST


TEXTS = {
    "short": [f"line {i} " + "x" * (i % 40) for i in range(500)],
    "long": ["y" * n for n in (3000, 0, 10, 5000, 1, 0, 0, 7000)] * 3,
    "blank": [""] * 300,
    "one": ["no end"],
}


@pytest.mark.parametrize("kind", sorted(TEXTS))
@pytest.mark.parametrize("block", [100, 1000])
@pytest.mark.parametrize("end", ["", "\n"])
def test_lines_are_whole_wherever_ranges_end(tmp_path, kind, block, end):
    text = ("\n".join(TEXTS[kind]) + end).encode()
    path = tmp_path / "t.gz"
    path.write_bytes(blocks_of(text, block))
    want = gzip.decompress(path.read_bytes()).decode().split("\n")
    want = want[:-1] if want[-1] == "" else want
    size = path.stat().st_size
    rng = random.Random(block)
    for step in (size, 64, 517, rng.randrange(40, 900)):
        with path.open("rb") as f:
            got = [line.decode() for a in range(0, size, step) for line in B.owned_lines(f, a, min(a + step, size), size)]
        assert got == want, step


def test_heads_inside_packed_bytes_are_no_blocks(tmp_path):
    text = (B.HEAD + b"\x00" * 6 + b"\x06\x00BC\x02\x00\x1b\x00" + b"abc\n") * 400
    path = tmp_path / "t.gz"
    stored = b"".join(B.packed(text[k : k + 500]) for k in range(0, len(text), 500)) + B.LAST
    path.write_bytes(stored)
    with path.open("rb") as f:
        got = [line for a in range(0, len(stored), 37) for line in B.owned_lines(f, a, min(a + 37, len(stored)), len(stored))]
    assert got == text.split(b"\n")[:-1]


def test_spark_reads_by_blocks(spark, tmp_path):
    rng = random.Random(2)
    lines = [f"{i}\t" + "".join(rng.choices("ACGTé", k=rng.randrange(200))) for i in range(20_000)]
    plain, blocked = tmp_path / "plain.tsv.gz", tmp_path / "blocked.tsv.gz"
    plain.write_bytes(gzip.compress("\n".join(lines).encode()))
    blocked.write_bytes(blocks_of("\n".join(lines).encode(), B.BLOCK_TEXT))
    many, one = B.lines(spark, str(blocked), split_bytes="100000"), B.lines(spark, str(plain))
    assert many.rdd.getNumPartitions() > 4 and one.rdd.getNumPartitions() == 1
    assert [r["value"] for r in many.collect()] == [r["value"] for r in one.collect()] == lines
    text = tmp_path / "plain.tsv"
    text.write_text("\n".join(lines))
    assert sorted(r["value"] for r in spark.read.text(str(text)).collect()) == sorted(lines)


def test_round_trip_and_other_cases(spark, tmp_path):
    rows = spark.createDataFrame([("a" * 200_000,), ("",), (None,), ("bé",)] + [(f"r{i}",) for i in range(5000)], "value string").repartition(3)
    path = str(tmp_path / "out")
    B.write_lines(rows, path)
    back = B.lines(spark, path, split_bytes="2000")
    assert sorted(r["value"] for r in back.collect()) == sorted(r["value"] or "" for r in rows.collect())
    (tmp_path / "empty.gz").write_bytes(b"")
    assert B.lines(spark, str(tmp_path / "empty.gz")).collect() == []
    (tmp_path / "two.gz").write_bytes(gzip.compress(b"a\r\nb") + gzip.compress(b"c\nd\n"))
    assert [r["value"] for r in B.lines(spark, str(tmp_path / "two.gz")).collect()] == ["a", "bc", "d"]
    (tmp_path / "cut.gz").write_bytes(gzip.compress(b"a\n" * 1000)[:-12])
    with pytest.raises(Exception, match="breaks off"):
        B.lines(spark, str(tmp_path / "cut.gz")).collect()


def test_variant_tables_of_blocks(spark, tmp_path):
    """The same rows from a plain file, from plain gzip and from blocks."""
    head = ["##fileformat=VCF", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]
    body = [f"1\t{i}\t.\tA\tG\t.\t.\tGENEINFO=GENE{i % 7}:1;CLNSIG=Pathogenic" for i in range(1, 4000)]
    text = ("\n".join(head + body) + "\n").encode()
    for name, data in (("a.vcf", text), ("b.vcf.gz", gzip.compress(text)), ("c.vcf.gz", blocks_of(text, 900))):
        (tmp_path / name).write_bytes(data)
    a, b, c = (sorted(map(str, tables.clinvar(spark, str(tmp_path / n)).collect())) for n in ("a.vcf", "b.vcf.gz", "c.vcf.gz"))
    assert a == b == c and len(a) == 3999
    maf = ["#version 2.4", "Hugo_Symbol\tChromosome\tStart_Position\tVariant_Classification\tReference_Allele\tTumor_Seq_Allele2"] + [f"G{i % 3}\tchr1\t{i}\tMissense_Mutation\tA\t-" for i in range(300)]
    genes = spark.createDataFrame([("G1",)], "gene_symbol string")
    (tmp_path / "m.maf").write_text("\n".join(maf))
    (tmp_path / "m.maf.gz").write_bytes(blocks_of("\n".join(maf).encode(), 700))
    a, b = (sorted(map(str, tables.mutations(spark, str(tmp_path / n), "s", genes).collect())) for n in ("m.maf", "m.maf.gz"))
    assert a == b and len(a) == 100
