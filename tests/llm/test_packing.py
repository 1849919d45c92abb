import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from litomics.llm import common, packing

from .cases import docs, sample


def test_against_plain(spark):
    frame = docs(spark, [*sample("documents"), "a <|endoftext|> b", "ab" * 3000])
    rows = packing.pack(frame).collect()
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = defaultdict(int)
    for r in frame.collect():
        ids = [*slow.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got, sequences = defaultdict(int), defaultdict(list)
    for r in rows:
        got[tuple(r)[:5]] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= 1.03 * total / 1024 + 2
    assert packing.pack(frame.limit(0)).collect() == []


def test_plan_is_whole_and_close():
    rng = np.random.default_rng(3)
    for n in (1, 7, 400, 20_000):
        lengths = np.concatenate([rng.integers(1, 1025, n), np.clip(rng.lognormal(5.7, 0.9, n).astype(int), 1, 1024)])
        counts = np.bincount(lengths, minlength=1025)
        found = np.zeros(1025, int)
        runs = packing.plan(counts)
        for members, times in runs:
            assert sum(members) <= 1024
            for m in members:
                found[m] += times
        assert (found == counts).all()
        assert sum(t for _, t in runs) <= 1.02 * lengths.sum() / 1024 + 2


def test_numbers_have_no_gap(spark, monkeypatch):
    monkeypatch.setattr(common, "BUCKET_ROWS", 10)
    pieces = spark.createDataFrame([(i % 3 + 1, i) for i in range(100)] + [(7, i) for i in range(3)], "length long, row long")
    by = defaultdict(list)
    for r in common.numbered(pieces, "length", {1: 34, 2: 33, 3: 33, 7: 3}, "row").collect():
        by[r["length"]].append(r["number"])
    assert {k: sorted(v) for k, v in by.items()} == {k: list(range(n)) for k, n in ((1, 34), (2, 33), (3, 33), (7, 3))}


def test_long_runs_and_repeated_rows(spark):
    encode, slow = packing.Encoder(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("a" + " " * 5000 + "b", "\n" * 4000, "\u00a0" * 3000, " \n" * 2000 + "x", "1" * 3000, "word " * 900, "x" + " " * 1999, ""):
        assert packing.longest_run(b"x" + text.encode()) == max(map(len, re.findall(rb"[ \t-\r]+|[^ \t-\r]+", b"x" + text.encode())))
        assert encode(text.encode()).tolist() == [*slow.encode(text, add_special_tokens=False).ids, 2]
    assert len(encode(b" " * 1_000_000)) > 1
    frame = spark.createDataFrame([(1, "same text")] * 50, "doc_id long, text string")
    rows = packing.pack(frame).collect()
    assert len(rows) == len({(r["sequence_id"], r["offset"]) for r in rows}) == 50
