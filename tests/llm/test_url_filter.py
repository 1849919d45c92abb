import re

from litomics.llm import url_filter
from litomics.llm.url_filter import LISTED, RULES, Bloom, Cascade

URLS = [
    None, "", "no scheme", "http://", "http://A.Example.ORG/es/x", "http://example.org/es", "http://example.org/en/12?x=/de/",
    "https://fr.com/fr/", "https://x.com/de/#/fr/", "https://notexample.org/es/1", "https://cheap-pills.example.com/en/",
    "https://www.cheap-pills.example.com/fr/1", "https://org/", "https://x.org", "ftp://x.org?a/b", "http://.com/de/", "a://b://c/", "https://spam-farm.example.net",
]


def plain(url):
    m = re.match(r"(?s).*?://([^/?#]*)(/[^?#]*)?", url or "")
    if not m:
        return "", "", None, "allow"
    host = re.sub("[A-Z]", lambda x: x[0].lower(), m[1])
    path = m[2] or ""
    fits = lambda h: host == h or host.endswith("." + h)
    best = max(((len(h + p), h + p, v) for v, h, p in RULES if fits(h) and path.startswith(p)), default=None)
    if best:
        return host, path, best[1], best[2]
    return host, path, None, "block" if any(map(fits, LISTED)) else "allow"


def test_against_plain(spark):
    frame = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, html string, verdict string")
    rows = {r["page_id"]: tuple(r)[1:] for r in url_filter.filter_urls(frame).collect()}
    assert rows == {i: plain(u) for i, u in enumerate([*URLS, *URLS])}
    assert url_filter.filter_urls(frame.limit(0)).collect() == []


def test_table_against_plain(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages).collect()}
    assert got == {r["page_id"]: plain(r["url"]) for r in pages.collect()}


def frame_of(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "key string")


def test_cascade_is_exact(spark):
    listed = {f"k{i}" for i in range(0, 3000, 3)}
    universe = {f"k{i}" for i in range(3000)}
    for guess in (1, 3000, 10**6):
        cascade = Cascade.build(frame_of(spark, listed), frame_of(spark, universe), guess)
        assert {k for k in universe if k in cascade} == listed
        assert len(cascade.levels) > (2 if guess == 3000 else 0)


def test_a_low_guess_sharpens_the_first_level(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SHARPEN", 2)
    listed, universe = {f"k{i}" for i in range(0, 9000, 20)}, {f"k{i}" for i in range(9000)}
    cascade = Cascade.build(frame_of(spark, listed), frame_of(spark, universe), 1)
    assert cascade.levels[0].n_hashes > Bloom(len(listed), 0.5, 0).n_hashes
    assert {k for k in universe if k in cascade} == listed


def test_list_as_a_table_and_odd_rows(spark):
    rows = [(None, u, "v") for u in URLS] + [(1, "http://" + "a." * 300_000 + "listed.test/" + "p" * 200_000, "v"), (2, "http://listed.test", "v"), (3, "http://listed.test/fr/", "v")]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = url_filter.filter_urls(pages, listed=frame_of(spark, ["listed.test", None, "listed.test"])).collect()
    assert len(got) == len(rows)
    assert {r["page_id"]: r["verdict"] for r in got if r["page_id"]} == {1: "block", 2: "block", 3: "block"}
