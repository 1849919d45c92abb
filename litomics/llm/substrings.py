"""Substring deduplication by suffix automata of reference shards.

A window is WINDOW words of one document. Every word under a window that also starts in a document with a smaller doc_id goes.

The whole corpus is the reference, so it cannot be broadcast; shards of it are routed to where they are needed instead:
1. Anchors. Of the GRAM-word grams in a window the one with the least hash is the window's anchor, so equal windows have equal
   anchors. Anchors that occur in one document only, copies of whole documents aside, leave; no window of theirs repeats.
2. Regions. For documents with shared anchors, each run of windows with one shared anchor is a region. Equal regions are one, with the smallest doc_id that has it.
   A document whose words equal a smaller doc_id's is all removed and has no regions.
3. Shards. The regions of an anchor meet in one place, at most SHARD_WORDS words of them in one suffix automaton, whose states
   know the smallest doc_id they occur in. Regions are streamed through every shard of their anchor for matching
   statistics; wherever WINDOW words match, the state says where they occur first.
4. Windows that occur first elsewhere are joined back to their documents, and their words are removed.

Hot anchors. An anchor with more than MOST_REGIONS regions, or MOST_WORDS words of several, such as the opening of a common sentence, is not one place: its regions are
cut again by anchors of longer grams, and those that are still hot by whole windows, each time merged where they are equal before they
meet. A region of whole windows is one window however often it stands in a row, so runs of one word, whatever their lengths, become a single row.
So no place gets more than that, and equal windows still meet. Anchors are counted before they are shuffled, equal regions merge in each pass over texts,
groups of equal texts meet their first document by a broadcast of fewer than 1 / HOT rows, and other joins are on keys that Spark splits.
No group is capped. Documents without a repeat are told by a bit filter of fixed size and skip the joins.

Nulls: a null text has no words. A null doc_id has no order: nothing is removed from such a row and it is no reference. Rows that share a doc_id
are judged alike, as one document that has all their windows. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LISTED, discard, gram_hashes, looked_up, marked, mix, places, small_batches, staged, table, text_chunks, within, without, word_hashes

WINDOW = 13
GRAM = 5
SHARD_WORDS = 50_000
#: Regions of one anchor that may meet in one place.
MOST_REGIONS = 2000
#: Words of several regions of one anchor that may meet in one place.
MOST_WORDS = 100_000
#: Bytes of hash that stand for a word in a region.
WORD_BYTES = 8
FAR = 2**63 - 1


def anchors_of(hashes: np.ndarray, starts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all windows, and their anchors."""
    at = places(starts, window)
    if not len(at):
        return at, np.zeros(0, np.int64)
    g = gram_hashes(hashes, gram)
    size = len(hashes) - window + 1
    least = g[:size].copy()
    for k in range(1, window - gram + 1):
        np.minimum(least, g[k : k + size], out=least)
    return at, mix(least[at]).view(np.int64)


def anchor_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id and the distinct anchors of each document."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            words = [t.split() for t in texts]
            hashes, starts = word_hashes(words)
            at, anchor = anchors_of(hashes, starts, window, gram)
            owner = np.searchsorted(starts, at, side="right") - 1
            new = np.ones(len(at), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
            anchor, owner = anchor[new], owner[new]
            order = np.lexsort((anchor, owner))
            anchor, owner = anchor[order], owner[order]
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
            anchor, owner = anchor[new], owner[new]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(owner)), pa.array(anchor)], names=["doc_id", "anchor"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, anchor long")


def text_keys(docs: DataFrame) -> DataFrame:
    """doc_id, number of words and hash of the word sequence, as two numbers."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            words = [t.split() for t in texts]
            joined = [hashlib.blake2b(b" ".join(w), digest_size=16).digest() for w in words]
            pair = np.frombuffer(b"".join(joined), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(map(len, words)), pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["doc_id", "n_words", "k1", "k2"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, k1 long, k2 long")


class SuffixAutomaton:
    """Of several word sequences; each state knows the smallest document that its words occur in."""

    def __init__(self, parts: list[tuple[list[int], int]]) -> None:
        self.next: list[dict[int | tuple[str, int], int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [FAR]
        for i, (words, doc) in enumerate(parts):
            last = self._add(0 if i == 0 else last, ("end", i), FAR)  # a sign that is no word: parts do not run into each other
            for w in words:
                last = self._add(last, w, doc)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            p = self.link[s]
            if self.first[s] < self.first[p]:
                self.first[p] = self.first[s]

    def _add(self, last: int, w: int | tuple[str, int], doc: int) -> int:
        new = len(self.link)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        self.first.append(doc)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            if self.length[q] == self.length[p] + 1:
                self.link[new] = q
            else:
                copy = len(self.link)
                self.next.append(dict(self.next[q]))
                self.link.append(self.link[q])
                self.length.append(self.length[p] + 1)
                self.first.append(FAR)
                while p >= 0 and self.next[p].get(w) == q:
                    self.next[p][w] = copy
                    p = self.link[p]
                self.link[q] = self.link[new] = copy
        return new

    def first_of_windows(self, words: list[int], window: int) -> list[int]:
        """For each window of `words` the smallest document that has it; FAR where none has."""
        out, state, n = [], 0, 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
            if n >= window:
                while self.length[self.link[state]] >= window:
                    state = self.link[state]
                n = min(n, self.length[state])
            if i + 1 >= window:
                out.append(self.first[state] if n >= window else FAR)
        return out


def _words_of(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<i8").tolist()


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def settled(docs: DataFrame) -> DataFrame:
    """Documents that lose nothing."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            words = [t.split() for t in texts]
            columns = [part.column("doc_id"), pa.array(list(map(len, words)), pa.int64()), pa.array([0] * len(words), pa.int64()), pa.array(list(map(_digest, words)), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def cut_regions(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Documents (doc_id, text, is_copy, shared: their shared anchors) with what is settled and the regions of the rest.

    A region is (anchor, start, two hashes, words); of equal regions in one pass only the smallest document's has its words."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            words = [t.split() for t in texts]
            ids, copies, shared = (part.column(c).to_pylist() for c in ("doc_id", "is_copy", "shared"))
            holder: dict[tuple[int, bytes], dict] = {}
            out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "text": [], "regions": []}
            for doc, w, t, copy, own in zip(ids, words, texts, copies, shared, strict=True):
                regions = []
                if own and not copy:
                    hashes, starts = word_hashes([w])
                    at, anchor = anchors_of(hashes, starts, window, gram)
                    hit = np.isin(anchor, np.array(own, np.int64))
                    edge = np.ones(len(at) + 1, bool)
                    edge[1:-1] = anchor[1:] != anchor[:-1]
                    cuts, raw = np.flatnonzero(edge), hashes.astype("<u8")
                    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                        if not hit[a]:
                            continue
                        content = raw[at[a] : at[b - 1] + window].tobytes()
                        key = (int(anchor[a]), content)
                        r1, r2 = (int.from_bytes(x, "little", signed=True) for x in _halves(key))
                        region = {"anchor": key[0], "start": int(at[a]), "r1": r1, "r2": r2, "words": content, "doc": doc}
                        first = holder.get(key)
                        if first is None or doc < first["doc"]:
                            if first is not None:
                                first["words"] = None
                            holder[key] = region
                        else:
                            region["words"] = None
                        regions.append(region)
                open_ = bool(regions)
                out["n_words"].append(len(w))
                out["n_removed"].append(None if open_ else len(w) if copy else 0)
                out["kept_sha256"].append(None if open_ else _digest([] if copy else w))
                out["text"].append(t if open_ else None)
                out["regions"].append(regions)
            region = pa.struct([("anchor", pa.int64()), ("start", pa.int32()), ("r1", pa.int64()), ("r2", pa.int64()), ("words", pa.binary())])
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(region))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], names=["doc_id", *out])

    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, text binary, regions array<struct<anchor:long,start:int,r1:long,r2:long,words:binary>>"
    return docs.select("doc_id", "text", "is_copy", "shared").mapInArrow(run, schema)


def _halves(key: tuple[int, bytes]) -> tuple[bytes, bytes]:
    d = hashlib.blake2b(key[1], digest_size=16, salt=key[0].to_bytes(8, "little", signed=True)).digest()
    return d[:8], d[8:]


def first_documents(regions: DataFrame, window: int) -> DataFrame:
    """For each distinct region, by its two hashes, the smallest document of each of its windows from `off` (0) on. Rows of an anchor stand together."""

    def answers(group: list[tuple[bytes, int, int, int]]) -> Iterator[tuple[int, int, list[int]]]:
        if len(group) == 1:
            raw, doc, r1, r2 = group[0]
            yield r1, r2, [doc] * (len(raw) // WORD_BYTES - window + 1)
            return
        best: list[list[int] | None] = [None] * len(group)
        at = 0
        while at < len(group):
            shard, n = [], 0
            while at < len(group) and (not shard or n < SHARD_WORDS):
                words = _words_of(group[at][0])
                shard.append((words, group[at][1]))
                n, at = n + len(words), at + 1
            automaton = SuffixAutomaton(shard)
            for i, (raw, *_) in enumerate(group):
                found = automaton.first_of_windows(_words_of(raw), window)
                best[i] = found if best[i] is None else list(map(min, best[i], found))
        for (_, _, r1, r2), mins in zip(group, best, strict=True):
            yield r1, r2, mins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict[tuple[int, int], tuple[bytes, int]] = {}
        last = None
        out: list[tuple[int, int, list[int]]] = []
        as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.list_(pa.int64()))], names=["r1", "r2", "firsts"])
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("anchor", "words", "first", "r1", "r2")]
            for anchor, words, first, r1, r2 in zip(*columns, strict=True):
                if anchor != last and group:
                    out += answers([(w, d, *k) for k, (w, d) in group.items()])
                    group = {}
                    if len(out) > 2000:
                        yield as_batch(out)
                        out = []
                last = anchor
                known = group.get((r1, r2))
                if known is None or first < known[1]:
                    group[r1, r2] = (words, first)
        if group:
            out += answers([(w, d, *k) for k, (w, d) in group.items()])
        yield as_batch(out)

    return (
        regions.select("anchor", "words", F.col("first").cast("long").alias("first"), "r1", "r2")
        .repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "r1 long, r2 long, firsts array<long>").select("r1", "r2", F.lit(0).alias("off"), "firsts")
    )


def finer_regions(regions: DataFrame, window: int, gram: int) -> DataFrame:
    """Regions cut again by anchors of a longer gram: p1, p2 and offs, the region and the windows in it where the new one begins, and the new one.

    A gram of a whole window makes regions of one window: each window that a region has is one row, wherever and however often it stands there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("p1", "p2", "offs", "anchor", "words", "first", "r1", "r2")}
            for anchor, raw, first, p1, p2 in zip(*(batch.column(c).to_pylist() for c in ("anchor", "words", "first", "r1", "r2")), strict=True):
                words = np.frombuffer(raw, "<u8")
                _, finer = anchors_of(words, np.array([0, len(words)]), window, gram)
                if gram == window:
                    order = np.argsort(finer, kind="stable")
                    edge = np.flatnonzero(np.concatenate([[True], finer[order][1:] != finer[order][:-1], [True]]))
                    parts = [(order[a], order[a], order[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                else:
                    edge = np.flatnonzero(np.concatenate([[True], finer[1:] != finer[:-1], [True]]))
                    parts = [(a, b - 1, [a]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                for a, last, offs in parts:
                    key = (int(mix(np.array([finer[a]]).view(np.uint64) + np.uint64(anchor & (2**64 - 1))).view(np.int64)[0]), words[a : last + window].tobytes())
                    r1, r2 = (int.from_bytes(x, "little", signed=True) for x in _halves(key))
                    for name, value in zip(out, (p1, p2, offs, *key, first, r1, r2), strict=True):
                        out[name].append(value)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return regions.select("anchor", "words", "first", "r1", "r2").mapInArrow(run, "p1 long, p2 long, offs array<int>, anchor long, words binary, first long, r1 long, r2 long")


def first_of_regions(regions: DataFrame, window: int, longer: list[int]) -> DataFrame:
    """r1, r2, off, firsts as first_documents has them, a hot anchor's regions in parts. `longer` are grams for these, up to whole windows."""
    met = regions.groupBy("anchor").agg(F.count("*").alias("n"), F.sum(F.octet_length("words")).alias("bytes"))
    hot = staged(met.where((F.col("n") > MOST_REGIONS) | (F.col("n") > 1) & (F.col("bytes") > MOST_WORDS * WORD_BYTES)).select("anchor"), "hot") if longer else None
    if hot is None or hot.isEmpty():
        return first_documents(regions, window)
    parts = staged(finer_regions(within(regions, hot, "anchor"), window, longer[0]), "parts")
    distinct = staged(parts.groupBy("anchor", "r1", "r2").agg(F.min("first").alias("first"), F.min("words").alias("words")), "distinct")
    found = first_of_regions(distinct, window, longer[1:]).withColumnRenamed("off", "by")
    back = parts.select("p1", "p2", "offs", "r1", "r2").distinct().join(found, ["r1", "r2"])
    if longer[0] == window:
        # the windows of a region, each with its places, as one row again
        placed = F.flatten(F.collect_list(F.transform("offs", lambda o: F.struct(o.alias("o"), F.col("firsts")[0].alias("f")))))
        back = back.groupBy("p1", "p2").agg(F.transform(F.array_sort(placed), lambda x: x["f"]).alias("firsts")).select(F.col("p1").alias("r1"), F.col("p2").alias("r2"), F.lit(0).alias("off"), "firsts")
    else:
        back = back.select(F.col("p1").alias("r1"), F.col("p2").alias("r2"), (F.col("offs")[0] + F.col("by")).alias("off"), "firsts")
    return first_documents(without(regions, hot, "anchor"), window).union(back)


def remove_windows(docs: DataFrame, window: int) -> DataFrame:
    """Open documents (doc_id, n_words, text, starts: windows to remove) with their words removed."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests, kept_texts = [], [], []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                words = text.split()
                edge = np.zeros(len(words) + 1, np.int64)
                for s in starts or ():
                    edge[s] += 1
                    edge[min(s + window, len(words))] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                removed.append(int(gone.sum()))
                digests.append(_digest(kept))
                kept_texts.append(b" ".join(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return docs.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of `docs`."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    known = docs.where("doc_id is not null")

    keys = staged(text_keys(known), "keys").where(F.col("n_words") >= window)
    first = staged(keys.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1"), "first")
    copies = staged(looked_up(keys, first, ["k1", "k2"], "copies", keys.count()).groupBy("doc_id").agg(F.min(F.col("doc_id") > F.col("first")).alias("is_copy")).where("is_copy"), "copies")

    # copies give no anchors: what their texts repeat is all of them
    anchors = staged(anchor_rows(without(known, copies), window, gram), "anchors")
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor")
    hits = anchors.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("shared"))
    told = staged(hits.withColumn("is_copy", F.lit(False)).unionByName(copies.select("doc_id", F.lit(None).cast("array<long>").alias("shared"), F.lit(True).alias("is_copy"))), "told")
    discard(anchors, first)
    parts = marked(docs, told.select("doc_id"))
    quiet = settled(parts.where(~F.col(LISTED)))
    loud = parts.where(LISTED).drop(LISTED).join(told, "doc_id", "left").withColumn("is_copy", F.coalesce("is_copy", F.lit(False)))
    cut = staged(cut_regions(loud, window, gram), "cut")

    regions = cut.select("doc_id", F.explode("regions").alias("r"))
    contents = regions.where("r.words is not null").select(F.col("r.anchor").alias("anchor"), F.col("r.words").alias("words"), F.col("doc_id").cast("long").alias("first"), F.col("r.r1").alias("r1"), F.col("r.r2").alias("r2"))
    firsts = staged(first_of_regions(contents, window, sorted({(gram + window) // 2, window})), "firsts")
    windows = F.transform("firsts", lambda f, i: F.when(f < F.col("doc_id"), F.col("start") + F.col("off") + i))
    gone = (
        regions.select("doc_id", F.col("r.start").alias("start"), F.col("r.r1").alias("r1"), F.col("r.r2").alias("r2")).join(firsts, ["r1", "r2"])
        .select("doc_id", F.filter(windows, lambda w: w.isNotNull()).alias("w")).where(F.size("w") > 0)
        .groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("w"))).alias("starts"))
    )
    whole = cut.where("text is null").select("doc_id", "n_words", "n_removed", "kept_sha256")
    opened = cut.where("text is not null").select("doc_id", "n_words", "text").join(gone, "doc_id", "left")
    return quiet.unionByName(whole).unionByName(remove_windows(opened.select("doc_id", "n_words", "text", "starts"), window))


def op1_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
