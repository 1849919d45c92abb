"""Repair of conversations by cost layers: bitsets of grammar states per turn for each increasing cost, and a trace of bits for the least audit.

The grammar of role initials is `(s?(ua)+)?`, an automaton of four states: at the start, after s, after u, after a. For each turn a word of LAYERS layers of four bits says which
states can still reach acceptance, and at what cost: layer c holds the states from which the rest can be repaired at cost base + c. Words go from the last turn to the first; keeping,
reroling, deleting and inserting are shifts of the whole word, so all layers move at once. Any state can be turned into any other at a cost of at most 5, so the least
cost of every state lies within the layers whatever the length. The first layer that holds the start at the first turn is the cost; from there the bits are traced forward, each time to the
ASCII-least edit that stays on a cheapest way. Roles of inserted and reroled rows follow from the state, so an audit names one repair.

Rows are cut to an initial and a few flags before they meet: equal rows of one turn become one with a number, and later repeats are told apart by a digest of the text. A
task streams the sorted rows of its conversations and holds about 20 bytes a row of one conversation, never its texts. The audit then goes in front of the conversation's rows, and a second
stream hashes the repaired text piece by piece. The digest of a conversation's whole text has to be made in order, so the rows of one conversation meet in one task, as a stream.

Defined cases: nulls are one space, in the damage, in roles and in texts; a null conv_id is a conversation. Rows of one turn are ordered by role, then by the SHA-256 of the text. A role that is
empty or has another initial than s, u, a cannot be kept, and makes illegal neighbours. Roles and texts are taken as they are, whatever their length. An empty table gives an empty result.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, table

#: Layers of a word, four bits each.
LAYERS = 8
_ALL = (1 << 4 * LAYERS) - 1
_START, _AFTER_S, _AFTER_U, _AFTER_A = (sum(1 << 4 * c + s for c in range(LAYERS)) for s in range(4))
_REROLE, _DELETE, _INSERT, _TRUNCATED = 2, 3, 2, 1
#: Of a row: must be deleted; is truncated. The low bits are the place of its initial in INITIALS.
FORCED, CUT = 8, 16
INITIALS = "sua"
#: State after a user or assistant row, by the state before.
AFTER = (2, 2, 3, 2)
NAMES = (None, None, "user", "assistant")
#: State after keeping each initial, by the state before.
KEPT_FROM = {0: {0: 1}, 1: {0: 2, 1: 2, 3: 2}, 2: {2: 3}}

BLANKS = " \t\n\v\f\r"
STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
STATS_SCHEMA = "conv_id long, " + ", ".join(f"{c} long" for c in STATS) + ", audit string"
RESULT_SCHEMA = STATS_SCHEMA + ", repaired_sha256 string"


def before_user(w: int) -> int:
    """The states from which a user row leads into the word."""
    u = w & _AFTER_U
    return u >> 2 | u >> 1 | u << 1


def before_assistant(w: int) -> int:
    return (w & _AFTER_A) >> 1


def before_any(w: int) -> int:
    return before_user(w) | before_assistant(w)


def before_system(w: int) -> int:
    return (w & _AFTER_S) >> 1


BEFORE = (before_system, before_user, before_assistant)


def with_inserts(w: int) -> int:
    """More than two rows inserted side by side lead nowhere that fewer do not."""
    for _ in range(2):
        w |= before_any(w) << 4 * _INSERT & _ALL
    return w


def settled(w: int, base: int) -> tuple[int, int]:
    """The word without its empty lowest layers, and the cost of its first one."""
    empty = ((w & -w).bit_length() - 1) // 4
    return w >> 4 * empty, base + empty


def layers(flags: bytes, copies: array) -> tuple[array, array]:
    """A word and its base before each row, and after the last."""
    n = len(flags)
    words, bases = array("L", bytes(8 * (n + 1))), array("q", bytes(8 * (n + 1)))
    w, base = with_inserts(1 << 0 | 1 << 3), 0
    words[n], bases[n] = w, base
    for i in range(n - 1, -1, -1):
        f, more = flags[i], _DELETE * (copies[i] - 1)
        if f & FORCED:
            # a row that must go changes no state
            base += _DELETE + more
        else:
            cut = _TRUNCATED * bool(f & CUT)
            kept = BEFORE[f & 3](w) << 4 * cut if f & 3 < 3 else 0
            w = (kept | before_any(w) << 4 * (_REROLE + cut) | w << 4 * _DELETE) & (1 << 4 * (LAYERS + _DELETE)) - 1
            w, base = settled(w, base + more)
            w = with_inserts(w & _ALL)
        words[i], bases[i] = w, base
    return words, bases


def least(word: int, base: int, state: int) -> int:
    """The first layer that holds the state."""
    bits = word & (_START, _AFTER_S, _AFTER_U, _AFTER_A)[state]
    return base + ((bits & -bits).bit_length() - 1) // 4 if bits else 1 << 62


def traced(flags: bytes, copies: array) -> tuple[int, str]:
    """The least cost of a conversation, and the least audit."""
    words, bases = layers(flags, copies)
    state, rest, i, out = 0, least(words[0], bases[0], 0), 0, []
    cost = rest
    while i < len(flags) or rest:
        at_end = i == len(flags)
        if not at_end:
            f, n = flags[i], copies[i]
            more = _DELETE * (n - 1)
            cut = _TRUNCATED * bool(f & CUT)
            if least(words[i + 1], bases[i + 1], state) + _DELETE + more == rest:
                out.append("D" * n)
                rest -= _DELETE + more
                i += 1
                continue
        if least(words[i], bases[i], AFTER[state]) + _INSERT == rest:
            out.append("I")
            rest -= _INSERT
            state = AFTER[state]
            continue
        kept = KEPT_FROM.get(f & 3, {}).get(state)
        if kept is not None and least(words[i + 1], bases[i + 1], kept) + cut + more == rest:
            edit, state, paid = "K", kept, cut + more
        else:
            edit, state, paid = "R", AFTER[state], _REROLE + cut + more
        out.append(edit + "D" * (n - 1))
        rest -= paid
        i += 1
    return cost, "".join(out)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage, and copies: 0 for a dropped row, 2 for a repeated one."""
    told = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *told).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def marked_rows(rows: DataFrame) -> DataFrame:
    """One row for all equal ones of a turn: conv_id, turn, role_digest, digest, initial, blank, truncated, copies; no text.

    Whether role and text were there before needs the rows of a conversation only, so one shuffle by conv_id serves both windows and streams."""
    initial = F.expr(f"cast(coalesce(nullif(locate(left(role, 1), '{INITIALS}'), 0), 4) - 1 as int)")
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    # a dropped row only tells of its conversation: nothing else of it is kept
    there = F.col("copies") > 0
    narrow = rows.select(
        "conv_id",
        *(F.when(there, c).alias(n) for n, c in {
            "turn": F.col("turn"), "role": F.col("role"), "digest": F.unhex(F.sha2(F.col("text").cast("binary"), 256)),
            "initial": F.when(F.col("role") == "", 3).otherwise(initial), "blank": trimmed == "", "truncated": ~F.substring(trimmed, -1, 1).isin(".", "!", "?"),
        }.items()),
        "copies",
    )
    joined = narrow.groupBy("conv_id", "turn", "role", "digest").agg(*(F.first(c).alias(c) for c in ("initial", "blank", "truncated")), F.sum("copies").alias("copies"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn"))) > 1
    return joined.repartition("conv_id").withColumn("seen", seen)


def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of STATS_SCHEMA for each conversation of a task; its rows arrive sorted."""
    now: tuple | None = None
    flags, copies, state = bytearray(), array("q"), None

    def closed() -> tuple:
        cost, audit = traced(bytes(flags), copies)
        span = state["last"] - state["first"] + 1 - state["turns"] if state["turns"] else 0
        return (*now, span, state["blank"], state["duplicate"], state["truncated"], state["illegal"], cost, audit)

    for batch in batches:
        out = []
        for conv, turn, initial, blank, cut, seen, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "blank", "truncated", "seen", "copies")), strict=True):
            if now != (conv,):
                if now is not None:
                    out.append(closed())
                now, flags, copies = (conv,), bytearray(), array("q")
                state = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0, "first": 0, "last": None, "initial": None}
            if not n:
                continue
            if turn is not None and turn != state["last"]:
                state["first"] = state["first"] if state["turns"] else turn
                state["last"] = turn
                state["turns"] += 1
            if state["initial"] is not None:
                state["illegal"] += (state["initial"], initial) not in LEGAL
            state["illegal"] += n - 1
            state["initial"] = initial
            state["blank"] += n if blank else 0
            state["duplicate"] += 0 if blank else n if seen else n - 1
            state["truncated"] += not blank and not seen and cut
            flags.append(initial | (FORCED if blank or seen else 0) | (CUT if cut and not blank and not seen else 0))
            copies.append(n)
        yield as_batch(out, STATS_SCHEMA)
    if now is not None:
        yield as_batch([closed()], STATS_SCHEMA)


#: Neighbouring initials that the grammar has.
LEGAL = {(INITIALS.index(a), INITIALS.index(b)) for a, b in ("su", "ua", "au")}


def as_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    types = {"long": pa.int64(), "string": pa.string()}
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


class Repair:
    """Hashes the repaired text of one conversation while its rows pass by."""

    def __init__(self, found: tuple, audit: str):
        self.found, self.audit, self.at, self.state = found, audit, 0, 0
        self.sha, self.any, self.last = hashlib.sha256(), False, None

    def line(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.any else "") + role + ":").encode())
        self.sha.update(text.encode())
        self.any = True

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state = AFTER[self.state]
            self.line(NAMES[self.state], "")
            self.at += 1

    def row(self, key: tuple, role: str, text: str, copies: int) -> None:
        if key != self.last:
            self.last = key
            self.inserts()
            edit = self.audit[self.at]
            if edit == "K":
                self.state = KEPT_FROM[INITIALS.index(role[0])][self.state]
                self.line(role, text)
            elif edit == "R":
                self.state = AFTER[self.state]
                self.line(NAMES[self.state], text)
            self.at += 1
            copies -= 1
        # further copies are deleted
        self.at += copies

    def end(self) -> tuple:
        self.inserts()
        return (*self.found, self.sha.hexdigest())


def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of RESULT_SCHEMA for each conversation; its audit arrives first, then its rows."""
    now: Repair | None = None
    for batch in batches:
        out = []
        for kind, conv, turn, role, digest, text, copies, *stats in zip(*(batch.column(c).to_pylist() for c in ("kind", "conv_id", "turn", "role", "digest", "text", "copies", *STATS)), strict=True):
            if kind == 0:
                if now is not None:
                    out.append(now.end())
                now = Repair((conv, *stats, text), text)
            else:
                now.row((turn, role, digest), role, text, copies)
        yield as_batch(out, RESULT_SCHEMA)
    if now is not None:
        yield as_batch([now.end()], RESULT_SCHEMA)


def in_order(rows: DataFrame, *first: str) -> DataFrame:
    return rows.sortWithinPartitions(F.asc_nulls_first("conv_id"), *first, F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("digest"))


def repair(conversations: DataFrame) -> DataFrame:
    """RESULT_SCHEMA of every conv_id of `conversations`, damaged first as `damaged` says."""
    small_batches(conversations.sparkSession)
    rows = damaged(conversations)
    marks = in_order(marked_rows(rows)).select("conv_id", "turn", "initial", "blank", "truncated", "seen", "copies")
    stats = marks.mapInArrow(statistics, STATS_SCHEMA)
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    none = {c: F.lit(None).cast("long").alias(c) for c in ("turn", "copies", *STATS)}
    texts = rows.where("copies > 0").select(F.lit(1).alias("kind"), "conv_id", "turn", "role", digest.alias("digest"), "text", "copies", *(none[c] for c in STATS))
    audits = stats.select(
        F.lit(0).alias("kind"), "conv_id", none["turn"], F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"), none["copies"], *STATS,
    )
    return in_order(audits.union(texts).repartition("conv_id"), "kind").mapInArrow(repaired, RESULT_SCHEMA)


def op12_turn_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


def oracle() -> str:
    """The same from whole texts, by sums of costs from the last row to the first, with the cheapest (cost, audit, text) of each state."""
    user = "chr(10) || 'user:'"
    assistant = "chr(10) || 'assistant:'"
    least_of = lambda *xs: f"list_sort([{', '.join(xs)}])[1]"
    paid = lambda s, cost, edit, text="''": f"struct_pack(c := {s}.c + {cost}, a := '{edit}' || {s}.a, t := {text} || {s}.t)"

    def inserted(source: str) -> str:
        return f"""SELECT conv_id, pos, {least_of("s0", paid("s2", 2, "I", user))} AS s0, {least_of("s1", paid("s2", 2, "I", user))} AS s1,
          {least_of("s2", paid("s3", 2, "I", assistant))} AS s2, {least_of("s3", paid("s2", 2, "I", user))} AS s3 FROM ({source})"""

    def moved(s: int) -> str:
        new, name = ((2, user), (2, user), (3, assistant), (2, user))[s]
        kept = [f"CASE WHEN NOT must AND i = '{INITIALS[k]}' THEN {paid(f's{to}', 'cut', 'K', 'chr(10) || role || chr(58) || text')} END" for k, froms in KEPT_FROM.items() for at, to in froms.items() if at == s]
        return least_of(paid(f"s{s}", 3, "D"), f"CASE WHEN NOT must THEN {paid(f's{new}', '2 + cut', 'R', f'{name} || text')} END", *kept) + f" AS s{s}"

    start = "struct_pack(c := 0::BIGINT, a := '', t := '')"
    never = "struct_pack(c := 1000000000::BIGINT, a := '', t := '')"
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    crc = """xor(4294967295, list_reduce(list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT),
      lambda a, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda v, _: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(a, b)), 4294967295::BIGINT))"""
    return f"""
WITH RECURSIVE keyed AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT *, {crc} % 20 AS kind FROM keyed),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0),
placed AS (
  SELECT *, left(role, 1) AS i, trim(text, {blanks}) AS body, row_number() OVER w AS pos, lead(left(role, 1)) OVER w AS next_i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
  FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
judged AS MATERIALIZED (
  SELECT *, body = '' AS blank, body <> '' AND nth > 1 AS duplicate, body = '' OR nth > 1 AS must,
    (body <> '' AND nth = 1 AND right(body, 1) NOT IN ('.', '!', '?'))::INT AS cut FROM placed),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (cut = 1) AS truncated, count(*) FILTER (next_i IS NOT NULL AND i || next_i NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM judged GROUP BY conv_id),
ends AS (SELECT conv_id, n + 1 AS pos, {start} AS s0, {never} AS s1, {never} AS s2, {start} AS s3 FROM counted),
ways AS (
  {inserted(inserted("SELECT * FROM ends"))}
  UNION ALL
  {inserted(inserted(f"SELECT j.conv_id, j.pos, {', '.join(moved(s) for s in range(4))} FROM ways w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.pos = w.pos - 1"))})
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(s0.c, 0) AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(substr(s0.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ways w ON o.conv_id IS NOT DISTINCT FROM w.conv_id AND w.pos = 1
"""
