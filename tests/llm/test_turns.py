import hashlib
import itertools
import random
import re
import zlib
from array import array
from collections import defaultdict

import pytest

from litomics.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, audit string, kind int"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def fault(i, rows):
    role, text = rows[i][1:]
    body = text.strip(" \t\n\v\f\r")
    if not body:
        return "blank"
    if any(r[1:] == (role, text) for r in rows[:i]):
        return "duplicate"
    return "truncated" if body[-1] not in ".!?" else None


def cheapest(rows, faults):
    """Cost, audit and repaired text by a search over whole repairs, least audit first among equals: Dijkstra's way over (row, initials so far reduced to a state)."""
    import heapq

    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        state = roles[-1:] if roles else ""
        if (i, state) in seen:
            continue
        if i == len(rows) and GRAMMAR.fullmatch(roles):
            return cost, audit, "\n".join(lines)
        seen.add((i, state))
        for new in "ua":
            if valid(roles + new):
                heapq.heappush(heap, (cost + 2, audit + "I", i, roles + new, (*lines, {"u": "user", "a": "assistant"}[new] + ":")))
        if i < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, roles, lines))
            if faults[i] not in ("blank", "duplicate"):
                cut = faults[i] == "truncated"
                _, role, text = rows[i]
                if role and valid(roles + role[0]):
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, roles + role[0], (*lines, f"{role}:{text}")))
                for new in "ua":
                    if valid(roles + new):
                        heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, roles + new, (*lines, {"u": "user", "a": "assistant"}[new] + ":" + text)))
    raise AssertionError


def valid(roles):
    """Whether a role sequence is a beginning of one of the grammar."""
    return re.fullmatch(r"(s?(ua)*u?)?", roles) is not None


def plain(table):
    groups = defaultdict(list)
    for conv, turn, role, text in table:
        conv_s, turn_s = (" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{conv_s}:{turn_s}".encode()) % 20
        rows = groups[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        rows.extend([(turn, role, text)] * (2 if kind == 3 else 1))
    out = []
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        faults = [fault(i, rows) for i in range(len(rows))]
        known = {r[0] for r in rows} - {None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, text = cheapest(rows, faults)
        out.append((conv, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(map(str, out))


def check(spark, table):
    frame = spark.createDataFrame([(*r, "clash", 7) for r in table], SCHEMA)
    assert sorted(str(tuple(r)) for r in turns.repair(frame).collect()) == plain(table)


def random_table(seed, n, roles, texts):
    rng = random.Random(seed)
    return [(conv, turn, rng.choice(roles), rng.choice(texts)) for conv in range(n) for turn in range(rng.randrange(1, 9))]


@pytest.mark.parametrize("seed", range(3))
def test_against_plain(spark, seed):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "u", "sysop"]
    texts = ["Yes.", "No!", "what", "Really? ", "", " \n\t", None, "one more.\v", "end ", "two.", "three.", "four", "\U0001f600", "five?\r\n"]
    check(spark, random_table(seed, 250, roles, texts))


def test_whole_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    table = [tuple(r) for r in frame.collect()]
    assert sorted(str(tuple(r)) for r in turns.repair(frame).collect()) == plain(table)


def test_defined_cases(spark):
    rows = [(None, t, r, x) for t in (None, None, 0, 1, 1, 5) for r, x in (("user", "Hi."), ("assistant", "Yes."), (None, None))]
    rows += [(1, None, "user", "no turn.")] * 3 + [(2, 3, "system", "only.")] + [(3, 4, "user", "same.")] * 40 + [(4, t, "user", "same again.") for t in range(30)]
    rows += [(5, t, "assistant" if t % 2 else "user", f"turn {t}.") for t in (2, 900, 901, 7_000_000_000)] + [(6, 1, "user", "x" * 1_000_000), (6, 2, "assistant", " " * 500_000 + "y.")]
    check(spark, rows)
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    check(spark, [(gone, 0, "user", "dropped."), (gone + 1, 0, "user", "x.")])
    assert turns.repair(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_conversation_streams(spark):
    rng = random.Random(8)
    table = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Well.", f"turn {t}.", f"cut {t}", ""])) for t in range(3000)]
    check(spark, table)


def test_layers_hold_the_least_cost_of_every_state():
    """Against minimum sums without layers."""
    rng = random.Random(1)
    infinite = 10**9
    for _ in range(300):
        n = rng.randrange(0, 30)
        flags = bytes(rng.choice([0, 1, 2, 3, 1, 2, 16, 17, 18, 19, 8]) for _ in range(n))
        copies = array("q", [rng.choice([1, 1, 1, 3]) for _ in range(n)])
        words, bases = turns.layers(flags, copies)
        best = [0, infinite, infinite, 0]
        for i in range(n, -1, -1):
            if i < n:
                f, more, cut = flags[i], 3 * (copies[i] - 1), bool(flags[i] & 16)
                new = [best[s] + 3 + more for s in range(4)]
                if not f & 8:
                    for s in range(4):
                        new[s] = min(new[s], best[turns.AFTER[s]] + 2 + cut + more)
                        kept = turns.KEPT_FROM.get(f & 3, {}).get(s)
                        if kept is not None:
                            new[s] = min(new[s], best[kept] + cut + more)
                best = new
            for _ in range(3):
                best = [min(best[s], best[turns.AFTER[s]] + 2) for s in range(4)]
            assert [turns.least(words[i], bases[i], s) for s in range(4)] == best
