"""Conversation repair against a search through all edits."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from tidegauge.llm import conversations, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, cost long, audit string, kind int"
BLANK = re.compile(r"[\x20\x09-\x0D]*")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows):
    """By uniform-cost search over (rows done, initials so far as a state of the pattern), in order of (cost, audit)."""
    found = faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, out = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", state):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in out)

        def go(edit, price, to, add):
            role = None if add is None else add[0]
            then = state + (role[:1] if role is not None else "")
            if role is None or role[:1] and re.fullmatch("s?(ua)*u?", then):
                then = re.sub("(ua)+", "ua", then)
                heapq.heappush(heap, (cost + price, audit + edit, to, then, out + ((add,) if add else ())))

        for role in ("user", "assistant"):
            go("I", 2, at, (role, ""))
        if at < len(rows):
            _, role, text = rows[at]
            go("D", 3, at + 1, None)
            if found[at] in (None, "truncated"):
                more = int(found[at] == "truncated")
                go("K", more, at + 1, (role, text))
                for new in ("user", "assistant"):
                    go("R", 2 + more, at + 1, (new, text))
    raise AssertionError


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def brute(rows, damaged=True):
    by = defaultdict(list)
    for conv, *r in damage(rows) if damaged else rows:
        by[conv].append(tuple(r))
    for conv in {r[0] for r in rows}:
        mine = sorted(by[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        turns = [r[0] for r in mine if r[0] is not None]
        found = faults(mine)
        cost, audit, text = cheapest(mine)
        pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        yield conv, gaps, *(found.count(k) for k in ("blank", "duplicate", "truncated")), pairs, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def talks():
    rng, rows = random.Random(4), []
    for conv in range(300):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None])
            rows.append((conv, rng.choice([turn] * 8 + [None, turn + 3]), role, rng.choice(["Yes.", "No!", "Tide", "Level?", "  ", "", None, f"Word {turn}.\n\t "])))
    rows += [(900, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(40)]
    rows += [(901, 1, "user", "All the same.")] * 30
    rows += [(902, t, "system", "One text.") for t in range(25)] + [(903, t, "system", f"Text {t}.") for t in range(25)]
    rows += [(904, None, None, None), (None, None, "user", "A null id."), (None, 2, "assistant", "x" * 30_000), (905, 0, "user", "a ")]
    return rows


@pytest.mark.parametrize("segment", [4096, 3])
def test_repair(spark, segment):
    rows = talks()
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(7)
    given = conversations.given(table)
    got = conversations.digests(spark, conversations.damaged(given), given, segment)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)


def test_repaired_rows(spark):
    rows = [(c, t, r or " ", x or " ") for c, t, r, x in talks()]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    given = conversations.given(table)
    lines = defaultdict(list)
    for r in sorted(conversations.repaired(spark, given, 5).collect(), key=lambda r: (str(r.conv_id), r.place)):
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    want = {b[0]: b[-1] for b in brute(rows, damaged=False)}
    assert {c: hashlib.sha256("\n".join(lines[c]).encode()).hexdigest() for c in want} == want


def test_hot_conversation(spark):
    """One conversation in many runs over several partitions: the chart's paths through all of them."""
    rows = [(7, t, random.Random(t).choice(["user", "assistant"]), f"Turn {t % 90}.") for t in range(3_000)] + [(8, 0, "user", "Hi.")]
    given = conversations.given(spark.createDataFrame(rows, "conv_id int, turn long, role string, text string").repartition(6))
    marked = conversations.with_repeats(conversations.marks(given))
    found = conversations.runs(marked, 100)
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(conf, "false")
    try:
        assert found.where("conv = 7").select("part").distinct().count() > 1
        got = {r.conv_id: r for r in conversations.digests(spark, given, given, 100).collect()}
    finally:
        spark.conf.unset(conf)
    want = {b[0]: b for b in brute(rows, damaged=False)}
    assert {c: tuple(r) for c, r in got.items()} == want


def test_empty_and_query(spark):
    none = conversations.given(spark.createDataFrame([], SCHEMA))
    assert conversations.digests(spark, none, none).count() == 0 and conversations.repaired(spark, none).count() == 0
    one = conversations.given(spark.createDataFrame([(5, 1, "user", "Hi.")], "conv_id long, turn long, role string, text string"))
    r = conversations.digests(spark, one.limit(0), one).first()
    assert tuple(r) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op13_conversation_repair(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))
