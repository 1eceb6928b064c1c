"""The trie of conversation prefixes against one built in memory, and on awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyhand.llm import common, prefix_trie

TURNS = "conv_id long, turn long, role string, text string, depth int, block string, k1 int, said string, saved string"
ABSENT = hashlib.sha256(b"").hexdigest()


def conversations(spark, rows):
    """Turns with more columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, 1, "x", 2, "y", "z") for r in rows], TURNS)


def brute(rows, forked=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    said = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()
    own = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: (*x[:2], said(*x[2:])))] for c, v in own.items()}
    paths = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if forked else 0
        paths[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, path in sorted(paths.items()):
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, who in members.items():
        worth = (len(who) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += worth
    out = Counter()
    for node, who in members.items():
        ends = ",".join(str(c) for c in who if paths[c] == node)
        out[who[0], len(node), members[node[:-1]][0] if node else None, len(who), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def found(table, **kw):
    return Counter((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in prefix_trie.prefix_trie(table, **kw).collect())


def made_up(seed, n=260):
    """Conversations of few words, so that many share turns; some absent firsts of families, some long, some equal."""
    draw = np.random.default_rng(seed)
    rows = []
    for c in range(-30, n):
        if c % 40 == 20:
            continue
        for t in range(int(draw.integers(1, 6)) if c % 50 else 45):
            rows.append((c, t, ("user", "assistant")[t % 2], ("a b", "a  b c", "x")[int(draw.integers(0, 3))] if t < 3 else f"turn {t} of {c % 7}"))
    return rows


AWKWARD = [
    (1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (2, 5, "a", "b c"), (2, -1, "a", "b"), (None, 1, "user", "lost"), (None, None, None, None),
    (3, 1, "a:b", "c"), (23, 1, "a", "b:c"), (40, 0, "u", "x " * 5000), (41, 0, "u", "x " * 5000), (43, 1 << 40, "u", "late"), (43, None, "u", "first"), ((1 << 60) + 1, 0, "u", "big id"),
]


@pytest.mark.parametrize("rows", [made_up(1), AWKWARD, AWKWARD + made_up(2, 60)], ids=["many", "awkward", "both"])
@pytest.mark.parametrize("bits", [None, (2, 8)])
@pytest.mark.parametrize("forked", [True, False])
def test_trie(spark, monkeypatch, rows, bits, forked):
    if bits:  # blocks of 4 turns, and a sketch so small that it proves little
        monkeypatch.setattr(prefix_trie, "BLOCK_BITS", bits[0])
        plain = prefix_trie.trie
        monkeypatch.setattr(prefix_trie, "trie", lambda *a: plain(*a, most_bits=bits[1]))
    assert found(conversations(spark, rows).repartition(3), forked=forked) == brute(rows, forked)


def test_trie_of_the_table(spark, sf_dir):
    table = common.table(spark, sf_dir, "conversations")
    assert found(table) == brute([tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in table.collect()])


def test_many_equal_conversations(spark):
    rows = [(c, t, "u", f"turn {t}") for c in range(9000) for t in range(3)]
    assert found(conversations(spark, rows)) == brute(rows)


def test_turnless_conversations_end_at_the_root(spark):
    rows = [(c, 0, "u", "only") for c in range(1, 20)] + [(c, 0, "u", "other") for c in range(21, 24)]
    got = found(conversations(spark, rows))
    assert got == brute(rows) and any(r[1] == 0 and r[7] != ABSENT for r in got)


def test_no_conversations(spark):
    assert found(conversations(spark, [])) == Counter()


def test_the_sketch_never_calls_a_shared_prefix_single(spark):
    draw = np.random.default_rng(3)
    once, twice = draw.integers(-(1 << 62), 1 << 62, (2000, 2)), draw.integers(-(1 << 62), 1 << 62, (300, 2))
    held = spark.createDataFrame([(int(a), int(b)) for a, b in [*once, *twice, *twice]], "k1 long, k2 long").repartition(5)
    for bits in (8, 12, 18):
        seen = spark.sparkContext.broadcast(prefix_trie.sketch(held, bits))
        told = {(r["k1"], r["k2"]) for r in held.where(prefix_trie.maybe_shared(seen, bits, "k1", "k2")).collect()}
        assert {(int(a), int(b)) for a, b in twice} <= told
        if bits == 18:
            assert len(told) < 320


def test_only_prefixes_that_may_be_shared_are_grouped(spark, monkeypatch):
    """Conversations that part at their second turn: the trie's groups are the root and the first turn."""
    rows = [(c, t, "u", "same" if t == 0 else f"{c} {t}") for c in range(1, 200) for t in range(30)]
    sizes = {}

    def counted(df, name):
        held = common.written(df, name)
        sizes[name] = held.count()
        return held

    monkeypatch.setattr(prefix_trie, "written", counted)
    assert found(conversations(spark, rows), forked=False) == brute(rows, False)
    assert sizes["prefixes"] == 199 * 30 and sizes["shared"] < 199 + 20 and sizes["groups"] < 2 + 20
