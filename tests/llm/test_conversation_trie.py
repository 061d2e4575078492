import hashlib
import zlib
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cohortforge.llm import conversation_trie as T
from cohortforge.llm.shipping import ship

SCHEMA = "conv_id long, turn long, role string, text string, path string, n int, shard int"


def brute(rows, rebuild=True):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    def order(t):
        return t[:2], hashlib.md5(f"{len(t[2])}:{t[2]}{t[3]}".encode()).hexdigest()
    convs = {c: [t[2:] for t in sorted(ts, key=order)] for c, ts in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = tuple(convs.get(base, [])[:h] + own[h:]) if rebuild else tuple(own)
    nodes = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes[path[:d]].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    out, below = [], {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves = sum(below[k][0] for k in kids[p]) or 1
        saved = sum(below[k][1] for k in kids[p]) + (len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0)
        below[p] = leaves, saved
        ends = ",".join(map(str, sorted(c for c in nodes[p] if built[c] == p)))
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(kids[p]), leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **kw):
    df = ship(spark).createDataFrame([(*r[:4], "x", 1, 2) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in T.prefix_trie(T.share_prefixes(T.turn_lists(df)), **kw).collect()), key=str)


def corpus(n, hot=None):
    rows = []
    for c in range(n):
        if hot and c % 3 == 0:
            rows += [(c, t, "user", f"hot {t}") for t in range(hot)]
            continue
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{(c // (7 ** (5 - t))) % 5}" * (t + 1))
                 for t in range(c % 6)] or [(c, 0, None, None)]
    return rows


@pytest.mark.parametrize("turns", [2, 64])
def test_equals_brute_force(spark, turns):
    rows = corpus(700)
    assert got(spark, rows, splitter_turns=turns) == brute(rows)


@pytest.mark.parametrize("hot", [4, 90])
def test_a_third_of_all_conversations_are_equal(spark, hot):
    rows = corpus(300, hot)
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows, samples_a_shard=1, splitter_turns=3) == brute(rows)


def test_nulls_ties_repeats_negative_ids_and_long_conversations(spark):
    rows = [(None, 0, "user", "no conversation"), (-5, 0, "user", "a"), (-100, None, "user", "b"), (0, 1, "x", "c"),
            (0, None, None, "first"), (7, 3, "user", "tie"), (7, 3, "user", "eit"), (7, 3, "user", "tie"),
            (8, 0, "a", "bc"), (9, 0, "ab", "c"), (350, 0, "user", None)]
    rows += [(200, t, "user", "ü" * (t % 4)) for t in range(700)] + [(201, t, "user", "ü" * (t % 4)) for t in range(650)]
    rows += [(203, 0, "user", "y" * 300_000)]
    assert got(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "user", "x")]) == []


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(-120, 320), st.one_of(st.none(), st.integers(0, 4)), st.sampled_from(["u", "a", None]),
                          st.sampled_from(["", "x", "yy", None])), max_size=80))
def test_random_tables(spark, rows):
    assert got(spark, rows, samples_a_shard=2) == brute(rows)


def test_shards_hold_whole_nodes():
    paths = sorted({bytes([a] * 16 + [b] * 16 + [c] * 16) for a in range(6) for b in range(5) for c in range(4)})
    trie = T.Skeleton(paths[::3], 7)
    for depth in (1, 2, 3):
        held = defaultdict(set)
        for p in paths:
            node = 0
            for k in range(depth):
                node = trie.children.get((node, p[16 * k:16 * k + 16])) if node is not None else None
            if node is None:
                held[p[:16 * depth]].add(trie.shard(p))
        assert all(len(s) == 1 for s in held.values())
