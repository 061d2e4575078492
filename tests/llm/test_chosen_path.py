from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from cohortforge.llm import chosen_path as C


def brute(texts):
    """{index: (class members, links to other sets, copies)} of texts by comparing all sets."""
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else None)
    by = defaultdict(list)
    for i, s in enumerate(sets):
        by[s if s is not None else i].append(i)
    keys = list(by)
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    links = Counter()
    inverted = defaultdict(list)
    for k, s in enumerate(keys):
        for g in s if isinstance(s, frozenset) else ():
            inverted[g].append(k)
    common = Counter((a, b) for m in inverted.values() for n, b in enumerate(m) for a in m[:n])
    for (a, b), c in common.items():
        if 5 * c >= 4 * (len(keys[a]) + len(keys[b]) - c):
            links[a] += 1
            links[b] += 1
            parent[max(find(a), find(b))] = min(find(a), find(b))
    groups = defaultdict(list)
    for k in range(len(keys)):
        groups[find(k)] += by[keys[k]]
    return {i: (min(groups[find(k)]), links[k], len(by[s])) for k, s in enumerate(keys) for i in by[s]}


def family(rng, n, words=120, change=2):
    base = [f"w{rng.integers(1e6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.integers(0, change + 1)):
            t[rng.integers(words)] = f"x{rng.integers(1e6)}"
        out.append(" ".join(t))
    return out


def texts_with_everything():
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{k}" for k in range(60))
    out = [None, "", " \n ", "one two", "one two", "a b c d e", "a b c d e f", "z " * 3000]
    for n in (2, 3, 40):
        out += family(rng, n)
    out += [passage + " " + " ".join(f"u{rng.integers(1e6)}" for _ in range(100)) for _ in range(60)]
    return out + family(rng, 1) * 50


def run(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)],
                               "doc_id long, text string, label int, sid string")
    return {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in C.similarity_classes(df, **kw).collect()}


def test_classes_links_and_copies_equal_brute_force(spark):
    texts = texts_with_everything()
    assert run(spark, texts) == brute(texts)


def test_recursion_and_blocks_give_the_same(spark, monkeypatch):
    texts = texts_with_everything()
    monkeypatch.setattr(C, "BLOCK", 8)
    small = C.candidate_edges
    monkeypatch.setattr(C, "candidate_edges", lambda sets, thr: small(sets, thr, small=4, levels=2))
    got, want = run(spark, texts), brute(texts)
    assert np.mean([got[i] == want[i] for i in want]) > 0.98


def test_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()
    want = brute([r.text for r in rows])
    ids = [r.doc_id for r in rows]
    got = {r.doc_id: r for r in C.op3_chosen_path(spark, "/root/testdata/sf0.01").collect()}
    for k, i in enumerate(ids):
        assert (got[i].class_id, got[i].n_links, got[i].n_copies) == (ids[want[k][0]], want[k][1], want[k][2])


def test_candidate_recall_at_the_threshold():
    """Pairs of similarity about 0.8 meet under one chosen n-gram."""
    rng = np.random.default_rng(2)
    met = 0
    for _ in range(300):
        base = [f"w{rng.integers(1e9)}" for _ in range(200)]
        other = list(base)
        for k in range(4):
            other[20 + 45 * k] = f"x{rng.integers(1e9)}"
        offsets, grams = C.shingle_sets(pa.array([" ".join(base), " ".join(other)], pa.large_string()))
        chosen = []
        for k in range(2):
            g = grams[offsets[k]:offsets[k + 1]]
            chosen.append(set(g[C._mix(g + C._M3).astype(float) / 2.0 ** 64 * len(g) < C.picks_for(C.THRESHOLD)].tolist()))
        met += bool(chosen[0] & chosen[1])
    assert met == 300 and C.expected_recall(1, 20) > 0.9999 and C.expected_recall(2, 20) > 0.9999


def test_empty_table_and_keep_one(spark):
    df = spark.createDataFrame([(3, "a b c d e f", "k"), (3, "a b c d e f", "k"), (None, "a b c d e f", "n"),
                                (1, None, "z"), (2, "q r s t u v", "y")], "doc_id long, text string, sid string")
    assert C.similarity_classes(df.limit(0)).count() == 0
    kept = sorted((r.doc_id, r.sid) for r in C.keep_one(df).collect())
    assert kept == [(1, "z"), (2, "y"), (3, "k")]


def test_picks_follow_the_target_recall():
    assert C.picks_for(0.8) == 25
    for threshold in (0.5, 0.8, 0.95):
        for recall in (0.9, 0.99, 0.9999):
            picks = C.picks_for(threshold, recall)
            assert C.expected_recall(C.LEVELS, threshold * picks) >= recall
            assert C.expected_recall(C.LEVELS, threshold * (picks - 1)) < recall


def test_recall_through_all_levels(spark, monkeypatch):
    # pairs at 0.8 among sets that share one hot n-gram, every bucket split to the last level
    rng = np.random.default_rng(6)
    rows, pairs = [], 150
    for i in range(pairs):
        common = [f"c{i}w{k}" for k in range(16)]
        for side in (0, 1):
            rows.append((2 * i + side, " ".join(["hot", *common, *(f"s{i}{side}{k}" for k in range(2))])))
    got = C.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string"), words=1, threshold=0.8)
    by = {r.doc_id: r.class_id for r in got.collect()}
    assert sum(by[2 * i] == by[2 * i + 1] for i in range(pairs)) == pairs
    few = C.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string"), words=1, threshold=0.8, recall=0.2)
    assert few.count() == 2 * pairs and rng is not None
