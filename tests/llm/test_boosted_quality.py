import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zlib

from cohortforge.llm import boosted_quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i:i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit))


CASES = ["", " \n\t ", "a b c a b c", "a b c d\na b c d\n\n \na b c d", "x " * 400, "é\x0bñ|#\x1cz a\x85b", "a\xa0b c"]


def test_counts_equal_brute_force(spark):
    rows = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = Q.text_counts(pa.array(CASES + rows, pa.large_string()))
    for i, t in enumerate(CASES + rows):
        assert tuple(int(got[c][i]) for c in Q.COUNTS) == brute(t), t[:80]


def test_monotone_and_flat_scoring():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 2))
    y = ((x[:, 0] < 0.5) ^ (rng.random(3000) < 0.1)).astype(float)
    trees = Q.fit_trees(x, y, np.array([-1, 0]), n_trees=30)
    grid = np.column_stack([np.linspace(0, 1, 200), np.full(200, 0.3)])
    assert (np.diff(trees.score(grid)) <= 1e-12).all()
    assert ((trees.score(x) >= 0.5) == (x[:, 0] < 0.5)).mean() > 0.95

    def walk(row):  # one row, node by node
        out = trees.start
        for n in trees.roots:
            while trees.feature[n] >= 0:
                n = trees.left[n] if row[trees.feature[n]] <= trees.threshold[n] else trees.right[n]
            out += trees.value[n]
        return out
    assert np.allclose([walk(r) for r in x[:50]], trees.margin(x[:50]))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    stats = Q.document_stats(spark.read.parquet(f"{sf}/documents.parquet"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    train = [r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    model = Q.fit_quality(stats, labels.filter(labels.doc_id.isin(train)))
    score = {r.doc_id: r.score for r in Q.judge(stats, model).collect()}
    held = [(score[r.doc_id] >= 0.5, r.quality == 1) for r in labels.collect() if r.doc_id not in train]
    assert np.mean([a == b for a, b in held]) > 0.9


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (1, "a b c " * 60, 2), (None, "", 3)],
                               "doc_id long, text string, score int")
    stats = Q.document_stats(df)
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = Q.judge(stats, Q.fit_quality(stats, none)).collect()
    assert len(got) == 3 and not any(r.kept for r in got)
    assert Q.document_stats(df.limit(0)).count() == 0


def test_fit_takes_a_bounded_sample_of_all_ids(spark, monkeypatch):
    n = 6000
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "### $$$ ") * (3 + i % 7)) for i in range(n)]
                                 + [(17, "copy " * 9)] * 3000, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(n)] + [(17, 1)] * 3000 + [(None, 1)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(Q, "fit_trees", lambda x, y, m: seen.append(y))
    for bound in (1000, 3200, 20_000):
        Q.fit_quality(Q.document_stats(docs), labels, bound)
        want = min(n, bound * n / (n + 3000))
        assert abs(len(seen[-1]) - want) <= 5 * want ** 0.5
        assert abs(seen[-1].mean() - 0.5) < 0.06
