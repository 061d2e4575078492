import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cohortforge.llm import lempel_ziv_spans as L
from cohortforge.llm.shipping import ship
from conftest import SF_SMALL

SCHEMA = "doc_id long, text string, key string, h int, n_words int, block int"


def brute(rows):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in split:
        if d is not None:
            for i in range(len(w) - 12):
                g = tuple(w[i:i + 13])
                first[g] = min(first.get(g, d), d)
    out = []
    for d, w in split:
        gone = set()
        if d is not None:
            for i in range(len(w) - 12):
                if first[tuple(w[i:i + 13])] < d:
                    gone.update(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept if gone else None))
    return sorted(out, key=str)


def removed(spark, rows):
    df = ship(spark).createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in L.remove_duplicates(df).collect()), key=str)


def corpus(n, seed, vocabulary=4000):
    rng = random.Random(seed)
    vocab = [f"w{k}é" if k % 9 == 0 else f"w{k}" for k in range(vocabulary)]
    line = rng.choices(vocab, k=15)
    passages = [rng.choices(vocab, k=rng.randint(10, 60)) for _ in range(12)]
    rows, made = [], []
    for i in range(n):
        w = rng.choices(vocab, k=rng.randint(0, 160))
        roll = rng.random()
        if made and roll < 0.2:
            w = list(rng.choice(made))
            for _ in range(rng.randint(0, 4)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
        elif roll < 0.5:
            p = rng.choice(passages)
            a = rng.randint(0, 8)
            at = rng.randint(0, len(w))
            w = w[:at] + p[a:len(p) - rng.randint(0, 8)] + w[at:]
        if i % 3 == 0:
            at = rng.randint(0, len(w))
            w = w[:at] + line + w[at:]
        made.append(w)
        rows.append((rng.randrange(10 * n), rng.choice([" ", "\n", "\t \x0b"]).join(w)))
    return rows


@pytest.mark.parametrize("seed,vocabulary", [(1, 4000), (2, 6)])
def test_equals_brute_force(spark, seed, vocabulary):
    rows = corpus(260, seed, vocabulary)
    assert removed(spark, rows) == brute(rows)


def test_salted_grams_and_copied_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "FREQUENT", 3)
    monkeypatch.setattr(L, "BLOCK_GRAMS", 100)
    rows = corpus(220, 5)
    assert removed(spark, rows) == brute(rows)


def test_a_third_of_all_rows_are_copies(spark):
    rows = corpus(150, 3)
    text = " ".join(f"c{k}" for k in range(40))
    rows += [(9000 + i, text if i % 2 else text + " tail" + str(i)) for i in range(90)]
    assert removed(spark, rows) == brute(rows)


def test_nulls_empty_repeats_shared_ids_and_very_long_texts(spark):
    a = " ".join(f"a{k}" for k in range(30))
    long = " ".join(f"v{k % 50_000}" for k in range(120_000))
    rows = [(None, a), (None, a), (1, None), (2, ""), (3, " \n\t "), (4, a), (4, a), (4, "x " + a + " y"), (4, "b " * 40),
            (5, a + " end"), (6, "b " * 14), (6, "short"), (-7, "z " + a), (7, a.upper()), (8, "nb sp " * 13),
            (9, "nb sp " * 20), (10, long), (11, "start " + long + " end"), (12, "one two three")]
    assert removed(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert removed(spark, []) == []


def test_a_window_its_grams_owner_has_in_other_words(spark):
    # document 1 owns the grams, only 2 and 3 share whole windows
    core = [f"k{i}" for i in range(6)]
    rows = [(1, " ".join(f"p{i}" for i in range(9)) + " " + " ".join(core) + " q q q q q q q q"),
            (2, " ".join(f"r{i}" for i in range(5)) + " " + " ".join(core) + " s s t u"),
            (3, "other " + " ".join(f"r{i}" for i in range(5)) + " " + " ".join(core) + " s s t u v")]
    assert removed(spark, rows) == brute(rows)
    assert brute(rows)[2][2] == 15


def test_testdata(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = sorted((tuple(r) for r in L.op12_lempel_ziv(ship(spark), SF_SMALL).collect()), key=str)
    assert got == sorted((r[:4] for r in brute(rows)), key=str)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-3, 12)), st.lists(st.sampled_from("abc"), max_size=40)), max_size=14))
def test_random_tables(spark, rows):
    rows = [(d, " ".join(w)) for d, w in rows]
    assert removed(spark, rows) == brute(rows)


def test_window_grams_are_minima():
    codes = np.random.default_rng(1).integers(0, 2**63, 60).astype(np.uint64)
    g = L._runs(codes, L.GRAM, L._GRAM_BY)
    want = [min(g[i:i + L.WINDOW - L.GRAM + 1]) for i in range(60 - L.WINDOW + 1)]
    assert L.window_grams(codes).tolist() == want
    assert len(L.window_grams(codes[:12])) == 0


def test_words_split_at_ascii_space_only():
    offsets, codes, _, words = L.word_codes(pa.array(["a\x0bb\x0cc\r\n d e", "", "a"], pa.large_string()))
    assert offsets.tolist() == [0, 4, 4, 5] and codes[0] == codes[4]
    assert words.to_pylist()[:4] == ["a", "b", "c", "d\u2003e"]
