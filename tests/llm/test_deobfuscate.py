import zlib

import numpy as np
import pyarrow as pa
import pytest

from cohortforge.llm import deobfuscate as D
from cohortforge.llm import ngram_hash as H

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    words = ("the idiot is a moron and worthless trash of the scum these are pathetic clown loser "
             "disgusting and stupid in that house with this other thing for all of them ") * 50
    return D.CharModel.collect(D.count_characters(spark.createDataFrame([(words,)], "text string")))


def test_counts_equal_a_plain_count(spark):
    text = "Ab ba, the été 12 x3 THE!\nthe"
    got = {(r.gram_order, r.bucket): r.n for r in
           D.count_characters(spark.createDataFrame([(text,), (None,)], "text string")).collect()}
    want = {}
    spelled = " ab ba the été the the "
    for order in D.ORDERS:
        for k in range(len(spelled) - order + 1):
            gram = spelled[k:k + order]
            if " " not in gram[1:-1]:
                key = order, H.bucket(gram)
                want[key] = want.get(key, 0) + 1
    assert got == want


@pytest.mark.parametrize("raw, clean", [("1d10t", "idiot"), ("m0r0n", "moron"), ("w.o.r.t.h.l.e.s.s", "worthless"),
                                        ("idiooooot", "idiot"), ("tr@sh", "trash"), ("$cum", "scum"), ("l0$er", "loser"),
                                        ("p-a-t-h-e-t-i-c", "pathetic"), ("i d i o t", "idiot")])
def test_viterbi_restores(model, raw, clean):
    _, codes, words = D.restored_words(pa.array([f"the {raw} house"], pa.large_string()), D.Restorer(model))
    assert clean in {words[c] for c in codes}


def test_viterbi_is_the_best_path(model):
    """Against every path of the lattice."""
    for observed in ("m0r", "id!", "t@@n", "s c", "a.b1"):
        paths = [("", "   ", 0.0)]
        for i in range(len(observed)):
            nxt = []
            for out, ctx, cost in paths:
                for emit, c in D._options(observed, i):
                    if emit == "" or emit == " " and ctx[-1] == " ":
                        nxt.append((out, ctx, cost + c))
                    else:
                        nxt.append((out + emit, ctx[1:] + emit, cost + c + model.cost(ctx, emit)))
            paths = nxt
        best = min(paths, key=lambda p: p[2] + (model.cost(p[1], " ") if p[1][-1] != " " else 0.0))
        assert D.decode(observed, model) == best[0].strip()


def test_clean_words_stay(model):
    text = "The house, with 12 things! a b"
    rows, codes, words = D.restored_words(pa.array([text], pa.large_string()), D.Restorer(model))
    assert sorted(words[c] for c in codes) == sorted(["the", "house", "with", "12", "things", "a", "b"])


def test_held_out_accuracy_and_fold(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    got = {r.doc_id: r for r in D.op1_toxicity(spark, SF).collect()}
    assert len(got) == 1000
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.85


def test_edges(spark, model):
    df = spark.createDataFrame([(1, None), (1, ""), (None, "x" * 50_000 + " a" * 20_000), (2, "!!! 123")],
                               "doc_id long, text string")
    scorer = D.Scorer({"idiot": 3.0}, np.array([-2.0, 1.0, 1.0, 1.0]))
    got = D.score_texts(df, model, scorer).collect()
    assert len(got) == 4 and len({r.score for r in got}) == 1
    assert D.score_texts(df.limit(0), model, scorer).count() == 0
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    empty = D.fit_scorer(D.training_words(df, none, model))
    assert {r.score for r in D.score_texts(df, model, empty).collect()} == {0.0}
    kept = D.reject_toxic(df.withColumn("score", df.doc_id), model, D.Scorer({}, np.array([-2.0, 0, 0, 0])))
    assert kept.count() == 4 and kept.columns == ["doc_id", "text", "score"]


@pytest.mark.parametrize("raw, clean", [("idio+", "idiot"), ("+rash", "trash"), ("(lown", "clown"), ("*diot", "idiot"),
                                        ("!d!0t", "idiot"), ("!diot", "idiot"), ("+ra$h!", "trash"), ("|oser,", "loser"),
                                        ("1 d 1 0 t", "idiot"), ("m 0 r 0 n", "moron"), ("id iot", "idiot"),
                                        ("st up id", "stupid"), ("tr @ sh", "trash"), ("!di ot", "idiot")])
def test_end_signs_and_cut_words_are_restored(model, raw, clean):
    _, codes, words = D.restored_words(pa.array([f"these {raw} house"], pa.large_string()), D.Restorer(model))
    assert clean in {words[c] for c in codes}


def test_clean_ends_and_short_words_stay(model):
    text = "(The house!) *things* of the them! these, all: is a house|"
    _, codes, words = D.restored_words(pa.array([text], pa.large_string()), D.Restorer(model))
    assert sorted(words[c] for c in codes) == sorted("the house things of the them these all is a house".split())


@pytest.mark.parametrize("raw, cut", [("ééécole", "éécole"), ("ддддурак", "ддурак"), ("idiooot", "idioot"), ("ééé", "éé")])
def test_runs_of_any_letter_are_looked_at(raw, cut):
    class Seen(D.Restorer):
        def restore(self, raw):
            asked.append(D._RUN.sub(r"\1\1", raw))
            return [raw]
    asked = []
    D.restored_words(pa.array([f"the {raw} école"], pa.large_string()), Seen(None))
    assert asked[0] == cut


def test_regression_takes_four_numbers_a_row(spark, model):
    rows = [(i, f"idiot scum number{i} loser trash moron" if i % 2 else f"clean house number{i} thing other") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    scorer = D.fit_scorer(D.training_words(docs, labels, model))
    got = {r.doc_id: r.score for r in D.score_texts(docs, model, scorer).collect()}
    assert len(scorer.beta) == 4 and np.mean([(s >= 0.5) == i % 2 for i, s in got.items()]) > 0.98
