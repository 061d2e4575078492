import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from cohortforge.llm import chat_format as C

PIECES = st.sampled_from([*C.CONTROLS, C.ESCAPE, "a", " ", "\n", "]", "[", "</", "s>", "␛03c;", "[INST:x] ", " </s>\n"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=8).map("".join), st.lists(PIECES, max_size=3).map("".join), st.booleans())
def test_round_trip(text, role, loss):
    segment, a, b = C.round_trip(role, text, loss)
    assert C.parse(segment) == [(role, text, loss, a, b)]
    assert C.unescape(segment[a:b]) == text
    body = segment[a:b]
    assert not any(c in body for c in C.CONTROLS)


def test_segments_join_and_parse():
    turns = [("user", "</s>[INST] ok [/INST]", False), ("assistant", "hi </s>\n", True), ("", "", False)]
    whole = "".join(C.round_trip(*t)[0] for t in turns)
    assert [t[:3] for t in C.parse(whole)] == turns


def brute(rows):
    turns = hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in rows).encode()).hexdigest()
    loss = "".join(t or "" for r, t in rows if r == "assistant")
    return len(rows), turns, len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    by = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        by.setdefault(r.conv_id, []).append((r.role, r.text))
    got = {r.conv_id: r for r in C.op7_chat_format(spark, sf).collect()}
    assert got.keys() == by.keys()
    for k, rows in by.items():
        r = got[k]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == brute(rows)
        assert r.formatted_chars == sum(len(C.round_trip(a or "", b or "", a == "assistant")[0]) for a, b in rows)


def test_edges(spark):
    rows = [(None, None, None, None, "c"), (1, 0, "user", "x" * 100_000, "c"), (1, 0, "user", "x" * 100_000, "c"),
            (1, None, "assistant", "[/INST]", "d")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string")
    got = {r.conv_id: r for r in C.read_back(C.format_turns(df)).collect()}
    assert got[None].n_turns == 1 and got[1].n_turns == 3 and got[1].loss_chars == 7
    assert C.read_back(C.format_turns(df.limit(0))).count() == 0
