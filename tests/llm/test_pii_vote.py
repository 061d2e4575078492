import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortforge.llm import pii_vote as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    t = [int(c) for c in d][::-1]
    return (sum(t[0::2]) + sum(sum(divmod(2 * x, 10)) for x in t[1::2])) % 10 == 0


def brute(text):
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text)
            if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.1 -+()9%é4\n0", max_size=60))
def test_base_spans_equal_plain_patterns(text):
    assert P.base_spans(text) == brute(text)


CASES = ["a.b@c.d.e, x@y", "@a.b c@@d.e f@g.h@i.j", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.4",
         "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (234) 567-8901 4111111111111111",
         "call me on (234) 567-8901 or 0049 30 1234567", "jane at mail dot example dot com", "é" * 10 + " a@b.cc"]


def test_base_spans_cases_and_long_runs():
    for t in CASES:
        assert P.base_spans(t) == brute(t), t
    for run in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 50_000, "+1" * 50_000):
        P.candidates(run)  # linear, so it ends


def test_labelers_add_what_the_base_misses():
    docs = CASES + ["mail bob at host dot org", "phone (234) 567-8901", "version 1.2.3.4444"] * 3
    counts = {}
    for t in docs:
        for c in P.candidates(t):
            counts[c[4]] = counts.get(c[4], 0) + 1
    accept = {p for p, v in P.fit(sorted(counts.items())).items() if v >= 0.5}
    added = [t[a:b] for t in docs for k, a, b, base in P.choose(P.candidates(t), accept) if not base]
    assert "bob at host dot org" in added and "(234) 567-8901" in added
    assert "1.2.3.4444" not in added
    assert P.redact_text("phone (234) 567-8901, a@b.cc.", accept) == "phone [PHONE], [EMAIL]."


def test_em_finds_the_reliable_labeler():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.5
    counts = {}
    for y in truth:
        votes = []
        for right in (0.95, 0.9, 0.6, 0.85):
            votes.append(P.YES if (rng.random() < right) == y else P.NO)
        code = 0
        for v in votes:
            code = code * 3 + v
        counts[code * 16] = counts.get(code * 16, 0) + 1
    soft, rates = P.estimate(np.array(list(counts)), np.array(list(counts.values())))
    hit = rates[0, 1, :, P.YES]
    assert hit.argmin() == 2 and hit[0] > 0.9


def test_query_edges(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, CASES[4], "z"), (3, CASES[4], "z"), (None, "a@b.cc", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kinds string")
    found = P.find_candidates(df)
    got = sorted(P.report(found, P.fit_on(found)).collect(), key=str)
    assert len(got) == 5
    for r in got:
        text = {1: "", 2: "", 3: CASES[4], None: "a@b.cc"}[r.doc_id] or ""
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(text))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert P.report(P.find_candidates(df.limit(0)), set()).collect() == []
    red = P.redact(df)
    assert red.columns == df.columns and red.filter("doc_id is null").first().text == "[EMAIL]"


def test_whole_table_against_plain_patterns(spark):
    got = {r.doc_id: r for r in P.op4_pii_vote(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(r.text or ""))
        assert got[r.doc_id].base_sha256 == hashlib.sha256(want.encode()).hexdigest()


@settings(max_examples=400, deadline=None)
@given(st.tuples(st.sampled_from(["jane", "x ", ""]), st.sampled_from([" at ", "[at]", " [AT] ", "(At)", " "]),
                 st.sampled_from(["corp", "x ", ""]), st.sampled_from([".", " dot ", "[DOT]", " (Dot) ", " ", "@"]),
                 st.sampled_from(["org", "-", ". 7", ""])).map("".join))
def test_the_prefilter_skips_no_candidate(text):
    if not pc.match_substring_regex(pa.array([text]), P._ANY)[0].as_py():
        assert P.candidates(text) == []


def test_plain_dots_and_capitals_are_candidates(spark):
    texts = ["write to jane [at] example.com now", "mail bob at corp.org please", "mail bob AT corp [DOT] org", "we met at home."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = {r.doc_id: r.kinds for r in P.find_candidates(df).collect()}
    assert kinds == {0: [0], 1: [0], 2: [0], 3: []}
    assert [r.text for r in P.redact(df).orderBy("doc_id").collect()] == [
        "write to [EMAIL] now", "mail [EMAIL] please", "mail [EMAIL]", "we met at home."]


SPAN = st.tuples(st.integers(0, 3), st.integers(0, 40), st.integers(1, 12), st.booleans(), st.integers(0, 2))


@settings(max_examples=300, deadline=None)
@given(st.lists(SPAN, max_size=25))
def test_chosen_additions_equal_brute_force(spans):
    found = [(k, a, a + n, base, p) for k, a, n, base, p in spans]
    out, taken = [c[:4] for c in found if c[3]], []
    for c in sorted((c for c in found if not c[3] and c[4] != 1), key=lambda c: (c[1] - c[2], c[1], c[0])):
        if all(c[2] <= a or c[1] >= b for a, b in taken):
            taken.append(c[1:3])
            out.append(c[:4])
    assert P.choose(found, {0, 2}) == sorted(out, key=lambda c: (c[0], c[1]))


def test_parts_of_a_phone_that_ran_on():
    text = "+1 234 567 8901  22 3456 7890 12"
    parts = [text[:b] for b in P._phone_parts(text, 0, len(text))]
    assert parts == ["+1 234 567 8901", "+1 234 567 8901  22"]
