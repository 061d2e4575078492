"""Texts and pages of a megabyte that once took quadratic time."""

import time

import pytest

from cohortforge.llm import language_fusion as L
from cohortforge.llm import pii_vote as P

MB = 1 << 20


def within(seconds, fn, *args):
    t0 = time.perf_counter()
    out = fn(*args)
    assert time.perf_counter() - t0 < seconds
    return out


@pytest.mark.parametrize("text", ["+" + "12 " * (MB // 3), "+1 " + " " * MB + "9", ("+1 (" + "- " * 50) * (MB // 104),
                                  "a@" * (MB // 2), "1.2." * (MB // 4), "00112 ((" * (MB // 8)])
def test_personal_data_in_long_texts(text):
    found = within(15, P.candidates, text)
    within(5, P.choose, found, {c[4] for c in found})


def test_many_loose_addresses():
    text = " ".join(f"user{i} [at] host{i} [dot] com" for i in range(50_000))
    found = within(20, P.candidates, text)
    assert len(found) == 50_000
    kept = within(5, P.choose, found, {c[4] for c in found})
    assert len(kept) == 50_000 and kept == sorted(kept)


@pytest.mark.parametrize("piece", ["<script>x ", "<style><script>", "<!-- a ", "<", "<a ", "<html ", "<html lang", "</script ",
                                   "<html>", "<!---->", "<SCRIPT>a</script>", "&amp"])
def test_unclosed_markup(piece):
    page = piece * (MB // len(piece))
    within(4, L.visible_text, page)
    within(4, L.declared_language, page)
    within(4, L.visible_text, page + "<p>x</p>")
