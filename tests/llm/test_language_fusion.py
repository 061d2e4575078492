import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortforge.llm import language_fusion as L
from cohortforge.llm import ngram_hash as H

SF = "/root/testdata/sf0.01"


def test_pages_get_their_language(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r for r in L.op10_language(spark, SF).collect()}
    assert got.keys() == pages.keys()
    truth = {i: m.group(1) for i, p in pages.items() if (m := re.search(r"/(en|fr|de|es)(/|$)", p.url or ""))}
    assert np.mean([got[i].language == t for i, t in truth.items()]) > 0.95


def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars > 200")
    model = L.TextModel.collect(L.count_languages(docs.filter("doc_id % 5 <> 0")))
    rows = docs.filter("doc_id % 5 = 0").collect()
    log, _ = model.log_likelihood(pa.array([r.text for r in rows], pa.large_string()))
    said = [model.languages[k] for k in log.argmax(axis=1)]
    assert np.mean([a == r.lang for a, r in zip(said, rows)]) > 0.95


def test_likelihood_equals_a_plain_sum(spark):
    df = spark.createDataFrame([("en", "the cat"), ("fr", "le chat"), (None, "x")], "lang string, text string")
    model = L.TextModel.collect(L.count_languages(df))
    text = "The chat, le 12"
    log, grams = model.log_likelihood(pa.array([text, ""], pa.large_string()))
    want, n = np.zeros(2), 0
    for word in (" the ", " chat ", " le "):
        for k, order in enumerate(L.ORDERS):
            for at in range(len(word) - order + 1):
                gram = word[at:at + order]
                if " " not in gram[1:-1] and not (order == 1 and at == len(word) - 1):
                    want += model.table[:, k, H.bucket(gram)]
                    n += 1
    assert np.allclose(log[0], want, rtol=1e-6) and grams[0] == n and grams[1] == 0 and (log[1] == 0).all()


def test_markup_and_host_decide_without_text(spark):
    train = spark.createDataFrame([("en", "the cat and the dog " * 20), ("fr", "le chat et la souris " * 20)],
                                  "lang string, text string")
    model = L.TextModel.collect(L.count_languages(train))
    french, english = "le chat et la souris " * 5, "the cat and the dog " * 5
    rows = [(i, "http://a.site.fr/x", f"<html lang='fr'><p>{french}</p></html>", "q") for i in range(8)]
    rows += [(20 + i, "http://b.site.com/x", f"<html lang=en><body>{english}</html>", "q") for i in range(8)]
    rows += [(40, "http://a.site.fr/empty", "<p></p>", "q"), (41, "http://new.site.org", "<html lang=fr>", "q"),
             (42, None, None, "q"), (42, None, None, "q"), (None, "no address", f"{english}&amp;", "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, language string")
    got = L.fuse(L.page_evidence(pages, model), model.languages).collect()
    by = {r.id: r.language for r in got}
    assert len(got) == len(rows) and by[40] == "fr" and by[41] == "fr" and by[None] == "en"
    assert all(by[i] == "fr" for i in range(8)) and all(by[20 + i] == "en" for i in range(8))
    assert L.fuse(L.page_evidence(pages.limit(0), model), model.languages).count() == 0
    nothing = L.TextModel.collect(L.count_languages(train.limit(0)))
    assert {r.language for r in L.fuse(L.page_evidence(pages, nothing), nothing.languages).collect()} == {"und"}


def test_visible_text_and_address():
    assert L.visible_text("<p>a<script>x<y</script><!-- z -->&eacute;</p>").split() == ["a", "é"]
    assert L.address_parts("https://u:p@WWW.Site.co:80/x?y") == ("www.site.co", "site.co", "co")
    assert L.address_parts("http://shop.example.co.uk") == ("shop.example.co.uk", "example.co.uk", "uk")
    assert L.address_parts("http://example.co.uk")[1] == "example.co.uk" and L.address_parts("http://co.uk")[1] == "co.uk"
    assert L.address_parts(None) == L.address_parts("mailto:x") == ("", "", "")


SCRIPTS = {"th": "สวัสดีครับ ที่นี่ กำลัง น้ำ", "hi": "में नहीं हिन्दी क्योंकि", "bn": "আমি বাংলায় কথা",
           "fr": "cafe\u0301 e\u0301te\u0301 l'e\u0301cole d'abord", "en": "don't well-known it's o'clock"}


def test_words_with_marks_and_inner_signs_are_evidence(spark):
    docs = spark.createDataFrame([(lang, text) for lang, text in SCRIPTS.items()], "lang string, text string")
    model = L.TextModel.collect(L.count_languages(docs))
    assert model.languages == sorted(SCRIPTS)
    asked = [*SCRIPTS.values(), "don't", "été", "7 \u2764\ufe0f 1\ufe0f\u20e3 --"]
    log, grams = model.log_likelihood(pa.array(asked, pa.large_string()))
    assert [model.languages[k] for k in log[:-1].argmax(axis=1)] == [*SCRIPTS, "en", "fr"]
    assert (grams[:-1] > 0).all() and grams[-1] == 0 and (log[-1] == 0).all()
    rows = [(i, lang, "s", text) for i, (lang, text) in enumerate(SCRIPTS.items())]
    rows += [(10, "en", "s", "don't"), (11, "en", "s", "7 --")]
    kept = L.keep_known(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string"), model, 0.3)
    assert {r.doc_id for r in kept.collect()} == {0, 1, 2, 3, 4, 10}


def test_every_language_and_value_counts(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{i:02d}": f"{letters[i % 26]}{letters[i // 26]}qu{letters[i % 26]}" for i in range(70)}
    docs = [(lang, f"{w} " * (200 - i)) for i, (lang, w) in enumerate(words.items())]
    model = L.TextModel.collect(L.count_languages(spark.createDataFrame(docs, "lang string, text string")))
    assert model.languages == sorted(words)
    log, _ = model.log_likelihood(pa.array([f"{w} {w}" for w in words.values()], pa.large_string()))
    assert [model.languages[k] for k in log.argmax(axis=1)] == list(words)
    rows = [(f"v{i}", [0.9, 0.1], 1.0) for i in range(300)] + [("", [0.5, 0.5], 1.0), ("rare", [0.0, 1.0], 1.0)]
    got = {r.declared: r.declared_log for r in L._value_given_language(
        spark.createDataFrame(rows, "declared string, text_p array<double>, grams double"), "declared", 2).collect()}
    start = 2 / 302
    assert len(got) == 302 and got[""] == [0.0, 0.0]
    assert np.allclose(got["rare"], np.log([start / 272, (1 + start) / 33]))
    assert np.allclose(np.exp([v for k, v in got.items() if k]).sum(axis=0), 1, atol=0.01)


TAGS = re.compile(r"<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})", re.I)
PIECES = st.sampled_from(["<script>", "<SCRIPT a='b'>", "</script >", "<style>", "</Style>", "<!--", "-->", "<", ">", "<p>", "x",
                          " ", "<html", " lang=", "'en", "fr'", "<html lang = de>", "<scripts>", "xlang=it", "<!-->", "\n"])


@settings(max_examples=600, deadline=None)
@given(st.lists(PIECES, max_size=14))
def test_markup_scan_equals_the_patterns(pieces):
    page = "".join(pieces)
    assert L.visible_text(page) == TAGS.sub(" ", page)
    m = DECLARED.search(page)
    assert L.declared_language(page) == (m.group(1).lower() if m else "")


def fused_by_hand(rows, m):
    """The fused posteriors of (id, host, domain, suffix, declared, grams, text_log, text_p) rows, one by one."""
    def sums(keep):
        return np.sum([np.array(r[7]) for r in rows if r[5] > 0 and keep(r)], axis=0) if any(
            r[5] > 0 and keep(r) for r in rows) else np.zeros(m)

    def given_language(k, value):
        if value == "":
            return np.zeros(m)
        values = {r[k] for r in rows if r[k]}
        start = 2 / (len(values) + 1)
        return np.log((sums(lambda r: r[k] == value) + start) / (2 + sums(lambda r: r[k] != "")))

    overall = sums(lambda r: True) + 1
    overall = overall / overall.sum()
    out = {}
    for row in rows:
        prior = overall
        own = np.array(row[7]) if row[5] > 0 else np.zeros(m)
        for level, k in (("suffix", 3), ("domain", 2), ("host", 1)):
            seen = np.maximum(sums(lambda r: r[k:4] == row[k:4]) - own, 0)
            prior = (seen + L.PULL[level] * prior) / (seen.sum() + L.PULL[level])
        log = np.array(row[6]) + np.log(np.maximum(prior, 1e-12))
        log = log + given_language(4, row[4]) + 0.25 * given_language(3, row[3])
        p = np.exp(log - log.max())
        out[row[0]] = p / p.sum()
    return out


def test_fusion_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(160):
        suffix = ["com", "fr", "de", ""][rng.integers(0, 4)]
        domain = f"d{rng.integers(0, 5)}.{suffix}" if suffix else ""
        host = f"h{rng.integers(0, 3)}.{domain}" if domain else ""
        log = rng.normal(size=3) * 2
        p = np.exp(log) / np.exp(log).sum()
        rows.append((i, host, domain, suffix, ["", "fr", "xx", "de"][rng.integers(0, 4)], float(rng.integers(0, 4)),
                     log.tolist(), p.tolist()))
    got = L.fuse(spark.createDataFrame(rows, L.EVIDENCE), ["de", "en", "fr"]).collect()
    want = fused_by_hand(rows, 3)
    assert len(got) == len(rows)
    for r in got:
        assert r.language == ["de", "en", "fr"][int(want[r.id].argmax())]
        assert abs(r.probability - want[r.id].max()) < 1e-9


def test_a_thousand_languages_take_as_many_jobs_as_two(spark):
    def jobs(n):
        docs = spark.createDataFrame([(f"l{i}", f"word{i % 26} {chr(97 + i % 26)}") for i in range(n)], "lang string, text string")
        counts = L.count_languages(docs)
        spark.sparkContext.setJobGroup(f"langs{n}", "x")
        model = L.TextModel.collect(counts)
        spark.sparkContext.setJobGroup("", "")
        assert len(model.languages) == n
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"langs{n}"))
    assert jobs(1000) <= jobs(2) + 2
