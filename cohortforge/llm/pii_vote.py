"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Candidate spans of a text are the base matches (email, ip, card, phone), base
matches that fail their check, and looser forms that the base patterns can't
match (``name at host dot com``, a phone number without ``+``, a card number
with other separators, a dotted address in brackets).  Four labelers vote yes,
no or abstain on each candidate:

* regex      -- the strict pattern with its check
* shape      -- checksum, octet range or digit count
* gazetteer  -- top-level domains, calling codes, issuer prefixes, address blocks
* context    -- words just before the span that name the kind, or another thing

Votes are counted per pattern by Spark (a few hundred patterns, however large
the corpus), expectation-maximisation estimates each labeler's reliability and
each pattern's probability, and a logistic classifier over votes and span
features is trained on those soft labels.  A base span always stays; any other
candidate is added when the classifier gives it 0.5 or more.  Added spans don't
overlap base spans or each other.

All scans are linear in the text: patterns that could retry inside one run of
characters are anchored at the run's start, which finds the same matches.

Defined results: a null or empty text has no spans; repeated ids are separate
rows; an empty table gives no rows; other columns are ignored by the query and
kept by ``redact``.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.session import stage_path

KINDS = ["email", "ip", "card", "phone"]
LABELERS = ["regex", "shape", "gazetteer", "context"]
ABSTAIN, YES, NO = 0, 1, 2

# Fixed values of the gazetteers.
TLDS = set("com org net edu gov int mil info io co uk de fr es it nl pt eu us ca au ch at be se no dk fi pl "
           "cz ru cn jp kr in br mx ar cl za dev app biz me tv test local".split())
CALLING_CODES = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 "
                    "64 65 66 81 82 84 86 90 91 92 351 352 353 354 358 420 421".split())
CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "22", "23", "24", "25", "26", "27")
CONTEXT = {
    "email": {"email", "e-mail", "mail", "contact", "write", "correo", "courriel", "adresse"},
    "ip": {"ip", "address", "host", "server", "adresse", "client", "from"},
    "card": {"card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta", "payment"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "téléphone", "teléfono", "cell"},
}
OTHER_CONTEXT = {"order", "invoice", "isbn", "version", "serial", "id", "no", "number", "page", "section", "v"}

_AT_RIGHT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[( ](?i:at)[\]) ] ?[A-Za-z0-9-]++"
                        r"(?: ?[\[( ](?i:dot)[\]) ] ?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)+"),
    "ip": re.compile(r"(?<![0-9.])[0-9]++(?:[\[(]\.[\])][0-9]++){3}"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+(.-])(?:00[0-9]|\([0-9]{2,4}\)|[0-9]{3}[\x20.-])[\x20().0-9-]{5,17}(?![0-9])"),
}
# a text without any of these has no candidate: all other patterns need a digit or @
_ANY = r"[0-9@]|[\[( ](?i:at)[\]) ] ?[A-Za-z0-9-]+(?: ?[\[( ](?i:dot)[\]) ]|\.)"


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octets_ok(s: str) -> bool:
    parts = [p.strip("[]()") for p in re.split(r"[\[(]?\.[\])]?", s)]
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def _card_ok(s: str) -> bool:
    d = _only_digits(s)
    return 16 <= len(d) <= 19 and luhn(d)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, found from each ``@`` outwards."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _AT_RIGHT.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_matches(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, passes its check) of every base match, by kind as listed."""
    if "@" in text:
        for a, b in _emails(text):
            yield "email", a, b, True
    for m in _IP.finditer(text):
        yield "ip", m.start(), m.end(), _octets_ok(m.group())
    for m in _CARD.finditer(text):
        yield "card", m.start(), m.end(), _card_ok(m.group())
    if "+" in text:
        for m in _PHONE.finditer(text):
            n = sum("0" <= c <= "9" for c in m.group())
            yield "phone", m.start(), m.end(), 8 <= n <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    return [(k, a, b) for k, a, b, ok in base_matches(text) if ok]


def _context_vote(kind: str, text: str, start: int) -> int:
    words = [w.strip(".,:;()[]#").lower() for w in text[max(0, start - 40):start].split()[-4:]]
    if any(w in CONTEXT[kind] for w in words):
        return YES
    return NO if any(w in OTHER_CONTEXT for w in words) else ABSTAIN


def _votes(kind: str, text: str, a: int, b: int, strict: bool, base: bool) -> tuple[int, int, int, int]:
    s = text[a:b]
    d = _only_digits(s)
    if kind == "email":
        last = re.split(r"[^A-Za-z0-9]+", s)[-1].lower()
        shape = YES if 2 <= len(last) <= 6 and last.isalpha() else NO
        gaz = YES if last in TLDS else NO
    elif kind == "ip":
        shape = YES if _octets_ok(s) else NO
        first = d and s.lstrip("[(")[:3].split(".")[0].strip("[]()")
        gaz = NO if first in ("0", "") else ABSTAIN
    elif kind == "card":
        shape = YES if _card_ok(s) else NO
        gaz = YES if d.startswith(CARD_PREFIXES) else NO
    else:
        shape = YES if 8 <= len(d) <= 15 else NO
        code = d.removeprefix("00") if s.startswith("00") else d
        known = any(code.startswith(c) for c in CALLING_CODES)
        gaz = (YES if known else NO) if s[0] in "+0" else ABSTAIN
    return (YES if strict else NO if base else ABSTAIN), shape, gaz, _context_vote(kind, text, a)


def _pattern(kind: str, text: str, a: int, b: int, votes: tuple[int, int, int, int]) -> int:
    """Votes and span features as one small integer (KINDS x 81 x 2 x 2 x 4 values)."""
    code = KINDS.index(kind)
    for v in votes:
        code = code * 3 + v
    before = a > 0 and text[a - 1].isalnum()
    after = b < len(text) and text[b].isalnum()
    size = min(3, sum("0" <= c <= "9" for c in text[a:b]) // 6)
    return ((code * 2 + before) * 2 + after) * 4 + size


def unpack(pattern: int) -> tuple[int, list[int], list[int]]:
    """(kind, votes, [before, after, size]) of a pattern."""
    size, pattern = pattern % 4, pattern // 4
    after, pattern = pattern % 2, pattern // 2
    before, pattern = pattern % 2, pattern // 2
    votes = []
    for _ in LABELERS:
        votes.insert(0, pattern % 3)
        pattern //= 3
    return pattern, votes, [before, after, size]


def _phone_parts(text: str, a: int, b: int) -> Iterator[int]:
    """Ends of the parts of a number that ran on into other digits: the first space after each 8th to 15th digit."""
    digits, told = 0, 0
    for i in range(a, b):
        if text[i] == " ":
            if 8 <= digits and digits != told:
                told = digits
                yield i
        elif "0" <= text[i] <= "9":
            digits += 1
            if digits > 15:
                return


def candidates(text: str) -> list[tuple[int, int, int, bool, int]]:
    """(kind, start, end, base, pattern) of every candidate; base ones by kind and start, then others."""
    found, out, failed = [], [], []
    for kind, a, b, ok in base_matches(text):
        if ok:
            found.append((a, b))
            out.append((KINDS.index(kind), a, b, True, _pattern(kind, text, a, b, _votes(kind, text, a, b, True, True))))
        elif kind != "card" or b - a >= 12:
            failed.append((kind, a, b, True))
    loose = list(failed)
    for kind, a, b, _ in failed:
        if kind == "phone":
            loose += ((kind, a, cut, False) for cut in _phone_parts(text, a, b))
    for kind, rule in _LOOSE.items():
        for m in rule.finditer(text):
            end = m.end()
            while end > m.start() and not text[end - 1].isalnum():
                end -= 1
            loose.append((kind, m.start(), end, False))
    # the longest first, none over a base span or an earlier pick of the same kind
    found.sort()
    starts = np.array([a for a, _ in found])
    reach = np.maximum.accumulate([b for _, b in found]) if found else np.zeros(0)
    picks = []
    for kind, a, b, base in loose:
        k = int(np.searchsorted(starts, b, side="left")) if found else 0
        if k and reach[k - 1] > a:
            continue
        picks.append((KINDS.index(kind), a, b, False, _pattern(kind, text, a, b, _votes(kind, text, a, b, False, base))))
    return out + picks


def _features(patterns: np.ndarray) -> np.ndarray:
    rows = []
    for p in patterns.tolist():
        kind, votes, (before, after, size) = unpack(p)
        row = [1.0] + [float(kind == k) for k in range(len(KINDS))]
        for v in votes:
            row += [float(v == YES), float(v == NO)]
        row += [float(before), float(after)] + [float(size == s) for s in range(4)]
        rows.append(row)
    return np.array(rows).reshape(len(rows), -1)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns: (probability of each pattern, P(vote | class) by kind and labeler).

    Each kind starts with five unanimous yes and five unanimous no candidates,
    which fixes which class is which and keeps small corpora sane.
    """
    told = [unpack(p) for p in patterns.tolist()]
    kind = np.array([t[0] for t in told], int)
    votes = np.array([t[1] for t in told], int).reshape(len(told), len(LABELERS))
    prob = np.zeros(len(told))
    rates = np.zeros((len(KINDS), 2, len(LABELERS), 3))
    for k in range(len(KINDS)):
        at = np.flatnonzero(kind == k)
        v = np.vstack([votes[at], np.full((1, len(LABELERS)), YES), np.full((1, len(LABELERS)), NO)])
        n = np.concatenate([counts[at].astype(float), [5.0, 5.0]])
        q = np.clip(((v == YES).sum(1) + 0.5) / ((v != ABSTAIN).sum(1) + 1.0), 0.05, 0.95)
        for _ in range(rounds):
            q[-2:] = 1.0, 0.0
            prior = np.array([(n * (1 - q)).sum(), (n * q).sum()]) + 1.0
            log = np.log(prior / prior.sum())[None, :].repeat(len(v), 0)
            for c, w in enumerate((n * (1 - q), n * q)):
                for j in range(len(LABELERS)):
                    seen = np.bincount(v[:, j], weights=w, minlength=3) + 1.0
                    rates[k, c, j] = seen / seen.sum()
                    # abstaining says nothing about the class
                    informed = v[:, j] != ABSTAIN
                    spoken = rates[k, c, j, 1:] / rates[k, c, j, 1:].sum()
                    log[informed, c] += np.log(spoken[v[informed, j] - 1])
            q = 1.0 / (1.0 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        prob[at] = q[:-2]
    return prob, rates


def train_classifier(patterns: np.ndarray, counts: np.ndarray, soft: np.ndarray, l2: float = 1.0,
                     rounds: int = 30) -> np.ndarray:
    """Logistic regression (Newton steps) on the soft labels; a pattern weighs log(1 + count)."""
    x = _features(patterns)
    w = np.log1p(counts.astype(float))
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - soft)) + l2 * beta
        hess = (x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + l2 * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(pattern_counts: list[tuple[int, int]]) -> dict[int, float]:
    """Probability by the classifier of every pattern seen (at most 5,184 patterns exist)."""
    if not pattern_counts:
        return {}
    patterns = np.array([p for p, _ in pattern_counts])
    counts = np.array([n for _, n in pattern_counts])
    soft, _ = estimate(patterns, counts)
    beta = train_classifier(patterns, counts, soft)
    p = 1.0 / (1.0 + np.exp(-np.clip(_features(patterns) @ beta, -30, 30)))
    return dict(zip(patterns.tolist(), p.tolist()))


def choose(found: list[tuple[int, int, int, bool, int]], accept: set[int]) -> list[tuple[int, int, int, bool]]:
    """Base spans and accepted candidates, by kind and start; of overlapping additions the longest."""
    out = [c[:4] for c in found if c[3]]
    more = sorted((c for c in found if not c[3] and c[4] in accept), key=lambda c: (c[1] - c[2], c[1], c[0]))
    starts: list[int] = []          # of the additions taken so far, which don't overlap, and their ends
    ends: list[int] = []
    for c in more:
        k = bisect.bisect_left(starts, c[1])
        if (k == 0 or ends[k - 1] <= c[1]) and (k == len(starts) or c[2] <= starts[k]):
            starts.insert(k, c[1])
            ends.insert(k, c[2])
            out.append(c[:4])
    return sorted(out, key=lambda c: (c[0], c[1]))


FOUND = ("doc_id long, kinds array<int>, starts array<int>, ends array<int>, base array<boolean>, "
         "patterns array<int>")


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its candidates as parallel arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            maybe = pc.fill_null(pc.match_substring_regex(text, _ANY), False)
            rows = [candidates(t.as_py()) if ok else [] for t, ok in zip(text, maybe.to_pylist())]
            cols = [[[c[i] for c in r] for r in rows] for i in range(5)]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.list_(k)) for c, k in zip(cols, kinds))],
                names=["doc_id", "kinds", "starts", "ends", "base", "patterns"])

    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return own.mapInArrow(run, FOUND)


def fit_on(found: DataFrame) -> set[int]:
    """Patterns that the classifier accepts, trained on the votes of all candidates."""
    counts = found.select(F.explode("patterns").alias("p")).groupBy("p").count().collect()
    return {p for p, v in fit(sorted((r[0], r[1]) for r in counts)).items() if v >= 0.5}


RESULT = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
          "spans string, n_added long")


def report(found: DataFrame, accept: set[int]) -> DataFrame:
    """Counts and digest of base spans, and all spans as text, per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, _ in spans)
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("kinds", "starts", "ends", "base", "patterns")]
            out = []
            for row in zip(*cols):
                spans = choose(list(zip(*row)), accept)
                base = [s for s in spans if s[3]]
                out.append((*(sum(s[0] == k for s in base) for k in range(len(KINDS))),
                            hashlib.sha256(said(base).encode()).hexdigest(), said(spans), len(spans) - len(base)))
            cols = list(zip(*out)) if out else [[] for _ in range(7)]
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types))],
                names=[c.split()[0] for c in RESULT.split(", ")])

    return found.mapInArrow(run, RESULT)


def redact_text(text: str, accept: set[int]) -> str:
    """The text with every chosen span replaced by ``[KIND]``; overlapping spans become one."""
    spans = sorted((a, b, k) for k, a, b, _ in choose(candidates(text), accept))
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data in ``text_col`` replaced."""
    accept = fit_on(find_candidates(docs.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text")),
                                    "doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            text = batch.column(at)
            maybe = pc.fill_null(pc.match_substring_regex(text, _ANY), False).to_pylist()
            if any(maybe):
                new = [redact_text(t.as_py(), accept) if ok else t.as_py() for t, ok in zip(text, maybe)]
                batch = batch.set_column(at, text_col, pa.array(new, text.type))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def op4_pii_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and added spans of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = stage_path(spark, "pii_candidates")
    find_candidates(docs).write.parquet(path)
    found = spark.read.schema(FOUND).parquet(path)
    return report(found, fit_on(found))
