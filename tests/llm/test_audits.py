"""Personal data, filter audit and source divergence against plain Python, and on odd rows."""

import hashlib
import re
import time
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from test_operators import SCHEMA, corpus, text_of

from logjury.llm import divergence, filters, pii

KINDS = ("email", "ip", "card", "phone")
# The formats as the contract writes them.
FORMATS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def check_digit(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute_base(text):
    found = []
    for kind, pattern in FORMATS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and check_digit(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                found.append((m.start(), KINDS.index(kind), m.end(), kind))
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def card(rng):
    digits = "".join(map(str, rng.integers(0, 10, 15)))
    return next(digits + str(d) for d in range(10) if check_digit(digits + str(d)))


def private_texts(n):
    rng = np.random.default_rng(3)
    for k in range(n):
        words = text_of("aa", 30, k).split()
        number = rng.integers(1, 255, 4)
        kinds = (
            f"{words[0]}.{k}@mail{k % 7}.example.com",
            ".".join(map(str, number)),
            card(rng),
            f"+1 ({rng.integers(100, 999)}) 555-{rng.integers(1000, 9999)}",
            str(rng.integers(10**15, 10**16)),
            f"20{k % 30:02}-0{1 + k % 9}-1{k % 9} 12:{k % 60:02}:30",
        )
        for part in rng.choice(kinds, 2, replace=False):
            words.insert(int(rng.integers(0, len(words))), str(part))
        yield " ".join(words)


ODD = [
    None, "", "a@b.c_d@e.f", "a@b@c.de", "@x.y", "x@y z@w.com.", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.02.3.255", "1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112", "4 4111111111111111", "+1 2 3", "+44 (0)20.7946-0018 x", "++12345678901",
    "é@x.yz \U0001f600 a@b.cd 1.1.1.1", "1" * 30, "+" * 50, "9.9.9.9.", "0.0.0.0@a.b",
]


@pytest.fixture(scope="module")
def private(spark):
    texts = [*ODD, *private_texts(900)]
    rows = [(k, t, "aa", "s", 1, "clash", 2, 3, 4) for k, t in enumerate(texts)]
    rows += [(None, texts[-1], None, None, 1, "clash", 2, 3, 4), rows[-1]]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def model(private):
    return pii.fit(private)


def test_base_spans_are_exact(private, model):
    found = pii.find(private, model, ["doc_id", "text"]).collect()
    assert len(found) == private.count()
    for r in found:
        base = brute_base(r["text"])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), r["text"]
        counts = Counter(k for k, _, _ in base)
        assert [r[f"n_{k}"] for k in KINDS] == [counts[k] for k in KINDS]
        spans = [x for x in r["spans"].split(",") if x]
        assert set(text.split(",")) - {""} <= set(spans)


def test_looser_forms_are_found(model):
    assert set(model) == set(KINDS)
    rng = np.random.default_rng(8)
    caught, wrong = Counter(), 0
    for k in range(100):
        words = text_of("aa", 20, 2000 + k)
        for kind, part in (
            ("email", f"{words.split()[0]} at mail{k} dot example dot com"),
            ("ip", "[.]".join(map(str, rng.integers(1, 255, 4)))),
            ("card", re.sub("(....)(?=.)", r"\1.", card(rng))),
            ("phone", f"({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}"),
        ):
            text = f"{words} {part} {words}"
            found = pii.added(text, pii.base_spans(text), model)
            caught[kind] += any(f == (len(words) + 1, len(words) + 1 + len(part), kind) for f in found)
        for part in (f"{rng.integers(10**15, 10**16)}", "12:30:45", "2024-01-02 03:04", "look at the dot. And"):
            text = f"{words} {part} {words}"
            base = pii.base_spans(text)
            wrong += bool(pii.added(text, base, model)) and not any(base.values())
    assert min(caught[k] for k in KINDS) >= 80, caught
    assert wrong <= 8


def test_spans_added_do_not_overlap(model):
    for text in private_texts(150):
        base = pii.base_spans(text)
        text, _ = pii.rewritten(text, base, True, "x")
        base = pii.base_spans(text)
        every = sorted([(a, b) for own in base.values() for a, b in own])
        new = sorted((a, b) for a, b, _ in pii.added(text, base, model))
        assert all(x[1] <= y[0] for x, y in zip(new, new[1:]))
        assert all(b <= x or y <= a for a, b in new for x, y in every)
        assert model == {} or pii.added(text, base, model) == pii.added(text, base, model)


def test_long_and_hostile_texts(spark, model):
    for part in ("1", "1 ", "a@", "1.", "+1", "(", " at a.", ":", "x@y.z ", "4111111111111111 "):
        text = part * (120_000 // len(part))
        start = time.perf_counter()
        base = pii.base_spans(text)
        pii.added(text, base, model)
        assert time.perf_counter() - start < 40, part
    nothing = spark.createDataFrame([], SCHEMA)
    assert pii.fit(nothing) == {}
    assert pii.find(nothing, {}, ["doc_id"]).collect() == []


def test_threshold_is_calibrated():
    scores = np.array([0.1, 0.2, 0.3, 0.4, 0.5] * 40)
    right = np.array([0.0, 0.0, 1.0, 1.0, 1.0] * 40)
    assert pii.threshold(scores, right) == 0.3
    assert pii.threshold(scores, right * 0) == np.inf


def test_redaction(private, model):
    row = pii.redact(pii.find(private.where("text LIKE 'é%'"), model, ["doc_id", "text"])).first()
    assert row["redacted"] == "é@x.yz \U0001f600 [email] [ip]"


# Filters.


def fails(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return {
        "A": len(words) < 100,
        "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        "D": re.search("[#$%&*|]", text) is not None,
    }


def brute_audit(rows, labels):
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    told = []
    for k, text, part in rows:
        smaller = any(o is not None and k is not None and o < k and (t or "") == (text or "") for o, t, _ in rows)
        told.append((part or "", k, fails(text or "") | {"E": smaller}))
    want, shapley = {}, Counter()
    for part in {p for p, _, _ in told}:
        own = [(k, f) for p, k, f in told if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, name in enumerate(order, 1):
                gone = [x for x in left if x[1][name]]
                left = [x for x in left if not x[1][name]]
                shapley[part, name] += len(gone)
                want[part, order, step] = (
                    len(left), len(gone), sum(f[name] for _, f in own) - len(gone),
                    sum(f[name] and sum(f.values()) == 1 for _, f in own),
                    sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone),
                )
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in want.items()}


def test_filters_in_every_order(spark):
    rows = [(r[0], r[1], r[2]) for r in corpus()]
    rows += [(300 + k, text_of("aa", 110, k % 5) + " X|" * (k % 3), ("aa", "bb", None, "")[k % 4]) for k in range(40)]
    rows += [(None, rows[3][1], "aa"), (50, rows[3][1], "bb"), (-5, "", "aa")]
    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 340, 2)] + [(3, 0, 0), (3, 1, None), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "s", 1, "clash", 2, 3, 4) for r in rows], SCHEMA).repartition(4)
    docs = docs.withColumnsRenamed({"score": "part", "fp": "digest", "_size": "A"})
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute_audit(rows, labels)
    for width in (filters.RANGE, 7):
        found = filters.audit(docs, marked, width)
        names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
        got = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in found.collect()}
        assert got == want
    assert filters.audit(docs.where("false"), marked.where("false")).count() == 0


def test_posting_lists():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b, c = (np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(3))
        assert filters.minus(a, b).tolist() == np.setdiff1d(a, b).tolist()
        assert filters.merged(a, b, c).tolist() == np.union1d(np.union1d(a, b), c).tolist()
        assert filters.shared_size(a, b) == len(np.intersect1d(a, b))


# Divergence.


def brute_divergence(rows):
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t, _, _ in rows]
    want = {}
    for lang in {r[1] for r in rows}:
        own = [(w, r[2]) for w, r in zip(words, rows, strict=True) if r[1] == lang]
        spread = Counter(t for w, _ in own for t in set(w))
        kept = {t for t, n in spread.items() if n >= 30}
        counts = defaultdict(Counter)
        for w, source in own:
            counts[source].update(t for t in w if t in kept)

        def share(times):
            total = sum(times.values())
            return {t: 1 + 10**9 * (times[t] + 5) // (total + 5 * len(kept)) for t in kept}

        usual = share(sum(counts.values(), Counter()))
        shares = {s: share(c) for s, c in counts.items()}
        for a in shares:
            pairs = [(-sum(abs(shares[a][t] - shares[b][t]) for t in kept), b.encode()) for b in shares if b != a]
            terms = [(usual[t] - shares[a][t], t.encode()) for t in kept if counts[a][t] and shares[a][t] > usual[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:50])):
                want |= {(lang, a, part, k): (item.decode(), -v) for k, (v, item) in enumerate(found, 1)}
    return want


def test_divergence_of_sources(spark, monkeypatch):
    rows = [(r[1], r[2], r[3]) for r in corpus()]
    rows += [(text_of("aa", 60, k) + " Éa É漢 ſ I" + " tie" * (k % 2), "aa", f"t{k % 3}") for k in range(60)]
    rows += [("the of and", "aa", ""), ("12 _ 3", "aa", "none"), ("few words", "dd", "s1"), ("few words", "dd", "s2"), (None, "ee", "s")]
    docs = spark.createDataFrame([(k, t, lang, s, 1, "c", 2, 3, 4) for k, (t, lang, s) in enumerate(rows)], SCHEMA)
    docs = docs.withColumnsRenamed({"score": "term", "fp": "n", "_size": "rank", "label": "counts"}).repartition(5)
    want = brute_divergence(rows)
    assert any(part == "term" for _, _, part, _ in want)
    for block, held in ((divergence.BLOCK, divergence.HELD), (3, 50)):
        monkeypatch.setattr(divergence, "HELD", held)
        found = divergence.divergence(docs, block=block).collect()
        assert {(r["lang"], r["source"], r["part"], r["rank"]): (r["item"], r["value"]) for r in found} == want
        assert len(found) == len(want)
    assert divergence.divergence(docs.where("false")).count() == 0


def test_shares_are_exact():
    counts = np.array([0, 3, 10**12, 3])
    want = [1 + 10**9 * (int(c) + 5) // (10**15 + 35) for c in counts]
    assert divergence.shares(counts, 10**15, 7).tolist() == want
