"""Every operator against a brute-force version, and on nulls, ties, repeats and empty tables."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from logjury.llm import chat, graph, language, licenses, mixing, packing, pages, quality, rules, simhash, vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, fp int, _size int, label int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Four vocabularies that share some words.
LANGS = {
    "aa": "the of and thing other than ther ering tion ingly whether",
    "bb": "der die und nicht ein schen keit ung lich verst",
    "cc": "les des une eaux ment tion ouer que dans",
}


def text_of(lang: str, n: int, seed: int) -> str:
    rng = np.random.default_rng([seed, len(lang), ord(lang[0])])
    parts = LANGS[lang].split()
    return " ".join("".join(rng.choice(parts, 2)) if rng.random() < 0.6 else str(rng.choice(parts)) for _ in range(n))


def corpus() -> list[tuple]:
    rows = []
    for k in range(120):
        lang = list(LANGS)[k % 3]
        text = text_of(lang, 30 + k, k)
        if k % 8 == 1:
            text = " ".join(w + "###" for w in text.split())
        if k % 8 == 2:
            text = text.upper().replace(" ", "!! ")
        rows.append((k, text, lang, f"s{k % 4}"))
    rows += [
        (200, None, "aa", "s1"),
        (201, "", None, None),
        (202, " \t\n", "aa", None),
        (203, "a", "aa", "s1"),
        (204, "!!! 12 ...", None, "s0"),
        (205, text_of("aa", 6000, 5), "aa", "s2"),
        (206, rows[5][1], "cc", "s2"),  # a copy
        (207, rows[5][1] + " more", "cc", "s2"),  # a near copy
        (5, rows[5][1], rows[5][2], rows[5][3]),  # a repeated row
        (None, "no name but a text " * 5, "aa", "s3"),
        (208, "Ärger\x00 <b>&amp; ʼn 漢字 " * 9, "bb", "s3"),
    ]
    return [(*r, len(r[1] or ""), "clash", 1, 2, 3) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, 0 if k % 8 in (1, 2) else 1, 0) for k in range(120)]
    rows += [(3, 0, 0), (None, 1, 0), (7, None, None), (999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mixing_meets_targets(spark, docs, nothing):
    sized = docs.select("doc_id", mixing.word_count(docs["text"]).alias("_size"), docs["source"].alias("_source"))
    rows = mixing.mix_counts(sized, ["doc_id"]).collect()
    assert len(rows) == docs.count()
    by_source = {}
    for r in rows:
        assert 0 <= r["_copies"] <= mixing.CAP
        by_source.setdefault((r["_source_size"], r["_target"]), []).append(r)
    total = sum(r["_size"] for r in rows)
    assert sum(target for _, target in by_source) == pytest.approx(1.5 * total)
    for (size, target), own in by_source.items():
        assert size == sum(r["_size"] for r in own)
        taken = sum(r["_size"] * r["_copies"] for r in own)
        assert target <= 2 * size
        assert abs(taken - target) <= max(r["_size"] for r in own)
    again = mixing.mix_counts(sized.repartition(7), ["doc_id"]).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["_copies"])
    assert [key(r) for r in sorted(again, key=key)] == [key(r) for r in sorted(rows, key=key)]
    mixed = mixing.mix(docs)
    assert mixed.schema == docs.schema
    assert mixed.count() == sum(r["_copies"] for r in rows)
    assert mixing.mix(nothing).count() == 0


def test_levels_are_filled(spark):
    """Targets against a loop that shares the excess out again and again."""
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 300, None: 40}
    frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "_source string, _size long")
    found = {r["_source"]: r["_target"] for r in mixing.source_targets(frame).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True))
    left, open_, want = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        if not full:
            want |= {s: weight[s] * level for s in open_}
            break
        want |= {s: 2 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    assert found == pytest.approx(want)


def test_perspectives_rotate(spark):
    turns = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", "yo"), (1, 3, "ann", None),
        (2, 0, "system", "alone"), (3, None, None, "who"), (3, None, None, "who"), (None, 1, "x", "y"),
    ]
    turns += [(4, k, "ann" if k % 2 else "bob", f"t{k}") for k in range(600)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = chat.rotate(frame).collect()
    views = {(r["conv_id"], r["perspective"], r["part"]): r for r in rows}
    assert (2, "system", 0) not in views and len([k for k in views if k[0] == 4]) == 6
    ann = views[1, "ann", 0]
    assert ann["text"] == (
        "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n"
        "<|im_start|>user name=bob\nyo<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    ).replace("< |im_end|>", "<|im_end|>".replace("<|im_", "< |im_"))
    assert [ann["text"][m["first"] : m["stop"]] for m in ann["masks"]] == ["hi < |im_end|><|im_end|>", "<|im_end|>"]
    assert views[3, "unknown", 0]["n_turns"] == 2 and views[None, "x", 0]["n_turns"] == 1
    for (conv, who, _), row in views.items():
        own = [row["text"][m["first"] : m["stop"]] for m in row["masks"]]
        assert len(own) == row["text"].count("<|im_start|>assistant\n"), (conv, who)
    assert chat.rotate(frame.where("conv_id = 99")).count() == 0


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="menu-open">
<nav><a href="/x">Menu words here</a></nav><div class="cookie-notice">We use cookies on this page</div>
<article><h1>Tit&eacute;l</h1><p>First  one\nwith <b>bold</b> &amp;amp; <a href='q>'>link</a>.<p>Second &lt;p&gt;<br>line
<script>var a="</p><p>no";</script><form><input>Send it now</form><ul><li>one</li><li>two</li></ul>
<div class="ad">Buy this thing today please</div><section id="comments"><p>I like it so much</p></section></article>
<aside>Other stories to read</aside><footer>&copy; all of us"""


def test_main_text(spark):
    marked = spark.createDataFrame([(k, "u", PAGE) for k in range(5)], "page_id long, url string, html string")
    weights = pages.learn(marked)
    want = "Titél\n\nFirst one with bold &amp; link.\n\nSecond <p> line\n\none\n\ntwo"
    assert pages.main_text(PAGE, weights) == want
    assert pages.main_text(PAGE, pages.Weights({})) == want
    for page, text in {
        None: "", "": "", "<": "<", "plain  text": "plain text", "<p>a<p>b": "a\n\nb", "<nav>x": "",
        "<p>x</p></div></p><p>y": "x\n\ny", "<script>": "", "<!-- x": "", "<p title='": "<p title='",
    }.items():
        assert pages.main_text(page, pages.Weights({})) == text, page
    for page, text in {
        '<body><div class="site-header">Name</div><p>a b c d</p><div id=side_bar>x y</div>': "a b c d",
        "<body><nav><a>m n</a><article><p>text of it</article><aside><article>teaser</article></aside>": "text of it",
        '<article class="post"><header><h1>t</h1></header><p>b</p><article class="comment">no</article></article>': "t\n\nb",
        "<main><p>a<div role=navigation>x</div><p hidden>y</p><table><tr><td>1<td>2</table></main>": "a\n\n1 2",
        "<p>" * 3000 + "deep": "deep",
        "<div>" * 3000 + "deep" + "</i>" * 3000: "deep",
    }.items():
        assert pages.main_text(page, pages.Weights({})) == text, page[:80]
    long = "<article>" + "<p>word word</p>" * 20_000 + "</article>"
    assert pages.main_text(long, weights).count("\n\n") == 19_999
    rows = spark.createDataFrame([(1, "u", None, "x"), (2, None, PAGE, "x"), (2, None, PAGE, "x")], "page_id long, url string, html string, text string")
    got = [r["main"] for r in pages.extract(rows, weights, ["page_id", "url"], name="main").collect()]
    assert got == ["", want, want]
    empty = rows.where("page_id = 9")
    assert pages.extract(empty, pages.learn(empty), ["page_id"]).count() == 0


def test_best_stretch_is_best():
    rng = np.random.default_rng(1)
    for _ in range(200):
        scores = rng.integers(-3, 4, rng.integers(0, 12)).tolist()
        first, stop = pages.best_stretch(scores)
        best = max([0] + [sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)])
        assert sum(scores[first:stop]) == best


def test_quality_words():
    text = "Ab cd!! ÄÖ  ab\nAB ###".encode()
    starts, hashes, shape = quality.words(np.frombuffer(text, dtype=np.uint8))
    cut = [text[s:].split()[0] for s in starts]
    assert cut[:3] == [b"Ab", b"cd!!", b"!!"] and len(starts) == 7
    assert shape.tolist() == [1, 0, 3, 0, 0, 2, 3]
    again = quality.words(np.frombuffer(b"zz " + text, dtype=np.uint8))[1]
    assert again[1:].tolist() == hashes.tolist()
    assert len(set(hashes.tolist())) == len(hashes)


def test_quality_learns(spark, docs, labels, nothing):
    weights = quality.fit(docs, labels)
    rows = quality.score(docs, weights, ["doc_id", "score"], name="found").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r["found"] <= 1
        if r["doc_id"] is not None and r["doc_id"] < 120:
            assert (r["found"] >= quality.KEEP) == (r["doc_id"] % 8 not in (1, 2)), r
    none = quality.fit(docs, labels.where("false"))
    assert {r["score"] for r in quality.score(docs, none, ["doc_id"]).collect()} == {0.5}
    assert quality.score(nothing, weights, ["doc_id"], name="x").count() == 0


def test_packing(spark, docs, nothing):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    extra = [(300, "<|endoftext|> it's   \n\n 12 x", 1), (301, "x" * 5000, 1), (302, "　 😀", 1)]
    extra = [(i, t.encode("utf-16", "surrogatepass").decode("utf-16"), n) for i, t, n in extra]
    frame = docs.select("doc_id", "text", "n_chars").union(spark.createDataFrame(extra, "doc_id long, text string, n_chars long"))
    texts = {r["doc_id"]: r["text"] for r in frame.collect()}
    ids = {k: np.array([*own.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for k, t in texts.items()}
    rows = packing.pack(frame, run_tokens=10_000).collect()
    repeats = Counter(r["doc_id"] for r in frame.collect())
    tokens = Counter()
    sequences = {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        tokens[r["doc_id"]] += r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert tokens == {k: len(v) * repeats[k] for k, v in ids.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at.bit_count() == 1 and at <= 2048
    assert packing.pack(nothing).count() == 0


def test_costs_are_balanced():
    rng = np.random.default_rng(2)
    sizes = np.minimum(2047, rng.exponential(400, 3000).astype(int) + 1).tolist()
    cost = Counter()
    for _, _, taken, sequence in packing.assign(sizes):
        cost[sequence] += packing.LINEAR * taken + packing.QUADRATIC * taken * taken
    full = [cost[k] for k in range(sum(sizes) // 2048)]
    room, plain = [2048] * (sum(sizes) // 2048 + 1), Counter()
    for left in sorted(sizes, reverse=True):  # the same pieces, each to the first sequence with room
        while left:
            to = next((k for k, r in enumerate(room) if r >= left), None)
            to = next(k for k, r in enumerate(room) if r) if to is None else to
            taken = min(left, room[to])
            plain[to] += packing.LINEAR * taken + packing.QUADRATIC * taken * taken
            room[to] -= taken
            left -= taken
    assert np.std(full) < 0.8 * np.std([plain[k] for k in range(len(full))])


def brute_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, linked):
    parent = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    return parent


def test_simhash(spark, docs, nothing):
    for text in ("", None, "One", "a b c", "A b  c\td e É\x1cf", text_of("aa", 500, 1)):
        assert simhash.fingerprint(text) == brute_fingerprint(text)
    rows = {}
    for r in simhash.near_duplicates(docs).collect():
        rows.setdefault(r["doc_id"], r)
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    ids = sorted(texts)
    prints = [brute_fingerprint(texts[k]) for k in ids]
    groups = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    for k, i in enumerate(ids):
        assert rows[i]["fp"] & ((1 << 64) - 1) == prints[k]
        assert rows[i]["component_id"] == ids[groups[k]]
    kept = simhash.representatives(docs)
    assert kept.schema == docs.schema
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({ids[g] for g in groups})
    assert simhash.near_duplicates(nothing).count() == 0


def test_components(spark, nothing):
    """A long chain, a star, random links, loops, repeats and null ends."""
    rng = np.random.default_rng(9)
    chain = [(1000 + k, 1001 + k) for k in range(200)]
    star = [(5000, 5001 + k) for k in range(500)]
    wild = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))]
    links = [*chain, *star, *wild, (7, 7), (None, 3), (3, None), chain[0], chain[0][::-1]]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    frame = spark.createDataFrame(links, "a long, b long").repartition(5)
    found = {r["node"]: r["component"] for r in graph.components(frame).collect()}
    assert found == {x: find(x) for x in list(parent)}
    assert graph.components(frame.where("false")).count() == 0


def test_fingerprint_tiles_lose_no_link(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 150, dtype=np.int64)
    rows = base.tolist() + [0, 1, 3, 7, 15, 31, 63, -1, -2, -4]
    for value in base[:100].tolist():
        for bits in range(1, 7):
            flips = sum(1 << int(b) for b in rng.choice(63, bits, replace=False))
            rows.append(value ^ flips)
    rows = sorted(set(rows))
    frame = spark.createDataFrame([(r,) for r in rows], "fp long")
    unsigned = [r & ((1 << 64) - 1) for r in rows]
    groups = brute_components(unsigned, lambda a, b: (a ^ b).bit_count() <= 4)
    for tile in (3, 1 << 15):
        found = {r["node"]: r["component"] for r in simhash.fingerprint_components(frame, tile=tile).collect()}
        for k, r in enumerate(rows):
            assert found.get(r, r) == rows[groups[k]]


@pytest.mark.parametrize("dims", [3, 8, 1100])
def test_vectors(spark, dims):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(60):
        base = rng.normal(size=dims)
        for _ in range(3):
            rows.append((len(rows), (base + rng.normal(size=dims) * rng.choice([0, 0.15, 0.3, 0.5])).astype("f4").tolist(), k % 2))
    rows += [
        (900, None, 0), (901, [], 0), (902, [0.0] * dims, 0), (903, rows[0][1], None), (904, [math.nan] * dims, 0),
        (905, [None] * dims, 0), (906, [math.inf] + [1.0] * (dims - 1), 1), (907, rows[0][1], 0), (908, rows[0][1][:-1], 0),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)

    def cosine(a, b):
        x, y = np.array(a, dtype=float), np.array(b, dtype=float)
        return (x * y).sum() / (math.sqrt((x * x).sum()) * math.sqrt((y * y).sum()))

    def able(v):
        return bool(v) and None not in v and all(map(math.isfinite, v)) and any(v)

    def linked(a, b):
        return a[2] is not None and a[2] == b[2] and able(a[1]) and able(b[1]) and len(a[1]) == len(b[1]) and cosine(a[1], b[1]) >= 0.93

    groups = brute_components(rows, linked)
    counts = [sum(linked(a, b) for b in rows if b is not a) for a in rows]
    for tile in (7, 1024):
        found = {r["vec_id"]: r for r in vectors.near_vectors(frame, tile=tile).collect()}
        assert len(found) == len(rows)
        for k, r in enumerate(rows):
            want = (counts[k], rows[groups[k]][0], rows[groups[k]][0] == r[0])
            assert tuple(found[r[0]])[1:] == want, r[0]
    assert vectors.near_vectors(frame.where("vec_id < 0")).count() == 0


def test_vector_repeats_and_bounds(spark):
    rows = [(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (None, [1.0, 2.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = sorted(map(tuple, vectors.near_vectors(frame).where("vec_id is not null").collect()))
    assert found == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    rng = np.random.default_rng(5)
    unit = rng.normal(size=(200, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    codes, scale, error = vectors.quantise(unit)
    near = (codes.astype(float) @ codes.astype(float).T) * scale[:, None] * scale[None, :]
    assert (np.abs(near - unit @ unit.T) <= error[:, None] + (1 + error)[:, None] * error[None, :] + 1e-12).all()


def test_cross_parsing():
    """Phrases against a parse with plain substring tests."""
    codes = language.code_table("abc")
    sample = "abcab caa"
    found, starts = language.encode([sample], codes)
    model = language.Model("abc", ["x"], [language.automaton(found, 5)], [len(found)])

    def phrases(text):
        text, count, at = language.normalise(text).replace("d", "?"), 0, 0
        while at < len(text):
            stop = at + 1
            while stop < len(text) and text[at : stop + 1] in sample:
                stop += 1
            at, count = stop, count + 1
        return count

    texts = ["abcab", "abcabc", "c", "dd", "caa  caa", "A, b. c", "abdab", "aaaaaaa", "cab!caab bca"]
    of, size, count = model.phrases(*language.encode(texts, codes))
    assert of.tolist() == list(range(len(texts)))
    assert size.tolist() == [len(language.normalise(t)) for t in texts]
    assert count[:, 0].tolist() == [phrases(t) for t in texts]


def test_language(spark, docs, nothing):
    model = language.fit(docs)
    rows = language.predict(docs, model, ["doc_id", "lang", "score"], names=("found", "sure")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r["sure"] <= 1
        if r["doc_id"] in (200, 201, 202, 204):
            assert (r["found"], r["sure"]) == ("und", 0.0)
        elif r["doc_id"] is not None and r["doc_id"] < 200:
            assert r["found"] == r["lang"], r
    untaught = language.fit(nothing)
    assert {r["lang_pred"] for r in language.predict(docs.drop("score"), untaught, ["doc_id"]).collect()} == {"und"}
    assert language.predict(nothing.drop("score"), model, ["doc_id"]).count() == 0


def test_long_texts_are_parsed_whole():
    codes = language.code_table("abc")
    model = language.Model(
        "abc", ["x", "y"], [language.automaton(language.encode([t], codes)[0], 5) for t in ("abab", "caac")], [4, 4]
    )
    long = "abab" * 10_000 + "caac" * 3_000
    of, size, count = model.phrases(*language.encode([long, "ab"], codes))
    assert size.sum() == len(long) + 2 and (size[of == 0][:-1] == language.SEGMENT).all()
    assert count[of == 0].min(axis=1).sum() >= len(long) / 4
    names, scores = model.predict([long, "caac" + long[::-1], "caa", "abab caac caac"])
    assert names == ["x", "x", "y", "y"] and 0.3 < scores[0] < 0.77


def test_licenses(spark, docs, nothing):
    own = licenses.scanner(tuple(licenses.TEMPLATES.items()), tuple(licenses.PHRASES.items()))
    for name, text in licenses.TEMPLATES.items():
        n, _, spans = own.scan(f"Some words first. {text.upper()} And more of it.")
        exact = [s for s in spans if s[0] == name]
        assert exact and exact[0][3] == 1.0 and exact[0][1] == 3, name
    edited = licenses.TEMPLATES["mit"].replace("publish", "print").replace("free of charge", "gratis")
    assert any(s[0] == "mit" and 0.8 < s[3] < 1 for s in own.scan(edited)[2])
    n, base, _ = own.scan("CC-BY cc by by all RIGHTS reserved, General\nPublic License cc")
    assert n == 12 and sorted(base) == [(0, "cc-by"), (2, "cc-by"), (5, "reserved"), (8, "gpl")]
    assert own.scan(None) == (0, [], []) and own.scan("the of the") == (3, [], [])
    rows = licenses.scan(docs).collect()
    assert len(rows) == docs.count() and not any(r["spans"] for r in rows)
    assert licenses.scan(nothing).count() == 0


def test_matching_statistics():
    rows = [[1, 2, 3, 1, 2], [2, 3, 4]]
    own = licenses.Automaton(rows)
    rng = np.random.default_rng(6)
    runs = {tuple(r[a:b]) for r in rows for a in range(len(r)) for b in range(a + 1, len(r) + 1)}
    for _ in range(100):
        text = rng.integers(1, 5, 10).tolist()
        want = []
        for stop in range(1, 11):
            size = max(n for n in range(stop + 1) if n == 0 or tuple(text[stop - n : stop]) in runs)
            longer = stop < 10 and tuple(text[stop - size : stop + 1]) in runs
            if size >= 2 and not longer:
                want.append((stop - size, size))
        assert [m[:2] for m in own.matches(text, 2)] == want


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {p for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for p in range(k, k + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_rules(spark, docs, labels, nothing):
    line = "one two three four five six seven eight nine"
    extra = [(400, f"{line}\n{line}\n{line} x\n \n \n" * 2), (401, "a " * 40), (402, f"{line} {line}"), (403, line + " z " + line[4:])]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in frame.collect()}
    found = rules.judge_quality(frame, labels).collect()
    assert len(found) == frame.count()
    for r in found:
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        assert got == brute_rules(texts[r["doc_id"]]), r["doc_id"]
        assert not (r["base_failed"] and r["kept"])
        if r["doc_id"] is not None and r["doc_id"] < 120:
            assert r["kept"] == (r["doc_id"] % 8 not in (1, 2)), r
    assert rules.judge_quality(nothing, labels).count() == 0
    assert {r["log_ratio"] for r in rules.judge_quality(frame, labels.where("false")).collect()} == {0.0}
    plan = rules.judge_quality(frame, labels)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_ratios_against_counts(spark, docs, labels):
    rows = rules.ratios(docs, rules.trusted_documents(docs, labels)).first()[0]
    assert len(rows) == rules.BUCKETS
    some = docs.select("doc_id", rules.ngrams(docs["text"]).alias("b")).where("b is not null").collect()
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and not r["toxic"]} - {None}
    raw = Counter(b for r in some for b in r["b"])
    fine = Counter(b for r in some if r["doc_id"] in good for b in r["b"])
    share = lambda counts, b: (counts[b] + 0.5) / (counts.total() + 0.5 * rules.BUCKETS)
    for b in (0, 2, 17, 4000):
        assert rows[b] == pytest.approx(math.log(share(fine, b)) - math.log(share(raw, b)))


def test_sql_oracles(spark, tmp_path):
    rows = [r[:5] for r in corpus() if r[0] is not None][:-3]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").dropDuplicates(["doc_id"]).write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(k // 5, k % 5, ["system", "user", "assistant", "bob"][k * 7 % 4], f"t {k}") for k in range(60)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rng = np.random.default_rng(8)
    bases = rng.normal(size=(12, 6))
    near = [(bases[k % 12] + rng.normal(size=6) * 0.2).astype("f4").tolist() for k in range(90)]
    points = [(k, v, k % 2 if k % 9 else None) for k, v in enumerate([*near, None, [0.0] * 6, [1.0, None]])]
    spark.createDataFrame(points, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for name in ("documents", "conversations", "embeddings"):
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    for query, sql in ((mixing.op1_mix_sources, mixing.OP1_SQL), (chat.op2_chat, chat.OP2_SQL), (vectors.op7_embedding_links, vectors.OP7_SQL)):
        found = query(spark, str(tmp_path))
        want = con.sql(sql)
        names = sorted(found.columns)
        assert sorted(want.columns) == names
        key = lambda row: str(row)
        got = sorted((tuple(r[n] for n in names) for r in found.collect()), key=key)
        assert got == sorted((tuple(r) for r in want.select(*names).fetchall()), key=key)
