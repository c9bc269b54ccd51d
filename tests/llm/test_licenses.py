"""Places of phrases and states of the automaton by brute force; chains over repeated passages; whole query."""

import re

import numpy as np

from logjury.llm import licenses, rules
from logjury.llm.shared import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def brute_base(text):
    found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = []
    for phrase, label in PHRASES.items():
        own = phrase.split()
        places += [(k, label) for k in range(len(found)) if found[k : k + len(own)] == own]
    return len(found), sorted(places)


def test_places_and_phrases_of_states():
    rng = np.random.default_rng(3)
    for _ in range(60):
        rows = [rng.integers(1, 4, rng.integers(1, 9)).tolist() for _ in range(4)]
        own = licenses.Automaton(rows, range(2, 4))
        text = rng.integers(1, 5, 14).tolist()
        spoken = []
        for first, size, state in own.matches(text, 2, spoken):
            run = text[first : first + size]
            for row, tokens in enumerate(rows):
                want = {k + size - 1 for k in range(len(tokens)) if tokens[k : k + size] == run}
                assert own.places[state].get(row, set()) == want
        want = [(k, row) for row in (2, 3) for k in range(len(text)) if text[k : k + len(rows[row])] == rows[row]]
        assert sorted(spoken) == sorted(want)


def test_base_places_like_a_plain_search():
    rng = np.random.default_rng(4)
    parts = "cc by general public license all rights reserved CC-BY the of é software Licensed".split()
    own = licenses.scanner(tuple(licenses.TEMPLATES.items()), tuple(licenses.PHRASES.items()))
    for _ in range(300):
        text = " ".join(rng.choice(parts, rng.integers(0, 30)))
        n, base, _ = own.scan(text)
        assert (n, base) == brute_base(text)


def test_an_edit_in_a_repeated_passage_does_not_split_the_span():
    """The BSD text holds 'the above copyright notice, this list of conditions and the following disclaimer' twice."""
    own = licenses.scanner(tuple(licenses.TEMPLATES.items()), tuple(licenses.PHRASES.items()))
    edited = licenses.TEMPLATES["bsd"].replace("must reproduce the above", "shall also repeat the above")
    spans = [s for s in own.scan(edited)[2] if s[0] == "bsd"]
    assert len(spans) == 1 and spans[0][3] > 0.9
    twice = f"{licenses.TEMPLATES['isc']} {'and so on ' * 9} {licenses.TEMPLATES['isc']}"
    assert [s[0] for s in own.scan(twice)[2]] == ["isc", "isc"]


def test_query_columns(spark, tmp_path):
    texts = ["Released under the MIT License. All rights reserved", None, "", "cc by cc by", "GNU General Public License"]
    texts += [licenses.TEMPLATES["mpl-2.0"] + " cc-by"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in licenses.op9_licenses(spark, str(tmp_path)).collect()}
    for k, text in enumerate(texts):
        n, base = brute_base(text)
        row = rows[k]
        assert (row["n_words"], row["n_base"]) == (n, len(base))
        assert (row["first_word"], row["last_word"]) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert row["base_labels"] == ",".join(sorted({label for _, label in base}))
        assert set(filter(None, row["base_labels"].split(","))) <= set(row["labels"].split(","))
        assert 0 <= row["score"] <= 1
    assert rows[0]["labels"] == "mit-notice,reserved" and "mpl-2.0" in rows[5]["labels"]
    assert table(spark, str(tmp_path), "documents").count() == len(rows)


def test_buckets_follow_the_corpus(spark):
    assert [rules.buckets_for(n) for n in (0, 1, 10_000, 51_000, 256_000, 15_000_000)] == [
        1 << 10, 1 << 10, 1 << 13, 1 << 15, 1 << 16, 1 << 19
    ]
    assert [rules.trusted_for(n) for n in (0, 10_000, 256_000)] == [4096, 4096, 20_239]
    docs = spark.createDataFrame([(k, f"word{k % 3} and {k}", "x") for k in range(30)], "doc_id long, text string, _good string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(20)] + [(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = docs.drop("_good")
    one = rules.ratios_of_labelled(docs, labels, "text", 64, 100).first()[0]
    two = rules.ratios(docs, rules.trusted_documents(docs, labels), buckets=64).first()[0]
    assert np.allclose(one, two)
