"""The registered queries on a small folder, all their columns against plain Python."""

import re
import zlib

import pytest
from test_operators import SCHEMA, WORD, brute_components, brute_fingerprint, corpus

from logjury.llm import catalog

PAGES = [
    (1, "u1", "<html><nav>menu</nav><article><h1>Head &amp; é</h1><p>Some text of the article.</p></article><footer>foot</footer></html>"),
    (2, "u2", None),
    (3, None, ""),
    (4, "u4", "plain text without tags"),
]


@pytest.fixture(scope="module")
def rows():
    kept = {}
    for row in corpus():
        if row[0] is not None:
            kept.setdefault(row[0], row)
    return kept


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, rows):
    path = str(tmp_path_factory.mktemp("queries"))
    spark.createDataFrame(list(rows.values()), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(k, 0 if k % 8 in (1, 2) else 1, 0) for k in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_op3(spark, folder):
    found = {r["page_id"]: r for r in catalog.QUERIES["op3_main_text"](spark, folder).collect()}
    assert {k: r["url"] for k, r in found.items()} == {k: u for k, u, _ in PAGES}
    assert found[1]["text"] == "Head & é\n\nSome text of the article."
    assert [found[k]["text"] for k in (2, 3, 4)] == ["", "", "plain text without tags"]
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())


def test_op4(spark, folder, rows):
    found = {r["doc_id"]: r for r in catalog.QUERIES["op4_quality"](spark, folder).collect()}
    assert found.keys() == rows.keys()
    for k, r in found.items():
        assert r["held_out"] == held_out(k) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.7)


def test_op5(spark, folder, rows):
    import numpy as np
    from public_tokenizers import path as tokenizer_path
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    pieces = {}
    sequences = {}
    for r in catalog.QUERIES["op5_pack"](spark, folder).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert pieces.keys() == rows.keys()
    for k, found in pieces.items():
        ids = [*own.encode(rows[k][1] or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(found, key=lambda r: r["start"]):
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048


def test_op6(spark, folder, rows):
    found = {r["doc_id"]: r for r in catalog.QUERIES["op6_simhash"](spark, folder).collect()}
    keys = sorted(rows)
    prints = [brute_fingerprint(rows[k][1]) for k in keys]
    groups = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    for place, k in enumerate(keys):
        assert found[k]["fingerprint"] == f"{prints[place]:016x}"
        assert found[k]["component_id"] == keys[groups[place]]


def test_op8(spark, folder, rows):
    found = {r["doc_id"]: r for r in catalog.QUERIES["op8_language"](spark, folder).collect()}
    assert found.keys() == rows.keys()
    for k, r in found.items():
        assert r["held_out"] == held_out(k) and 0 <= r["score"] <= 1
        lettered = any(c.isalpha() for c in rows[k][1] or "")
        assert (r["lang_pred"] != "und") == lettered
        assert r["lang_pred"] in ("und", "aa", "bb", "cc")
    assert sum(found[k]["lang_pred"] == rows[k][2] for k in range(120)) >= 118


def test_op10(spark, folder, rows):
    found = {r["doc_id"]: r for r in catalog.QUERIES["op10_quality_rules"](spark, folder).collect()}
    assert found.keys() == rows.keys()
    for k, r in found.items():
        text = rows[k][1] or ""
        own = WORD.findall(text)
        windows = {}
        for at in range(len(own) - 7):
            windows.setdefault(tuple(own[at : at + 8]), []).append(at)
        covered = {at + n for places in windows.values() if len(places) > 1 for at in places for n in range(8)}
        lines = [line for line in text.split("\n") if WORD.search(line)]
        assert r["n_words"] == len(own) and r["word_chars"] == sum(map(len, own))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == len(covered)
        assert r["base_failed"] == (len(own) < 20 or 100 * len(covered) > 30 * len(own))
        assert not (r["base_failed"] and r["kept"])
