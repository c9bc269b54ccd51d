"""Broken and hostile pages; hot labels and extreme vectors; plans that shuffle no text by a hot key."""

import time

import numpy as np
import pytest

from logjury.llm import chat, language, pages, vectors


@pytest.mark.parametrize("part", ["<a ", "<nav><article>x", "<script ", "<a '>x ", "<svg><p>x", "< b ", "<article><aside>x"])
def test_broken_pages_take_linear_time(part):
    page = part * (400_000 // len(part))
    start = time.perf_counter()
    pages.main_text(page, pages.Weights({}))
    assert time.perf_counter() - start < 20


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><div><svg width=1></div><p>kept words</p></article>", "kept words"),
        ("<svg width=1><g><p>kept words</p>", "kept words"),
        ("<svg><foreignObject><p>drawn</p></foreignObject></svg><p>kept words</p>", "kept words"),
        ("<div><iframe src=x><p>in</p></div><p>after words here</p>", "after words here"),
        ("<div><noscript><p>in</p></div><p>after words here</p>", "after words here"),
        ("<p>one two</p> 3 < 4 and <b", "one two\n\n3 < 4 and <b"),
        ("<p>one two</p>three <!-- <p>four", "one two\n\nthree"),
        ("no tags & <5", "no tags & <5"),
    ],
)
def test_broken_pages_keep_their_text(page, text):
    assert pages.main_text(page, pages.Weights({})) == text


def test_hot_label_and_extreme_vectors(spark):
    rng = np.random.default_rng(7)
    rows = [(k, rng.normal(size=4).tolist(), "hot") for k in range(60)]
    rows += [(100, [1e200, 0.0, 1e200, 0.0], "hot"), (101, [1e-200, 0.0, 1e-200, 0.0], "hot"), (102, [3.0, 0.0, 3.0, 0.0], "hot")]
    rows += [(103, [5e-324, 0.0, 0.0, 5e-324], "x"), (104, [1.7e308, 0.0, 0.0, 1.7e308], "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    seen = []
    try:
        for threshold in ("-1", "10m"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            seen.append(sorted(map(tuple, vectors.near_vectors(frame, tile=8).collect())))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert seen[0] == seen[1]
    unit = {k: np.array(v) / max(map(abs, v)) for k, v, _ in rows}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    label = {k: own for k, _, own in rows}
    for k, n, _, _ in seen[0]:
        assert n == sum(o != k and label[o] == label[k] and unit[o] @ unit[k] >= 0.93 for o in unit), k
    assert {row[0]: row[1] for row in seen[0]}[103] == 1


def test_tile_pairs_are_dealt_by_their_whole_key(spark):
    tiled = spark.createDataFrame([("a", 2, b, [b]) for b in range(5)], "label string, dims int, block long, rows array<int>")
    blocks = spark.createDataFrame([("a", 2, 5)], "label string, dims int, blocks long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = vectors.tile_pairs(tiled, blocks)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        found = sorted((r["left"][0], r["right"][0], r["same"]) for r in pairs.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == [(a, b, a == b) for a in range(5) for b in range(a, 5)]
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert len(joins) == 2 and all("_block" in line for line in joins)


def test_language_sample_shuffles_no_text_by_language(spark):
    rows = [(k, "some text", "aa", "s") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    plan = language.sample(docs, "doc_id", "text", "lang", 5)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert not [line for line in plan.splitlines() if "hashpartitioning(lang" in line and "text" not in line.split("hashpartitioning")[1]]


def test_dialogues_do_not_meet_by_their_id_alone(spark):
    rows = [(1, k, ("ann", "bob", "system")[k % 3], f"t{k}") for k in range(700)] + [(None, 0, "x", "y")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = chat.rotate(turns)
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = found.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert joins and all("salt" in line or "_part" in line for line in joins)
    assert sorted((r["conv_id"] or 0, r["perspective"], r["part"], r["n_turns"]) for r in rows) == [
        (0, "x", 0, 1), (1, "ann", 0, 256), (1, "ann", 1, 256), (1, "ann", 2, 188),
        (1, "bob", 0, 256), (1, "bob", 1, 256), (1, "bob", 2, 188),
    ]
