"""The pipeline's stages on odd rows, and all of it against a version in plain Python."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from test_operators import SCHEMA, WORD, brute_components, brute_fingerprint, corpus

import corpus_pipeline
from logjury.llm import mixing, packing, quality
from logjury.llm.shared import table


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with nulls, empty and long texts, copies, repeated rows and columns of clashing names."""
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(k, 0 if k % 8 in (1, 2) else 1, 0) for k in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_names_and_order():
    numbers = [("quality", 4), ("language", 8), ("SimHash", 6), ("mixing", 1), ("packing", 5)]
    assert [name.split()[0] for name, _ in corpus_pipeline.STAGES] == [name for name, _ in numbers]


def test_stages_keep_columns(spark, folder):
    docs = table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.schema == docs.schema, name
        assert stage(spark, docs.where("false"), folder).count() == 0, name
        given = {str(r) for r in docs.collect()}
        assert {str(r) for r in kept.collect()} <= given, name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs.where("false"), folder).columns == packing.NAMES


def _scored(text, weights):
    """The classifier word by word."""
    parts = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x09-\x0d\x20]+", (text or "").encode())
    hashes, shapes = [], []
    for part in parts:
        _, value, _ = quality.words(np.frombuffer(part, dtype=np.uint8))
        hashes.append(value[0])
        is_sign = not re.match(rb"[0-9A-Za-z\x80-\xff]", part)
        capital = re.match(rb"[A-Z]", part) is not None
        shapes.append(3 if is_sign else 2 if re.fullmatch(rb"[A-Z]{2,}", part) else int(capital))
    found = list(hashes)
    for k in range(len(hashes) - 1):
        found.append(quality._mix(np.array([(3 * int(hashes[k]) + int(hashes[k + 1])) % (1 << 64)], dtype=np.uint64))[0])
        shape = (shapes[k] * 4 + shapes[k + 1]) * 2 + (hashes[k] == hashes[k + 1])
        found.append(quality._mix(np.array([shape + 1], dtype=np.uint64))[0])
    size = np.uint64((1 << quality.BITS) - 1)
    total = sum(float(weights[int(h & size)]) for h in found) / (len(parts) + quality.PRIOR_WORDS) + float(weights[-1])
    return 1 / (1 + np.exp(-total))


def _mixed(rows):
    """Copies of every row ``(id, text, source)``, by the words of the method."""
    size = {k: len(WORD.findall(r[1] or "")) for k, r in enumerate(rows)}
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    has = {s: sum(size[k] for k, r in enumerate(rows) if r[2] == s) for s in sources}
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sources)}
    left, open_, target = 1.5 * sum(has.values()), set(sources), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * has[s] <= weight[s] * level}
        for s in full or open_:
            target[s] = 2 * has[s] if full else weight[s] * level
        left -= sum(2 * has[s] for s in full)
        open_ -= full or open_
    copies = Counter()
    for s in sources:
        own = sorted((k for k, r in enumerate(rows) if r[2] == s), key=lambda k: (size[k], f"{rows[k][0]}|"))
        each = int(target[s] / has[s] * mixing.ONE + 0.5) if has[s] else 0
        name = "none" if s is None else f"s{s}"
        at = int(hashlib.md5(f"{mixing.SEED}|{name}".encode()).hexdigest()[:6], 16)
        for k in own:
            copies[rows[k][0]] += (at + each) // mixing.ONE - at // mixing.ONE
            at += each
    return +copies


def test_against_plain_python(spark, folder):
    docs = table(spark, folder, "documents").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    path = f"{folder}/named"
    docs.write.parquet(f"{path}/documents.parquet")
    table(spark, folder, "labels").write.parquet(f"{path}/labels.parquet")
    docs = table(spark, path, "documents")
    weights = quality.fit(docs, table(spark, path, "labels"))
    rows = [r for r in docs.collect() if _scored(r["text"], weights) >= quality.KEEP]
    rows = sorted((r for r in rows if any(c.isalpha() for c in r["text"] or "")), key=lambda r: r["doc_id"])
    groups = brute_components(
        [brute_fingerprint(r["text"]) for r in rows], lambda a, b: (a ^ b).bit_count() <= 4
    )
    rows = [(r["doc_id"], r["text"], r["source"]) for k, r in enumerate(rows) if groups[k] == k]
    copies = _mixed(rows)
    from public_tokenizers import path as tokenizer_path
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    want = {k: copies[k] * (len(own.encode(t or "", add_special_tokens=False).ids) + 1) for k, t, _ in rows if copies[k]}
    found = corpus_pipeline.run(spark, path).collect()
    got = Counter()
    for r in found:
        got[r["doc_id"]] += r["length"]
    assert dict(got) == want and len(want) > 50
    assert {r["sequence_id"] for r in found if r["offset"] == 0} == {r["sequence_id"] for r in found}
