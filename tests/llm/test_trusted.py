"""Operator 10 counts every trusted document, whatever their number and the kind of their ids."""

import pytest

from logjury.llm import rules


def test_all_trusted_documents_count(spark):
    texts = [(k, f"word{k % 97} some{k % 89} other{k}") for k in range(6000)]
    docs = spark.createDataFrame([*texts, (None, "no id"), (7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 6 > 0), int(k % 50 == 1)) for k in range(6000)], "doc_id long, quality int, toxic int")
    assert rules.trusted_documents(docs, labels).count() > rules.trusted_for(docs.count())
    size = rules.buckets_for(docs.count())
    of = rules.ratios(docs, rules.trusted_documents(docs, labels), buckets=size).first()[0]
    grams = docs.where("doc_id is not null and text is not null").select("doc_id", rules.ngrams(docs["text"], size).alias("b"))
    want = {r["doc_id"]: sum(of[b] for b in r["b"]) / len(r["b"]) for r in grams.collect()}
    rows = [r for r in rules.judge_quality(docs, labels).collect() if r["doc_id"] is not None and r["n_words"]]
    assert len(rows) == len(want) == 6000
    assert all(r["log_ratio"] == pytest.approx(want[r["doc_id"]], abs=1e-9) for r in rows)


@pytest.mark.parametrize("kinds", [("long", "long"), ("int", "long"), ("string", "string"), ("decimal(20,0)", "long")])
def test_kinds_of_ids(spark, kinds):
    ids = [0, 1, 63, 64, 65, -1, -63, -64, -65, 2**31 - 1, -(2**31)]
    if "int" not in kinds:
        ids += [2**63 - 1, -(2**63), 10**15]
    docs = spark.createDataFrame([(str(k), f"text of n{n} and n{n}") for n, k in enumerate(ids)] + [("5", "copy"), ("5", "copy"), (None, "none")], "doc_id string, text string")
    labels = spark.createDataFrame([(str(k), n % 2, 0) for n, k in enumerate(ids)] + [("5", 1, None), ("5", 1, 0), ("1", 0, 1), ("64", 1, 1), (None, 1, 0)], "doc_id string, quality int, toxic int")
    docs, labels = (f.withColumn("doc_id", f["doc_id"].cast(kind)) for f, kind in zip((docs, labels), kinds, strict=True))
    one = rules.ratios_of_labelled(docs, labels, "text", 256).first()[0]
    two = rules.ratios(docs, rules.trusted_documents(docs, labels), buckets=256).first()[0]
    assert one == pytest.approx(two) and any(one)


def test_no_text_is_dealt_by_id(spark):
    docs = spark.range(100_000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    labels = docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        plan = rules.ratios_of_labelled(docs, labels, "text", 64)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
