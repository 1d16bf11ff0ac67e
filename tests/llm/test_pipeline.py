"""The pipeline's stages against their operators' brute-force results."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from sievelog.llm import quality
from sievelog.llm.queries import table
from tests.llm.test_documents import brute_hits, brute_near


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "decontaminate", "packing"]
    stages = dict(corpus_pipeline.STAGES)

    def ids(df):
        assert df.columns == columns
        return sorted(r.doc_id for r in df.collect())

    kept = stages["quality"](spark, docs, sf).cache()
    good = {r.doc_id for r in quality.scores(docs, table(spark, sf, "labels")).collect() if r.predicted == 1}
    assert ids(kept) == sorted(good)
    once = stages["exact_dedup"](spark, kept, sf).cache()
    first = {}
    for r in sorted(kept.collect(), key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r.doc_id)
    assert ids(once) == sorted(first.values())
    near = stages["near_dedup"](spark, once, sf).cache()
    assert ids(near) == sorted(r[0] for r in brute_near([(r.doc_id, r.text) for r in once.collect()]) if r[3])
    some = near.limit(60).cache()
    clean = stages["decontaminate"](spark, some, sf)
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    assert ids(clean) == sorted(r[0] for r in brute_hits([(r.doc_id, r.text) for r in some.collect()], items) if not r[5])
    packed = stages["packing"](spark, clean, sf)
    assert {r.doc_id for r in packed.collect()} == set(ids(clean))


def test_rows_without_ids_stay(spark, sf):
    docs = spark.createDataFrame([(None, "a b c d e f", 1), (1, "a b c d e f", 2), (2, "a b c d e f", 3)], "doc_id long, text string, keep_id int")
    rows = corpus_pipeline.keep_one_of_near(spark, corpus_pipeline.keep_first_copies(spark, docs, sf), sf).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "None"] and docs.columns == ["doc_id", "text", "keep_id"]


def test_rows_are_judged_by_themselves(spark, sf):
    item = table(spark, sf, "benchmark").where("length(text) > 100").first().text
    clean = [" ".join(f"{c}{i}" for i in range(60)) for c in ("a", "b", "c")]
    rows = [(None, item, 1), (5, item, 2), (5, clean[0], 3), (None, clean[1], 4), (7, clean[2], 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    assert sorted(r.n for r in corpus_pipeline.keep_uncontaminated(spark, docs, sf).collect()) == [3, 4, 5]
    # of rows of one id, copies go and others stay
    near = clean[0] + " more"
    rows = [(5, clean[0], 1), (5, clean[1], 2), (9, clean[0], 3), (9, clean[2], 4), (9, clean[2], 5), (10, near, 6), (10, item, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    once = corpus_pipeline.keep_first_copies(spark, docs, sf).cache()
    assert sorted(r.n for r in once.collect()) in ([1, 2, 4, 6, 7], [1, 2, 5, 6, 7]) and once.columns == docs.columns
    assert sorted({r.n for r in corpus_pipeline.keep_one_of_near(spark, once, sf).collect()} - {4, 5}) == [1, 2, 7]
    # quality: rows without an id, and with a shared one, are scored as with ids of their own
    given = table(spark, sf, "documents").select("doc_id", "text").limit(300).cache()
    alone = {r.doc_id: r.predicted for r in quality.scores(given, table(spark, sf, "labels")).collect()}
    mixed = given.select("text", F.col("doc_id").alias("n")).withColumn("doc_id", F.when(F.col("n") % 2 == 0, F.col("n")))
    kept = {r.n for r in corpus_pipeline.keep_quality(spark, mixed, sf).collect()}
    odd = quality.scores(mixed, table(spark, sf, "labels"), "n").where("predicted = 1").collect()
    assert kept == {r.n for r in odd} and len(kept) < len(alone) and any(n % 2 for n in set(alone) - kept)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
