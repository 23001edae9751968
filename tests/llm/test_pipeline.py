import hashlib

import corpus_pipeline
from tests.llm.helpers import docs_of, partition
from tests.llm.test_lines import brute as slow_lines
from tests.llm.test_simhash import shingle_set

SF = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "source_mix", "byte_bpe"]
    first = stages["language_id"](spark, docs, SF)
    kept = {r.doc_id: r for r in first.collect()}
    letters = {r.doc_id for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}
    assert set(kept) <= letters and len(kept) >= 0.97 * len(letters) and first.columns == docs.columns

    rows = [(r.doc_id, r.text) for r in kept.values()]
    second = stages["line_dedup"](spark, first, SF).collect()
    wanted = slow_lines(rows)
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in second} == {i: w[2] for i, w in wanted.items()}

    second_df = spark.createDataFrame(second, docs.schema)
    third = stages["near_dedup"](spark, second_df, SF).collect()
    sets = {r.doc_id: shingle_set(r.text) for r in second}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    stays = {r.doc_id for r in third}
    parts = partition([(a, b) for a in sets for b in sets if a < b and alike(a, b) >= 0.8], list(sets))
    assert stays == set(parts.values())

    fourth = stages["source_mix"](spark, spark.createDataFrame(third, docs.schema), SF)
    assert sorted(map(str, fourth.collect())) == sorted(map(str, third)) and fourth.columns == docs.columns
    last = stages["byte_bpe"](spark, fourth, SF).collect()
    assert {r.doc_id: r.decoded_sha256 for r in last} == {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in third}


def test_run_and_odd_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 50
    rows = [(1, None, "en", "a", 0), (None, "the same text", "en", None, 3), (2, "the same text", None, "a", 3), (2, "the same text", "en", "a", 3), (3, "", "en", "b", 0)]
    for name, own in (("odd", rows), ("none", [])):
        docs_of(spark, own).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
