import re

import corpus_pipeline as P
from pyspark.sql import functions as F
from townpulse.llm import merge_dropout, secret_scan

SMALL = "/root/testdata/sf0.001"


def test_stages_against_plain_checks(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(-1, "123 !!", None, None, 6), (-2, None, None, None, None)], docs.schema))
    seen = []
    for name, stage in P.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, SMALL)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        after = {r.doc_id: r for r in docs.collect()}
        seen.append(name)
        if name != "merge_dropout":
            assert tuple(docs.columns) == P.COLUMNS
        if name == "language_id":
            assert before.keys() - after.keys() == {-1, -2}
        if name == "ngram_jaccard":
            from test_llm_ngram_jaccard import plain

            rows = [(r.doc_id, r.text) for r in before.values()]
            firsts = {int(line.split(", ")[0][1:]) for line in plain(rows) if line.split(", ")[0][1:] == line.split(", ")[2][:-1]}
            assert after.keys() == firsts
        if name == "decontamination":
            items = [
                re.findall(r"[^\W_]+", r.text.lower()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
            ]
            held = {
                i
                for i, r in before.items()
                for words in items
                if f" {' '.join(words)} " in f" {' '.join(re.findall(r'[^\W_]+', r.text.lower()))} "
            }
            assert held and not held & after.keys() and len(before.keys() - after.keys() - held) <= 1
        if name == "secret_scan":
            assert after.keys() == before.keys()
            for i, r in after.items():
                want = before[i].text
                spans = sorted((m.start(), m.end()) for rule in secret_scan.RULES for m in re.finditer(rule.pattern, want, re.ASCII) if len(m.group(rule.group)) >= rule.least)
                out, at = "", 0
                for a, b in spans:
                    if a >= at:
                        out += want[at:a] + "[secret]"
                    at = max(at, b)
                assert r.text == out + want[at:] and r.n_chars == len(r.text)
        if name == "merge_dropout":
            model = merge_dropout.load_model(P.public_tokenizers.path("piece_bpe_32k.model"))
            assert after.keys() == before.keys()
            assert all(merge_dropout.decode_ids(r.ids, model) == before[i].text for i, r in after.items())
    assert seen == ["language_id", "ngram_jaccard", "decontamination", "secret_scan", "merge_dropout"]


def test_run(spark):
    found = P.run(spark, SMALL)
    assert found.columns == ["doc_id", "ids", "lossless"] and found.where(~F.col("lossless")).count() == 0


def test_stages_pass_texts_to_python_in_batches_bounded_by_bytes(spark):
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes], pa.int64())], names=["n"])

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    long = spark.range(0, 40, 1, 1).selectExpr("repeat('x', 1000000) AS text")
    for _, stage in P.STAGES[:1] + P.STAGES[-1:]:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        assert stage(spark, docs, SMALL).count() == docs.count()
        found = [r.n for r in long.mapInArrow(sizes, "n bigint").collect()]
        # a batch ends with the row that goes beyond the bound
        assert sum(found) > 40_000_000 and max(found) < P.BATCH_BYTES + 2_000_000
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
