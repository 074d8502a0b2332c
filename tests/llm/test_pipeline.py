from collections import Counter

import corpus_pipeline
from docs import frame, rows
from orderledger.llm import language, near_duplicates, packing, toxicity
from orderledger.sources import stage_table
from test_near_duplicates import brute
from test_packing import check

SF = "/root/testdata/sf0.01"


def test_every_stage_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage_table(stage(spark, docs, SF), name)
        assert docs.columns == columns
        kept[name] = (before, docs)
    final = rows(corpus_pipeline.STAGES[-1][1](spark, docs, SF))
    sequences, tokens = check(final, [tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert sequences <= 1.02 * tokens / 2048 + 2

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before, after = kept["toxicity"]
    gone = {r[0] for r in before.join(after, "doc_id", "left_anti").select("doc_id").collect()}
    assert gone == {r["doc_id"] for r in rows(toxicity.detect(before, labels)) if r["predicted"]} and gone
    before, after = kept["language"]
    gone = {r[0] for r in before.join(after, "doc_id", "left_anti").select("doc_id").collect()}
    assert gone == {r["doc_id"] for r in rows(language.identify(before)) if r["rejected"]}
    before, after = kept["near_duplicates"]
    flat = [(i, " ".join(t.split())) for i, t in before.select("doc_id", "text").collect()]
    assert {r["doc_id"] for r in rows(after)} == {c for _, c, _ in brute(flat)}
    before, after = kept["secrets"]
    assert before.count() == after.count()
    changed = before.join(after.withColumnRenamed("text", "now"), "doc_id").where("text <> now")
    assert changed.count() and changed.where("now not like '%[SECRET]%'").count() == 0
    leaked = after.where("text rlike 'AKIA[A-Z0-9]{16}|password=[0-9a-f]{18}|token = \"[0-9a-f]{40}'")
    assert leaked.count() == 0


def test_one_of_each_with_awkward_rows(spark):
    made = [(3, "five words and one more here"), (3, "five words and one more here"), (2, "five words and one more here"), (None, "five words and one more here"),
            (None, "only null ids have this text"), (None, "only null ids have this text"), (7, None), (7, None), (8, ""), (1, "alone"), (1, "another")]
    got = near_duplicates.one_of_each(frame(spark, made, extra=True))
    expected = Counter([(2, made[2][1]), (None, made[4][1]), (7, None), (7, None), (8, ""), (1, "alone"), (1, "another")])
    assert Counter((r["doc_id"], r["text"]) for r in rows(got)) == expected
    assert got.columns == frame(spark, made, extra=True).columns


def test_a_worker_is_left_with_empty_caches(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        stage(spark, docs, SF).write.format("noop").mode("overwrite").save()

    def held(batches):
        import pyarrow as pa

        from orderledger.llm import toxicity, words

        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([len(words._hashes) + toxicity.fold.cache_info().currsize])], ["n"])

    assert {r.n for r in spark.range(0, 64, 1, 16).mapInArrow(held, "n long").collect()} == {0}


def test_empty_tables(spark):
    none = frame(spark, [])
    for keep in (language.keep_accepted, near_duplicates.one_of_each, packing.pack_documents):
        assert keep(none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.keep_clean(none, labels).count() == 0
    assert toxicity.keep_clean(frame(spark, [(1, None), (2, "x")], extra=True), labels).count() == 2
