import corpus_pipeline as c

from strandline.llm.common import stage
from strandline.llm.language_id import Model, held_out, predict
from tests.llm.test_minhash_dedup import brute as components


def test_stages_in_order_and_decisions_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in c.STAGES] == ["language_id", "minhash_dedup", "substring_dedup", "mixing", "packing"] and c.ORACLE_SQL is None
    seen = {}
    for name, step in c.STAGES:
        before, docs = docs, stage(step(spark, docs, sf), name)
        seen[name] = (before, docs)
        assert name == "packing" or docs.columns == columns
    before, after = seen["language_id"]
    model = Model.learn(before.filter(~held_out()).select("text", "lang"))
    kept = {r.doc_id for r in after.collect()}
    for r in before.collect():
        lang, _, _, fits = predict(model, [(r.text or "").encode()])
        assert (r.doc_id in kept) == fits[0] and (fits[0] <= (lang[0] != "und"))
    before, after = seen["minhash_dedup"]
    rows = [(r.doc_id, r.text, None, None) for r in before.collect()]
    assert {r.doc_id for r in after.collect()} == {d for d, _, comp in components(rows, 5) if d == comp}
    before, after = seen["substring_dedup"]
    assert before.count() == after.count()
    before, after = seen["mixing"]
    assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
    before, after = seen["packing"]
    sizes = {(r.sequence_id): r.n for r in after.groupBy("sequence_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert all(n <= 4096 and n & (n - 1) == 0 for n in sizes.values())
    whole = after.filter("start = 0").count()
    assert whole == before.count()


def test_run(spark):
    assert c.run(spark, "/root/testdata/sf0.001").count() > 0
