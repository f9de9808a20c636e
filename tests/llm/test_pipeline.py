import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from lodestone.llm import mixing, secrets

from .test_simhash import brute_components, brute_print
from .test_toxicity import corpus


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(5)
    rows, labels = corpus(240)
    rows = [(i, t, "en", "abc"[min(i % 5, 2)], len(t)) for i, t in rows]
    rows[7] = (7, rows[8][1], "en", "a", len(rows[8][1]))
    rows[13] = (13, "Words and token=" + "".join(r.choice("0123456789abcdef") for _ in range(18)) + " after.", "en", None, 0)
    rows += [(900, None, None, "b", None), (901, "", "en", "b", 0), (None, "an odd one without an id", "en", "b", 24), (7, rows[8][1], "en", "a", len(rows[8][1]))]
    where = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where), rows, dict(labels)


def test_stages(spark, tables):
    where, rows, labels = tables
    docs = spark.read.parquet(f"{where}/documents.parquet")
    kept = pipeline.drop_toxic(spark, docs, where)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    toxic = {i for i, bad in labels.items() if bad and i not in (7, 13)}
    assert len(set(ids) & toxic) <= 1 and len([i for i in ids if i is None]) == 1
    assert sum(i not in ids for i, bad in labels.items() if not bad) <= 1

    single = pipeline.drop_near_duplicates(spark, kept, where)
    assert single.columns == docs.columns
    before, after = kept.collect(), single.collect()
    prints = {r.doc_id: brute_print(r.text) for r in before if r.doc_id is not None}
    roots = brute_components(prints)
    none_kept = [r for r in after if r.doc_id is None]
    assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted(set(roots.values()))
    assert len(none_kept) == 1

    clean = pipeline.redact_secrets(spark, single, where)
    found = {r.doc_id: r for r in clean.collect()}
    assert len(found) == len(after) and found[13].text == "Words and [secret:assign] after." and found[13].n_chars == len(found[13].text)
    assert all(found[r.doc_id].text == r.text for r in after if not secrets.base_spans(r.text or "") and "[secret" not in (found[r.doc_id].text or ""))

    taken = {r.doc_id: r.reps for r in mixing.mix(clean).collect()}
    mixed = pipeline.mix_sources(spark, clean, where)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in taken.items() if n})

    packed = pipeline.pack_windows(spark, mixed, where).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r.length for r in packed) == sum(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in mixed.collect())


def test_run(spark, tables):
    where, _, _ = tables
    out = pipeline.run(spark, where)
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    assert out.agg(F.max("length")).first()[0] <= 1024


def test_clashing_columns(spark, tables):
    where, _, _ = tables
    docs = spark.read.parquet(f"{where}/documents.parquet").limit(60)
    for name in ("k", "th", "spans", "words", "reps", "i", "copy", "score", "count", "fp", "size", "key", "__k", "__TH", "___words", "__spans", "__i", "__copy", "__reps", "__source"):
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    columns = docs.columns
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, where)
        assert docs.columns == columns
    for name in columns[5:]:
        assert {r[name] for r in docs.select(name).distinct().collect()} == {f"own {name}"}
    assert docs.where("k = 'own k' and reps = 'own reps'").count() == docs.count() > 0


def test_empty(spark, tables, tmp_path):
    where, _, _ = tables
    spark.read.parquet(f"{where}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{where}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_many_rejected_are_neither_broadcast_nor_sorted(spark, monkeypatch):
    """Beyond the bound, what a stage rejects meets the texts by hash; within it, the driver holds some 24 MB at most."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)] + [(None, "a"), (None, None)], "doc_id long, text string")
    names = pipeline.Names(docs)
    rejected = names.keyed(docs.where("doc_id % 3 = 0 or text is null")).select(names.keys())
    want = sorted(map(repr, docs.where("not (coalesce(doc_id % 3 = 0, false) or text is null)").collect()))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        monkeypatch.setattr(pipeline, "BROADCAST_ROWS", 0)
        kept = pipeline._without(docs, rejected, names)
        plan = kept._jdf.queryExecution().sparkPlan().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Broadcast" not in plan, plan
        assert sorted(map(repr, kept.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    monkeypatch.undo()
    assert pipeline.BROADCAST_ROWS * 240 <= 24_000_000
    assert sorted(map(repr, pipeline._without(docs, rejected, names).collect())) == want
