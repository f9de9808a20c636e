import hashlib
import json
import threading
import time
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from lodestone import checks, service
from lodestone.errors import IngestionError, RetrievalError
from lodestone.operators import embedding, records
from lodestone.sources import corpus, documents, files, ingest
from lodestone.streaming import queries as stream


def opener(content):
    """A stand-in for a document library: pages between form feeds; the word LOCKED encrypts, BROKEN fails a page."""
    text = content.decode()
    if text.startswith("JUNK"):
        raise ValueError("no document")
    if text.startswith("LOCKED"):
        return [], True, {}
    return [(RuntimeError("bad page") if "BROKEN" in p else p, 600.0, 800.0) for p in text.split("\f")], False, {"title": "T", "author": None}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    where = tmp_path_factory.mktemp("in")
    for name, text in (("ab-1-x.pdf", "one page\fBROKEN\f"), ("ab-2.pdf", "fine"), ("junk.pdf", "JUNK"), ("locked.pdf", "LOCKED"), ("changed.pdf", "new")):
        (where / name).write_text(text)
    return where


def manifest(spark, folder, names):
    rows = [(n, None, hashlib.sha256((folder / n).read_bytes()).hexdigest() if (folder / n).exists() else "0", p) for n, p in names]
    return spark.createDataFrame(rows, "filename string, document_id string, expected_sha256 string, expected_pages int")


def scanned(spark, folder, listed, **options):
    return ingest.scan(spark, str(folder), listed, opener, **options)


def test_gates(spark, folder):
    listed = manifest(spark, folder, [("ab-1-x.pdf", 3), ("ab-2.pdf", 2), ("junk.pdf", 1), ("locked.pdf", 1), ("gone.pdf", 1), ("changed.pdf", 1)])
    listed = listed.withColumn("expected_sha256", F.when(F.col("filename") == "changed.pdf", "00").otherwise(F.col("expected_sha256")))
    rows = scanned(spark, folder, listed)
    got = {r.filename: r for r in files.verify(rows, listed).collect()}
    assert got["ab-1-x.pdf"].reason is None and got["ab-1-x.pdf"].document_id == "AB-1" and got["ab-1-x.pdf"].sha256.isupper()
    assert {n: r.reason for n, r in got.items() if n != "ab-1-x.pdf"} == {"ab-2.pdf": "page count differs", "junk.pdf": "cannot be opened: ValueError: no document", "locked.pdf": "encrypted", "gone.pdf": "missing", "changed.pdf": "checksum differs"}
    with pytest.raises(IngestionError):
        files.require_verified(files.verify(rows, listed))
    assert got["ab-1-x.pdf"].metadata == {k: "T" if k == "title" else None for k in documents.METADATA_KEYS}


def test_a_field_that_cannot_be_read_is_null_alone(spark, tmp_path):
    (tmp_path / "a.pdf").write_text("x")

    def odd(content):
        return [("text", None, None)], False, {"title": "T", "author": ValueError("bad"), "creation_date_raw": 5}

    name = documents.register_pages(spark, odd, "odd_pages")
    found = spark.read.format(name).load(str(tmp_path)).where("page_number IS NULL").first().metadata
    assert found["title"] == "T" and found["author"] is None and found["creation_date_raw"] == "5" and set(found) == set(documents.METADATA_KEYS)


def test_a_long_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "big-1.pdf").write_text("\f".join(f"page {i}" for i in range(1, 10_001)))
    (tmp_path / "in" / "other-2.pdf").write_text("one")
    (tmp_path / "in" / "big-3.txt").write_text("not asked for")
    opened = tmp_path / "opened"
    opened.mkdir()

    def noting(content):
        with open(opened / str(time.time_ns()), "w") as f:
            f.write(content[:5].decode())
        return opener(content)

    name = documents.register_pages(spark, noting, "noting_pages")
    rows = spark.read.format(name).option("rangeBytes", 10_000).option("suffix", ".pdf").load(str(tmp_path / "in"))
    pages = rows.where("page_number IS NOT NULL AND filename = 'big-1.pdf'")
    held = pages.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.min("page_number").alias("low"), F.max("page_number").alias("high")).collect()
    assert len(held) == 10 and sum(r.n for r in held) == 10_000 and max(r.n for r in held) == 1000
    assert all(r.high - r.low + 1 == r.n for r in held)
    seen = [p.read_text() for p in opened.iterdir()]
    assert len(seen) == 10 and set(seen) == {"page "}  # the other file was not opened
    assert pages.where("page_number = 7001").first().text == "page 7001"
    facts = rows.where("page_number IS NULL").orderBy("filename").collect()
    assert [(r.filename, r.page_count) for r in facts] == [("big-1.pdf", 10_000), ("other-2.pdf", 1)]
    with pytest.raises(Exception, match="no file or folder"):
        spark.read.format(name).load(str(tmp_path / "nowhere")).count()


def test_checksums(spark):
    schema = "a string, b int, c array<string>, d struct<x:int,y:string>, e map<string,int>"
    rows = [("x", 1, ["p", None], (1, None), {"k": 1, "l": 2}), ("y", None, [], (None, "q"), None), ("x", 1, ["p", None], (1, None), {"l": 2, "k": 1})]
    base = checks.checksum(spark.createDataFrame(rows, schema))
    assert checks.checksum(spark.createDataFrame(rows[::-1], schema).repartition(3).select("e", "d", "c", "b", "a")) == base
    assert checks.checksum(spark.createDataFrame([], schema)) == (0, 0, 0)
    changed = [("z", 1, ["p", None], (1, None), {"k": 1, "l": 2}), ("x", 1, [None, "p"], (1, None), {"k": 1, "l": 2}), ("x", 1, ["p"], (1, None), {"k": 1, "l": 2}), ("x", 1, ["p", None], (None, "1"), {"k": 1, "l": 2}), ("x", 1, ["p", None], (1, None), {"k": 2, "l": 1}), ("x", None, ["p", None], (1, None), {"k": 1, "l": 2})]
    for other in changed:
        assert checks.checksum(spark.createDataFrame([other, *rows[1:]], schema)) != base
    assert checks.checksum(spark.createDataFrame([*rows, rows[0]], schema)) != base


def test_written_pages_are_compared(spark, tmp_path, monkeypatch):
    rows = [("A", 1, "one", None), ("A", 2, "two", None), ("007", 1, "three", None)]
    pages = spark.createDataFrame(rows, "document_id string, page_number int, text string, extraction_error string")
    again, changed = ingest.write_checked(pages, str(tmp_path / "good"), "v1")
    assert changed is None and sorted(tuple(r) for r in again.collect()) == sorted(rows)
    write = files.write_partitioned

    def bad(df, *args):
        write(df.withColumn("text", F.regexp_replace("text", "w", "v")), *args)

    monkeypatch.setattr(files, "write_partitioned", bad)
    _, changed = ingest.write_checked(pages, str(tmp_path / "bad"), "v1")
    assert [r.document_id for r in changed.collect()] == ["A"]


def test_ingestion(spark, folder, tmp_path, capsys):
    calls = tmp_path / "calls"
    calls.mkdir()

    def noting(content):
        (calls / str(time.time_ns())).write_text("")
        return opener(content)

    listed = manifest(spark, folder, [("ab-1-x.pdf", 3), ("ab-2.pdf", 1)])
    summary = ingest.run_ingestion(spark, str(folder), str(tmp_path), listed, "v1", noting, embedding.HashProvider(16))
    found = {r.document_id: r for r in summary.collect()}
    assert {d: (r.overall_status, r.reload_ok, r.page_count, r.empty_pages, r.failed_pages) for d, r in found.items()} == {"AB-1": ("fail", True, 3, [3], [2]), "AB-2": ("pass", True, 1, [], [])}
    assert len(list(calls.iterdir())) == 2  # one parse for each file, and none of files that the manifest has not
    report = {r.document_id: r for r in spark.read.json(f"{tmp_path}/report").collect()}
    assert report["AB-1"].ingestion_status == "partial" and report["AB-1"].failed_pages == [2] and report["AB-2"].embedded_chunks == report["AB-2"].total_chunks == 1
    checked = {(r.document_id, r.name): r.status for r in spark.read.json(f"{tmp_path}/validation").collect()}
    assert checked["AB-1", "reload_equivalent"] == "pass" and checked["AB-1", "extraction_failures"] == "fail"
    told = {r.document_id: r.provenance for r in spark.read.json(f"{tmp_path}/provenance").collect()}
    assert told["AB-2"].pdf_metadata.title == "T" and told["AB-2"].page_count == 1
    files.write_json(listed, f"{tmp_path}/manifest")
    assert ingest.main([str(folder), str(tmp_path / "cli"), "--manifest", f"{tmp_path}/manifest", "--corpus", "v1", "--opener", "tests.test_sources:opener"]) == 1
    assert "AB-2: pass, 1 pages, 4 characters" in capsys.readouterr().out
    files.write_json(listed.withColumn("expected_pages", F.lit(9)), f"{tmp_path}/manifest")
    assert ingest.main([str(folder), str(tmp_path / "cli2"), "--manifest", f"{tmp_path}/manifest", "--corpus", "v1", "--opener", "tests.test_sources:opener"]) == 2
    provider = embedding.HashProvider(16)
    loaded = corpus.load_corpus(spark, str(tmp_path), "v1", {provider.name: provider})
    assert loaded.index.count() == 2 and loaded.embedder is provider
    one = corpus.load_corpus(spark, str(tmp_path), "v1", {provider.name: provider}, "AB-2")
    assert [r.document_id for r in one.index.collect()] == ["AB-2"] and "document_id" in one.chunks.columns
    with pytest.raises(RetrievalError):
        corpus.load_corpus(spark, str(tmp_path), "v1", {"other": provider})
    with pytest.raises(RetrievalError):
        corpus.load_corpus(spark, str(tmp_path), "v0", {provider.name: provider})
    pages = {r.page_number: r for r in files.read_partitioned(spark, f"{tmp_path}/pages", "v1", "AB-1").collect()}
    assert {n: r.extraction_status for n, r in pages.items()} == {1: "ok", 2: "failed", 3: "empty"} and pages[2].extraction_error == "RuntimeError: bad page"
    assert files.read_partitioned(spark, f"{tmp_path}/pages", "v2").count() == 0
    plan = files.read_partitioned(spark, f"{tmp_path}/pages", "v1", "AB-1")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan
    with pytest.raises(IngestionError):
        files.write_partitioned(spark.range(1), str(tmp_path / "x"), "v1")


def test_json_and_paths(spark, tmp_path):
    rows = spark.createDataFrame([("a", None), ("é", 2), ("é", 2)], "k string, v int")
    files.write_json(rows, str(tmp_path / "j"))
    assert files.round_trip_equal(rows, str(tmp_path / "j")) and not files.round_trip_equal(rows.limit(1), str(tmp_path / "j"))
    assert files.read_json(spark, str(tmp_path / "j"), "k string, v int").count() == 3
    assert files.artifact_path("data", "parsed", "v1", "D", "parsed") == "data/parsed/v1/D/D.parsed.json"
    for bad in (lambda: files.artifact_path("d", "", "v", "D", "k"), lambda: files.embedding_dir("other"), lambda: documents.Pdf(b"x")):
        with pytest.raises(IngestionError):
            bad()
    assert files.env_value("A=1\nexport KEY = 'v' \n", "KEY") == "v" and files.env_value("KEY=\n", "KEY") is None and files.env_value("", "KEY") is None


def test_log_lines(spark):
    events = spark.createDataFrame([("INFO", "asked", "the question", 200)], "level string, message string, query string, status int")
    assert json.loads(records.log_lines(events).first().line) == {"level": "INFO", "message": "asked", "status": 200}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"query_id":"1","query":"what"}\n')
    ask = lambda batch: batch.withColumn("answer", F.upper("query"))
    for expected in (1, 2):
        stream.answer_stream(stream.query_stream(spark, str(tmp_path / "in"), 1), ask, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        assert spark.read.json(str(tmp_path / "out")).count() == expected
        (tmp_path / "in" / "b.json").write_text('{"query_id":"2","query":"why"}\n')


def test_requests():
    assert service.request_problem({"query": "x", "top_k": 50, "max_chars": 1}) is None
    for bad in ([], {}, {"query": " "}, {"query": "x", "top_k": 51}, {"query": "x", "top_k": True}, {"query": "x", "max_chars": 0}, {"query": "x", "api_key": 5}):
        assert service.handle(lambda b: {}, bad)[0] == 422

    def fail(body):
        raise RuntimeError("the key is 123")

    assert service.handle(fail, {"query": "x"}) == (500, {"detail": "RuntimeError"})


def test_server(capfd):
    server = service.serve(lambda b: {"echo": b["query"], "top_k": b["top_k"]}, lambda: {"status": "ok"}, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def call(path, data=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, data=data)) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    assert call("/health") == (200, {"status": "ok"}) and call("/x")[0] == 404
    assert call("/query", b'{"query": "hidden words", "api_key": "k3y"}') == (200, {"echo": "hidden words", "top_k": 5})
    assert call("/query", b"nonsense")[0] == 422 and call("/query", b'{"query": ""}')[0] == 422
    server.shutdown()
    logged = capfd.readouterr().err
    assert '"status": 200' in logged and "hidden" not in logged and "k3y" not in logged
