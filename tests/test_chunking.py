import random

import pytest
from pyspark.sql import functions as F

from lodestone.errors import ChunkError
from lodestone.functions import text as T
from lodestone.operators import chunking
from lodestone.schemas import ChunkConfig

PAGES = "document_id string, page_number int, text string, extraction_status string"


def blank(s):
    return not s.strip()


def fill(items, most, glue, slack=0):
    """An independent statement of greedy filling: each piece takes as many items as fit."""
    out, at = [], 0
    while at < len(items):
        if items[at] == "" and glue == " ":
            at += 1
            continue
        end = at + 1
        while end < len(items) and len(glue.join(items[at : end + 1])) + slack <= most:
            end += 1
        out.append(glue.join(items[at:end]))
        at = end
    return out


def chunks_of(text, c):
    import re

    pieces = []
    for p in re.split(r"\n[ \t]*\n+", text):
        if blank(p):
            continue
        sentences = [s for s in re.split(r"(?<=[.!?])\s+", p) if not blank(s)]
        if len(p) <= c.max_chars:
            pieces.append(p)
        elif len(sentences) > 1:
            for g in fill(sentences, c.max_chars, " "):
                pieces += [g] if len(g) <= c.max_chars else fill(g.split(" "), c.max_chars, " ")
        else:
            pieces += fill(p.split(" "), c.max_chars, " ")
    found = fill(pieces, c.target_chars, "\n\n", 2)
    if len(found) > 1 and len(found[-1]) < c.min_chars and len(found[-2]) + 2 + len(found[-1]) <= c.max_chars:
        found[-2:] = [f"{found[-2]}\n\n{found[-1]}"]
    return found


def texts(seed=1):
    r = random.Random(seed)
    out = ["one", "a\n\nb", "x" * 300, "tail. " * 80 + "\n\nend", "no space" + "y" * 400 + " z", "a  \n \t\n\n b!", "Q? \x1c R. S", " lead  double  spaces " * 20]
    for _ in range(60):
        words = ["".join(r.choice("abcde.!?") for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 150))]
        out.append("".join(w + r.choice([" ", " ", " ", "\n", "\n\n", "\n \n", ". "]) for w in words))
    return out


@pytest.mark.parametrize("config", [ChunkConfig(), ChunkConfig(120, 180, 20), ChunkConfig(30, 60, 25)])
def test_chunks_match_an_independent_statement(spark, config):
    rows = [("d", i, t, "ok") for i, t in enumerate(texts(), 1)]
    got = {}
    for r in chunking.chunk_pages(spark.createDataFrame(rows, PAGES), config).orderBy("page_number", "chunk_index").collect():
        got.setdefault(r.page_number, []).append(r.text)
        assert r.chunk_id == f"d-p{r.page_number:03d}-c{r.chunk_index:03d}" and r.chunk_index == len(got[r.page_number])
    assert got == {i: chunks_of(t, config) for _, i, t, _ in rows if chunks_of(t, config)}


def test_pages_without_chunks_and_contract(spark):
    pages = spark.createDataFrame([("d", 3, "", "empty"), ("d", 1, "text", "failed"), ("d", 2, "words. here", "ok"), ("e", 1, None, None)], PAGES)
    chunks = chunking.chunk_pages(pages)
    stats = {r.document_id: r for r in chunking.chunk_statistics(pages, chunks).collect()}
    assert [tuple(p) for p in stats["d"].pages_without_chunks] == [(1, "failed"), (3, "empty")] and stats["d"].pages_with_chunks == [2]
    assert stats["e"].chunk_count == 0
    assert {r.status for r in chunking.contract_checks(chunks, 1800).collect()} == {"pass"}
    broken = chunks.union(chunks).withColumn("text", F.lit(" "))
    failed = {r.name for r in chunking.contract_checks(broken, 1800).collect() if r.status == "fail"}
    assert failed == {"chunk_ids_unique", "chunk_index_contiguous_per_page", "no_empty_chunks"}
    with pytest.raises(ChunkError):
        chunking.chunk_pages(spark.createDataFrame([(None, 1, "x", "ok")], PAGES))


def test_ids(spark):
    row = spark.range(1).select(
        T.chunk_id(F.lit("D-1"), F.lit(1000), F.lit(7)).alias("long"), T.chunk_id_parts(F.lit("D-1-p002-c010")).alias("p"), T.chunk_id_parts(F.lit("D-1-p1000-c010")).alias("q"),
        T.document_id(F.lit("/x/ab7-007-guide.pdf")).alias("d"), T.document_id(F.lit("Plain.pdf")).alias("e"), T.strip_ws(F.lit("  x\x1c\n")).alias("s"), T.control_ratio(F.lit("a\x01\tb")).alias("c"),
    ).first()
    assert row.long == "D-1-p1000-c007" and tuple(row.p) == ("D-1", 2, 10) and row.q.page_number is None
    assert (row.d, row.e, row.s, row.c) == ("AB7-007", "Plain", "x", 0.25)
