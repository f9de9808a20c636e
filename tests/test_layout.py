import pytest

from lodestone import schemas
from lodestone.operators import layout


def grid(page, columns, lines=40, words=5, pitch=30.0, size=22.0, shift=0.0):
    """Words of `columns` blocks (left edges) side by side."""
    out = []
    for line in range(lines):
        for b, left in enumerate(columns):
            for k in range(words):
                out.append((page, len(out), left + k * pitch + shift, left + k * pitch + size + shift, 50.0 + 12 * line, f"r{b}l{line}w{k}", True))
    return out


@pytest.fixture(scope="module")
def pages(spark):
    rows = grid("one", [60.0], words=16) + grid("two", [60.0, 330.0]) + grid("three", [40.0, 230.0, 420.0]) + grid("few", [60.0, 330.0], lines=4) + grid("table", [60.0, 330.0])
    rows += [("two", 9999, 268.0, 300.0, 62.0, "SIDE", False), ("few", 8888, 1.0, 2.0, 50.0, "kept", None)]
    words = spark.createDataFrame(rows, schemas.WORDS).repartition(4)
    cells = spark.createDataFrame([("table", 60.0, 0.0, 270.0, 9.0), ("table", None, 0.0, 268.04, 9.0)], schemas.CELLS)
    widths = spark.createDataFrame([(p, 600.0) for p in ("one", "two", "three", "few", "table", "blank")], "page_id string, page_width double")
    return words, cells, widths


def test_reading_order(pages):
    got = {r.page_id: r for r in layout.reading_order(*pages).collect()}
    assert {p: r.region_count for p, r in got.items()} == {"one": 1, "two": 2, "three": 3, "few": 1, "table": 1, "blank": 1}
    two = got["two"]
    assert two.is_two_column and not two.fallback_used and two.left_word_count == two.right_word_count == 200
    assert "SIDE" not in two.text and two.text.index("r0l39w4") < two.text.index("r1l0w0")
    assert two.text.split("\n")[0] == "r0l0w0 r0l0w1 r0l0w2 r0l0w3 r0l0w4"
    assert [x.word_count for x in got["three"].regions] == [200, 200, 200]
    assert got["few"].fallback_used and got["few"].text.startswith("kept ") and got["few"].right_word_count == 0
    assert got["blank"].text == "" and got["blank"].word_count == 0
    g = two.gutters[0]
    assert g.start > 202 and g.end < 330 and g.mid == (g.start + g.end) / 2 and g.width >= 6 and g.left_lines == g.right_lines == 40 * 1


def test_table_guard(pages, spark):
    words, _, widths = pages
    found = layout.gutters(layout.line_segments(layout.upright(words)), widths).where("page_id = 'table'")
    mid = found.first().mid
    near = spark.createDataFrame([("table", mid - 9.0, 0.0, 10.0, 1.0)], schemas.CELLS)
    assert [r.rejected for r in layout.guard_tables(found, near).collect()] == [True]
    far = spark.createDataFrame([("table", mid - 11.0, 0.0, 10.0, 1.0)], schemas.CELLS)
    assert [r.rejected for r in layout.guard_tables(found, far).collect()] == [False]
    assert layout.column_split(found).first().split_x == mid


def test_segments(spark):
    rows = [("p", 0, 10.0, 20.0, 49.6, "a", True), ("p", 1, 28.0, 40.0, 50.4, "b", True), ("p", 2, 48.5, 60.0, 50.0, "c", True), ("p", 3, 10.0, 12.0, 50.0, "tie", True)]
    words = spark.createDataFrame(rows, schemas.WORDS)
    got = sorted((r.row, r.segment, r.x0, r.x1, r.words) for r in layout.line_segments(words).collect())
    assert got == [(50, 0, 10.0, 12.0, 2), (50, 1, 28.0, 40.0, 1), (50, 2, 48.5, 60.0, 1)]
