import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions import hashing
from folioscope.operators import chunking, tables


def test_a_chunk_may_exceed_size_and_share_a_start():
    assert chunking.spans("abc\n\nxxxxxxxxx", 10, 5, "chars") == [(0, 5), (0, 14)]


def test_blank_and_null_pages_and_bad_settings():
    assert chunking.spans(None, 10, 2, "chars") == chunking.spans(" \n ", 10, 2, "chars") == []
    with pytest.raises(ValueError):
        chunking.spans("x", 10, 10, "chars")
    with pytest.raises(ValueError):
        chunking.spans("x", 10, 2, "words")


@settings(max_examples=300, deadline=None)
@given(st.text("ab. \n", max_size=200), st.integers(2, 30), st.data())
def test_pieces_tile_and_chunks_cover(text, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    for unit in ("chars", "tokens"):
        length = chunking.measure(text, unit)
        tile = [*chunking.pieces(text, size, length)] if text else []
        assert "".join(text[a:b] for a, b in tile) == text
        assert all(length(a, b) <= size or b - a == 1 for a, b in tile)
        out = chunking.spans(text, size, overlap, unit)
        if not text.strip():
            assert out == []
            continue
        assert out[0][0] == 0 and out[-1][1] == len(text)
        assert all(length(a, b) <= size + overlap for a, b in out)
        assert all(a[0] <= b[0] <= a[1] and a[1] < b[1] for a, b in zip(out, out[1:]))


def test_a_very_long_word_and_page():
    text = "x" * 20_000
    assert chunking.spans(text, 400, 40, "chars")[1] == (360, 760)
    assert len(chunking.spans("word " * 100_000)) > 200


def test_pages_to_chunks(spark):
    pages = spark.createDataFrame([("D", 1, "one two\n\nthree four", "Co"), ("D", 2, "  ", "Co"), ("D", 3, None, "Co"), ("D", 4, "ünï 𝒳 cödé end", "Co")], "doc_id string, page_num int, text string, company string")
    rows = chunking.chunk_pages(pages, 10, 2, "chars").orderBy("page_num", "end").collect()
    source = {1: "one two\n\nthree four", 4: "ünï 𝒳 cödé end"}
    assert {r["page_num"] for r in rows} == {1, 4} and all(r["text"] == source[r["page_num"]][r["start"] : r["end"]] for r in rows)
    assert rows[0]["chunk_id"] == hashlib.sha256(b"D:1:0").hexdigest()[:16] and rows[0]["company"] == "Co"
    assert chunking.chunk_pages(pages.where("false")).count() == 0


def test_identities(spark):
    row = spark.createDataFrame([("a", "question", None)], "t string, q string, g string").select(
        hashing.text_key("rev", F.col("t")).alias("k"), hashing.joined_key(F.col("q"), F.col("g"), F.lit("s")).alias("j"), hashing.table_chunk_id(F.lit("D"), F.lit(1), F.lit(3), F.lit(0)).alias("c"), hashing.point_id(F.lit("ffffffffffffffff")).alias("p")
    ).first()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert row["k"] == digest("rev\0a") and row["j"] == digest("question\0\0s") and row["c"] == digest("D:1:t3:0")[:16] and int(row["p"]) == 2**64 - 1
    ids = spark.createDataFrame([("b",), ("a",)], "id string")
    assert hashing.fingerprint(ids, "id").first()[0] == digest("a\0b\0")
    once = hashing.content_fingerprint(ids, "id").first()
    assert hashing.content_fingerprint(ids.repartition(3), "id").first() == once and hashing.content_fingerprint(ids.limit(1), "id").first() != once


def cell(row, col, text, head=False):
    return (text, row, col, 1, 1, head, False, False)


def one_table(spark, cells, rows=None, cols=None, caption=None):
    return spark.createDataFrame([((rows, cols, caption, cells),)], f"table {tables.TABLE}")


def rendered(df):
    header, body = tables.markdown(F.col("table"))
    r = df.select(tables.flat(F.col("table")).alias("flat"), header.alias("h"), body.alias("b"), tables.linearized(F.col("table")).alias("l")).first()
    return r["flat"], r["h"], r["b"], r["l"]


def test_tables(spark):
    two_heads = [cell(0, 1, "Year Ended", True), cell(0, 2, "Year Ended", True), cell(1, 1, "2022", True), cell(1, 2, "2021", True), cell(2, 0, "Net revenue"), cell(2, 1, "23,601"), cell(2, 2, "16,434"), cell(3, 0, "Costs | all\nof"), cell(4, 1, " 7 "), cell(4, 1, "later"), cell(9, 9, "out")]
    flat, head, body, lines = rendered(one_table(spark, two_heads, 5, 3, " In millions "))
    assert flat == "In millions\nYear Ended Year Ended\n2022 2021\nNet revenue 23,601 16,434\nCosts | all\nof\n7"
    assert head == ["|  | Year Ended | Year Ended |", "|  | 2022 | 2021 |", "| --- | --- | --- |"]
    assert body == ["| Net revenue | 23,601 | 16,434 |", "| Costs \\| all of |  |  |", "|  | 7 |  |"]
    assert lines == ["Net revenue — Year Ended 2022: 23,601; Year Ended 2021: 16,434", "Costs | all of", "7 — Year Ended 2022: 7"]


def test_tables_without_headers_size_or_cells(spark):
    flat, head, body, lines = rendered(one_table(spark, [cell(0, 0, "Net sales"), cell(0, 1, ""), cell(1, 0, "a"), cell(1, 1, "100")]))
    assert (flat, head, body, lines) == ("Net sales\na 100", ["| Net sales |  |", "| --- | --- |"], ["| a | 100 |"], ["a — col1: 100"])
    assert rendered(one_table(spark, [])) == rendered(one_table(spark, None)) == ("", [], [], [])


ELEMENTS = f"doc_id string, element_index int, page_num int, element_type string, text string, table {tables.TABLE}"


def elements(spark, rows=20):
    grid = [cell(0, 0, "item", True), cell(0, 1, "2022", True)] + [c for r in range(1, rows + 1) for c in (cell(r, 0, f"row {r}"), cell(r, 1, str(100 * r)))]
    return spark.createDataFrame([("D", 0, 1, "heading", "Balance sheet", None), ("D", 1, 1, "text", "Some prose that is here.", None), ("D", 2, 1, "text", "(in millions)", None), ("D", 3, 1, "table", "", (rows + 1, 2, "Balance sheet", grid)), ("D", 4, None, "text", "placeless", None), ("D", None, 2, "text", "Next page", None)], ELEMENTS)


def test_element_modes(spark):
    df = elements(spark)
    flat = chunking.chunk_elements(df, "flat", 2000, 10, "chars").orderBy("page_num").collect()
    assert [r["page_num"] for r in flat] == [1, 2] and "row 3 300" in flat[0]["text"] and "|" not in flat[0]["text"]
    parts = [r["text"] for r in chunking.chunk_elements(df, "markdown", 90, 10, "chars").collect() if "|" in r["text"]]
    assert len(parts) > 3 and all(p.startswith("Balance sheet\n(in millions)\n| item | 2022 |\n| --- | --- |\n| row") and len(p) <= 90 for p in parts)
    lines = [r["text"] for r in chunking.chunk_elements(df, "linearized", 4000, 10, "chars").collect()]
    assert any(t.startswith("Balance sheet\n(in millions)\nrow 1 — 2022: 100\n") and t.endswith("row 20 — 2022: 2000") for t in lines)
    with pytest.raises(ValueError):
        chunking.chunk_elements(df, "html")
    assert chunking.chunk_elements(df.where("false"), "markdown").count() == 0


def test_a_cell_longer_than_the_size_is_cut(spark):
    parts = chunking.table_parts("", ["| a |", "| --- |"], ["| " + "word " * 180 + "|"], "", 200, 20, "chars")
    assert len(parts) > 3 and all(len(p) <= 220 for p in parts)
    assert chunking.table_parts("T", [], [], " plain ", 50, 5, "chars") == ["T\nplain"] and chunking.table_parts("", [], [], "", 50, 5, "chars") == []
