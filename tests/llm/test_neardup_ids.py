"""Rows that repeat an id: one document, whatever the number of its texts."""

from lumenfold.llm import neardup


def text(name, change=None):
    return " ".join("other" if i == change else f"{name}{i}" for i in range(200))


def classes(spark, rows):
    got = {}
    for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect():
        got.setdefault(r.doc_id, set()).add(r.class_id)
    return got


def test_exact_copies_of_different_texts_of_an_id(spark):
    rows = [(2, text("a")), (9, text("a")), (9, text("b")), (11, text("b")), (12, text("c")), (13, text("c"))]
    rows += [(20, text("d")), (21, text("e")), (22, text("e")), (22, text("d")), (30, None), (30, text("d"))]
    assert classes(spark, rows) == {2: {2}, 9: {2}, 11: {2}, 12: {12}, 13: {12}, 20: {20}, 21: {20}, 22: {20}, 30: {20}}


def test_near_copies_of_different_texts_of_an_id(spark):
    rows = [(1, text("a")), (3, text("a", 50)), (3, text("b")), (4, text("b", 50)), (5, text("c"))]
    assert classes(spark, rows) == {1: {1}, 3: {1}, 4: {1}, 5: {5}}


def test_one_of_repeated_rows_stays(spark):
    rows = [(1, text("a"), "x"), (1, text("a"), "y"), (1, text("b"), "z"), (2, text("a"), "u"), (None, text("c"), "v"), (None, text("c"), "v"), (7, None, "w"), (8, text("d"), "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = neardup.drop_copies(df)
    assert got.columns == df.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [rows[0], rows[2], rows[4], rows[6], rows[7]]))
