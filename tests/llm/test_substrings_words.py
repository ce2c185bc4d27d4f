"""The word total of the corpus, which decides how many buckets there are."""

from lumenfold.llm import substrings


def test_words_are_counted_beside_many_reported_runs(spark):
    data = [(i, " ".join([f"x{i} y{i} z{i}"] * 3)) for i in range(40)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(data, 40), "doc_id long, text string")
    n, often = substrings.frequent(substrings._keyed(df, "doc_id", "text"), rate=2)
    assert n == 360 and len(often) == 0
