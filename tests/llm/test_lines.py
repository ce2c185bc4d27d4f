from collections import defaultdict

from pyspark.sql import functions as F

from lumenfold.llm import lines

SCHEMA = "doc_id long, text string, source string, k1 int, site string"


def brute(rows, sites):
    where, first = defaultdict(set), {}
    trim = lambda x: x.strip(" \t\x0b\x0c\r")
    low = lambda i: -(1 << 70) if i is None else i
    for i, t, s, *_ in rows:
        for x in (t or "").split("\n"):
            where[trim(x)].add(s)
            first[trim(x)] = min(first.get(trim(x), 1 << 70), low(i))
    out = []
    for i, t, *_ in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        all_ = t.split("\n")
        kept = [x for x in all_ if not (trim(x) and len(where[trim(x)]) >= sites and first[trim(x)] != low(i))]
        out.append((i, "\n".join(kept), len(all_), len(all_) - len(kept)))
    return sorted(out, key=str)


def rows(n=60):
    out = []
    for i in range(n):
        own = [f"own {i}", "  everywhere\r", "", f"by seven {i % 7}", "only one site" if i % 12 == 0 else "x"]
        own += [f"on {k} sites" for k in range(1, 13) if i % 12 < k]
        out.append((i, "\n".join(own), f"s{i % 12}" if i % 12 else None, 1, "q"))
    return out + [(None, "everywhere\nz", "s1", 1, ""), (3, None, "s1", 1, ""), (3, "", "s2", 1, ""), (4, "everywhere", "s3", 1, ""), (4, "everywhere", "s3", 1, "")]


def test_as_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    for sites in (2, 5, 10):
        out = lines.drop_lines(df, sites=sites)
        assert out.columns == [*df.columns, "n_lines", "n_dropped"]
        got = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()]
        assert sorted(got, key=str) == brute(data, sites)


def test_near_lines_are_counted_exactly(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    found = lines.spread(lines.frequent(lines.occurrences(df, "doc_id", "text", "source"), 5), 5)
    kinds = {r.n_sites: r.exact for r in found.collect()}
    assert kinds[5] and kinds[6] and not kinds[12] and min(kinds) == 5


def test_empty_and_long(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert lines.drop_lines(df).collect() == []
    df = spark.range(12).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("same\n"), 100_000).alias("text"), F.col("id").cast("string").alias("source")
    )
    assert sorted(r.n_dropped for r in lines.drop_lines(df).collect()) == [0] + [100_000] * 11
