import random

import pytest

import corpus_pipeline as p
from lumenfold.llm import decontaminate, mixing, neardup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(8)
    text = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    rows, labels, item = [], [], text(40)
    for i in range(400):
        body = [text(30), text(25)]
        toxic = i % 8 == 3
        if toxic:
            body[0] += r.choice([" vileword", " nastyword"]) + ". " + text(9)
        if i % 4 == 1:
            body.append("all rights reserved everywhere")
        if i % 50 == 2:
            body.append(item)
        rows.append((i, "\n".join(body), "en", f"s{i % 13}", 1))
        labels.append((i, int(toxic)))
    for i in range(400, 420):  # near and exact copies
        own = rows[(i - 400) * 8 + 4][1].split(" ")
        if i % 2:
            own[5] = "changed"
        rows.append((i, " ".join(own), "en", "s1", 1))
    rows += [(500, None, None, None, None), (501, "", "en", None, 0), (502, "all rights reserved everywhere", "en", "s2", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = {}
    for name, stage in p.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns + ["taken"] * (name == "mixing")
        rows = out.collect()
        kept[name] = {r.doc_id: r.text for r in rows}
        gone = before.keys() - kept[name].keys()
        if name == "toxicity":
            assert gone == {i for i in range(400) if i % 8 == 3}
        elif name == "line_dedup":
            assert gone == {502}
            same = "all rights reserved everywhere"
            assert [i for i, t in kept[name].items() if t and same in t] == [1]
        elif name == "minhash_neardup":
            classes = neardup.brute_force(sorted(before.items()))
            assert gone == {i for i, c in classes.items() if i != c} >= set(range(400, 420))
        elif name == "decontamination":
            hit = decontaminate.brute_force(list(before.items()), [(1, next(r.text for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()))])
            assert gone == {r[0] for r in hit if r[5]} and gone
        else:
            assert {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken} == {r.doc_id: r.taken for r in rows}
        docs = spark.createDataFrame(rows, out.schema)


def test_run(spark, tables):
    out = p.run(spark, tables)
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids)) and len(ids) > 150 and out.columns[-1] == "taken"


def test_long_documents_lose_passages(spark, tables):
    """A passage of less than a twentieth of its document is cut out, and n_chars follows."""
    item = spark.read.parquet(f"{tables}/benchmark.parquet").collect()[0].text
    r = random.Random(3)
    own = " ".join(f"v{r.randrange(10**6)}" for _ in range(1000))
    docs = spark.createDataFrame([(1, f"{own} {item} {own}", "en", "s", 5), (2, own, "en", "s", 5)], DOCS)
    got = {x.doc_id: (x.text, x.n_chars) for x in p.drop_contaminated(spark, docs, tables).collect()}
    assert got == {1: (f"{own} {own}", 2 * len(own) + 1), 2: (own, 5)}
