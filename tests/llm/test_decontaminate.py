import random

from lumenfold.llm import decontaminate as d


def both(spark, docs, items, **kw):
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in d.verdicts(d.leaks(a, b, **kw)).collect()]
    want = d.brute_force(docs, items)
    key = lambda r: str(r)
    assert sorted(got, key=key) == sorted(want, key=key)
    return got


def passages(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "Ha", "é", "x9", "zz", "The"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([0, 1, 3, 5, 12, 13, 14, 20, 40, 40, 60])]
    items += [(9, items[8][1]), (None, items[7][1] + " q"), (77, None), (78, "ha " * 30)]
    docs = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(r.randrange(40)))]
        for _ in range(r.randrange(3)):
            own = (r.choice(items)[1] or "").split()
            lo = r.randrange(len(own) + 1)
            parts.append(r.choice([" ", ", ", "\n"]).join(own[lo : lo + r.randrange(1, 45)]).upper())
        docs.append((i, " ".join(parts)))
    return docs + [(None, "x"), (3, None), (3, ""), (3, "ha " * 40), (3, "ha " * 40)], items


def test_as_brute_force(spark):
    for seed in range(3):
        got = both(spark, *passages(seed))
        assert any(r[5] for r in got) and not all(r[5] for r in got)


def test_a_full_bitmap_gives_the_same(spark, monkeypatch):
    docs, items = passages(9)
    want = both(spark, docs, items)
    monkeypatch.setattr(d, "FILTER_BITS", 32)
    assert sorted(map(str, both(spark, docs, items))) == sorted(map(str, want))


def test_runs_of_one_word(spark):
    """A hundred thousand equal words against items of equal words: one window with many places."""
    items = [(1, "ha " * 200), (2, "ha " * 13), (3, "ha " * 12), (4, "ho " * 50)]
    docs = [(1, "ha " * 100_000), (2, "x " + "ha " * 12 + "y"), (3, "ha " * 11)]
    a = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in d.leaks(a, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert [tuple(s) for s in got[1].spans] == [(0, 100_000)] and got[1]["items"] == ["1", "2", "3"]
    assert [tuple(s) for s in got[2].spans] == [(1, 13)] and got[2]["items"] == ["3"]
    assert not got[3].spans and not got[3]["items"]


def test_dropped_rows(spark):
    docs, items = passages(4)
    rows = [(i, t, n, "s") for n, (i, t) in enumerate(docs)]
    a = spark.createDataFrame(rows, "doc_id long, text string, n int, k1 string")
    b = spark.createDataFrame(items, "item_id long, text string")
    left = sorted(r.n for r in d.drop_contaminated(a, b).collect())
    assert left == [n for n, r in enumerate(d.brute_force(docs, items)) if not r[5]] and 0 < len(left) < len(rows)
    assert d.drop_contaminated(a, b.filter("false")).count() == len(rows)


def test_empty_tables(spark):
    assert both(spark, [], [(1, "a")]) == []
    assert both(spark, [(1, "a b c"), (2, None)], [])[0][2] == 0


def test_spans_and_other_columns(spark):
    own = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"x {own} y", 5, "s")], "doc_id long, text string, n_words int, items string")
    items = spark.createDataFrame([(4, own, 1)], "item_id long, text string, spans int")
    r = d.leaks(docs, items).collect()[0]
    assert [tuple(s) for s in r.spans] == [(1, 31)] and r["items"] == ["4"] and r.n_words == 32


def test_very_long_text(spark):
    own = " ".join(f"w{i}" for i in range(20))
    text = "lorem ipsum " * 400_000 + own
    a = spark.createDataFrame([(1, text), (2, "z" * 3_000_000)], "doc_id long, text string")
    b = spark.createDataFrame([(4, own)], "item_id long, text string")
    got = {r.doc_id: r for r in d.verdicts(d.leaks(a, b)).collect()}
    assert (got[1].n_hit, got[1].contaminated, got[2].n_words) == (20, False, 1)


def test_no_window_is_left(spark):
    """Of what clean() keeps no word is in a window, and only words of windows are gone; drop_contaminated() leaves passages in."""
    docs, items = passages(4)
    r = random.Random(5)
    own = [f"p{i}" for i in range(30)]
    other = [f"q{i}" for i in range(20)]
    items += [(90, " ".join(own)), (91, " ".join(other))]
    long = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    nested = [*other[:10], *own, *other[10:]]  # what is left around the inner passage is one
    docs += [(100, "\u00e9. " + ", ".join([*long(900), *own, *long(300)]) + " \u00fc!"), (101, "\n".join([*own, *long(900)])), (102, " ".join([*long(900), *nested, *long(900)]))]
    docs += [(103, " ".join(long(900) + own[:12])), (103, " ".join([*long(900), *own, *long(3), *own, *long(900)]))]
    items = [x for x in items if len((x[1] or "").split()) >= 13]
    rows = [(i, t, n, "s", 7) for n, (i, t) in enumerate(docs)]
    a = spark.createDataFrame(rows, "doc_id long, text string, n int, k1 string, left int")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = d.brute_force(docs, items)
    got = {x.n: x for x in d.clean(a, b).collect()}
    nested_at = next(n for n, x in enumerate(docs) if x[0] == 102)
    assert sorted(got) == [n for n, x in enumerate(found) if not x[5] and n != nested_at]
    assert all(x[2] == 0 for x in d.brute_force([(n, x.text) for n, x in got.items()], items))
    for n, x in got.items():
        assert (x.n_cut, x.doc_id, x.k1, x.left) == (found[n][2], docs[n][0], "s", 7)
        assert d.brute_force([(1, x.text)], [])[0][1] == found[n][1] - x.n_cut
        assert x.n_cut or x.text == docs[n][1]
    assert sorted(x.n_cut for x in got.values())[-3:] == [30, 30, 60]
    assert next(x.text for x in got.values() if x.doc_id == 100) == docs[-5][1].replace(", ".join(own) + ", ", "")
    left = [(x.n, x.text) for x in d.drop_contaminated(a, b).collect()]
    assert any(x[2] for x in d.brute_force(left, items))
    assert sorted((x.n, x.text) for x in d.clean(a, b.filter("false")).collect()) == sorted((x[2], x[1]) for x in rows)
