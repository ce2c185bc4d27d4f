import re
from collections import Counter

from lumenfold.llm import quality

TEXTS = [
    None, "", " ", "a", "a b c d e f g h", "a b c d e f g h " * 3, "x " * 30, "a b c d e f g h i " * 2 + "z", "##$$ <b> & * | %\n##$$ <b> & * | %",
    "line one\n\nline one\n \n \nline two\r\nline one", "é ü\x0bß\tq\x0cw", "word " * 3000, " ".join(f"w{i}" for i in range(20_000)),
    " ".join(f"w{i}" for i in range(40)), "LOUD " * 2 + " ".join(f"W{i}X" for i in range(40)), " ".join(f"w{i}!!" for i in range(40)),
    " ".join(f"{'q' * 40}{i}" for i in range(30)), " nbsp x y", "a b c d e f g h a b c d e f g h a b c",
]


def base(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(grams)
    hit = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.sub("[\x20\x09-\x0d]", "", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def frame(spark):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int, words string")


def test_measures(spark):
    for r in quality.judge(frame(spark)).collect():
        want = base(TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_order_changes_no_verdict(spark):
    a = {r.doc_id: r.kept for r in quality.judge(frame(spark), quality.RULES).collect()}
    b = {r.doc_id: r.kept for r in quality.judge(frame(spark), quality.RULES[::-1]).collect()}
    assert a == b and a[13] and not a[14] and not a[15] and not a[16]


def test_plan_prefers_rejection_per_cost(spark):
    never = quality.Rule("never", lambda t, m: t.isNull())
    often = quality.Rule("often", lambda t, m: t.isNotNull())
    assert [r.name for r in quality.plan(frame(spark), [never, often])] == ["often", "never"]
    assert quality.plan(frame(spark).limit(0), [never, often]) == [never, often]
    assert quality.judge(frame(spark).limit(0)).collect() == []
