import itertools

import pytest
from helpers import documents, prose, words
from pyspark.sql import functions as F

from nidalytics.llm import quality
from nidalytics.llm.common import whole

REPEATS = " ".join(["one two three four"] * 30)
ROWS = [
    (1, prose(1, 80)),
    (2, prose(2, 49)),
    (3, prose(3, 50)),
    (4, REPEATS),
    (5, None),
    (6, ""),
    (7, " \t\n\x0b\x0c\r "),
    (8, "\n".join(["the same line"] * 20 + [prose(5, 60)])),
    (9, "### " * 60 + prose(6, 60)),
    (10, " ".join(str(i) for i in range(100))),
    (11, "\n".join("- " + prose(i, 6) for i in range(20))),
    (12, "\n".join(prose(i, 6) + " ..." for i in range(20))),
    (13, "é ü  ö\n\n" + prose(9, 70)),
    (14, "a b a b a b"),
    (15, prose(15, 30_000, 5000)),
    (15, prose(15, 30_000, 5000)),
    (None, prose(16, 90)),
]


def facts(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = {g for g, n in ((g, len(list(v))) for g, v in itertools.groupby(sorted(windows))) if n > 1}
    covered = {i + d for i, g in enumerate(windows) if g in many for d in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def test_counts_match_brute_force(spark):
    got = quality.judge(documents(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    want = {i: facts(t) for i, t in ROWS}
    for r in got:
        d = r.asDict()
        assert {k: d[k] for k in want[r.doc_id]} == want[r.doc_id], r.doc_id
        failed = d["n_words"] < 50 or 100 * d["n_repeat_words"] > 50 * d["n_words"]
        assert d["base_failed"] == failed
        assert not (failed and d["kept"])


def test_verdicts(spark):
    kept = {r.doc_id for r in quality.judge(documents(spark, ROWS)).collect() if r.kept}
    assert kept == {1, 3, 13, 15, None}


def test_filter_agrees_with_report(spark):
    docs = documents(spark, ROWS)
    good = quality.good_rows(docs)
    assert good.columns == docs.columns
    assert sorted(str(r.doc_id) for r in good.collect()) == sorted(
        str(r.doc_id) for r in quality.judge(docs).collect() if r.kept
    )


def test_order_of_rules_changes_no_verdict(spark):
    docs = documents(spark, ROWS)
    found = quality.rules(whole("text"))
    want = {r.doc_id for r in docs.filter(quality.verdict(found).isNull()).collect()}
    assert {r.doc_id for r in docs.filter(quality.verdict(found[::-1]).isNull()).collect()} == want


def test_cascade_prefers_rejection_per_cost(spark):
    docs = documents(spark, [(i, f"text {i}") for i in range(200)])
    slow = F.length(F.repeat("text", 20_000)) < 0
    found = [quality.Rule("never", slow), quality.Rule("always", F.length("text") > 0)]
    assert [r.name for r in quality.order_by_gain(docs, "text", found)] == ["always", "never"]


def test_order_is_that_of_what_earlier_rules_leave(spark, monkeypatch):
    """Rejections are counted among the texts that are left, in the same sample wherever the rows lie."""
    monkeypatch.setattr(quality.time, "perf_counter", itertools.count().__next__)  # every rule costs the same
    rows = [(i, f"text {i}") for i in range(90)] * 2 + [(1, None)]
    number = F.coalesce(F.regexp_extract("text", "([0-9]+)", 1).try_cast("int"), F.lit(0))
    found = [
        quality.Rule("small", number < 40),
        quality.Rule("nested", number < 39),
        quality.Rule("large", number > 70),
        quality.Rule("b never", number < 0),
        quality.Rule("a never", number > 900),
    ]
    orders = {
        tuple(r.name for r in quality.order_by_gain(documents(spark, some).repartition(n), "text", found))
        for some, n in ((rows, 1), (rows[::-1], 5))
    }
    assert orders == {("small", "large", "a never", "b never", "nested")}
    texts = [{r.text for r in quality.sampled(documents(spark, some), "text", 7).collect()} for some in (rows, rows[::-1])]
    assert texts[0] == texts[1] and len(texts[0]) == 7


def test_later_rules_are_not_evaluated(spark):
    docs = documents(spark, [(1, "x")])
    cascade = [quality.Rule("first", F.length("text") > 0), quality.Rule("fails", F.raise_error(F.lit("evaluated")).isNull())]
    assert docs.select(quality.verdict(cascade).alias("v")).first()["v"] == "first"


@pytest.mark.parametrize("make", [quality.judge, quality.good_rows])
def test_empty_table(spark, make):
    assert make(documents(spark, [])).count() == 0
