"""Budgets against their definition, prefixes against a sort, and whole mixtures."""

import random

import pytest

from siltbed.llm import mixing

DOCS = "doc_id long, domain string, lang string, source string, text string, tokens int, leaf string"
TARGETS = "source string, target_share double, max_repeats int, tokens string"


def corpus(spark, n=400, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        source = rnd.choice(["Big ", "big", "BIG", "small", "mid", " mid", "other", None])
        rows.append((i, rnd.choice(["question", "answer", None]), rnd.choice(["en", "EN-us", "de", None, "??"]), source, " ".join(rnd.choice(["salt", "harbour", "quick", "lantern"]) for _ in range(rnd.randrange(0, 40))), 1, "z"))
    return spark.createDataFrame(rows, DOCS), rows


def targets(spark, small=3):
    return spark.createDataFrame([("big", 0.5, 1, "a"), ("small", 0.3, small, "a"), ("mid", 0.2, 2, "a"), ("gone", 0.0, 1, "a")], TARGETS)


def test_every_source_reaches_its_share(spark):
    docs, rows = corpus(spark)
    mixture, shares = mixing.mix(docs, targets(spark))
    got = {r.source: r for r in shares.collect()}
    for name, share, most in (("big", 0.5, 1), ("small", 0.3, 3), ("mid", 0.2, 2)):
        assert abs(got[name].share - share) < 0.01 and got[name].most_copies <= most
    mixed = mixture.collect()
    assert len({r.doc_id for r in mixed}) == len(mixed)
    tokens = {i: n for i, n in zip([r[0] for r in rows], mixing.count_tokens([r[4] for r in rows]))}
    assert all(r.tokens == tokens[r.doc_id] and r.copies >= 1 for r in mixed)
    assert {r.source for r in mixed} <= {"big", "small", "mid"}
    again = mixing.mix(docs.repartition(7), targets(spark))[0]
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in mixed}
    other = mixing.mix(docs, targets(spark), seed=8)[0]
    assert {tuple(r) for r in other.collect()} != {tuple(r) for r in mixed}


def test_shortage_goes_to_siblings_first():
    leaves = {("d", "en", "a"): 100, ("d", "en", "b"): 1000, ("d", "de", "b"): 1000, ("e", "en", "b"): 1000}
    given = mixing.budgets(leaves, {"a": (0.5, 1), "b": (0.5, 2)}, 1200)
    assert sum(given.values()) == pytest.approx(1200)
    assert given["d", "en", "a"] == pytest.approx(100)
    # Weights: the subtree d/en had 1/2 + 1/6 of the budget, and keeps it although its leaf a is short.
    assert given["d", "en", "a"] + given["d", "en", "b"] == pytest.approx(1200 * (0.5 + 0.5 / 3))
    assert given["e", "en", "b"] == pytest.approx(200)


def test_shortage_beyond_siblings_goes_to_ancestors():
    leaves = {("d", "en", "a"): 100, ("d", "de", "b"): 1000, ("e", "en", "b"): 50}
    given = mixing.budgets(leaves, {"a": (0.5, 1), "b": (0.5, 1)}, 1000)
    assert given["d", "en", "a"] == pytest.approx(100) and sum(given.values()) == pytest.approx(1000)
    assert given["d", "de", "b"] + given["e", "en", "b"] == pytest.approx(900)


def test_the_report_shows_where_shortages_went(spark):
    docs, _ = corpus(spark)
    rows = {(r.domain, r.lang, r.source): r for r in mixing.budget_report(docs, targets(spark, small=1), 1.5).collect()}
    root = rows[None, None, None]
    assert root.level == 0 and root.given == pytest.approx(min(root.asked, root.most)) and any(r.short > 0 for r in rows.values()) and any(r.from_siblings > 0 for r in rows.values())
    for path, r in rows.items():
        mine = [rows[p] for p in rows if rows[p].level == r.level + 1 and p[: r.level] == path[: r.level]]
        assert r.given <= r.most + 1e-6 and r.given == pytest.approx(r.asked + r.from_ancestors - r.short + r.from_siblings)
        if mine:
            # Children share what their parent was given, and no child is short while a sibling below its cap was given nothing of it.
            assert sum(c.given for c in mine) == pytest.approx(r.given) and sum(c.short for c in mine) == pytest.approx(sum(c.from_siblings for c in mine))
            assert all(c.given == pytest.approx(c.most) for c in mine if c.short > 1e-6)
    leaves = [r for r in rows.values() if r.level == 3]
    assert sum(r.given for r in leaves) == pytest.approx(root.given)


def test_budget_never_exceeds_what_is_there():
    given = mixing.budgets({("d", "en", "a"): 10, ("d", "en", "b"): 20}, {"a": (0.5, 2), "b": (0.5, 1)}, 1e9)
    assert given == {("d", "en", "a"): pytest.approx(20), ("d", "en", "b"): pytest.approx(20)}


def test_prefix_is_the_sorted_prefix(spark):
    rnd = random.Random(5)
    docs = spark.createDataFrame([(i, "l", rnd.randrange(1, 30)) for i in range(500)], "doc_id long, leaf string, tokens long")
    total = sum(r.tokens for r in docs.collect())
    for rest in (0.0, 1.0, total / 3, total - 1.0):
        wanted = spark.createDataFrame([("l", 1, rest)], "leaf string, epochs long, rest double")
        got = mixing._prefix(docs, wanted, 7).collect()
        assert len(got) == 500 and abs(sum(r.tokens * (r.copies - 1) for r in got) - rest) <= 15
        ordered = docs.selectExpr("doc_id", "tokens", "xxhash64(doc_id, 7, 1L) h").collect()
        ordered.sort(key=lambda r: ((r.h + (1 << 64)) % (1 << 64) >> 52, r.h, r.doc_id))
        more = {r.doc_id for r in got if r.copies == 2}
        assert {r.doc_id for r in ordered[: len(more)]} == more


def test_nothing_there(spark):
    docs, _ = corpus(spark, 10)
    mixture, shares = mixing.mix(docs.limit(0), targets(spark))
    assert mixture.count() == 0 and {r.share for r in shares.collect()} == {0.0}
    assert mixing.mix(docs, targets(spark).limit(0))[0].count() == 0


def test_repeated_rows_are_one_document(spark):
    docs, _ = corpus(spark, 60)
    assert {tuple(r) for r in mixing.mix(docs.union(docs), targets(spark))[0].collect()} == {tuple(r) for r in mixing.mix(docs, targets(spark))[0].collect()}


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "a", "en", "big", "salt and water " * 60_000, 1, "z"), (2, "a", "en", "small", "short", 1, "z")], DOCS)
    assert mixing.mix(docs, spark.createDataFrame([("big", 0.9, 1, "a"), ("small", 0.1, 1, "a")], TARGETS))[0].count() >= 1
