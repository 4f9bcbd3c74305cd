"""Planted copies, alterations, quotations and re-parameterised questions."""

import random

import pytest

from siltbed.llm import leakage
from siltbed.llm.words import alike, clean, fold

ITEM = (
    "Karvolin, a hollow lantern beside Tursenmar, borrowed 417 pages about the tide and quietly sold the amber door to a baker. "
    "In 1834 the widow from Obrintal lifted a crooked mirror before dawn, although nobody near the harbour counted the silver nets. "
    "Because Selkamor painted 93 barrels, the northern bridge and 18 sleepy goats followed Dunverrick across the frozen marsh."
)
OTHER = (
    "While Hestrophan weighed 62 wooden spoons, a patient miller and 5 tall ladders crossed the valley of Quillonbar twice. "
    "The narrow orchard of Vextamil hid every copper bell behind Rondalur, so that 77 weavers repaired the gate at noon. "
    "After supper, Lorminkal gave 240 candles to the choir, since the old piano annoyed a wandering clerk."
)
PROSE = "We talked about other matters for a while. The weather was fine and the coffee cold. Nobody had any question left at the end of the day. "


def sentence(text, *numbers):
    parts = text.split(". ")
    return ". ".join(parts[n] for n in numbers) + "."


def found(spark, docs, items=((1, ITEM), (2, OTHER))):
    documents = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, h string, item_id int")
    tests = spark.createDataFrame([(i, q, 3) for i, q in items], "item_id long, question string, doc_id int")
    return sorted((r.doc_id, r.item_id) for r in leakage.leaked(documents, tests).collect())


def test_copies_and_alterations(spark):
    rnd = random.Random(1)
    words = ITEM.split()
    typos = " ".join(w[:2] + w[3:] if len(w) > 6 and i % 5 == 0 else w for i, w in enumerate(words))
    filled = " ".join(w + (" really" if i % 6 == 0 else "") for i, w in enumerate(words))
    docs = [
        (1, PROSE + ITEM + PROSE),
        (2, PROSE + ITEM.upper()),
        (3, "".join(c for c in ITEM.lower() if c.isalnum() or c == " ")),
        (4, ITEM.replace("a", "а").replace("e", "е")),
        (5, "\n> ".join(ITEM[i : i + 40] for i in range(0, len(ITEM), 40)).replace("lan\n> tern", "lantern")),
        (6, "<p>" + ITEM.replace(" the ", " <em>the</em> ") + "</p>"),
        (7, "­".join(ITEM)),
        (8, PROSE + typos),
        (9, filled),
        (10, sentence(ITEM, 2) + " " + PROSE + sentence(ITEM, 0)),
        (11, ITEM + " " + OTHER),
        (12, PROSE * 300 + ITEM + PROSE * 300),
        (13, ITEM),
        (13, ITEM),
    ]
    rnd.shuffle(docs)
    want = sorted({(i, 1) for i, _ in docs if i != 5} | {(11, 2)})
    got = found(spark, docs)
    assert [g for g in got if g[0] != 5] == want


def test_what_does_not_count(spark):
    other_slots = ITEM
    for a, b in (("Karvolin", "Mastoren"), ("Tursenmar", "Wilkabad"), ("417", "902"), ("1834", "1207"), ("Obrintal", "Festunor"), ("Selkamor", "Yandrofel"), ("93", "41"), ("18", "66"), ("Dunverrick", "Pollosten")):
        other_slots = other_slots.replace(a, b)
    docs = [(1, PROSE + sentence(ITEM, 0)), (2, PROSE), (3, ""), (4, None), (None, ITEM), (5, other_slots), (6, "word " * 200_000), (7, "x" * 500_000)]
    assert found(spark, docs) == []
    each = leakage.leaks(spark.createDataFrame([(5, other_slots)], "doc_id long, text string"), spark.createDataFrame([(1, ITEM)], "item_id long, question string")).first()
    assert each.copied == 0 and each.reparameterised >= 0.9


def test_shared_instructions(spark):
    asked = "Read the passage below and choose the one statement that follows from it. "
    items = [(i, asked + f"Item number {i} speaks of thing{i} and matter{i} under name{i}.") for i in range(30)]
    assert found(spark, [(1, asked * 3 + PROSE)], items) == []
    assert found(spark, [(1, PROSE + ITEM + asked)], [*items, (99, asked + ITEM)]) == [(1, 99)]


def test_empty(spark):
    assert found(spark, []) == [] and found(spark, [(1, ITEM)], []) == []
    assert found(spark, [(1, ITEM)], [(1, None), (None, ITEM), (2, "  ")]) == []


def test_more_items_than_one_block_holds(spark, monkeypatch):
    docs = [(1, PROSE + ITEM + PROSE), (2, OTHER), (3, ITEM + OTHER)]
    want = found(spark, docs)
    monkeypatch.setattr(leakage, "MOST_CHARS", 300)
    assert len(leakage.load_items(spark.createDataFrame([(1, ITEM), (2, OTHER)], "item_id long, question string"))) > 2
    assert found(spark, docs) == want == [(1, 1), (2, 2), (3, 1), (3, 2)]


def variant(k):
    text = ITEM
    for i, (word, number) in enumerate((("Karvolin", "417"), ("Obrintal", "1834"), ("Selkamor", "93"), ("Dunverrick", "18 "))):
        text = text.replace(word, f"{'BDFGKLMNPR'[k % 10]}ov{'aeiou'[k // 10 % 5]}r{'bdfgklmnpr'[k // 50 % 10]}{'aei'[k // 500]}{'nstr'[i]}").replace(number, f"{1000 * (i + 2) + k}{' ' if number[-1] == ' ' else ''}")
    return text


@pytest.mark.parametrize("n", [21, 100, 1000])
def test_families_of_one_template(spark, n):
    """Every member of a family is found by its own values; other values are re-parameterised, one row for the family."""
    items = [(k, variant(k)) for k in range(n)]
    unseen = ITEM
    for a, b in (("Karvolin", "Mastoren"), ("Obrintal", "Festunix"), ("Selkamor", "Yandrofel"), ("Dunverrick", "Pollosto"), ("417", "12"), ("1834", "16"), ("93", "31"), ("18 ", "47 ")):
        unseen = unseen.replace(a, b)
    docs = [(k, PROSE + variant(k) + PROSE) for k in (0, 7, n - 1)] + [(5000, PROSE + unseen), (5001, PROSE), (5002, variant(3) + " " + PROSE + variant(5))]
    assert found(spark, docs, items) == [(0, 0), (7, 7), (n - 1, n - 1), (5002, 3), (5002, 5)]
    documents, tests = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, question string")
    assert [(r.doc_id, r.class_id, r.members) for r in leakage.variants(documents, tests).collect()] == [(5000, 0, n)]


def test_families_that_share_most_sentences(spark):
    """Items that differ in one sentence only are no phrasing to each other: a copy is a whole copy."""
    own = ["Nobody saw the falcon of Marrowgate again.", "A tired juggler kept every receipt.", "Seven owls watched the empty mill.", "The brass kettle sang until midnight.", "Her brother forgot the wooden ladder.", "Old maps covered the northern wall.", "The clerk sealed nine letters twice."]
    items = [(k, ITEM + " " + tail) for k, tail in enumerate(own)]
    documents, tests = spark.createDataFrame([(1, items[2][1])], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, question string")
    got = {r.item_id: r.copied for r in leakage.leaks(documents, tests).collect()}
    assert got[2] == 1.0 and set(got) == set(range(7))


def test_words():
    assert clean("co­op <b>x</b> wa-\nter d’or ﬁn") == "coop  x  water dor fin"
    assert fold("Émile") == "emile" and fold("STRASSE") == fold("straße")
    assert alike("lantern", "lanten") and alike("lantern", "latnern") and alike("lantern", "lantirn") and not alike("lantern", "lintirn") and not alike("cat", "car")


def test_short_items(spark):
    """Verbatim copies of items with fewer windows than four, and a sentence that is two fifths of its item."""
    items = [(1, "Crooked lanterns hum"), (2, "Seven bakers quietly painted the northern orchard"), (3, "A sleepy miller weighed nine candles. Beyond the frozen marsh nobody counted silver nets anymore")]
    docs = [(1, PROSE + "Crooked lanterns hum. " + PROSE), (2, PROSE + "Seven bakers quietly painted the northern orchard. " + PROSE), (3, PROSE + "A sleepy miller weighed nine candles. " + PROSE), (4, PROSE), (5, "Crooked lanterns"), (6, "Seven bakers painted nothing")]
    assert found(spark, docs, items) == [(1, 1), (2, 2), (3, 3)]
    assert [leakage.least_shared(n) for n in (1, 7, 15, 64, 200)] == [1, 1, 1, 4, 10]
