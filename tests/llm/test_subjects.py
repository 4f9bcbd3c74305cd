"""Subject rules on a made-up language whose truth is known."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from siltbed.llm import subjects

TERMS = {
    "sea": ["anchor", "rudder", "harbour", "sailcloth", "keel", "tide", "lighthouse", "deck"],
    "bread": ["oven", "sourdough", "crust", "flour", "yeast", "kneading", "loaf", "bakery"],
    "stars": ["telescope", "comet", "orbit", "nebula", "eclipse", "galaxy", "meteor", "planet"],
}
FRAMES = ["What is the difference between {} and {}?", "Without the {} the {} is pointless.", "I always check the {} before the {}.", "Everybody talks about {} but nobody about {}."]
IDLE = ["Thanks in advance.", "That sounds like flour in the works to me.", "Any hint is welcome.", "I searched for hours and found nothing."]
SAMPLE, DOC, LISTED = "text string, subject string, doc_id int", "doc_id long, text string, subject string, words int", "subject string"


def speak(rnd, subject, known=None):
    a, b = rnd.sample(TERMS[subject][:known], 2)
    return rnd.choice(FRAMES).format(a, b)


def make(n=240, seed=3):
    rnd = random.Random(seed)
    samples = [(" ".join(speak(rnd, s, 6) for _ in range(4)), s, 1) for s in TERMS for _ in range(12)]
    samples[0] = (samples[0][0], "bread", 1)  # labelled wrongly
    samples += [("no subject", None, 1), (None, "sea", 1), ("other list", "opera", 1)]
    docs, truth = [], set()
    for i in range(n):
        own = rnd.sample(sorted(TERMS), rnd.choice([1, 1, 1, 2]))
        said = [speak(rnd, s) for s in own for _ in range(3)] + rnd.sample(IDLE, 2)
        rnd.shuffle(said)
        docs.append((i, " ".join(said) + "\n```\nanchor = oven + keel\n```", "x", 1))
        truth |= {(i, s) for s in own}
    docs += [(n + 1, "", "x", 1), (n + 2, None, "x", 1), (None, "The anchor.", "x", 1), (n + 3, "Thanks in advance.", "x", 1), (n + 4, "word " * 100_000, "x", 1)]
    return samples, docs, truth


def result(spark, samples, docs, listed=tuple(TERMS)):
    out = subjects.subjects_of(spark.createDataFrame(docs, DOC), spark.createDataFrame(samples, SAMPLE), spark.createDataFrame([(s,) for s in listed], LISTED))
    return {(r.doc_id, r.subject) for r in out.where(f"share >= {subjects.SHARE}").collect()}


def test_subjects(spark):
    samples, docs, truth = make()
    got = result(spark, samples, docs)
    assert len(got & truth) >= 0.97 * len(truth) and len(got & truth) >= 0.97 * len(got)


def test_words_never_in_a_sample_are_learned(spark):
    samples, docs, truth = make()
    rows = [(10_000, "Without the loaf the bakery is pointless.", "x", 1), (10_001, "I always check the meteor before the planet.", "x", 1)]
    got = result(spark, samples, docs + rows)
    assert (10_000, "bread") in got and (10_001, "stars") in got


def test_wrong_labels_are_left_out():
    samples, _, _ = make()
    names = sorted(TERMS)
    labelled = [(subjects.prose(t), names.index(s)) for t, s, _ in samples if t and s in names]
    kept = subjects.believable(labelled, names)
    assert len(kept) == len(labelled) - 1


def test_figures_of_speech_are_disarmed(spark):
    samples, docs, _ = make(400)
    assert not any(d == 9_999 for d, _ in result(spark, samples, [*docs, (9_999, "That sounds like flour in the works to me.", "x", 1)]))


def test_empty_inputs(spark):
    samples, docs, _ = make(10)
    assert result(spark, [], docs) == set() and result(spark, samples, []) == set() and result(spark, samples, docs, ()) == set()


def test_repeated_rows(spark):
    samples, docs, _ = make(60)
    once = result(spark, samples, docs)
    assert len(once ^ result(spark, samples, docs + docs)) <= 0.03 * len(once)


def test_balanced_and_wilson():
    assert subjects.balanced([10, 1], [100, 10]) == [0.5, 0.5] and subjects.balanced([0, 0], [0, 5]) == [0.0, 0.0]
    low, high = subjects.wilson(0.5, 100, 1.96)
    assert 0.40 < low < 0.41 and 0.59 < high < 0.60


def encoded(spark, rows):
    """Labelled sentences (words, subject) as documents of one sentence, and their vocabulary."""
    vocabulary = subjects.Vocabulary.of(Counter(w for words, _ in rows for w in subjects.with_stems(words)))
    return spark.createDataFrame([(*vocabulary.encode([words]), k) for words, k in rows], f"{subjects.ENCODED}, subject int"), vocabulary


def brute(rows, names, depth):
    """Counts of every set of words by subject."""
    counts = defaultdict(lambda: [0] * len(names))
    for words, k in rows:
        for n in range(2, depth + 1):
            for p in combinations(sorted(set(words)), n):
                counts[p][k] += 1
    return counts


def test_pairs_of_plain_words(spark):
    """Words that tell nothing alone tell a subject together, however far apart in a long sentence."""
    names, words = [f"s{k}" for k in range(8)], [f"p{i:02d}" for i in range(60)]
    rows = [([w], k) for w in words for k in range(8) for _ in range(20)] + [(words, 0)] * 4
    table, vocabulary = encoded(spark, rows)
    rules = subjects.mine(table, names, vocabulary.size, len(vocabulary.words), 2)
    at = lambda *w: tuple(sorted(vocabulary.words[x] for x in w))
    assert not rules.known.any() and rules.patterns[at("p00", "p01")][0] == rules.patterns[at("p00", "p59")][0] == 0 and len(rules.patterns) == 60 * 59 // 2


@pytest.mark.parametrize("shard_words", [10**9, 40])
def test_growth_finds_what_counting_finds(spark, monkeypatch, shard_words):
    """Every rule of two and three words, also where words are spread over tasks; supports, redundancy and disarming by their definitions."""
    monkeypatch.setattr(subjects, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(subjects, "DEEPER", 1)
    rnd, names = random.Random(5), ["a", "b", "c"]
    rows = []
    for _ in range(260):
        k = rnd.randrange(3)
        base = rnd.sample("t u v w x y".split(), rnd.randrange(1, 6)) + (["p", "q", "r"] if k == 0 and rnd.random() < 0.4 else rnd.sample("pqr", rnd.randrange(3)))
        rows.append((sorted(set(base + rnd.sample(["k%d" % k, "k1"], 1))), k))
    table, vocabulary = encoded(spark, rows)
    rules = subjects.mine(table, names, vocabulary.size, len(vocabulary.words), 3)
    totals = [float(sum(k == j for _, k in rows)) for j in range(3)]
    word = {i: w for w, i in vocabulary.words.items()}
    sure = {}
    for n in (1, 2, 3):
        counts = brute(rows, names, 3) if n > 1 else {(w,): [sum(w in ws for ws, k in rows if k == j) for j in range(3)] for w in vocabulary.words}
        for p, c in counts.items():
            if len(p) == n and sum(c) >= 3:
                part = subjects.balanced(c, totals)
                top = max(range(3), key=part.__getitem__)
                own = subjects.wilson(part[top], sum(c), 1.0)[0]
                parts = [q for m in range(1, n) for q in combinations(p, m)]
                below = max((sure[q][1] for q in parts if q in sure and sure[q][0] == top), default=0.0)
                if n == 1 or (own >= subjects.SURE and own >= subjects.SURER + below):
                    sure[p] = (top, own)
    got = {tuple(sorted(word[i] for i in p)): (k, round(c, 9)) for p, (k, c) in rules.patterns.items()}
    assert got == {p: (k, round(c, 9)) for p, (k, c) in sure.items() if len(p) > 1} and any(len(p) == 3 for p in got) and any(len(p) == 2 for p in got)


def test_languages_are_learned():
    words = {"de": "der die und ist nicht das", "fr": "le la et est une des", "it": "il che non per una sono", "pl": "nie jest sie w na z"}
    names = sorted(words)
    counts = {w: np.where(np.array(names) == x, 60.0, 1.0) for x in names for w in words[x].split()}
    model = subjects.Languages.of(names, np.full(4, 100.0), counts)
    for x in names:
        assert model.mark({*words[x].split(), "telefon"}) == "@" + x
    assert model.mark({f"strange{i}" for i in range(30)}) == "@?" and model.mark(set()) in {"@" + x for x in names} and subjects.Languages(["en"]).mark({"a"}) == ""


def test_equal_words_of_two_languages(spark):
    """The language comes from the documents, though a tenth of them name a wrong one."""
    rnd = random.Random(1)
    common = {"en": "the of and is in that".split(), "de": "der die und ist nicht von".split()}
    docs = [(i, " ".join(rnd.choices(common[x], k=12)) + ".", rnd.choice([x] * 9 + ["en", "de"]), 1) for i in range(200) for x in [("en", "de")[i % 2]]]
    bodies, model = subjects.parse(spark.createDataFrame(docs + [(900, None, "en", 1), (901, "", None, 1)], "doc_id long, text string, lang string, n int"))
    assert model.names == ["de", "en"] and bodies.count() == 201
    assert model.mark({"the", "gift", "is"}) == "@en" and model.mark({"das", "gift", "ist", "nicht"}) == "@de"
