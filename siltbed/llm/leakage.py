"""Evaluation texts leaking into training text, by templates and slots.

Every text becomes a template: numbers, names and units turn into typed placeholders, the rest into
folded words. A name is a word with a capital inside a sentence, or one that is written so in
any test item, so that lower-cased copies give the same template. Windows of template words
are hashed and joined with the windows of the test items; a document and an item that share
enough windows are aligned sentence by sentence. In an aligned stretch, the values of the slots decide:
where they agree the stretch is copied; where they differ, but every value of the item
is replaced by always the same other one, the question is re-parameterised; else the stretch is mere likeness.

Items with the same template are one class: a document is aligned with it once, and the values of the
slots decide which members are copied, so families of re-parameterised questions of any size cost little and
lose none. Where no member is copied but the template returns with other, consistent values, the class comes
out once, under its smallest item, as re-parameterised.

A sentence is phrasing, such as an instruction, if more than PHRASING classes have it that share little else; it
counts as copied only where enough of the rest is copied too. Windows inside of phrasing make no candidates.

The test items are held-out and collected in blocks of at most MOST_CHARS characters (more of them are taken block by
block, with equal templates in one block); documents are never compared with each other.

Nulls: documents and items without id or text are none; empty texts have no windows. Repeated
documents are found each under their own id; repeated rows of one id once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.words import SENTENCE, WORD, alike, clean, fold
from siltbed.session import scratch, settle, ship

#: Words of a window; shared windows that make a candidate (fewer for short items), of the item's words at least so many; independent classes above which a sentence is phrasing.
WINDOW, LEAST_SHARED, LEAST_SHARE, PHRASING = 5, 4, 0.05, 5
#: Copied words over the item's words from which an item counts as leaked.
COPIED = 0.4
#: A stretch may skip so many words of item and document, must have so many words, and so large a part of its slots must agree.
SKIP_ITEM, SKIP_DOC, LEAST_RUN, SLOTS_AGREE = 3, 5, 5, 0.67
#: Most characters of test items that are sent to the executors at once.
MOST_CHARS = 64_000_000
NUMBER, NAME, UNIT = "<n>", "<name>", "<unit>"
# Units that may follow a number.
UNITS = frozenset("mm cm m km mg g kg t ml l s sec min h hr hrs mb gb tb kb hz khz mhz ghz w kw kwh v a ms usd eur gbp percent pct px pt mph kmh".split())

_CAPITAL = re.compile(r"^[^\W\d_a-z][^\W\d_]*[a-zà-ÿ]")


@dataclass
class Text:
    words: list[str]
    template: list[str]
    ends: list[int]  # index behind the last word of each sentence


def _sentences(text: str) -> list[list[str]]:
    return [w for s in SENTENCE.split(clean(text)) if s and (w := WORD.findall(s))]


def name_lexicon(texts: list[str]) -> frozenset[str]:
    """Folded words that are written with a capital inside a sentence."""
    return frozenset(fold(w) for t in texts for s in _sentences(t) for w in s[1:] if _CAPITAL.match(w))


def _hash_of(kind: str) -> int:
    return xxhash.xxh3_64_intdigest(kind)


class Reader:
    """Turns texts into templates; what it found out about a word as written is remembered, as most words come again."""

    MOST_REMEMBERED = 300_000

    def __init__(self, names: frozenset[str]):
        self.names, self.known = names, {}

    def _look(self, raw: str) -> tuple[str, str, str, int, int, bool, bool]:
        """Folded word, template word inside and at the beginning of a sentence, their hashes, whether it is a number, whether it may be a unit."""
        word = fold(raw)
        number = word[0].isdigit()
        first = NUMBER if number else NAME if word in self.names else word
        inside = NAME if first is word and _CAPITAL.match(raw) else first
        if len(self.known) >= self.MOST_REMEMBERED:
            self.known.clear()
        found = self.known[raw] = (word, inside, first, _hash_of(inside), _hash_of(first), number, word in UNITS)
        return found

    def canonical(self, text: str) -> Text:
        words, template, ends, known = [], [], [], self.known
        for sentence in _sentences(text):
            for i, raw in enumerate(sentence):
                word, inside, first, _, _, _, unit = known.get(raw) or self._look(raw)
                words.append(word)
                template.append(UNIT if unit and template and template[-1] == NUMBER else inside if i else first)
            ends.append(len(words))
        return Text(words, template, ends)

    def hashes(self, text: str) -> list[int]:
        """Hashes of the template's words."""
        out, known, after_number = [], self.known, False
        for sentence in _sentences(text):
            at_start = True
            for raw in sentence:
                found = known.get(raw) or self._look(raw)
                if found[6] and after_number:
                    out.append(_UNIT_HASH)
                    after_number = False
                else:
                    out.append(found[4] if at_start else found[3])
                    after_number = found[5]
                at_start = False
        return out


_UNIT_HASH = _hash_of(UNIT)
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def rolled(words: np.ndarray, width: int) -> np.ndarray:
    """A signed 64-bit hash of each window of so many words, from the words' hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = h * _FACTOR + words[k : k + n]
    h ^= h >> np.uint64(33)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h.view(np.int64)


class Sieve:
    """A bitmap that lets all hashes of a set through and few others."""

    def __init__(self, hashes: np.ndarray):
        self.shift = np.uint64(64 - max(16, min(30, int(len(hashes) * 32).bit_length())))
        self.bits = np.zeros(1 << (64 - int(self.shift) - 3), np.uint8)
        at = hashes.view(np.uint64) >> self.shift
        np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.view(np.uint64) >> self.shift
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def least_shared(words: int) -> int:
    """Shared windows that make a candidate of an item of so many words: no more than there are if its least copied part comes in runs of one window."""
    return max(1, min(LEAST_SHARED, math.ceil(COPIED * words) // WINDOW), int(LEAST_SHARE * words))


@dataclass
class Verdict:
    copied: float
    reparameterised: float


def compare(text: Text, members: list[list[str]], phrasing: set[int], doc: Text) -> list[Verdict]:
    """For each member of a class (its words; all have the template of text): how much of it the document copies, and how much it repeats with other, consistent slot values.

    phrasing: numbers of the sentences that are phrasing. They count among the words, and as copied
    where the rest alone reaches COPIED.
    """
    matcher = SequenceMatcher(None, [], doc.template, autojunk=False)  # what it knows of the document serves all sentences
    scored, begin = [], 0
    for end in text.ends:
        mine, found = text.template[begin:end], []
        matcher.set_seq1(mine)
        left, runs = doc.template, list(_runs(matcher))
        while runs:
            scores = [[_score(run, mine, words[begin:end], doc) for words in members] for run in runs]
            found += scores
            whole = sum(n for run in runs for _, _, n in run) >= 0.8 * len(mine)
            if not whole or (len(members) == 1 and not any(differ for run in scores for _, _, differ in run)):
                break
            # The template may come again further on, with the values of another member.
            left = list(left)
            for run in runs:
                for _, at, n in run:
                    left[at : at + n] = [""] * n
            runs = list(_runs(SequenceMatcher(None, mine, left, autojunk=False)))
        # What another member has more of is that member's copy.
        tops = [max(same for same, _, _ in run) for run in found]
        scored.append([[(*score, score[0] == top) for score in run] for run, top in zip(found, tops)])
        begin = end
    return [_judge(text, phrasing, [[run[m] for run in runs] for runs in scored]) for m in range(len(members))]


def _judge(text: Text, phrasing: set[int], scored: list[list[tuple[int, int, list, bool]]]) -> Verdict:
    """The verdict on one member from the scores of its stretches, sentence by sentence."""
    copied = stock = moved = 0
    slots: dict[tuple[str, str], Counter] = {}
    pending: list[tuple[int, list[tuple[str, str, str]]]] = []
    begin = 0
    for k, end in enumerate(text.ends):
        mine = text.template[begin:end]
        begin = end
        best, best_slots = 0, []
        for same, agree, differ, nearest in scored[k]:
            if same + len(differ) < min(LEAST_RUN, len(mine)):
                continue
            # One slot may be off by a misaligned neighbour where nearly all of the sentence agrees.
            if agree >= SLOTS_AGREE * (agree + len(differ)) or (len(differ) == 1 and agree and same >= 0.7 * len(mine)):
                if same > best and nearest:
                    best, best_slots = same, []
            elif best == 0 and same + len(differ) >= 0.8 * len(mine) and len(differ) > len(best_slots) and k not in phrasing:
                best_slots = differ
                pending.append((same + len(differ), differ))
        if k in phrasing:
            stock += best
        else:
            copied += best
        if best and pending and pending[-1][1] is best_slots:
            pending.pop()
    for _, differ in pending:
        for kind, a, b in differ:
            slots.setdefault((kind, a), Counter())[b] += 1
    for n, differ in pending:
        if all(len(slots[kind, a]) == 1 for kind, a, _ in differ):
            moved += n
    total = max(1, len(text.words))
    if copied >= COPIED * total:
        copied += stock
    return Verdict(copied / total, moved / total)


def _runs(matcher: SequenceMatcher) -> Iterator[list[tuple[int, int, int]]]:
    """Matching blocks of one sentence's template in the document, joined to stretches over small gaps."""
    run: list[tuple[int, int, int]] = []
    for a, b, n in matcher.get_matching_blocks():
        if run and (not n or a - run[-1][0] - run[-1][2] > SKIP_ITEM or b - run[-1][1] - run[-1][2] > SKIP_DOC):
            yield run
            run = []
        if n:
            run.append((a, b, n))


def _score(run: list[tuple[int, int, int]], mine: list[str], words: list[str], doc: Text) -> tuple[int, int, list[tuple[str, str, str]]]:
    """Equal words of a stretch, its slots that agree, and those that differ (kind, value in the item, value in the document)."""
    same = agree = 0
    differ = []
    for k, (a, b, n) in enumerate(run):
        for i in range(n):
            x, y, slot = words[a + i], doc.words[b + i], mine[a + i] in (NUMBER, NAME, UNIT)
            if x == y or (slot and mine[a + i] != NUMBER and alike(x, y)):
                same += 1
                agree += slot
            elif slot:
                differ.append((mine[a + i], x, y))
        if k + 1 < len(run):
            between = doc.words[b + n : run[k + 1][1]]
            for i in range(a + n, run[k + 1][0]):
                if any(alike(words[i], y) for y in between):
                    same += 1
                    agree += mine[i] in (NUMBER, NAME, UNIT)
    return same, agree, differ


class Items:
    """A block of test items in classes of equal template, with what is phrasing in them."""

    def __init__(self, rows: list[tuple[int, str]], names: frozenset[str]):
        self.names = names
        reader, by_template = Reader(names), {}
        for i, question in rows:
            t = reader.canonical(question)
            by_template.setdefault((tuple(t.template), tuple(t.ends)), []).append((i, t.words))
        #: smallest item of a class: its template, its members as (item, words)
        self.classes: dict[int, tuple[Text, list[tuple[int, list[str]]]]] = {}
        for (template, ends), members in sorted(by_template.items(), key=lambda x: x[1][0][0]):
            self.classes[members[0][0]] = Text(members[0][1], list(template), list(ends)), members
        cut = {c: [tuple(t.template[b:e]) for b, e in zip([0, *t.ends], t.ends)] for c, (t, _) in self.classes.items()}
        owners: dict[tuple, list[int]] = {}
        for c, parts in cut.items():
            for part in set(parts):
                owners.setdefault(part, []).append(c)
        sets = {c: set(parts) for c, parts in cut.items()}
        stock = {part for part, ids in owners.items() if len(ids) > PHRASING and _independent(part, ids, sets) > PHRASING}
        self.phrasing = {c: {k for k, part in enumerate(parts) if part in stock} for c, parts in cut.items()}
        #: Lengths of the items that are shorter than a window.
        self.shorter = sorted({len(t.words) for t, _ in self.classes.values() if 0 < len(t.words) < WINDOW})
        hashes, of = [], []
        for c, (t, _) in self.classes.items():
            width = min(WINDOW, len(t.template))
            if not width:
                continue
            mine = rolled(np.array([_hash_of(w) for w in t.template], np.uint64), width)
            plain = np.zeros(len(t.template), bool)
            for k, (b, e) in enumerate(zip([0, *t.ends], t.ends)):
                plain[b:e] = k not in self.phrasing[c]
            touches = np.convolve(plain, np.ones(width, int), "valid") > 0
            mine = np.unique(mine[touches])
            hashes.append(mine)
            of.append(np.full(len(mine), c, np.int64))
        self.hashes = np.concatenate(hashes) if hashes else np.empty(0, np.int64)
        self.of = np.concatenate(of) if of else np.empty(0, np.int64)


def _independent(part: tuple, ids: list[int], sets: dict[int, set]) -> int:
    """How many of the classes with a sentence share less than two fifths of their other words with each other, PHRASING + 1 at most."""
    leaders: list[int] = []
    for c in ids:
        mine = sets[c] - {part}
        size = sum(map(len, mine))
        if not any(sum(map(len, mine & sets[x])) >= COPIED * max(1, min(size, sum(map(len, sets[x])) - len(part))) for x in leaders):
            leaders.append(c)
            if len(leaders) > PHRASING:
                break
    return len(leaders)


def names_of(items: DataFrame) -> frozenset[str]:
    """The lexicon of names of all items, whatever their block.

    Words with a capital inside a sentence, and words that begin a sentence which other items have
    with another beginning, if no item has them in lower case.
    """

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"name": sorted(name_lexicon(list(batch["question"])))}, dtype=object)

    names = frozenset(r["name"] for r in items.mapInPandas(inside, "name string").distinct().toLocalIterator())

    def begun(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(names)
        for batch in batches:
            rows = set()
            for question in batch["question"]:
                t, raws = reader.canonical(question), [w for s in _sentences(question) for w in s]
                for b, e in zip([0, *t.ends], t.ends):
                    rows.update((None, t.words[i]) for i in range(b, e) if raws[i].islower())
                    if e - b >= WINDOW and _CAPITAL.match(raws[b]) and t.template[b] != NAME:
                        rows.add((_hash_of("\x1f".join(t.template[b + 1 : e])) - (1 << 63), t.words[b]))
            yield pd.DataFrame(sorted(rows, key=str), columns=["tail", "word"])

    words = settle(items.mapInPandas(begun, "tail long, word string").distinct(), scratch(items.sparkSession, "beginnings"))
    several = words.where("tail is not null").groupBy("tail").agg(F.count("*").alias("n")).where("n > 1")
    more = words.join(several, "tail", "left_semi").select("word").distinct().join(words.where("tail is null").select("word"), "word", "left_anti")
    return names | {r.word for r in more.toLocalIterator()}


def load_items(items: DataFrame) -> list[Items]:
    """The held-out items (item_id, question) in blocks of bounded size; one block as a rule."""
    items = items.where("item_id is not null and trim(question) != ''").select("item_id", "question").distinct()
    chars = items.agg(F.sum(F.length("question"))).first()[0] or 0
    blocks = max(1, -(-chars // MOST_CHARS))

    names = names_of(items)
    if blocks == 1:
        return [Items(sorted((r.item_id, r.question) for r in items.toLocalIterator()), names)]

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(names)
        for batch in batches:
            yield batch.assign(block=[xxhash.xxh3_64_intdigest(" ".join(reader.canonical(q).template)) % blocks for q in batch["question"]])

    cut = settle(items.mapInPandas(placed, "item_id long, question string, block long"), scratch(items.sparkSession, "items"))
    return [Items(sorted((r.item_id, r.question) for r in cut.where(F.col("block") == k).toLocalIterator()), names) for k in range(blocks)]


def _leaks(texts: DataFrame, known: Items) -> DataFrame:
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((known.classes, known.phrasing, known.names))
    sieve = spark.sparkContext.broadcast((known.names, known.shorter, Sieve(known.hashes)))

    def to_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, shorter, sift = sieve.value
        reader, widths = Reader(names), [*shorter, WINDOW]
        for batch in batches:
            docs, found = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = np.array(reader.hashes(text), np.uint64)
                for width in widths:
                    h = rolled(words, width)
                    h = np.unique(h[sift.passes(h)])
                    if len(h):
                        docs.append(np.full(len(h), doc_id, np.int64))
                        found.append(h)
            cat = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([cat(docs), cat(found)], ["doc_id", "h"])

    rows = pd.DataFrame({"h": known.hashes, "class_id": known.of})
    item_windows = settle(spark.createDataFrame(rows, "h long, class_id long"), scratch(spark, "item-windows"))
    least = spark.createDataFrame([(c, least_shared(len(t.words))) for c, (t, _) in known.classes.items()], "class_id long, least int")
    # The sieve lets nearly only windows of items through; the join decides. A block's windows are bounded by MOST_CHARS, so they go to every executor.
    hits = texts.mapInArrow(to_windows, "doc_id long, h long").join(F.broadcast(item_windows), "h").groupBy("doc_id", "class_id").agg(F.countDistinct("h").alias("n"))
    found = hits.join(F.broadcast(least), "class_id").where("n >= least").groupBy("doc_id").agg(F.collect_set("class_id").alias("class_ids"))
    found = settle(found, scratch(spark, "leak-candidates"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes, phrasing, names = shared.value
        reader = Reader(names)
        for batch in batches:
            rows = []
            for doc_id, text, ids in zip(batch["doc_id"], batch["text"], batch["class_ids"]):
                doc = reader.canonical(text)
                for c in ids:
                    template, members = classes[c]
                    verdicts = compare(template, [words for _, words in members], phrasing[c], doc)
                    copied = [(i, v) for (i, _), v in zip(members, verdicts) if v.copied >= COPIED]
                    # Without a copy, the class is one row: how far its nearest member is copied, and the furthest repeated.
                    for i, v in copied or [(c, Verdict(max(v.copied for v in verdicts), max(v.reparameterised for v in verdicts)))]:
                        rows.append((doc_id, int(i), int(c), len(members), v.copied, v.reparameterised))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "class_id", "members", "copied", "reparameterised"])

    schema = "doc_id long, item_id long, class_id long, members int, copied double, reparameterised double"
    return texts.join(found, "doc_id").mapInPandas(verify, schema)


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, class_id, members, copied, reparameterised (parts of the item's words).

    One row for each member of a class that the document copies; if it copies none, one row for
    the class, of its smallest item, with the largest values. Only pairs that share enough windows have rows.
    """
    ship(documents.sparkSession)
    texts = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    out = None
    for known in load_items(items):
        part = _leaks(texts, known)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id", "class_id", "members").agg(F.max("copied").alias("copied"), F.max("reparameterised").alias("reparameterised"))


def variants(documents: DataFrame, items: DataFrame, least: float = COPIED) -> DataFrame:
    """doc_id, class_id, members, reparameterised: documents that hold a class of items with other, consistent values, and copy none of its members."""
    each = leaks(documents, items).groupBy("doc_id", "class_id", "members").agg(F.max("copied").alias("copied"), F.max("reparameterised").alias("reparameterised"))
    return each.where((F.col("copied") < least) & (F.col("reparameterised") >= least)).select("doc_id", "class_id", "members", "reparameterised")


def leaked(documents: DataFrame, items: DataFrame, least: float = COPIED) -> DataFrame:
    """doc_id, item_id where the document copies at least that part of the item's words."""
    return leaks(documents, items).where(F.col("copied") >= least).select("doc_id", "item_id")
