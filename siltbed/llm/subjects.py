"""Subject areas of documents by class-association rules.

A sentence is a transaction of words. Rules "words -> subject" with up to DEPTH words on the left are mined by parallel
frequent-pattern growth. Words are numbered by their frequency (the F-list), and every sentence is the sorted list of its words'
numbers. Numbers are cut into shards of equal load; a sentence sends each shard the prefix that ends with the shard's last word in it, and a
shard counts, word by word, the prefixes before the word by subject (its conditional base), and grows each frequent pattern on
the prefixes before it in turn. A word whose base is larger than a shard may be is spread over several tasks, whose counts are summed.
Confidence is balanced (subjects of any size count the same) and calibrated as the lower end of its Wilson interval. A rule is
redundant unless it is clearly surer than each of its parts, which need not tell anything alone; where two words
together clearly don't mean what one of them means alone (figures of speech), the pair disarms that word.

Labelled samples give the first rules; a sample that the rules of all others contradict is left
out as mislabelled. These rules label documents that clearly have one subject, and rules are
mined anew over all documents so labelled, three times. At last every sentence of every document is scored by
the evidence (log odds) of the rules it matches, and a document has each subject that a
third of its sentences with a subject has.

Equal words of two languages are two words. Which language a text is in is learned: the frequent words of each
language are counted over the documents that name it (the names are unreliable, but the counts are many), and a text is in the
language that its own words make likeliest. A longer text that has next to no frequent word of any of them is in another.

What is sent to all tasks is bounded by the supports, parts of all sentences: the words by words a sentence over LEAST_SUPPORT, the
rules by pairs of words a sentence over it, whatever the number of documents.

Nulls: documents without id or text, and samples without text or a listed subject, are left out; a null language names none.
A text without a sentence that matches has no subject. Repeated rows of an id are scored each; the query keeps one row per id and subject.
A sentence of more than LONGEST words (text without punctuation) is cut into stretches.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.words import SENTENCE, WORD, clean
from siltbed.session import scratch, settle, ship, shuffle_partitions

#: Labelled samples that are collected, at most.
MOST_SAMPLES = 100_000
#: Words on the left of a rule, at most.
DEPTH = 2
#: A pattern's least support: so many sentences, and so large a part of all; patterns of three words and more need DEEPER times as much.
LEAST_COUNT, LEAST_SUPPORT, DEEPER = 3, 1e-5, 4
#: Balanced confidence that makes a word informative; calibrated confidence of a rule; how much surer a longer rule must be.
INFORMATIVE, SURE, SURER = 0.25, 0.5, 0.05
#: A pair disarms a word from so many sentences on, if the word's subject has surely less than this part of them.
DISARM_COUNT, DISARM = 8, 0.4
#: Log odds above chance that a sentence needs for its subject (one word that is 91 % sure), and by which it must exceed any other.
EVIDENCE, MARGIN = 2.3, 1.0
#: A document teaches if so many of its sentences have a subject, so large a part of these the same one, and so many different words speak for it.
TEACH_SENTENCES, TEACH_PURITY, TEACH_WORDS = 2, 0.75, 2
#: Part of the sentences with a subject that a document's subject needs.
SHARE = 1 / 3
#: Letters of a longer word's stem, which stands for words not known.
STEM = 5
#: Words of one sentence, at most; a longer one is cut.
LONGEST = 150
#: A language counts from so many documents and so large a part of all; a frequent word of it is in so large a part of its documents.
LEAST_DOCUMENTS, LEAST_PART, FREQUENT = 20, 0.001, 0.02
#: A text of so many words, of which a smaller part is frequent in its likeliest language, is in another language.
FOREIGN_WORDS, FOREIGN_PART = 20, 0.1
#: Words that a shard of the mining may hold.
SHARD_WORDS = 20_000_000
#: Words of conditional bases that are counted at once.
GROW_AT_ONCE = 2_000_000

_CODE = re.compile(r"```.*?(?:```|\Z)|<pre\b.*?</pre>|<code\b.*?</code>|(?:^|<p>)(?: {4}|\t)\s*\S.*$|\bhttps?://\S+", re.S | re.M | re.I)
_MARKS = re.compile("[\u0300-\u036f\u0483-\u0487\u0591-\u05bd\u0610-\u061a\u064b-\u065f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]")


def _folded(text: str) -> str:
    """text without case and accents."""
    return text.lower() if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", text.casefold()))


def prose(text: str) -> list[list[str]]:
    """Distinct folded words of each sentence of the prose in a text."""
    out = []
    for part in SENTENCE.split(clean(_CODE.sub("\n\n", text))):
        words = WORD.findall(_folded(part))
        out += [sorted(set(words[at : at + LONGEST])) for at in range(0, len(words), LONGEST)]
    return out


def stem(word: str) -> str | None:
    """The beginning of a longer word, whatever its language; related languages share it in words of learning."""
    bare = word.partition("@")[0]
    return bare[:STEM] + "*" if len(bare) > STEM else None


def with_stems(words: list[str]) -> list[str]:
    return words + sorted({s for w in words if (s := stem(w))})


@dataclass
class Languages:
    """What is frequent in which language: a row of log likelihoods and one of frequency by language for each word. Without languages all texts are in one."""

    names: list[str]
    words: dict[str, int] = field(default_factory=dict)
    likely: np.ndarray | None = None
    common: np.ndarray | None = None
    prior: np.ndarray | None = None

    @classmethod
    def of(cls, names: list[str], documents: np.ndarray, counts: dict[str, np.ndarray]) -> Languages:
        """counts: documents of each language that have a word."""
        table = np.array(list(counts.values())).reshape(-1, len(names))
        likely = np.log((table + 0.5) / (documents + 1))
        return cls(names, {w: i for i, w in enumerate(counts)}, likely - likely.max(axis=1, keepdims=True), table >= FREQUENT * documents, np.log(documents / documents.sum()))

    def mark(self, words: set[str]) -> str:
        """The mark that the words of a text get."""
        if len(self.names) < 2:
            return ""
        at = [i for w in words if (i := self.words.get(w)) is not None]
        best = int((self.prior + self.likely[at].sum(axis=0)).argmax())
        if len(words) >= FOREIGN_WORDS and self.common[at, best].sum() < FOREIGN_PART * len(words):
            return "@?"
        return "@" + self.names[best]


def wilson(part: float, n: float, z: float) -> tuple[float, float]:
    """Ends of the Wilson interval of a part seen in n cases."""
    mid, wide = part + z * z / (2 * n), z * math.sqrt(part * (1 - part) / n + z * z / (4 * n * n))
    return (mid - wide) / (1 + z * z / n), (mid + wide) / (1 + z * z / n)


def balanced(counts: list[float], totals: list[float]) -> list[float]:
    """Parts of the subjects as if all had equally many sentences."""
    rates = [c / t if t else 0.0 for c, t in zip(counts, totals)]
    return [r / (sum(rates) or 1.0) for r in rates]


def evidence(confidence: float, subjects: int) -> float:
    """Log odds of a confidence over those of a guess among the subjects."""
    sure = min(confidence, 0.99)
    return math.log(sure / (1 - sure)) + math.log(max(1, subjects - 1))


def needed(subjects: int) -> float:
    return EVIDENCE + math.log(max(1, subjects - 1))


def _by_item(rows: DataFrame, k: int) -> pd.DataFrame:
    """Counts by item and subject, summed: a frame of item and k columns."""
    return rows.groupBy("item").agg(*(F.sum(F.when(F.col("subject") == j, F.col("n")).otherwise(0)).alias(f"n{j}") for j in range(k))).toPandas()


def wilson_of(part: np.ndarray, n: np.ndarray, z: float) -> tuple[np.ndarray, np.ndarray]:
    """wilson() of arrays."""
    n = np.maximum(n, 1e-9)
    mid, wide = part + z * z / (2 * n), z * np.sqrt(np.maximum(0, part * (1 - part)) / n + z * z / (4 * n * n))
    return (mid - wide) / (1 + z * z / n), (mid + wide) / (1 + z * z / n)


def balance(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """balanced() of rows of counts."""
    rates = np.divide(counts, totals, out=np.zeros(counts.shape), where=totals > 0)
    whole = rates.sum(axis=1, keepdims=True)
    return np.divide(rates, whole, out=np.zeros(counts.shape), where=whole > 0)


@dataclass
class Vocabulary:
    """Numbers of words (1 the most frequent) and, above these, of stems."""

    words: dict[str, int]
    stems: dict[str, int]
    #: by mark: words met before
    seen: dict[str, dict[str, tuple[int, int]]] = field(default_factory=dict, repr=False)

    @classmethod
    def of(cls, counts: dict[str, int]) -> Vocabulary:
        order = sorted(counts, key=lambda w: (-counts[w], w))
        words = {w: i for i, w in enumerate((w for w in order if not w.endswith("*")), 1)}
        return cls(words, {w: len(words) + i for i, w in enumerate((w for w in order if w.endswith("*")), 1)})

    @property
    def size(self) -> int:
        return 1 + len(self.words) + len(self.stems)

    def encode(self, found: list[list[str]], mark: str = "") -> tuple[list[int], list[int], list[int]]:
        """Words (without their mark) and stems of all sentences, by number of the word (0 not known), and the sentences' lengths."""
        known = self.seen.setdefault(mark, {})
        ids, stems, lens = [], [], []
        for words in found:
            pairs = []
            for w in words:
                pair = known.get(w)
                if pair is None:
                    if len(known) > 500_000:
                        known.clear()
                    pair = known[w] = (self.words.get(w + mark, 0), self.stems.get(stem(w) or "", 0))
                if pair != (0, 0):
                    pairs.append(pair)
            pairs.sort()
            ids += [p[0] for p in pairs]
            stems += [p[1] for p in pairs]
            lens.append(len(pairs))
        return ids, stems, lens


ENCODED = "ids array<int>, stems array<int>, lens array<int>"


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column one after the other, and the length of each list."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(column.offsets.to_numpy()).astype(np.int64)


class Batch:
    """Sentences of encoded documents: words, stems, the sentence and the document of each place, documents of sentences."""

    def __init__(self, ids: pa.Array, stems: pa.Array, lens: pa.Array):
        self.words, _ = _flat(ids)
        self.stems, _ = _flat(stems)
        self.lens, per_doc = _flat(lens)
        self.doc = np.repeat(np.arange(len(per_doc)), per_doc)
        self.sentence = np.repeat(np.arange(len(self.lens)), self.lens)


def pairs_within(words: np.ndarray, row: np.ndarray, first: np.ndarray, second: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i < j, of two words in one row, where first[words[i]] and second[words[j]]; by growing distance."""
    keep = np.flatnonzero(first[words] | second[words])
    w, r = words[keep], row[keep]
    one, two, d = first[w], second[w], 1
    left = np.arange(len(w))
    while len(left):
        left = left[left + d < len(w)]
        left = left[r[left] == r[left + d]]
        hit = left[one[left] & two[left + d]]
        if len(hit):
            yield keep[hit], keep[hit + d]
        d += 1


@dataclass
class Rules:
    subjects: list[str]
    size: int
    #: by number of a word or stem: whether it is informative, its subject, its calibrated confidence
    known: np.ndarray
    subject: np.ndarray
    sure: np.ndarray
    #: sorted tuple of words: subject and confidence
    patterns: dict[tuple[int, ...], tuple[int, float]] = field(default_factory=dict)
    disarmed: set[tuple[int, int, int]] = field(default_factory=set)

    def index(self) -> Rules:
        """Number all patterns and their beginnings, as matched() wants them: a level per length, found by the beginning's number and the last word."""
        off: dict[tuple[int, int], set[int]] = defaultdict(set)
        for a, b, w in self.disarmed:
            off[a, b].add(w)
        wanted = set(self.patterns) | set(off)
        wanted |= {p[:n] for p in wanted for n in range(2, len(p))}
        self.levels, self.pattern_of = [], sorted(wanted, key=lambda p: (len(p), p))
        number = {p: i for i, p in enumerate(self.pattern_of)}
        for n in range(2, max(map(len, wanted), default=1) + 1):
            mine = [p for p in self.pattern_of if len(p) == n]
            keys = np.array([(p[0] if n == 2 else number[p[:-1]]) * self.size + p[-1] for p in mine], np.int64)
            order = np.argsort(keys)
            self.levels.append((keys[order], np.array([number[p] for p in mine], np.int64)[order]))
        self.starts, self.seconds = np.zeros(self.size, bool), np.zeros(self.size, bool)
        for p in self.pattern_of:
            self.starts[p[0]] = True
            self.seconds[p[1]] = True
        self.extends = np.zeros(len(self.pattern_of), bool)
        for p in self.pattern_of:
            if len(p) > 2:
                self.extends[number[p[:-1]]] = True
        n = len(self.pattern_of)
        self.rule_subject, self.rule_sure, self.rule_words, self.off = np.full(n, -1, np.int64), np.zeros(n), np.zeros((n, max([3, *map(len, self.pattern_of)])), np.int64), np.zeros((n, 2), bool)
        for i, p in enumerate(self.pattern_of):
            self.rule_words[i, : len(p)] = p
            if p in self.patterns:
                self.rule_subject[i], self.rule_sure[i] = self.patterns[p]
            if len(p) == 2:
                self.off[i] = [w in off.get(p, ()) for w in p]
        k = len(self.subjects)
        self.weight = np.where(self.known & (self.sure >= SURE), [evidence(c, k) if c > 0 else 0.0 for c in np.minimum(self.sure, 0.99)], 0.0)
        self.rule_weight = np.array([evidence(c, k) if c > 0 else 0.0 for c in self.rule_sure])
        self.active = self.known & (self.sure >= SURE)
        # A small table of the pairs' keys lets nearly all other pairs be passed over.
        self.sieve = np.zeros(1 << 20, bool)
        if self.levels:
            self.sieve[_spread(self.levels[0][0])] = True
        return self

    def matched(self, words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, pattern) of every pattern or beginning of one in the rows, whose words are sorted."""
        rows, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if not self.levels:
            return rows[0], found[0]
        ends = [np.empty(0, np.int64)]
        keys, numbers = self.levels[0]
        for i, j in pairs_within(words, row, self.starts, self.seconds):
            key = words[i] * self.size + words[j]
            near = self.sieve[_spread(key)]
            key, j = key[near], j[near]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[at] == key
            rows.append(row[j[hit]])
            found.append(numbers[at[hit]])
            ends.append(j[hit])
        at_rows, at_found, at_ends = np.concatenate(rows), np.concatenate(found), np.concatenate(ends)
        rows, found = [at_rows], [at_found]
        for keys, numbers in self.levels[1:]:
            grow = self.extends[at_found]
            at_found, at_ends, d = at_found[grow], at_ends[grow], 1
            more_f, more_e = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            left = np.arange(len(at_ends))
            while len(left) and len(keys):
                left = left[at_ends[left] + d < len(words)]
                left = left[row[at_ends[left]] == row[at_ends[left] + d]]
                key = at_found[left] * self.size + words[at_ends[left] + d]
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[at] == key
                more_f.append(numbers[at[hit]])
                more_e.append(at_ends[left[hit]] + d)
                d += 1
            at_found, at_ends = np.concatenate(more_f), np.concatenate(more_e)
            rows.append(row[at_ends])
            found.append(at_found)
        return np.concatenate(rows), np.concatenate(found)

    def judge(self, batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The subject of each sentence (-1: the evidence doesn't suffice), and as (sentence, word) what speaks for these."""
        k, n, m = len(self.subjects), len(batch.lens), self.size
        words, row = batch.words, batch.sentence
        lone = np.flatnonzero(self.active[words])
        s, w = row[lone], words[lone]
        stand_in = np.flatnonzero(~self.known[words] & self.active[batch.stems])
        stems = np.unique(row[stand_in] * m + batch.stems[stand_in])
        p_row, p = self.matched(words, row)
        off = np.concatenate([p_row[self.off[p, c]] * m + self.rule_words[p[self.off[p, c]], c] for c in (0, 1)]) if len(p) else np.empty(0, np.int64)
        if len(off):
            stays = ~np.isin(s * m + w, off)
            s, w = s[stays], w[stays]
        s, w = np.concatenate([s, stems // m]), np.concatenate([w, stems % m])
        subject, weight = self.subject[w], self.weight[w]
        # What a longer pattern adds is what its words, and surer patterns with one of them, don't say already.
        rule = self.rule_subject[p] >= 0
        p_row, p = p_row[rule], p[rule]
        said = [(s * k + subject) * m + w]
        add_s, add_k, add_w = [], [], []
        while len(p):
            where = p_row * k + self.rule_subject[p]
            fresh = np.ones(len(p), bool)
            for c in range(self.rule_words.shape[1]):
                word = self.rule_words[p, c]
                fresh &= (word == 0) | ~np.isin(where * m + word, said[-1])
            p_row, p, where = p_row[fresh], p[fresh], where[fresh]
            if not len(p):
                break
            order = np.lexsort((p, -self.rule_sure[p], where))
            top = order[np.r_[True, where[order][1:] != where[order][:-1]]]
            add_s.append(p_row[top])
            add_k.append(self.rule_subject[p[top]])
            add_w.append(self.rule_weight[p[top]])
            new = self.rule_words[p[top]]
            keys = (where[top][:, None] * m + new)[new > 0]
            said.append(keys)
            rest = np.ones(len(p), bool)
            rest[top] = False
            p_row, p = p_row[rest], p[rest]
        score = np.bincount(np.concatenate([s, *add_s]) * k + np.concatenate([subject, *add_k]), np.concatenate([weight, *add_w]), n * k).reshape(n, k)
        best = score.argmax(axis=1) if n else np.empty(0, np.int64)
        first = score.max(axis=1) if n else np.empty(0)
        second = np.partition(score, k - 2, axis=1)[:, k - 2] if k > 1 and n else np.zeros(n)
        got = np.where((first >= needed(k)) & (first - second >= MARGIN) & (first > 0), best, -1)
        said = np.concatenate(said)
        at, word = said // m, said % m
        speaks = got[at // k] == at % k
        return got, (at // k)[speaks], word[speaks]


def _spread(keys: np.ndarray) -> np.ndarray:
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def _counted(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each is there."""
    key = np.concatenate(keys) if keys else np.empty(0, np.int64)
    if not len(key):
        return key, key
    key.sort()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.diff(np.r_[first, len(key)])


def grow(words: np.ndarray, row: np.ndarray, subject: np.ndarray, mine: np.ndarray, size: int, k: int, least: int, depth: int, deeper: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Frequent patterns that end with a word of a shard (mine, by word) and their counts by subject, some words after the others, so that memory is bounded.

    Rows hold sorted words. A pattern is grown by the words before its first one in each row it is in: its conditional base.
    """
    place = np.flatnonzero(mine[words])
    if not len(place):
        return
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    before = place - np.repeat(starts, np.diff(np.r_[starts, len(row)]))[place]
    base = np.bincount(words[place], before, minlength=size)
    part = (np.cumsum(base) // GROW_AT_ONCE).astype(np.int64)[words[place]]
    order = np.argsort(part, kind="stable")
    for at in np.split(place[order], np.flatnonzero(np.diff(part[order])) + 1):
        yield from _grow(words, row, subject, at, size, k, least, depth, deeper)


def _grow(words: np.ndarray, row: np.ndarray, subject: np.ndarray, at: np.ndarray, size: int, k: int, least: int, depth: int, deeper: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    # at: place of the first word of each occurrence; pattern: number of the pattern it is an occurrence of.
    pattern, names = words[at], np.arange(size)[:, None]
    for length in range(2, depth + 1):
        floor = least if length == 2 else least * deeper
        keys, ats, pending = [], [], []
        left, d = np.arange(len(at)), 1
        while len(left):
            left = left[at[left] >= d]
            left = left[row[at[left] - d] == row[at[left]]]
            key = pattern[left] * size + words[at[left] - d]
            pending.append(key * k + subject[at[left]])
            if length < depth:
                keys.append(key)
                ats.append(at[left] - d)
            d += 1
        found, found_n = _counted(pending)
        if not len(found):
            return
        owner = found // k
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        frequent = np.add.reduceat(found_n, first) >= floor
        number = np.cumsum(frequent) - 1
        of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(found)]))
        kept = frequent[of]
        base = owner[first][frequent]
        if not len(base):
            return
        counts = np.zeros((len(base), k), np.int64)
        counts[number[of[kept]], found[kept] % k] = found_n[kept]
        names = np.concatenate([(base % size)[:, None], names[base // size]], axis=1)
        yield names, counts
        # Only patterns frequent enough for a longer one go on, and patterns so sure that nothing can be surer don't.
        on = counts.sum(axis=1) >= least * deeper
        if length == depth or not on.any() or len(names) * size * k >= 1 << 62:
            return
        key, place = np.concatenate(keys), np.concatenate(ats)
        wanted, numbers = base[on], np.flatnonzero(on)
        sieve = np.zeros(1 << 20, bool)
        sieve[_spread(wanted)] = True
        near = np.flatnonzero(sieve[_spread(key)])
        spot = np.minimum(np.searchsorted(wanted, key[near]), len(wanted) - 1)
        hit = wanted[spot] == key[near]
        at, pattern = place[near[hit]], numbers[spot[hit]]


def mine(labelled: DataFrame, subjects: list[str], size: int, words: int, depth: int = DEPTH) -> Rules:
    """Rules of labelled documents (ids, stems, lens: see Vocabulary.encode(); subject int), by parallel frequent-pattern growth.

    size and words: numbers of items, and of the words among them.
    """
    spark, k = labelled.sparkSession, len(subjects)
    ship(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sentences = np.zeros((size, k), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            b, label = Batch(*(batch.column(i) for i in range(3))), batch.column(3).to_numpy()
            subject = label[b.doc]
            sentences += np.bincount(subject, minlength=k)
            n += np.bincount(b.words * k + subject[b.sentence], minlength=size * k)[: size * k].reshape(size, k)
            at = np.unique(b.sentence * size + b.stems)
            at = at[at % size > 0]
            n += np.bincount((at % size) * k + subject[at // size], minlength=size * k)[: size * k].reshape(size, k)
        n[0] = sentences  # no item has the number 0
        item, of = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(of), pa.array(n[item, of])], ["item", "subject", "n"])

    # Bounded by the vocabulary.
    table = _by_item(labelled.select("ids", "stems", "lens", "subject").mapInArrow(count, "item long, subject long, n long"), k)
    n = np.zeros((size, k), np.int64)
    n[table["item"].to_numpy(np.int64)] = table[[f"n{j}" for j in range(k)]].to_numpy(np.int64) if len(table) else 0
    totals = n[0].astype(float)
    n[0] = 0
    least = max(LEAST_COUNT, math.ceil(LEAST_SUPPORT * totals.sum()))
    frequent = n.sum(axis=1) >= least
    part = balance(n, totals)
    top = part.argmax(axis=1)
    best = part[np.arange(size), top]
    sure = np.where(frequent, wilson_of(best, n.sum(axis=1).astype(float), 1.0)[0], 0.0)
    rules = Rules(subjects, size, frequent & (best >= INFORMATIVE), top, sure)
    if depth < 2 or not frequent.any():
        return rules.index()

    # Shards of words of about equal load, in the order of the list; a word with too much for one is spread.
    item = frequent & (np.arange(size) > 0) & (np.arange(size) <= words)
    freq = np.where(item, n.sum(axis=1), 0).astype(float)
    before = np.r_[0.0, np.cumsum(freq)[:-1]] / max(1.0, totals.sum())
    load = freq * (1 + before)
    shards = int(max(shuffle_partitions(spark), -(-load.sum() // SHARD_WORDS)))
    shard_of = np.minimum((np.cumsum(load) - load / 2) * shards / max(1.0, load.sum()), shards - 1).astype(np.int64)
    spread = np.maximum(1, np.ceil(load / SHARD_WORDS)).astype(np.int64)
    shard_spread = np.ones(shards, np.int64)
    np.maximum.at(shard_spread, shard_of[item], spread[item])
    model = spark.sparkContext.broadcast((item, shard_of, shard_spread, top, sure, frequent, totals))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, shard_of, shard_spread, *_ = model.value
        for batch in batches:
            b, label = Batch(*(batch.column(i) for i in range(3))), batch.column(3).to_numpy().astype(np.int64)
            keep = item[b.words]
            words, row = b.words[keep], b.sentence[keep]
            if not len(words):
                continue
            start = np.zeros(len(b.lens) + 1, np.int64)
            np.cumsum(np.bincount(row, minlength=len(b.lens)), out=start[1:])
            # Shards follow the order of words, so the last place of a shard in a row is where the shard changes.
            shard = shard_of[words]
            last = np.flatnonzero(np.r_[(shard[1:] != shard[:-1]) | (row[1:] != row[:-1]), True])
            last = last[last > start[row[last]]]  # a prefix of one word holds no pattern
            length = last - start[row[last]] + 1
            ends = np.cumsum(length)
            places = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length) + np.repeat(start[row[last]], length)
            salt = (row[last] * 7919 + words[last]) % shard_spread[shard[last]]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(words[places], pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(shard[last]), pa.array(salt), pa.array(label[b.doc[row[last]]]), lists], ["shard", "salt", "subject", "words"])

    def useful(names: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Patterns that are clearly surer than their words, or pairs that disarm one."""
        _, _, _, top, sure, _, totals = model.value
        total = counts.sum(axis=1).astype(float)
        part = balance(counts, totals)
        to = part.argmax(axis=1)
        own = wilson_of(part[np.arange(len(to)), to], total, 1.0)[0]
        word_sure = np.where(top[names] == to[:, None], sure[names], 0.0).max(axis=1)
        rule = (own >= SURE) & (own >= SURER + word_sure)
        if names.shape[1] == 2:
            for c in (0, 1):
                w = names[:, c]
                rule |= (total >= DISARM_COUNT) & (sure[w] >= SURE) & (wilson_of(part[np.arange(len(to)), top[w]], total, 2.0)[1] < DISARM)
        return rule

    def mine_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, shard_of, shard_spread, *_ = model.value
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)
        for batch in batches:
            words, lens = _flat(batch.column(3))
            shard, subject = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            of_word = np.repeat(shard, lens)
            for s in np.unique(shard):
                mine_ = shard == s
                held[int(s)].append((words[of_word == s].astype(np.int32), lens[mine_], subject[mine_].astype(np.int16)))
        for s, parts in held.items():
            words = np.concatenate([p[0] for p in parts]).astype(np.int64)
            lens = np.concatenate([p[1] for p in parts])
            row, subject = np.repeat(np.arange(len(lens)), lens), np.repeat(np.concatenate([p[2] for p in parts]).astype(np.int64), lens)
            alone = shard_spread[s] == 1
            for names, counts in grow(words, row, subject, shard_of == s, size, k, least if alone else 1, depth, DEEPER if alone else 1):
                if alone:
                    keep = useful(names, counts)
                    names, counts = names[keep], counts[keep]
                lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel(), kind))
                yield pa.RecordBatch.from_arrays([lists(names, pa.int32()), lists(counts, pa.int64()), pa.array(np.full(len(names), alone))], ["names", "counts", "whole"])

    sent = labelled.select("ids", "stems", "lens", "subject").mapInArrow(send, "shard long, salt long, subject long, words array<int>")
    found = sent.repartition(shards, "shard", "salt").mapInArrow(mine_shards, "names array<int>, counts array<long>, whole boolean")
    if (shard_spread > 1).any():
        found = settle(found, scratch(spark, "patterns"))
        summed = found.where("not whole").groupBy("names").agg(*(F.sum(F.col("counts")[j]).alias(f"n{j}") for j in range(k)))
        found = found.where("whole").select("names", "counts").unionByName(summed.select("names", F.array(*(F.col(f"n{j}") for j in range(k))).alias("counts")))
    by_length: dict[int, list] = defaultdict(list)
    for r in found.select("names", "counts").toLocalIterator(prefetchPartitions=True):
        if sum(r.counts) >= least * (DEEPER if len(r["names"]) > 2 else 1):
            by_length[len(r["names"])].append((tuple(r["names"]), r.counts))
    for length in sorted(by_length):
        names, counts = np.array([p for p, _ in by_length[length]]), np.array([c for _, c in by_length[length]])
        total, share = counts.sum(axis=1).astype(float), balance(counts, totals)
        to = share.argmax(axis=1)
        own = wilson_of(share[np.arange(len(to)), to], total, 1.0)[0]
        for i, (p, _) in enumerate(by_length[length]):
            below = max((sure[w] for w in p if top[w] == to[i]), default=0.0)
            for j in range(len(p) if length > 2 else 0):
                part_of = rules.patterns.get(p[:j] + p[j + 1 :])
                below = max(below, part_of[1] if part_of and part_of[0] == to[i] else 0.0)
            if own[i] >= SURE and own[i] >= SURER + below:
                rules.patterns[tuple(map(int, p))] = (int(to[i]), float(own[i]))
            if length == 2 and total[i] >= DISARM_COUNT:
                rules.disarmed |= {(int(p[0]), int(p[1]), int(w)) for w in p if sure[w] >= SURE and wilson(share[i, top[w]], total[i], 2.0)[1] < DISARM}
    return rules.index()


def believable(parsed: list[tuple[list[list[str]], int]], subjects: list[str]) -> list[tuple[list[list[str]], int]]:
    """Samples as sentences, without those whose label the words of all other samples contradict."""
    k = len(subjects)
    counts: dict[str, list[float]] = defaultdict(lambda: [0.0] * k)
    totals, own = [0.0] * k, []
    for found, subject in parsed:
        mine_ = Counter(w for s in found for w in with_stems(s))
        own.append(mine_)
        totals[subject] += len(found)
        for w, n in mine_.items():
            counts[w][subject] += n

    def against(i: int) -> float:
        """By how much the words of the samples still there speak for another subject."""
        subject, score = parsed[i][1], [0.0] * k
        for w, n in own[i].items():
            others = [c - n * (j == subject) for j, c in enumerate(counts[w])]
            if sum(others) < 2:
                continue
            part = balanced(others, totals)
            top = max(range(k), key=part.__getitem__)
            if (sure := wilson(part[top], sum(others), 1.0)[0]) >= SURE:
                score[top] += evidence(sure, k)
        return max(score) - score[subject]

    # The worst goes first, as a wrong sample also speaks against right ones.
    doubted = sorted(((-against(i), i) for i in range(len(parsed))), key=lambda x: x)
    dropped = set()
    for first, i in doubted:
        if -first < needed(k):
            break
        if against(i) >= needed(k):
            dropped.add(i)
            found, subject = parsed[i]
            totals[subject] -= len(found)
            for w, n in own[i].items():
                counts[w][subject] -= n
    return [p for i, p in enumerate(parsed) if i not in dropped]


@dataclass
class Corpus:
    """Documents as numbers: doc_id and the columns of Vocabulary.encode()."""

    encoded: DataFrame
    vocabulary: Vocabulary
    languages: Languages


_BODY = "doc_id long, body string, lang string, word string, n long"


def parse(documents: DataFrame) -> tuple[DataFrame, Languages]:
    """Words of every document (doc_id, body: words by blanks, sentences by lines), and the languages learned from them."""
    spark = documents.sparkSession
    ship(spark)
    lang = F.regexp_extract(F.lower(F.trim(F.col("lang").cast("string"))), "^([a-z]{2,3})(?:[-_]|$)", 1) if "lang" in documents.columns else F.lit("")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            bodies = []
            for text, name in zip(batch["text"], batch["lang"]):
                found = prose(text)
                bodies.append("\n".join(map(" ".join, found)))
                if name:
                    seen.update((name, w) for w in set().union(*found))
                    seen[name, None] += 1
            yield pd.DataFrame({"doc_id": batch["doc_id"], "body": bodies, "lang": None, "word": None, "n": None})
        rows = [(None, None, name, w, n) for (name, w), n in seen.items()]
        yield pd.DataFrame(rows, columns=["doc_id", "body", "lang", "word", "n"]).astype({"doc_id": "Int64", "n": "Int64"})

    rows = documents.where("doc_id is not null and text is not null").select("doc_id", "text", F.coalesce(lang, F.lit("")).alias("lang"))
    parsed = settle(rows.mapInPandas(split, _BODY), scratch(spark, "parsed"))
    counts = parsed.where("lang is not null").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    documents_of = {r.lang: r.n for r in counts.where("word is null").collect()}  # a row a language
    total = sum(documents_of.values())
    names = sorted(x for x, n in documents_of.items() if n >= max(LEAST_DOCUMENTS, LEAST_PART * total))
    if len(names) < 2:
        return parsed.where("body is not null").select("doc_id", "body"), Languages(names)
    # Bounded: a document has few words, so few are in a fiftieth of a language's documents.
    sizes = F.create_map(*(x for name in names for x in (F.lit(name), F.lit(documents_of[name]))))
    common = counts.where(F.col("lang").isin(names) & F.col("word").isNotNull() & (F.col("n") >= FREQUENT * sizes[F.col("lang")])).select("word").distinct()
    number, table = {x: i for i, x in enumerate(names)}, {}
    for r in counts.where(F.col("lang").isin(names)).join(common, "word").toLocalIterator():
        table.setdefault(r.word, np.zeros(len(names)))[number[r.lang]] = r.n
    return parsed.where("body is not null").select("doc_id", "body"), Languages.of(names, np.array([documents_of[x] for x in names], float), dict(sorted(table.items())))


def _marked(body: str, languages: Languages) -> tuple[str, list[list[str]]]:
    """The mark of a document's words, and these by sentence."""
    found = [s.split(" ") for s in body.split("\n") if s]
    return languages.mark(set().union(*found)) if found else "", found


def sentences(text: str, languages: Languages) -> list[list[str]]:
    """Distinct folded words of each sentence, marked with the text's language."""
    found = prose(text)
    mark = languages.mark(set().union(*found)) if found else ""
    return [[w + mark for w in s] for s in found]


def encode(documents: DataFrame, labelled: list[tuple[str, int]]) -> tuple[Corpus, list[tuple[list[list[str]], int]]]:
    """The documents as numbers, and the samples (text, subject) as sentences."""
    spark = documents.sparkSession
    bodies, languages = parse(documents)
    own = [(sentences(text, languages), subject) for text, subject in labelled]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: dict[str, Counter] = defaultdict(Counter)
        total = 0
        for batch in batches:
            for body in batch["body"]:
                mark, found = _marked(body, languages)
                total += len(found)
                for words in found:
                    n[mark].update(words)
        rows, stems = [(w + mark, c) for mark, of in n.items() for w, c in of.items()], Counter()
        for of in n.values():
            for w, c in of.items():
                if len(w) > STEM:
                    stems[w[:STEM] + "*"] += c
        yield pd.DataFrame([*rows, *stems.items(), ("", total)], columns=["item", "n"])

    counted = settle(bodies.select("body").mapInPandas(count, "item string, n long").groupBy("item").agg(F.sum("n").alias("n")), scratch(spark, "items"))
    total = (counted.where("item = ''").agg(F.max("n")).first()[0] or 0)
    least = max(LEAST_COUNT, math.ceil(LEAST_SUPPORT * total))
    counts = {r["item"]: r.n for r in counted.where((F.col("n") >= least) & (F.col("item") != "")).toLocalIterator()}
    mine_: Counter = Counter(w for found, _ in own for s in found for w in with_stems(s))
    for w, n in mine_.items():
        if n >= LEAST_COUNT:
            counts[w] = counts.get(w, 0) + n
    vocabulary = Vocabulary.of(counts)
    model = spark.sparkContext.broadcast((vocabulary, languages))

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, languages = model.value
        for batch in batches:
            rows = [vocabulary.encode(found, mark) for mark, found in (_marked(body, languages) for body in batch["body"])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], **{c: [r[i] for r in rows] for i, c in enumerate(("ids", "stems", "lens"))}})

    encoded = settle(bodies.mapInPandas(number, f"doc_id long, {ENCODED}"), scratch(spark, "encoded"))
    return Corpus(encoded, vocabulary, languages), own


def learn(corpus: Corpus, own: list[tuple[list[list[str]], int]], subjects: list[str], rounds: int = 3, depth: int = DEPTH) -> Rules:
    """Rules from labelled samples (sentences, subject), then from documents that they label."""
    spark, vocabulary = corpus.encoded.sparkSession, corpus.vocabulary
    size, words = vocabulary.size, len(vocabulary.words)
    rows = [(*vocabulary.encode(found), subject) for found, subject in believable(own, subjects)]
    first = settle(spark.createDataFrame(rows, f"{ENCODED}, subject int"), scratch(spark, "samples"))
    rules = mine(first, subjects, size, words, depth)
    for _ in range(rounds):
        teacher = spark.sparkContext.broadcast(rules)

        def teach(batches: Iterator[pa.RecordBatch], teacher=teacher) -> Iterator[pa.RecordBatch]:
            rules = teacher.value
            k = len(rules.subjects)
            for batch in batches:
                b = Batch(*(batch.column(i) for i in range(3)))
                got, at, word = rules.judge(b)
                judged = got >= 0
                votes = np.bincount(b.doc[judged] * k + got[judged], minlength=batch.num_rows * k).reshape(-1, k)
                top, total = votes.argmax(axis=1), votes.sum(axis=1)
                # Different words that speak for the document's subject.
                mine_ = got[at] == top[b.doc[at]]
                speak = np.unique(b.doc[at[mine_]] * rules.size + word[mine_])
                different = np.bincount(speak // rules.size, minlength=batch.num_rows)
                clear = (total >= TEACH_SENTENCES) & (votes.max(axis=1) >= TEACH_PURITY * total) & (different >= TEACH_WORDS)
                chosen = batch.filter(pa.array(clear))
                yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(top[clear], pa.int32())], ["ids", "stems", "lens", "subject"])

        taught = settle(corpus.encoded.select("ids", "stems", "lens").mapInArrow(teach, f"{ENCODED}, subject int"), scratch(spark, "taught"))
        rules = mine(taught.unionByName(first), subjects, size, words, depth)
    return rules


def score(corpus: Corpus, rules: Rules) -> DataFrame:
    """doc_id, subject, sentences of that subject, share among the sentences with a subject."""
    model = corpus.encoded.sparkSession.sparkContext.broadcast(rules)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = model.value
        k, names = len(rules.subjects), np.array(rules.subjects, dtype=object)
        for batch in batches:
            b = Batch(*(batch.column(i) for i in range(1, 4)))
            got, _, _ = rules.judge(b)
            judged = got >= 0
            votes = np.bincount(b.doc[judged] * k + got[judged], minlength=batch.num_rows * k).reshape(-1, k)
            doc, of = np.nonzero(votes)
            n = votes[doc, of]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(names[of], pa.string()), pa.array(n), pa.array(n / votes.sum(axis=1)[doc])], ["doc_id", "subject", "sentences", "share"])

    return corpus.encoded.mapInArrow(apply, "doc_id long, subject string, sentences long, share double")


def subjects_of(documents: DataFrame, samples: DataFrame, listed: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, subject, sentences, share: every listed subject that at least one sentence of the document has."""
    names = sorted(r.subject for r in listed.where("subject is not null").select("subject").distinct().collect())  # a short, fixed list
    number = {s: i for i, s in enumerate(names)}
    rows = samples.where("text is not null and subject is not null").select("text", "subject").limit(MOST_SAMPLES + 1).collect()
    if len(rows) > MOST_SAMPLES:
        raise ValueError(f"there are more than {MOST_SAMPLES} labelled samples")
    if not names:
        return documents.sparkSession.createDataFrame([], "doc_id long, subject string, sentences long, share double")
    corpus, own = encode(documents, sorted((r.text, number[r.subject]) for r in rows if r.subject in number))
    return score(corpus, learn(corpus, own, names, depth=depth))
