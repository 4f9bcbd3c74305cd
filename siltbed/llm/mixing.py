"""Mixing sources to target weights, measured in tokens.

Documents lie in the leaves of a tree of domain, language and source. The targets of the sources are
propagated: a leaf's weight is its source's target times its part of the source's tokens, a node's the
sum of its leaves. A budget goes down the tree by weight. What a child cannot take (its tokens
times the most repeats) goes to its siblings by weight, and only what all of them together cannot take was
never given to their parent, but to the parent's siblings. Without a stated budget the largest
one is taken at which every source that has documents reaches its target.

A leaf's budget is taken in epochs, each a seeded order of all its documents: as many whole
epochs as fit, and of the next one a prefix of the tokens left. The end of the prefix is found from token
sums of ranges of the order, so no task sorts a whole leaf. The rounding to whole documents of a source's
small leaves is made up for in its largest one.

Nulls: documents without id, text or source, or of a source without target, are left out; a missing
language or domain is one of its own. Empty texts have no tokens and are never taken. Repeated rows of an id are
one document. Of repeated targets of one source the largest counts.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltbed.session import scratch, settle, ship

#: Default vocabulary, a file of token ranks; a parameter of every operator here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public splitting pattern that belongs to this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ranges that an epoch's order is cut into (a power of two).
RANGE_BITS = 12
LEVELS = ["domain", "lang", "source"]

_loaded: dict = {}


def _encoding(path: str):
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def count_tokens(texts: list[str], vocabulary: str = VOCABULARY) -> list[int]:
    encode = _encoding(vocabulary).encode_ordinary
    return [len(encode(t)) for t in texts]


def with_tokens(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, domain, lang, source, text with tokens in place of the text."""
    ship(documents.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns="text").assign(tokens=count_tokens(list(batch["text"]), vocabulary))

    return documents.select("doc_id", *LEVELS, "text").mapInPandas(count, "doc_id long, domain string, lang string, source string, tokens long")


def _pour(amount: float, children: dict, weight: dict, cap: dict) -> dict:
    """amount by weight, no child above its cap; the excess goes to the others by weight."""
    given = dict.fromkeys(children, 0.0)
    open_, left = set(children), amount
    while open_ and left > 1e-9:
        total = sum(weight[c] for c in open_)
        if total <= 0:
            break
        full = {c for c in open_ if given[c] + left * weight[c] / total >= cap[c] - 1e-9}
        if not full:
            for c in open_:
                given[c] += left * weight[c] / total
            break
        for c in full:
            left -= cap[c] - given[c]
            given[c] = cap[c]
        open_ -= full
        # What the others were given stays; only the rest is poured again.
    return given


@dataclass
class Node:
    """What one node of the tree was asked for, could give at most, and was given.

    asked: its weight's part of the whole budget. share: its weight's part of what its parent was given, so share - asked is
    what came from shortages beside its ancestors; given - share is what came from its siblings' shortages (or, below 0, its own shortage).
    """

    path: tuple
    weight: float
    cap: float
    asked: float
    share: float
    given: float


def largest_total(leaves: dict[tuple, int], targets: dict[str, tuple[float, int]]) -> float:
    """The largest budget at which every source that has documents reaches its target."""
    there: dict[str, int] = defaultdict(int)
    for path, tokens in leaves.items():
        there[path[-1]] += tokens
    return min((targets[s][1] * n / targets[s][0] for s, n in there.items() if n and targets[s][0] > 0), default=0.0)


def budget_tree(leaves: dict[tuple, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[tuple, Node]:
    """Every node from the root () to the leaves. leaves: tokens there are by (domain, lang, source); targets: share and most repeats of a source."""
    there: dict[str, int] = defaultdict(int)
    for path, tokens in leaves.items():
        there[path[-1]] += tokens
    if total is None:
        total = largest_total(leaves, targets)
    weight: dict[tuple, float] = defaultdict(float)
    cap: dict[tuple, float] = defaultdict(float)
    children: dict[tuple, dict] = defaultdict(dict)
    for path, tokens in leaves.items():
        share, repeats = targets[path[-1]]
        for depth in range(len(path) + 1):
            node = path[:depth]
            weight[node] += share * tokens / there[path[-1]] if there[path[-1]] else 0.0
            cap[node] += repeats * tokens
            if depth:
                children[path[: depth - 1]][node] = None
    nodes = {(): Node((), weight[()], cap[()], total, total, min(total, cap[()]))}
    queue = [()]
    while queue:
        node = queue.pop()
        if node in children:
            given, all_weights = nodes[node].given, sum(weight[c] for c in children[node])
            poured = _pour(given, children[node], weight, cap)
            for c in children[node]:
                share = given * weight[c] / all_weights if all_weights else 0.0
                asked = total * weight[c] / weight[()] if weight[()] else 0.0
                nodes[c] = Node(c, weight[c], cap[c], asked, share, poured[c])
            queue += list(children[node])
    return nodes


def budgets(leaves: dict[tuple, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[tuple, float]:
    """Tokens for each leaf."""
    nodes = budget_tree(leaves, targets, total)
    return {path: nodes[path].given for path in leaves}


def _prefix(docs: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """docs with copies: whole epochs, and one more for the prefix of the next.

    docs: doc_id, leaf, tokens. wanted: a row per leaf: leaf, epochs, rest.
    """
    order = F.xxhash64("doc_id", F.lit(seed), F.col("epochs"))
    placed = docs.join(F.broadcast(wanted), "leaf").withColumn("h", order)  # leaves are few: domains x languages x sources
    placed = placed.withColumn("part", F.shiftrightunsigned("h", 64 - RANGE_BITS))
    sums = placed.groupBy("leaf", "part").agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("leaf").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before)
    edge = sums.where("before <= rest and before + n > rest").select("leaf", F.col("part").alias("edge"), "before")
    placed = placed.join(F.broadcast(edge), "leaf", "left")
    # A leaf without an edge is asked for all of its tokens, or for none.
    whole = placed.where("edge is null or part != edge").withColumn("more", F.when(F.col("edge").isNull(), F.col("rest") > 0).otherwise(F.col("part") < F.col("edge")))
    in_part = Window.partitionBy("leaf").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    cut = placed.where("part = edge").withColumn("upto", F.col("before") + F.coalesce(F.sum("tokens").over(in_part), F.lit(0)))
    cut = cut.withColumn("more", F.col("upto") + F.col("tokens") / 2 <= F.col("rest")).drop("upto")
    both = whole.unionByName(cut)
    return both.select("doc_id", "leaf", "tokens", (F.col("epochs") + F.col("more").cast("long")).alias("copies")).where("copies > 0 and tokens > 0")


def counted_leaves(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> tuple[DataFrame, dict[tuple, int], dict[str, tuple[float, int]]]:
    """Documents with tokens and leaf, tokens by leaf (there are domains times languages times sources), and share and repeats by source."""
    spark = documents.sparkSession
    name = lambda c: F.lower(F.trim(c))
    # The sources with a target are a short, given list.
    wanted = {}
    for r in targets.where("trim(source) != '' and target_share is not null and max_repeats is not null").select(name(F.col("source")).alias("source"), "target_share", "max_repeats").collect():
        wanted[r.source] = max(wanted.get(r.source, (0.0, 0)), (float(r.target_share), int(r.max_repeats)))
    docs = documents.withColumn("source", name(F.col("source"))).where(F.col("source").isin(sorted(wanted)) & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    docs = docs.withColumn("lang", F.coalesce(F.regexp_extract(F.lower(F.trim("lang")), "^([a-z]{2,3})(?:[-_]|$)", 1), F.lit(""))).withColumn("domain", F.coalesce("domain", F.lit("")))
    counted = with_tokens(docs, vocabulary).groupBy("doc_id").agg(F.max(F.struct(*LEVELS, "tokens")).alias("d")).select("doc_id", "d.*")
    counted = settle(counted.withColumn("leaf", F.concat_ws("\x1f", *LEVELS)), scratch(spark, "tokens"))
    leaves = {tuple(r.leaf.split("\x1f")): r.tokens for r in counted.groupBy("leaf").agg(F.sum("tokens").alias("tokens")).collect() if r.tokens}
    return counted, leaves, wanted


def budget_report(documents: DataFrame, targets: DataFrame, excess: float, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row for each node of the tree, at a budget of excess times the largest at which no source is short.

    level, domain, lang, source (null below the level), weight, asked, most (what it could give at most), given,
    short (what it lacks of its share), from_siblings and from_ancestors (what it got of the shortages beside it, and beside its ancestors).
    """
    _, leaves, wanted = counted_leaves(documents, targets, vocabulary)
    nodes = budget_tree(leaves, wanted, excess * largest_total(leaves, wanted))
    rows = []
    for path, n in sorted(nodes.items()):
        names = [*path, *[None] * (len(LEVELS) - len(path))]
        rows.append((len(path), *names, n.weight, n.asked, n.cap, n.given, max(0.0, n.share - n.given), max(0.0, n.given - n.share), n.share - n.asked))
    columns = ", ".join(f"{c} double" for c in ("weight", "asked", "most", "given", "short", "from_siblings", "from_ancestors"))
    return documents.sparkSession.createDataFrame(rows, "level int, " + ", ".join(f"{c} string" for c in LEVELS) + ", " + columns)


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 7, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, domain, lang, source, tokens, copies), and per source what was wanted and reached.

    documents: doc_id, domain, lang, source (compared without case and blanks), text. targets:
    source, target_share, max_repeats. total: tokens of the mixture.
    """
    spark = documents.sparkSession
    counted, leaves, wanted = counted_leaves(documents, targets, vocabulary)
    given = budgets(leaves, wanted, total)

    def plan(amounts: dict[tuple, float]) -> DataFrame:
        rows = []
        for path, amount in amounts.items():
            epochs = int((amount + 1e-6) // leaves[path])
            rows.append(("\x1f".join(path), epochs, max(0.0, amount - epochs * leaves[path])))
        return spark.createDataFrame(rows, "leaf string, epochs long, rest double")

    small = counted.select("doc_id", "leaf", "tokens")
    largest = {}
    for path in sorted(leaves):
        if path[-1] not in largest or given[path] > given[largest[path[-1]]]:
            largest[path[-1]] = path
    first = {p: a for p, a in given.items() if p not in largest.values()}
    schema = "doc_id long, leaf string, tokens long, copies long"
    chosen = settle(_prefix(small, plan(first), seed), scratch(spark, "mix")) if first else spark.createDataFrame([], schema)
    got = {tuple(r.leaf.split("\x1f")): r.tokens for r in chosen.groupBy("leaf").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens")).collect()}
    rest = {}
    for source, path in largest.items():
        off = sum(a - got.get(p, 0) for p, a in first.items() if p[-1] == source)
        rest[path] = min(max(0.0, given[path] + off), float(wanted[source][1] * leaves[path]))
    chosen = chosen.unionByName(_prefix(small, plan(rest), seed)) if rest else chosen
    parts = F.split("leaf", "\x1f")
    mixture = settle(chosen.select("doc_id", *(parts[i].alias(c) for i, c in enumerate(LEVELS)), "tokens", "copies"), scratch(spark, "mixture"))

    there: dict[str, int] = defaultdict(int)
    for path, tokens in leaves.items():
        there[path[-1]] += tokens
    asked = spark.createDataFrame([(s, w[0], w[1], there.get(s, 0), float(sum(a for p, a in given.items() if p[-1] == s))) for s, w in sorted(wanted.items())],
                                  "source string, target_share double, max_repeats int, tokens_there long, tokens_asked double")
    reached = mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row a source
    report = asked.join(reached, "source", "left").na.fill(0, ["tokens", "documents", "most_copies"])
    sum_all = F.sum("tokens").over(everything)
    return mixture, report.withColumn("share", F.when(sum_all > 0, F.col("tokens") / sum_all).otherwise(F.lit(0.0)))
