"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are added up by membership
pattern (the set of their sources), and a flow routes the patterns' words to
the sources' quotas. A pattern offers its words once for nothing, again at
cost 1 and a third time at cost 2: convex costs, so that the flow repeats only
where quotas can't be filled otherwise, and as evenly as it can.

The flow is between patterns and sources, whose numbers do not follow the
documents. It reaches the documents as cuts: the documents of a pattern stand
in the order of a seeded hash, and each source takes an interval of their
words. A cut is found by adding up words in slots of the hash, ever smaller
ones, until the one that holds it has few documents, and is then one value of
the hash, to which each document compares its own. Slots are added up and
chosen on the executors: the driver sees patterns and sources only. No text
moves.

The last cut of a pattern stops before the document that would go beyond it.
The gap that is left is closed by documents behind the cut: of the next ones
in the order each is taken that still fits, or the document on the cut itself
where that comes nearer.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import WORD, broadcast_if_small, free_name, stage, unstage

#: Times that the mix may hold a document.
REPEATS = 3
#: More different sets of sources than this are an error: the flow runs on the driver, for so many in some seconds.
MOST_PATTERNS = 200_000
#: A cut is found in so many steps of so many bits of the hash.
LEVELS, LEVEL_BITS = 2, 12
#: Documents behind a last cut that are tried for its gap.
TRIED = 256
#: How a table of patterns is joined: bytes of a row beside the pattern.
ROW_BYTES = 96


def source_key(source: Column) -> Column:
    """A source's name as a key that null has too; by code point, null last."""
    return F.when(source.isNull(), F.lit("~")).otherwise(F.concat(F.lit("s"), source))


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("bigint")


def hash_key(seed: int, doc_id: Column, text: Column) -> Column:
    """A document's place in the seeded order: it follows from the document, so reruns agree."""
    return F.xxhash64(F.lit(seed), doc_id, text)


def capped_targets(sizes: dict[str, int], weights: dict[str, float], most: float) -> dict[str, float]:
    """Shares of the sum of sizes by weight; what exceeds most times a source's size goes to the others by weight."""
    total, out, open_ = float(sum(sizes.values())), {}, sorted(sizes)
    while open_:
        left, weight = total - sum(out.values()), sum(weights[s] for s in open_)
        share = {s: left * weights[s] / weight for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return out | share
        out |= {s: float(most * sizes[s]) for s in over}
        open_ = [s for s in open_ if s not in out]
    return out


def min_cost_flow(capacity: list[int], member: list[list[int]], quota: list[int], repeats: int = REPEATS) -> list[dict[int, int]]:
    """For each pattern: source -> words, of the cheapest flow among the largest.

    Words of a pattern's k-th repetition cost k, and nothing else costs. A
    path that adds to a flow leaves the start once, so it costs what its first
    edge does: the cheapest flow is the largest one with the patterns' words
    once, made larger with their words twice, and so on. Each is found in
    blocking flows along shortest paths.
    """
    left, open_ = [0] * len(capacity), list(quota)  # words that a pattern may still send, that a source may still take
    sent: list[dict[int, int]] = [{} for _ in capacity]
    of_source: list[list[int]] = [[] for _ in quota]
    for p, sources in enumerate(member):
        for s in sources:
            of_source[s].append(p)
    for _ in range(repeats):
        left = [x + c for x, c in zip(left, capacity)]
        while _blocking_flow(left, open_, member, of_source, sent):
            pass
    return [{s: w for s, w in sorted(to.items()) if w} for to in sent]


def _blocking_flow(left: list[int], open_: list[int], member: list[list[int]], of_source: list[list[int]], sent: list[dict[int, int]]) -> bool:
    """Send what fits along the shortest paths there are; False if there is none.

    A path goes from a pattern with words left to a source, on to a pattern
    whose words that source gives back, to another source that takes them, and
    ends at a source with room.
    """
    level_p, level_s = [-1] * len(left), [-1] * len(open_)
    front, depth, ends = [p for p, x in enumerate(left) if x > 0], 0, False
    for p in front:
        level_p[p] = 0
    while front and not ends:
        depth += 1
        reached = []
        for p in front:
            for s in member[p]:
                if level_s[s] < 0:
                    level_s[s] = depth
                    reached.append(s)
                    ends = ends or open_[s] > 0
        depth += 1
        front = []
        for s in reached if not ends else ():
            for p in of_source[s]:
                if level_p[p] < 0 and sent[p].get(s):
                    level_p[p] = depth
                    front.append(p)
    if not ends:
        return False
    next_s, next_p = [0] * len(left), [0] * len(open_)  # the neighbour to try next
    for root in [p for p, x in enumerate(level_p) if x == 0]:
        path = [root]  # patterns and sources by turns
        while path and left[root] > 0:
            x = path[-1]
            if len(path) % 2:
                while next_s[x] < len(member[x]) and level_s[member[x][next_s[x]]] != level_p[x] + 1:
                    next_s[x] += 1
                if next_s[x] < len(member[x]):
                    path.append(member[x][next_s[x]])
                else:
                    path.pop()
                    if path:
                        next_p[path[-1]] += 1
            elif open_[x] > 0:
                push = min(left[root], open_[x], *(sent[path[i]][path[i - 1]] for i in range(2, len(path), 2)))
                left[root] -= push
                open_[x] -= push
                for i in range(0, len(path), 2):
                    to = sent[path[i]]
                    to[path[i + 1]] = to.get(path[i + 1], 0) + push
                    if i:
                        to[path[i - 1]] -= push
                path = [root]
            else:
                some = of_source[x]
                while next_p[x] < len(some) and not (level_p[some[next_p[x]]] == level_s[x] + 1 and sent[some[next_p[x]]].get(x)):
                    next_p[x] += 1
                if next_p[x] < len(some):
                    path.append(some[next_p[x]])
                else:
                    path.pop()
                    next_s[path[-1]] += 1
    return True


@dataclass
class Mix:
    """A solved mix: which interval of which pattern's order goes to which source."""

    patterns: list[tuple[str, list[str]]]  # each with its sources
    size: dict[str, int]
    target: dict[str, float]
    intervals: DataFrame  # staged: pattern, parts array<struct<source, low, high>>

    def copies(self, docs: DataFrame, pattern: Column, key: Column, name: str = "copies") -> DataFrame:
        """docs with an array column: for each copy that the mix takes, its source's key."""
        of, at, to, parts = (free_name(docs, n) for n in ("mix_pattern", "mix_key", "mix_of", "mix_parts"))
        wide = docs.withColumn(of, pattern).withColumn(at, key)
        small = broadcast_if_small(self.intervals, ROW_BYTES + 64 * F.size("parts") + F.octet_length("pattern")).withColumnsRenamed({"pattern": to, "parts": parts})
        got = wide.join(small, F.col(of) == F.col(to), "left")
        parts = F.filter(parts, lambda x: (x["low"].isNull() | (F.col(at) > x["low"])) & (x["high"].isNull() | (F.col(at) <= x["high"])))
        return got.withColumn(name, F.coalesce(F.transform(parts, lambda x: x["source"]), F.array().cast("array<string>"))).select(*docs.columns, name)


def narrow(docs: DataFrame, sources: Column, seed: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Staged: id, size, pattern (sorted keys, as one string) and key of each row. sources: array of source keys."""
    text = docs[text_col].cast("string")
    return stage(docs.select(F.col(id_col), word_count(text).alias("size"), pattern_key(sources).alias("pattern"), hash_key(seed, docs[id_col], text).alias("key")), "mix-rows")


def pattern_key(sources: Column) -> Column:
    return F.to_json(F.array_sort(F.array_distinct(sources)))


def solve(rows: DataFrame, weights, repeats: int = REPEATS) -> Mix:
    """Solve the mix of narrow rows. weights: function of the sorted source keys, giving their weights.

    Targets share 100 % of all words, each at most `repeats` times its
    source's; a document of two sources counts for either's size.
    """
    spark = rows.sparkSession
    sums = [(r["pattern"], r["words"]) for r in rows.groupBy("pattern").agg(F.sum("size").alias("words")).limit(MOST_PATTERNS + 1).collect()]
    if len(sums) > MOST_PATTERNS:
        raise ValueError(f"over {MOST_PATTERNS} different sets of sources: group sources before mixing them")
    sums.sort()
    members = [json.loads(p) for p, _ in sums]
    sources = sorted({s for m in members for s in m})
    place = {s: i for i, s in enumerate(sources)}
    size = dict.fromkeys(sources, 0)
    for m, (_, words) in zip(members, sums):
        for s in m:
            size[s] += words
    share = dict(zip(sources, weights(sources)))
    total = sum(words for _, words in sums)
    target, overlapping = capped_targets(size, share, repeats), sum(size.values())
    if overlapping > total:  # overlapping sources: shares of the words there are
        target = {s: t * total / max(1, overlapping) for s, t in target.items()}
    flow = min_cost_flow([words for _, words in sums], [[place[s] for s in m] for m in members], [round(target[s]) for s in sources], repeats)

    parts: list[tuple] = []
    for (pattern, words), to in zip(sums, flow):
        at = 0
        for s in sorted(to):
            end = at + to[s]
            while at < end:  # one part for each repetition
                stop = min(end, (at // words + 1) * words)
                low, high = at % words, (stop - 1) % words + 1
                parts.append((pattern, sources[s], low or None, high if high < words else None, False))
                at = stop
        if parts and parts[-1][0] == pattern:
            parts[-1] = (*parts[-1][:4], True)
    table = stage(spark.createDataFrame(parts, "pattern string, source string, low bigint, high bigint, last boolean"), "mix-parts")
    intervals = stage(_intervals(rows, table), "mix-intervals")
    unstage(table)
    return Mix([(p, m) for (p, _), m in zip(sums, members)], size, target, intervals)


def _intervals(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """(pattern, parts): parts (pattern, source, low, high, last) in words as intervals of the hash, with one for each document that fills a gap before a last cut."""
    ends = [parts.select(F.col("pattern").alias("cut_pattern"), F.col(c).alias("at"), (F.col("last") & F.lit(c == "high")).alias("floor")) for c in ("low", "high")]
    wanted = ends[0].union(ends[1]).where("at IS NOT NULL").groupBy("cut_pattern", "at").agg(F.max("floor").alias("floor"))
    cuts = _cuts(rows, wanted)
    key_at = lambda name: cuts.select(F.col("cut_pattern").alias("pattern"), F.col("at").alias(name), F.col("key").alias(f"{name}_key"))
    out = parts.join(key_at("low"), ["pattern", "low"], "left").join(key_at("high"), ["pattern", "high"], "left")
    pieces = out.select("pattern", "source", F.col("low_key").alias("low"), F.col("high_key").alias("high"))

    last = parts.where("last AND high IS NOT NULL").select("pattern", "source", "high")
    gaps = cuts.where("gap > 0").join(last, (F.col("cut_pattern") == F.col("pattern")) & (F.col("at") == F.col("high"))).select(F.col("pattern").alias("gap_pattern"), "source", F.col("key").alias("after"), "gap", "next")
    gaps = stage(gaps, "mix-gaps")
    behind = rows.join(_sent(gaps, "gap_pattern"), (F.col("pattern") == F.col("gap_pattern")) & (F.col("key") > F.col("after")) & (F.col("size") > 0) & (F.col("size") <= F.col("gap")))
    alike = behind.groupBy("pattern", "key").agg(F.sum("size").alias("size"))
    tried = alike.withColumn("place", F.row_number().over(Window.partitionBy("pattern").orderBy("key"))).where(F.col("place") <= TRIED)
    in_order = tried.groupBy(F.col("pattern").alias("gap_pattern")).agg(F.sort_array(F.collect_list(F.struct("key", "size"))).alias("docs"))
    in_order = gaps.join(in_order, "gap_pattern", "left").withColumn("docs", F.coalesce("docs", F.array().cast("array<struct<key:bigint,size:bigint>>")))
    state = lambda left, keys: F.struct(left.alias("left"), keys.alias("keys"))
    take = lambda acc, x: F.when(x["size"] <= acc["left"], state(acc["left"] - x["size"], F.array_append(acc["keys"], x["key"]))).otherwise(acc)
    in_order = in_order.withColumn("filled", F.aggregate("docs", state(F.col("gap"), F.array().cast("array<bigint>")), take))
    nearer = F.when(F.col("next.size") - F.col("gap") < F.col("filled.left"), F.array("next.key")).otherwise(F.col("filled.keys"))
    fill = in_order.select(F.col("gap_pattern").alias("pattern"), "source", F.explode(nearer).alias("high")).select("pattern", "source", (F.col("high") - 1).alias("low"), "high")
    return pieces.union(fill).groupBy("pattern").agg(F.sort_array(F.collect_list(F.struct("source", "low", "high"))).alias("parts"))


def _sent(table: DataFrame, pattern: str) -> DataFrame:
    return broadcast_if_small(table, ROW_BYTES + F.octet_length(pattern))


def _cuts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Staged: (cut_pattern, at, key, gap, next) for wanted (cut_pattern, at, floor): the hash up to which the pattern's documents hold about `at` words, what is left of them, and the document behind.

    A cut is looked for in LEVELS steps of LEVEL_BITS bits of the hash: words
    are added up by the next bits, and the slot in which they reach the cut is
    taken. The documents of the slot that is left are then added up one by
    one. The document on the cut goes to the side on which it leaves the
    smaller gap, or behind a cut with floor. Rows with one hash repeat each
    other and go together. A pattern holds at least as many words as its cut.
    """
    found = stage(wanted.select("cut_pattern", "at", "floor", F.lit(0).cast("bigint").alias("slot"), F.col("at").alias("rest")), "mix-cuts")
    of_cut = Window.partitionBy("cut_pattern", "at")
    for level in range(LEVELS):
        known, then = level * LEVEL_BITS, (level + 1) * LEVEL_BITS
        here = (F.col("pattern") == F.col("cut_pattern")) & ((F.shiftright("key", 64 - known) == F.col("slot")) if known else F.lit(True))
        sums = rows.join(_sent(found, "cut_pattern"), here).groupBy("cut_pattern", "at", "floor", "rest", F.shiftright("key", 64 - then).alias("next")).agg(F.sum("size").alias("words"))
        # One row for each cut and slot, of which there are 2 ** LEVEL_BITS.
        run = sums.withColumn("run", F.sum("words").over(of_cut.orderBy("next"))).where(F.col("run") >= F.col("rest"))
        first = run.groupBy("cut_pattern", "at", "floor").agg(F.min_by(F.struct("next", (F.col("rest") - F.col("run") + F.col("words")).alias("rest")), "next").alias("x"))
        closer = stage(first.select("cut_pattern", "at", "floor", F.col("x.next").alias("slot"), "x.rest"), "mix-cuts")
        unstage(found)
        found = closer
    shift = 64 - LEVELS * LEVEL_BITS
    within = rows.join(_sent(found, "cut_pattern"), (F.col("pattern") == F.col("cut_pattern")) & (F.shiftright("key", shift) == F.col("slot")))
    within = within.groupBy("cut_pattern", "at", "floor", "slot", "rest", "key").agg(F.sum("size").alias("size"))
    run = F.sum("size").over(of_cut.orderBy("key"))
    below = F.when(F.col("floor"), F.col("run")).otherwise(F.col("run") - F.col("size") / 2) <= F.col("rest")
    at_key = F.max(F.when(F.col("below"), F.col("key")))
    held = F.coalesce(F.max(F.when(F.col("below"), F.col("run"))), F.lit(0))
    keys = within.withColumn("run", run).withColumn("below", below).groupBy("cut_pattern", "at", "slot", "rest").agg(at_key.alias("key"), held.alias("held"), F.min(F.when(~F.col("below"), F.struct("key", "size"))).alias("next"))
    return stage(keys.select("cut_pattern", "at", F.coalesce("key", F.shiftleft("slot", shift) - 1).alias("key"), (F.col("rest") - F.col("held")).alias("gap"), "next"), "mix-keys")


def cycle(weights: tuple[float, ...]):
    """Weights that repeat over the sources in order."""
    return lambda sources: [weights[i % len(weights)] for i in range(len(sources))]


def single_source(docs: DataFrame, source_col: str = "source") -> Column:
    return F.array(source_key(docs[source_col].cast("string")))


def mix_report(docs: DataFrame, weights=(5, 2, 1), seed: int = 6, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row of documents with one source each: id, size, source_size, target and taken.

    Null sources are one source, the last; null and empty texts have size 0
    and are taken 0 words; repeated rows are taken alike; an empty table gives
    an empty table; other columns are not read.
    """
    rows = narrow(docs, single_source(docs, source_col), seed, text_col, id_col)
    mix = solve(rows, cycle(tuple(weights)))
    spark = docs.sparkSession
    facts = spark.createDataFrame([(p, mix.size[m[0]], float(mix.target[m[0]])) for p, m in mix.patterns], "fact_pattern string, source_size bigint, target double")
    got = mix.copies(rows, F.col("pattern"), F.col("key"))
    return got.join(_sent(facts, "fact_pattern"), F.col("pattern") == F.col("fact_pattern")).select(id_col, "size", "source_size", "target", (F.size("copies") * F.col("size")).cast("bigint").alias("taken"))


def mix_documents(docs: DataFrame, weights=(5, 2, 1), seed: int = 6, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with the columns of docs, whatever their names.

    Documents without a word (null and empty texts) have nothing to take and
    are left out. Null sources are one source, the last. Rows that repeat an
    id with its text, or a text without an id, have one place in the order and
    are taken alike. Very long texts count whole. An empty table gives an
    empty table.
    """
    rows = narrow(docs, single_source(docs, source_col), seed, text_col, id_col)
    mix = solve(rows, cycle(tuple(weights)))
    text = docs[text_col].cast("string")
    copies, copy = free_name(docs, "mix_copies"), free_name(docs, "mix_copy")
    got = mix.copies(docs, pattern_key(single_source(docs, source_col)), hash_key(seed, docs[id_col], text), copies)
    return got.where(word_count(F.col(text_col)) > 0).withColumn(copy, F.explode(copies)).select(*docs.columns)
