"""Mechanical checks that what a report claims is in its sources."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.functions import text as X
from attestry.functions import vocab
from attestry.functions.fuzzy import quote_ratios
from attestry.operators.sizes import broadcast_if_small


def host_suffixes(host: Column) -> Column:
    """All endings of a host at a dot, itself first; the last label alone is none."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def suffix_pairs(claims: DataFrame, known: DataFrame) -> DataFrame:
    """(claim, domain) where one equals the other or ends with it at a dot: two equi-joins, no product."""
    down = claims.select("claim", F.explode(host_suffixes(F.col("claim"))).alias("domain")).join(known.select("domain").distinct(), "domain")
    up = known.select("domain", F.explode(host_suffixes(F.col("domain"))).alias("claim")).join(claims.select("claim").distinct(), "claim")
    return down.select("claim", "domain").unionByName(up.select("claim", "domain")).distinct()


#: A quote is looked up by a key of at most so many of its characters.
KEY_LENGTH = 24
#: Characters of the keys that are looked up in one pass over the texts: an automaton takes about 100 bytes for each.
KEYS_AT_ONCE = 1 << 20


def key_of(quote: str) -> int:
    """Where the key of a quote starts: the run of KEY_LENGTH with the most different characters, the first of equals."""
    return max(range(max(1, len(quote) - KEY_LENGTH + 1)), key=lambda i: (len(set(quote[i : i + KEY_LENGTH])), -i))


class QuoteFinder:
    """Which of many quotes a text holds: one pass of an automaton of their keys; what it meets is compared whole."""

    def __init__(self, quotes: list[str]):
        self.quotes, keys = quotes, {}
        for n, q in enumerate(quotes):
            at = key_of(q)
            keys.setdefault(q[at : at + KEY_LENGTH], []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for key, held in keys.items():
            self.automaton.add_word(key, (len(key), held))
        self.automaton.make_automaton()

    def held(self, text: str) -> list[int]:
        """The places in the list of the quotes that the text holds, in order."""
        found: set[int] = set()
        for end, (size, held) in self.automaton.iter(text):
            for n, at in held:
                start = end + 1 - size - at
                if n not in found and start >= 0 and text.startswith(self.quotes[n], start):
                    found.add(n)
        return sorted(found)


def _blocks(quotes: DataFrame) -> Iterator[list[str]]:
    """The quotes in blocks of KEYS_AT_ONCE characters of keys."""
    block, size = [], 0
    for row in quotes.toLocalIterator():
        block.append(row[0])
        size += min(len(row[0]), KEY_LENGTH)
        if size >= KEYS_AT_ONCE:
            yield block
            block, size = [], 0
    if block:
        yield block


def containing(quotes: DataFrame, texts: DataFrame, quote_id: str = "quote_id", text_id: str = "text_id") -> DataFrame:
    """(quote_id, text_id) where the text holds the quote, character by character.

    quotes: (quote_id, quote); texts: (text_id, text). The different quotes
    are read here, block by block; each block is an automaton that goes to
    the tasks, and one pass over the texts finds all that they hold of it, so
    the work is one step for each character and block. Null quotes are in
    nothing, the empty quote is in every text that is not null; repeated rows
    count once.
    """
    asked = quotes.where(F.col("quote").isNotNull()).select(F.col(quote_id).alias("quote_id"), "quote").distinct()
    named = texts.where(F.col("text").isNotNull()).select(F.col(text_id).alias("text_id"), "text")
    schema = T.StructType([T.StructField("quote", T.StringType()), named.schema["text_id"]])

    def search(block: list[str]) -> DataFrame:
        sent = quotes.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = QuoteFinder([q for q in sent.value if q])
            anywhere = [""] if "" in sent.value else []
            for b in batches:
                ids, found, row = b.column("text_id"), [], []
                for i, text in enumerate(b.column("text").to_pylist()):
                    here = [finder.quotes[n] for n in finder.held(text)] + anywhere
                    found += here
                    row += [i] * len(here)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), ids.take(pa.array(row, pa.int64()))], names=schema.names)

        return named.mapInArrow(run, schema)

    passes = [search(block) for block in _blocks(asked.select("quote").distinct())]
    if not passes:
        return asked.join(named.limit(0), F.lit(False)).select("quote_id", "text_id")
    met = reduce(DataFrame.unionByName, passes).distinct()
    return met.join(broadcast_if_small(asked, F.octet_length("quote") + 64), "quote").select("quote_id", "text_id").distinct()


def citation_status(article: Column, regulation: Column, retrieved: Column) -> Column:
    """Whether the cited article (and regulation, if given) is among those retrieved."""
    base = X.article_base(article)
    hit = F.exists(retrieved, lambda r: (r["article"] == base) & (regulation.isNull() | (F.upper(r["regulation"]) == F.upper(regulation))))
    return F.when(F.coalesce(article, F.lit("")) == "", "N/A").when(F.coalesce(F.size(retrieved), F.lit(0)) <= 0, "N/A").when(hit, "SUPPORTED").otherwise("UNSUPPORTED")


def quote_statuses(rows: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Adds a struct (status, ratio, note) for each check, a quote and its source, under the check's name.

    Built-in functions decide what they can. What is left of all checks
    reaches the fuzzy function in one call, which gets null for the rest, so
    rows are read once.
    """
    fast = rows.withColumns({f"_fast_{name}": X.quote_status(quote, source) for name, (quote, source) in checks.items()})
    due = lambda name, c: F.when(F.col(f"_fast_{name}.status").isNull(), c)
    slow = fast.withColumn("_ratios", quote_ratios([(due(name, X.joined_quote(quote)), due(name, X.norm(source))) for name, (quote, source) in checks.items()]))
    out = {}
    for i, name in enumerate(checks):
        known, ratio = F.col(f"_fast_{name}"), F.get("_ratios", F.lit(i))
        note = F.when(ratio >= vocab.FUZZY_ACCEPT, "near-verbatim (minor edits)").when(ratio >= vocab.FUZZY_PARTIAL, "paraphrased, not a quotation").otherwise("no matching text found in source")
        out[name] = F.when(
            known["status"].isNotNull(),
            F.struct(known["status"].alias("status"), F.when(known["note"] == "source text unavailable", 0.0).otherwise(1.0).alias("ratio"), known["note"].alias("note")),
        ).otherwise(F.struct(F.when(ratio >= vocab.FUZZY_ACCEPT, "SUPPORTED").otherwise("UNSUPPORTED").alias("status"), F.bround(ratio, 3).alias("ratio"), note.alias("note")))
    return slow.withColumns(out).drop("_ratios", *(f"_fast_{name}" for name in checks))


def quote_checks(rows: DataFrame, quote: str = "quote", source: str = "source") -> DataFrame:
    """Adds status, ratio and note of one quote."""
    checked = quote_statuses(rows, {"_check": (F.col(quote), F.col(source))})
    return checked.withColumns({c: F.col(f"_check.{c}") for c in ("status", "ratio", "note")}).drop("_check")


def behaviour_issues(claim: Column, domains: Column, cookies: Column, counts: Column, raw: Column) -> Column:
    """array<string>: domains, cookies and counts of a claim that the evidence lacks.

    A cookie or count that merely occurs in the evidence's text is let pass.
    """
    named = F.filter(X.domains_in(claim), lambda d: ~X.is_domain_stopword(d) & ~X.is_script_api(d))
    known = lambda d: F.exists(domains, lambda k: (d == k) | F.endswith(d, F.concat(F.lit("."), k)) | F.endswith(k, F.concat(F.lit("."), d)))
    bad = F.transform(F.filter(named, lambda d: ~known(d)), lambda d: F.concat(F.lit("domain '"), d, F.lit("' not in telemetry")))
    names = F.filter(X.cookie_names_in(claim), lambda c: ~F.array_contains(cookies, c) & ~F.contains(raw, c))
    numbers = F.filter(X.counts_in(claim), lambda n: ~F.array_contains(counts, n) & ~F.contains(raw, n.cast("string")))
    return F.concat(bad, F.transform(names, lambda c: F.concat(F.lit("cookie '"), c, F.lit("' not in telemetry"))), F.transform(numbers, lambda n: F.concat(F.lit("count '"), n.cast("string"), F.lit("' not corroborated by telemetry"))))


def behaviour_status(claim: Column, issues: Column, domains: Column, cookies: Column) -> Column:
    named = F.size(F.filter(X.domains_in(claim), lambda d: ~X.is_domain_stopword(d))) + F.size(F.filter(X.cookie_names_in(claim), lambda c: F.array_contains(cookies, c)))
    return F.when(F.coalesce(claim, F.lit("")) == "", "N/A").when(F.size(issues) > 0, "UNSUPPORTED").when(named > 0, "SUPPORTED").otherwise("N/A")


def grounding(rows: DataFrame) -> DataFrame:
    """One row of rates over (legacy, issues array): of the verifiable rows, and of all; null without rows."""
    fine = F.size("issues") == 0
    rate = lambda n, d: F.bround(F.try_divide(n.cast("double"), d.cast("double")), 3)
    return rows.agg(
        rate(F.count_if(fine & ~F.col("legacy")), F.count_if(~F.col("legacy"))).alias("grounding_rate"), rate(F.count_if(fine), F.count("*")).alias("grounding_rate_all"),
        F.coalesce(F.sum(F.size("issues")), F.lit(0)).cast("bigint").alias("issues"),
    )
