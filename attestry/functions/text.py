"""Legal and policy text."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry.functions import vocab
from attestry.functions.urls import any_of, first_match


def requirement_type(text: Column, words=vocab.REQUIREMENT_WORDS, otherwise: str = "general") -> Column:
    low = F.lower(text)
    return first_match([(any_of(low, w), name) for name, w in words], otherwise)


def legal_units(text: Column, heading: str = vocab.HEADING, least: int = vocab.LEAST_CHUNK) -> Column:
    """array<struct<number, text>>: the units from heading to heading, or paragraphs where there is no heading.

    Text before the first heading belongs to no unit; units shorter than
    least are left out, paragraphs of the fallback never are.
    """
    groups = re.compile(heading).groups
    parts = F.transform(F.split(text, f"(?im)(?=^(?:{heading}))"), lambda x: F.btrim(x, F.lit(" \t\r\n")))
    number = lambda x: F.coalesce(*(F.nullif(F.regexp_extract(x, rf"(?im)\A(?:{heading})", g), F.lit("")) for g in range(1, groups + 1))) if groups else F.lit(None).cast("string")
    headed = F.filter(parts, lambda x: x.rlike(rf"(?im)\A(?:{heading})"))
    units = F.transform(F.filter(headed, lambda x: F.length(x) >= least), lambda x: F.struct(number(x).alias("number"), x.alias("text")))
    blocks = F.filter(F.transform(F.split(text, "\n\n"), lambda x: F.btrim(x, F.lit(" \t\r\n"))), lambda x: x != "")
    fallback = F.transform(blocks, lambda x, i: F.struct((i + 1).cast("string").alias("number"), x.alias("text")))
    return F.when(text.rlike(f"(?im)^(?:{heading})"), units).otherwise(fallback)


def norm(text: Column) -> Column:
    """Quotes, dashes and white space unified, trimmed, in lower case."""
    plain = F.translate(F.coalesce(text, F.lit("")), "‘’“”–— ", "''\"\"-- ")
    return F.lower(F.trim(F.regexp_replace(plain, r"(?U)\s+", " ")))


def fix_pdf_breaks(text: Column) -> Column:
    joined = F.regexp_replace(text, r"([a-z,;])\n+([a-z])", "$1 $2")
    return F.regexp_replace(joined, r"(?i)(?<!\n)\s*(Article|Section)\s+(\d+)", "\n\n$1 $2")


def fix_html_breaks(text: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n\s*\n+", "\n\n")
    t = F.regexp_replace(t, r"(?im)^(Article|Section|Chapter|Regulation)\s*\n\s*(\d+[A-Za-z]?)\s*$", "$1 $2")
    return F.regexp_replace(t, r"(?<!\n)\s*\b(Article|Regulation)\s+(\d+[A-Za-z]?)\s*\n", "\n\n$1 $2\n")


def bare_quote(quote: Column) -> Column:
    """The normalised quote without the quotation marks around it."""
    return F.trim(F.btrim(norm(quote), F.lit("\"'")))


def joined_quote(quote: Column) -> Column:
    """The bare quote with a space for each ellipsis."""
    spaced = F.replace(F.replace(bare_quote(quote), F.lit("..."), F.lit(" ")), F.lit("…"), F.lit(" "))
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def quote_status(quote: Column, source: Column) -> Column:
    """struct(status, note) of what built-in functions can tell; status is null where a fuzzy comparison is due."""
    s, bare = norm(source), bare_quote(quote)
    pieces = F.filter(F.transform(F.split(bare, r"\.{3}|\[\.\.\.\]|…"), lambda x: F.btrim(x, F.lit(" ."))), lambda x: F.length(x) >= 12)
    case = lambda status, note: F.struct(F.lit(status).cast("string").alias("status"), F.lit(note).cast("string").alias("note"))
    return (
        F.when(norm(quote) == "", case("N/A", "no quote given"))
        .when(s == "", case("UNSUPPORTED", "source text unavailable"))
        .when(F.length(bare) < 12, case("N/A", "quote too short to verify"))
        .when((F.size(pieces) > 1) & F.forall(pieces, lambda p: F.contains(s, p)), case("SUPPORTED", "verbatim (elided quote, all fragments found)"))
        .when(F.contains(s, joined_quote(quote)), case("SUPPORTED", "verbatim"))
        .otherwise(case(None, None))
    )


def domains_in(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(vocab.DOMAIN), 1), F.lower)


def cookie_names_in(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(vocab.COOKIE_NAME), 1), norm)


def counts_in(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(vocab.COUNT), 1), lambda x: x.cast("int"))


def is_script_api(token: Column) -> Column:
    t = F.lower(token)
    return reduce(lambda x, y: x | y, [F.startswith(t, F.lit(p)) for p in vocab.API_PREFIXES] + [F.endswith(t, F.lit(p)) for p in vocab.API_SUFFIXES])


def is_domain_stopword(token: Column) -> Column:
    return token.isin(vocab.DOMAIN_STOPWORDS) | reduce(lambda x, y: x | y, [F.endswith(token, F.lit(s)) for s in vocab.FILE_SUFFIXES])


def law_references(text: Column, pattern: str = vocab.LAW_REFERENCE) -> Column:
    """array<struct<regulation, article>>, the regulation in upper case. A number counts only right after its instrument."""
    names = F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), F.upper)
    zipped = F.arrays_zip(names.alias("regulation"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("article"))
    return F.transform(zipped, lambda x: F.struct(x["regulation"].alias("regulation"), x["article"].alias("article")))


def is_consent_control(text: Column, tokens=vocab.CONSENT_TOKENS) -> Column:
    """Whether the text of an element that can be clicked is about consent."""
    return any_of(F.lower(F.coalesce(text, F.lit(""))), list(tokens))


def article_base(article: Column) -> Column:
    plain = F.trim(F.replace(article, F.lit("Article"), F.lit("")))
    return F.coalesce(F.nullif(F.regexp_extract(plain, r"^\d+[A-Za-z]?", 0), F.lit("")), article)


def effective_date(text: Column, forms: list[str] = vocab.DATE_FORMS) -> Column:
    """The first form that is found at the text's beginning or end."""
    near = F.when(F.length(text) > 4000, F.concat(F.substring(text, 1, 2000), F.lit(" "), F.right(text, F.lit(2000)))).otherwise(text)
    return F.coalesce(*(F.nullif(F.trim(F.regexp_extract(near, f, 1)), F.lit("")) for f in forms))


def dom_text(html: Column) -> Column:
    """The text of markup by patterns alone: without scripts, styles, comments and tags, white space unified."""
    plain = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", " ")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(plain, r"[ \t\n\r]+", " "))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def word_gate(text: Column) -> Column:
    return F.when(F.length(F.trim(text)) < 100, "skip").when(word_count(text) < 300, "thin").when(word_count(text) < 500, "hub_check").otherwise("full")


def headings_of_plain(text: Column) -> Column:
    """Plain lines as markdown: a short line in capitals or title case is a heading."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    cased = lambda x: x.rlike(r"\p{L}")
    title = lambda x: (F.initcap(x) == x) & (F.regexp_count(x, F.lit(r"\S+")) < 10)
    head = lambda x: (F.length(x) < 80) & cased(x) & ((F.upper(x) == x) | title(x))
    return F.array_join(F.transform(lines, lambda x: F.when(head(x), F.concat(F.lit("\n## "), x, F.lit("\n"))).otherwise(x)), "\n")


def long_sentences(text: Column, least: int = 120) -> Column:
    return F.size(F.filter(F.split(text, r"[.!?]"), lambda x: F.length(F.trim(x)) > least))


def legal_density(text: Column, links: Column) -> Column:
    return long_sentences(text) / F.greatest(F.lit(1), links).cast("double")


def cookie_section(markdown: Column, least_words: int = 150) -> Column:
    """The section under a heading on cookies, if it is long enough."""
    section = F.regexp_extract(markdown, r"(?is)(?:^|\n)(\s*## cookies.*?)(?=\n## |\z)", 1)
    return F.when(word_count(section) > least_words, section)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it in functions over arrays."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dedupe_blocks(blocks: Column, least: int = 30, window: int = 3) -> Column:
    """The blocks without blank ones and those that one of the last kept ones equals or contains, on letters and digits of any script alone.

    Blocks shorter than least always stay. Each block is stripped once. What
    the fold carries is the last kept blocks; it runs over groups of as many
    blocks as there are groups, and what a group keeps is appended within it,
    so that no step copies more than the root of the number of blocks.
    """
    stripped = F.filter(F.transform(blocks, lambda x: F.btrim(x, F.lit(" \t\r\n"))), lambda x: x != "")
    both = F.transform(stripped, lambda x: F.struct(x.alias("block"), F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", "").alias("bare")))
    none = F.array().cast("array<string>")
    state = lambda last, kept: F.struct(last.alias("last"), kept.alias("kept"))

    def one(acc: Column, x: Column) -> Column:
        seen = (F.length(x["block"]) >= least) & F.exists(acc["last"], lambda k: F.contains(k, x["bare"]))
        last = F.array_append(acc["last"], x["bare"])
        return F.when(seen, acc).otherwise(state(F.when(F.size(last) > window, F.slice(last, 2, window)).otherwise(last), F.array_append(acc["kept"], x["block"])))

    def group(acc: Column, g: Column) -> Column:
        return bound(F.aggregate(g, state(acc["last"], none), one), lambda x: state(x["last"], F.array_append(acc["kept"], x["kept"])))

    def fold(b: Column) -> Column:
        step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(b))).cast("int"))
        groups = F.transform(F.sequence(F.lit(0), F.greatest(F.size(b) - 1, F.lit(0)), step), lambda i: F.slice(b, i + 1, step))
        return F.flatten(F.aggregate(groups, state(none, F.array().cast("array<array<string>>")), group)["kept"])

    return bound(both, fold)


def count_in(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))


def prose_score(text: Column) -> Column:
    """Sentences for, links (those to fragments twice) and bullets against."""
    links = count_in(text, "](") + count_in(text, "](#")
    return (count_in(text, ". ") * 2 - links * 3 - count_in(text, "\n-") - count_in(text, "\n*")).cast("int")


def html_escape(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def score_band(score: Column) -> Column:
    return F.when(score.isNull(), "grey").when(score >= 75, "green").when(score >= 50, "amber").otherwise("red")


def capped_list(items: Column, most: int) -> Column:
    """Lines of a list, the rest as a count."""
    more = F.when(F.size(items) > most, F.array(F.format_string("… and %d more", F.size(items) - most))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.transform(F.slice(items, 1, most), lambda x: F.concat(F.lit("- "), x)), more)


def front_matter_body(text: Column) -> Column:
    """The text after a front matter between lines of three hyphens."""
    parts = F.split(text, "---", 3)
    return F.when(F.startswith(text, F.lit("---")) & (F.size(parts) == 3), F.btrim(F.get(parts, 2), F.lit(" \t\r\n"))).otherwise(text)
