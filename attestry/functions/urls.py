"""URLs, hosts and domains."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry.functions import vocab


def any_of(text: Column, needles: list[str]) -> Column:
    """Whether the text holds any of the strings."""
    return text.rlike("|".join(re.escape(n) for n in needles)) if needles else F.lit(False)


def first_match(cases: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The value of the first condition that holds."""
    out = reduce(lambda acc, c: F.when(c[0], F.lit(c[1])) if acc is None else acc.when(c[0], F.lit(c[1])), cases, None)
    return out.otherwise(F.lit(otherwise)) if otherwise is not None else out


def url_host(url: Column, strict_compat: bool = False) -> Column:
    """The URL's host in lower case; with strict_compat also its port and user part."""
    return F.lower(F.try_parse_url(url, F.lit("AUTHORITY" if strict_compat else "HOST")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def url_fragment(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("REF")), F.lit(""))


def is_https(url: Column) -> Column:
    return F.startswith(F.lower(url), F.lit("https://"))


def etld1(host: Column, suffixes: list[str] = vocab.MULTI_LABEL_SUFFIXES) -> Column:
    """The registrable domain: two labels, or three over a suffix of two labels."""
    labels = F.split(F.ltrim(F.lower(F.coalesce(host, F.lit(""))), F.lit(".")), r"\.", -1)
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - (n - 1)), F.lit(n)), ".")
    return F.when((F.size(labels) >= 3) & last(2).isin(suffixes), last(3)).otherwise(last(2))


def root_domain(host: Column) -> Column:
    """The last two labels, whatever the suffix, without a leading www."""
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(host, F.lit("")))), r"^www\.", "")
    labels = F.split(bare, r"\.", -1)
    return F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2)), ".")


def is_third_party(host: Column, first_party: Column, suffixes: list[str] = vocab.MULTI_LABEL_SUFFIXES) -> Column:
    return (F.coalesce(host, F.lit("")) != "") & (etld1(host, suffixes) != first_party)


def is_trusted(primary: Column, candidate: Column, ecosystems: dict[str, list[str]] = vocab.ECOSYSTEMS) -> Column:
    """Either whole host is within the other, or the candidate or its root is in the ecosystem of the primary host's root."""
    a, b = F.lower(F.coalesce(primary, F.lit(""))), F.lower(F.coalesce(candidate, F.lit("")))
    group = F.create_map(*(x for k, v in ecosystems.items() for x in (F.lit(k), F.array(*map(F.lit, v))))) if ecosystems else F.create_map().cast("map<string,array<string>>")
    members = F.try_element_at(group, root_domain(a))
    kin = F.coalesce(F.array_contains(members, b) | F.array_contains(members, root_domain(b)), F.lit(False))
    return (b != "") & (F.contains(a, b) | F.contains(b, a) | kin)


def score_url(url: Column, direct=vocab.DIRECT_URL_SIGNALS, weak=vocab.WEAK_URL_SIGNALS, ends=("/privacy", "/terms"), language=vocab.LANGUAGE_KEYWORDS, proximity: str = vocab.PROXIMITY) -> Column:
    """How likely a URL is a whole policy document: a sum of signed signals."""
    u = F.lower(url)
    path = url_path(u)
    trimmed = F.rtrim(path, F.lit("/"))
    parts = [F.when(any_of(u, signals), 10).otherwise(0) for _, signals in direct]
    parts += [
        F.when(any_of(path, weak), -5).otherwise(0),
        F.when(path.rlike(vocab.LANGUAGE_PATH) & any_of(path, list(language)), 15).otherwise(0),
        F.when(reduce(lambda x, y: x | y, (F.endswith(trimmed, F.lit(e)) for e in ends)), 20).otherwise(0),
        F.when(u.rlike(proximity), 30).otherwise(0),
    ]
    return reduce(lambda x, y: x + y, parts)


def classify_policy(url: Column, text: Column, management=vocab.MANAGEMENT_URL_TOKENS, direct=vocab.DIRECT_URL_SIGNALS, keywords=vocab.POLICY_KEYWORDS) -> Column:
    """The kind of policy a link points to; the first rule that matches counts."""
    u = F.lower(url)
    both = F.concat(u, F.lit(" "), F.lower(F.coalesce(text, F.lit(""))))
    rules = [(any_of(u, list(management)), "other_policy")]
    rules += [(any_of(both, s), c) for c, s in direct] + [(any_of(both, k), c) for c, k in keywords]
    return first_match(rules, "other_policy")


def is_policy_link(href: Column, text: Column, keywords=vocab.POLICY_KEYWORDS) -> Column:
    return any_of(F.lower(F.concat(href, F.lit(" "), F.coalesce(text, F.lit("")))), [k for _, ks in keywords for k in ks])


def is_auth_url(url: Column, tokens=vocab.AUTH_URL_TOKENS) -> Column:
    return any_of(F.lower(url_path(url)), list(tokens))


def candidate_score(url: Column, category: Column, source: Column) -> Column:
    """score_url with the boosts for where the link was found and what its path names."""
    place = F.lower(F.concat(url_path(url), F.lit("#"), url_fragment(url)))
    boost = F.when(source == "consent_popup", 200).when(source == "ecosystem_wellknown", 150).when(source == "wellknown", -1).otherwise(0)
    named = F.when((category == "cookie_policy") & F.contains(place, F.lit("cookie")), 100).when((category == "privacy_policy") & F.contains(place, F.lit("privacy")), 100).otherwise(0)
    return score_url(url) + boost + F.when(source.isin("wellknown", "ecosystem_wellknown"), 0).otherwise(named)


def absolute_url(origin: Column, href: Column) -> Column:
    """The href made absolute; null if it is no http address."""
    return F.when(F.startswith(href, F.lit("/")), F.concat(origin, href)).when(F.startswith(href, F.lit("http")), href)


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\w\-.]", "_")


def security_headers(headers: Column, wanted: list[str] = vocab.SECURITY_HEADERS) -> tuple[Column, Column]:
    """The wanted headers that a map of headers has, and the names that it lacks."""
    names = F.transform(F.map_keys(headers), F.lower)
    want = F.array(*map(F.lit, wanted))
    return F.map_filter(headers, lambda k, _: F.array_contains(want, F.lower(k))), F.array_except(want, names)


def laws_of(jurisdiction: Column, url: Column | None = None) -> Column:
    """The instruments of a jurisdiction; an Indian address adds its own."""
    table = F.create_map(*(x for k, v in vocab.JURISDICTION_LAWS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    laws = F.coalesce(F.try_element_at(table, jurisdiction), F.array(*map(F.lit, vocab.DEFAULT_LAWS)))
    if url is None:
        return laws
    indian = F.endswith(F.lower(url), F.lit(".in")) | F.contains(F.lower(url), F.lit(".in/"))
    return F.when(indian, F.array_union(laws, F.array(F.lit("DPDP")))).otherwise(laws)
