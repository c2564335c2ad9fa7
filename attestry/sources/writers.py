"""Writers of evidence, reports and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.numbers import py_format
from attestry.functions.text import html_escape, score_band
from attestry.operators import agreement, rollups

# The columns of a batch file.
BATCH_COLUMNS = [
    "domain", "sector", "jurisdiction", "status", "requests", "ui_elements", "policies_found", "overall_score", "overall_verdict", "n_dimensions",
    "n_fail", "n_partial", "n_pass", "n_not_addressed", "grounding_rate", "dims_with_issues", "seconds", "notes",
]
DISCREPANCY_LABELS = {
    "neglect": "Neglect: observed, and never disclosed in the policy", "contrary": "Contrary: the policy says the opposite of what was observed", "inadequate": "Inadequate: mentioned, but too vaguely",
}


def json_rows(df: DataFrame, path: str, by: list[str] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*by).json(path)


def new_only(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that an earlier run has not written: resuming is an anti-join."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def append_chunks(chunks: DataFrame, existing: DataFrame | None, path: str) -> None:
    """Append chunks that the table does not hold yet, by regulation, article and text."""
    keys = ["regulation", "article", "text"]
    fresh = chunks.dropDuplicates(keys) if existing is None else new_only(chunks.dropDuplicates(keys), existing, keys)
    fresh.write.mode("append").partitionBy("regulation").parquet(path)


def in_batch_columns(records: DataFrame) -> DataFrame:
    """Exactly the columns of a batch file: others are left out, missing ones are null."""
    return records.select(*(F.col(c) if c in records.columns else F.lit(None).cast("string").alias(c) for c in BATCH_COLUMNS))


def batch_csv(records: DataFrame, path: str) -> None:
    in_batch_columns(records).write.mode("overwrite").option("header", True).csv(path)


def batch_json(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def _table_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(c.cast("string"), F.lit("—")) for c in cells)), F.lit(" |"))


def _lines(df: DataFrame, order: list[str], line: Column) -> DataFrame:
    """One row: the lines in order. df has a row for each sector, label or cause, of which there are few."""
    return df.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))


def batch_markdown(records: DataFrame, issues: DataFrame) -> DataFrame:
    """(value): one row, the summary of a batch. records: batch() rows; issues: (pos, issue)."""
    named = records.withColumnRenamed("overall_score", "score")
    totals = rollups.status_totals(named).select(
        F.concat(F.format_string("# Batch summary\n\n%d sites attempted, %d scored, %d blocked, %d failed. Capture failure rate: ", "attempted", "scored", "blocked", "failed"), py_format(F.col("blocked_rate"), ".0%"), F.lit(".")).alias("head")
    )
    sectors = rollups.by_sector(named.where("score IS NOT NULL").withColumnsRenamed({"n_fail": "fails", "n_dimensions": "dimensions"}))
    sectors = sectors.withColumns({"mean": py_format(F.col("mean_score"), ".1f"), "share": py_format(F.col("fail_pct"), ".1f")})
    by_sector = _lines(sectors, ["sector"], _table_row(F.col("sector"), F.col("n"), F.col("mean"), F.col("share")))
    causes = _lines(rollups.flag_causes(issues), ["cause"], _table_row(F.col("cause"), F.col("n")))
    one = totals.crossJoin(by_sector.withColumnRenamed("lines", "sectors")).crossJoin(causes.withColumnRenamed("lines", "causes"))  # one row each
    return one.select(F.concat_ws("\n", "head", F.lit("\n## Sectors\n\n| Sector | Sites | Mean score | FAIL % |\n|---|---|---|---|"), "sectors", F.lit("\n## Attribution of flags\n\n| Cause | Flags |\n|---|---|"), "causes").alias("value"))


def ground_truth_markdown(joined: DataFrame, labels: list[str], concern: list[str]) -> DataFrame:
    """(value): one row, the comparison of annotators with the system. joined: agreement.matched() rows."""
    pairs = joined.where("matched")
    all_of = agreement.agreement(pairs).crossJoin(agreement.kappa(pairs, labels).select("kappa")).crossJoin(joined.agg(F.count_if(~F.col("matched")).alias("missing")))
    head = F.concat(F.format_string("# Ground-truth comparison\n\n%d annotated judgements, exact agreement %d (", "n", "matches"), py_format(F.col("ratio"), ".0%"), F.lit("), kappa "), py_format(F.col("kappa"), ".2f"), F.format_string(". %d rows had no system verdict.", "missing"))
    scores = agreement.prf(pairs, labels)
    used = scores.where((F.col("human_support") > 0) | (F.col("system_support") > 0))
    two = lambda c: py_format(F.col(c), ".2f")
    classes = _lines(used.withColumns({k: two(k) for k in ("precision", "recall", "f1")}), ["label"], _table_row(F.col("label"), F.col("human_support"), F.col("system_support"), F.col("precision"), F.col("recall"), F.col("f1")))
    yes = agreement.binary(pairs, concern).select(F.concat(F.lit("Concern raised: precision "), two("precision"), F.lit(", recall "), two("recall"), F.lit(", F1 "), two("f1"), F.format_string(" (TP %d, FP %d, FN %d).", "tp", "fp", "fn")).alias("binary"))
    by = agreement.agreement(pairs, ["dimension"]).join(agreement.kappa(pairs, labels, ["dimension"]).select("dimension", "kappa"), "dimension")
    dims = _lines(by.withColumns({"ratio": py_format(F.col("ratio"), ".0%"), "kappa": two("kappa")}), ["dimension"], _table_row(F.col("dimension"), F.col("n"), F.col("ratio"), F.col("kappa")))
    grid = _lines(agreement.confusion(pairs, labels), ["human"], _table_row(F.col("human"), *(F.col(f"system_{x}") for x in labels)))
    one = all_of.select(head.alias("head"))
    for name, part in (("classes", classes), ("macro", agreement.macro_f1(scores).select(F.concat(F.lit("Macro F1: "), two("macro_f1")).alias("lines"))), ("dims", dims), ("grid", grid)):
        one = one.crossJoin(part.withColumnRenamed("lines", name))  # one row each
    return one.crossJoin(yes).select(F.concat_ws("\n", "head", F.lit("\n| Verdict | Human | System | Precision | Recall | F1 |\n|---|---|---|---|---|---|"), "classes", F.lit(""), "macro", "binary", F.lit("\n| Dimension | n | Agreement | Kappa |\n|---|---|---|---|"), "dims", F.lit("\n| | " + " | ".join(labels) + " |" + "\n|---" + "|---" * len(labels) + "|"), "grid").alias("value"))


def annotation_sheet(rows: DataFrame, path: str) -> None:
    """A blinded sheet: the system's verdict is not in it, and the label is blank."""
    sheet = rows.select("domain", "dimension", "legal_requirement", "observed_behaviour", "policy_excerpt", F.lit("").alias("human_verdict"), F.lit("").alias("annotator_notes"))
    sheet.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def domain_list(domains: DataFrame, path: str) -> None:
    domains.select(F.col("domain").alias("value")).orderBy("value").write.mode("overwrite").text(path)


def policy_markdown(policies: DataFrame) -> DataFrame:
    """(file, value): the text with its front matter. policies: domain, category, url, title, body, effective_date."""
    line = lambda k, c: F.concat(F.lit(f"{k}: "), F.coalesce(F.col(c), F.lit("")))
    head = F.concat_ws("\n", F.lit("---"), line("title", "title"), line("url", "url"), line("category", "category"), line("effective_date", "effective_date"), F.lit("---"))
    return policies.select(F.concat(F.regexp_replace("domain", r"[^\w.-]", "_"), F.lit("_"), F.col("category"), F.lit(".md")).alias("file"), F.concat(head, F.lit("\n\n"), F.col("body")).alias("value"))


def policy_index(policies: DataFrame) -> DataFrame:
    return policies.groupBy("domain").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("category", "url", "title"))).alias("documents"))


def _card(columns: list[str]) -> Column:
    """A dimension's card: verdict, score, bar, severity and confidence, and the rows that it has text for."""
    opt = lambda c, kind="string": F.col(c) if c in columns else F.lit(None).cast(kind)
    score = F.col("score")
    label = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in DISCREPANCY_LABELS.items() for x in kv)), opt("discrepancy_type")), opt("discrepancy_type"))
    cite = F.when(opt("regulation").isNotNull(), F.concat(opt("regulation"), F.lit(" Art. "), F.coalesce(opt("article"), F.lit(""))))
    row = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"<dt>{name}</dt><dd>"), html_escape(c), F.lit("</dd>"))).otherwise("")
    width = F.when(score.isNull(), 0).otherwise(F.greatest(F.lit(2), score)).cast("string")
    return F.concat(
        F.lit('<section class="'), score_band(score), F.lit('"><h2>'), html_escape(F.col("dimension")), F.lit("</h2><p>"), html_escape(F.replace("verdict", F.lit("_"), F.lit(" "))), F.lit(" "), F.coalesce(score.cast("string"), F.lit("—")),
        F.lit('</p><div class="bar" style="width:'), width, F.lit('%"></div><p>severity: '), html_escape(F.coalesce(opt("severity"), F.lit("—"))), F.lit(", confidence: "), py_format(opt("confidence", "double"), ".0%"), F.lit("</p><dl>"),
        row("Legal requirement", F.concat_ws(" ", opt("requirement_text"), cite)), row("Policy claim", opt("policy_claim")), row("Observed behaviour", opt("behavioral_evidence")), row("Discrepancy", label),
        row("Assessment", opt("explanation")), row("Recommended fix", opt("recommendation")), F.lit("</dl></section>"),
    )


def evidence_appendix(evidence: DataFrame) -> DataFrame:
    """(site, appendix): profiling cookies, third parties and fingerprinting of an evidence row; empty where it has none of them."""
    cookies = F.concat("pre_consent_profiling_cookies", "js_set_profiling_cookies")
    life = lambda c: F.when(F.coalesce(c["lifetime_days"], F.lit(0.0)) == 0, "session").otherwise(F.concat(c["lifetime_days"].cast("bigint").cast("string"), F.lit(" days")))
    parts = [
        ("Potential pre-consent profiling cookies", F.transform(cookies, lambda c: F.concat(html_escape(c["name"]), F.lit(" ("), html_escape(c["cookie_domain"]), F.lit("), "), life(c)))),
        ("Third-party domains contacted", F.transform("third_party_domains", html_escape)), ("Fingerprinting API calls", F.transform("fingerprinting_alarms", html_escape)),
    ]
    lists = [F.when(F.size(items) > 0, F.concat(F.format_string(f"<h3>{title} (%d)</h3><ul>", F.size(items)), F.array_join(F.transform(items, lambda x: F.concat(F.lit("<li>"), x, F.lit("</li>"))), ""), F.lit("</ul>"))).otherwise("") for title, items in parts]
    body = F.concat(*lists)
    head = F.concat(F.lit("<h2>Behavioural evidence</h2><p>tracker classification: "), html_escape(F.col("tracker_list_mode")), F.lit(", consent UI detected: "), F.coalesce(F.col("consent_ui_detected").cast("string"), F.lit("")), F.lit("</p>"))
    return evidence.select(F.col("scan").alias("site"), F.when(body != "", F.concat(head, body)).otherwise("").alias("appendix"))


def report_html(rows: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """(site, value): a page per site, worst dimensions first, unscored ones last, with the evidence at the end.

    rows: (site, dimension, verdict, score, pos) and what else of a card there
    is. A site has as many rows as there are dimensions.
    """
    card = _card(rows.columns)
    made = rows.select("site", F.struct(F.coalesce("score", F.lit(1000)).alias("o"), F.col("pos").alias("p"), card.alias("card")).alias("x"))
    pages = made.groupBy("site").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["card"]), "\n").alias("body"))
    pages = pages.join(evidence_appendix(evidence), "site", "left") if evidence is not None else pages.withColumn("appendix", F.lit(""))
    return pages.select("site", F.concat(F.lit('<!doctype html><meta charset="utf-8"><title>'), html_escape(F.col("site")), F.lit("</title>\n"), F.col("body"), F.coalesce("appendix", F.lit(""))).alias("value"))


def gate(verified: DataFrame) -> None:
    """Raise if any check is unsupported: for strict runs."""
    if not verified.where("status = 'UNSUPPORTED'").isEmpty():
        raise SystemExit(1)
