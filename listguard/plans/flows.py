"""The three whole jobs: listing files to verdicts, published listings to a report, weekly files."""

from __future__ import annotations

from pyspark.sql import DataFrame

from listguard.operators import analytics, audit, ingest, matching, report
from listguard.operators.checks import run_checks
from listguard.operators.skew import first_per_key
from listguard.operators.verdict import expand, verdict
from listguard.session import stage
from listguard.sources.rules import RuleBook, paths_to_codes


def category_predictor(rules: RuleBook, stop_words=None):
    """Predictor from the rule tables, or None when there is no category map."""
    if "category_map" not in rules.tables:
        return None
    categories = rules.table("category_map").where("path IS NOT NULL").selectExpr("path AS category", "_pos")
    def given(name):
        return rules.table(name) if name in rules.tables else None
    return matching.predictor(categories, paths_to_codes(rules.table("category_map")),
                              given("category_keyword"), given("correction"), stop_words)


def listing_tables(df: DataFrame, rules: RuleBook, pos: str = "_pos", skip=(), predict=None) -> tuple[DataFrame, DataFrame]:
    """(prepared products, their flags), both written.

    The prepared products hold all columns and are written once; the joined checks read few of them each. The flags
    go with the columns that expansions and verdicts need, so whatever follows reads narrow rows.
    """
    prepared = stage(ingest.prepare(df, rules.country, rules.market, pos), "prepared")
    checked = run_checks(prepared, rules, skip=skip, pos=pos, predict=predict)
    return prepared, stage(checked.select(*[c for c in CHECKED if c in checked.columns]), "flagged")


CHECKED = ["PRODUCT_SET_SID", "PARENTSKU", "NAME", "BRAND", "SELLER_NAME", "COLOR", "_found", "_mask"]


def flagged_listings(df: DataFrame, rules: RuleBook, **kwargs) -> DataFrame:
    """Products with own and shared flags, in the narrow form of ``listing_tables``."""
    return expand(listing_tables(df, rules, **kwargs)[1])


def validate(df: DataFrame, rules: RuleBook, **kwargs) -> DataFrame:
    """Listing rows to one verdict per product."""
    return verdict(flagged_listings(df, rules, **kwargs), rules)


def audit_verdicts(df: DataFrame, rules: RuleBook, pages: DataFrame | None = None, pos: str = "_pos",
                   predict=None) -> tuple[DataFrame, DataFrame]:
    """Published listings to (repaired rows with advisory columns, verdicts).

    Enrichment and repair look at all rows before they change any, so the rows are written before each.
    """
    rows = stage(first_per_key(df, ["PRODUCT_SET_SID"], [pos]), "first")
    if pages is not None:
        rows = stage(audit.enrich(rows, pages), "enriched")
    category_map = rules.table("category_map") if "category_map" in rules.tables else None
    ready = audit.repair(rows, rules.country, rules.market, category_map)
    ready = stage(ready, "ready")
    checked = run_checks(ready, rules, pos=pos, predict=predict, published=True)
    checked = stage(checked.select(*[c for c in CHECKED if c in checked.columns]), "checked")
    return ready, verdict(expand(checked), rules)


def scored_report(df: DataFrame, rules: RuleBook, predict=None) -> DataFrame:
    return report.quality_report(report.find_issues(df, rules, predict), rules.country)


def weekly_tables(df: DataFrame, country: str, week: str, files: int, generated: str) -> dict[str, DataFrame]:
    rows = analytics.choose_columns(df)
    return {
        "Cover Sheet": analytics.report_metadata(rows, country, week, files, generated),
        "Daily & Weekly Summary": analytics.daily_summary(rows).orderBy("day_no"),
        "Top Rejected Sellers": analytics.seller_stats(rows),
        "Top Rejection Reasons": analytics.value_counts(rows, "flag", "Reason", "Count"),
        "Top Rejected Categories": analytics.top_values(rows, "category", "Category"),
    }
