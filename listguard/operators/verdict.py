"""From flags per product to one verdict per product, and what reviewers change after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listguard.functions import text as tx
from listguard.operators.skew import HOT_ROWS, attach_some, small
from listguard.sources.rules import DEFAULT_REASON, FLAG_ORDER, RuleBook

VERDICT_COLUMNS = ["ProductSetSid", "ParentSKU", "Status", "Reason", "Comment", "FLAG", "SellerName"]

# Flags that also reach every product with the same brand, name and colour key.
SHARED_FLAGS = ["Seller Approve to sell books", "Seller Approved to Sell Perfume",
                "Counterfeit Sneakers", "Seller Not approved to sell Refurb", "Restricted brands"]
SHARED_MASK = sum(1 << (FLAG_ORDER[f] - 1) for f in SHARED_FLAGS)

# reviewer's reason keys and the flags they stand for.
REASON_KEYS = {
    "REJECT_POOR_IMAGE": "Poor images", "REJECT_WRONG_CAT": "Wrong Category",
    "REJECT_FAKE": "Suspected Fake product", "REJECT_BRAND": "Restricted brands",
    "REJECT_PROHIBITED": "Prohibited products", "REJECT_COLOR": "Missing COLOR",
    "REJECT_WRONG_BRAND": "Generic branded products with genuine brands",
    "OTHER_CUSTOM": "Other Reason (Custom)",
}
CUSTOM_FLAG = "Other Reason (Custom)"


def duplicate_key(columns=("NAME", "BRAND", "SELLER_NAME", "COLOR")) -> Column:
    return F.concat_ws("\u0001", *[tx.lower_key(F.col(c)) for c in columns])


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Keys shared by more than one product, with the group size."""
    return (df.groupBy(duplicate_key().alias("dup_key")).agg(F.count("*").alias("n")).where("n > 1"))


def lowest_bit(mask: Column) -> Column:
    """1-based position of the lowest set bit; 65 for an empty mask."""
    return F.bit_count(mask.bitwiseAND(-mask) - 1).cast("int") + 1


def duplicate_mask(df: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``_dm``: flags found on any exact duplicate of the row; null where there are none."""
    if not {"NAME", "BRAND", "SELLER_NAME", "COLOR"} <= set(df.columns):
        return df.withColumn("_dm", F.lit(None).cast("bigint"))
    keyed = df.withColumn("_dk", duplicate_key())
    stats = (keyed.groupBy("_dk").agg(F.count("*").alias("_dn"), F.bit_or("_mask").alias("_dm"))
             .where("_dn > 1 AND _dm <> 0"))
    return attach_some(keyed, stats, ["_dk"], ["PRODUCT_SET_SID"], "_dn", hot_rows).drop("_dk", "_dn")


def shared_mask(df: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``_mm``: shared flags found on any row with the same brand, name and colour key."""
    def text(c):
        return tx.as_text(F.col(c)) if c in df.columns else F.lit("")
    keyed = df.withColumn("_mk", tx.match_key(text("BRAND"), text("NAME"), text("COLOR")))
    shared = F.bit_or(F.col("_mask").bitwiseAND(SHARED_MASK))
    stats = keyed.groupBy("_mk").agg(F.count("*").alias("_mn"), shared.alias("_mm")).where("_mm <> 0")
    return attach_some(keyed, stats, ["_mk"], ["PRODUCT_SET_SID"], "_mn", hot_rows).drop("_mk", "_mn")


def expand(df: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``_final``: own flags, the flags of exact duplicates, shared flags of equal keys.

    Groups travel as one bit mask per key: a hash aggregate with map-side combining, then an
    attach that spreads hot groups.  Groups without any flag are dropped before the attach.
    """
    out = shared_mask(duplicate_mask(df, hot_rows), hot_rows)
    zero = F.lit(0).cast("bigint")
    final = F.col("_mask").bitwiseOR(F.coalesce("_dm", zero)).bitwiseOR(F.coalesce("_mm", zero))
    return out.withColumn("_final", final).drop("_dm", "_mm")


def flags_of(mask: Column) -> Column:
    """Orders of the set bits."""
    return F.filter(F.sequence(F.lit(1), F.lit(len(FLAG_ORDER))), lambda i: F.getbit(mask, i - 1) == 1)


def flag_names() -> Column:
    return F.array(*[F.lit(f) for f in FLAG_ORDER])


def comment_language(country: str) -> str:
    return "comment_fr" if country == "MA" else "comment_en"


def verdict(df: DataFrame, rules: RuleBook, mask: str = "_final") -> DataFrame:
    """One row per product: the first flag in priority order, or Approved."""
    order = lowest_bit(F.col(mask))
    own = F.get(F.filter("_found", lambda x: x.ord == F.col("_ord")), F.lit(0)).getField("detail")
    narrow = df.select(
        F.col("PRODUCT_SET_SID").alias("ProductSetSid"),
        (F.col("PARENTSKU") if "PARENTSKU" in df.columns else F.lit("")).cast("string").alias("ParentSKU"),
        (F.col("SELLER_NAME") if "SELLER_NAME" in df.columns else F.lit("")).cast("string").alias("SellerName"),
        "_found", F.when(F.col(mask) != 0, order).alias("_ord"))
    named = narrow.select("*", own.alias("_detail"), F.get(flag_names(), F.col("_ord") - 1).alias("_flag"))
    texts = rules.flags.select(F.col("flag").alias("_flag"), F.col("reason").alias("_reason"),
                               F.col(comment_language(rules.country)).alias("_comment"))
    joined = named.join(small(texts), "_flag", "left")
    rejected = F.col("_ord").isNotNull()
    base = F.coalesce("_comment", F.concat(F.lit("Flagged by "), F.col("_flag")))
    detail = F.col("_detail")
    comment = F.when(detail.isNotNull() & (detail != ""),
                     F.concat(base, F.lit(" ("), detail, F.lit(")"))).otherwise(base)
    return joined.select(
        "ProductSetSid", "ParentSKU",
        F.when(rejected, F.lit("Rejected")).otherwise("Approved").alias("Status"),
        F.when(rejected, F.coalesce("_reason", F.lit(DEFAULT_REASON))).otherwise("").alias("Reason"),
        F.when(rejected, comment).otherwise("").alias("Comment"),
        F.when(rejected, F.col("_flag")).otherwise("").alias("FLAG"), "SellerName")


def approved(df: DataFrame, rejected_ids: DataFrame) -> DataFrame:
    """Products none of the flags reached."""
    return df.join(rejected_ids.select("PRODUCT_SET_SID"), "PRODUCT_SET_SID", "left_anti")


def without_flag(df: DataFrame, flag: str) -> DataFrame:
    """``_final`` with one flag cleared: the state after approving that flag in bulk."""
    return df.withColumn("_final", F.col("_final").bitwiseAND(~(1 << (FLAG_ORDER[flag] - 1))))


def bulk_approve(df: DataFrame, rules: RuleBook, flag: str, ids: DataFrame | None = None) -> DataFrame:
    """Verdicts after approving ``flag`` for the products it decided (or those in ``ids``).

    A product takes its next flag, or becomes approved by the user.
    """
    decided = lowest_bit(F.col("_final")) == FLAG_ORDER[flag]
    if ids is not None:
        chosen = ids.select("PRODUCT_SET_SID").distinct().withColumn("_chosen", F.lit(True))
        df = df.join(chosen, "PRODUCT_SET_SID", "left")
        decided = decided & F.coalesce("_chosen", F.lit(False))
    after = verdict(without_flag(df.where(decided), flag), rules)
    freed = F.col("Status") == "Approved"
    return after.withColumn("FLAG", F.when(freed, F.lit("Approved by User")).otherwise(F.col("FLAG")))


def bulk_approve_counts(after: DataFrame) -> DataFrame:
    return after.groupBy("FLAG").agg(F.count("*").alias("n"))


def apply_decisions(verdicts: DataFrame, decisions: DataFrame, rules: RuleBook) -> DataFrame:
    """Reviewer decisions over verdicts; the latest per product counts.

    ``decisions``: sid, action (reject or restore), reason_key, comment, ts.
    """
    latest = decisions.groupBy("sid").agg(
        F.max_by(F.struct("action", "reason_key", "comment"), F.struct("ts", "action", "reason_key")).alias("d"))
    key = F.col("d.reason_key")
    flag = F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in REASON_KEYS.items()], F.lit(CUSTOM_FLAG))
    texts = rules.flags.select(F.col("flag").alias("_flag"), F.col("reason").alias("_r"),
                               F.col(comment_language(rules.country)).alias("_c"))
    latest = latest.withColumn("_flag", flag).join(small(texts), "_flag", "left")
    joined = verdicts.join(latest.withColumnRenamed("sid", "ProductSetSid"), "ProductSetSid", "left")
    reject, restore = F.col("d.action") == "reject", F.col("d.action") == "restore"
    changed = {
        "Status": F.when(reject, "Rejected").when(restore, "Approved").otherwise(F.col("Status")),
        "Reason": F.when(reject, F.coalesce("_r", F.lit(DEFAULT_REASON))).when(restore, "")
        .otherwise(F.col("Reason")),
        "Comment": F.when(reject, F.coalesce(F.col("d.comment"), F.col("_c"), F.lit("Manual rejection")))
        .when(restore, "").otherwise(F.col("Comment")),
        "FLAG": F.when(reject, F.col("_flag")).when(restore, "Approved by User").otherwise(F.col("FLAG")),
    }
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in VERDICT_COLUMNS])


def decisions_from_payload(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Review messages ``{"action": ..., "payload": {sid: reason}}`` as decision rows."""
    parsed = F.from_json(column, "action string, payload map<string,string>")
    return (payloads.select("ts", parsed.alias("m")).select("ts", "m.action", F.explode("m.payload")
                                                            .alias("sid", "reason_key"))
            .select("sid", F.when(F.col("action") == "undo", "restore").otherwise(F.col("action")).alias("action"),
                    "reason_key", F.lit(None).cast("string").alias("comment"), "ts"))


def merge_full(listings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Listings with their verdict columns."""
    v = verdicts.select(F.col("ProductSetSid").alias("PRODUCT_SET_SID"), "Status", "Reason", "Comment",
                        F.col("FLAG").alias("_verdict_flag"), "SellerName")
    base = listings.drop("FLAG") if "FLAG" in listings.columns else listings
    return base.join(v, "PRODUCT_SET_SID", "left").withColumnRenamed("_verdict_flag", "FLAG")


def audit_export(listings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Audit rows with FINAL_FLAG and FLAG_REASON, internal columns dropped."""
    v = verdicts.select(F.col("ProductSetSid").alias("PRODUCT_SET_SID"), F.col("Status").alias("_s"),
                        F.col("FLAG").alias("_f"), F.col("Comment").alias("_c"))
    public = [c for c in listings.columns if not c.startswith("_")]
    ok = F.coalesce("_s", F.lit("Approved")) == "Approved"
    return listings.join(v, "PRODUCT_SET_SID", "left").select(
        *public, F.when(ok, F.lit("ok")).otherwise(F.col("_f")).alias("FINAL_FLAG"),
        F.when(ok, F.lit("ok")).otherwise(F.col("_c")).alias("FLAG_REASON"))
