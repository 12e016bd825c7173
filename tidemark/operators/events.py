"""Event tables derived from filings: comment threads, item events, amendments, corrections, partner histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import normalize as T
from tidemark.operators.temporal import asof_join, cumulative, first_by, sessions

THREAD_GAP_DAYS = 120
TARGET_ITEMS = ("3.01", "4.01", "4.02", "5.02")
AMENDED = ("10-K/A", "10-Q/A")


def comment_threads(filings: DataFrame, gap_days: int = THREAD_GAP_DAYS) -> DataFrame:
    """Letters and answers of an issuer, a new thread after a longer gap."""
    s = sessions(filings.filter(F.col("form").isin("UPLOAD", "CORRESP")), "issuer_cik", "filing_date", gap_days, ["accession"])
    return s.groupBy("issuer_cik", F.concat_ws("-", "issuer_cik", F.col("session_seq").cast("string")).alias("thread_id")).agg(
        F.min("filing_date").alias("first_submission_date"), F.max("filing_date").alias("last_submission_date"),
        F.count_if(F.col("form") == "UPLOAD").alias("upload_count"), F.count_if(F.col("form") == "CORRESP").alias("corresp_count"), F.countDistinct("accession").alias("filing_count"),
    )


def item_events(filings: DataFrame, items: tuple[str, ...] = TARGET_ITEMS) -> DataFrame:
    """A row for each wanted item of a current report, and one for each report without item data."""
    f = filings.filter("form = '8-K'").withColumn("missing", T.items_missing("items"))
    named = f.filter("not missing").withColumn("item_code", F.explode(T.item_codes("items"))).filter(F.col("item_code").isin(*items))
    named = named.withColumn("event_type", F.concat(F.lit("8k_item_"), F.translate("item_code", ".", "_")))
    bare = f.filter("missing").withColumn("item_code", F.lit(None).cast("string")).withColumn("event_type", F.lit("item_metadata_missing"))
    both = named.unionByName(bare).select("issuer_cik", "accession", T.accession_plain("accession").alias("accession_nodash"), F.col("filing_date").alias("public_date"), "report_date", "item_code", "event_type", F.col("missing").cast("int").alias("item_metadata_missing"), F.lit("items_metadata").alias("identified_from"))
    return first_by(both, ["issuer_cik", "accession", "item_code", "event_type"], [F.col("public_date").asc_nulls_last(), F.col("report_date").asc_nulls_last()])


def amendment_class(description: Column, note: Column) -> dict[str, Column]:
    """The flags, class and reason of an amendment: financial words in its note outweigh an administrative description."""
    money = F.coalesce(note.rlike(T.FINANCIAL_WORDS), F.lit(False))
    admin = F.coalesce(description.rlike(T.ADMIN_WORDS), F.lit(False))
    absent = F.coalesce(note == "", F.lit(True))
    return {
        "admin_candidate_part_iii": admin.cast("int"), "financial_override": money.cast("int"), "mixed_content": (money & admin).cast("int"),
        "amendment_annotation": F.when(money, "non_admin_financial_correction").when(admin, "admin_part_iii_proxy").otherwise("broad_amendment_unclassified"),
        "annotation_reason": F.when(money & admin, "mixed_content_classified_as_nonadmin").when(money, "explanatory_note_financial_keyword").when(admin, "admin_candidate_metadata").when(absent, "explanatory_note_missing").otherwise("no_financial_keyword"),
        "explanatory_note_missing": absent.cast("int"), "explanatory_note_char_count": F.coalesce(F.length(note), F.lit(0)),
    }


def amendments(filings: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Amended reports, classed by their description and explanatory note (Q3). texts: accession, document_text."""
    f = filings.filter(F.col("form").isin(*AMENDED))
    f = f.join(texts.select("accession", "document_text"), "accession", "left") if texts is not None else f.withColumn("document_text", F.lit(None).cast("string"))
    f = f.withColumn("note", T.note_window(T.plain_text(F.coalesce("document_text", F.lit("")))))
    return f.select("issuer_cik", "accession", T.accession_plain("accession").alias("accession_nodash"), F.col("filing_date").alias("public_date"), "report_date", "form", "primary_document", *(c.alias(n) for n, c in amendment_class(F.coalesce("primary_doc_description", F.lit("")), F.col("note")).items()))


def corrections(filings: DataFrame) -> DataFrame:
    """Amendments, non-reliance reports, and revisions that a filing names itself."""
    base = lambda kind, by: [F.col("issuer_cik"), F.col("accession"), F.col("filing_date").alias("public_date"), F.col("report_date"), F.lit(kind).alias("correction_type"), F.lit(by).alias("identified_from")]
    says = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))).contains("revision")
    amended = filings.filter(F.col("form").isin(*AMENDED)).select(*base("amendment_10x_a", "form"))
    unreliable = filings.filter((F.col("form") == "8-K") & F.array_contains(T.item_codes("items"), "4.02")).select(*base("nonreliance_8k_402", "items_metadata"))
    revised = filings.filter(F.col("form").isin("10-K", "10-Q", *AMENDED) & (says("primary_doc_description") | says("items"))).select(*base("revision_if_identifiable", "revision_keyword"))
    return first_by(amended.unionByName(unreliable).unionByName(revised), ["issuer_cik", "accession", "correction_type"], [F.col("public_date").asc_nulls_last(), F.col("report_date").asc_nulls_last()])


def engagements(form_ap: DataFrame) -> DataFrame:
    """Distinct audit engagements with a known issuer, date and partner."""
    e = form_ap.withColumn("engagement_partner_id", T.blank_to_null("engagement_partner_id")).filter("issuer_cik is not null and filing_date is not null and engagement_partner_id is not null")
    return e.select("issuer_cik", "fiscal_period_end", F.col("filing_date").alias("form_ap_public_date"), "form_filing_id", "engagement_partner_id").distinct()


def risk_events(items: DataFrame, annotations: DataFrame) -> DataFrame:
    a = items.filter("item_code = '4.02'").select("issuer_cik", F.col("public_date").alias("event_date"), F.lit("8k_402").alias("risk_type"))
    b = annotations.filter("amendment_annotation = 'non_admin_financial_correction'").select("issuer_cik", F.col("public_date").alias("event_date"), F.lit("nonadmin_amendment").alias("risk_type"))
    return a.unionByName(b).filter("issuer_cik is not null and event_date is not null")


def partner_histories(engaged: DataFrame, risks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Running counts of risk events by partner, and by partner and issuer; an event belongs to the partner engaged
    last before it, of partners of one day to the least id (Q5, J6, A10, W9)."""
    matched = asof_join(risks, engaged, ["issuer_cik"], "event_date", "form_ap_public_date", ["engagement_partner_id"], ties=["engagement_partner_id"]).filter("engagement_partner_id is not null")

    def history(by: list[str], name: str) -> DataFrame:
        kind = lambda k: F.count_if(F.col("risk_type") == k)
        day = matched.groupBy(*by, "event_date").agg(kind("8k_402").alias("_a"), kind("nonadmin_amendment").alias("_b"))
        run = cumulative(day, by, "event_date", {f"{name}_8k_402_count": "_a", f"{name}_nonadmin_amendment_count": "_b"})
        return run.withColumn(f"{name}_total_count", F.col(f"{name}_8k_402_count") + F.col(f"{name}_nonadmin_amendment_count")).drop("_a", "_b")

    return history(["engagement_partner_id"], "partner_prior"), history(["engagement_partner_id", "issuer_cik"], "partner_issuer_prior")
