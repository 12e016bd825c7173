"""The two panels: all filings with windowed features, and one annual row of each issuer and year with features and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import numeric as N
from tidemark.functions.normalize import blank_to_null, form_key
from tidemark.operators.audit import assert_known, assert_not_negative, assert_unique
from tidemark.operators.facts import annual_order, year_over_year
from tidemark.operators.temporal import asof_join, exists_ahead, first_by, window_counts, with_history
from tidemark.sources.sinks import kept

PERIOD_FORMS = ("10-K", "10-K/A", "10-Q", "10-Q/A", "20-F", "40-F")
ANNUAL_FORMS, FOREIGN_FORMS = ("10-K", "10-K/A"), ("20-F", "40-F", "6-K")
HISTORY_ITEMS = ("3.01", "4.01", "4.02", "5.02")
LATE = ("NT 10-K", "NT 10-Q")


def filing_base(filings: DataFrame, periods: DataFrame, as_of: str) -> DataFrame:
    """filings with fiscal period, its source, year, origin date and what was public by then."""
    periods = periods.select(blank_to_null("accession").alias("_a"), F.col("fsds_fiscal_period_end"))
    f = filings.join(assert_unique(periods, ["_a"]), blank_to_null("accession") == F.col("_a"), "left").drop("_a")
    has = form_key("form").isin(*PERIOD_FORMS)
    d, year = F.col("filing_date"), F.year("filing_date")
    flag = lambda c: F.when(c, 1).otherwise(0)
    on = lambda s: F.lit(s).cast("timestamp_ntz")
    f = f.withColumn("fiscal_period_end", F.when(has, F.coalesce("report_date", "fsds_fiscal_period_end")))
    source = F.when(~has, "not_applicable").when(F.col("report_date").isNotNull(), "submissions_report_date").when(F.col("fsds_fiscal_period_end").isNotNull(), "fsds_period").otherwise("unresolved")
    return f.withColumns({
        "fiscal_period_end_source": source, "fiscal_year": F.year("fiscal_period_end"), "origin_date": d, "as_of_date": on(as_of),
        "source_available_xbrl": flag(year >= 2011), "source_available_notes": flag(d >= on("2020-11-01")), "source_available_form_ap": flag(d >= on("2017-01-31")),
        "source_available_pcaob_inspections": flag(year >= 2018), "source_available_insider": flag(year >= 2006), "source_available_13f": flag(d >= on("2013-07-01")),
        "source_available_edgar_logs": flag((year >= 2003) & ~d.between(on("2017-07-01"), on("2020-05-18"))), "source_available_market_structure": flag(year >= 2012),
        "public_date_form_ap": on("2017-01-31"), "public_date_notes": on("2020-11-01"), "vintage_xbrl_main_sample": F.lit("2011+"),
    }).drop("fsds_fiscal_period_end")


def windowed(base: DataFrame) -> DataFrame:
    """Days since, and number of, an issuer's filings before; over all its filings, so before any filter."""
    return with_history(base, "issuer_cik", "origin_date", "accession").withColumnsRenamed({"days_since_previous": "days_since_previous_filing", "prior_count": "prior_filing_count"})


def late_notices(filings: DataFrame, every: DataFrame) -> DataFrame:
    """Whether a filing is a late notice, whether one for its period came before, and the days since."""
    w = every.filter(F.col("form").isin(*LATE)).select("issuer_cik", "report_date", F.col("origin_date").alias("notice_date"))
    out = asof_join(filings, w, ["issuer_cik", "report_date"], "origin_date", "notice_date", ["notice_date"], strict=False)
    return out.withColumns({
        "filing_friction_is_nt": F.when(F.col("form").startswith("NT "), 1).otherwise(0), "filing_friction_nt_pre_origin": F.when(F.col("notice_date").isNotNull(), 1).otherwise(0),
        "filing_friction_nt_delay_days": D.day_diff("origin_date", "notice_date"),
    }).drop("notice_date")


def history(filings: DataFrame, threads: DataFrame, corrections: DataFrame, items: DataFrame) -> DataFrame:
    """Twelve look-back counts: six kinds of events, one and three years (Q9, J9). One pass over all kinds."""
    one = lambda df, ts, kind: df.select("issuer_cik", F.col(ts).alias("event_date"), kind.alias("kind"))
    events = one(threads, "first_submission_date", F.lit("comment_thread")).unionByName(one(corrections.filter("correction_type = 'amendment_10x_a'"), "public_date", F.lit("amendment")))
    events = events.unionByName(one(items.filter(F.col("item_code").isin(*HISTORY_ITEMS)), "public_date", F.concat(F.lit("8k_"), F.translate("item_code", ".", ""))))
    kinds = ["comment_thread", "amendment", *("8k_" + c.replace(".", "") for c in HISTORY_ITEMS)]
    spans = {"1y": D.YEAR_DAYS, "3y": D.THREE_YEARS_DAYS}
    return window_counts(filings, events, "issuer_cik", "origin_date", "event_date", {f"public_history_{k}_{s}_count": (n, F.col("kind") == k) for k in kinds for s, n in spans.items()})


def labels(filings: DataFrame, threads: DataFrame, corrections: DataFrame, items: DataFrame, horizon: int = D.YEAR_DAYS) -> DataFrame:
    """Look-ahead labels. That of item 4.02 is unknown if only reports without item data follow."""
    one = lambda df, ts, kind: df.select("issuer_cik", F.col(ts).alias("event_date"), F.lit(kind).alias("kind"))
    events = one(threads, "first_submission_date", "thread").unionByName(one(corrections.filter("correction_type = 'amendment_10x_a'"), "public_date", "amendment"))
    events = events.unionByName(one(items.filter("item_code = '4.02'"), "public_date", "k402")).unionByName(one(items.filter("item_metadata_missing = 1"), "public_date", "unknown"))
    out = exists_ahead(filings, events, "issuer_cik", "origin_date", "event_date", {f"_{k}": (horizon, F.col("kind") == k) for k in ("thread", "amendment", "k402", "unknown")})
    return out.withColumns({
        "label_comment_thread_365": F.col("_thread"), "label_amendment_365": F.col("_amendment"), "label_8k_402_365": F.when(F.col("_k402") == 1, 1).when(F.col("_unknown") == 1, None).otherwise(0),
        "k402_item_metadata_unknown_365": F.when(F.col("_k402") == 1, 0).otherwise(F.col("_unknown")), "censored_365": D.censored("origin_date", F.col("as_of_date"), horizon),
    }).drop("_thread", "_amendment", "_k402", "_unknown")


def form_ap_summary(filings: DataFrame, form_ap: DataFrame) -> DataFrame:
    """Audit reports of a filing's issuer and fiscal year that were public before it."""
    e = form_ap.select(F.col("issuer_cik"), F.year("fiscal_period_end").alias("fiscal_year"), F.col("filing_date").alias("_d"), "form_filing_id", "engagement_partner_id", F.col("number_of_participants").cast("double").alias("_p"))
    j = filings.select("accession", "issuer_cik", "fiscal_year", "origin_date").join(e, ["issuer_cik", "fiscal_year"]).filter("_d < origin_date")
    return j.groupBy("accession", "issuer_cik").agg(F.countDistinct("form_filing_id").alias("form_ap_filing_count"), F.countDistinct("engagement_partner_id").alias("form_ap_unique_partners"), F.avg("_p").alias("form_ap_avg_participants"))


def partner_priors(filings: DataFrame, engaged: DataFrame, by_partner: DataFrame, by_issuer: DataFrame) -> DataFrame:
    """What the engaged partner met at other issuers before a filing: all minus the same issuer's."""
    f = asof_join(filings.select("issuer_cik", "accession", "origin_date"), engaged, ["issuer_cik"], "origin_date", "form_ap_public_date", ["engagement_partner_id"], ties=["engagement_partner_id"])
    kinds = ("8k_402", "nonadmin_amendment", "total")
    f = asof_join(f, by_partner, ["engagement_partner_id"], "origin_date", "event_date", [f"partner_prior_{k}_count" for k in kinds])
    f = asof_join(f, by_issuer, ["engagement_partner_id", "issuer_cik"], "origin_date", "event_date", [f"partner_issuer_prior_{k}_count" for k in kinds])
    raw = {k: F.coalesce(f"partner_prior_{k}_count", F.lit(0)) - F.coalesce(f"partner_issuer_prior_{k}_count", F.lit(0)) for k in kinds}
    return f.select("issuer_cik", "accession", "engagement_partner_id", *(c.alias(f"raw_other_issuer_{k}_count") for k, c in raw.items()), *(N.at_least_zero(c).alias(f"auditor_partner_prior_other_issuer_{k}_count") for k, c in raw.items()))


def foreign_years(filings: DataFrame) -> DataFrame:
    """Issuers and years with a foreign form."""
    return filings.filter(form_key("form").isin(*FOREIGN_FORMS)).select("issuer_cik", F.coalesce("fiscal_year", F.year("report_date")).alias("fpi_year")).filter("fpi_year is not null").distinct()


def issuer_panel(filings: DataFrame, every: DataFrame, issuers: DataFrame) -> DataFrame:
    """One annual filing of each issuer and year, with foreign-form flags and issuer attributes."""
    annual = filings.filter(form_key("form").isin(*ANNUAL_FORMS) & F.col("issuer_cik").isNotNull() & F.col("fiscal_year").isNotNull() & F.col("origin_date").isNotNull())
    first = first_by(annual, ["issuer_cik", "fiscal_year"], annual_order())
    foreign = foreign_years(every).select("issuer_cik", F.col("fpi_year").alias("fiscal_year"), F.lit(1).alias("issuer_has_fpi_form_year"))
    out = first.join(foreign, ["issuer_cik", "fiscal_year"], "left").withColumn("issuer_has_fpi_form_year", F.coalesce("issuer_has_fpi_form_year", F.lit(0)))
    return out.withColumn("is_domestic_us_gaap_proxy", 1 - F.col("issuer_has_fpi_form_year")).join(issuers, "issuer_cik", "left")


def build(filings: DataFrame, periods: DataFrame, threads: DataFrame, corrections: DataFrame, items: DataFrame, issuers: DataFrame, as_of: str, form_ap: DataFrame | None = None, engaged: DataFrame | None = None, histories: tuple[DataFrame, DataFrame] | None = None, features: DataFrame | None = None, notes: DataFrame | None = None, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """The panel of all filings and the panel of issuers and years (Q8). Optional tables add their features."""
    every = kept(windowed(filing_base(filings, periods, as_of)), "filings")
    threads, corrections, items = kept(threads, "threads"), kept(corrections, "corrections"), kept(items, "items")
    f = every.filter(form_key("form").isin(*ANNUAL_FORMS))
    if form_ap is not None:
        f = f.join(form_ap_summary(f, form_ap), ["accession", "issuer_cik"], "left")
    if engaged is not None and histories is not None:
        priors = partner_priors(f, engaged, *histories).drop("engagement_partner_id")
        if check:
            assert_unique(priors, ["issuer_cik", "accession"])
            assert_not_negative(priors, [c for c in priors.columns if c.startswith("raw_")])
        priors = priors.drop(*(c for c in priors.columns if c.startswith("raw_"))).withColumnsRenamed({"issuer_cik": "_i", "accession": "_a"})
        f = f.join(priors, F.col("issuer_cik").eqNullSafe(F.col("_i")) & F.col("accession").eqNullSafe(F.col("_a")), "left").drop("_i", "_a")
    f = kept(history(kept(late_notices(f, every), "notices"), threads, corrections, items), "history")
    if features is not None:
        f = f.join(features, "accession", "left")
        f = year_over_year(f, {"revenues": "xbrl_value_revenues", "assets": "xbrl_value_assets"})
    if notes is not None:
        f = f.join(notes, "accession", "left")
    panel = kept(issuer_panel(kept(labels(f, threads, corrections, items), "labels"), every, issuers), "panel")
    if check:
        assert_unique(assert_known(panel, ["issuer_cik", "fiscal_year", "origin_date"]), ["issuer_cik", "fiscal_year"])
    return every, panel
