"""Reconciling reported facts: contexts with more than one value, repeated facts, the best fact of a concept, a wide
row for each filing, its ratios, and year-over-year changes.

A context is a filing, tag, taxonomy version, date, number of quarters, unit, segment and co-registrant. Values stay exact
decimals until conflicts are settled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import numeric as N
from tidemark.functions.normalize import form_key
from tidemark.operators.temporal import first_by

CONTEXT = ("adsh", "tag", "taxonomy_version", "fact_date", "quarters", "unit", "segments", "coreg")

# fixed values: the tags of each concept, in the order in which they are preferred
CONCEPTS: Mapping[str, Sequence[str]] = {
    "assets": ("Assets",),
    "liabilities": ("Liabilities", "LiabilitiesAndStockholdersEquity"),
    "revenues": ("Revenues", "SalesRevenueNet", "RevenueFromContractWithCustomerExcludingAssessedTax"),
    "net_income": ("NetIncomeLoss", "ProfitLoss"),
    "current_assets": ("AssetsCurrent",),
    "current_liabilities": ("LiabilitiesCurrent",),
    "cash": ("CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents"),
    "receivables": ("AccountsReceivableNetCurrent", "ReceivablesNetCurrent"),
    "inventory": ("InventoryNet", "InventoryFinishedGoodsNetOfReserves"),
    "debt": ("LongTermDebtAndFinanceLeaseObligations", "LongTermDebt"),
    "debt_current": ("ShortTermBorrowings", "LongTermDebtCurrent"),
    "operating_cash_flow": ("NetCashProvidedByUsedInOperatingActivities",),
    "working_capital": ("WorkingCapital",),
}
RATIOS = {
    "leverage": ("liabilities", "assets"), "profitability": ("net_income", "assets"), "working_capital_to_assets": ("working_capital", "assets"),
    "receivables_to_revenue": ("receivables", "revenues"), "inventory_to_assets": ("inventory", "assets"), "cash_to_assets": ("cash", "assets"),
    "debt_to_assets": ("debt", "assets"), "operating_cash_flow_to_assets": ("operating_cash_flow", "assets"),
}


def exact(c: str):
    """A value as DECIMAL(28,4); null out of range."""
    return F.col(c).try_cast("decimal(28,4)")


def tag_map(spark: SparkSession, concepts: Mapping[str, Sequence[str]] = CONCEPTS) -> DataFrame:
    rows = [(c, t.lower(), k) for c, tags in concepts.items() for k, t in enumerate(tags)]
    return spark.createDataFrame(rows, "concept string, tag_key string, tag_priority int")


def marked(facts: DataFrame, context: Sequence[str] = CONTEXT) -> DataFrame:
    """facts with the least and largest value of their context (W3); unknown parts of a context are equal."""
    w = Window.partitionBy(*context)
    return facts.withColumn("context_minimum", F.min("value").over(w)).withColumn("context_maximum", F.max("value").over(w))


def settled(facts: DataFrame, context: Sequence[str] = CONTEXT) -> DataFrame:
    """One fact of each context whose facts agree; contexts with more values are left out as a whole."""
    m = marked(facts.filter("value is not null"), context).filter("context_minimum = context_maximum")
    return first_by(m, [*context, "value"], [F.col("value_text").asc_nulls_last()]).drop("context_minimum", "context_maximum")


def best(facts: DataFrame, tags: DataFrame) -> DataFrame:
    """The preferred fact of each filing and concept: unsegmented, in dollars or no unit."""
    f = facts.filter("(unit is null or unit = 'USD') and segments is null and coreg is null").withColumn("tag_key", F.lower("tag"))
    f = f.join(F.broadcast(tags), "tag_key").withColumn("unit_priority", F.when(F.col("unit") == "USD", 0).otherwise(1))
    down = lambda c: F.col(c).desc_nulls_last()
    order = [F.col("tag_priority").asc(), down("quarters"), down("fact_date"), F.col("unit_priority").asc(), down("taxonomy_version"), F.col("tag_key").asc(), F.col("tag").asc(), F.col("value_text").asc_nulls_last()]
    return first_by(f, ["adsh", "concept"], order)


def features(facts: DataFrame, concepts: Mapping[str, Sequence[str]] = CONCEPTS) -> DataFrame:
    """A row for each filing: values, coverage flags and ratios."""
    tags = tag_map(facts.sparkSession, concepts)
    wanted = facts.filter(F.lower("tag").isin([t.lower() for x in concepts.values() for t in x]))
    wide = best(settled(wanted), tags).groupBy(F.col("adsh").alias("accession")).agg(*(F.max(F.when(F.col("concept") == c, F.col("value").cast("double"))).alias(f"xbrl_value_{c}") for c in concepts))
    v = lambda c: F.col(f"xbrl_value_{c}")
    wide = wide.withColumn("xbrl_value_working_capital", F.coalesce(v("working_capital"), v("current_assets") - v("current_liabilities")))
    wide = wide.withColumn("xbrl_value_debt", N.first_known_sum(v("debt"), v("debt_current")))
    return wide.select(
        "*", *(v(c).isNotNull().cast("int").alias(f"xbrl_coverage_{c}") for c in concepts), N.log_size(v("assets")).alias("xbrl_ratio_log_assets"),
        *(N.ratio(v(a), v(b)).alias(f"xbrl_ratio_{n}") for n, (a, b) in RATIOS.items()),
    )


def annual_order(form: str = "form", origin: str = "origin_date", accepted: str = "acceptance_datetime", accession: str = "accession"):
    """The order in which an issuer's filings of a year are preferred."""
    f = form_key(form)
    return [F.when(f == "10-K", 0).when(f == "10-K/A", 1).otherwise(99), F.col(origin).asc_nulls_last(), F.col(accepted).asc_nulls_last(), f.asc(), F.col(accession).asc()]


def annual_pick(filings: DataFrame) -> DataFrame:
    """One annual filing of each issuer and fiscal year."""
    return first_by(filings.filter(form_key("form").isin("10-K", "10-K/A") & F.col("issuer_cik").isNotNull() & F.col("fiscal_year").isNotNull()), ["issuer_cik", "fiscal_year"], annual_order())


def year_over_year(filings: DataFrame, values: Mapping[str, str]) -> DataFrame:
    """filings with the change of each value since the annual filing of the year before: short name -> column.
    Only annual filings get one, and only if that year's is there."""
    w = Window.partitionBy("issuer_cik").orderBy("fiscal_year")
    ref = annual_pick(filings)
    before = ref.select("issuer_cik", "fiscal_year", F.lag("fiscal_year").over(w).alias("_year"), *(F.lag(c).over(w).alias(f"_lag_{n}") for n, c in values.items()))
    before = before.select("issuer_cik", "fiscal_year", *(F.when(F.col("_year") == F.col("fiscal_year") - 1, F.col(f"_lag_{n}")).alias(f"_prev_{n}") for n in values))
    out, annual = filings.join(before, ["issuer_cik", "fiscal_year"], "left"), form_key("form").isin("10-K", "10-K/A")
    for n, c in values.items():
        prev = F.col(f"_prev_{n}")
        out = out.withColumn(f"xbrl_ratio_{n}_yoy_change", F.when(annual, N.change(c, prev)))
        out = out.withColumn(f"xbrl_coverage_{n}_yoy", (annual & F.col(c).isNotNull() & F.coalesce(prev != 0, F.lit(False))).cast("int"))
    return out.drop(*(f"_prev_{n}" for n in values))


def summary(facts: DataFrame) -> DataFrame:
    """Distinct facts, tags and units of each filing."""
    return facts.distinct().groupBy("adsh").agg(F.count("*").alias("xbrl_fact_count"), F.countDistinct("tag").alias("xbrl_unique_tags"), F.countDistinct("unit").alias("xbrl_unique_units"))
