"""Projections, filters and scalar functions (P, F, D, M of the inventory), each as a query with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import normalize as T
from tidemark.functions import numeric as N
from tidemark.operators import events as E
from tidemark.operators import panel as P
from tidemark.operators.audit import profile
from tidemark.operators.panel import PERIOD_FORMS
from tidemark.operators.temporal import exists_ahead, window_counts
from tidemark.plans.lake import AS_OF, duck, query, read, view

# texts made from customer keys, with the shapes that identifiers come in
RAW_ID = "CASE c_custkey % 8 WHEN 0 THEN concat('CIK', CAST(c_custkey AS {s})) WHEN 1 THEN concat(CAST(c_custkey AS {s}), '.0') WHEN 2 THEN concat(' ', CAST(c_custkey AS {s}), ' ') WHEN 3 THEN 'nan' WHEN 4 THEN '0' WHEN 5 THEN 'none' WHEN 6 THEN CAST(NULL AS {s}) ELSE concat('00', CAST(c_custkey AS {s})) END"


def raw_ids(spark, sf):
    return read(spark, sf, "customer").selectExpr("c_custkey", "c_name", "c_mktsegment", "c_acctbal", f"{RAW_ID.format(s='STRING')} AS raw")


RAW_SQL = f"ids AS (SELECT c_custkey, c_name, c_mktsegment, c_acctbal, {RAW_ID.format(s='VARCHAR')} AS raw FROM customer)"


@query("P1_rename", "SELECT o_orderkey AS accession_key, o_custkey AS issuer_key, o_orderstatus AS form FROM orders")
def p1(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").withColumnsRenamed({"o_orderkey": "accession_key", "o_custkey": "issuer_key", "o_orderstatus": "form"})


@query("P2_all_but", "SELECT * EXCLUDE (o_totalprice, o_orderpriority) FROM orders")
def p2(spark, sf):
    return read(spark, sf, "orders").drop("o_totalprice", "o_orderpriority")


@query("P3_typed_columns", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_name FROM customer")
def p3(spark, sf):
    df, kinds = read(spark, sf, "customer"), {"c_custkey": "string", "c_nationkey": "long", "c_acctbal": "double", "c_name": "string"}
    return df.select(*(df[c].cast(kinds[c]) for c in df.columns if c in kinds))


@query("P4_form_sets", f"WITH {duck('filing')} SELECT accession, upper(trim(coalesce(form, ''))) AS form_key FROM filing WHERE upper(trim(coalesce(form, ''))) IN ({', '.join(repr(f) for f in PERIOD_FORMS)})")
def p4(spark, sf):
    return view(spark, sf, "filing").filter(T.form_key("form").isin(*PERIOD_FORMS)).select("accession", T.form_key("form").alias("form_key"))


@query("P5_exact_forms", f"WITH {duck('filing')} SELECT form, count(*) AS n FROM filing WHERE form IN ('UPLOAD', 'CORRESP', '8-K', '10-K/A', '10-Q/A') GROUP BY form")
def p5(spark, sf):
    return view(spark, sf, "filing").filter(F.col("form").isin("UPLOAD", "CORRESP", "8-K", "10-K/A", "10-Q/A")).groupBy("form").agg(F.count("*").alias("n"))


@query("P6_prefix", f"WITH {duck('filing')} SELECT accession, CASE WHEN form LIKE 'NT %' THEN 1 ELSE 0 END AS is_late FROM filing")
def p6(spark, sf):
    return view(spark, sf, "filing").select("accession", F.when(F.col("form").startswith("NT "), 1).otherwise(0).alias("is_late"))


@query("P7_revision_word", f"WITH {duck('filing')} SELECT accession FROM filing WHERE form IN ('10-K', '10-Q', '10-K/A', '10-Q/A') AND (contains(lower(coalesce(primary_doc_description, '')), 'revision') OR contains(lower(coalesce(items, '')), 'revision'))")
def p7(spark, sf):
    return E.corrections(view(spark, sf, "filing")).filter("correction_type = 'revision_if_identifiable'").select("accession")


#: filings of the lake, moved to the years in which sources begin
_LATER = "later AS (SELECT * REPLACE (filing_date + INTERVAL 19 YEAR AS filing_date) FROM filing)"


def later(spark, sf):
    f = view(spark, sf, "filing")
    return P.filing_base(f.withColumn("filing_date", F.col("filing_date") + F.expr("INTERVAL 19 YEAR")), view(spark, sf, "period"), AS_OF)


@query("P8_availability_flags", f"WITH {duck('filing')}, {_LATER} SELECT accession, CAST(year(filing_date) >= 2018 AS INTEGER) AS inspections, CAST(filing_date >= TIMESTAMP '2020-11-01' AS INTEGER) AS notes, CAST(filing_date >= TIMESTAMP '2017-01-31' AS INTEGER) AS form_ap, CAST(year(filing_date) >= 2003 AND NOT filing_date BETWEEN TIMESTAMP '2017-07-01' AND TIMESTAMP '2020-05-18' AS INTEGER) AS logs FROM later")
def p8(spark, sf):
    names = {"inspections": "pcaob_inspections", "notes": "notes", "form_ap": "form_ap", "logs": "edgar_logs"}
    return later(spark, sf).select("accession", *(F.col(f"source_available_{c}").alias(n) for n, c in names.items()))


@query("P9_constants", "SELECT o_orderkey, TIMESTAMP '2017-01-31' AS public_date, '2011+' AS vintage FROM orders")
def p9(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", F.lit("2017-01-31").cast("timestamp_ntz").alias("public_date"), F.lit("2011+").alias("vintage"))


@query("P10_priority_case", f"WITH {duck('filing', 'period')} SELECT f.accession, CASE WHEN upper(trim(form)) NOT IN ({', '.join(repr(f) for f in PERIOD_FORMS)}) THEN 'not_applicable' WHEN report_date IS NOT NULL THEN 'submissions_report_date' WHEN fsds_fiscal_period_end IS NOT NULL THEN 'fsds_period' ELSE 'unresolved' END AS source FROM filing f LEFT JOIN period USING (accession)")
def p10(spark, sf):
    return later(spark, sf).select("accession", F.col("fiscal_period_end_source").alias("source"))


def main_sample(df, year: str, first: int, last: int, flag: str | None = None):
    """Years first to last, and only flagged rows if the flag's column is there."""
    df = df.filter(F.col(year).between(first, last))
    return df.filter(F.col(flag) == 1) if flag and flag in df.columns else df


@query("P11_main_sample", "SELECT o_orderkey, year(o_orderdate) AS y FROM orders WHERE year(o_orderdate) BETWEEN 1994 AND 1996 AND o_orderstatus = 'F'")
def p11(spark, sf):
    df = read(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), (F.col("o_orderstatus") == "F").cast("int").alias("keep"))
    return main_sample(main_sample(df, "y", 1994, 1996, "keep"), "y", 1994, 1996, "absent").drop("keep")


@query("P12_task_exclusion", "SELECT count(*) FILTER (doc_id % 7 = 0 OR quality IS NULL) AS excluded, count(*) FILTER (NOT (doc_id % 7 = 0 OR quality IS NULL)) AS kept FROM documents LEFT JOIN labels USING (doc_id)")
def p12(spark, sf):
    df = read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels"), "doc_id", "left")
    out = (F.col("doc_id") % 7 == 0) | F.col("quality").isNull()
    return df.agg(F.count_if(out).alias("excluded"), F.count_if(~out).alias("kept"))


@query("P13_null_safe_filter", "SELECT a.doc_id, a.quality FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE quality END AS quality FROM labels) a WHERE a.quality IS NOT DISTINCT FROM NULL OR a.quality IS NOT DISTINCT FROM 1")
def p13(spark, sf):
    df = read(spark, sf, "labels").select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("quality")).alias("quality"))
    return df.filter(F.col("quality").eqNullSafe(F.lit(None)) | F.col("quality").eqNullSafe(F.lit(1)))


@query("P14_window_edges", "SELECT count(*) FILTER (EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderdate > a.o_orderdate AND b.o_orderdate <= a.o_orderdate + INTERVAL 365 DAY)) AS ahead, CAST(sum((SELECT count(*) FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderdate >= a.o_orderdate - INTERVAL 365 DAY AND b.o_orderdate < a.o_orderdate)) AS BIGINT) AS before FROM orders a")
def p14(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    n = window_counts(o, o, "o_custkey", "o_orderdate", "o_orderdate", {"before": (365, None)})
    n = exists_ahead(n, o, "o_custkey", "o_orderdate", "o_orderdate", {"ahead": (365, None)})
    return n.agg(F.sum("ahead").cast("long").alias("ahead"), F.sum("before").alias("before"))


@query("P15_finite_clip", "SELECT c_custkey, CASE WHEN c_custkey % 4 IN (0, 1) OR c_custkey % 8 = 2 THEN NULL ELSE greatest(least(c_acctbal * 1e10, 1e12), -1e12) END AS x FROM customer")
def p15(spark, sf):
    raw = F.when(F.col("c_custkey") % 4 == 0, F.lit(float("inf"))).when(F.col("c_custkey") % 4 == 1, F.lit(float("nan"))).when(F.col("c_custkey") % 8 != 2, F.col("c_acctbal") * 1e10)
    return read(spark, sf, "customer").select("c_custkey", N.finite(raw).alias("x"))


@query("P16_usable_columns", "SELECT * FROM (VALUES ('quality', true), ('toxic', true), ('constant', false), ('missing', false)) t(column_name, varies)")
def p16(spark, sf):
    df = read(spark, sf, "labels").select("quality", "toxic", F.lit(1).alias("constant"), F.lit(None).cast("int").alias("missing"))
    return profile(df, df.columns).select("column_name", "varies")


_DIGITS = "regexp_replace(raw, '[^0-9]', '', 'g')"
_NUMBER = f"coalesce(try_cast(trunc(try_cast(CASE WHEN lower(trim(raw)) NOT IN ('nan', 'none') THEN trim(raw) END AS DOUBLE)) AS BIGINT), try_cast(CASE WHEN lower(trim(raw)) NOT IN ('nan', 'none') THEN {_DIGITS} END AS BIGINT))"


@query("F1_cik_digits", f"WITH {RAW_SQL} SELECT c_custkey, CASE WHEN try_cast({_DIGITS} AS BIGINT) > 0 THEN lpad(CAST(try_cast({_DIGITS} AS BIGINT) AS VARCHAR), 10, '0') END AS cik FROM ids")
def f1(spark, sf):
    return raw_ids(spark, sf).select("c_custkey", T.cik_digits("raw").alias("cik"))


@query("F2_cik_number_first", f"WITH {RAW_SQL} SELECT c_custkey, CASE WHEN {_NUMBER} > 0 THEN lpad(CAST({_NUMBER} AS VARCHAR), 10, '0') END AS cik FROM ids")
def f2(spark, sf):
    return raw_ids(spark, sf).select("c_custkey", T.cik("raw").alias("cik"))


@query("F3_cik_zero_allowed", f"WITH {RAW_SQL} SELECT c_custkey, CASE WHEN try_cast({_DIGITS} AS BIGINT) >= 0 THEN lpad(CAST(try_cast({_DIGITS} AS BIGINT) AS VARCHAR), 10, '0') END AS cik FROM ids")
def f3(spark, sf):
    return raw_ids(spark, sf).select("c_custkey", T.cik_digits("raw", 0).alias("cik"))


@query("F4_cik_of_numbers", "SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik FROM supplier WHERE s_suppkey > 0")
def f4(spark, sf):
    return read(spark, sf, "supplier").select("s_suppkey", T.cik(F.col("s_suppkey").cast("double")).alias("cik")).filter("cik is not null")


@query("F5_firm_and_year", f"WITH {RAW_SQL} SELECT c_custkey, CASE WHEN {_NUMBER} >= 0 THEN CAST({_NUMBER} AS VARCHAR) END AS firm, CASE WHEN c_custkey % 500 + 1700 BETWEEN 1800 AND 2200 THEN CAST(c_custkey % 500 + 1700 AS INTEGER) END AS y FROM ids")
def f5(spark, sf):
    year = F.concat((F.col("c_custkey") % 500 + 1700).cast("string"), F.when(F.col("c_custkey") % 2 == 0, ".0").otherwise("-12-31"))
    return raw_ids(spark, sf).select("c_custkey", T.firm_key("raw").alias("firm"), T.year_key(year).alias("y"))


_NAME = "concat(replace(s_name, '#', '  '), CASE s_suppkey % 5 WHEN 0 THEN ' Corp' WHEN 1 THEN ' incorporated' WHEN 2 THEN ' Inc' WHEN 3 THEN ' Ltd' ELSE '' END)"


@query("F6_ticker_and_name", f"SELECT s_suppkey, concat('BRK-', chr(CAST(65 + s_suppkey % 26 AS INTEGER))) AS ticker, trim(regexp_replace(regexp_replace(upper({_NAME}), '\\s+', ' ', 'g'), ' (CORPORATION|CORP|INCORPORATED|INC|LIMITED|LTD)$', '')) AS name FROM supplier")
def f6(spark, sf):
    t = F.concat(F.lit(" brk."), F.lower(F.char(65 + F.col("s_suppkey") % 26)))
    n = F.expr(_NAME)
    return read(spark, sf, "supplier").select("s_suppkey", T.ticker(t).alias("ticker"), T.company_name(n).alias("name"))


@query("F7_accession_plain", f"WITH {duck('filing')} SELECT accession, replace(accession, '-', '') AS plain FROM filing")
def f7(spark, sf):
    return view(spark, sf, "filing").select("accession", T.accession_plain("accession").alias("plain"))


@query("F8_item_codes", f"WITH {duck('filing')} SELECT accession, CASE WHEN lower(trim(coalesce(items, ''))) IN ('', 'nan', 'none', 'null') THEN '' ELSE array_to_string(list_sort(list_distinct(regexp_extract_all(items, '(?i)(?:\\bitem\\s*)?([0-9]{{1,2}}\\.[0-9]{{2}})', 1))), ';') END AS codes FROM filing")
def f8(spark, sf):
    return view(spark, sf, "filing").select("accession", F.array_join(T.item_codes("items"), ";").alias("codes"))


#: the entities that the pages hold, the ampersand last, as entities are resolved once
_PLAIN = r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(
  regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', chr(10), 'g'),
  '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g'), '[ \t\r\f\x0B]+', ' ', 'g'), '\n\s*', chr(10), 'g') AS plain FROM pages"""


@query("F9_plain_text", _PLAIN)
def f9(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.plain_text("html").alias("plain"))


@query("F10_note_window", f"WITH {duck('amended_text')} SELECT accession, CASE WHEN document_text LIKE '<p>%' THEN 'EXPLANATORY NOTE' WHEN document_text LIKE 'Intro%' THEN 'Introductory Note' ELSE '' END AS heading FROM amended_text")
def f10(spark, sf):
    return view(spark, sf, "amended_text").select("accession", F.regexp_extract(T.note_window(T.plain_text("document_text")), T.NOTE_HEADING, 1).alias("heading"))


_D, _N = "coalesce(primary_doc_description, '')", "coalesce(items, '')"
_ADMIN = f"regexp_matches({_D}, '(?i)\\b(part\\s+iii|proxy|def\\s*14a|exhibit)\\b')"
_MONEY = f"regexp_matches({_N}, '(?i)\\b(restat(e|ed|ement|ing)|correct(ed|ion|ing)?|error|misstatement|non-reliance|nonreliance|previously issued financial)\\b')"


@query("F11_amendment_class", f"WITH f0 AS ({duck('filing')[11:-1]}), filing AS (SELECT accession, primary_doc_description, CASE WHEN contains(items, '4.02') THEN 'an Error' ELSE items END AS items FROM f0) SELECT accession, CASE WHEN {_MONEY} THEN 'non_admin_financial_correction' WHEN {_ADMIN} THEN 'admin_part_iii_proxy' ELSE 'broad_amendment_unclassified' END AS annotation, CASE WHEN {_MONEY} AND {_ADMIN} THEN 'mixed_content_classified_as_nonadmin' WHEN {_MONEY} THEN 'explanatory_note_financial_keyword' WHEN {_ADMIN} THEN 'admin_candidate_metadata' WHEN {_N} = '' THEN 'explanatory_note_missing' ELSE 'no_financial_keyword' END AS reason FROM filing")
def f11(spark, sf):
    from tidemark.operators.events import amendment_class

    note = F.coalesce(F.when(F.col("items").contains("4.02"), "an Error").otherwise(F.col("items")), F.lit(""))
    c = amendment_class(F.coalesce("primary_doc_description", F.lit("")), note)
    return view(spark, sf, "filing").select("accession", c["amendment_annotation"].alias("annotation"), c["annotation_reason"].alias("reason"))


@query("F12_clean_text", f"WITH {duck('filing')} SELECT accession, upper(nullif(trim(items), '')) AS items FROM filing")
def f12(spark, sf):
    return view(spark, sf, "filing").select("accession", F.upper(T.blank_to_null("items")).alias("items"))


@query("F13_identifier_words", "SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS compact, array_to_string(list_filter(string_split(lower(regexp_replace(regexp_replace(concat('partType', replace(p_type, ' ', 'X')), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda x: x <> ''), ' ') AS words FROM part")
def f13(spark, sf):
    camel = F.concat(F.lit("partType"), F.replace("p_type", F.lit(" "), F.lit("X")))
    return read(spark, sf, "part").select("p_partkey", T.slug("p_type").alias("slug"), T.compact("p_type").alias("compact"), F.array_join(T.identifier_words(camel), " ").alias("words"))


@query("F14_numeric_like", "SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(c_custkey * 1000 AS DOUBLE) END AS x FROM customer")
def f14(spark, sf):
    text = F.when(F.col("c_custkey") % 6 == 0, "n/a").when(F.col("c_custkey") % 6 == 1, F.concat((F.col("c_custkey") * 1000).cast("string"), F.lit("%"))).otherwise(F.concat(F.lit(" "), F.regexp_replace((F.col("c_custkey") * 1000).cast("string"), "(000)$", ",$1")))
    return read(spark, sf, "customer").select("c_custkey", T.numeric_like(text).alias("x"))


@query("F15_bool_like", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 END AS b FROM orders")
def f15(spark, sf):
    k = F.col("o_orderkey") % 4
    return read(spark, sf, "orders").select("o_orderkey", T.bool_like(F.when(k == 0, " Yes").when(k == 1, "FALSE").when(k == 2, "t").otherwise("maybe")).alias("b"))


FAMILIES = {"order": ("o_",), "line": ("l_",), "price": ("l_extendedprice", "o_totalprice")}


@query("F16_feature_families", "SELECT * FROM (VALUES ('o_orderkey', 'order'), ('o_custkey', 'order'), ('o_orderstatus', 'order'), ('o_totalprice', 'order'), ('o_orderdate', 'order'), ('o_orderpriority', 'order')) t(column_name, family)")
def f16(spark, sf):
    cols = read(spark, sf, "orders").columns
    return spark.createDataFrame([(c, T.family_of(c, FAMILIES)) for c in cols], "column_name string, family string")


@query("F17_year_hint", "SELECT page_id, try_cast(nullif(regexp_extract(concat(url, '/', CAST(1980 + page_id % 90 AS VARCHAR), 'q1.zip'), '((?:20|19)[0-9]{2})', 1), '') AS INTEGER) AS hint FROM pages")
def f17(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.year_hint(F.concat("url", F.lit("/"), (1980 + F.col("page_id") % 90).cast("string"), F.lit("q1.zip"))).alias("hint"))


@query("D1_sec_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d FROM orders")
def d1(spark, sf):
    text = F.date_format("o_orderdate", "yyyyMMdd")
    text = F.when(F.col("o_orderkey") % 5 == 0, "bad").when(F.col("o_orderkey") % 5 == 1, F.concat(text, F.lit(".0"))).otherwise(text)
    return read(spark, sf, "orders").select("o_orderkey", D.sec_date(text).alias("d"))


@query("D2_mixed_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d FROM orders")
def d2(spark, sf):
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "MM/dd/yyyy")).when(k == 2, F.date_format("o_orderdate", "yyyyMMdd")).otherwise("2020")
    return read(spark, sf, "orders").select("o_orderkey", D.day(D.mixed_date(text)).alias("d"))


@query("D3_year", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders")
def d3(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))


@query("D4_day_difference", "SELECT l_orderkey, l_linenumber, date_diff('day', o_orderdate, l_shipdate) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def d4(spark, sf):
    j = read(spark, sf, "lineitem").join(read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", D.day_diff("l_shipdate", "o_orderdate").cast("long").alias("days"))


@query("D5_plus_days", "SELECT o_orderkey, o_orderdate + INTERVAL 365 DAY AS ahead, o_orderdate - INTERVAL 1095 DAY AS back FROM orders")
def d5(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", D.plus_days("o_orderdate", 365).alias("ahead"), D.plus_days("o_orderdate", -1095).alias("back"))


@query("D6_censored", "SELECT o_orderkey, CASE WHEN o_orderdate + INTERVAL 365 DAY > TIMESTAMP '1998-01-01' THEN 1 ELSE 0 END AS censored FROM orders")
def d6(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", D.censored("o_orderdate", F.lit("1998-01-01").cast("timestamp_ntz")).alias("censored"))


@query("D7_windows", "SELECT 365 AS one_year, 1095 AS three_years")
def d7(spark, sf):
    return spark.range(1).select(F.lit(D.YEAR_DAYS).alias("one_year"), F.lit(D.THREE_YEARS_DAYS).alias("three_years"))


_A, _B = "o_orderdate", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate + INTERVAL 100 DAY END"
_Y, _Z = "o_orderdate + INTERVAL 400 DAY", "CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate ELSE NULL END"


@query("D8_window_meet", f"SELECT o_orderkey, CASE WHEN greatest({_A}, {_B}) <= least({_Y}, {_Z}) THEN greatest({_A}, {_B}) END AS first, CASE WHEN greatest({_A}, {_B}) <= least({_Y}, {_Z}) THEN least({_Y}, {_Z}) END AS last FROM orders")
def d8(spark, sf):
    first, last = D.window_meet([F.expr(_A), F.expr(_B)], [F.expr(_Y), F.expr(_Z)])
    return read(spark, sf, "orders").select("o_orderkey", first.alias("first"), last.alias("last"))


@query("D9_years", "SELECT o_orderkey, CAST(unnest(range(year(o_orderdate), year(o_orderdate + INTERVAL 800 DAY) + 1)) AS INTEGER) AS y FROM orders")
def d9(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", F.explode(D.years_between(F.col("o_orderdate"), D.plus_days("o_orderdate", 800))).alias("y"))


@query("M1_ratio", "SELECT c_custkey, CASE WHEN c_nationkey % 3 <> 0 THEN round(c_acctbal / (c_nationkey % 3), 6) END AS r FROM customer")
def m1(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", F.round(N.ratio("c_acctbal", (F.col("c_nationkey") % 3)), 6).alias("r"))


@query("M2_log_size", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(ln(1 + c_acctbal), 6) END AS x FROM customer")
def m2(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", F.round(N.log_size("c_acctbal"), 6).alias("x"))


@query("M3_fallback_sum", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN NULL ELSE (CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_acctbal END) + (CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1.5 END) END AS debt FROM customer")
def m3(spark, sf):
    a, b = F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")), F.when(F.col("c_custkey") % 2 != 0, F.lit(1.5))
    return read(spark, sf, "customer").select("c_custkey", N.first_known_sum(a, b).alias("debt"))


@query("M4_change", "SELECT c_custkey, CASE WHEN c_acctbal <> 0 THEN round((c_custkey - c_acctbal) / abs(c_acctbal), 6) END AS x FROM customer")
def m4(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", F.round(N.change("c_custkey", "c_acctbal"), 6).alias("x"))


@query("M5_at_least_zero", "SELECT c_custkey, greatest(c_acctbal, 0) AS x FROM customer")
def m5(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", N.at_least_zero("c_acctbal").alias("x"))


@query("M6_linear_score", "SELECT c_custkey, round(1 / (1 + exp(-greatest(least(-7.893 + 0.79 * (c_acctbal / 100) + 2.518 * (c_nationkey / 25.0), 35), -35))), 6) AS p FROM customer")
def m6(spark, sf):
    df = read(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("a"), (F.col("c_nationkey") / 25.0).alias("b"))
    return df.select("c_custkey", F.round(N.linear_score(-7.893, {"a": 0.79, "b": 2.518}), 6).alias("p"))


@query("M7_z_score", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER w) / nullif(stddev_pop(c_acctbal) OVER w, 0), 5) AS z FROM customer WINDOW w AS (PARTITION BY c_mktsegment)")
def m7(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", F.round(N.z_score("c_acctbal", ("c_mktsegment",)), 5).alias("z"))


@query("M8_hash", "SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents")
def m8(spark, sf):
    return read(spark, sf, "documents").select("doc_id", N.text_hash("text").alias("h"))


@query("M9_task_seed")
def m9(spark, sf):
    return spark.createDataFrame([(w, y, N.task_seed("model", w, y)) for w in ("expanding", "rolling_5y") for y in range(2010, 2015)], "window string, year long, seed long")


@query("M10_half_up", "SELECT c_custkey, CAST(floor(c_custkey * 0.25 + 0.5) AS BIGINT) AS k FROM customer")
def m10(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", N.half_up(F.col("c_custkey") * F.lit(0.25)).alias("k"))
