"""The engine's flows as functions: building the lake and its panels, linkage, backtests, cascades, peers, overlap.

Each writes its tables as Parquet under an output folder and a small JSON summary beside them, and returns the summary.
Folders are any that Spark reaches; summaries are written by Hadoop's file system too.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import normalize as N
from tidemark.functions.dates import day
from tidemark.functions.numeric import z_score
from tidemark.operators import audit, events, facts, labels, models, overlap, panel, ranking, stats
from tidemark.operators.reports import dispersion, ladder
from tidemark.sources import archives
from tidemark.sources.sinks import kept, sample_entities, write_by_year, write_table
from tidemark.sources.tables import exists, read_any, read_csvs, read_table, source_or_empty, write_bytes

TASKS = {"comment_thread": "label_comment_thread_365", "amendment": "label_amendment_365", "8k_402": "label_8k_402_365"}
EXCLUDED = {"8k_402": "k402_item_metadata_unknown_365"}
KEYS = ("issuer_cik", "accession", "fiscal_year", "origin_date", "filing_date", "report_date", "as_of_date", "acceptance_datetime", "fiscal_period_end", "form", "items", "primary_document", "primary_doc_description", "entity_name", "sic", "sic_description", "entity_type", "fiscal_period_end_source", "censored_365", "is_domestic_us_gaap_proxy", "issuer_has_fpi_form_year", "accession_nodash")
FAMILIES = {"xbrl": ("xbrl_",), "text": ("note_", "item_"), "auditor": ("form_ap_", "auditor_partner_prior_"), "history": ("public_history_", "filing_friction_"), "oversight": ("prior_",)}


def _summary(spark: SparkSession, out: str, **values: object) -> dict:
    write_bytes(spark, f"{out}/summary.json", json.dumps(values, indent=2, sort_keys=True, default=str).encode())
    return values


def _put(df: DataFrame, out: str, name: str, order: Sequence[str] = ()) -> DataFrame:
    write_table(df, f"{out}/{name}.parquet", mode="overwrite", order=order)
    return df.sparkSession.read.parquet(f"{out}/{name}.parquet")


def materialize_raw_dataset(spark: SparkSession, source: str, out: str) -> dict:
    """A raw table from a CSV file, or from a zip with exactly one, as Parquet."""
    if source.lower().endswith(".zip"):
        rows = archives.zip_rows(spark, [source], "", first_only=False)
        names = sorted(r[0] for r in rows.select(F.explode(F.map_keys("row"))).distinct().collect())
        df = rows.select(*(archives.field(n).alias(n) for n in names))
    else:
        df = read_any(spark, source)
    return _summary(spark, out, rows=_put(df, out, "raw").count(), columns=df.columns)


def materialize_sample_dataset(spark: SparkSession, source: str, out: str, entity: str, n: int, seed: int = 7) -> dict:
    """All rows of n entities (K8)."""
    return _summary(spark, out, rows=_put(sample_entities(read_any(spark, source), entity, n, seed), out, "sample").count(), entities=n, seed=seed)


def build_lake(spark: SparkSession, out: str, submissions: Sequence[str], fact_archives: Sequence[str] = (), note_archives: Sequence[str] = (), form_ap: Sequence[str] = (), texts: str | None = None, notes_mode: str = "summary") -> dict:
    """Normalized tables and derived events from archives."""
    if notes_mode not in ("summary", "raw", "skip"):
        raise ValueError("notes_mode must be summary, raw or skip")
    issuer, filing = archives.submissions(archives.zip_texts(spark, submissions))
    done = {"issuer_dim": _put(issuer, out, "issuer_dim"), "filing_dim": _put(filing, out, "filing_dim", ["issuer_cik", "filing_date", "accession"])}
    if fact_archives:
        rows = archives.zip_rows(spark, fact_archives, "num")
        done["filing_xbrl_dim"] = _put(archives.fact_filings(archives.zip_rows(spark, fact_archives, "sub")), out, "filing_xbrl_dim")
        done["xbrl_fact_summary"] = _put(facts.summary(archives.core_facts(rows)), out, "xbrl_fact_summary")
        core = kept(archives.core_facts(rows, [t for x in facts.CONCEPTS.values() for t in x]), "core")
        done["xbrl_context_conflicts"] = _put(audit.conflicts(core, facts.CONTEXT, "value"), out, "xbrl_context_conflicts")
        done["xbrl_core_fact"] = _put(facts.settled(core), out, "xbrl_core_fact")
    if note_archives and notes_mode != "skip":
        n = archives.notes(archives.zip_rows(spark, note_archives, "txt"))
        done["note_summary"] = _put(archives.note_summary(n), out, "note_summary")
        if notes_mode == "raw":
            done["note_text"] = _put(n, out, "note_text")
    f = done["filing_dim"]
    done["comment_thread"] = _put(events.comment_threads(f), out, "comment_thread")
    done["issuer_8k_item_event"] = _put(events.item_events(f), out, "issuer_8k_item_event")
    done["amendment_annotation"] = _put(events.amendments(f, read_any(spark, texts) if texts else None), out, "amendment_annotation")
    done["correction_event"] = _put(events.corrections(f), out, "correction_event")
    if form_ap:
        ap = done["form_ap_event"] = _put(archives.form_ap(archives.zip_rows(spark, form_ap, "")), out, "form_ap_event")
        e = done["partner_issuer_engagement"] = _put(events.engagements(ap), out, "partner_issuer_engagement")
        one, two = events.partner_histories(e, events.risk_events(done["issuer_8k_item_event"], done["amendment_annotation"]))
        done["partner_risk_history"], done["partner_issuer_risk_history"] = _put(one, out, "partner_risk_history"), _put(two, out, "partner_issuer_risk_history")
    return _summary(spark, out, tables={n: df.count() for n, df in done.items()})


def build_panels(spark: SparkSession, lake: str, out: str, as_of: str) -> dict:
    """The filing panel, sharded by year, and the issuer-year panel."""
    table = lambda n: spark.read.parquet(f"{lake}/{n}.parquet")
    have = lambda n: exists(spark, f"{lake}/{n}.parquet")
    periods = table("filing_xbrl_dim").select(F.col("adsh").alias("accession"), F.col("fiscal_period_end").cast("timestamp_ntz").alias("fsds_fiscal_period_end")) if have("filing_xbrl_dim") else spark.createDataFrame([], "accession string, fsds_fiscal_period_end timestamp_ntz")
    features = facts.features(table("xbrl_core_fact")) if have("xbrl_core_fact") else None
    notes = table("note_summary").withColumnRenamed("adsh", "accession") if have("note_summary") else None
    partners = have("partner_risk_history")
    every, one = panel.build(
        table("filing_dim"), periods, table("comment_thread"), table("correction_event"), table("issuer_8k_item_event"), table("issuer_dim").select("issuer_cik", "entity_name", "sic", "sic_description", "entity_type"), as_of,
        form_ap=table("form_ap_event") if have("form_ap_event") else None, engaged=table("partner_issuer_engagement") if partners else None, histories=(table("partner_risk_history"), table("partner_issuer_risk_history")) if partners else None, features=features, notes=notes,
    )
    write_by_year(every, f"{out}/filing_origin_panel.parquet", "origin_date", ["origin_date", "accession"])
    return _summary(spark, out, as_of=as_of, filing_origin_panel=every.count(), issuer_origin_panel=_put(one, out, "issuer_origin_panel", ["issuer_cik", "fiscal_year"]).count())


def prepare_crosswalk(spark: SparkSession, source: str, raw: str | None, out: str, clamp: bool = True) -> dict:
    """An annual crosswalk from rows with a year or a range of years (Q13)."""
    x = read_any(spark, source)
    first = next((c for c in ("first_year", "data_year", "fiscal_year", "year") if c in x.columns), None)
    if first is None:
        raise ValueError("a crosswalk needs a year or a range of years")
    last = "last_year" if "last_year" in x.columns else first
    x = x.withColumns({"first_year": F.col(first), "last_year": F.col(last)})
    years = overlap.raw_keys(read_any(spark, raw)).select("data_year").distinct() if raw else None
    got = overlap.annual_crosswalk(x.select("gvkey", "issuer_cik", "first_year", "last_year", *(c for c in ("source", "match_method", "match_score") if c in x.columns)), years, clamp)
    return _summary(spark, out, rows=_put(got, out, "crosswalk", ["gvkey", "data_year", "issuer_cik"]).count())


def build_primary_linkage(spark: SparkSession, links: str, raw: str, out: str, extra: str | None = None, wanted: str | None = None, names: dict | None = None, rule: str = "intersection") -> dict:
    """The annual linkage from dated raw links, supplemented by outside rows for keys it lacks; conflicts are reported (Q12, Q14)."""
    l = read_any(spark, links)
    l = l.withColumns({c: day(c) for c in ("sec_start_date", "sec_end_date", "link_start_date", "link_end_date")})
    keys = overlap.raw_keys(read_any(spark, raw))
    first = kept(overlap.annual_links(l, read_any(spark, raw), rule, wanted, names), "links")
    whole, clash = first, 0
    if extra:
        more = spark.read.parquet(f"{extra}/crosswalk.parquet")
        whole = overlap.supplement(first, more, ["gvkey", "data_year"])
        clash = _put(overlap.disagreements(first, more, ["gvkey", "data_year"], "issuer_cik"), out, "conflicts").count()
    linked = _put(whole, out, "linkage", ["gvkey", "data_year", "issuer_cik"])
    hit = keys.select("gvkey", "data_year").distinct().join(linked.select("gvkey", "data_year").distinct(), ["gvkey", "data_year"], "left_semi").count()
    return _summary(spark, out, rows=linked.count(), raw_keys=keys.select("gvkey", "data_year").distinct().count(), linked_keys=hit, conflicts=clash)


def run_bridge_probe(spark: SparkSession, raw: str, out: str, crosswalk: str | None = None, issuer_panel: str | None = None, issuers: str | None = None) -> dict:
    """Whether two worlds of identifiers can be linked, and how well (Q15). The status says what blocks it."""
    r = read_any(spark, raw)
    r = kept(r.withColumn("raw_row_id", F.monotonically_increasing_id()), "raw")
    found = {k: next((c for c in names if c in r.columns), None) for k, names in {"cik": ("cik", "issuer_cik"), "ticker": ("ticker", "tic"), "name": ("company_name", "conm", "name")}.items()}
    public = read_any(spark, issuers) if issuers and exists(spark, issuers) else None
    if crosswalk and exists(spark, crosswalk):
        x = spark.read.parquet(crosswalk).select("gvkey", "data_year", "issuer_cik").distinct()
        c = r.withColumns({"gvkey": N.firm_key("gvkey"), "data_year": N.year_key("data_year")}).select("raw_row_id", "gvkey", "data_year").join(x, ["gvkey", "data_year"])
        status = None
    elif not any(found.values()):
        return _summary(spark, out, status="raw_identifier_blocker", raw_rows=r.count())
    elif public is None:
        return _summary(spark, out, status="public_identifier_blocker", raw_rows=r.count())
    else:
        of = {"cik": N.cik, "ticker": N.ticker, "name": N.company_name}
        keys = None
        for kind, column in found.items():
            if column:
                one = r.select("raw_row_id", F.lit(kind).alias("match_type"), of[kind](column).alias("match_value")).filter("match_value is not null")
                keys = one if keys is None else keys.unionByName(one)
        p = public.select("issuer_cik", *(F.col(c) if c in public.columns else F.lit(None).cast("string").alias(c) for c in ("tickers_json", "entity_name")))
        c, status = overlap.match(keys, overlap.identifiers(p)), "candidate_crosswalk_available"
    c = _put(c, out, "candidates")
    n = c.count()
    status = ("crosswalk_available" if n else "crosswalk_no_matches") if status is None else (status if n else "no_candidate_matches")
    many = _put(c.groupBy("raw_row_id").agg(F.countDistinct("issuer_cik").alias("candidate_count")).filter("candidate_count > 1"), out, "ambiguous").count()
    extra = {}
    if issuer_panel and exists(spark, issuer_panel) and "data_year" in c.columns:
        extra = overlap.overlap_stats(c, spark.read.parquet(issuer_panel).select("issuer_cik", F.col("fiscal_year").alias("data_year"))).first().asDict()
    return _summary(spark, out, **({"candidates": n} | extra), status=status, raw_rows_all=r.count(), matched_rows=c.select("raw_row_id").distinct().count(), ambiguous_rows=many)


def _metrics(predictions: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    m = ranking.ranking_metrics(predictions, "label", "probability", by)
    return m.join(ranking.calibration(predictions, "label", "probability", key, by).drop("n_obs"), list(by))


def run_benchmark(spark: SparkSession, source: str, out: str, features: Sequence[str], target: str, firm: str = "gvkey", year: str = "data_year", offsets: Sequence[str] = (), modes: Sequence[str] = ("naive", "proxy_drop_observed", "proxy_imputed_lag_<N>y"), lags: Sequence[int] = (1,), windows: Sequence[int | None] = (None, 5), least_years: int = 3, spec: models.Spec | None = None, jobs: int = 2) -> dict:
    """Out-of-time backtests under each assumption of label timing; coverage, metrics and fold dispersion."""
    spec = spec or models.Spec("boosted", "gbt", "weights", {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1})
    p = labels.with_detection_year(read_any(spark, source).withColumns({firm: N.firm_key(firm), year: N.year_key(year)}), year, target, offsets) if offsets else read_any(spark, source).withColumns({firm: N.firm_key(firm), year: N.year_key(year), "detection_year_proxy": F.lit(None).cast("int")})
    p = kept(audit.assert_unique(audit.assert_known(p, [firm, year]), [firm, year]).withColumns({"row_id": F.concat_ws("-", firm, year), target: F.col(target).cast("int")}), "benchmark")
    _put(labels.timing_coverage(p, year, target), out, "timing_coverage", [year])
    ys = [r[0] for r in p.select(year).distinct().collect()]
    every, status = None, None
    for mode in labels.label_modes(modes, lags):
        for w, test, train in labels.rolling_folds(ys, windows, least_years):
            name = "expanding" if w is None else f"rolling_{w}y"
            fold = labels.matured(p.filter(F.col(year).isin(train)), mode, max(train), year, target).withColumn("y_train", F.col("y_train").cast("int"))
            both = fold.unionByName(p.filter(F.col(year) == test).withColumn("y_train", F.col(target)))
            a, s = models.backtest(both, [spec], [(name, test, train)], year, "y_train", features, "row_id", jobs=jobs)
            s = s.withColumns({"label_mode": F.lit(mode), "train_window": F.lit(name)})
            status = s if status is None else status.unionByName(s)
            if a is not None:
                a = a.withColumn("label_mode", F.lit(mode))
                every = a if every is None else every.unionByName(a)
    if status is None:
        return _summary(spark, out, status="no_folds", rows=p.count())
    status = _put(status, out, "status")
    if every is None:
        return _summary(spark, out, status="no_fits", rows=p.count(), cells=status.count())
    pred = _put(every, out, "predictions", ["label_mode", "train_window", "test_year", "row_id"])
    m = _put(_metrics(pred, ["label_mode", "train_window", "test_year"], "row_id"), out, "metrics")
    _put(dispersion(m.withColumnRenamed("n_pos", "positives"), ["label_mode", "train_window"], "pr_auc", "positives"), out, "dispersion")
    return _summary(spark, out, status="complete", rows=p.count(), cells=status.count(), fits=status.filter("status = 'fit'").count())


def families(columns: Sequence[str]) -> dict[str, list[str]]:
    """Model columns by family (F16)."""
    out: dict[str, list[str]] = {f: [] for f in (*FAMILIES, "metadata")}
    for c in columns:
        if c not in KEYS and not c.startswith(("label_", "k402_", "public_date_", "vintage_", "source_available_")):
            out[N.family_of(c, FAMILIES, "metadata")].append(c)
    out["all"] = sorted(c for f, cs in out.items() for c in cs)
    return out


def opacity(p: DataFrame) -> tuple[DataFrame, list[str]]:
    """p with missingness_density_score: the mean of its missingness flags and lacking coverage."""
    parts = {c: F.greatest(F.least(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0)) for c in p.columns if c.startswith(("missing_", "raw_missing_"))}
    parts |= {f"opacity_{c}": 1.0 - F.greatest(F.least(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0)) for c in p.columns if c.startswith("xbrl_coverage_")}
    parts |= {f"opacity_{c}_absent": F.when(F.coalesce(F.col(c), F.lit(0)) <= 0, 1.0).otherwise(0.0) for c in ("note_text_count", "note_text_char_count") if c in p.columns}
    total = sum(parts.values(), F.lit(0.0))
    return p.withColumn("missingness_density_score", total / len(parts) if parts else F.lit(0.0)), list(parts)


NOT_CONTROLS = ("missingness_density_score", "issuer_has_fpi_form", "tickers_json", "exchanges_json", "former_names_json", "flags", "description", "phone", "ein", "prior_comment_thread_count", "public_history_comment_thread_1y_count", "public_history_comment_thread_3y_count")


def dml_controls(columns: Sequence[str], parts: Sequence[str]) -> list[str]:
    """All model columns but those that the opacity score is made of, states of the sources and labels (ML12)."""
    gone = {*NOT_CONTROLS, *KEYS, *parts, *(c.replace("opacity_", "").replace("_absent", "") for c in parts)}
    return [c for c in columns if c not in gone and not c.startswith(("missing_", "raw_missing_", "xbrl_coverage_", "source_available_", "public_date_", "vintage_", "label_", "censored_"))]


def run_public_cascade(spark: SparkSession, panel_path: str, out: str, first_year: int, last_year: int, sets: Sequence[str] = ("metadata", "all"), windows: Sequence[int | None] = (None, 5), least_years: int = 3, spec: models.Spec | None = None, domestic_only: bool = True, jobs: int = 2, with_dml: bool = True) -> dict:
    """Three label tasks over feature families and matured folds, and the adjusted effect of opacity on each."""
    spec = spec or models.Spec("boosted", "gbt", "weights", {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1})
    p = spark.read.parquet(panel_path)
    _put(ladder(p, {"years": F.col("fiscal_year").between(first_year, last_year), "domestic": (F.col("is_domestic_us_gaap_proxy") == 1) if domestic_only else F.lit(True), "uncensored": F.col("censored_365") == 0}), out, "attrition")
    p = p.filter(F.col("fiscal_year").between(first_year, last_year) & (F.col("censored_365") == 0))
    p = p.filter("is_domestic_us_gaap_proxy = 1") if domestic_only else p
    as_of = p.agg(F.max("as_of_date")).first()[0]
    p = kept(p.withColumn("origin_year", F.year("origin_date").cast("long")), "cascade")
    fam = families(audit_columns(p))
    folds = [(r.train_window, r.test_year, r.train_years) for r in labels.mature_folds(spark, p, "origin_date", str(as_of.date()) if as_of else "1900-01-01", windows, least_years).collect()]
    every, status = None, None
    for task, label in TASKS.items():
        t = p.filter(F.col(label).isNotNull())
        t = t.filter(F.coalesce(F.col(EXCLUDED[task]), F.lit(0)) == 0) if task in EXCLUDED else t
        for f in sets:
            if not fam.get(f):
                continue
            a, s = models.backtest(t, [spec], folds, "origin_year", label, fam[f], "accession", jobs=jobs)
            tag = {"task": F.lit(task), "feature_set": F.lit(f)}
            s = s.withColumns(tag)
            status = s if status is None else status.unionByName(s)
            if a is not None:
                a = a.withColumns(tag)
                every = a if every is None else every.unionByName(a)
    inference = []
    if with_dml:
        q, parts = opacity(p)
        controls = dml_controls(fam["all"], parts)
        for task, label in TASKS.items():
            got = models.dml(q.filter(F.col(label).isNotNull()), label, "missingness_density_score", controls, "accession", "issuer_cik", trees=5) if parts else {"status": "skipped_no_opacity_components"}
            inference.append({"outcome": task, **got})
    if every is None:
        return _summary(spark, out, status="no_fits", rows=p.count(), folds=len(folds), inference=inference)
    status = _put(status, out, "status")
    pred = _put(every, out, "predictions", ["task", "feature_set", "train_window", "test_year", "accession"])
    _put(_metrics(pred, ["task", "feature_set", "train_window", "test_year"], "accession"), out, "metrics")
    return _summary(spark, out, status="complete", rows=p.count(), folds=len(folds), fits=status.filter("status = 'fit'").count(), inference=inference, families={k: len(v) for k, v in fam.items()})


def audit_columns(p: DataFrame) -> list[str]:
    """Numeric columns of a panel."""
    return [c for c, t in p.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint")]


def run_peer_comparison(spark: SparkSession, source: str, out: str, features: Sequence[str], target: str, key: str, year: str, test_years: Sequence[int], light: bool = True, jobs: int = 2) -> dict:
    """All peer specifications on one panel, with a status for each cell; those that the light mode leaves out say so."""
    p = kept(read_any(spark, source).withColumns({target: F.col(target).cast("int"), year: F.col(year).cast("long")}), "peers")
    specs = models.peer_specs(light)
    run, off = (specs[:-3], specs[-3:]) if light else (specs, [])
    folds = [("expanding", t, [y for (y,) in p.select(year).distinct().collect() if y < t]) for t in test_years]
    every, status = models.backtest(p, run, folds, year, target, features, key, jobs=jobs)
    left = [(s.name, t, "disabled_in_light_mode", 0, 0) for s in off for t in test_years]
    status = _put(status.unionByName(spark.createDataFrame(left, models.STATUS)) if left else status, out, "status", ["model", "test_year"])
    if every is not None:
        _put(_metrics(_put(every, out, "predictions", ["model", "test_year", key]), ["model", "test_year"], key), out, "metrics")
    return _summary(spark, out, cells=status.count(), fits=status.filter("status = 'fit'").count())


def run_public_peer_comparison(spark: SparkSession, panel_path: str, out: str, task: str, mapping: dict[str, Sequence[str]], test_years: Sequence[int], light: bool = True) -> dict:
    """Peer specifications on the public panel, by columns that stand for theirs; how well is reported."""
    p = spark.read.parquet(panel_path)
    audit.assert_unique(p, ["issuer_cik", "fiscal_year"])
    found = {c: next((n for n in names if n in p.columns), None) for c, names in mapping.items()}
    rate = {c: p.agg(F.avg(F.col(n).isNotNull().cast("int"))).first()[0] if n else 0.0 for c, n in found.items()}
    _put(spark.createDataFrame([(c, n, float(rate[c] or 0)) for c, n in found.items()], "concept string, column_name string, coverage double"), out, "mapping")
    usable = [n for c, n in found.items() if n and (rate[c] or 0) > 0]
    quality = "full" if len(usable) == len(mapping) else "partial" if usable else "insufficient"
    if not usable:
        return _summary(spark, out, mapping_quality=quality, fits=0)
    t = p.filter((F.col("censored_365") == 0) & F.col(TASKS[task]).isNotNull())
    _put(t, out, "task_frame")
    return {"mapping_quality": quality} | run_peer_comparison(spark, f"{out}/task_frame.parquet", f"{out}/peers", usable, TASKS[task], "accession", "fiscal_year", test_years, light)


def run_construct_overlap(spark: SparkSession, master: str, crosswalk: str, issuer_panel: str, out: str, target: str, offsets: Sequence[str] = (), allowed: Sequence[str] = ()) -> dict:
    """Tiers of the link between both label worlds, the overlap panel, lifts by tier, and event-time rates (Q16-Q20)."""
    missing = [x for x in (master, crosswalk, issuer_panel) if not exists(spark, x)]
    if missing:
        return _summary(spark, out, status="blocked", missing=missing)
    names = list(TASKS.values())
    raw = read_any(spark, master)
    raw = raw.select(F.concat_ws("-", N.firm_key("gvkey"), N.year_key("data_year").cast("string")).alias("raw_row_id"), N.firm_key("gvkey").alias("gvkey"), N.year_key("data_year").alias("data_year"), F.coalesce(F.col(target).cast("int"), F.lit(0)).alias("benchmark_label"), *offsets).filter("gvkey is not null and data_year is not null")
    x = spark.read.parquet(crosswalk).withColumn("issuer_cik", N.cik("issuer_cik"))
    trust = overlap.evidence(x, allowed).first() if allowed else None
    j = kept(overlap.bridge(raw, x, overlap.public_annual(spark.read.parquet(issuer_panel), names), names), "bridge")
    t = _put(overlap.tiers(j), out, "bridge_tiers")
    p = _put(overlap.overlap_panel(j, t, names, ["benchmark_label", *offsets]), out, "overlap_panel", ["raw_row_id"])
    from tidemark.operators.reports import tier_lift

    lifts = None
    for c in names:
        one = tier_lift(p, "bridge_tier", c, "benchmark_label").withColumn("label", F.lit(c))
        lifts = one if lifts is None else lifts.unionByName(one)
    _put(lifts, out, "lifts", ["label", "tier"])
    from tidemark.operators.reports import event_time

    _put(event_time(p.filter("benchmark_label = 1").select("gvkey", "data_year"), p.groupBy("gvkey", "data_year").agg(F.max(names[0]).alias("v")), "gvkey", "data_year", "v"), out, "event_time", ["rel"])
    return _summary(spark, out, status="complete", tiers={r.bridge_tier: r["count"] for r in t.groupBy("bridge_tier").count().collect()}, evidence=trust.evidence_tier if trust else "not_checked")


def prep(spark: SparkSession, source: str, out: str, target: str, year: str, group: str, folds: int = 3, holdout_years: int = 1, purge: int = 0) -> dict:
    """The schema of a raw table, its hold-out split and folds, and a baseline that predicts the training rate (Q24)."""
    df = read_any(spark, source)
    schema = _put(labels.prep_schema(df, [c for c in df.columns if c not in (target, year, group)]), out, "schema", ["column_name"])
    train, test = labels.holdout(df, year, holdout_years)
    _put(train, out, "train"), _put(test, out, "holdout")
    blocks = _put(labels.year_blocks(train, year, folds, purge), out, "year_folds", ["fold"])
    _put(train.select(group, labels.group_fold(group, folds).alias("fold")).distinct(), out, "group_folds", ["fold", group])
    y = F.col(target).cast("double")
    base = []
    for b in blocks.collect():
        rate = train.filter(F.col(year).isin(list(b.train_years))).agg(F.avg(y)).first()[0]
        base.append((b.fold, rate, train.filter(F.col(year).isin(list(b.test_years))).agg(F.avg(F.pow(y - F.lit(rate), 2))).first()[0] if rate is not None else None))
    _put(spark.createDataFrame(base, "fold int, rate double, brier double"), out, "baseline", ["fold"])
    return _summary(spark, out, columns=schema.count(), train=train.count(), holdout=test.count())


def missing_profile_report(p: DataFrame, flags: Sequence[str], target: str, rate: str, by: str) -> DataFrame:
    """Clusters of missingness patterns with their label rates, densest first (ML10, M7)."""
    _, c = stats.missing_profiles(p, flags)
    c = c.withColumn("missingness_density_score", z_score(rate, (by,)))
    return c.groupBy("missing_profile_cluster").agg(F.count("*").alias("n_obs"), F.avg(target).alias("label_rate"), F.avg(rate).alias("avg_missing_rate")).orderBy(F.col("avg_missing_rate").desc())


__all__ = ["build_lake", "build_panels", "build_primary_linkage", "materialize_raw_dataset", "materialize_sample_dataset", "prep", "prepare_crosswalk", "read_csvs", "read_table", "run_benchmark", "run_bridge_probe", "run_construct_overlap", "run_peer_comparison", "run_public_cascade", "run_public_peer_comparison", "source_or_empty", "write_table"]
