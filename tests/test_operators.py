"""Operators on small tables of their own, with answers worked out by hand."""

import math
from datetime import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import normalize as N
from tidemark.functions import numeric as X
from tidemark.operators import audit, events, facts, labels, models, overlap, panel, ranking, runner, stats, temporal
from tidemark.sources import archives, sinks, tables


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr.alias("y")).first().y


@pytest.mark.parametrize("raw,want", [("320193.0", "0000320193"), ("CIK0000320193", "0000320193"), (" 7 ", "0000000007"), ("0", None), ("nan", None), ("", None), (None, None), ("none", None)])
def test_cik(spark, raw, want):
    assert one(spark, N.cik("x"), raw) == want


@pytest.mark.parametrize("raw,want", [("20111231", "2011-12-31"), ("20111231.0", "2011-12-31"), ("bad", None), ("2011", None), ("20111399", None), (None, None)])
def test_sec_date(spark, raw, want):
    got = one(spark, D.sec_date("x"), raw)
    assert (got and str(got)) == want


@pytest.mark.parametrize("raw,want", [("Item 4.02, 9.01", ["4.02", "9.01"]), ("5.02;5.02", ["5.02"]), (" NaN ", []), (None, []), ("4", [])])
def test_item_codes(spark, raw, want):
    assert one(spark, N.item_codes("x"), raw) == want


def test_names_and_tickers(spark):
    assert one(spark, N.company_name("x"), " Acme   Holdings Inc") == "ACME HOLDINGS"
    assert one(spark, N.company_name("x"), "Corp Corp Ltd") == "CORP CORP"
    assert one(spark, N.tickers("x"), '["a", "b.c"]') == ["A", "B-C"]
    assert one(spark, N.tickers("x"), "[]") == [] and one(spark, N.tickers("x"), None) == []
    assert one(spark, N.year_key("x"), "1799") is None and one(spark, N.year_key("x"), "2003-01-01") == 2003


def test_plain_text_and_note(spark):
    html = "<style>p{}</style><p>Cover &amp; more</p><h1>Explanatory Note</h1> we restated <b>it</b>.<br>ITEM 1. Business <script>x</script>"
    text = one(spark, N.plain_text("x"), html)
    assert "Cover & more" in text and "p{}" not in text and "x" not in text.split("Business")[1]
    note = one(spark, N.note_window(N.plain_text("x")), html)
    assert note.startswith("Explanatory Note") and "restated" in note and "ITEM" not in note
    assert one(spark, N.note_window("x"), "no heading") == "" and one(spark, N.note_window("x", most=20), "INTRODUCTORY NOTE abc def ghi") == "INTRODUCTORY NOTE ab"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_look_ahead_edges(spark):
    base = frame(spark, [("a", dt(2020, 1, 1)), ("a", dt(2020, 1, 7)), ("a", dt(2020, 1, 8)), ("b", dt(2020, 1, 1)), (None, dt(2020, 1, 1))], "k string, t timestamp_ntz")
    ev = frame(spark, [("a", dt(2020, 1, 8)), ("b", dt(2020, 1, 1)), (None, dt(2020, 1, 2))], "k string, e timestamp_ntz")
    got = temporal.exists_ahead(base, ev, "k", "t", "e", {"f": (7, None)})
    assert sorted((str(r.k), r.t.day, r.f) for r in got.collect()) == [("None", 1, 0), ("a", 1, 1), ("a", 7, 1), ("a", 8, 0), ("b", 1, 0)]
    n = temporal.window_counts(base, ev, "k", "t", "e", {"n": (7, None)})
    assert sorted((str(r.k), r.t.day, r.n) for r in n.collect()) == [("None", 1, 0), ("a", 1, 0), ("a", 7, 0), ("a", 8, 0), ("b", 1, 0)]
    at_edge = temporal.window_counts(frame(spark, [("a", dt(2020, 1, 15)), ("a", dt(2020, 1, 16))], "k string, t timestamp_ntz"), ev, "k", "t", "e", {"n": (7, None)})
    assert sorted((r.t.day, r.n) for r in at_edge.collect()) == [(15, 1), (16, 0)]


def test_asof_is_strict_and_ties_go_to_the_least(spark):
    left = frame(spark, [("a", dt(2020, 1, 5), 1), ("a", dt(2020, 1, 3), 2), ("z", dt(2020, 1, 5), 3), (None, dt(2020, 1, 5), 4)], "k string, t timestamp_ntz, id int")
    right = frame(spark, [("a", dt(2020, 1, 3), "p2"), ("a", dt(2020, 1, 3), "p1"), ("a", dt(2020, 1, 5), "p9"), (None, dt(2020, 1, 1), "no")], "k string, d timestamp_ntz, p string")
    got = {r.id: r.p for r in temporal.asof_join(left, right, ["k"], "t", "d", ["p"], ties=["p"]).collect()}
    assert got == {1: "p1", 2: None, 3: None, 4: None}
    loose = {r.id: r.p for r in temporal.asof_join(left, right.repartition(3), ["k"], "t", "d", ["p"], strict=False, ties=["p"]).collect()}
    assert loose == {1: "p9", 2: "p1", 3: None, 4: None}


def test_threads_split_after_120_days(spark):
    f = frame(spark, [("1", "a", "UPLOAD", dt(2020, 1, 1)), ("1", "b", "CORRESP", dt(2020, 4, 30)), ("1", "c", "UPLOAD", dt(2020, 8, 29)), ("1", "d", "10-K", dt(2020, 5, 1))], "issuer_cik string, accession string, form string, filing_date timestamp_ntz")
    got = sorted((r.thread_id, r.filing_count, r.upload_count, r.corresp_count) for r in events.comment_threads(f).collect())
    assert got == [("1-1", 2, 1, 1), ("1-2", 1, 1, 0)]


def test_three_valued_label(spark):
    f = frame(spark, [(k, k, dt(2020, 1, 1), dt(2022, 1, 1)) for k in "abc"], "issuer_cik string, accession string, origin_date timestamp_ntz, as_of_date timestamp_ntz")
    items = frame(spark, [("a", dt(2020, 2, 1), "4.02", 0), ("a", dt(2020, 2, 1), None, 1), ("b", dt(2020, 12, 31), None, 1), ("c", dt(2021, 1, 1), "4.02", 0)], "issuer_cik string, public_date timestamp_ntz, item_code string, item_metadata_missing int")
    none = frame(spark, [], "issuer_cik string, first_submission_date timestamp_ntz")
    cor = frame(spark, [], "issuer_cik string, public_date timestamp_ntz, correction_type string")
    got = {r.accession: (r.label_8k_402_365, r.k402_item_metadata_unknown_365, r.label_comment_thread_365) for r in panel.labels(f, none, cor, items).collect()}
    assert got == {"a": (1, 0, 0), "b": (None, 1, 0), "c": (0, 0, 0)}


FACT = "adsh string, tag string, taxonomy_version string, fact_date date, quarters int, unit string, segments string, coreg string, value_text string"


def fact_rows(spark, rows):
    return spark.createDataFrame([(*r[:2], "us-gaap/2020", None, *r[2:]) for r in rows], FACT).withColumn("value", facts.exact("value_text"))


def test_facts_conflict_priority_and_exactness(spark):
    f = fact_rows(spark, [
        ("x", "Assets", 0, "USD", None, None, "100"), ("x", "assets", 0, "USD", "seg", None, "999"), ("x", "SalesRevenueNet", 4, "USD", None, None, "7"), ("x", "Revenues", 1, None, None, None, "100"),
        ("x", "InventoryNet", 0, "USD", None, None, "9007199254740992"), ("x", "InventoryNet", 0, "USD", None, None, "9007199254740993"), ("x", "LongTermDebtCurrent", 0, "USD", None, None, "5"),
        ("x", "AssetsCurrent", 0, "USD", None, None, "60"), ("x", "LiabilitiesCurrent", 0, "USD", None, None, "20"), ("x", "LiabilitiesCurrent", 0, "USD", None, None, "20.0000"),
    ])
    r = facts.features(f).first()
    assert (r.xbrl_value_assets, r.xbrl_value_revenues, r.xbrl_coverage_inventory, r.xbrl_value_debt, r.xbrl_value_working_capital) == (100, 100, 0, 5, 40)
    assert r.xbrl_ratio_debt_to_assets == 0.05 and r.xbrl_ratio_leverage is None and math.isclose(r.xbrl_ratio_log_assets, math.log(101))
    assert audit.conflicts(f, facts.CONTEXT, "value").count() == 1


def test_year_over_year_needs_the_year_before(spark):
    rows = [("i", "a", "10-K", 2018, 100.0), ("i", "b", "10-K", 2019, 150.0), ("i", "c", "10-K/A", 2019, 999.0), ("i", "d", "10-K", 2021, 10.0), ("i", "e", "8-K", 2019, 5.0)]
    f = frame(spark, [(i, a, form, y, dt(y, 3, 1), dt(y, 3, 1), v) for i, a, form, y, v in rows], "issuer_cik string, accession string, form string, fiscal_year int, origin_date timestamp_ntz, acceptance_datetime timestamp_ntz, v double")
    got = {r.accession: (r.xbrl_ratio_v_yoy_change, r.xbrl_coverage_v_yoy) for r in facts.year_over_year(f, {"v": "v"}).collect()}
    assert got == {"a": (None, 0), "b": (0.5, 1), "c": (8.99, 1), "d": (None, 0), "e": (None, 0)}


def test_annual_pick_prefers_form_then_time(spark):
    rows = [("z-annual", "10-K", dt(2020, 3, 1, 8)), ("a-late", "10-K", dt(2020, 3, 1, 9)), ("b-null", " 10-k ", None), ("c", "10-K/A", dt(2020, 1, 1))]
    f = frame(spark, [("i", a, form, 2019, dt(2020, 3, 1), t) for a, form, t in rows], "issuer_cik string, accession string, form string, fiscal_year int, origin_date timestamp_ntz, acceptance_datetime timestamp_ntz")
    assert facts.annual_pick(f).first().accession == "z-annual"


def test_ranking_vector(spark):
    y = [0, 1, 0, 1, 0, 0, 1, 0, 0, 0]
    s = [0.1, 0.9, 0.2, 0.8, 0.7, 0.3, 0.4, 0.05, None, 0.15]
    df = frame(spark, list(zip(range(10), y, s)), "id int, y int, s double")
    r = ranking.top_fraction(df, "y", "s", "id", 0.3).first()
    assert (r.k, r.precision, r.sensitivity) == (3, 2 / 3, 2 / 3) and math.isclose(r.specificity, 6 / 7)
    ideal = sum(1 / math.log2(1 + k) for k in (1, 2, 3))
    assert math.isclose(r.ndcg, (1 / math.log2(2) + 1 / math.log2(3)) / ideal)
    m = ranking.ranking_metrics(df, "y", "s", least=1).first()
    pos, neg = [-1 if v is None else v for v, k in zip(s, y) if k], [-1 if v is None else v for v, k in zip(s, y) if not k]
    assert math.isclose(m.roc_auc, np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]))
    assert ranking.ranking_metrics(df, "y", "s").first().status == "blocked_sparse"
    ties = frame(spark, [(i, int(i < 2), 1.0) for i in range(20)], "id int, y int, s double")
    assert math.isclose(ranking.by_score(ties, "y", "s").agg(ranking.top_precision(0.1)).first()[0], 0.1)


def test_label_timing(spark):
    rows = [(1, 2018, 1, 1, 0), (2, 2018, 1, 0, 1), (3, 2018, 0, 0, 0), (4, 2019, 0, 0, 0), (5, 2019, 1, 0, 0)]
    d = labels.with_detection_year(frame(spark, rows, "k int, y int, t int, r0 int, r2 int"), "y", "t", ["r0", "r2"])
    assert [r.detection_year_proxy for r in d.orderBy("k").collect()] == [2018, 2019, None, None, None]
    of = lambda mode, year: {r.k: r.y_train for r in labels.matured(d, mode, year, "y", "t").collect()}
    assert of("naive", 2018) == {1: 1, 2: 1, 3: 0, 4: 0, 5: 1}
    assert of("proxy_drop_observed", 2018) == {1: 1, 2: 0, 3: 0, 4: 0}
    assert of("proxy_imputed_lag_1y", 2019) == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0} and of("proxy_imputed_lag_1y", 2020)[5] == 1
    with pytest.raises(ValueError):
        labels.matured(d, "other", 2019, "y", "t")


def test_links(spark):
    rows = [("ok", "A", "7.0", "1", "2001-02-01", "2003-05-01", "2002-01-01", None), ("ok", "B", "7", "1", "2003-01-01", "2003-02-01", None, None), ("ok", "A", "8", "2", None, "2003-05-01", None, None), ("name", "A", "9", "3", "2001-01-01", "2002-01-01", None, None), ("ok", "A", "5", "4", "2005-01-01", "2003-01-01", None, None)]
    l = frame(spark, rows, "link_desc string, source string, cik string, gvkey string, a string, b string, c string, d string")
    l = l.selectExpr("link_desc", "source", "cik", "gvkey", "cast(a as date) sec_start_date", "cast(b as date) sec_end_date", "cast(c as date) link_start_date", "cast(d as date) link_end_date")
    got = sorted((r.gvkey, r.data_year, r.issuer_cik, r.source) for r in overlap.annual_links(l, wanted="ok").collect())
    assert got == [("1", 2002, "0000000007", "A"), ("1", 2003, "0000000007", "A;B")]
    assert {r.data_year for r in overlap.annual_links(l, wanted="ok", rule="sec_window").collect()} == {2001, 2002, 2003}
    with pytest.raises(Exception, match="unsupported link source"):
        overlap.annual_links(l, names={"A": "a"}).collect()


def test_checks_fail_closed(spark):
    df = frame(spark, [(1, "a"), (1, "b"), (2, None), (2, None)], "k int, v string")
    for bad in (lambda: audit.assert_unique(df, ["k"]), lambda: audit.assert_no_conflict(df, ["k"]), lambda: audit.assert_known(df, ["v"]), lambda: audit.assert_not_negative(df.select((-F.col("k")).alias("n")), ["n"]), lambda: audit.only_row(df)):
        with pytest.raises(ValueError):
            bad()
    assert audit.assert_no_conflict(df.filter("k = 2"), ["k"]).count() == 2
    assert audit.usable_columns(df.withColumn("c", F.lit(1)), ["k", "v", "c"]) == ["k", "v"]


def test_tails_and_regression(spark):
    assert math.isclose(stats.t_tail(2.228, 10), 0.05, abs_tol=1e-4) and math.isclose(stats.f_tail(4.9646, 1, 10), 0.05, abs_tol=1e-4) and math.isclose(stats.normal_tail(1.96), 0.05, abs_tol=1e-4)
    r = np.random.default_rng(1)
    t, g = r.normal(size=400), np.repeat(np.arange(40), 10)
    y = 0.5 * t + r.normal(size=400)
    df = frame(spark, [(float(a), float(b), int(c)) for a, b, c in zip(y, t, g)], "y double, t double, g int")
    x = np.stack([np.ones(400), t], 1)
    b, e, inv = stats.ols(x, y)
    lever = np.einsum("ij,jk,ik->i", x, inv, x)
    hc3 = inv @ (x.T * (e / (1 - lever)) ** 2) @ x @ inv
    got = stats.residual_regression(df, "y", "t")
    assert math.isclose(got["coef"], b[1]) and math.isclose(got["std_err"], math.sqrt(hc3[1, 1]))
    u = np.stack([(x * e[:, None])[g == k].sum(0) for k in range(40)])
    cl = inv @ u.T @ u @ inv * 40 / 39 * 399 / 398
    got = stats.residual_regression(df, "y", "t", "g")
    assert math.isclose(got["std_err"], math.sqrt(cl[1, 1])) and got["p_value"] < 1e-6
    assert stats.residual_regression(df.withColumn("t", F.lit(1.0)), "y", "t")["status"] == "skipped_constant_treatment"


def test_breaks():
    r = np.random.default_rng(2)
    years = np.arange(2000, 2012, dtype=float)
    f, p = stats.break_test(years, np.where(years >= 2006, 0.5, 0.1) + r.normal(0, 0.01, 12), 2006)
    assert f > 50 and p < 1e-4


def test_folds(spark):
    assert list(labels.rolling_folds([2001, 2002, 2003, 2004], [None, 2], 2)) == [(None, 2003, [2001, 2002]), (None, 2004, [2001, 2002, 2003]), (2, 2003, [2001, 2002]), (2, 2004, [2002, 2003])]
    df = frame(spark, [(dt(y, 6, 1),) for y in range(2010, 2018)], "d timestamp_ntz")
    got = sorted((r.train_window, r.test_year, tuple(r.train_years)) for r in labels.mature_folds(spark, df, "d", "2017-01-01", [None, 2], 3).collect())
    assert got == [("expanding", 2014, (2010, 2011, 2012)), ("expanding", 2015, (2010, 2011, 2012, 2013))]
    assert labels.label_modes(["a", "lag_<N>", "a"], [1, 3]) == ["a", "lag_1", "lag_3"]


def test_models_have_statuses(spark):
    r = np.random.default_rng(3)
    rows = [(i, 2000 + i % 4, float(v), "ab"[i % 2], int(v + r.normal(0, 0.3) > 0)) for i, v in enumerate(r.normal(size=240))]
    df = frame(spark, rows, "id long, y long, v double, c string, label int")
    out, status = models.backtest(df, [models.Spec("logit", "logit", "undersample", {"maxIter": 10}), models.Spec("fixed", "fixed", "none")], [("w", 2003, [2000, 2001, 2002]), ("w", 2009, [2000])], "y", "label", ["v"], "id", ["c"])
    assert sorted((s.model, s.test_year, s.status) for s in status.collect()) == [("fixed", 2003, "fit"), ("fixed", 2009, "skipped_no_rows"), ("logit", 2003, "fit"), ("logit", 2009, "skipped_no_rows")]
    assert ranking.ranking_metrics(out.filter("model = 'logit'"), "label", "probability").first().roc_auc > 0.9
    _, _, s = models.fit_predict(models.Spec("x", "tree", "weights", {}), df.withColumn("label", F.lit(0)), df, "label", ["v"], "id")
    assert s == "skipped_one_class"


def test_runner_resumes(tmp_path):
    log, src = [], tmp_path / "in.txt"
    src.write_text("1")
    out = {n: str(tmp_path / "lake" / n) for n in "ab"}
    (tmp_path / "lake").mkdir()

    def act(n):
        return lambda: (log.append(n), sinks.write_json({"n": n}, out[n]), [out[n]])[2]

    work = lambda **s: [runner.Task("a", act("a"), [str(src)], s), runner.Task("b", act("b"), after=["a"])]
    r = runner.Runner(str(tmp_path / "marks"), [str(tmp_path / "lake")])
    assert r.run(work()) == {"a": True, "b": True} and r.run(work()) == {"a": False, "b": False}
    src.write_text("2")
    assert r.run(work()) == {"a": True, "b": True} and r.run(work(k=1)) == {"a": True, "b": True}
    import os

    os.remove(out["b"])
    assert r.run(work(k=1)) == {"a": False, "b": True} and log == ["a", "b"] * 3 + ["b"]
    with pytest.raises(ValueError):
        runner.remove_path(str(src), [str(tmp_path / "lake")])


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n")
    (tmp_path / "b.csv").write_text("name|id\ny|2\n")
    assert sorted(map(tuple, tables.read_csvs(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).select("id", "name").collect())) == [("1", "x"), ("2", "y")]
    df = tables.align(tables.read_any(spark, str(tmp_path / "a.csv")), "ID long, label string, missing double", {"label": ["NAME"]})
    assert df.dtypes == [("ID", "bigint"), ("label", "string"), ("missing", "double")] and tuple(df.first()) == (1, "x", None)
    assert archives.pick_members(["d/", "d/sub.txt", "SUB2.txt", "other"], "sub") == ["SUB2.txt", "d/sub.txt"]
    with pytest.raises(ValueError):
        archives.only_member(["a.csv", "b.csv"], ".csv")
    assert tables.source_or_empty(spark, str(tmp_path / "none.parquet"), "a long").count() == 0
    with pytest.raises(ValueError):
        sinks.write_by_year(df, str(tmp_path / "y"), "ID", [])


def test_seed_and_rounding(spark):
    assert 1 <= X.task_seed("a", 1) <= 2**31 - 2 and X.task_seed("a", 1) == X.task_seed("a", 1) != X.task_seed("a", 2)
    assert one(spark, X.half_up(F.col("x").cast("double")), "2.5") == 3


def test_order_of_input_does_not_matter(spark):
    rows = [("i%d" % (i % 7), "a%d" % i, ["UPLOAD", "CORRESP", "8-K", "10-K", "10-K/A"][i % 5], dt(2018 + i % 4, 1 + i % 12, 1 + i % 28)) for i in range(200)]
    cols = "issuer_cik string, accession string, form string, filing_date timestamp_ntz"
    a, b = frame(spark, rows, cols), frame(spark, rows[::-1], cols).repartition(5)
    assert audit.same_rows(events.comment_threads(a), events.comment_threads(b))
