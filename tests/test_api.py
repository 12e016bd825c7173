"""The flows end to end on toy studies."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark import api
from tidemark.operators.models import Spec
from tidemark.sources.archives import make_zip, to_json

QUICK = Spec("logit", "logit", "weights", {"maxIter": 5})


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("lake")
    r = random.Random(1)
    subs, sub, num, ap = {}, ["adsh\tcik\tform\tperiod\tfiled\tfy\tfp"], ["adsh\ttag\tversion\tddate\tqtrs\tuom\tsegments\tcoreg\tvalue"], ["Form Filing ID,Issuer CIK,Engagement Partner ID,Fiscal Period End Date,Filing Date,Number of Participants"]
    for k in range(1, 13):
        rows = []
        for y in range(2010, 2020):
            rows.append((f"{k}-{y}-a", f"{y}-03-0{1 + k % 8}", f"{y - 1}-12-31", "10-K", "", ""))
            if r.random() < 0.5:
                rows.append((f"{k}-{y}-b", f"{y}-06-15", f"{y - 1}-12-31", "10-K/A", "", "part III"))
            if r.random() < 0.5:
                rows.append((f"{k}-{y}-c", f"{y}-09-15", "", "8-K", r.choice(["4.02", "5.02,9.01", ""]), ""))
            if r.random() < 0.6:
                rows.append((f"{k}-{y}-d", f"{y}-08-01", "", r.choice(["UPLOAD", "CORRESP"]), "", ""))
            sub.append(f"{k}-{y}-a\t{k}\t10-K\t{y - 1}1231\t{y}0301\t{y - 1}\tFY")
            for tag, v in (("Assets", 100 + k * y % 97), ("Liabilities", 40 + y % 7), ("Revenues", 10 + r.randint(0, 50))):
                num.append(f"{k}-{y}-a\t{tag}\tus-gaap\t{y - 1}1231\t0\tUSD\t\t\t{v}.5")
            ap.append(f"{k}{y},{k},P{k % 3},12/31/{y - 1},05/01/{y},{k % 4}")
        recent = dict(zip(("accessionNumber", "filingDate", "reportDate", "form", "items", "primaryDocDescription"), map(list, zip(*rows))))
        subs[f"CIK{k:010d}.json"] = to_json({"cik": str(k), "name": f"Firm {k} Inc", "sic": "10", "filings": {"recent": recent}})
    for name, members in {"subs": subs, "facts": {"sub.txt": "\n".join(sub) + "\n", "num.txt": "\n".join(num) + "\n"}, "notes": {"txt.txt": "adsh\ttag\ttxt\n1-2010-a\tT\thello\n"}, "ap": {"a.csv": "\n".join(ap) + "\n"}}.items():
        (d / f"{name}.zip").write_bytes(make_zip(members))
    z = lambda n: [str(d / f"{n}.zip")]
    got = api.build_lake(spark, str(d / "lake"), z("subs"), z("facts"), z("notes"), z("ap"))
    assert got["tables"]["issuer_dim"] == 12 and got["tables"]["xbrl_core_fact"] == 360 and got["tables"]["partner_issuer_engagement"] == 120
    panels = api.build_panels(spark, str(d / "lake"), str(d / "gold"), "2020-06-30")
    assert panels["issuer_origin_panel"] == 120
    return d


def test_panel_has_all_features(spark, lake):
    p = spark.read.parquet(f"{lake}/gold/issuer_origin_panel.parquet")
    assert {"xbrl_ratio_leverage", "xbrl_ratio_revenues_yoy_change", "form_ap_filing_count", "auditor_partner_prior_other_issuer_total_count", "public_history_8k_402_3y_count", "note_text_count", "label_8k_402_365"} <= set(p.columns)
    assert p.filter("xbrl_value_assets is null").count() == 0 and p.filter("fiscal_year = 2012 and xbrl_ratio_revenues_yoy_change is null").count() == 0
    years = spark.read.parquet(f"{lake}/gold/filing_origin_panel.parquet").select("year").distinct().count()
    assert years == 10


def test_cascade_and_peers(spark, lake):
    panel = f"{lake}/gold/issuer_origin_panel.parquet"
    got = api.run_public_cascade(spark, panel, f"{lake}/cascade", 2009, 2019, ("xbrl",), (None,), 6, QUICK, jobs=2, with_dml=False)
    assert got["status"] == "complete" and got["fits"] > 0
    fam = got["families"]
    assert fam["all"] == sum(n for f, n in fam.items() if f != "all")
    peers = api.run_public_peer_comparison(spark, panel, f"{lake}/peers", "amendment", {"leverage": ["xbrl_ratio_leverage"], "size": ["none", "xbrl_ratio_log_assets"], "lost": ["nothing"]}, [2018])
    assert peers["mapping_quality"] == "partial" and peers["cells"] == 10 and peers["fits"] == 7


def test_bridge_linkage_and_overlap(spark, lake):
    raw = [(g, y, int((g + y) % 3 == 0), 0, int((g + y) % 3 == 0), str(g), f"Firm {g} Inc", g * 0.1, (g * y) % 7 * 1.0) for g in range(1, 13) for y in range(2009, 2019)]
    df = spark.createDataFrame(raw, "gvkey long, data_year long, target int, r0 int, r1 int, cik string, company_name string, f1 double, f2 double")
    df.write.parquet(f"{lake}/raw.parquet")
    links = spark.createDataFrame([("ok", "A", f"{g}.0", str(g), "2008-01-01", "2019-12-31", None, None) for g in range(1, 11)], "link_desc string, source string, cik string, gvkey string, sec_start_date string, sec_end_date string, link_start_date string, link_end_date string")
    links.write.parquet(f"{lake}/links.parquet")
    extra = spark.createDataFrame([("10", "99", 2009, 2019), ("11", "11", 2000, None)], "gvkey string, issuer_cik string, first_year int, last_year int")
    extra.write.parquet(f"{lake}/extra.parquet")
    assert api.prepare_crosswalk(spark, f"{lake}/extra.parquet", f"{lake}/raw.parquet", f"{lake}/x")["rows"] == 20
    l = api.build_primary_linkage(spark, f"{lake}/links.parquet", f"{lake}/raw.parquet", f"{lake}/linkage", f"{lake}/x", "ok")
    assert l == {"rows": 110, "raw_keys": 120, "linked_keys": 110, "conflicts": 10}
    probe = lambda out, **k: api.run_bridge_probe(spark, f"{lake}/raw.parquet", f"{lake}/{out}", **k)
    assert probe("b1", crosswalk=f"{lake}/linkage/linkage.parquet", issuer_panel=f"{lake}/gold/issuer_origin_panel.parquet")["status"] == "crosswalk_available"
    found = probe("b2", issuers=f"{lake}/lake/issuer_dim.parquet")
    assert (found["status"], found["matched_rows"]) == ("candidate_crosswalk_available", 120)
    assert probe("b3")["status"] == "public_identifier_blocker"
    df.drop("cik", "company_name").write.parquet(f"{lake}/bare.parquet")
    assert api.run_bridge_probe(spark, f"{lake}/bare.parquet", f"{lake}/b4")["status"] == "raw_identifier_blocker"
    o = api.run_construct_overlap(spark, f"{lake}/raw.parquet", f"{lake}/linkage/linkage.parquet", f"{lake}/gold/issuer_origin_panel.parquet", f"{lake}/overlap", "target", ["r0", "r1"])
    assert o["status"] == "complete" and o["tiers"] == {"high_confidence": 110, "dropped": 10}
    assert api.run_construct_overlap(spark, f"{lake}/none", f"{lake}/none", f"{lake}/none", f"{lake}/blocked", "target")["status"] == "blocked"
    b = api.run_benchmark(spark, f"{lake}/raw.parquet", f"{lake}/bench", ["f1", "f2"], "target", offsets=["r0", "r1"], modes=("naive", "proxy_drop_observed"), windows=(None,), least_years=8, spec=QUICK)
    assert b["status"] == "complete" and b["cells"] == 4 and b["fits"] == 4
    p = api.prep(spark, f"{lake}/raw.parquet", f"{lake}/prep", "target", "data_year", "gvkey")
    assert p["train"] == 108 and p["holdout"] == 12


def test_small_datasets(spark, lake):
    (lake / "d.zip").write_bytes(make_zip({"a.csv": "x,y\n1,2\n3,4\n"}))
    assert api.materialize_raw_dataset(spark, str(lake / "d.zip"), str(lake / "m"))["rows"] == 2
    assert api.materialize_sample_dataset(spark, f"{lake}/gold/issuer_origin_panel.parquet", f"{lake}/s", "issuer_cik", 3)["rows"] == 30
    p, parts = api.opacity(spark.createDataFrame([(1, 0, None)], "missing_a int, xbrl_coverage_b int, note_text_count int"))
    assert len(parts) == 3 and p.select(F.col("missingness_density_score")).first()[0] == 1.0
