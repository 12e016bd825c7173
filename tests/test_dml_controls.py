from pyspark.sql import functions as F

from tidemark import api


def test_controls_are_whole(spark, tmp_path, monkeypatch):
    more = [f"xbrl_ratio_{i}" for i in range(25)] + ["note_word_count", "form_ap_filing_count", "filing_friction_days", "prior_letters"]
    gone = ["note_text_count", "missing_a", "xbrl_coverage_b", "prior_comment_thread_count"]
    day = F.to_timestamp(F.lit("2015-03-01")).cast("timestamp_ntz")
    p = spark.range(20).select(
        F.col("id").cast("string").alias("accession"), F.col("id").cast("string").alias("issuer_cik"), F.lit(2014).alias("fiscal_year"), F.lit(0).alias("censored_365"), F.lit(1).alias("is_domestic_us_gaap_proxy"),
        day.alias("origin_date"), day.alias("as_of_date"), *(F.lit(0).alias(c) for c in (*api.TASKS.values(), *api.EXCLUDED.values())), *(F.col("id").cast("double").alias(c) for c in more + gone),
    )
    p.write.parquet(f"{tmp_path}/p.parquet")
    seen = []

    def dml(df, target, treatment, controls, key, cluster=None, folds=3, seed=7, trees=10):
        seen.append((set(controls), folds))
        return {"status": "ok"}

    monkeypatch.setattr(api.models, "dml", dml)
    api.run_public_cascade(spark, f"{tmp_path}/p.parquet", f"{tmp_path}/out", 2014, 2014, sets=(), least_years=99)
    assert len(seen) == 3 and all(f == 3 and set(more) <= c and not c & set(gone) for c, f in seen)
