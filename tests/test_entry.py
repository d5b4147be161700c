import duckdb

import __spark_entry__ as entry
from tests.conftest import SMALL_SF

TABLES = ["orders", "customer", "lineitem", "events"]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"win_m", "imagen_media", "status"} <= set(df.columns)


def test_every_oracle_has_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(o) >= 30


def test_selected_oracles_match_at_small_scale(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL_SF}/{t}.parquet')")
    q, o = entry.queries(), entry.oracle_sql()
    for name in ["survey_clean", "rake_month_diagnostics", "track_vote_month", "test_stats_first_last_week",
                 "report_weight_summary"]:
        sdf = q[name](spark, SMALL_SF)
        cols = sorted(sdf.columns)
        a = sorted(tuple(str(r[c]) for c in cols) for r in sdf.collect())
        cur = con.execute(o[name])
        names = [d[0] for d in cur.description]
        b = sorted(tuple(str(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall())
        assert len(a) == len(b), name
        assert a == b, name


def test_process_and_dashboard_end_to_end(spark):
    from tallyrake.plans.dashboard import dashboard
    from tallyrake.plans.process import process_survey
    from tallyrake.sources.driver_view import survey_view
    res = process_survey(spark, survey_view(spark, SMALL_SF), "pampeana")
    w = res.weighted
    assert {"peso_d", "peso_s", "peso_m"} <= set(w.columns)
    assert w.filter("peso_d is null or peso_s is null or peso_m is null").count() == 0
    d = dashboard(w, res.variables, res.targets, unit="m")
    assert d.tracking_score.count() > 0 and d.test.count() == 1
    assert d.report_weights.count() == 22


def test_the_library_stands_without_the_corpus_operators(tmp_path):
    """A copy without the corpus folder still lists its queries, with or without the pipeline's file."""
    import os
    import shutil
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "tallyrake"), tmp_path / "tallyrake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = ("import __spark_entry__ as e; q = e.queries(); "
            "assert len(q) > 50 and set(e.oracle_sql()) <= set(q) and 'pipeline' not in q and not any(k.startswith('op') for k in q)")
    for _ in range(2):
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
        if os.path.exists(os.path.join(root, "corpus_pipeline.py")):
            shutil.copy(os.path.join(root, "corpus_pipeline.py"), tmp_path)
