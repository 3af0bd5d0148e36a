import shutil
import subprocess
import sys
from pathlib import Path

from .conftest import SF

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_leave_the_time_zone_of_the_session(spark):
    import __spark_entry__ as entry

    spark.conf.set("spark.sql.session.timeZone", "Asia/Seoul")
    try:
        hours = entry.queries()["x03_times"](spark, SF).orderBy("event_id").limit(50)
        assert spark.conf.get("spark.sql.session.timeZone") == "Asia/Seoul"
        there = hours.collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert there == entry.queries()["x03_times"](spark, SF).orderBy("event_id").limit(50).collect()


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    for name in ("__spark_entry__.py", "catalogflow"):
        source = ROOT / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path / name)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(n.startswith('op') for n in q); print(len(q))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0 and int(said.stdout) > 100, said.stderr
