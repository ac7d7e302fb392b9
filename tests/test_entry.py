import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def run_in(folder, *args):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, *args], cwd=folder, env=env, capture_output=True, text=True, check=True).stdout


def names_in(folder):
    code = "import __spark_entry__ as e; print(sorted(e.queries())); print(sorted(e.oracle_sql()))"
    return [eval(x) for x in run_in(folder, "-c", code).splitlines()]


def test_without_the_corpus_package(tmp_path):
    """The other queries are there without the subpackage, with or without the pipeline, and after caches are left."""
    for n, gone in enumerate((["textloom/llm", "tests/llm"], ["textloom/llm", "tests/llm", "corpus_pipeline.py"])):
        copy = tmp_path / str(n)
        shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
        for x in gone:
            shutil.rmtree(copy / x) if (copy / x).is_dir() else (copy / x).unlink(missing_ok=True)
        (copy / "textloom/llm/__pycache__").mkdir(parents=True)
        queries, sql = names_in(copy)
        assert len(queries) > 50 and set(sql) <= set(queries)
        assert not [x for x in queries if x.startswith("op") or x == "pipeline"]
    # without both, a query runs, and all other tests are found and some of them run
    shared = tmp_path / "shared"
    code = f"""
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{shared}").getOrCreate()
print(e.queries()["docs_by_source"](spark, "/root/testdata/sf0.001").count() > 0, e.entry(spark).count() > 0)
"""
    assert run_in(copy, "-c", code).split()[-2:] == ["True", "True"]
    found = run_in(copy, "-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider")
    assert "ERROR" not in found and "test_web_crawl.py" in found and "tests/llm" not in found
    assert " passed" in run_in(copy, "-m", "pytest", "tests/test_scratch.py", "tests/test_query_tables.py", "-q", "-x", "-p", "no:cacheprovider", "-k", "dealt or folder or cover or bitmaps")
