"""The entry points from another folder, and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code, folder, root):
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", f"import sys; sys.path.insert(0, {root!r})\n{code}"], cwd=folder, env=environment, capture_output=True, text=True, timeout=300)


def test_workers_find_the_package_from_another_folder(tmp_path, sf):
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as entry
print("rows", entry.queries()["anomaly_scores"].__wrapped__ is not None)
from mailquarry.operators import mime
from pyspark.sql import functions as F
entry.ship(spark)
df = spark.createDataFrame([("Content-Type: text/plain; charset=shift_jis\\n\\nx",)], "raw string")
print("parts", len(df.select(mime.decoded_parts("raw").alias("p")).first().p))
"""
    done = run(code, tmp_path, ROOT)
    assert "parts 1" in done.stdout, done.stderr[-2000:]


def test_import_without_the_subpackage(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    done = run("import __spark_entry__ as e; print('queries', len(e.queries()), sum(n.startswith('op') for n in e.queries()), set(e.oracle_sql()) <= set(e.queries()))", copy, str(copy))
    assert done.stdout.startswith("queries 1") and done.stdout.strip().endswith("0 True"), done.stderr[-2000:]
    (copy / "mailquarry" / "llm").mkdir()
    (copy / "mailquarry" / "llm" / "__init__.py").write_text("")
    (copy / "mailquarry" / "llm" / "queries.py").write_text("import no_such_library\n")
    (copy / "corpus_pipeline.py").write_text("")
    assert "no_such_library" in run("import __spark_entry__", copy, str(copy)).stderr           # a missing library is no reason to leave queries out
