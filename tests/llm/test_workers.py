import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.append({repo!r})  # of the driver alone
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
settings = lambda: {{r["key"]: r["value"] for r in spark.sql("SET").collect() if "warehouse" not in r["key"]}}
before = settings()
from gridloom.llm import registry
from gridloom.plans.scratch import TABLES, _own_folder, released
for name, query in registry.queries().items():
    assert query(spark, "/root/testdata/sf0.001").count() > 0 or name == "op2_license_scan", name
assert before == settings(), set(before.items()) ^ set(settings().items())
assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
released(spark)
import os
assert not TABLES and not os.listdir(_own_folder())
print("done")
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    """All queries, run where Python workers can't import the package; then nothing is left in the scratch folder."""
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(repo=REPO))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert out.stdout.strip().endswith("done"), out.stderr[-3000:]
