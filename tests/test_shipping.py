import subprocess
import sys
from pathlib import Path


def test_workers_import_the_package_from_anywhere(tmp_path):
    """A session whose workers start in another folder, without PYTHONPATH."""
    root = Path(__file__).resolve().parents[1]
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession, functions as F
from proseplane.operators import external
from proseplane.shipping import ship
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
ship(spark)
ship(spark)
def load():
    from proseplane.functions import rulebook
    return lambda ts: [float(len(rulebook.TRANSITIONS))] * len(ts)
assert spark.createDataFrame([("a",)], "t string").select(external.external_scores(F.col("t"), load)).first()[0] == 35.0
"""
    _run_elsewhere(code, tmp_path)


def test_stream_state_from_anywhere(tmp_path):
    """The worker that sets up a stream's state gets no Python files of the session."""
    root = Path(__file__).resolve().parents[1]
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
from proseplane.shipping import ship
from proseplane.streaming import monitor
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
ship(spark)
rows = spark.createDataFrame([(k, k, "s", k % 2, k * 1000, 5) for k in range(10)], "arrival long, id long, source string, shard long, at long, total long")
rows.write.parquet("in")
monitor.follow(spark.readStream.schema(rows.schema).parquet("in"), "out", "state")
assert [(r["source"], r["n"], r["total"]) for r in monitor.levels(spark.read.parquet("out")).collect()] == [("s", 10, 50)]
"""
    _run_elsewhere(code, tmp_path)


def _run_elsewhere(code: str, tmp_path: Path) -> None:
    env = {"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)} | {k: v for k, v in __import__("os").environ.items() if k not in ("PYTHONPATH",)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
