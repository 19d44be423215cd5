"""The package reaches Python workers of a session that was started elsewhere."""

import os
import subprocess
import sys
import textwrap


def test_predict_from_another_folder(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = f"""
        import importlib.util, numpy as np
        spec = importlib.util.spec_from_file_location("entry", {os.path.join(repo, "__spark_entry__.py")!r})
        entry = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(entry)
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        print("ROWS", entry.queries()["predict"](spark, "/root/testdata/sf0.001").count())
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", textwrap.dedent(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 500" in ran.stdout, ran.stderr[-2000:]
