"""Operators take tables that no helper of the package read, in a process whose workers can't find the package."""

import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from cairn.llm import neighbours, simhash
v = s.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0)], "vec_id long, embedding array<double>, label int")
d = s.createDataFrame([(1, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
print("links", neighbours.near_vectors(v).filter("n_links = 1").count(), "groups", simhash.near_groups(d).select("component_id").distinct().count())
"""


def test_package_is_shipped(tmp_path):
    root = str(Path(__file__).resolve().parents[2])
    got = subprocess.run([sys.executable, "-c", CODE.format(root=root)], cwd=tmp_path, capture_output=True, text=True, timeout=280)
    assert "links 2 groups 1" in got.stdout, got.stderr[-2000:]
