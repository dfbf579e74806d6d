"""Python workers find the package also where the session starts outside of the repository."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import functions as F
from voteframe.operators.scoring import score_responses
from voteframe.session import build_session, ship_package
spark = build_session("outside", "local[2]", **{{"spark.ui.enabled": "false"}})
df = spark.range(3).select(F.array(F.array(F.lit(-1.0)), F.array(F.lit(-3.0))).alias("logprobs"))
print("scored", score_responses(df, 1).count(), score_responses(df, 1).first().mean_group_confidence, ship_package(spark))
"""


def test_arrow_operators_run_outside_the_repository(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "scored 3 2.0 True" in run.stdout, run.stderr[-2000:]
