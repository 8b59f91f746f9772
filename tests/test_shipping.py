import subprocess
import sys

from pyspark import cloudpickle

import causalrisk  # noqa: F401
from causalrisk.operators.anomaly import mean_path, path_lengths
from causalrisk.operators.explain import path_contributions
from causalrisk.operators.retrieve import _unit_rows
from causalrisk.streaming.history import HistoryProcessor


def test_task_code_loads_where_the_package_is_not_installed(tmp_path):
    parts = [mean_path, path_lengths, path_contributions, _unit_rows, HistoryProcessor]
    (tmp_path / "code.bin").write_bytes(cloudpickle.dumps(parts))
    script = (
        "import pickle, importlib.util; assert importlib.util.find_spec('causalrisk') is None; "
        "f = pickle.load(open('code.bin', 'rb')); assert f[0](2) == 1.0; assert f[3]([[3.0, 4.0]]).tolist() == [[0.6, 0.8]]"
    )
    done = subprocess.run([sys.executable, "-I", "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert done.returncode == 0, done.stderr
