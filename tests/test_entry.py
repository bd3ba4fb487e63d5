"""The driver's file can be read before any session is there."""

import subprocess
import sys
from pathlib import Path


def test_entry_needs_no_session():
    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert 'pck_threshold_sweep' in q and set(o) <= set(q) and len(o) > 90"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, check=True, timeout=120)
