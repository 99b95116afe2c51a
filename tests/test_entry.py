import os
import subprocess
import sys

from flowtide.plans.catalog import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_traffic_queries_survive_a_missing_package():
    """Without a package that only the document operators need, all other queries are there."""
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    names, twins = (line.split() for line in done.stdout.strip().splitlines()[-2:])
    assert set(names) == set(QUERIES) and set(twins) <= set(QUERIES)
