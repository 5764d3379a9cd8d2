"""The driver's contract, with and without the optional part."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_names_and_sql():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert len(queries) >= 75 and set(sql) <= set(queries) and all(map(callable, queries.values()))


def test_works_without_the_optional_part(tmp_path):
    for name in ("__spark_entry__.py", "lociweave"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "lociweave/llm")], check=True)
    code = "import __spark_entry__ as e; assert e.queries() and not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["position", "ref", "alt", "alt_count", "miss_count", "total"]
