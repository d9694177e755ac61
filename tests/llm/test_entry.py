import os
import re
import subprocess
import sys

import public_tokenizers
from conftest import SMALL

import __spark_entry__ as entry


def test_one_query_per_operator():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def test_python_tasks_need_no_package_on_the_executors(tmp_path):
    """From another folder the workers cannot import the package; all functions travel along."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "import __spark_entry__ as e\n"
        "from curveboard.session import local_session\n"
        "spark = local_session(4)\n"
        "for name, query in e.queries().items():\n"
        "    if name.startswith('op') or name == 'pipeline':\n"
        f"        print('rows', name, query(spark, {SMALL!r}).count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    env["PYTHONPATH"] = os.path.dirname(os.path.dirname(public_tokenizers.__file__))
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert out.stdout.count("rows") == 14, out.stderr[-2000:]
