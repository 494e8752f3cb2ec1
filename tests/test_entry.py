"""The driver's entry, with the training-data operators and without them."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert sum(r.n_pages for r in rows) == 200


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_does_not_need_the_training_operators(tmp_path):
    code = "import sys; sys.modules['quire.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pairing' in q and not any(n.startswith('op') for n in q); print(len(q), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    for path in (ROOT / "quire").rglob("*.py"):
        if "llm" not in path.parts:
            assert "quire.llm" not in path.read_text(encoding="utf-8")
