import re
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark, sf):
    assert "resolution" in entry.entry(spark).columns


def test_core_does_not_need_the_llm_folder(tmp_path):
    """The entry file imports without it, and nothing else imports it."""
    for p in ROOT.glob("weftline/**/*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"(from|import) .*\bllm\b", p.read_text()), p
    (tmp_path / "weftline").mkdir()
    for p in ROOT.glob("weftline/**/*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            to = tmp_path / p.relative_to(ROOT)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(p.read_text())
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and 'pipeline' not in e.queries(); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
