"""The driver's contract."""

from __future__ import annotations

import json
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["query", "id", "codes", "bands", "rc", "rb", "best"]
    assert df.count() > 0


def test_imports_without_the_training_part(tmp_path):
    """Without the subpackage and the pipeline's file the rest imports and has its queries."""
    top = Path(entry.__file__).parent
    for path in top.rglob("*.py"):
        part = path.relative_to(top)
        if "llm" in part.parts or part.name == "corpus_pipeline.py" or part.parts[0] == "tests":
            continue
        (tmp_path / part).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / part).write_text(path.read_text())
    code = "import json, __spark_entry__ as e; print(json.dumps(sorted(e.queries())))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env={"PATH": "", "PYTHONPATH": str(tmp_path)})
    names = json.loads(out.stdout)
    assert "nominate_topk" in names and not any(n.startswith("op") for n in names)
