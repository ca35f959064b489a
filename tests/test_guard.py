import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_the_rest_works_without_the_training_data_part(tmp_path, sf_dir):
    for name in ("tidemark", "__spark_entry__.py"):
        src = ROOT / name
        if src.is_dir():
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and 'pipeline' not in q and not any(k.startswith('op1_') for k in q); assert set(e.oracle_sql()) <= set(q)"
    code += f"; from tidemark.session import local_session; s = local_session(2, '2g', 2); assert all(q[k](s, {sf_dir!r}).count() for k in ('snapshot_diff_counts', 'codec_roundtrip_orders', 'versioned_map_diff', 'proximity_pairs')) and e.entry(s).count()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_nothing_else_imports_it():
    for p in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "tidemark.llm" not in p.read_text() and "from .llm" not in p.read_text(), p
