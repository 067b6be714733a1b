"""The driver's entry points, with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 80


def test_without_the_subpackage():
    """The library and its queries import where the subpackage and the pipeline are gone."""
    code = (
        "import sys\n"
        "sys.modules['eventgraph.llm'] = sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e\n"
        "from eventgraph.plans import registry\n"
        "assert set(e.queries()) == set(registry.QUERIES) and set(e.oracle_sql()) == set(registry.ORACLES)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)}, check=True)


def test_a_copy_without_the_folders(tmp_path):
    """With the folders of the subpackage, its tests and the pipeline deleted, queries are registered and a test file passes."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    env = os.environ | {"PYTHONPATH": str(copy)}
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > 80 and not [q for q in e.queries() if q.startswith('op')]"], cwd=copy, env=env, check=True)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", "tests/test_graph.py"], cwd=copy, env=env, check=True)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "eventgraph").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "eventgraph").parts:
            assert "eventgraph.llm" not in path.read_text()
