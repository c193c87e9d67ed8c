"""The rest of the library and the entry module work where the corpus package is absent."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_the_corpus_package(tmp_path):
    shutil.copytree(f"{ROOT}/crawlframe", tmp_path / "crawlframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = ("import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'domain_stats' in q and set(q) == set(s);"
            "assert not any(n.startswith('op') or n == 'pipeline' for n in q)")
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_errors_inside_the_corpus_package_are_raised(tmp_path):
    shutil.copytree(f"{ROOT}/crawlframe", tmp_path / "crawlframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    (tmp_path / "crawlframe/llm").mkdir()
    (tmp_path / "crawlframe/llm/__init__.py").write_text("")
    (tmp_path / "crawlframe/llm/catalog.py").write_text("import no_such_module_at_all\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode != 0 and "no_such_module_at_all" in done.stderr
