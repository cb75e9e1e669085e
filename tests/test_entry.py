"""The driver contract, with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.abspath(__spark_entry__.__file__))


def test_queries_and_oracles_fit():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and "eligibility_report" in queries
    if __spark_entry__.corpus is not None:
        assert sum(name.startswith("op") and name[2].isdigit() for name in queries) == 10 and "pipeline" in queries


def test_entry_without_the_corpus_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and out.stdout.split()[-1] == "False", out.stderr


def test_entry_with_only_the_two_folders_gone(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    code = "import warnings; warnings.simplefilter('ignore'); import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and out.stdout.split()[-1] == "False", out.stderr


def test_a_missing_dependency_of_the_corpus_operators_leaves_the_rest(tmp_path):
    code = "import sys, warnings; warnings.simplefilter('ignore'); sys.modules['ahocorasick'] = None; import __spark_entry__ as e; print('eligibility_report' in e.queries(), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and out.stdout.split()[-2:] == ["True", "False"], out.stderr
