"""The rest of the library stands without the corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest
from conftest import ROOT

PROBE = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q, 'shots' in q)"


def copied(tmp_path, *without):
    skip = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *without)
    return shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)


def probe(folder):
    out = subprocess.run([sys.executable, "-c", PROBE], cwd=folder, capture_output=True, text=True, timeout=120,
                         env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


@pytest.mark.parametrize("without", [("llm",), ("llm", "corpus_pipeline.py")])
def test_imports_without_the_corpus_operators(tmp_path, without):
    count, numbered, pipeline, shots = probe(copied(tmp_path, *without))
    assert int(count) > 90 and (numbered, pipeline, shots) == ("False", "False", "True")


def test_nothing_else_imports_the_corpus_operators():
    for folder, _, names in os.walk(os.path.join(ROOT, "frameflow")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert "llm" not in f.read(), name
