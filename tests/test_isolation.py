"""The library and its queries load without the training-data operators."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

HIDDEN = """
import importlib.abc, sys

class Hide(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.startswith("shotspark.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)

sys.meta_path.insert(0, Hide())
import importlib.util
found = importlib.util.find_spec
importlib.util.find_spec = lambda name, package=None: None if name.startswith("shotspark.llm") else found(name, package)
import __spark_entry__
names, texts = __spark_entry__.queries(), __spark_entry__.oracle_sql()
assert set(texts) <= set(names) and "flagship_top_players" in names
assert not any(n == "pipeline" or n.startswith("op") and n[2].isdigit() for n in names)
assert not any(m.startswith("shotspark.llm") or m == "corpus_pipeline" for m in sys.modules)
"""


def test_queries_load_without_the_operators():
    run = subprocess.run([sys.executable, "-c", HIDDEN], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]


def test_library_does_not_import_the_operators():
    for folder in ("functions", "operators", "plans", "sources"):
        for name in os.listdir(os.path.join(ROOT, "shotspark", folder)):
            if name.endswith(".py"):
                with open(os.path.join(ROOT, "shotspark", folder, name)) as f:
                    assert "shotspark.llm" not in f.read()
