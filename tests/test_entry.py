"""The driver's entry module without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), set(o) <= set(q), any(n[:2] == 'op' or n == 'pipeline' for n in q))"


def test_the_rest_stands_alone(tmp_path):
    shutil.copytree(os.path.join(ROOT, "colloquy"), tmp_path / "colloquy", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    counts = []
    # Nothing is left of the folder; a cache is left of it; a library of an operator is missing.
    for left in ((), ("colloquy/llm/__pycache__",), ("colloquy/llm",)):
        for folder in left:
            os.makedirs(tmp_path / folder, exist_ok=True)
        if left == ("colloquy/llm",):
            (tmp_path / "colloquy/llm/__init__.py").write_text("")
            (tmp_path / "colloquy/llm/catalogue.py").write_text("import a_library_that_is_not_there\n")
            (tmp_path / "corpus_pipeline.py").write_text("")
        out = subprocess.run([sys.executable, "-W", "ignore", "-c", SAYS], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
        n, known, llm = out.stdout.split()
        assert known == "True" and llm == "False"
        counts.append(int(n))
    assert len(set(counts)) == 1 and counts[0] > 60
