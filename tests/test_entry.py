"""The driver's entry points with and without the corpus part."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q))"


def counted(blocked: list[str]) -> tuple[int, int]:
    """Numbers of all and of corpus queries where some modules cannot be imported."""
    block = f"import sys; sys.modules.update(dict.fromkeys({blocked!r})); sys.path.insert(0, {str(ROOT)!r}); "
    done = subprocess.run([sys.executable, "-B", "-c", block + COUNT], capture_output=True, text=True, cwd=os.sep, check=True)
    return tuple(map(int, done.stdout.split()))


@pytest.mark.parametrize("blocked", [["skyloom.llm", "corpus_pipeline"], ["skyloom.llm"], ["xxhash"]])
def test_engine_without_corpus_part(blocked):
    every, corpus = counted(blocked)
    # Without xxhash only the pipeline, which does not need it, is left of the corpus part.
    left = blocked == ["xxhash"] and (ROOT / "corpus_pipeline.py").exists() and (ROOT / "skyloom/llm").exists()
    assert every - corpus >= 80 and corpus == left


@pytest.mark.skipif(not (ROOT / "skyloom/llm").exists() or not (ROOT / "corpus_pipeline.py").exists(), reason="the corpus part is not there")
def test_pipeline_missing():
    operators = counted(["corpus_pipeline"])[1]
    assert operators >= 10 and counted([])[1] == operators + 1
