"""The other queries register when the text operators, or a library that only they need, are missing."""

import subprocess
import sys
from pathlib import Path

import pytest

CODE = """
import sys, warnings
warnings.simplefilter("ignore")
sys.modules[sys.argv[1]] = None
import __spark_entry__ as entry
from nidalytics.queries import QUERIES, SQL
assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(SQL), set(entry.queries()) ^ set(QUERIES)
"""


@pytest.mark.parametrize("missing", ["corpus_pipeline", "nidalytics.llm", "ahocorasick", "public_tokenizers", "tiktoken"])
def test_without(missing):
    root = Path(__file__).resolve().parents[1]
    if not (root / "corpus_pipeline.py").exists() and missing not in ("corpus_pipeline", "nidalytics.llm"):
        pytest.skip("there are no text operators")
    done = subprocess.run([sys.executable, "-c", CODE, missing], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
