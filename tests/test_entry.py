"""The entry stands without the corpus operators' own libraries."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("library", ["ahocorasick", "tiktoken", "zstandard", "public_tokenizers"])
def test_entry_imports_without_a_library_of_the_operators(library):
    code = f"import sys; sys.modules[{library!r}] = None; import __spark_entry__ as e; assert len(e.queries()) >= 86 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
