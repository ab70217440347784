"""The queries that don't depend on the optional folder are there whatever that folder needs."""

import subprocess
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[1])


def names(before: str) -> set[str]:
    code = f"import sys; sys.path.insert(0, {ROOT!r}); {before}; import __spark_entry__ as e; print('NAMES', *e.queries())"
    done = subprocess.run([sys.executable, "-B", "-c", code], capture_output=True, text=True, check=True, cwd=ROOT)
    return set(done.stdout.rpartition("NAMES")[2].split())


def test_a_missing_module_of_the_optional_folder_costs_no_other_query():
    from tiersmith.plans import catalog

    for module in ("public_tokenizers", "tiersmith.llm", "corpus_pipeline", "regex"):
        assert set(catalog.QUERIES) <= names(f"sys.modules[{module!r}] = None")
    assert names("sys.modules['public_tokenizers'] = None") == set(catalog.QUERIES)
