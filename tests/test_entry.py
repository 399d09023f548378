"""The registry works without the training-data operators."""

import subprocess
import sys

CODE = """
import sys
sys.modules["shopstream.llm"] = None
sys.modules["corpus_pipeline"] = None
import __spark_entry__ as e
assert len(e.queries()) > 50 and not any(n.startswith("op1_") for n in e.queries()) and "pipeline" not in e.queries()
assert set(e.oracle_sql()) <= set(e.queries())
"""


MISSING = """
import sys
sys.modules["public_tokenizers"] = None
try:
    import __spark_entry__
except ModuleNotFoundError as error:
    assert error.name == "public_tokenizers"
else:
    raise SystemExit("corpus_pipeline" in sys.modules)
"""


def test_other_missing_modules_are_told():
    subprocess.run([sys.executable, "-c", MISSING], check=True)


def test_entry_without_the_package():
    subprocess.run([sys.executable, "-c", CODE], check=True)
