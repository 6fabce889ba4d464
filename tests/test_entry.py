"""The entry module with and without the optional subpackage."""

import subprocess
import sys

HIDE = """
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("certus.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name="certus.llm" if name.startswith("certus") else name)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as e
print(len(e.queries()), any(q.startswith("op") or q == "pipeline" for q in e.queries()))
"""


def test_entry_works_without_the_subpackage():
    out = subprocess.run([sys.executable, "-c", HIDE], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 40 and out[1] == "False"


def test_entry_gives_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
