"""The other queries stay where the training-data subpackage can't be imported."""
import subprocess
import sys

import pytest

import __spark_entry__ as entry

OWN = {name for module in entry.MODULES for name in module.QUERIES}


@pytest.mark.parametrize("gone", ["pricematch.llm", "corpus_pipeline", "tokenizers_of_another_release"])
def test_entry_without(gone):
    code = f"""
import sys, types, warnings
warnings.simplefilter("ignore")
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == {gone!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
        if name == "pricematch.llm" and {gone!r}.startswith("tokenizers"):
            raise ModuleNotFoundError("No module named 'tokenizers'", name="tokenizers")
sys.meta_path.insert(0, Gone())
import __spark_entry__ as entry
print(*sorted(entry.queries()), "|", *sorted(entry.oracle_sql()))
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=entry.os.path.dirname(entry.__file__), check=True)
    queries, sql = (set(x.split()) for x in done.stdout.split("|"))
    assert queries == sql == OWN
