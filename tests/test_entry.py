"""The entry file works without its optional part, or a module that this needs."""

import subprocess
import sys

import pytest

from corpusforge.operators import reports

PROBE = """
import sys, warnings
sys.modules[{missing!r}] = None
warnings.simplefilter("error" if {quiet} else "ignore")
import __spark_entry__ as e
q, s = e.queries(), e.oracle_sql()
assert set(s) <= set(q) and "bm25_topk" in q
print(len([n for n in q if n.startswith("op") and n[2].isdigit()]), "pipeline" in q)
"""


@pytest.mark.parametrize(("missing", "quiet", "said"), [("corpusforge.llm", True, "0 False"), ("ahocorasick", False, "0 False"), ("corpus_pipeline", True, "13 False")])
def test_queries_without_a_module(missing, quiet, said):
    pytest.importorskip("corpusforge.llm.queries")
    root = reports.__file__.rsplit("/corpusforge/", 1)[0]
    done = subprocess.run([sys.executable, "-c", PROBE.format(missing=missing, quiet=quiet)], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert done.stdout.strip() == said


def test_rounds_that_are_never_enough_are_an_error(spark):
    make = lambda seed: spark.range(3).withColumnRenamed("id", "key")
    assert reports.until_enough(make, "key", 9, 3).count() == 9
    with pytest.raises(RuntimeError, match="4 rounds gave 12 rows"):
        reports.until_enough(make, "key", 10, 5, most_rounds=4)
