"""The entry module without the optional subpackage, and with a third-party module missing."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = """
import sys, warnings
warnings.simplefilter("ignore")
for name in sys.argv[1:]:
    sys.modules[name] = None
import __spark_entry__ as e
print(",".join(sorted(e.queries())))
print(",".join(sorted(e.oracle_sql())))
"""


def _keys(folder, *blocked):
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([str(folder), os.environ.get("PYTHONPATH", "")])}
    run = subprocess.run(
        [sys.executable, "-c", PROBE, *blocked], cwd=folder, env=env, capture_output=True, text=True, timeout=120
    )
    assert run.returncode == 0, run.stderr
    queries, oracles = run.stdout.strip().splitlines()[-2:]
    return set(queries.split(",")), set(oracles.split(","))


def _tree(tmp_path, *left_out):
    skip = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache")
    shutil.copytree(ROOT, tmp_path / "tree", ignore=lambda d, names: skip(d, names) | {
        n for n in names if os.path.relpath(os.path.join(d, n), ROOT) in left_out
    })
    return tmp_path / "tree"


def test_entry_without_the_subpackage_and_pipeline(tmp_path):
    from sparkcover.catalog import QUERIES

    tree = _tree(tmp_path, "sparkcover/llm", "tests/llm", "corpus_pipeline.py")
    queries, oracles = _keys(tree)
    assert queries == set(QUERIES) and oracles <= queries


def test_entry_with_a_pipeline_but_no_subpackage(tmp_path):
    from sparkcover.catalog import QUERIES

    queries, _ = _keys(_tree(tmp_path, "sparkcover/llm", "tests/llm"))
    assert queries == set(QUERIES)


def test_entry_with_a_third_party_module_missing():
    from sparkcover.catalog import QUERIES

    queries, _ = _keys(ROOT, "ahocorasick")
    assert set(QUERIES) <= queries


def test_entry_of_the_whole_tree_has_no_fewer_keys():
    from sparkcover.catalog import QUERIES

    queries, oracles = _keys(ROOT)
    assert set(QUERIES) <= queries and oracles <= queries
