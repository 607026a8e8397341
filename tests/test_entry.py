"""The registry: every query beside its SQL on the smallest tables, and life without the llm folders."""

import os
import shutil
import subprocess
import sys

import pytest

from kgloom import catalog
from tests.oracle import compare, duck

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
FEW = ["s1_parse_nt", "a29_schema_graph", "t1_windows_with_failures", "a17_snapshot_statistics", "a28_yearly_diff", "g2_components", "g3_links_strong_normal", "c2_rule_classes", "k9_nquads", "a41_class_labels"]


@pytest.mark.parametrize("name", FEW)
def test_query_equals_sql(spark, sf, name):
    assert compare(spark, duck(sf), catalog.queries()[name], catalog.oracle_sql()[name], sf) is None


def test_names_agree():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and len(catalog.queries()) > 100


def test_imports_without_llm(tmp_path):
    for part in ("kgloom", "__spark_entry__.py"):
        src = os.path.join(REPO, part)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / part)
    shutil.rmtree(tmp_path / "kgloom" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
