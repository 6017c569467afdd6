"""Every registered query against its SQL, on the smallest tables."""

import pytest

from palimpsest.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, small, oracle, same):
    ours = registry.QUERIES[name](spark, small).toPandas()
    if name in registry.SQL:
        same(ours, oracle(registry.SQL[name]))
    else:
        assert len(ours)


def test_entry_imports_without_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for p in ("palimpsest", "__spark_entry__.py"):
        (shutil.copytree if (root / p).is_dir() else shutil.copy)(root / p, tmp_path / p)
    shutil.rmtree(tmp_path / "palimpsest" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'layer_resolution' in q and not any(n.startswith('op1_') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
