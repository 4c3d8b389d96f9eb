import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_queries_and_sql_belong_together(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    for pipeline in (True, False):
        at = tmp_path / str(pipeline)
        shutil.copytree(os.path.join(ROOT, "tessera"), at / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        for name in ["__spark_entry__.py", "bench.py"] + ["corpus_pipeline.py"] * (pipeline and os.path.exists(os.path.join(ROOT, "corpus_pipeline.py"))):
            shutil.copy(os.path.join(ROOT, name), at)
        code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op1') for n in q), set(e.oracle_sql()) <= set(q))"
        done = subprocess.run([sys.executable, "-c", code], cwd=at, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
        assert done.returncode == 0, done.stderr
        assert done.stdout.split()[1:] == ["False", "False", "True"]
