"""The entry without the llm folder, without the pipeline, and without both."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]


def registered(folder):
    code = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)
    return json.loads(done.stdout) if done.returncode == 0 else done.stderr


@pytest.mark.parametrize("gone", [(), ("corpus_pipeline.py",), ("skein/llm",), ("corpus_pipeline.py", "skein/llm")])
def test_what_is_taken_out_takes_only_its_own_queries(tmp_path, gone):
    shutil.copytree(REPO / "skein", tmp_path / "skein", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (REPO / name).exists():
            shutil.copy(REPO / name, tmp_path / name)
    for name in gone:
        at = tmp_path / name
        shutil.rmtree(at) if at.is_dir() else at.unlink(missing_ok=True)
    names, sql = registered(tmp_path)
    has_llm, has_pipeline = (tmp_path / "skein/llm").exists(), (tmp_path / "corpus_pipeline.py").exists()
    assert len([n for n in names if n[:2] == "op" and n[2:3].isdigit()]) == (13 if has_llm else 0)
    assert ("pipeline" in names) == (has_llm and has_pipeline)
    assert "keep_tail" in names and set(sql) <= set(names)


def test_another_missing_module_is_an_error(tmp_path):
    shutil.copytree(REPO / "skein", tmp_path / "skein", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path / "__spark_entry__.py")
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    assert "no_such_module" in registered(tmp_path)


def test_a_pipeline_elsewhere_on_the_path_is_not_taken(tmp_path, monkeypatch):
    (tmp_path / "elsewhere").mkdir()
    (tmp_path / "elsewhere/corpus_pipeline.py").write_text("def run(spark, sf_dir): ...\n")
    (tmp_path / "here").mkdir()
    shutil.copytree(REPO / "skein", tmp_path / "here/skein", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path / "here/__spark_entry__.py")
    monkeypatch.setenv("PYTHONPATH", str(tmp_path / "elsewhere"))
    names, _ = registered(tmp_path / "here")
    assert "pipeline" not in names and "keep_tail" in names
