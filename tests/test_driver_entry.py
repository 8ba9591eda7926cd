"""The driver's entry without the training-data folders; the shared folder."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from feedweave.sources import shared

TOP = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_training_folders(tmp_path, pipeline):
    shutil.copytree(TOP / "feedweave", tmp_path / "feedweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else [])):
        if (TOP / name).exists():
            shutil.copy(TOP / name, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_shared_folder_is_asked_for():
    class Unset:
        def get(self, *_):
            return None

    class Context:
        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Unset(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())
