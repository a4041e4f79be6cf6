import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]


@pytest.fixture(scope="session")
def spark():
    from corpusloom.session import local_session

    session = local_session("8", shuffle_partitions=8, app="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def files_of(spark):
    """Source files with language, lines and declarations from ``{path: content}``."""
    from corpusloom.operators import extract
    from corpusloom.sources import corpus as src

    def build(files: dict[str, str], repo: str = "r"):
        rows = [(repo, p, len(c.encode()), c) for p, c in files.items()]
        df = spark.createDataFrame(rows, "repo string, path string, size_bytes bigint, content string")
        return extract.with_declarations(src.with_lines(src.code_files(df)))

    return build
