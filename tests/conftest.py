from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from harrow.session import local_session  # noqa: E402

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, shuffle_partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data() -> str:
    if not DATA.exists():
        pytest.skip("no test data here")
    return str(DATA)


def _variant(tmp: Path, change) -> str:
    import pyarrow.parquet as pq

    for path in DATA.glob("*.parquet"):
        pq.write_table(change(path.stem, pq.read_table(path)), tmp / path.name)
    return str(tmp)


@pytest.fixture(scope="session")
def empty_data(tmp_path_factory) -> str:
    """Every growing table without rows; the fixed tables as they are."""
    if not DATA.exists():
        pytest.skip("no test data here")
    fixed = {"title_hooks", "list_sources", "lead_files", "call_limits"}
    return _variant(tmp_path_factory.mktemp("empty"), lambda name, t: t if name in fixed else t.slice(0, 0))


@pytest.fixture(scope="session")
def odd_data(tmp_path_factory) -> str:
    """Every growing table twice over, with rows of NULLs and extra columns whose names clash with inner ones."""
    if not DATA.exists():
        pytest.skip("no test data here")
    import pyarrow as pa

    fixed = {"title_hooks", "list_sources", "lead_files", "call_limits"}

    def change(name, t):
        if name in fixed:
            return t
        nulls = pa.table({f.name: pa.nulls(2, f.type) for f in t.schema}, schema=pa.schema([pa.field(f.name, f.type) for f in t.schema]))
        t = pa.concat_tables([t, t.slice(0, 20), nulls], promote_options="permissive")
        for extra in ("n", "k", "key", "rank", "name", "core", "web", "mail", "t", "tokens", "items", "page", "size", "bucket"):
            if extra not in t.column_names:
                t = t.append_column(extra, pa.array([str(i % 3) for i in range(len(t))]))
        return t

    return _variant(tmp_path_factory.mktemp("odd"), change)
