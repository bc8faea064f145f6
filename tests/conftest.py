import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from vigie.session import local_session

    folder = {"spark.checkpoint.dir": tempfile.mkdtemp(prefix="vigie-ckpt-")}
    s = local_session("*", shuffle_partitions=8, app="vigie-tests", extra=folder)
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="vigie-test-")


def rows(df, *cols):
    """Rows as tuples of the given columns, sorted with NULLs first."""
    cols = cols or tuple(df.columns)
    out = [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]
    return sorted(out, key=lambda t: tuple((v is not None, str(v)) for v in t))
