import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from postmill import session

    folder = str(tmp_path_factory.mktemp("shared"))
    out = session.build("tests", "local[8]", 4, **{
        "spark.driver.memory": "6g", "spark.checkpoint.dir": folder, "spark.ui.showConsoleProgress": "false",
        "spark.sql.warehouse.dir": folder + "/warehouse"})
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()


@pytest.fixture
def rows():
    """Rows of a DataFrame as a sorted list of tuples."""

    def get(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=repr)

    return get
