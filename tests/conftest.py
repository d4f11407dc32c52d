import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gaugework.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        4, "gaugework-tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"}
    )
    yield session
    session.stop()


@pytest.fixture
def readings_of(spark):
    """Readings from (id, node, value, time) with time as text; values may be text."""

    def make(rows, kind="string"):
        data = [
            (i, node, None if value is None else (str(value) if kind == "string" else float(value)), at, "Good", at)
            for i, node, value, at in ((*row[:3], datetime.fromisoformat(row[3])) for row in rows)
        ]
        return spark.createDataFrame(
            data,
            f"id bigint, node_id string, value {kind}, timestamp timestamp, quality string, created_on timestamp",
        )

    return make


@pytest.fixture
def variables_of(spark):
    """Variables from (id, formula[, minutes[, deadline]])."""

    def make(*rows):
        data = []
        for row in rows:
            number, formula, minutes, deadline = (*row, 0, None)[:4] if len(row) < 4 else row
            deadline = datetime.fromisoformat(deadline) if deadline else None
            data.append((number, f"V{number}", formula, "SINGLE", minutes, deadline, False))
        return spark.createDataFrame(
            data,
            "variable_id bigint, variable_name string, pre_save_formula string, formula_type string, "
            "time int, time_interval timestamp, is_deleted boolean",
        )

    return make
