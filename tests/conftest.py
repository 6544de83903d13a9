import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidewater import session

    warehouse = tmp_path_factory.mktemp("warehouse")
    made = session(
        "tests", spark__master="local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__sql__warehouse__dir=str(warehouse), spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoint")), spark__driver__memory="3g",
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture
def engine(spark):
    from tidewater import Engine

    made = Engine(spark)
    people = "id bigint, name string, dept bigint, salary int, boss bigint"
    rows = [(1, "Ann", 1, 50, None), (2, "Bob", 1, 60, 1), (3, "Cyd", 2, None, 1), (4, "O'Neil \"x\" \\", None, 60, 2), (5, "Ümit", 2, 70, 9)]
    made.register("people", spark.createDataFrame(rows, people))
    made.register("depts", spark.createDataFrame([(1, "Ops"), (2, "Lab"), (3, "Void")], "id bigint, name string"))
    made.register("nothing", spark.createDataFrame([], "id bigint, name string"))
    return made
