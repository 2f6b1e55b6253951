import sys
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from telltale.session import create_session  # noqa: E402

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = create_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
                       spark__driver__memory="6g", spark__ui__showConsoleProgress="false",
                       spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def small_blocks(spark):
    """Force every group above six rows into blocks."""
    spark.conf.set("spark.telltale.rowsPerBlock", "6")
    yield spark
    spark.conf.unset("spark.telltale.rowsPerBlock")


@pytest.fixture
def no_broadcast(spark):
    """Make every size check fail, so joins take their shuffle path."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.telltale.broadcastRows", "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.telltale.broadcastRows")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def at(seconds: float) -> datetime:
    return START + timedelta(seconds=seconds)


def stream_rows(spark, rows, **fixed):
    """Process-stream rows from dicts; metrics that are not given are 0."""
    from telltale.schemas import PROCESS_STREAM
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("seq", T.LongType())] + PROCESS_STREAM.fields)
    out = []
    for i, r in enumerate(rows):
        r = {"seq": i, "session_id": "s", "pid": 1, "exe": "a", "status": "running", **fixed, **r}
        r["timestamp"] = at(r.pop("t", i))
        out.append(tuple(r.get(f.name, None if f.name == "ppid" else (0.0 if f.dataType.typeName() == "double" else 0))
                         for f in schema.fields))
    return spark.createDataFrame(out, schema)


def by_seq(df, *columns):
    return {r.seq: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]]
            for r in df.select("seq", *columns).collect()}
