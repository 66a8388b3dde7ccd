from pathlib import Path

import pytest
from pyspark.sql import functions as F

from keyreel.llm.common import cut_table, drop


def files(table):
    return sorted(p for p in Path(table._keyreel_path.removeprefix("file:")).rglob("*") if p.is_file())


def test_tables_of_steps_make_one_file_a_task_and_are_verified(spark):
    df = spark.range(0, 3000, 1, 3).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    t = cut_table(df)
    assert sorted(t.collect()) == sorted(df.collect())
    assert [p.name.split("-")[0] for p in files(t)] == ["_SUCCESS", "part", "part", "part"]  # no checksum files beside them
    at = files(t)[1]
    broken = bytearray(at.read_bytes())
    broken[len(broken) // 2] ^= 1  # in a page of texts
    at.write_bytes(broken)
    with pytest.raises(Exception, match="(?i)checksum|crc"):
        t.agg(F.sum(F.length("text")), F.max("text")).collect()
    drop(t)
    assert not at.parent.exists()
