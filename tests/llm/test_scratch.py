import os
from pathlib import Path

from tapewright.llm.scratch import Scratch


def test_saved_tables_leave_no_shuffle(spark):
    found = lambda: {str(f) for f in Path(os.environ["SPARK_LOCAL_DIRS"]).rglob("shuffle_*.data")}
    before = found()
    saved = Scratch(spark, "test").save(spark.range(1000).repartition(4, "id"), "t")
    assert not found() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert saved.count() == 1000
