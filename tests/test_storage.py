from pathlib import Path
from urllib.parse import urlsplit

from textloom import storage


def test_clear_deletes_this_applications_tables_alone(spark):
    own, other = storage.scratch(spark, "x"), f"{storage.shared_dir(spark)}/textloom/other-application/y"
    local = lambda path: Path(urlsplit(path).path)
    for path in (own, other):
        spark.range(3).write.mode("overwrite").parquet(path)
    assert storage.cut(spark.range(5), "z").count() == 5
    storage.clear(spark)
    assert not local(own).exists() and local(other).exists()
    storage.clear(spark)  # nothing left to delete
    assert storage.cut(spark.range(5), "z").count() == 5
