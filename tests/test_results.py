"""Result tables that several reports read."""

from conftest import SF
from knnhard.plans import results as RS


def test_a_result_table_whose_files_are_gone_is_written_again(spark, monkeypatch):
    monkeypatch.setattr(RS, "_WRITTEN", {})
    made = []

    def make():
        made.append(1)
        return spark.range(7)

    assert [RS._written(spark, SF, "seven", make).count() for _ in range(2)] == [7, 7] and len(made) == 1
    (key, (path, *rest)), = RS._WRITTEN.items()
    RS._WRITTEN[key] = path + "-emptied", *rest  # as if the shared folder had been cleared between two queries
    assert RS._written(spark, SF, "seven", make).count() == 7 and len(made) == 2
