"""Two publishers, one next version."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from lodestitch.sources import snapshots as S


def publish(spark, base, run, **more):
    return S.publish(spark, base, run, {"t": spark.range(2)}, **more)


def test_the_second_of_two_runs_from_one_version_is_refused(spark, tmp_path):
    base = str(tmp_path)
    assert publish(spark, base, "first", based_on=None) == 1
    assert publish(spark, base, "second", based_on="first") == 2
    with pytest.raises(S.PublishConflict, match="based on first"):
        publish(spark, base, "late", based_on="first")
    assert S.current_run(spark, base) == "second" and S.manifest(spark, base).count() == 2
    assert publish(spark, base, "free") == 3 and S.current_run(spark, base) == "free"


def test_runs_that_publish_at_once(spark, tmp_path):
    base = str(tmp_path)
    publish(spark, base, "first")

    def attempt(name):
        try:
            return publish(spark, base, name, based_on="first")
        except S.PublishConflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(attempt, [f"run-{i}" for i in range(4)]))
    assert sorted(x for x in found if x) == [2]
    assert S.current_run(spark, base) == f"run-{found.index(2)}"
    with ThreadPoolExecutor(3) as pool:
        assert sorted(pool.map(lambda n: publish(spark, base, n), ["a", "b", "c"])) == [3, 4, 5]


def test_a_claim_without_a_manifest_is_released(spark, tmp_path):
    base = str(tmp_path)
    publish(spark, base, "first")
    assert S._claim(spark, base, 2)
    with pytest.raises(S.PublishConflict, match="claimed"):
        publish(spark, base, "next", based_on="first")
    assert not S.release(spark, base, 1) and S.release(spark, base, 2) and not S.release(spark, base, 2)
    assert publish(spark, base, "again", based_on="first") == 2
