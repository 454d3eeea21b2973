import pytest

from ticketlens.session import at_once, staged


def test_stagings_at_once_keep_their_order(spark):
    makers = [lambda n=n: staged(spark.range(n), "range") for n in (3, 0, 7)]
    assert [frame.count() for frame in at_once(spark, *makers)] == [3, 0, 7]
    assert at_once(spark) == []


def test_an_error_of_one_staging_is_raised(spark):
    def broken():
        raise ValueError("no such part")

    with pytest.raises(ValueError, match="no such part"):
        at_once(spark, broken, lambda: spark.range(1).count())


def test_jobs_keep_the_callers_properties(spark):
    spark.sparkContext.setLocalProperty("ticketlens.test", "yes")
    try:
        assert at_once(spark, lambda: spark.sparkContext.getLocalProperty("ticketlens.test")) == ["yes"]
    finally:
        spark.sparkContext.setLocalProperty("ticketlens.test", None)
