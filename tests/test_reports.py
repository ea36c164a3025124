import pytest

from strandline.operators.reports import draw


def test_a_figure_of_more_rows_than_the_limit_is_refused(spark, tmp_path):
    table = spark.createDataFrame([(i, "a", float(i)) for i in range(11)], "ts long, asset string, value double")
    with pytest.raises(ValueError, match="more than 10 rows"):
        draw(table, "line", str(tmp_path / "x.png"), limit=10)
