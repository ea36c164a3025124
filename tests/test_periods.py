from datetime import date

import numpy as np
import pytest

from strandline.functions import kernels as k
from strandline.operators.calendars import TimePeriod, year_to_date


def test_period_arithmetic():
    p = TimePeriod("2020-01-31", "2024-02-29")
    assert p.shifted(1, -1) == TimePeriod("2020-02-01", "2024-02-28") and TimePeriod(None, "2024-02-29").shifted(5).start is None
    assert p.years_to_end(1) == TimePeriod("2023-02-28", "2024-02-29") and TimePeriod("2020-01-31").years_to_end(1) == TimePeriod("2020-01-31")
    assert p.years() == 1490 / 365 and TimePeriod("2020-01-01").years(date(2020, 12, 31)) == 1.0
    assert p.label() == "31Jan2020 - 29Feb2024" and p.label(":", True) == "01Feb2020:29Feb2024" and TimePeriod("2020-01-31").label() == "31Jan2020 - "
    assert year_to_date(date(2024, 1, 1)) == TimePeriod("2022-12-31", "2023-12-31")
    with pytest.raises(ValueError):
        TimePeriod().years()


def test_markov_winsorising_keeps_the_last_clean_value():
    clean, mean, var, score = k.winsor_markov(np.array([1.0, 0.1, 9.0, np.nan, 0.2]), 0.5, 3.0, 0.0, 0.04)
    assert np.isnan(clean[0]) and clean[1] == clean[2] == 0.1 and np.isnan(clean[3]) and clean[4] == 0.2
    assert mean.tolist() == [0.0, 0.05, 0.05, 0.05, 0.125] and np.allclose(var[:4], [0.04, 0.02125, 0.02125, 0.02125])
    assert score[0] == 0 and np.isclose(score[1], 0.5) and score[2] > 3 and np.isnan(score[3])


def test_zero_is_neither_gain_nor_loss():
    up, down = k.up_down_vol(np.array([0.0, 2.0, 0.0, -1.0, 4.0]), 0.5)
    assert np.allclose(up**2, [10, 7, 7, 7, 11.5]) and np.allclose(down**2, [1, 1, 1, 1, 1])
    assert np.allclose(k.up_down_vol(np.array([2.0, 4.0]), 0.5, init="first")[0] ** 2, [4, 10])
