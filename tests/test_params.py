import pytest

from stationmine.params import MineParams, check_target


@pytest.mark.parametrize(
    "bad",
    [
        {"ct": 0},
        {"extraction_type": "Full-Full"},
        {"neighborhood": "nearby"},
        {"interval": 0},
        {"thr": -1},
    ],
)
def test_bad_values_are_refused(bad):
    with pytest.raises(ValueError):
        MineParams(**bad)


def test_bad_target_is_refused():
    with pytest.raises(ValueError):
        check_target("Full")


def test_parts_of_the_type():
    p = MineParams(extraction_type="Empty-Increase")
    assert (p.side, p.second, p.by_reading) == ("Empty", "Increase", False)
    assert MineParams().by_reading
