import numpy as np
import pytest

from galeway.functions import geo
from galeway.grid import GridSpec


def test_known_distances():
    m, az = geo.np_inverse(0, 0, [1, 0], [0, 1])
    assert np.allclose(m, [111319.4908, 110574.3886], atol=1e-3)
    assert np.allclose(az, [90, 0])


def test_same_and_antipodal_points():
    m, az = geo.np_inverse([5, 0], [5, 0], [5, 180], [5, 0])
    assert m[0] == 0 and np.isnan(az[0]) and 19.9e6 < m[1] < 20.1e6


def test_rhumb_on_the_equator_and_meridian():
    assert np.allclose(geo.np_rhumb(0, 44.5, [1, 0, -1, 0], [44.5, 45.5, 44.5, 43.5]), [90, 0, 270, 180])
    assert abs(float(geo.np_rhumb(0, 44.5, 1, 45.5)) - geo.np_rhumb(0, 44.5, 1, 45.5)) == 0


def test_equal_earth_round_trip():
    lon, lat = np.array([-170.0, 0, 33, 120]), np.array([-80.0, 0, 45, 60])
    back = geo.np_equal_earth_inverse(*geo.np_equal_earth(lon, lat))
    assert np.allclose(back[0], lon) and np.allclose(back[1], lat)


def test_aspect_has_no_negative_root():
    assert np.isinf(geo.np_aspect(np.array([90.0]))).all()


@pytest.mark.parametrize("bad", [dict(nrow=0), dict(xmin=9, xmax=9)])
def test_grid_needs_an_extent(bad):
    with pytest.raises(ValueError):
        GridSpec(**({"nrow": 2, "ncol": 2, "xmin": 0.0, "xmax": 2.0, "ymin": 0.0, "ymax": 2.0} | bad))


def test_field_needs_degrees():
    with pytest.raises(ValueError):
        GridSpec(2, 2, 0, 400, 0, 2).check_lonlat()
