import numpy as np

from massif.operators import kernels as K


def test_pit_is_filled():
    z = np.full((5, 5), 10.0)
    z[2, 2], z[0, 2] = 1.0, 5.0
    out = K.pit_fill(z)
    assert out[2, 2] == 10.0 and out[0, 2] == 5.0
    assert (K.pit_fill(np.arange(25.0).reshape(5, 5)) == np.arange(25.0).reshape(5, 5)).all()


def test_ramp_accumulates():
    z = np.repeat(np.arange(6.0)[:, None], 4, axis=1)
    acc = K.accumulation(z)
    assert acc.sum(axis=1).tolist() == [24, 20, 16, 12, 8, 4]


def test_strahler_third_order():
    z = np.full((9, 9), 100.0)
    for r in range(9):
        for c in range(9):
            z[r, c] = 10 * abs(c - 4) + r
    assert K.strahler(z, least=1).max() >= 2


def test_a_cliff_is_worn_and_mass_is_kept():
    z = np.zeros((9, 9))
    z[:, :4] = 1000.0
    out = K.mass_wasting(z)
    assert abs(out.sum() - z.sum()) < 1e-6 and out[4, 3] < 1000 and out[4, 4:].sum() > 0


def test_gentle_slopes_and_single_peaks_stay():
    ramp = np.repeat(np.arange(9.0)[:, None] * 10, 9, axis=1)
    assert (K.mass_wasting(ramp) == ramp).all()
    peak = np.zeros((5, 5))
    peak[2, 2] = 1000.0  # its own gradient is nought, those of its neighbours face it
    assert K.mass_wasting(peak)[2, 2] == 1000.0


def test_steepest_neighbour_takes_half_of_the_excess():
    z = np.array([[90.0, 90, 90], [300, 200, 0], [90, 90, 90]])
    out = K.mass_wasting(z)
    moved = (200 - np.tan(np.radians(30)) * 90) / 2
    assert abs(out[1, 1] - (200 - moved)) < 1e-9 and abs(out[1, 2] - moved) < 1e-9 and out[1, 0] == 300


def test_stream_power_lowers_slopes_and_stops_at_the_sea():
    z = np.repeat(np.arange(12.0)[:, None] * 20, 12, axis=1)
    out = K.stream_power(z, rounds=1)
    assert (out[1:-1, 1:-1] <= z[1:-1, 1:-1]).all() and (z - out).max() <= 10 and (out[1:-1, 1:-1] < z[1:-1, 1:-1]).any()
    assert (out[0] == z[0]).all() and K.stream_power(z - 500, rounds=1).min() == 0.0
    flat = np.full((8, 8), 50.0)
    assert (K.stream_power(flat) == flat).all()


def test_thinning():
    m = np.zeros((9, 15), bool)
    m[3:6, 2:13] = True
    t = K.thinned(m)
    assert 0 < t.sum() < 14 and not t[3].any()
