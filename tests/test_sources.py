import numpy as np
import pytest

from galeway.plans.iterate import register
from galeway.sources import genetics
from galeway.sources import series as src


@pytest.fixture()
def archive(tmp_path):
    lon, lat = np.array([260.0, 261, 262]), np.array([40.0, 41])
    (tmp_path / "wnd10m").mkdir()
    for d in (1, 2):
        u = np.arange(24 * 6, dtype=float).reshape(24, 2, 3) + d
        np.savez(tmp_path / "wnd10m" / f"197901{d:02d}.npz", lon=lon, lat=lat, hour=np.arange(24), u=u, v=-u)
    np.savez(tmp_path / "land.npz", lon=lon, lat=lat, soil=np.array([[1.0, np.nan, 2], [np.nan, 3, 4]]))
    return str(tmp_path)


def test_hyperslab(spark, archive):
    df = src.read_reanalysis(spark, archive, days=[1, 2], hlim=(3, 4), xlim=(260, 261))
    rows = df.where("lat >= 41").collect()
    assert len(rows) == 8 and {r.hour for r in rows} == {3, 4} and {r.lat for r in rows} == {41.0}
    s = src.gridded(df)
    assert (s.grid.nrow, s.grid.ncol) == (2, 2) and s.df.count() == 16 and s.df.agg({"step": "max"}).first()[0] == 3


@pytest.mark.parametrize("bad", [dict(years=[1960]), dict(months=[13]), dict(days=[0]), dict(xlim=(-5, 10))])
def test_requests_are_checked(spark, archive, bad):
    with pytest.raises(ValueError):
        src.read_reanalysis(spark, archive, **bad)


def test_only_dates_are_read():
    assert src._days([1980], [2], [29, 30]) == [(1980, 2, 29)]


def test_land(spark, archive):
    assert sorted((r.lat, r.lon, r.w) for r in src.read_land_mask(spark, archive).collect())[:3] == [(40, 260, 1), (40, 261, 0), (40, 262, 1)]


def test_site_and_genotype_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text('"ID","name","longitude","latitude","n"\n1,7,-4.8,57.9,2\n2,8,3,54,1\n')
    sites = genetics.read_sites(spark, str(tmp_path / "s.csv"))
    register(sites=sites)
    assert spark.sql("select sum(n) from sites").first()[0] == 3
    (tmp_path / "g.txt").write_text("title\nA, B\npop\nx1, 168170 000000\nx2, 164164 098112\npop\ny1, 160162 100102\n")
    g = {(r["pop"], r.ind, r.locus): (r.a1, r.a2) for r in genetics.read_genepop(spark, str(tmp_path / "g.txt")).collect()}
    assert len(g) == 6 and g[1, "x1", "B"] == (None, None) and g[2, "y1", "A"] == (160, 162)


def write_netcdf(path, dims, variables, wide=False):
    """A classic file: dims {name: length, None for records}, variables {name: (dims, array, attributes)}."""
    import struct

    code = {"i2": 3, "i4": 4, "f4": 5, "f8": 6}
    pad = lambda b: b + bytes(-len(b) % 4)
    name = lambda s: struct.pack(">i", len(s)) + pad(s.encode())
    kinds = {k: code[a.dtype.str[1:]] for k, (_, a, _) in variables.items()}
    raw = {k: a.astype(a.dtype.newbyteorder(">")) for k, (_, a, _) in variables.items()}
    n_rec = next((len(a) for d, a, _ in variables.values() if d and dims[d[0]] is None), 0)
    is_rec = {k: bool(d) and dims[d[0]] is None for k, (d, _, _) in variables.items()}
    size = {k: len(pad(raw[k][:1].tobytes() if is_rec[k] else raw[k].tobytes())) for k in raw}

    def head(begin):
        out = b"CDF" + bytes([2 if wide else 1]) + struct.pack(">i", n_rec) + struct.pack(">ii", 10, len(dims))
        out += b"".join(name(k) + struct.pack(">i", n or 0) for k, n in dims.items()) + struct.pack(">ii", 0, 0) + struct.pack(">ii", 11, len(variables))
        for k, (d, _, at) in variables.items():
            out += name(k) + struct.pack(">i", len(d)) + b"".join(struct.pack(">i", list(dims).index(x)) for x in d)
            out += struct.pack(">ii", 12 if at else 0, len(at)) + b"".join(name(x) + struct.pack(">ii", 6, 1) + struct.pack(">d", v) for x, v in at.items())
            out += struct.pack(">ii", kinds[k], size[k]) + struct.pack(">q" if wide else ">i", begin.get(k, 0))
        return out

    at, begin = len(head({})), {}
    for k in sorted(raw, key=lambda k: is_rec[k]):
        begin[k], at = at, at + size[k]
    body = b"".join(pad(raw[k].tobytes()) for k in raw if not is_rec[k])
    body += b"".join(pad(raw[k][r : r + 1].tobytes()) for r in range(n_rec) for k in raw if is_rec[k])
    path.write_bytes(head(begin) + body)


@pytest.mark.parametrize("wide", [False, True])
def test_netcdf_archive_is_the_npz_one(spark, archive, tmp_path, wide):
    rows = sorted(map(tuple, src.read_reanalysis(spark, archive, days=[1, 2], hlim=(3, 7), xlim=(260, 261)).collect()))
    land = sorted(map(tuple, src.read_land_mask(spark, archive).collect()))
    other = tmp_path / "nc"
    (other / "wnd10m").mkdir(parents=True)
    for d in (1, 2):
        with np.load(f"{archive}/wnd10m/197901{d:02d}.npz") as f:
            axes = {k: ((k,), f[k].astype("f8"), {}) for k in ("lat", "lon")} | {"hour": (("hour",), f["hour"].astype("i4"), {})}
            both = {"u": (("hour", "lat", "lon"), ((f["u"] - 5) / 0.5).astype("i2"), {"scale_factor": 0.5, "add_offset": 5.0}), "v": (("hour", "lat", "lon"), f["v"].astype("f4"), {})}
            write_netcdf(other / "wnd10m" / f"197901{d:02d}.nc", {"hour": None, "lat": 2, "lon": 3}, axes | both, wide)
    with np.load(f"{archive}/land.npz") as f:
        write_netcdf(other / "land.nc", {"lat": 2, "lon": 3}, {k: ((k,), f[k].astype("f4"), {}) for k in ("lat", "lon")} | {"soil": (("lat", "lon"), np.nan_to_num(f["soil"], nan=-9).astype("f4"), {"_FillValue": -9.0})}, wide)
    assert sorted(map(tuple, src.read_reanalysis(spark, str(other), days=[1, 2], hlim=(3, 7), xlim=(260, 261)).collect())) == rows and len(rows) == 40
    assert sorted(map(tuple, src.read_land_mask(spark, str(other)).collect())) == land


def test_stacked_series(spark):
    from galeway.grid import GridSpec

    g = GridSpec(1, 2, 0, 2, 0, 1)
    a = src.WindSeries.from_long(spark.createDataFrame([(1, 0, 1.0, 1.0), (1, 1, 2.0, 2.0)], "cell long, step int, u double, v double"), g)
    b = src.WindSeries.from_long(spark.createDataFrame([(1, 5, 3.0, 3.0)], "cell long, step int, u double, v double"), g)
    assert sorted((r.step, r.u) for r in a.stack(b).df.collect()) == [(0, 1.0), (1, 2.0), (2, 3.0)]
    with pytest.raises(ValueError):
        a.stack(src.WindSeries(b.df, g.shift(1)))


def write_tiff(path, z, tiled, deflate, planar, order="<", nodata=None):
    """z: (rows, columns, layers) of float32."""
    import struct
    import zlib

    nr, nc, nl = z.shape
    h, w = (16, 16) if tiled else (3, nc)
    layers = [z[..., [k]] for k in range(nl)] if planar else [z]
    blocks = []
    for part in layers:
        for r in range(0, nr, h):
            for c in range(0, nc, w):
                b = part[r : r + h, c : c + w]
                if tiled:
                    b = np.pad(b, ((0, h - b.shape[0]), (0, w - b.shape[1]), (0, 0)))
                raw = b.astype(order + "f4").tobytes()
                blocks.append(zlib.compress(raw) if deflate else raw)
    out, at = b"", []
    for b in blocks:
        at.append(8 + len(out))
        out += b
    sizes = [len(b) for b in blocks]
    tags = [(256, "I", [nc]), (257, "I", [nr]), (258, "H", [32] * nl), (259, "H", [8 if deflate else 1]), (277, "H", [nl]), (284, "H", [2 if planar else 1]), (339, "H", [3] * nl)]
    tags += [(322, "I", [w]), (323, "I", [h]), (324, "I", at), (325, "I", sizes)] if tiled else [(273, "I", at), (278, "I", [h]), (279, "I", sizes)]
    tags += [(33550, "d", [0.5, 0.25, 0]), (33922, "d", [0, 0, 0, 10, 50, 0])] + ([(42113, "c", [bytes([x]) for x in f"{nodata}\0".encode()])] if nodata is not None else [])
    extra, entries, start = b"", b"", 8 + len(out)
    for tag, kind, v in sorted(tags):
        raw = struct.pack(order + kind * len(v), *v)
        if len(raw) > 4:
            extra, raw = extra + raw, struct.pack(order + "I", start + len(extra))
        entries += struct.pack(order + "HHI", tag, {"c": 2, "H": 3, "I": 4, "d": 12}[kind], len(v)) + raw.ljust(4, b"\0")
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, start + len(extra))
    path.write_bytes(head + out + extra + struct.pack(order + "H", len(tags)) + entries + bytes(4))


@pytest.mark.parametrize("tiled,deflate,planar,order", [(False, False, False, "<"), (False, True, True, "<"), (True, True, False, ">"), (True, False, True, "<")])
def test_geotiff(spark, tmp_path, tiled, deflate, planar, order):
    from galeway.sources import raster

    z = np.random.default_rng(2).normal(size=(20, 18, 4)).astype("f4")
    z[3, 4, 1] = -99
    write_tiff(tmp_path / "a.tif", z, tiled, deflate, planar, order, -99)
    got = raster.read_raster(spark, str(tmp_path / "a.tif"))
    g = raster.read_grid(spark, str(tmp_path / "a.tif"))
    assert (g.nrow, g.ncol, g.xmin, g.xmax, g.ymin, g.ymax) == (20, 18, 10, 19, 45, 50)
    want = {(r + 1, c + 1, k + 1): None if z[r, c, k] == -99 else float(z[r, c, k]) for r in range(20) for c in range(18) for k in range(4)}
    assert {(r.row, r.col, r.layer): r.value for r in got.collect()} == want
    s = src.WindSeries.from_wide(raster.wide(got, 4), g).df.where("cell = 77").collect()  # row 5, column 5
    assert {(r.step, r.u, r.v) for r in s} == {(k, float(z[4, 4, k]), float(z[4, 4, k + 2])) for k in (0, 1)}


def test_merge_takes_the_first_value(spark):
    from galeway.grid import GridSpec, merge

    a, b = GridSpec(1, 3, 0, 3, 0, 1), GridSpec(2, 2, 2, 4, 0, 2)
    da = a.with_coords(spark.createDataFrame([(1, 1.0, None), (3, None, 3.0)], "cell long, u double, v double"))
    db = b.with_coords(spark.createDataFrame([(3, 30.0, 31.0), (1, 10.0, 11.0)], "cell long, u double, v double"))
    df, g = merge(da, a, db, b, ["u", "v"])
    assert (g.nrow, g.ncol, g.xmin, g.xmax, g.ymax) == (2, 4, 0, 4, 2)
    assert {(r.row, r.col): (r.u, r.v) for r in df.collect()} == {(2, 1): (1.0, None), (2, 3): (30.0, 3.0), (1, 3): (10.0, 11.0)}
    with pytest.raises(ValueError):
        merge(da, a, db, b.shift(0.5), ["u"])


def test_landscape_tables(spark):
    pairs = spark.createDataFrame([(1, 2, 0.2), (2, 1, 0.4)], "i int, j int, value double")
    t = genetics.landscape(None, None, None, pairs)
    assert set(t) == {"sites", "div", "mig", "fst"} and [round(r.value, 9) for r in t["fst"].collect()] == [0.3, 0.3]
