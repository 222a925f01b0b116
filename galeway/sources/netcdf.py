"""A reader of classic NetCDF files (CDF-1 and CDF-2) that reads slabs by position."""

from __future__ import annotations

import math
import struct
from typing import NamedTuple

import numpy as np

#: Type codes of the format.
_TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}


class Variable(NamedTuple):
    """dims: lengths; begin, dtype: where and what the values are; record: the first dimension is the unlimited one, values are that far apart."""

    dims: tuple[int, ...]
    begin: int
    dtype: np.dtype
    record: int | None
    attributes: dict


class NetCdf:
    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as f:
            self._b, self._at = f.read(1 << 20), 0
        magic = self._b[:4]
        if magic not in (b"CDF\x01", b"CDF\x02"):
            raise ValueError(f"{path} is no classic NetCDF file")
        self._at, self._wide = 4, magic[3] == 2
        n_records = self._int()
        dims = self._list(lambda: (self._name(), self._int()))
        self.attributes = dict(self._list(self._attribute))
        raw = self._list(lambda: (self._name(), [self._int() for _ in range(self._int())], dict(self._list(self._attribute)), self._int(), self._int(), self._begin()))
        size = sum(v[4] for v in raw if v[1] and dims[v[1][0]][1] == 0)  # bytes of one record of all variables
        single = sum(bool(v[1]) and dims[v[1][0]][1] == 0 for v in raw) == 1
        self.dimensions = {k: n or n_records for k, n in dims}
        self.variables: dict[str, Variable] = {}
        for name, ids, attributes, kind, _, begin in raw:
            dtype, record = np.dtype(_TYPES[kind]), bool(ids) and dims[ids[0]][1] == 0
            lengths = tuple(dims[i][1] or n_records for i in ids)
            apart = math.prod(lengths[1:]) * dtype.itemsize if single else size  # a lone record variable isn't padded
            self.variables[name] = Variable(lengths, begin, dtype, apart if record else None, attributes)

    def _int(self) -> int:
        self._at += 4
        return struct.unpack_from(">i", self._b, self._at - 4)[0]

    def _begin(self) -> int:
        if not self._wide:
            return self._int()
        self._at += 8
        return struct.unpack_from(">q", self._b, self._at - 8)[0]

    def _bytes(self, n: int) -> bytes:
        self._at += n + -n % 4
        return self._b[self._at - n - -n % 4 : self._at - -n % 4]

    def _name(self) -> str:
        return self._bytes(self._int()).decode()

    def _attribute(self) -> tuple:
        name, kind, n = self._name(), self._int(), self._int()
        dtype = np.dtype(_TYPES[kind])
        raw = self._bytes(n * dtype.itemsize)
        return name, raw.decode() if kind == 2 else np.frombuffer(raw, dtype)

    def _list(self, item) -> list:
        self._int()  # the tag
        return [item() for _ in range(self._int())]

    def read(self, name: str, at: list[np.ndarray] | None = None) -> np.ndarray:
        """The values at the given positions of each dimension; scaled and with gaps as NaN where attributes say so. Only pages of these rows are read."""
        v = self.variables[name]
        strides = np.cumprod([v.dtype.itemsize, *v.dims[:0:-1]])[::-1] if v.dims else ()
        if v.record is not None:
            strides = (v.record, *strides[1:])
        need = v.begin + sum((n - 1) * s for n, s in zip(v.dims, strides, strict=True)) + v.dtype.itemsize if all(v.dims) else 0
        held = np.memmap(self.path, np.uint8, "r")
        if need > len(held):
            raise ValueError(f"{self.path} is cut short")
        whole = np.ndarray(v.dims, v.dtype, held, v.begin, tuple(map(int, strides))) if need else np.zeros(v.dims, v.dtype)
        out = whole[np.ix_(*at)] if at is not None else np.array(whole)
        gaps = [out == v.attributes[k][0] for k in ("_FillValue", "missing_value") if k in v.attributes]
        if gaps or "scale_factor" in v.attributes or "add_offset" in v.attributes:
            out = out.astype(float) * float(v.attributes.get("scale_factor", [1])[0]) + float(v.attributes.get("add_offset", [0])[0])
        for gap in gaps:
            out[gap] = np.nan
        return out.astype(out.dtype.newbyteorder("="))
