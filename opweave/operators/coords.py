"""Directions: unit vectors and pairs of angles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from opweave.expr import Operator

CONVENTIONS = ("zenith,azimuth", "azimuth,zenith", "elevation,azimuth", "azimuth,elevation")


class _Direction(Operator):
    def __init__(self, convention: str = "zenith,azimuth", degrees: bool = False):
        if convention not in CONVENTIONS:
            raise ValueError(f"no convention {convention!r}")
        super().__init__(name=f"{type(self).__name__.removesuffix('Operator')}[{convention}]")
        self.convention, self.degrees = convention, degrees

    def same(self, other) -> bool:
        return (self.convention, self.degrees) == (other.convention, other.degrees)


class Cartesian2SphericalOperator(_Direction):
    def on_array(self, x):
        x = np.asarray(x, float)
        if x.shape[-1] != 3:
            raise ValueError("three coordinates are needed")
        first = np.arccos(x[..., 2])
        second = np.arctan2(x[..., 1], x[..., 0]) % (2 * np.pi)
        if "elevation" in self.convention:
            first = np.pi / 2 - first
        out = np.stack([first, second] if self.convention.endswith("azimuth") else [second, first], axis=-1)
        return np.degrees(out) if self.degrees else out

    def on_columns(self, x: Column, y: Column, z: Column) -> tuple[Column, Column]:
        first, second = F.acos(z), F.atan2(y, x)
        second = F.when(second < 0, second + 2 * np.pi).otherwise(second)
        if "elevation" in self.convention:
            first = F.lit(np.pi / 2) - first
        out = (first, second) if self.convention.endswith("azimuth") else (second, first)
        return tuple(F.degrees(c) for c in out) if self.degrees else out

    def inverse_(self):
        return Spherical2CartesianOperator(self.convention, self.degrees)


class Spherical2CartesianOperator(_Direction):
    def on_array(self, x):
        x = np.asarray(x, float)
        if x.shape[-1] != 2:
            raise ValueError("two angles are needed")
        x = np.radians(x) if self.degrees else x
        first, second = (x[..., 0], x[..., 1]) if self.convention.endswith("azimuth") else (x[..., 1], x[..., 0])
        first = np.pi / 2 - first if "elevation" in self.convention else first
        return np.stack([np.sin(first) * np.cos(second), np.sin(first) * np.sin(second), np.cos(first)], axis=-1)

    def on_columns(self, a: Column, b: Column) -> tuple[Column, Column, Column]:
        a, b = (F.radians(a), F.radians(b)) if self.degrees else (a, b)
        first, second = (a, b) if self.convention.endswith("azimuth") else (b, a)
        first = F.lit(np.pi / 2) - first if "elevation" in self.convention else first
        return F.sin(first) * F.cos(second), F.sin(first) * F.sin(second), F.cos(first)

    def inverse_(self):
        return Cartesian2SphericalOperator(self.convention, self.degrees)
