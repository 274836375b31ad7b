"""Chemical formulas: surface validity and molar mass, read with a stack instead of recursion."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Standard atomic weights.
ATOMIC_WEIGHT = {
    "H": 1.008, "He": 4.0026, "Li": 6.94, "Be": 9.0122, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "Ne": 20.180, "Na": 22.990, "Mg": 24.305, "Al": 26.982, "Si": 28.085,
    "P": 30.974, "S": 32.06, "Cl": 35.45, "Ar": 39.95, "K": 39.098, "Ca": 40.078, "Sc": 44.956, "Ti": 47.867, "V": 50.942, "Cr": 51.996, "Mn": 54.938, "Fe": 55.845, "Co": 58.933, "Ni": 58.693,
    "Cu": 63.546, "Zn": 65.38, "Ga": 69.723, "Ge": 72.630, "As": 74.922, "Se": 78.971, "Br": 79.904, "Kr": 83.798, "Rb": 85.468, "Sr": 87.62, "Y": 88.906, "Zr": 91.224, "Nb": 92.906, "Mo": 95.95,
    "Ru": 101.07, "Rh": 102.91, "Pd": 106.42, "Ag": 107.87, "Cd": 112.41, "In": 114.82, "Sn": 118.71, "Sb": 121.76, "Te": 127.60, "I": 126.90, "Xe": 131.29, "Cs": 132.91, "Ba": 137.33, "La": 138.91,
    "Ce": 140.12, "W": 183.84, "Re": 186.21, "Os": 190.23, "Ir": 192.22, "Pt": 195.08, "Au": 196.97, "Hg": 200.59, "Tl": 204.38, "Pb": 207.2, "Bi": 208.98, "Th": 232.04, "U": 238.03,
}
_TOKEN = re.compile(r"([A-Z][a-z]?)|(\()|(\))|(\d+)|([.·])")
_PLAIN = str.maketrans("₀₁₂₃₄₅₆₇₈₉（）", "0123456789()")


def molar_mass(formula: str | None) -> float | None:
    """The molar mass of a formula with brackets and parts joined by a point; None if it is no formula."""
    if not formula:
        return None
    text = re.sub(r"\s+", "", formula.translate(_PLAIN))
    at, total, factor = 0, 0.0, 1
    stack: list[list[float]] = [[]]
    fresh = True
    while at < len(text):
        token = _TOKEN.match(text, at)
        if not token:
            return None
        element, opening, closing, digits, dot = token.groups()
        if element:
            if element not in ATOMIC_WEIGHT:
                return None
            stack[-1].append(ATOMIC_WEIGHT[element])
        elif opening:
            stack.append([])
        elif closing:
            if len(stack) < 2 or not stack[-1]:
                return None
            group = sum(stack.pop())
            stack[-1].append(group)
        elif digits:
            if stack[-1]:
                stack[-1][-1] *= int(digits)
            elif fresh and len(stack) == 1:
                factor = int(digits)
            else:
                return None
        elif dot:
            if len(stack) > 1 or not stack[-1]:
                return None
            total += factor * sum(stack[0])
            stack, factor = [[]], 1
        fresh = bool(dot)
        at = token.end()
    if len(stack) > 1 or not stack[0]:
        return None
    return total + factor * sum(stack[0])


@F.pandas_udf(T.DoubleType())
def molar_mass_of(formula: pd.Series) -> pd.Series:
    return formula.map(lambda f: molar_mass(f) if isinstance(f, str) else None).astype("float64")
