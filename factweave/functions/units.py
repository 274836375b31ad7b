"""Unit aliases, conversion factors and the automaton that finds units beside numbers.

The common unit of a dimension and the set of symbols come from the reference table; the factors are public knowledge.
"""

from __future__ import annotations

import re
from functools import lru_cache

from factweave.functions.fold import fold_latin

# Written forms of each unit symbol, in plain (folded) characters.
UNIT_ALIASES: dict[str, tuple[str, ...]] = {
    "g/cm3": ("g/cm3", "g/cm^3", "g/cm³", "g·cm-3", "g·cm⁻³", "g/cc", "g/ml", "克/立方厘米", "克每立方厘米"),
    "kg/m3": ("kg/m3", "kg/m^3", "kg/m³", "kg·m-3", "kg·m⁻³", "kg m-3", "千克/立方米", "千克每立方米", "公斤/立方米"),
    "lb/ft3": ("lb/ft3", "lb/ft^3", "lb/ft³", "lb/cu ft", "lb/cuft", "pcf", "磅/立方英尺", "磅每立方英尺"),
    "g/L": ("g/l", "g·l-1", "g·l⁻¹", "克/升", "克每升"),
    "℃": ("℃", "°c", "degc", "deg c", "摄氏度", "celsius", "度c"),
    "K": ("k", "kelvin", "开", "开尔文"),
    "℉": ("℉", "°f", "degf", "deg f", "华氏度", "fahrenheit"),
    "MPa": ("mpa", "兆帕", "n/mm2", "n/mm²", "n/mm^2", "n·mm-2", "牛/平方毫米"),
    "GPa": ("gpa", "吉帕"),
    "kPa": ("kpa", "千帕"),
    "psi": ("psi", "lbf/in2", "lbf/in²", "lbf/in^2", "磅/平方英寸", "磅每平方英寸"),
    "kgf/cm2": ("kgf/cm2", "kgf/cm²", "kgf/cm^2", "kg力/cm2", "kg力/cm²", "千克力/平方厘米", "千克力每平方厘米", "公斤力/平方厘米"),
    "Pa·s": ("pa·s", "pa.s", "pas", "pa s", "帕·秒", "帕秒", "帕斯卡秒"),
    "mPa·s": ("mpa·s", "mpa.s", "mpas", "mpa s", "毫帕·秒", "毫帕秒"),
    "cP": ("cp", "cps", "centipoise", "厘泊"),
    "μm": ("μm", "um", "微米", "micron", "microns"),
    "nm": ("nm", "纳米"),
    "mm": ("mm", "毫米"),
    "mil": ("mil", "mils", "密耳"),
    "W/(m·K)": ("w/(m·k)", "w/m·k", "w/mk", "w/m/k", "w·m-1·k-1", "w·m⁻¹·k⁻¹", "瓦/(米·开)", "瓦每米开"),
    "mW/(m·K)": ("mw/(m·k)", "mw/m·k", "mw/mk", "mw·m-1·k-1", "mw·m⁻¹·k⁻¹", "毫瓦/(米·开)", "毫瓦每米开"),
    "kcal/(m·h·℃)": ("kcal/(m·h·℃)", "kcal/m·h·℃", "kcal/mh℃", "kcal/(m·h·°c)", "kcal·m-1·h-1·℃-1", "千卡/(米·时·度)", "千卡每米时度"),
    "J/(g·K)": ("j/(g·k)", "j/g·k", "j/gk", "j·g-1·k-1", "j·g⁻¹·k⁻¹", "焦/(克·开)", "焦每克开"),
    "kJ/(kg·K)": ("kj/(kg·k)", "kj/kg·k", "kj/kgk", "kj·kg-1·k-1", "kj·kg⁻¹·k⁻¹", "千焦/(千克·开)", "千焦每千克开"),
    "cal/(g·℃)": ("cal/(g·℃)", "cal/g·℃", "cal/g℃", "cal/(g·°c)", "cal·g-1·℃-1", "卡/(克·度)", "卡每克度"),
    "min": ("min", "mins", "minute", "minutes", "分钟", "分"),
    "h": ("h", "hr", "hrs", "hour", "hours", "小时", "时"),
    "s": ("s", "sec", "secs", "second", "seconds", "秒", "秒钟"),
    "%": ("%", "wt%", "百分比", "百分之", "percent", "vol%", "百分之一"),
    "‰": ("‰", "千分之", "permille", "千分之一"),
    "ppm": ("ppm", "mg/kg", "百万分之", "百万分之一"),
    "Ω·cm": ("ω·cm", "ohm·cm", "ohm-cm", "ohm cm", "欧姆·厘米", "欧·厘米", "欧厘米"),
    "Ω·m": ("ω·m", "ohm·m", "ohm-m", "ohm m", "欧姆·米", "欧·米", "欧米"),
    "mN/m": ("mn/m", "mn·m-1", "mn·m⁻¹", "毫牛/米", "毫牛每米"),
    "dyn/cm": ("dyn/cm", "dyne/cm", "达因/厘米", "达因每厘米"),
    "N/m": ("n/m", "n·m-1", "n·m⁻¹", "牛/米", "牛每米"),
}

# Value in the common unit = value * factor + offset, the common unit being that of the reference table.
CONVERSION: dict[str, tuple[float, float]] = {
    "g/cm3": (1.0, 0.0), "kg/m3": (1e-3, 0.0), "lb/ft3": (0.016018463373960142, 0.0), "g/L": (1e-3, 0.0),
    "℃": (1.0, 0.0), "K": (1.0, -273.15), "℉": (5.0 / 9.0, -160.0 / 9.0),
    "MPa": (1.0, 0.0), "GPa": (1e3, 0.0), "kPa": (1e-3, 0.0), "psi": (0.006894757293168361, 0.0), "kgf/cm2": (0.0980665, 0.0),
    "Pa·s": (1.0, 0.0), "mPa·s": (1e-3, 0.0), "cP": (1e-3, 0.0),
    "μm": (1.0, 0.0), "nm": (1e-3, 0.0), "mm": (1e3, 0.0), "mil": (25.4, 0.0),
    "W/(m·K)": (1.0, 0.0), "mW/(m·K)": (1e-3, 0.0), "kcal/(m·h·℃)": (1.163, 0.0),
    "J/(g·K)": (1.0, 0.0), "kJ/(kg·K)": (1.0, 0.0), "cal/(g·℃)": (4.184, 0.0),
    "min": (1.0, 0.0), "h": (60.0, 0.0), "s": (1.0 / 60.0, 0.0),
    "%": (1.0, 0.0), "‰": (0.1, 0.0), "ppm": (1e-4, 0.0),
    "Ω·cm": (1.0, 0.0), "Ω·m": (100.0, 0.0),
    "mN/m": (1.0, 0.0), "dyn/cm": (1.0, 0.0), "N/m": (1e3, 0.0),
}

# The dimension of each unit symbol, as the reference table has it.
DIMENSION: dict[str, str] = {
    symbol: dimension
    for dimension, symbols in {
        "density": ("g/cm3", "kg/m3", "lb/ft3", "g/L"),
        "temperature": ("℃", "K", "℉"),
        "pressure": ("MPa", "GPa", "kPa", "psi", "kgf/cm2"),
        "viscosity": ("Pa·s", "mPa·s", "cP"),
        "length": ("μm", "nm", "mm", "mil"),
        "conductivity": ("W/(m·K)", "mW/(m·K)", "kcal/(m·h·℃)"),
        "heat": ("J/(g·K)", "kJ/(kg·K)", "cal/(g·℃)"),
        "time": ("min", "h", "s"),
        "fraction": ("%", "‰", "ppm"),
        "resistivity": ("Ω·cm", "Ω·m"),
        "tension": ("mN/m", "dyn/cm", "N/m"),
    }.items()
    for symbol in symbols
}
# What the name of a property says of the dimension of its quantity.
CONTEXT: tuple[tuple[str, re.Pattern], ...] = (
    ("viscosity", re.compile(r"[黏粘]度|viscosity", re.I)),
    ("tension", re.compile(r"张力|surface tension|interfacial tension", re.I)),
    ("conductivity", re.compile(r"热导|导热|热传导|thermal conductivity", re.I)),
    ("heat", re.compile(r"比热|heat capacity|\bcp\b", re.I)),
    ("resistivity", re.compile(r"电阻|resistivity", re.I)),
    ("density", re.compile(r"密度|比重|density|\brho\b", re.I)),
    ("pressure", re.compile(r"强度|模量|应力|压强|压力|strength|modulus|stress|pressure|\buts\b", re.I)),
    ("fraction", re.compile(r"伸长率|延伸率|吸水|含量|elongation|absorption|content", re.I)),
    ("length", re.compile(r"粒径|厚度|直径|diameter|thickness|\bd50\b", re.I)),
    ("time", re.compile(r"时间|\btime\b", re.I)),
    ("temperature", re.compile(r"温度|熔点|软化点|沸点|闪点|temperature|point|\btg\b|m\.p\.", re.I)),
)
# Forms that case alone keeps apart from the unit they resemble, the dimension in which they can only be a slip for it,
# and the power of ten between the two.
CASED = (("mPa", "MPa", "pressure", -9), ("MN/m", "mN/m", "tension", 9))


def context_dimension(name: str | None) -> str | None:
    """The dimension that a property name speaks of; null where it speaks of none."""
    return next((dimension for dimension, words in CONTEXT if name and words.search(name)), None)


_SPACES = re.compile(r"\s+")
POWER = re.compile(r"^(?:[×x*]?\s*10\s*(?:\^\s*([+-]?\d+)|([⁺⁻]?[⁰¹²³⁴-⁹]+)|(?:\*\*([+-]?\d+)))\s*|(千|万|百万|亿)\s*(?=[a-zμω℃°%‰ ]))")
# Numeral words before a unit.
WORD_POWER = {"千": 3, "万": 4, "百万": 6, "亿": 8}
SUPERSCRIPT = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻", "0123456789+-")


def unit_key(text: str) -> str:
    """Comparison form of a unit: folded, lower case, inner spaces single."""
    return _SPACES.sub(" ", fold_latin(text)).strip().lower()


@lru_cache(maxsize=1)
def alias_index() -> dict[str, str]:
    """Comparison form to unit symbol, with and without spaces around separators."""
    index: dict[str, str] = {}
    for symbol, forms in UNIT_ALIASES.items():
        for form in (symbol, *forms):
            key = unit_key(form)
            index.setdefault(key, symbol)
            index.setdefault(key.replace(" ", ""), symbol)
    return index


def leading_power(key: str) -> tuple[int, str]:
    """A power of ten written before the unit and the rest."""
    found = POWER.match(key)
    if not found:
        return 0, key
    if found[4]:
        return WORD_POWER[found[4]], key[found.end() :].lstrip()
    digits = (found[1] or found[3] or found[2] or "0").translate(SUPERSCRIPT)
    return int(digits), key[found.end() :].lstrip()


def resolve_unit(text: str | None) -> tuple[str, int] | None:
    """The unit symbol a whole text names, with the power of ten before it; None if it names none."""
    if not text:
        return None
    key = unit_key(text)
    symbol = alias_index().get(key) or alias_index().get(key.replace(" ", ""))
    if symbol:
        return symbol, 0
    power, rest = leading_power(key)
    if rest != key:
        symbol = alias_index().get(rest) or alias_index().get(rest.replace(" ", ""))
        if symbol:
            return symbol, power
    return None


@lru_cache(maxsize=1)
def unit_automaton():
    """Aho-Corasick automaton over all written forms."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for key, symbol in alias_index().items():
        automaton.add_word(key, (len(key), symbol))
    automaton.make_automaton()
    return automaton
