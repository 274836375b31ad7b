"""From the grid of a table to facts: header paths, roles of columns, rows and cells, a semantic plan, and the unpivot by the reading
that the plan asks for.

A table is small beside its document, so each is worked on in the task that reads the text, and only what comes out is a row. The
rules stand in tables (words, evidence, topologies) that are read by short loops; the words are parameters for other domains.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from statistics import mean

from pyspark.sql import DataFrame

from factweave.operators.documents import Cell, _exploder, grid_of, headings_of, tables_of

# Words of labels that tell what an axis holds.
WORDS: dict[str, tuple[str, ...]] = {
    "entity": tuple("材料 名称 样品 试样 配方 编号 型号 代号 炸药 推进剂 火药 烟火药 药剂 化合物 体系 聚合物 单体 预聚物 组分 物质 产品 试验样品 样品名称 配方号 材料名称 炸药名称 推进剂名称 药剂名称".split()),
    "identifier": tuple("编号 序号 代号 型号 批次 cas cas号 登记号 样品号 配方号".split()),
    "property": tuple(
        "性能 属性 项目 指标 密度 相对密度 理论密度 装药密度 熔点 沸点 分解温度 爆速 爆压 爆热 爆温 爆容 燃速 比冲 压力指数 感度 撞击感度 摩擦感度 火花感度 热感度 临界直径 威力 猛度 生成热 生成焓 燃烧热 氧平衡 分子量 相对分子质量 "
        "含量 纯度 黏度 粘度 强度 拉伸强度 伸长率 模量 硬度 粒径 粒度 比表面积 含水量 吸湿性 热值 产气量 发光强度 燃烧时间 释能时间 释能功率 峰顶温度 玻璃化温度 活化能 速率常数 误差 计算值 实验值 实测值 预测值".split()
    ),
    "condition": tuple(
        "条件 温度 试验温度 实验温度 环境温度 压力 湿度 时间 老化时间 加热速率 升温速率 加载速率 应变率 频率 粒径 粒度 装药密度 试验密度 样品质量 试样质量 落锤质量 落高 浓度 固含量 转速 搅拌速度 气氛 介质 溶剂 真空度 保温时间 "
        "干燥温度 循环次数 配比 质量比 摩尔比 在 下 时 不同温度 不同压力 不同时间 不同粒径 不同密度".split()
    ),
    "method": tuple("方法 试验方法 测试方法 检验方法 测定方法 分析方法 仪器 设备 标准 模型 算法 计算方法 表征方法 检测方法 测试仪器 装置 程序".split()),
    "composition": tuple("组成 组分 配方组成 质量分数 质量百分数 含量 比例 配比 摩尔分数 氧化剂 燃料 粘合剂 黏合剂 增塑剂 固化剂 键合剂 催化剂 添加剂 安定剂 燃速调节剂 金属燃料 填料 链段 软链段 硬链段".split()),
    "group": tuple("类别 类型 分组 等级 用途 应用领域 状态 结果 判定 级别".split()),
    "note": tuple("备注 注 说明 现象 特点 优点 缺点 适用范围 结论".split()),
    "comparison": tuple("对照 基准 实验值 计算值 预测值 理论值 误差 偏差 差值".split()),
}
# Labels of results that tell where they come from.
RESULTS = (("theoretical_result", ("理论值",)), ("calculated_result", ("计算值", "预测值")), ("measured_result", ("实验值", "实测值", "测定值")), ("comparison_metric", ("误差", "偏差", "差值")))
_NUMBER = re.compile(r"[\s<>≤≥≈~～±+\-−]?(?:\d+(?:[.,]\d+)?|[.,]\d+)(?:%|‰|[a-zA-Z°℃·/^\-0-9]+)?")
_BEGINS = re.compile(r"[<>≤≥≈~～±约(+\-−]?\d")
_SPAN = re.compile(r"\d(?:[-~～—至]|\.{2,})\d")
_FORMULA, _CODE = re.compile(r"(?:[A-Z][a-z]?\d*){2,}"), re.compile(r"(?i)[A-Z][A-Z0-9\-_/]{1,15}")
_UNIT = re.compile(r"[（(]\s*([^（）()]*(?:\([^()]*\))?[^（）()]*)\s*[)）]\s*$|/\s*([^/\s][^\s]*)\s*$")
_GENERIC = ("数值", "值", "结果", "数据", "单位", "备注")


@lru_cache(maxsize=65536)
def _folded(text: str) -> str:
    return re.sub(r"\s+", "", text.lower()).replace("（", "(").replace("）", ")")


@lru_cache(maxsize=65536)
def holds(label: str, words: tuple[str, ...]) -> bool:
    """True if a label holds one of the words, marks set aside; labels come again in many tables."""
    bare = re.sub(r"[/()\[\]{}%‰·:_\-]+", "", _folded(label))
    return bool(bare) and any(_folded(w) in bare for w in words)


@lru_cache(maxsize=65536)
def is_number(text: str) -> bool:
    value = re.sub(r"\s+", "", text)
    return bool(value) and bool(_NUMBER.fullmatch(value) or len(value) <= 40 and _SPAN.search(value) or len(value) <= 28 and _BEGINS.match(value) and not re.search(r"[一-鿿]{2}", value))


def is_code(text: str) -> bool:
    value = re.sub(r"\s+", "", text)
    return 0 < len(value) <= 32 and bool(_FORMULA.fullmatch(value) or _CODE.fullmatch(value))


@lru_cache(maxsize=65536)
def names_material(text: str) -> bool:
    value = text.strip()
    return 0 < len(value) <= 80 and not is_number(value) and not re.search("[。；;]", value) and (is_code(value) or bool(re.search(r"[^\W\d_]", value)))


def same_labels(left: Sequence[str], right: Sequence[str], least: float = 0.75) -> bool:
    """True if two sets of at least two labels share this part of the larger one."""
    a, b = ({_folded(x) for x in side} - {""} for side in (left, right))
    return min(len(a), len(b)) >= 2 and len(a & b) / max(len(a), len(b)) >= least


def label_path(labels: Sequence[str]) -> list[str]:
    """Labels from outside in, blanks and repeats of the one before left out."""
    out: list[str] = []
    for label in labels:
        value = " ".join(label.split())
        if value and out[-1:] != [value]:
            out.append(value)
    return out


def name_and_unit(label: str) -> tuple[str, str]:
    """A label without the unit at its end, and the unit."""
    m = _UNIT.search(label)
    return (label[: m.start()].strip() or label, (m[1] or m[2]).strip()) if m else (label.strip(), "")


def _share(values: Sequence[str], test: Callable[[str], bool]) -> float:
    filled = [v for v in values if v]
    return sum(map(test, filled)) / len(filled) if filled else 0.0


@dataclass
class Axis:
    """A column or row with its label path and role."""

    index: int
    labels: list[str]
    unit: str
    numeric: float
    unique: float
    role: str = "unknown"
    confidence: float = 0.25

    @property
    def label(self) -> str:
        return "/".join(self.labels)


@dataclass
class Table:
    """A grid with what its parts mean; everything is worked out once, when it is asked for."""

    cells: list[Cell]
    words: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: WORDS)

    def __post_init__(self) -> None:
        self.height = 1 + max((c[0] for c in self.cells), default=-1)
        self.width = 1 + max((c[1] for c in self.cells), default=-1)
        self.text = [[""] * self.width for _ in range(self.height)]
        self.marked = [[False] * self.width for _ in range(self.height)]
        for r, c, text, header, _ in self.cells:
            self.text[r][c], self.marked[r][c] = text, header

    @cached_property
    def header_rows(self) -> int:
        """How many leading rows are headers: marked ones, else the first if it is clearly less numeric than those below."""
        marked = 0
        while marked < self.height - 1 and any(self.marked[marked]) and _share_marked(self.text[marked], self.marked[marked]) >= 0.6:
            marked += 1
        if marked or self.height < 2:
            return marked
        top, below = _share(self.text[0], is_number), mean(_share(row, is_number) for row in self.text[1:6])
        return int(top < 0.5 and (below > top + 0.2 or _share(self.text[0], lambda v: len(v) <= 30) >= 0.8))

    @cached_property
    def row_headers(self) -> int:
        """How many leading columns name their rows: marked ones, else up to three that hold few numbers and mostly distinct texts."""
        body = range(self.header_rows, self.height)
        marked = 0
        while marked < self.width - 1 and body and _share_marked([self.text[r][marked] for r in body], [self.marked[r][marked] for r in body]) >= 0.6:
            marked += 1
        if marked:
            return marked
        n = 0
        while n < min(3, self.width) and self._measure(self.column(n))[0] <= 0.35 and self._measure(self.column(n))[1] >= 0.4:
            n += 1
        return min(n, 1) if n == self.width else n

    def column(self, c: int) -> list[str]:
        return [self.text[r][c] for r in range(self.header_rows, self.height)]

    @staticmethod
    def _measure(values: Sequence[str]) -> tuple[float, float]:
        filled = [v for v in values if v]
        return _share(values, is_number), len(set(filled)) / len(filled) if filled else 0.0

    @cached_property
    def header_confidence(self) -> float:
        explicit = any(self.marked[r][c] and self.text[r][c] for r in range(self.header_rows) for c in range(self.width))
        return min(1.0, 0.5 + 0.2 * bool(self.header_rows) + 0.15 * bool(self.row_headers) + 0.15 * explicit)

    def _is_component(self, label: str, unit: str) -> bool:
        token = re.sub(r"[/()\[\]{}%‰·:_\-]+", "", _folded(label))
        return holds(label, self.words["composition"]) or 0 < len(token) <= 12 and is_code(token) and ("%" in label + unit or not holds(label, self.words["property"]))

    @cached_property
    def columns(self) -> list[Axis]:
        out = []
        for c in range(self.width):
            labels = label_path([self.text[r][c] for r in range(self.header_rows)])
            values = self.column(c)
            axis = Axis(c, labels, name_and_unit(labels[-1])[1] if labels else "", *self._measure(values))
            said = {role for role, words in self.words.items() if holds(axis.label, words)}
            component, leads = self._is_component(axis.label, axis.unit), c < self.row_headers
            words_only = 1 - axis.numeric if any(values) else 0.0
            named = leads and _share(values, names_material) >= 0.6 and axis.unique >= 0.5
            evidence = [(role, 0.75, role in said) for role in ("entity", "identifier", "property", "condition", "method", "composition", "group", "note")] + [
                ("composition", 0.90, component), ("value", -0.10, component),
                ("entity", 0.55, named), ("group", 0.20, leads and not named and words_only >= 0.7),
                ("value", 0.65, axis.numeric >= 0.75), ("value", 0.30, 0.35 <= axis.numeric < 0.75),
                ("condition", 0.25, bool(axis.unit) and "condition" in said),
                ("composition", 0.20, bool(axis.unit) and "condition" not in said and component),
                ("property", 0.20, bool(axis.unit) and "condition" not in said and not component), ("value", 0.10, bool(axis.unit) and "condition" not in said and not component),
                ("condition", 0.35, "condition" in said and axis.numeric >= 0.35), ("value", -0.10, "condition" in said and axis.numeric >= 0.35),
                ("property", 0.25, "property" in said and (axis.numeric >= 0.35 or leads and words_only >= 0.7)), ("value", 0.15, "property" in said and axis.numeric >= 0.35),
                ("method", 0.25, "method" in said and words_only >= 0.5),
                ("identifier", 0.30, "identifier" in said), ("entity", -0.10, "identifier" in said),
                ("entity", 0.40, not axis.labels and c == 0 and words_only >= 0.8 and axis.unique >= 0.5),
            ]
            score = _decide(axis, evidence, 0.98)
            if score["property"] >= 0.75 and axis.numeric >= 0.5:
                axis.role, axis.confidence = "property_value", min(0.98, 0.6 + 0.25 * axis.numeric + 0.1 * bool(axis.unit))
            out.append(axis)
        return out

    @cached_property
    def rows(self) -> list[Axis]:
        out = []
        for r in range(self.header_rows, self.height):
            labels = label_path(self.text[r][: self.row_headers])
            axis = Axis(r, labels, "", *self._measure(self.text[r][self.row_headers :]))
            said = {role for role, words in self.words.items() if holds(axis.label, words)}
            component, numeric = self._is_component(axis.label, ""), axis.numeric >= 0.6
            evidence = [(role, 0.75, role in said) for role in ("entity", "property", "condition", "method", "composition", "group", "note")] + [
                ("composition", 0.60, component),
                ("entity", 0.35, bool(labels) and not is_number(axis.label) and not said),
                ("condition", 0.25, numeric and "condition" in said),
                ("property", 0.25, numeric and "condition" not in said and "property" in said),
                ("composition", 0.25, numeric and not said & {"condition", "property"} and component),
            ]
            _decide(axis, evidence, 0.95)
            out.append(axis)
        return out

    @cached_property
    def topology(self) -> tuple[str, str, float, list[str]]:
        """(topology, orientation, confidence, what is unresolved): the first rule that holds."""
        n, rows = Counter(a.role for a in self.columns), Counter(a.role for a in self.rows)
        results = n["property"] + n["property_value"]
        parts = n["composition"] + sum(a.role == "property_value" and "%" in a.label for a in self.columns)
        loose = n["note"] + n["group"]
        compared = sum(holds(a.label, self.words["comparison"]) for a in self.columns)
        data = [a.labels[-1] if a.labels else "" for a in self.columns[self.row_headers :]]
        flat = mean([a.numeric for a in self.columns] or [0.0]) < 0.35
        by_rows = lambda role: f"row_{role}" if rows[role] else "row_subject"
        rules = (
            ("pairwise_compatibility", "pairwise_entity", 0.92, min(self.height, self.width) >= 3 and same_labels([a.label for a in self.rows], data), ""),
            ("model_validation", "row_subject", 0.90, compared >= 2 and any("误差" in a.label or "偏差" in a.label for a in self.columns), ""),
            ("composition_and_performance", "row_subject", 0.90, parts >= 2 and results >= 1, ""),
            ("formulation_matrix", "row_subject", 0.85, parts >= 2 and n["entity"] + n["identifier"] >= 1, ""),
            ("condition_by_property", by_rows("condition"), 0.86, n["condition"] >= 1 and results >= 1, ""),
            ("method_comparison", by_rows("method"), 0.82, n["method"] >= 1 and results + loose >= 1, ""),
            ("entity_by_property", "column_subject", 0.84, rows["property"] >= 2 and n["entity"] >= 1, ""),
            ("entity_by_property", "row_subject", 0.86, n["entity"] >= 1 and results >= 1, ""),
            ("entity_by_property", "row_subject", 0.78, rows["entity"] >= 2 and results >= 1, ""),
            ("experiment_result", "row_subject", 0.72, n["condition"] >= 1 and n["value"] >= 1, ""),
            ("qualitative_taxonomy", "row_subject", 0.75, loose >= 1 and flat, ""),
            ("entity_by_property", "row_subject", 0.62, results >= 1 and n["value"] >= 1, "subject_axis_not_explicit"),
            ("method_comparison", "row_method", 0.62, n["method"] >= 1, "comparison_targets_not_explicit"),
            ("qualitative_taxonomy", "row_subject", 0.50, min(self.height, self.width) >= 2, "semantic_axes_low_confidence"),
            ("unresolved", "row_subject", 0.35, True, "table_too_small_or_semantically_empty"),
        )
        name, orientation, confidence, _, open_ = next(rule for rule in rules if rule[3])
        unresolved = [open_] if open_ else []
        for amount, reason, holds_ in (
            (0.15, "header_tree_low_confidence", self.header_confidence < 0.55),
            (0.08, "row_header_axis_not_explicit", not self.row_headers and orientation.startswith("row_")),
        ):
            if holds_ and name not in ("pairwise_compatibility", "model_validation"):
                confidence = max(0.3, confidence - amount)
                unresolved.append(reason)
        return name, orientation, min(0.98, confidence), unresolved

    def cell_role(self, r: int, c: int) -> tuple[str, float]:
        """(role, confidence) of a cell by its place, the role of its column and its own text."""
        text, axis, orientation = self.text[r][c], self.columns[c], self.topology[1]
        if r < self.header_rows:
            return "header", 0.99
        if not text:
            return "empty", 0.99
        named = {"condition": "condition_value", "method": "method_name", "identifier": "identifier", "entity": "subject_value", "composition": "formulation_component_value"}
        if c < self.row_headers:
            turned = {"row_condition": "condition_value", "row_method": "method_name"}.get(orientation)
            by_axis = "property_name" if axis.role == "property" else named.get(axis.role, "subject_value") if axis.role != "composition" else "subject_value"
            return turned or by_axis, 0.88
        if axis.role in named:
            return named[axis.role], 0.88 if axis.role == "method" else 0.90
        if axis.role in ("property", "property_value", "value"):
            stated = next((role for role, words in RESULTS if holds(axis.label, words)), "measured_result" if is_number(text) else "qualitative_result")
            return stated, 0.82 if axis.role == "value" else 0.90
        if axis.role in ("group", "note"):
            return "qualitative_context", 0.80
        return ("unresolved_numeric" if is_number(text) else "qualitative_context"), 0.45

    @cached_property
    def plan(self) -> tuple[float, list[str], dict[str, list[int]]]:
        """(confidence, what is unresolved, the columns of every role)."""
        name, orientation, confidence, unresolved = self.topology
        axes: dict[str, list[int]] = {k: [] for k in ("entity", "identifier", "property", "value", "condition", "method", "composition", "group", "note")}
        for a in self.columns:
            for role in ("property", "value") if a.role == "property_value" else (a.role,):
                axes.setdefault(role, []).append(a.index)
        open_ = list(unresolved)
        if orientation == "row_subject" and not axes["entity"] and not self.row_headers:
            open_.append("no_subject_axis")
        if not axes["property"] and name not in ("qualitative_taxonomy", "pairwise_compatibility", "method_comparison"):
            open_.append("no_property_axis")
        lost = sum(self.cell_role(r, c)[0] == "unresolved_numeric" for r in range(self.height) for c in range(self.width))
        if lost:
            open_.append(f"unresolved_numeric_cells:{lost}")
        total = mean([confidence, self.header_confidence, *[a.confidence for a in self.columns]]) if self.columns else confidence
        if open_:
            total = max(0.2, total - min(0.2, 0.03 * len(set(open_))))
        return min(0.98, total), sorted(set(open_)), axes

    def facts(self, context: str = "") -> list[tuple]:
        """(r, c, subject, subject source, sample, property, unit, value, value role, conditions, method, confidence, status, reasons) of
        every cell that states something, by the reading that the plan asks for. context: the subject of the text around the table."""
        certainty, unresolved, axes = self.plan
        body = range(self.header_rows, self.height)
        join = lambda r, cs: " / ".join(self.text[r][c] for c in cs if self.text[r][c])
        lead = range(self.row_headers)
        used = set(axes["entity"] + axes["identifier"])
        labels = [a for a in axes["property"] if self.columns[a].role == "property" and self.columns[a].numeric <= 0.35]
        others = [c for c in range(self.width) if c not in {*labels, *used, *axes["method"], *axes["condition"], *axes["note"], *axes["group"]} and self.columns[c].labels]
        subjects = [c for c in others if names_material(self.columns[c].label) and self.columns[c].label not in _GENERIC and len(self.columns[c].label) <= 60 and self.columns[c].role not in ("property_value",)]

        def subject_of_row(r: int) -> tuple[str, str, float]:
            for cells, source, value in ((axes["entity"], "table_entity_axis", 0.94), (axes["identifier"], "table_identifier_axis", 0.90), (lead, "row_header", 0.84)):
                if found := join(r, cells):
                    return found, source, value
            return context, "context" if context else "", 0.6 if context else 0.0

        def header_of_column(r: int, c: int) -> tuple[str, str, float]:
            return self.columns[c].label, "column_header", 0.90

        if len(labels) == 1 and not used and len(subjects) >= 2:
            places, subject, label = [(r, c) for r in body for c in subjects], header_of_column, lambda r, c: self.text[r][labels[0]]
        elif len(labels) == 1 and not used and context and others:
            places, subject, label = [(r, c) for r in body for c in others if self.columns[c].role in ("property_value", "value", "composition")], lambda r, c: (context, "context", 0.6), lambda r, c: self.text[r][labels[0]]
        elif self.topology[1] in ("column_subject", "pairwise_entity"):
            places, subject, label = [(r, c) for r in body for c in range(self.row_headers, self.width)], header_of_column, lambda r, c: join(r, lead)
        else:
            outside = {*axes["entity"], *axes["identifier"], *axes["condition"], *axes["method"], *lead}
            places, subject, label = [(r, c) for r in body for c in range(self.width) if c not in outside], lambda r, c: subject_of_row(r), lambda r, c: self.columns[c].label
        out = []
        for r, c in places:
            role, sure = self.cell_role(r, c)
            if role in ("header", "empty", "unresolved_numeric"):
                continue
            name, source, weight = subject(r, c)
            prop, unit = name_and_unit(label(r, c))
            if not name:
                continue
            conditions = [f"{name_and_unit(self.columns[k].label)[0]}={self.text[r][k]} {self.columns[k].unit}".strip() for k in axes["condition"] if self.text[r][k] and k != c]
            reasons = (["subject_from_context_requires_registry_confirmation"] if source == "context" else []) + (["table_plan_low_confidence"] if certainty < 0.6 else []) + ([] if prop else ["property_name_unresolved"])
            status = "unresolved" if not prop else "candidate" if reasons else "ready"
            confidence = min(0.98, mean([certainty, weight, sure]))
            out.append((r, c, name, source, join(r, axes["identifier"]), prop, unit, self.text[r][c], role, conditions, join(r, axes["method"]), round(confidence, 6), status, reasons))
        return out


def _share_marked(texts: Sequence[str], marks: Sequence[bool]) -> float:
    filled = [m for t, m in zip(texts, marks, strict=True) if t]
    return sum(filled) / len(filled) if filled else 0.0


def _decide(axis: Axis, evidence: Sequence[tuple[str, float, bool]], most: float) -> Counter:
    """Adds up the evidence; the strongest role wins, the first named of equals, with a confidence that grows with the margin."""
    score: Counter = Counter(dict.fromkeys(dict.fromkeys(role for role, _, _ in evidence), 0.0))
    for role, points, holds_ in evidence:
        score[role] += points if holds_ else 0.0
    score["unknown"] = 0.05
    (role, top), (_, second) = sorted(score.items(), key=lambda kv: -kv[1])[:2]
    if top >= 0.25:
        axis.role, axis.confidence = role, max(0.2, min(most, 0.55 + (top - second) * 0.35))
    return score


def _tables(text: str, words: Mapping[str, tuple[str, ...]]) -> list[tuple[int, Table, str]]:
    marks = headings_of(text)
    return [(n, Table(grid_of(kind, raw), words), next((m[1] for m in reversed(marks) if m[0] < first), "")) for n, (first, _, kind, raw) in enumerate(tables_of(text), 1)]


def header_paths(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: Mapping[str, tuple[str, ...]] = WORDS) -> DataFrame:
    """id, table_no, axis, index, labels, unit, role, numeric_ratio, unique_ratio, confidence of every column and row of every table."""

    def work(text: str) -> list[tuple]:
        return [
            (n, kind, a.index, a.labels, a.unit, a.role, round(a.numeric, 6), round(a.unique, 6), round(a.confidence, 6))
            for n, t, _ in _tables(text, words)
            for kind, axes in (("column", t.columns), ("row", t.rows))
            for a in axes
        ]

    return _exploder(documents, id_col, text_col, work, "table_no int, axis string, index int, labels array<string>, unit string, role string, numeric_ratio double, unique_ratio double, confidence double")


def table_plans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: Mapping[str, tuple[str, ...]] = WORDS) -> DataFrame:
    """id, table_no, topology, orientation, header_rows, row_headers, confidence, unresolved, axes (role -> columns) of every table."""

    def work(text: str) -> list[tuple]:
        out = []
        for n, t, _ in _tables(text, words):
            confidence, unresolved, axes = t.plan
            out.append((n, t.topology[0], t.topology[1], t.header_rows, t.row_headers, round(confidence, 6), unresolved, {k: v for k, v in axes.items() if v}))
        return out

    return _exploder(documents, id_col, text_col, work, "table_no int, topology string, orientation string, header_rows int, row_headers int, confidence double, unresolved array<string>, axes map<string,array<int>>")


def cell_roles(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: Mapping[str, tuple[str, ...]] = WORDS) -> DataFrame:
    """id, table_no, r, c, role, confidence of every cell of every table."""

    def work(text: str) -> list[tuple]:
        return [(n, r, c, *t.cell_role(r, c)) for n, t, _ in _tables(text, words) for r in range(t.height) for c in range(t.width)]

    return _exploder(documents, id_col, text_col, work, "table_no int, r int, c int, role string, confidence double")


def compiled_facts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: Mapping[str, tuple[str, ...]] = WORDS, subject_of_heading: Callable[[str], str] | None = None) -> DataFrame:
    """The facts of every table: id, table_no, r, c, subject, subject_source, sample_id, property, unit, value_text, value_role, conditions,
    method, confidence, status, reasons.

    subject_of_heading may take a subject from the heading above a table that names none. Null and empty texts, tables without
    a body and cells without a subject give no row.
    """

    def work(text: str) -> list[tuple]:
        return [(n, *fact) for n, t, title in _tables(text, words) for fact in t.facts(subject_of_heading(title) if subject_of_heading else "")]

    schema = "table_no int, r int, c int, subject string, subject_source string, sample_id string, property string, unit string, value_text string, value_role string, conditions array<string>, method string, confidence double, status string, reasons array<string>"
    return _exploder(documents, id_col, text_col, work, schema)
