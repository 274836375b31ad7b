"""Problem 4: the best representative of each duplicate group, by Bayesian fusion with copy detection.

Every record type is a source that claims a value for a field of a key. Source accuracies and the dependence of each pair of
sources are estimated together: two sources that share false values more often than chance allows copy one another, and a copied
vote is discounted. The value of highest posterior is taken field by field; the record it is built on is the row of the group
that is most complete, most recent and most trusted.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.blank import is_blank, plain
from factweave.session import cut_lineage, small_rows

COMPLETE_FIELDS = ("章节路径", "来源定位", "所属表格标题", "单位", "条件文本", "方法名称", "证据文本")
FUSED_FIELDS = (*COMPLETE_FIELDS, "主体名称", "attribute_name", "尾实体/取值文本", "数值")

#: Prior of a dependence, share of values a copier takes over, number of wrong values a field can have.
DEPENDENCE, COPIED, WRONG_VALUES = 0.1, 0.8, 20
#: Rounds of estimation at most, and the change of an accuracy below which it ends.
ROUNDS, SETTLED = 12, 1e-3
#: Keys of more rows than this are grouped by value before they are grouped by key.
HOT = 4096
_PATTERN = pa.schema([("masks", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("n", pa.int64())])
#: Stands for a missing time while rows are compared.
OLDEST = "0001-01-01"
#: Sources are numbered in a bit mask of 64 bits.
MAX_SOURCES = 62


def group_key(column: Column) -> Column:
    """The 40 hex digits of a key, however it is written; null where there are none."""
    # most keys are plain ASCII; only the others may hold characters that cannot be seen
    text = F.when(column.rlike(r"[^\x00-\x7f]"), plain(column)).otherwise(column)
    found = F.regexp_extract(F.lower(text), r"(?:^|[^0-9a-f])([0-9a-f]{40})\s*$", 1)
    return F.when(found != "", found)


def source_key(column: Column) -> Column:
    return F.regexp_replace(F.lower(plain(column)), r"[\s_-]+", "_")


def _clamp(p: float) -> float:
    return min(0.99, max(0.05, p))


def _mask_score(mask: int, accuracy: dict[int, float], dependence: dict[tuple[int, int], float]) -> float:
    """Log votes of the sources in a mask; each is discounted by the chance that it copied one counted before it."""
    members = sorted((s for s in accuracy if mask >> s & 1), key=lambda s: (-accuracy[s], s))
    total = 0.0
    for i, s in enumerate(members):
        independent = 1.0
        for t in members[:i]:
            independent *= 1 - COPIED * dependence.get((min(s, t), max(s, t)), 0.0)
        total += independent * math.log(WRONG_VALUES * accuracy[s] / (1 - accuracy[s]))
    return total


def _pattern_statistics(patterns: Iterator[pd.DataFrame], accuracy: dict[int, float], dependence: dict[tuple[int, int], float]) -> Iterator[pd.DataFrame]:
    """Sufficient statistics of a set of claim patterns: (a, a, right, wrong, 0) a source, (a, b, same right, same wrong, different) a pair."""
    sums: dict[tuple[int, int], list[float]] = {}
    scores: dict[int, float] = {}
    for frame in patterns:
        for masks, counts, weight in zip(frame["masks"], frame["counts"], frame["n"], strict=True):
            for m in masks:
                if m not in scores:
                    scores[m] = _mask_score(m, accuracy, dependence)
            top = max(0.0, max(scores[m] for m in masks))
            raw = [math.exp(scores[m] - top) for m in masks]
            total = sum(r * c for r, c in zip(raw, counts, strict=True)) + math.exp(-top)
            claims: dict[int, float] = {}
            for m, r, c in zip(masks, raw, counts, strict=True):
                p = r / total
                members = [s for s in range(MAX_SOURCES) if m >> s & 1]
                for i, s in enumerate(members):
                    claims[s] = claims.get(s, 0.0) + c
                    entry = sums.setdefault((s, s), [0.0, 0.0, 0.0])
                    entry[0] += p * c * weight
                    entry[1] += (1 - p) * c * weight
                    for t in members[i + 1 :]:
                        entry = sums.setdefault((s, t), [0.0, 0.0, 0.0])
                        entry[0] += p * c * weight
                        entry[1] += (1 - p) * c * weight
                        entry[2] -= c * weight
            sources = sorted(claims)
            for i, s in enumerate(sources):
                for t in sources[i + 1 :]:
                    sums.setdefault((s, t), [0.0, 0.0, 0.0])[2] += min(claims[s], claims[t]) * weight
    yield pd.DataFrame([(a, b, *v) for (a, b), v in sums.items()], columns=["a", "b", "same_right", "same_wrong", "different"])


def dependence_of(a: float, b: float, right: float, wrong: float, different: float) -> float:
    """Posterior that one of two sources of these accuracies copies the other."""
    both_right, both_wrong = a * b, (1 - a) * (1 - b) / WRONG_VALUES
    apart = max(1e-6, 1 - both_right - both_wrong)
    mean = (a + b) / 2
    copy_right, copy_wrong = mean * COPIED + both_right * (1 - COPIED), (1 - mean) * COPIED + both_wrong * (1 - COPIED)
    ratio = right * math.log(copy_right / both_right) + wrong * math.log(copy_wrong / both_wrong) + max(0.0, different) * math.log(max(1e-6, apart * (1 - COPIED)) / apart)
    ratio = max(-50.0, min(50.0, ratio))
    odds = DEPENDENCE / (1 - DEPENDENCE) * math.exp(ratio)
    return odds / (1 + odds)


def estimate_sources(patterns: DataFrame, prior: dict[int, float]) -> tuple[dict[int, float], dict[tuple[int, int], float]]:
    """Accuracies and pairwise dependences from (masks, counts, n): distinct claim patterns and how many fields show each.

    Only sums per source and pair reach the driver.
    """
    accuracy, dependence = dict(prior), {}
    for _ in range(ROUNDS):
        now = (accuracy, dependence)
        sums = patterns.mapInPandas(lambda it, now=now: _pattern_statistics(it, *now), "a int, b int, same_right double, same_wrong double, different double")
        rows = small_rows(sums.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("same_right", "same_wrong", "different")]))
        new_accuracy = dict(accuracy)
        for r in rows:
            if r.a == r.b:
                new_accuracy[r.a] = _clamp((r.same_right + 10 * prior[r.a]) / (r.same_right + r.same_wrong + 10))
        dependence = {(r.a, r.b): dependence_of(new_accuracy[r.a], new_accuracy[r.b], r.same_right, r.same_wrong, r.different) for r in rows if r.a != r.b}
        moved = max((abs(new_accuracy[s] - accuracy[s]) for s in accuracy), default=0.0)
        accuracy = new_accuracy
        if moved < SETTLED:
            break
    return accuracy, dependence


class _Groups:
    """Rows sorted by key, as arrays: the groups of one or more Arrow batches."""

    def __init__(self, batch: pa.Table, n_fields: int) -> None:
        keys = batch.column("group_key").combine_chunks()
        self.raw = np.frombuffer(b"".join(keys.to_pylist()), dtype="S20")
        self.begin = np.flatnonzero(np.concatenate(([True], self.raw[1:] != self.raw[:-1])))
        self.size = np.diff(np.concatenate((self.begin, [len(self.raw)])))
        self.group = np.repeat(np.arange(len(self.begin)), self.size)
        self.bit = (1 << batch.column("source").to_numpy()).astype(np.int64)
        self.values = batch.column("vals").combine_chunks().flatten()
        self.n_fields = n_fields

    def claims(self, field: int, codes: np.ndarray, missing: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rows in order of group and value, first place of each value, its group, its mask of sources) of one field."""
        rows = np.flatnonzero(~missing)
        order = rows[np.lexsort((codes[rows], self.group[rows]))]
        g, v = self.group[order], codes[order]
        first = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])))) if len(order) else np.zeros(0, dtype=np.int64)
        mask = np.bitwise_or.reduceat(self.bit[order], first) if len(first) else np.zeros(0, dtype=np.int64)
        return order, first, g[first] if len(first) else first, mask


def _whole_groups(batches: Iterator[pa.RecordBatch], at_least: int = 20_000) -> Iterator[pa.Table]:
    """Batches sorted by key, regrouped so that no group is cut; a group is at most HOT rows long."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < at_least:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column("group_key").combine_chunks()
        last = keys[len(keys) - 1]
        cut = len(keys)
        while cut and keys[cut - 1] == last:
            cut -= 1
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        rows = len(keys) - cut
    if rows:
        yield pa.Table.from_batches(held)


def _patterns_of(batches: Iterator[pa.RecordBatch], n_fields: int) -> Iterator[pd.DataFrame]:
    """Claim patterns of whole groups and how many fields show each; hashes stand for the values, 0 for a missing one."""
    single: Counter = Counter()
    several: Counter = Counter()
    for table in _whole_groups(batches):
        groups = _Groups(table, n_fields)
        hashes = groups.values.to_numpy().reshape(-1, n_fields)
        for field in range(n_fields):
            codes = hashes[:, field]
            _, _, owner, mask = groups.claims(field, codes, codes == 0)
            per = np.bincount(owner, minlength=len(groups.begin))
            alone = per[owner] == 1
            for m, n in zip(*np.unique(mask[alone], return_counts=True), strict=True):
                single[int(m)] += int(n)
            at = np.flatnonzero(~alone)
            if len(at):
                cuts = np.flatnonzero(np.concatenate(([True], owner[at][1:] != owner[at][:-1])))
                for members in np.split(mask[at], cuts[1:]):
                    several[tuple(np.sort(members).tolist())] += 1
    found = [([m], [1], n) for m, n in single.items()]
    for members, n in several.items():
        counted = Counter(members)
        found.append((list(counted), list(counted.values()), n))
    yield pd.DataFrame(found, columns=["masks", "counts", "n"])


def _records_of(batches: Iterator[pa.RecordBatch], fields: tuple[str, ...], accuracy: dict[int, float], dependence: dict[tuple[int, int], float]) -> Iterator[pa.RecordBatch]:
    """Surviving records of whole groups."""
    scores: dict[int, float] = {}
    n_fields = len(fields)
    for table in _whole_groups(batches):
        groups = _Groups(table, n_fields)
        ids = table.column("id_").to_numpy()
        recent = table.column("recent").cast(pa.int64()).to_numpy()
        trusted = table.column("trusted").to_numpy()
        complete = table.column("complete").to_numpy()
        n = len(groups.begin)
        best = np.lexsort((-ids, trusted, recent, complete, groups.group))[groups.begin + groups.size - 1]
        most = [np.maximum.reduceat(x, groups.begin) for x in (complete, recent, trusted)]
        dominant = (complete[best] == most[0]) & (recent[best] == most[1]) & (trusted[best] == most[2])
        entry_group, entry_field, entry_row = [], [], []
        for field in range(n_fields):
            column = groups.values.take(pa.array(np.arange(field, len(groups.values), n_fields)))
            encoded = column.dictionary_encode()
            codes = encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            order, first, owner, mask = groups.claims(field, codes, codes < 0)
            if not len(first):
                continue
            for m in set(mask.tolist()) - scores.keys():
                scores[m] = _mask_score(m, accuracy, dependence)
            score = np.asarray([scores[m] for m in mask.tolist()])
            latest = np.maximum.reduceat(recent[order], first)
            earliest_id = np.minimum.reduceat(ids[order], first)
            rank = np.lexsort((-earliest_id, latest, score, owner))
            last = np.flatnonzero(np.concatenate((owner[rank][1:] != owner[rank][:-1], [True])))
            winner = rank[last]
            entry_group.append(owner[winner])
            entry_field.append(np.full(len(winner), field))
            entry_row.append(order[first[winner]])
        if entry_group:
            g, f, r = map(np.concatenate, (entry_group, entry_field, entry_row))
            order = np.lexsort((f, g))
            g, f, r = g[order], f[order], r[order]
        else:
            g = f = r = np.zeros(0, dtype=np.int64)
        offsets = np.searchsorted(g, np.arange(n + 1)).astype(np.int32)
        names = pa.array(fields, pa.string()).take(pa.array(f))
        values = pa.MapArray.from_arrays(pa.array(offsets), names, groups.values.take(pa.array(r * n_fields + f)))
        when = pa.array(most[1]).cast(pa.timestamp("us", "UTC"))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k.hex() for k in table.column("group_key").combine_chunks().take(pa.array(groups.begin)).to_pylist()], pa.string()),
                pa.array(groups.size, pa.int64()),
                pa.array(ids[best], pa.int64()),
                pa.array(dominant),
                pa.array(most[0], pa.int32()),
                when,
                pa.array(most[2], pa.int32()),
                values,
            ],
            names=["group_key", "n_rows", "base_row_id", "dominant", "complete", "recent", "trusted", "values"],
        )


RECORD = "group_key string, n_rows bigint, base_row_id bigint, dominant boolean, complete int, recent timestamp, trusted int, `values` map<string,string>"


def _spread_base(rows: DataFrame) -> DataFrame:
    """Base row and group maxima of keys of any size, by partial aggregation."""
    return rows.groupBy("group_key").agg(
        F.count("*").alias("n_rows"),
        F.max(F.struct("complete", "recent", "trusted", (-F.col("id_")).alias("minus_id"))).alias("best"),
        F.max("complete").alias("complete"),
        F.max("recent").alias("recent"),
        F.max("trusted").alias("trusted"),
    )


def _spread_claims(rows: DataFrame, n_fields: int) -> DataFrame:
    """One row per distinct value of a field of a key, grouped by the value too, so that a large key is spread over all tasks."""
    return (
        rows.select("group_key", "id_", F.expr("shiftleft(1L, source)").alias("bit"), "recent", F.posexplode("vals").alias("field", "value"))
        .where("value is not null")
        .groupBy("group_key", "field", "value")
        .agg(F.bit_or("bit").alias("mask"), F.max("recent").alias("recent"), F.min("id_").alias("first_id"))
    )


def fuse_records(
    facts: DataFrame,
    trust: DataFrame,
    id_col: str = "row_id",
    key_col: str = "graph_fact_key",
    source_col: str = "来源类型",
    time_col: str = "extracted_at",
    fields: tuple[str, ...] = FUSED_FIELDS,
    complete_fields: tuple[str, ...] = COMPLETE_FIELDS,
) -> DataFrame:
    """One surviving record per key: group_key, n_rows, base_row_id, dominant, complete, recent, trusted, values (map field -> value).

    base_row_id is the row that is first by completeness, then recency, then trust, then the smallest id; dominant says that it
    is at least as good as every other row of its group in each of the three. values holds the value of highest posterior of each
    field that any row fills (ties: the latest, then the one of the smallest id). Rows without a key belong to no group and give
    none; placeholders count as missing; a missing time is the oldest and an unknown source the least trusted. Repeated ids count
    as rows of their own. ids are integers. Sources the table of trust does not name are estimated each by itself, as many as the mask of
    sources has room for; beyond these, and where the source is missing, rows share one further source.

    Keys of up to HOT rows are brought together by one shuffle and worked on batch by batch as sorted arrays. Larger keys take
    another way: values are grouped before keys, so that a key with a third of all rows is spread over all tasks.
    """
    ranked = sorted((r.source_type, r.trust) for r in small_rows(trust.groupBy("source_type").agg(F.max("trust").alias("trust"))) if r.source_type)
    if len(ranked) >= MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES - 1} sources")
    # sources that the table of trust does not know are sources of their own, the most frequent first, as far as the mask reaches
    kind = source_key(F.col(f"`{source_col}`"))
    others = facts.groupBy(F.col(f"`{source_col}`").alias("s")).agg(F.count("*").alias("n")).groupBy(source_key(F.col("s")).alias("s")).agg(F.sum("n").alias("n"))
    others = others.where(F.col("s").isNotNull() & (F.col("s") != "") & ~F.col("s").isin([name for name, _ in ranked]))
    ranked += [(r.s, None) for r in others.orderBy(F.desc("n"), "s").limit(MAX_SOURCES - 1 - len(ranked)).collect()]
    fields = (*complete_fields, *[f for f in fields if f not in complete_fields])
    n_fields = len(fields)
    most = max([t or 0 for _, t in ranked], default=0) or 1
    prior = {i: _clamp(0.5 + 0.4 * (t or 0) / most) for i, (_, t) in enumerate(ranked, 1)} | {0: 0.5}
    number = F.coalesce(*[F.when(kind == name, F.lit(i)) for i, (name, _) in enumerate(ranked, 1)], F.lit(0)) if ranked else F.lit(0)
    trusted = F.coalesce(F.element_at(F.array(F.lit(-1), *[F.lit(-1 if t is None else t) for _, t in ranked]), F.col("source") + 1), F.lit(-1))
    # one small expression over an array instead of one per field: the generated method stays within what the JVM compiles
    vals = F.transform(F.array(*[F.col(f"`{f}`") for f in fields]), lambda x: F.when(~is_blank(x), x))
    rows = (
        facts.select(F.unhex(group_key(F.col(f"`{key_col}`"))).alias("group_key"), F.col(f"`{id_col}`").cast("bigint").alias("id_"), number.cast("int").alias("source"), F.coalesce(F.col(f"`{time_col}`").cast("timestamp"), F.lit(OLDEST).cast("timestamp")).alias("recent"), vals.alias("vals"))
        .where("group_key is not null")
        .withColumns({"trusted": trusted.cast("int"), "complete": F.size(F.filter(F.slice("vals", 1, len(complete_fields)), lambda x: x.isNotNull()))})
    )
    keys = facts.select(F.unhex(group_key(F.col(f"`{key_col}`"))).alias("group_key")).where("group_key is not null")
    hot = cut_lineage(keys.groupBy("group_key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("group_key"))
    any_hot = not hot.isEmpty()
    cold = rows.join(hot, "group_key", "left_anti") if any_hot else rows
    spread = rows.join(hot, "group_key", "left_semi")

    # what is estimated needs no texts, only hashes of the values
    hashed = F.transform("vals", lambda x: F.when(x.isNull(), F.lit(0).cast("bigint")).otherwise(F.xxhash64(x)))
    masks = (
        cold.select("group_key", "source", hashed.alias("vals"))
        .repartition("group_key")
        .sortWithinPartitions("group_key")
        .mapInArrow(lambda it: (pa.RecordBatch.from_pandas(f, schema=_PATTERN, preserve_index=False) for f in _patterns_of(it, n_fields)), "masks array<bigint>, counts array<bigint>, n bigint")
    )
    if any_hot:
        large = (
            _spread_claims(spread.withColumn("vals", F.transform("vals", lambda x: F.when(x.isNotNull(), F.xxhash64(x).cast("string")))), n_fields)
            .groupBy("group_key", "field", "mask")
            .agg(F.count("*").alias("c"))
            .groupBy("group_key", "field")
            .agg(F.sort_array(F.collect_list(F.struct("mask", "c"))).alias("p"))
            .select(F.col("p.mask").alias("masks"), F.col("p.c").alias("counts"), F.lit(1).cast("bigint").alias("n"))
        )
        masks = masks.unionByName(large)
    patterns = cut_lineage(masks.groupBy("masks", "counts").agg(F.sum("n").alias("n")))
    accuracy, dependence = estimate_sources(patterns, prior)

    columns = ["group_key", "id_", "source", "recent", "trusted", "complete", "vals"]
    records = (
        cold.select(*columns)
        .repartition("group_key")
        .sortWithinPartitions("group_key")
        .mapInArrow(lambda it: _records_of(it, fields, accuracy, dependence), RECORD)
    )
    if any_hot:
        occurring = small_rows(patterns.select(F.explode("masks").alias("mask")).distinct())
        scores = facts.sparkSession.createDataFrame([(r.mask, _mask_score(r.mask, accuracy, dependence)) for r in occurring], "mask bigint, score double")
        chosen = (
            _spread_claims(spread, n_fields)
            .join(F.broadcast(scores), "mask")
            .groupBy("group_key", "field")
            .agg(F.max_by("value", F.struct("score", "recent", (-F.col("first_id")).alias("minus_id"))).alias("value"))
            .groupBy("group_key")
            .agg(F.map_from_entries(F.collect_list(F.struct(F.element_at(F.array(*map(F.lit, fields)), F.col("field") + 1), "value"))).alias("values"))
        )
        dominant = (F.col("best.complete") == F.col("complete")) & (F.col("best.recent") == F.col("recent")) & (F.col("best.trusted") == F.col("trusted"))
        records = records.unionByName(
            _spread_base(spread).join(chosen, "group_key", "left").select(
                F.lower(F.hex("group_key")).alias("group_key"), "n_rows", (-F.col("best.minus_id")).alias("base_row_id"), dominant.alias("dominant"), "complete", "recent", "trusted", F.coalesce("values", F.create_map().cast("map<string,string>")).alias("values")
            )
        )
    return records.withColumn("recent", F.nullif("recent", F.lit(OLDEST).cast("timestamp")))


def dominant_rows(facts: DataFrame, trust: DataFrame, **columns: str) -> DataFrame:
    """The ids of surviving records that no other row of their group of two or more surpasses in anything, checked exactly."""
    id_col = columns.get("id_col", "row_id")
    fused = fuse_records(facts, trust, **columns)
    # the surviving record must hold at least what its base row holds; then the three comparisons decide
    held = F.size(F.filter(F.map_keys("values"), lambda k: k.isin(*columns.get("complete_fields", COMPLETE_FIELDS))))
    return fused.where((F.col("n_rows") >= 2) & F.col("dominant") & (F.greatest(held, F.lit(0)) >= F.col("complete"))).select(F.col("base_row_id").alias(id_col))
