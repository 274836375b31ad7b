"""Problem 8: records of several sources mixed to target weights, by subset-sum budget fitting.

Each source has a budget of tokens. It is met by a bounded knapsack over the counts of documents of each exact length and their
repeats, whole repeats first, and the documents of each length are drawn in a seeded order.
"""

from __future__ import annotations

from math import gcd

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.tokens import TOKENIZER, place_by_rank, with_tokens
from factweave.session import cut_lineage, small_rows

#: Sums up to this size are searched whole at once; beyond it the search first stays within windows of growing size.
WINDOW = 1 << 16


def _even_share(counts: dict[int, int], budget: int, room: int) -> dict[int, int]:
    """An even share of every length whose sum lies below the budget, by no more than room where whole documents allow it."""
    total = sum(length * n for length, n in counts.items())
    taken = {length: n * max(0, budget - room // 2) // total for length, n in counts.items()}
    left = budget - sum(length * n for length, n in taken.items())
    for length in sorted(counts, reverse=True):
        more = min(counts[length] - taken[length], max(0, left - room) // length)
        taken[length] += more
        left -= more * length
    return taken


def _spread(reached: np.ndarray, step: int, times: int) -> np.ndarray:
    """For every remainder the least number of steps (0..times) that leads to it from a reached one; -1 where none does."""
    size = len(reached)
    cycles = gcd(step, size)
    length = size // cycles
    places = (np.arange(cycles)[:, None] + np.arange(length)[None, :] * step) % size
    seen = np.tile(reached[places], (1, 2))
    last = np.maximum.accumulate(np.where(seen, np.arange(2 * length)[None, :], -1), axis=1)[:, length:]
    steps = np.where(last >= 0, np.arange(length, 2 * length)[None, :] - last, -1)
    out = np.empty(size, dtype=np.int64)
    out[places] = np.where(steps > times, -1, steps)
    return out


def _by_remainders(counts: dict[int, int], budget: int) -> tuple[int, dict[int, int] | None]:
    """(bound, documents): no sum not above the budget is above the bound; the documents reach it, if any were found that do.

    Sums are looked at modulo one length of which there are plenty. The remainders that the other lengths reach, none used more
    often than it is there, bound the sum from above; the way to the best of them, begun at an even share of every length, is a
    sum of documents if the plentiful length can make up for the difference.
    """
    base = _even_share(counts, budget, WINDOW)
    pivot = max(counts, key=lambda x: (min(base[x], counts[x] - base[x]) * x, x))
    reached = np.zeros(pivot, dtype=bool)
    reached[sum(x * base[x] for x in counts if x != pivot) % pivot] = True
    trail: list[tuple[int, np.ndarray, np.ndarray]] = []
    for length in sorted(counts):
        if length == pivot or reached.all():
            continue
        more = _spread(reached, length % pivot, min(counts[length] - base[length], pivot)) if length % pivot else np.where(reached, 0, -1)
        less = _spread(reached, -length % pivot, min(base[length], pivot)) if length % pivot else more
        change = np.where(more >= 0, np.where((less >= 0) & (less < more), -less, more), -less)
        grown = (more >= 0) | (less >= 0)
        trail.append((length, change, grown))
        reached = grown
    sums = budget - np.arange(pivot)
    bound = int(sums[np.flatnonzero(reached[sums % pivot])[0]])
    taken, at = dict(base), bound % pivot
    for length, change, _ in reversed(trail):
        taken[length] += int(change[at])
        at = (at - int(change[at]) * length) % pivot
    taken[pivot] = (bound - sum(x * n for x, n in taken.items() if x != pivot)) // pivot
    return bound, taken if 0 <= taken[pivot] <= counts[pivot] else None


def _by_sums(counts: dict[int, int], base: dict[int, int], rest: int, wanted: int) -> dict[int, int]:
    """The documents beside those of base whose sum is the greatest not above rest; the search ends when it meets what is wanted."""
    window = (1 << rest + 1) - 1
    sums = 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted(counts):
        if sums >> wanted & 1 or length > rest:
            break
        left = min(counts[length] - base[length], rest // length)
        size = 1
        while left > 0 and not sums >> wanted & 1:
            n = min(size, left)
            grown = sums | sums << length * n & window
            if grown != sums:
                steps.append((length, n, sums))
                sums = grown
            left -= n
            size *= 2
    taken = dict(base)
    at = wanted if sums >> wanted & 1 else sums.bit_length() - 1
    for length, n, before in reversed(steps):
        if not before >> at & 1:
            taken[length] += n
            at -= length * n
    return taken


def fit_budget(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length to take so that their sum is the greatest not above the budget, whatever its size.

    counts: length -> documents. A sum is proven the greatest if it meets the budget, or the bound that the remainders modulo a
    length set. Large budgets are searched in windows above an even share of every length, each sixteen times as wide as the one
    before, until the proof holds or the window is the whole budget, where the search over sums (held as bits) is exact by itself.
    """
    counts = {length: n for length, n in counts.items() if length > 0 and n > 0}
    total = sum(length * n for length, n in counts.items())
    if budget >= total:
        return counts
    if budget <= 0:
        return {}
    unit = gcd(*counts)
    scaled, goal = {length // unit: n for length, n in counts.items()}, budget // unit
    bound, taken = goal, None
    if goal > max(WINDOW, 4 * max(scaled)):
        bound, taken = _by_remainders(scaled, goal)
    width = max(WINDOW, 4 * max(scaled))
    while taken is None:
        base = _even_share(scaled, goal, width) if width < goal else dict.fromkeys(scaled, 0)
        rest = goal - sum(length * n for length, n in base.items())
        found = _by_sums(scaled, base, rest, rest - (goal - bound))
        if width >= goal or sum(length * n for length, n in found.items()) == bound:
            taken = found
        width *= 16
    return {length * unit: n for length, n in taken.items() if n}


def repeats_for(counts: dict[int, int], budget: int, max_repeats: int) -> dict[int, int]:
    """Uses of each length, every document at most max_repeats times, with the greatest sum not above the budget.

    Even repeats with each document at most once more are taken if they meet the budget; else the knapsack is over all repeats.
    """
    counts = {length: n for length, n in counts.items() if length > 0 and n > 0}
    total = sum(length * n for length, n in counts.items())
    if not total or budget <= 0 or max_repeats <= 0:
        return {}
    whole, rest = divmod(min(budget, total * max_repeats), total)
    even = {length: n * whole for length, n in counts.items()}
    if rest:
        for length, n in fit_budget(counts, rest).items():
            even[length] += n
    if sum(length * n for length, n in even.items()) < min(budget, total * max_repeats):
        even = fit_budget({length: n * max_repeats for length, n in counts.items()}, budget)
    return {length: n for length, n in even.items() if n}


def budgets(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, int]:
    """Tokens each source is to give: the largest mixture in which every source that has documents keeps its share and its cap on
    repeats, or the total asked for if that is smaller. Shares are scaled to the sources that have documents."""
    present = {s: targets[s] for s in targets if tokens.get(s, 0) > 0 and targets[s][0] > 0 and targets[s][1] > 0}
    whole = sum(share for share, _ in present.values())
    if not whole:
        return {}
    largest = min(tokens[s] * repeats / (share / whole) for s, (share, repeats) in present.items())
    size = largest if total is None else min(total, largest)
    return {s: min(int(round(size * share / whole)), tokens[s] * repeats) for s, (share, repeats) in present.items()}


#: Different lengths of all sources that the driver takes; a length is bounded by the longest text, whatever the number of documents.
LENGTHS = 1 << 23


def clean_sources(documents: DataFrame, books: DataFrame) -> DataFrame:
    """doc_id, text, source: the source of the book where the book is known, else the document's own, in lower case with underscores."""
    own = F.regexp_replace(F.lower(F.trim("d.source")), r"[\s-]+", "_")
    known = F.broadcast(books.select("book_id", F.col("source").alias("book_source")).dropDuplicates(["book_id"]))
    return documents.alias("d").join(known, "book_id", "left").select("doc_id", "text", F.coalesce("book_source", own).alias("source"))


def mix_sources(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(selection, report): selection has source, doc_id, tokens, repeats for every document used; report has, for every source of
    the targets, target_share, actual_share, target_tokens, actual_tokens, max_repeats, n_documents.

    documents: doc_id, text, source; targets: source, target_share, max_repeats (a small fixed table). Documents without tokens or
    of no target source are not used; sources without documents give nothing and are reported with an actual share of 0. Repeated
    rows are documents of their own. The driver sees the counts per source and
    length; documents meet their plan by rank, in the shuffle that ranks them, and the plan is not broadcast.
    """
    spark = documents.sparkSession
    wanted = {r.source: (r.target_share or 0.0, r.max_repeats or 0) for r in small_rows(targets.select("source", "target_share", "max_repeats")) if r.source}
    used = documents.select("doc_id", "text", "source").where(F.col("source").isin(list(wanted)))
    sized = cut_lineage(with_tokens(used, "text", tokenizer).select("source", "doc_id", "tokens").where("tokens > 0"))
    lengths: dict[str, dict[int, int]] = {}
    for r in small_rows(sized.groupBy("source", "tokens").agg(F.count("*").alias("n")), LENGTHS):
        lengths.setdefault(r.source, {})[r.tokens] = r.n
    tokens = {s: sum(length * n for length, n in c.items()) for s, c in lengths.items()}
    budget = budgets(tokens, wanted, total)
    plan, report = [], []
    for s, (share, repeats) in wanted.items():
        uses = repeats_for(lengths.get(s, {}), budget.get(s, 0), repeats)
        n_documents = 0
        for length, n in uses.items():
            there = lengths[s][length]
            whole, extra = divmod(n, there)
            n_documents += there if whole else extra
            plan += [(s, length, *run) for run in ((0, extra, whole + 1), (extra, there, whole)) if run[1] > run[0] and run[2]]
        report.append((s, share, budget.get(s, 0), sum(length * n for length, n in uses.items()), repeats, n_documents))
    all_used = sum(r[3] for r in report) or 1
    counted = [(s, share, used / all_used, size, used, repeats, n) for s, share, size, used, repeats, n in report]
    runs = spark.createDataFrame(plan, "source string, tokens int, first_rank bigint, end_rank bigint, repeats int")
    selection = place_by_rank(sized, ["source", "tokens"], ["doc_id"], runs, seed).select("source", "doc_id", "tokens", "repeats")
    reported = spark.createDataFrame(counted, "source string, target_share double, actual_share double, target_tokens bigint, actual_tokens bigint, max_repeats int, n_documents bigint")
    return selection, reported
