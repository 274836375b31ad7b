"""Problem 6: text that reads the same but differs in its characters, brought to one form.

Code points and strings are joined into look-alike classes by union-find: width, composition, compatibility radicals, signs drawn
alike, invisible characters, and over all planes the public table of confusable characters, which joins strings too (ligatures).
A member that differs only in width or composition is rewritten to what it is composed of; any other to the most frequent member of
its class in the corpus that is of its kind. Texts are rewritten greedily by a multi-pattern automaton. Letters of scripts that words
are really written in are settled per word, as the script depends on the neighbours, and whole names by the registry or, beyond it,
by the most frequent spelling of all names that look the same.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions.fold import FOLDED_PLANES, LOOKALIKE_FROM, LOOKALIKE_TO, fold_char
from factweave.session import cut_lineage, small_rows, spread_join

# Full-width forms that are ordinary East Asian punctuation, and signs that are not taken for another one.
ORDINARY = "（）［］｛｝，：；！？～｜。、"
DISTINCT_SIGNS = "–•・"
# Characters of ASCII that are drawn alike; both are plain, so neither is rewritten, but both can represent a class.
ASCII_LOOKS = (("1", "l"), ("I", "l"), ("0", "O"))

#: Texts of these characters alone hold nothing to rewrite; a native filter keeps them away from Python.
PLAIN_TEXT = r"^[\x20-\x7e\n\r\t一-鿿（）［］｛｝，：；！？。、·×±≤≥℃℉‰²³⁰¹⁴-⁻①-⑳“”‘’「」『』μΩⅠ-Ⅿⅰ-ⅿ°]*$"

_WORD = re.compile("[A-Za-zÀ-ɏͰ-ϿЀ-ӿḀ-ỿἀ-῿]+")
_TO_LATIN = {a: b for a, b in zip(LOOKALIKE_FROM, LOOKALIKE_TO, strict=True) if a.isalpha() and b.isalpha()}
_TO_CYRILLIC = {b: a for a, b in _TO_LATIN.items() if "Ѐ" <= a <= "ӿ"}
_LOWER_KEY = {a.lower(): b.lower() for a, b in _TO_LATIN.items() if a.isupper()} | {a: b for a, b in _TO_LATIN.items() if a.islower() and a != "ν"}


class UnionFind:
    """Classes of hashable members, with path halving."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def classes(self) -> list[list]:
        groups: dict = {}
        for x in self.parent:
            groups.setdefault(self.find(x), []).append(x)
        return [sorted(g) for g in groups.values()]


@lru_cache(maxsize=1)
def code_point_edges() -> tuple[tuple[str, str], ...]:
    """(variant, plain form) of every code point or composed sequence that differs from another in width, composition or not at all."""
    edges = []
    for code in FOLDED_PLANES:
        ch = chr(code)
        if ch in ORDINARY or ch in DISTINCT_SIGNS:
            continue
        plain = fold_char(ch)
        if plain != ch:
            edges.append((ch, plain))
        parts = unicodedata.decomposition(ch)
        if parts and not parts.startswith("<") and " " in parts:
            sequence = unicodedata.normalize("NFD", ch)
            if unicodedata.normalize("NFC", sequence) == ch and len(sequence) <= 4 and not 0xAC00 <= code < 0xD7A4:
                edges.append((sequence, ch))
    return tuple(edges)


def _may_stand_for_another(ch: str) -> bool:
    """Letters and styled digits that no word of the languages here is written with: phonetic, Cherokee, Lisu, mathematical, ligatures,
    further Cyrillic. Letters of Latin languages, Greek and Russian ones, numerals and signs are ordinary."""
    code, kind = ord(ch), unicodedata.category(ch)
    if code < 0x250 or 0x370 <= code < 0x400 or 0x410 <= code < 0x450 or code in (0x401, 0x451) or 0x1E00 <= code < 0x2000 or 0x2150 <= code < 0x2190:
        return False
    return kind in ("Lu", "Ll", "Lt", "Lo", "Lm") or kind == "Nd" and unicodedata.decomposition(ch).startswith("<font>")


@lru_cache(maxsize=1)
def confusable_edges(jvm) -> tuple[tuple[str, str], ...]:
    """(variant, what it looks like) by the confusables of Unicode that the ICU library Spark ships holds, for code points of all planes
    that may stand for ASCII letters or digits or for strings of them."""
    checker = jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    skip = ((0x2E80, 0xA000), (0xAC00, 0xE000), (0x20000, 0x32000))
    chars = [chr(c) for c in range(0x250, 0x110000) if not any(a <= c < b for a, b in skip)]
    chars = [c for c in chars if _may_stand_for_another(c)]
    looks = checker.getSkeleton(0, "\n".join(chars)).split("\n")
    return tuple((a, b) for a, b in zip(chars, looks, strict=True) if a != b and b.isascii() and b.isalnum())


def rewrite_rules(frequency: dict[str, int], confusables: Iterable[tuple[str, str]] = ()) -> dict[str, str]:
    """variant -> representative.

    frequency: how often each code point occurs. A variant that differs from a plain form only in width or composition, or is not seen,
    becomes this form. Any other becomes the most frequent ASCII member of its class, of those of its own kind (digit, capital, small
    letter) if there are any; ties go to what it is composed of, then to the smaller one.
    """
    plain_of = dict(code_point_edges())
    rules = {v: plain_of.get(p, p) for v, p in plain_of.items()}
    sets = UnionFind()
    confusables = [(v, look) for v, look in confusables if v not in plain_of]
    looks = {look for _, look in confusables}
    for variant, look in confusables:
        sets.union(variant, look)
    # what looks alike within ASCII joins the classes too: capital I and the digit 1 look like a small l, the digit 0 like a capital O
    for a, b in ASCII_LOOKS:
        sets.union(a, b)
    for members in sets.classes():
        plains = [m for m in members if m.isascii()]
        single = [m for m in plains if len(m) == 1]
        for variant in members:
            if variant.isascii():
                continue
            composed = unicodedata.normalize("NFKC", variant)
            if composed in plains or composed.isascii() and composed.isalnum():
                rules[variant] = composed
                continue
            kind = [m for m in single if unicodedata.category(m) == unicodedata.category(variant)] or single or [m for m in plains if m in looks]
            if kind:
                rules[variant] = max(sorted(kind), key=lambda m: sum(frequency.get(c, 0) for c in m))
    return rules


@lru_cache(maxsize=4)
def _automaton(rules: tuple[tuple[str, str], ...]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for variant, plain in rules:
        automaton.add_word(variant, (len(variant), plain))
    automaton.make_automaton()
    return automaton


def rewrite(text: str, automaton) -> str:
    """Greedy rewriting from left to right, longest pattern first."""
    out, last = [], 0
    for end, (size, plain) in automaton.iter_long(text):
        out.append(text[last : end - size + 1])
        out.append(plain)
        last = end + 1
    if not last:
        return text
    out.append(text[last:])
    return "".join(out)


def settle_word(word: str) -> str:
    """A word with letters of one script: look-alikes go over to the script that the others prove, Latin where none does."""
    foreign = [c for c in word if "Ͱ" <= c <= "ӿ"]
    if not foreign:
        return word
    native = [c for c in word if not "Ͱ" <= c <= "ӿ"]
    if all(c in _TO_LATIN for c in foreign):
        return "".join(_TO_LATIN.get(c, c) for c in word)
    latin_form = "".join(_TO_LATIN.get(c, c) for c in word)
    proven_cyrillic = any("Ѐ" <= c <= "ӿ" and c not in _TO_LATIN for c in foreign)
    if proven_cyrillic and all(c in _TO_CYRILLIC for c in latin_form if not "Ͱ" <= c <= "ӿ"):
        return "".join(_TO_CYRILLIC.get(c, c) for c in latin_form)
    return latin_form if native and not proven_cyrillic else word


def registry_names(registry: DataFrame, to_canonical: bool) -> dict[str, str]:
    """Look key to the spelling of the registry; a proper form goes before an alias, then the smaller one counts."""
    found: dict[str, str] = {}
    rows = sorted(((r.canonical, sorted(a for a in r.aliases or [] if a)) for r in small_rows(registry.select("canonical", "aliases")) if r.canonical))
    for canonical, _ in rows:
        found.setdefault(look_key(canonical), canonical)
    for canonical, aliases in rows:
        for alias in aliases:
            found.setdefault(look_key(alias), canonical if to_canonical else alias)
    return found


def look_key(text: str) -> str:
    """Equal for texts that look the same apart from upper and lower case."""
    return "".join(_LOWER_KEY.get(c, c) for c in text.lower())


def code_point_counts(cells: DataFrame, column: str) -> dict[str, int]:
    """How often each code point occurs; counted per partition, so that at most one row a code point and partition is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, dtype=np.int64)
        for batch in batches:
            text = "".join(x for x in batch.column(0).to_pylist() if x)
            codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            np.add.at(total, *np.unique(codes, return_counts=True))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["code", "n"])

    counted = cells.select(F.col(column)).mapInArrow(count, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    return {chr(r.code): r.n for r in small_rows(counted, 0x110000)}


def unify(text: str, field: str, automaton, names: dict[str, str], name_fields: tuple[str, ...]) -> str:
    """One form of a text; names of the registry keep its spelling, upper and lower case stay as they are."""
    base = unicodedata.normalize("NFC", rewrite(text, automaton))
    if field in name_fields:
        known = names.get(look_key(base.strip()))
        if known is not None:
            return base if base.strip().lower() == known.lower() else known
    return _WORD.sub(lambda m: settle_word(m[0]), base)


def unify_text(
    facts: DataFrame,
    registry: DataFrame,
    id_col: str = "row_id",
    fields: Iterable[str] = ("主体名称", "尾实体/取值文本", "单位"),
    name_fields: Iterable[str] = ("主体名称",),
) -> DataFrame:
    """Rows of the fields whose text holds a character to rewrite: id, field_name, text, unified.

    Text that is already in its one form gives no row, null and empty text neither. Case, ordinary East Asian punctuation, signs
    such as ℃ or ²  and names the registry spells in another script stay as they are. registry: columns canonical and aliases, a
    small fixed table. Names beyond the registry that look the same get one spelling by consistent_names, not here.
    """
    fields, name_fields = tuple(fields), tuple(name_fields)
    spellings = registry_names(registry, False)
    cells = (
        facts.select(
            F.col(f"`{id_col}`").alias("id_"),
            F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").alias("text")) for f in fields])).alias("c"),
        )
        .select("id_", "c.field_name", "c.text")
        .where("text is not null and text <> ''")
    )
    rules = tuple(sorted(rewrite_rules(code_point_counts(cells, "text"), confusable_edges(facts.sparkSession._jvm)).items()))
    shared = facts.sparkSession.sparkContext.broadcast((rules, spellings))

    @F.pandas_udf("string")
    def unified(field: pd.Series, text: pd.Series) -> pd.Series:
        rule_items, names = shared.value
        automaton = _automaton(rule_items)
        seen: dict[tuple[str, str], str] = {}
        out = []
        for key in zip(field, text, strict=True):
            if key not in seen:
                seen[key] = unify(key[1], key[0], automaton, names, name_fields)
            out.append(seen[key])
        return pd.Series(out)

    candidates = cells.where(~F.col("text").rlike(PLAIN_TEXT)).withColumn("unified", unified("field_name", "text"))
    return candidates.where("unified <> text").select(F.col("id_").alias(id_col), "field_name", "text", "unified")


def consistent_names(facts: DataFrame, registry: DataFrame, id_col: str = "row_id", field: str = "主体名称") -> DataFrame:
    """One consistent name a row: id, name. Registry spelling where the registry knows the name, else the most frequent spelling
    of all names that look the same (ties: the smaller one). Null and empty names give no row; repeated ids give one row each.

    Distinct texts are unified and counted once each; rows meet their name in a join spread over salts, so a name that a third of
    all rows hold is no hot key.
    """
    known = registry_names(registry, True)
    shared = facts.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf("key string, name string")
    def keyed(text: pd.Series) -> pd.DataFrame:
        keys = text.map(look_key)
        return pd.DataFrame({"key": keys, "name": keys.map(shared.value)})

    names = facts.select(F.col(f"`{id_col}`").alias("id_"), F.col(f"`{field}`").alias("raw")).where("raw is not null and raw <> ''")
    distinct = cut_lineage(names.groupBy("raw").agg(F.count("*").alias("n")))
    changed = unify_text(distinct.select("raw", F.col("raw").alias(field)), registry, "raw", (field,), (field,)).select("raw", "unified")
    counted = cut_lineage(distinct.join(changed, "raw", "left").withColumn("text", F.trim(F.coalesce("unified", "raw"))).withColumn("k", keyed("text")).select("raw", "text", "n", "k.*"))
    spelled = counted.groupBy("key", "text").agg(F.sum("n").alias("n"), F.max("name").alias("known"))
    groups = spelled.groupBy("key").agg(F.max("n").alias("most"), F.max("known").alias("known"))
    usual = spelled.join(groups.select("key", "most"), "key").where("n = most").groupBy("key").agg(F.min("text").alias("usual"))
    mapping = counted.select("raw", "key").join(groups.join(usual, "key"), "key").select("raw", F.coalesce("known", "usual").alias("name"))
    return spread_join(names, mapping, "raw", "id_").select(F.col("id_").alias(id_col), "name")
