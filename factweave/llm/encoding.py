"""Problem 9: text decoded with the wrong character encoding, found and restored.

A noisy channel: the bytes behind a suspicious span are laid out as a lattice, in which a replacement character is a wildcard for
bytes that are lost; the right decoding is read off it by a Viterbi search under the frequencies of words and character pairs of
the whole corpus. The decodings of all channels are arcs of one lattice beside the text as it is written; a span counts as damaged if
the best path takes its decoding, which has to be more frequent in the corpus than what is written. The frequencies are
counts in a table of fixed size, filled from all documents.
"""

from __future__ import annotations

import math
import re
from bisect import bisect, bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots of the frequency table; its size does not follow the corpus.
SLOTS = 1 << 20
#: How much more frequent (in nats a pair) a decoding has to be than what is written.
GAIN = 1.2
#: The same for a word of three letters or fewer.
SHORT_GAIN = 4.2
LOST = "\ufffd"

# What the replacement character's own UTF-8 bytes look like when they are read as GBK.
REPLACED = re.compile("锟斤|斤拷|锟[^\x00-\x7f]{1,2}拷|锟[�拷较酵狡借截教接]|�|[\x80-\x84\x86-\x9f]|[-]")
# One-byte encodings that bytes are read in by mistake.
ONE_BYTE = ("cp1252", "mac_roman", "cp437", "cp850", "cp866", "cp1251", "koi8_r", "cp1250", "mac_cyrillic")
# Those of them that have no character for some bytes.
HOLED = ("cp1252", "cp1251", "cp1250")
# Fixed values: (encoding the text was written in, encoding it was read in), both of one byte, for Cyrillic words.
SWAPPED = (("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("iso8859_5", "cp1251"), ("cp866", "cp1252"), ("iso8859_5", "cp1252"))


@lru_cache(maxsize=32)
def byte_of(codec: str) -> dict[str, int]:
    """Character to byte for the upper half of an encoding; bytes without a character stand for themselves."""
    table: dict[str, int] = {}
    for byte in range(0x80, 0x100):
        try:
            table.setdefault(bytes([byte]).decode(codec), byte)
        except UnicodeDecodeError:
            pass
    for byte in range(0x80, 0x100):
        table.setdefault(chr(byte), byte)
    return table


def _class(codec: str, low: int, high: int) -> str:
    return "".join(re.escape(c) for c, b in byte_of(codec).items() if low <= b <= high)


@lru_cache(maxsize=32)
def utf8_pattern(codec: str) -> re.Pattern:
    """UTF-8 read in a one-byte encoding: a lead byte and as many trail bytes as it asks for."""
    tail = _class(codec, 0x80, 0xBF)
    return re.compile(f"(?:[{_class(codec, 0xC2, 0xDF)}][{tail}]|[{_class(codec, 0xE0, 0xEF)}][{tail}]{{2}}|[{_class(codec, 0xF0, 0xF4)}][{tail}]{{3}})+")


@lru_cache(maxsize=32)
def utf8_region(codec: str) -> re.Pattern:
    """Where such text may begin: one lead byte and one trail byte, then any of both; quick to search for."""
    leads, tail = _class(codec, 0xC2, 0xF4), _class(codec, 0x80, 0xBF)
    return re.compile(f"[{leads}][{tail}][{leads}{tail}]*")


@lru_cache(maxsize=32)
def _leads_and_tails(codec: str) -> tuple[frozenset, frozenset]:
    table = byte_of(codec).items()
    return frozenset(c for c, b in table if 0xC2 <= b <= 0xF4), frozenset(c for c, b in table if 0x80 <= b <= 0xBF)


_HIGH = _class("cp1252", 0x81, 0xFF)
#: GBK read as a one-byte encoding: pairs of high bytes, the second of a pair may be a letter.
GBK_AS_LATIN = re.compile(f"[{_HIGH}]{{2,}}(?:[{_HIGH}]|[0-9@-~](?=[{_HIGH}]))*")
_SWAP_WORD = re.compile("[^\x00-\x7f\u3000-\uffef]{3,}")
#: Blocks that restored text may come from: Latin-1, Greek, Cyrillic, punctuation and signs, CJK.
_PLAUSIBLE = re.compile("[\x00-\x7f\xa0-\xff\u0152\u0153\u0370-\u045f\u2010-\u22ff\u2460-\u24ff\u2500-\u25ff\u3000-\u303f\u4e00-\u9fff\uff00-\uffef\ufffd]*")
NON_ASCII = re.compile("[^\x00-\x7f]+")
#: UTF-8 of the blocks that restored text may come from.
_UTF8_UNIT = re.compile(rb"(?:[\xc2\xc3\xc5\xce-\xd1][\x80-\xbf]|\xe2[\x80-\x97][\x80-\xbf]|\xe3\x80[\x80-\xbf]|[\xe4-\xe9][\x80-\xbf]{2}|\xef[\xbc-\xbf][\x80-\xbf])+")
_LETTERS = re.compile(r"[^\W\d_\u2e80-\u9fff]+")
#: Native filter: text of ASCII alone cannot be damaged in these ways.
HAS_NON_ASCII = "[^\\x00-\\x7f]"


def _slots_of_pairs(codes: np.ndarray) -> np.ndarray:
    """Slots of neighbouring code points of which one at least is not ASCII."""
    left, right = codes[:-1].astype(np.uint64), codes[1:].astype(np.uint64)
    pair = (left * np.uint64(0x9E3779B1) + right * np.uint64(0x85EBCA77)) & np.uint64(0xFFFFFFFF)
    pair ^= pair >> np.uint64(15)
    return ((pair * np.uint64(0x2C1B3C6D)) >> np.uint64(7)) & np.uint64(SLOTS - 1)


def pair_slots(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(codes) < 2:
        return np.zeros(0, dtype=np.uint64)
    wide = (codes[:-1] > 127) | (codes[1:] > 127)
    return _slots_of_pairs(codes)[wide]


@lru_cache(maxsize=65536)
def word_slot(word: str) -> int:
    value = 2166136261
    for byte in word.lower().encode("utf-8"):
        value = ((value ^ byte) * 16777619) & 0xFFFFFFFF
    return (value ^ value >> 13) & (SLOTS - 1)


def alphabetic_words(text: str) -> list[str]:
    """Words of letters outside the Han script that hold one beyond ASCII; Han text counts by pairs."""
    return [w for w in _LETTERS.findall(text) if not w.isascii()]


def corpus_frequencies(documents: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of character pairs and words of all documents in SLOTS slots; one partial table per partition is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            slots = [pair_slots("\n".join(texts))]
            words = [word_slot(w) for t in texts for w in alphabetic_words(t)]
            slots.append(np.asarray(words, dtype=np.uint64))
            total += np.bincount(np.concatenate(slots).astype(np.int64), minlength=SLOTS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["slot", "n"])

    counted = documents.select(text_col).where(F.col(text_col).rlike(HAS_NON_ASCII)).mapInArrow(count, "slot int, n bigint")
    table = np.zeros(SLOTS, dtype=np.float32)
    # at most one row a slot, whatever the corpus
    sums = counted.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table[sums.column("slot").to_numpy()] = sums.column("n").to_numpy()
    return table


def pair_slot(a: str, b: str) -> int:
    """The slot of one pair, as in the vectorised form."""
    pair = (ord(a) * 0x9E3779B1 + ord(b) * 0x85EBCA77) & 0xFFFFFFFF
    pair ^= pair >> 15
    return (pair * 0x2C1B3C6D >> 7) & (SLOTS - 1)


class Model:
    """Frequencies as log scores."""

    #: Pairs whose score is kept at hand.
    CACHE = 400_000
    #: Pairs and words of the corpus that the thresholds are counts in; in others they are as large a share.
    PER = 4.4e7
    #: Score of what was seen twice, the least that is counted.
    SEEN = math.log(2.3)

    def __init__(self, table: np.ndarray) -> None:
        # what was seen once may be no more than the damage itself
        self.logs = np.log(np.where(table > 1, table, 0) + 0.3)
        #: How far apart the scores of two pairs can be.
        self.reach = max(float(self.logs.max()), 0.0) - min(float(self.logs.min()), 0.0)
        self.shift = math.log(max(float(table.sum(dtype=np.float64)), 1.0) / self.PER)
        self._seen: dict[str, float] = {}
        self._words: dict[str, object] = {}

    def least(self, threshold: float) -> float:
        """A threshold for the size of this corpus; in a small one it asks for nothing beyond having been seen."""
        return max(threshold + self.shift, min(threshold, self.SEEN))

    def remembered(self, word, judge):
        """judge(word, self), kept at hand for words (or words in their place) that come again."""
        if word not in self._words:
            if len(self._words) > self.CACHE:
                self._words.clear()
            self._words[word] = judge(word, self)
        return self._words[word]

    def pair(self, ab: str) -> float:
        """Log frequency of a pair of which one code point at least is not ASCII."""
        score = self._seen.get(ab)
        if score is None:
            if len(self._seen) > self.CACHE:
                self._seen.clear()
            score = self._seen[ab] = float(self.logs[pair_slot(ab[0], ab[1])])
        return score

    def pairs(self, text: str) -> float:
        """Mean log frequency of the pairs of a text; 0 for none."""
        scores = [self.pair(a + b) for a, b in pairwise(text) if a > "\x7f" or b > "\x7f"]
        return sum(scores) / len(scores) if scores else 0.0

    def word(self, word: str) -> float:
        return float(self.logs[word_slot(word)])


def bytes_read_as(text: str, codec: str) -> bytes:
    """The bytes behind a text that was read in a one-byte encoding; ASCII stands for itself."""
    table = byte_of(codec)
    return bytes(table[c] if c in table else ord(c) for c in text)


#: Steps that a code point of up to three bytes looks ahead.
_AHEAD = 3


def _code_points(units: list[int | None]) -> list[tuple[int, str]]:
    """(bytes, code point) of what the head of a lattice can stand for, one lost byte at most in each."""
    lead = units[0]
    found: list[tuple[int, str]] = []
    for length in (2, 3):
        part = units[:length]
        if len(part) < length or part.count(None) > 1:
            continue
        if lead is None:
            leads = range(0xE3, 0xEA) if length == 3 else range(0xC3, 0xD2)
        elif 0xC2 <= lead < 0xF0 and (length == 2) == (lead < 0xE0):
            leads = (lead,)
        else:
            continue
        options = [bytes([x]) for x in leads]
        for unit in part[1:]:
            options = [o + bytes([x]) for o in options for x in (range(0x80, 0xC0) if unit is None else (unit,))]
        for option in options:
            try:
                found.append((length, option.decode("utf-8")))
            except UnicodeDecodeError:
                continue
    if lead is not None and lead < 0x80:
        found.append((1, chr(lead)))
    return found


def viterbi_utf8(lattice: list[int | None], model: Model, before: str = " ") -> str:
    """The most frequent text whose UTF-8 bytes fit a lattice of bytes, None being a lost one.

    States are the code point decoded last; a place that no code point fits is passed over with the replacement character. Only
    the places ahead are held, and the texts of the states share what they have in common: the work is linear in the lattice.
    """
    best: list[dict[str, tuple[float, tuple]]] = [{before: (0.0, ())}, *({} for _ in range(_AHEAD))]
    for at in range(len(lattice)):
        # a state so far behind that no pair can make up for it leads nowhere: the next code point may as well follow the best one
        least = max((x[0] for x in best[0].values()), default=0.0) - model.reach
        states = [x for x in best[0].items() if x[1][0] >= least]
        found = _code_points(lattice[at : at + _AHEAD]) if states else []
        for last, (score, text) in states:
            for length, ch in found:
                new = score + (0.0 if (last + ch).isascii() else model.pair(last + ch)) + 1.0 * length
                old = best[length].get(ch)
                if old is None or new > old[0]:
                    best[length][ch] = (new, (text, ch))
            old = best[1].get(last)
            if old is None or score - 6.0 > old[0]:
                best[1][last] = (score - 6.0, (text, LOST))
        best = [*best[1:], {}]
    if not best[0]:
        return LOST * len(lattice)
    out, text = [], max(best[0].values(), key=lambda x: x[0])[1]
    while text:
        text, ch = text
        out.append(ch)
    return "".join(reversed(out))


def _gbk_lattice(span: str) -> list[int | None]:
    out: list[int | None] = []
    for ch in span:
        if ch == LOST:
            out.append(None)
        else:
            out += ch.encode("gb18030", "replace")
    return out


def _better(model: Model, written: str, restored: str, left: str, right: str) -> float:
    """How much more frequent the restored span is in its place, in nats a pair."""
    return model.pairs(left + restored + right) - model.pairs(left + written + right)


def _context(text: str, begin: int, end: int) -> tuple[str, str]:
    return text[max(0, begin - 1) : begin], text[end : end + 1]


Span = tuple[int, int, str, str]
#: A span and its margin: how much more frequent, in nats a pair, its decoding is than it has to be; below 0 the written text is the better path.
Arc = tuple[float, Span]
#: Margin of what is proven otherwise: by the encoding of the text around it, or by the mark of a lost character.
PROVEN, MARKED = 0.05, 0.01


def _one_byte_reading(key: tuple[str, str, str, str], model: Model) -> tuple[float, str] | None:
    """(margin, decoding) of (written, code point before, code point behind, encoding) as UTF-8; None where it decodes to nothing that is text."""
    written, left, right, codec = key
    pattern = utf8_pattern(codec)
    restored = bytes_read_as(written, codec).decode("utf-8", "replace")
    while pattern.fullmatch(restored):  # damaged twice, if that reads better
        again = bytes_read_as(restored, codec).decode("utf-8", "replace")
        if LOST in again or not _PLAUSIBLE.fullmatch(again) or _better(model, restored, again, left, right) <= 0:
            break
        restored = again
    if LOST in restored or not _PLAUSIBLE.fullmatch(restored):
        return None
    return _better(model, written, restored, left, right), restored


def utf8_as_one_byte(text: str, model: Model) -> list[Arc]:
    arcs = []
    present = set(text)
    for codec in ONE_BYTE:
        leads, tails = _leads_and_tails(codec)
        if leads.isdisjoint(present) or tails.isdisjoint(present):
            continue
        pattern = utf8_pattern(codec)
        proven = 0
        regions = utf8_region(codec).finditer(text)
        for m in (m for region in regions for m in pattern.finditer(text, region.start(), region.end())):
            reading = model.remembered((m[0], *_context(text, *m.span()), codec), _one_byte_reading)
            if reading is None:
                continue
            margin, restored = reading
            # once a text has proven the encoding three times, what fits it needs no further proof, a lone Han character apart
            if margin > 0:
                proven += 1
            elif proven >= 3 and (len(restored) > 1 or restored < "\u2e80"):
                proven, margin = proven + 1, PROVEN
            if margin > 0:
                arcs.append((margin, (m.start(), m.end(), restored, f"utf-8 as {codec}")))
    return arcs


@lru_cache(maxsize=32)
def _holed_runs(codec: str) -> re.Pattern:
    """Runs of lead, trail and lost bytes of UTF-8 that hold a lost one and begin with a lead byte."""
    leads, tail = _class(codec, 0xC2, 0xEF), _class(codec, 0x80, 0xBF)
    return re.compile(f"[{leads}][{leads}{tail}]*{LOST}[{leads}{tail}{LOST}]*")


def utf8_with_holes(text: str, model: Model) -> list[Arc]:
    """UTF-8 read in a one-byte encoding that has no character for some of its bytes: the lattice with these as wildcards."""
    if LOST not in text:
        return []
    arcs = []
    for codec in HOLED:
        table = byte_of(codec)
        for m in _holed_runs(codec).finditer(text):
            restored = viterbi_utf8([None if c == LOST else table[c] for c in m[0]], model, text[m.start() - 1 : m.start()] or " ")
            if LOST in restored or not _PLAUSIBLE.fullmatch(restored):
                continue
            left, right = _context(text, m.start(), m.end())
            known = model.pairs(left + restored + right)
            margin = min(known - model.least(1.0), known - model.pairs(left + m[0].replace(LOST, "") + right) - GAIN)
            arcs.append((margin, (m.start(), m.end(), restored, f"utf-8 as {codec}")))
    return arcs


def gbk_as_one_byte(text: str, model: Model) -> list[Arc]:
    arcs = []
    for m in GBK_AS_LATIN.finditer(text):
        written = m[0]
        restored = bytes_read_as(written, "cp1252").decode("gb18030", "replace")
        if restored.count(LOST) * 4 > len(restored) or not _PLAUSIBLE.fullmatch(restored):
            continue
        left, right = _context(text, m.start(), m.end())
        gain = _better(model, written, restored.replace(LOST, ""), left, right)
        # one or two code points prove less than a run
        margin = min(gain - (GAIN if len(restored) > 2 else 1.5 * GAIN), model.pairs(left + restored + right) - model.least(0.5))
        arcs.append((margin, (m.start(), m.end(), restored, "gbk as one-byte")))
    return arcs


def swapped_word(written: str, model: Model) -> tuple[float, str, str] | None:
    """(margin, decoding, channel) of a word written in one one-byte encoding and read in another, if the corpus knows the decoding far better."""
    known = model.word(written)
    # three letters prove little: the decoding must be a frequent word, and far more so than what is written
    least = max(known + 2 * GAIN, model.least(1.5)) if len(written) > 3 else max(known + SHORT_GAIN, model.least(3.0))
    for right_codec, wrong_codec in SWAPPED:
        table = byte_of(wrong_codec)
        if not all(c in table for c in written):
            continue
        try:
            restored = bytes(table[c] for c in written).decode(right_codec)
        except UnicodeDecodeError:
            continue
        if not restored.isalpha() or restored[1:] != restored[1:].lower() or not _PLAUSIBLE.fullmatch(restored):
            continue
        margin = min(model.word(restored) - least, model.pairs(restored) - model.pairs(written) - GAIN)
        if margin > 0:
            return margin, restored, f"{right_codec} as {wrong_codec}"
    return None


@lru_cache(maxsize=1)
def _short_words() -> tuple[dict[str, dict[str, str]], re.Pattern]:
    """For each swapped channel its letters and the small Cyrillic ones they may stand for, and words of one or two such letters."""
    channels = {}
    for right_codec, wrong_codec in SWAPPED:
        letters = {}
        for byte in range(0x80, 0x100):
            shown, restored = (bytes([byte]).decode(codec, "replace") for codec in (wrong_codec, right_codec))
            if shown.isalpha() and restored != shown and "\u0430" <= restored <= "\u044f":
                letters[shown] = restored
        channels[f"{right_codec} as {wrong_codec}"] = letters
    known = "".join(sorted(set().union(*channels.values())))
    return channels, re.compile(f"(?<![^\\W\\d_])[{known}]{{1,2}}(?![^\\W\\d_])")


def _short_word(key: tuple[str, str, str, bool], model: Model) -> tuple[float, str, str] | None:
    """(margin, decoding, channel) of (a word of one or two letters, code point before, code point behind, whether it stands among Cyrillic
    words): of the decodings that fit its place far better than what is written, the one that is the most frequent word. A word of
    another script among Cyrillic ones needs less proof."""
    written, left, right, among = key
    in_place = model.pairs(left + written + right)
    need = 2 * GAIN if among and written[0] < "\u0400" else SHORT_GAIN
    found = []
    for channel, letters in _short_words()[0].items():
        restored = "".join(letters.get(c, "") for c in written)
        if len(restored) == len(written):
            margin = min(model.pairs(left + restored + right) - in_place - need, model.word(restored) - model.least(3.0))
            found.append((margin > 0, model.word(restored), margin, restored, channel))
    best = max(found, default=(False,))
    return best[2:] if best[0] else None


def swapped_one_byte(text: str, model: Model) -> list[Arc]:
    """Swapped words, the short words beside them that fit the same channel at least as well as what is written, and lone short words."""
    arcs = []
    for m in _SWAP_WORD.finditer(text):
        found = model.remembered(m[0], swapped_word)
        if found:
            arcs.append((found[0], (m.start(), m.end(), *found[1:])))
    words = [(m.start(), m.end()) for m in NON_ASCII.finditer(text)] if arcs else []
    settled = {span[0] for _, span in arcs}
    channels = {(a, b): channel for _, (a, b, _, channel) in arcs}
    for i, (a, b) in enumerate(words):
        near = {channels.get(words[j]) for j in (i - 1, i + 1) if 0 <= j < len(words)} - {None}
        if (a, b) in channels or b - a > 3 or not near:
            continue
        for channel in sorted(near):
            right_codec, wrong_codec = channel.split(" as ")
            table = byte_of(wrong_codec)
            try:
                restored = bytes(table[c] for c in text[a:b]).decode(right_codec)
            except (KeyError, UnicodeDecodeError):
                continue
            if restored.isalpha() and restored == restored.lower() and _PLAUSIBLE.fullmatch(restored) and (b - a == 1 or model.word(restored) >= model.word(text[a:b])):
                arcs.append((PROVEN, (a, b, restored, channel)))
                settled.add(a)
                break
    for m in _short_words()[1].finditer(text):
        begin, end = m.span()
        if begin in settled:
            continue
        among = "\u0400" <= text[begin - 2 : begin - 1] <= "\u04ff" and "\u0400" <= text[end + 1 : end + 2] <= "\u04ff"
        found = model.remembered((m[0], *_context(text, begin, end), among), _short_word)
        if found:
            arcs.append((found[0], (m.start(), m.end(), *found[1:])))
    return arcs


@lru_cache(maxsize=1)
def _two_byte_runs() -> tuple[dict[str, str], re.Pattern]:
    """The characters GBK shows for code points of two bytes, and runs of them."""
    shown = {}
    for lead in (0xC2, 0xC3, 0xC5, *range(0xCE, 0xD2)):
        for tail in range(0x80, 0xC0):
            pair = bytes([lead, tail])
            shown[pair.decode("gb18030", "replace")] = pair.decode("utf-8")
    shown.pop(LOST, None)
    return shown, re.compile("[" + "".join(map(re.escape, shown)) + "]+")


def _shown(leads: Iterable[int], tails: Iterable[int]) -> str:
    """The characters that GBK shows for two bytes of these sets, as a class of a pattern."""
    both = (bytes([a, b]).decode("gb18030", "replace") for a in leads for b in tails)
    return "".join(re.escape(c) for c in both if len(c) == 1 and c != LOST)


@lru_cache(maxsize=1)
def _three_byte_units() -> re.Pattern:
    """What GBK shows for a code point of three bytes: two characters, the first of which holds its first two bytes. The second ends
    with an ASCII byte that it swallowed, or with the lead of a further code point, whose tail begins the next character."""
    trail = range(0x80, 0xC0)
    leads = (0xC2, 0xC3, 0xC5, *range(0xCE, 0xD2), *range(0xE2, 0xEA), 0xEF)
    first = _shown((0xE2,), range(0x80, 0x98)) + _shown((0xE3,), (0x80,)) + _shown(range(0xE4, 0xEA), trail) + _shown((0xEF,), range(0xBC, 0xC0))
    return re.compile(f"[{first}](?:[{_shown(trail, range(0x40, 0x7F))}]|[{_shown(trail, leads)}][{_shown(trail, range(0x40, 0xFF))}])")


def may_be_utf8_as_gbk(text: str, model: Model) -> bool:
    """A quick test that no text with such a span fails. Text that was read as GBK begins with the first byte of a character, so that
    its code points lie in few ways on the characters: one of three bytes and what follows it, or a run of code points of two bytes
    that would be known in its place. Where characters are lost, anything may stand."""
    if LOST in text or _three_byte_units().search(text):
        return True
    shown, runs = _two_byte_runs()
    for m in runs.finditer(text):
        left, right = _context(text, m.start(), m.end())
        known = model.pairs(left + "".join(map(shown.get, m[0])) + right)
        if known > model.least(0.0 if len(m[0]) > 4 else 1.0) and known - model.pairs(left + m[0] + right) > (GAIN if len(m[0]) > 2 else 2 * GAIN):
            return True
    return False


def utf8_as_gbk(text: str, model: Model) -> list[Arc]:
    """Spans of UTF-8 read as GBK; an ASCII byte that the last code point swallowed is given back."""
    spans: list[Arc] = []
    for run in NON_ASCII.finditer(text):
        chars = run[0]
        try:
            raw = chars.encode("gb18030")
        except UnicodeEncodeError:
            continue
        units = list(_UTF8_UNIT.finditer(raw))
        if not units:
            continue
        # two bytes a character, as a rule; else the places are summed up
        even = len(raw) == 2 * len(chars)
        widths = range(0, len(raw) + 1, 2) if even else list(accumulate((len(c.encode("gb18030")) for c in chars), initial=0))
        last = 0
        for unit in units:
            first_byte, end_byte = unit.span()
            if even and end_byte - first_byte == 2 and first_byte & 1:
                # one code point of two bytes across two characters
                continue
            begin = first_byte // 2 if even else bisect(widths, first_byte) - 1
            end = (end_byte + 1) // 2 if even else bisect_left(widths, end_byte)
            if begin < last:
                begin = last
            core = unit[0]
            size = widths[end] - widths[begin]
            if len(core) < 0.5 * size or len(core) == 2 and widths[begin] != first_byte:
                continue
            restored = core.decode("utf-8", "replace")
            rest = raw[end_byte : widths[end]]
            swallowed = rest.decode() if len(rest) == 1 and rest.isascii() else ""
            if len(restored) == 1:
                # one code point: both its pairs must be known, which they seldom are in sound text
                before = "" if first_byte != widths[begin] else chars[begin - 1 : begin] or text[run.start() - 1 : run.start()]
                after = swallowed if end_byte != widths[end] else chars[end : end + 1] or text[run.end() : run.end() + 1]
                scores = ([model.pair(before + restored)] if before else []) + ([model.pair(restored + after)] if after else [])
                if sum(scores) <= len(scores) * model.least(1.0):
                    continue
            if LOST in restored or not _PLAUSIBLE.fullmatch(restored):
                continue
            written = chars[begin:end]
            aligned = raw[widths[begin] : widths[end]]
            left = chars[begin - 1] if begin else text[run.start() - 1 : run.start()]
            right = chars[end] if end < len(chars) else text[run.end() : run.end() + 1]
            if len(aligned) > len(core):
                # a lost or swallowed byte at the rim: judged by the inside alone
                left = left if unit.start() == widths[begin] else ""
                right = right if unit.end() == widths[end] or swallowed else ""
            gain = _better(model, written, restored + swallowed, left, right)
            need = GAIN if len(restored) > 2 else 2 * GAIN
            margin = min(gain - need, model.pairs(left + restored + swallowed + right) - model.least(0.0 if len(restored) > 4 else 1.0))
            if margin > 0:
                spans.append((margin, (run.start() + begin, run.start() + end, restored + swallowed, "utf-8 as gbk")))
                last = end
    return spans


def _joined(text: str, arcs: list[Arc], model: Model) -> list[Arc]:
    """Neighbouring spans of UTF-8 read as GBK and the wildcards between them, decoded once more as one lattice: further arcs."""
    out = list(arcs)
    spans = sorted(span for _, span in arcs)
    at = 0
    while at < len(spans):
        first = last = at
        while last + 1 < len(spans) and spans[last + 1][0] - spans[last][1] <= 3 and text[spans[last][1] : spans[last + 1][0]].strip(" \n") != "":
            last += 1
        begin, end = spans[first][0], spans[last][1]
        while end < len(text) and text[end] == LOST:
            end += 1
        written = text[begin:end]
        if last > first or LOST in written:
            restored = viterbi_utf8(_gbk_lattice(written), model, text[begin - 1 : begin] or " ")
            if restored.count(LOST) * 3 <= len(restored):
                margin = model.pairs(restored.replace(LOST, "")) - model.pairs(written.replace(LOST, "")) - GAIN / 2
                out.append((margin, (begin, end, restored, spans[first][3])))
        at = last + 1
    return out


def best_path(arcs: list[Arc]) -> list[Span]:
    """The spans on the best path through a text, by Viterbi search: from each place the written text goes on at no gain, and every arc
    leads to its end with its margin for each character. Of paths equally good the one of fewer arcs is taken."""
    ways: dict[int, list[Arc]] = {}
    for margin, span in arcs:
        if margin > 0:
            ways.setdefault(span[1], []).append((margin, span))
    ends: list[int] = []
    best: list[tuple[float, int, Span | None, int]] = [(0.0, 0, None, 0)]
    for end in sorted(ways):
        found = (best[-1][0], best[-1][1], None, len(best) - 1)
        for margin, span in ways[end]:
            before = bisect(ends, span[0])
            score, steps = best[before][0] + margin * (end - span[0]), best[before][1] - 1
            if (score, steps) > found[:2]:
                found = (score, steps, span, before)
        ends.append(end)
        best.append(found)
    path, at = [], len(best) - 1
    while at:
        _, _, span, before = best[at]
        if span is not None:
            path.append(span)
        at = before
    return path[::-1]


def damaged_spans(text: str, model: Model) -> list[Span]:
    """(begin, end, restored, channel) of all damaged spans, in order and without overlap; what is lost stays the replacement character.

    All decodings of all channels are arcs of one lattice beside the written text; what the best path decodes is damaged.
    """
    arcs = _joined(text, utf8_as_gbk(text, model), model) if may_be_utf8_as_gbk(text, model) else []
    arcs += utf8_as_one_byte(text, model) + utf8_with_holes(text, model) + gbk_as_one_byte(text, model) + swapped_one_byte(text, model)
    arcs += [(MARKED, (m.start(), m.end(), LOST, "lost")) for m in REPLACED.finditer(text)]
    return best_path(arcs)


def restore(text: str, spans: list[Span]) -> str:
    out, last = [], 0
    for begin, end, restored, _ in spans:
        out += [text[last:begin], restored]
        last = end
    out.append(text[last:])
    return "".join(out)


RESULT = "struct<n_spans int, channels array<string>, n_lost int, restored string>"


def repair_encoding(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per damaged document: id, n_spans, channels (distinct, sorted), n_lost (spans that stay lost in part), restored.

    The frequencies come from all documents; the table broadcast has SLOTS entries whatever the corpus. Null, empty and plain
    ASCII texts give no row; repeated ids give one row each. Whole texts are read, each in the task that holds it; nothing but
    the frequency table is shuffled.
    """
    table = corpus_frequencies(documents, text_col)
    shared = documents.sparkSession.sparkContext.broadcast(table)
    models: dict[int, Model] = {}

    @F.pandas_udf(RESULT)
    def examine(texts: pd.Series) -> pd.DataFrame:
        if 0 not in models:
            models[0] = Model(shared.value)
        model = models[0]
        rows = []
        for text in texts:
            spans = damaged_spans(text, model)
            rows.append((len(spans), sorted({s[3] for s in spans}), sum(LOST in s[2] for s in spans), restore(text, spans) if spans else None))
        return pd.DataFrame(rows, columns=["n_spans", "channels", "n_lost", "restored"]).astype({"n_spans": "int32", "n_lost": "int32"})

    candidates = documents.select(F.col(id_col), F.col(text_col).alias("text_")).where(F.col("text_").rlike(HAS_NON_ASCII))
    return candidates.select(id_col, examine("text_").alias("r")).where("r.n_spans > 0").select(id_col, "r.*")


