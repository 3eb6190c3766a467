"""Text that was decoded with the wrong character encoding.

Garbled sequences are precomputed: every short character sequence of at
least three documents is encoded with each encoding and decoded with each other
one. What comes out is kept as a pattern if the corpus holds it, but rarely
compared with its original, over all documents, or if no language writes it so
(`telling`): then it may be as frequent as it likes. UTF-8 read with a
single-byte encoding is also known by its byte sequences alone, without any
counts (`_run_spans`). One multi-pattern automaton
then finds all patterns in a text in a single pass. Only matched spans are
replaced; text around them stays as it is, so correct text with unusual
characters is left alone.

The automaton also holds a fixed table that doesn't depend on the corpus: the
first two characters of every UTF-8 sequence as each encoding shows them, and
the characters that only a failed decoding leaves. A match of the former
makes the run it lies in be read as UTF-8; a match of the latter says that
something was lost.

Whether a run of characters beyond ASCII is garbled depends on the run and
two characters to either side, so short runs, which come again and again, are
judged once per worker.

Two kinds of patterns differ in how much they prove. UTF-8 read with a
single-byte encoding turns one character into a lead and trail characters that
hardly ever meet otherwise: one match is enough. A single-byte encoding read
as another one turns a letter into one other letter, so several overlapping
patterns of one encoding pair have to agree on the same character.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Collection, Iterable, Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop, stage

# Python's names of the encodings whose mix-ups are searched.
WESTERN = ("cp1252", "latin-1", "cp1250", "cp1254", "cp437", "cp850", "cp852", "mac-roman", "iso8859-2")
CYRILLIC = ("cp1251", "cp866", "koi8-r", "mac-cyrillic", "iso8859-5")
ASIAN = ("gbk", "big5", "shift_jis", "euc-kr")

#: A sequence counts as common from this many documents, however large the corpus is.
LEAST = 3
#: So many characters in valid UTF-8 sequences one after the other aren't there by chance.
CERTAIN = 12
#: A pattern may occur in at most this share of its original's documents: structural, structural of letters only, other.
RARE_BYTES, RARE_LETTERS, RARE_PAIR = 0.5, 0.05, 0.03
#: Runs of so many characters at most are remembered, so many of them in each worker.
SHORT_RUN, JUDGED = 64, 200_000
#: More patterns than this mean that the rules don't fit the corpus.
MAX_PATTERNS = 1_000_000

_CONTROL = re.compile("[\x80-\x84\x86-\x9f]")
_ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,30}|#\d{1,7}|#x[0-9A-Fa-f]{1,6});")
_RUN = re.compile("[^\x00-\x7f]+")
_BITS = 21
#: Before the pair of a pattern that is too frequent for the counts and is kept for its form.
TOLD = "by form: "
#: Signs that close a word or follow it in clean text, also in capitals or beside units.
_CLOSING = frozenset("\xa0…”“’‘»«›‹–—™®°²³¹ªº·•±×÷¼½¾")
#: Characters that a single UTF-8 sequence may stand for; others (phonetic, ancient) need more than one in a run.
IN_USE = (
    (0xA0, 0x17F), (0x192, 0x192), (0x1A0, 0x1A1), (0x1AF, 0x1B0), (0x218, 0x21B), (0x2C6, 0x2DD), (0x300, 0x30C), (0x323, 0x323), (0x386, 0x3CE), (0x400, 0x45F),
    (0x900, 0x97F), (0x1E00, 0x1EFF), (0x200B, 0x206F), (0x2070, 0x209C), (0x20A0, 0x20C0), (0x2100, 0x22FF), (0x2300, 0x27BF), (0x2B00, 0x2BFF), (0x3000, 0x30FF),
    (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFB00, 0xFB04), (0xFE0E, 0xFE0F), (0xFEFF, 0xFEFF), (0xFF00, 0xFFEE), (0xFFFD, 0xFFFD), (0x1F000, 0x1FAFF),
)
#: Signs that clean text sets directly beside letters.
_BESIDE = frozenset("\xa0\xad\u200b\u200c\u200d\u2011°²³©®™’‘“”„‚«»‹›–—―…•·×±÷€£¥§µªº、。,·!?:;()《》「」『』【】।॥\ufe0f")


def pack(gram: str) -> int:
    return sum(ord(c) << (_BITS * i) for i, c in enumerate(gram))


def unpack(code: int) -> str:
    out = ""
    while code:
        out += chr(code & ((1 << _BITS) - 1))
        code >>= _BITS
    return out


def _codes(text: str) -> np.ndarray:
    """Code points with every digit as 0; arrays do this many times faster than str.translate beyond ASCII."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    code[(code > 48) & (code < 58)] = 48
    return code


def text_grams(text: str) -> np.ndarray:
    """The distinct 1-, 2- and 3-grams of a text that hold a character beyond ASCII, digits made equal, packed."""
    if text.isascii():
        return np.zeros(0, np.int64)
    code = _codes(text).astype(np.int64)
    wide = code > 127
    two = code[:-1] | (code[1:] << _BITS)
    three = two[:-1] | (code[2:] << (2 * _BITS))
    near2 = wide[:-1] | wide[1:]
    return np.unique(np.concatenate([code[wide], two[near2], three[near2[:-1] | wide[2:]]]))


def _decode(data: bytes, encoding: str) -> str | None:
    """As browsers do: bytes that a Windows code page leaves open become control characters."""
    try:
        if encoding.startswith("cp125"):
            return "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in data)
        return data.decode(encoding)
    except UnicodeDecodeError:
        return None


@lru_cache(maxsize=None)
def _shown(read: str) -> tuple[str | None, ...]:
    """What each of the 256 bytes is shown as by an encoding of one byte a character."""
    return tuple(_decode(bytes([b]), read) for b in range(256))


def garbled_forms(gram: str) -> Iterator[tuple[str, str, bool]]:
    """What a sequence can turn into: (garbled, ``written>read``, whether it is structural)."""
    for written in ("utf-8", *WESTERN, *CYRILLIC, "gbk"):
        if len(gram) == 1 and written not in ("utf-8", "gbk"):
            continue
        try:
            data = gram.encode(written)
        except UnicodeEncodeError:
            continue
        for read in (*WESTERN, *CYRILLIC, *(ASIAN if written == "utf-8" else ())):
            if written == read or (len(data) > 4 and read not in ASIAN):
                continue
            if read in ASIAN:
                seen = _decode(data, read)
            else:
                shown = _shown(read)
                parts = [shown[b] for b in data]
                seen = None if None in parts else "".join(parts)
            if seen is None or seen == gram or not 2 <= len(seen) <= 4 or "\0" in seen:
                continue
            if written == "utf-8" and len(gram) == 1 and read not in ASIAN:
                yield seen, f"{written}>{read}", True
                if read in ("cp1252", "latin-1") and seen.lower() not in (seen, gram):
                    yield seen.lower(), f"{written}>{read}", True
            elif len(seen) <= 3 and (len(gram) > 1 or written == "gbk"):
                yield seen, f"{written}>{read}", False
    # control characters are often dropped once they have come about
    bare = _CONTROL.sub("", gram.encode("utf-8", "replace").decode("latin-1"))
    if len(gram) > 1 and bare != gram and 2 <= len(bare) <= 3:
        yield bare, "utf-8>latin-1 without controls", False


def _keeps(seen: str, pair: str, structural: bool, n: int, m: int) -> bool:
    if not structural:
        return m <= max(1, RARE_PAIR * n)
    if pair.split(">")[1] in CYRILLIC:
        return m <= RARE_PAIR * n
    return m <= (RARE_LETTERS if seen.isalpha() else RARE_BYTES) * n


def _alien(c: str) -> bool:
    """Neither letter, digit nor a sign that clean text sets beside letters."""
    return ord(c) > 127 and c not in _BESIDE and not c.isalpha() and not c.isspace()


@lru_cache(maxsize=4096)
def _script(c: str) -> str:
    # a sign for a unit goes with any script
    return unicodedata.name(c, "").split(" ")[0] if c.isalpha() and c not in "µμªºΩΔπ\u2126\u212a\u212b" else ""


def strained(gram: str) -> bool:
    """Whether no language writes a sequence so: a sign or another script against a letter, a capital beyond ASCII after a small letter."""
    for a, b in zip(gram, gram[1:], strict=False):
        if ord(a) < 128 and ord(b) < 128:
            continue
        if (a.isalpha() and _alien(b)) or (_alien(a) and a not in "¿¡" and b.isalpha()):
            return True
        if a.isalpha() and b.isalpha() and ("" != _script(a) != _script(b) != "" or (a.islower() and b.isupper() and ord(b) > 127)):
            return True
    return False


def telling(seen: str, original: str) -> bool:
    """Whether a garbled form proves itself by how it is written, however many documents hold it."""
    if strained(original) or not any(c.isalpha() for c in original):
        return False
    foreign = len(seen) == 3 and all(ord(c) > 127 and _script(c) == "LATIN" for c in seen) and all(_script(c) == "CYRILLIC" for c in original)
    return foreign or strained(seen)


def gram_counts(docs: DataFrame, text: str) -> DataFrame:
    """``gram`` (packed) and in how many documents it stands; each batch is counted before anything moves."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [text_grams(x) for x in b["text"]]
            if found:
                gram, n = np.unique(np.concatenate(found), return_counts=True)
                yield pd.DataFrame({"gram": gram, "n": n})

    texts = docs.select(F.col(text).alias("text")).where(F.col("text").isNotNull())
    return texts.mapInPandas(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def find_patterns(docs: DataFrame, text: str) -> list[tuple[str, str, str, bool]]:
    """The corpus's patterns: (garbled, original, pair, structural), from counts over all documents."""
    counts = stage(gram_counts(docs, text), "grams")
    try:
        return sorted(_patterns_of(counts))
    finally:
        drop(counts)


def _patterns_of(counts: DataFrame) -> Iterator[tuple[str, str, str, bool]]:
    # the characters of the corpus; there are at most as many as Unicode has
    there = frozenset(chr(r[0]) for r in counts.where(F.col("gram") < 1 << _BITS).select("gram").collect())

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for code, n in zip(b["gram"], b["n"], strict=True):
                gram, made = unpack(code), defaultdict(list)
                for seen, pair, structural in garbled_forms(gram):
                    made[seen, structural].append(pair)
                for (seen, structural), pairs in made.items():
                    if all(c in there or c < "\x80" for c in seen):
                        rows.append((-1 if len(seen) == 4 else pack(seen), seen, gram, "|".join(sorted(set(pairs))), structural, n))
            yield pd.DataFrame(rows, columns=["gram", "seen", "original", "pairs", "structural", "n"])

    def prove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[telling(seen, original) for seen, original in zip(b["seen"], b["original"], strict=True)]]

    spark = counts.sparkSession
    common = counts.where(F.col("n") >= LEAST).repartition(spark.sparkContext.defaultParallelism)
    made = common.mapInPandas(forms, "gram bigint, seen string, original string, pairs string, structural boolean, n bigint")
    met = made.join(counts.select("gram", F.col("n").alias("m")), "gram", "left").where((F.col("m") > 0) | (F.col("gram") == -1))
    each = met.select("seen", "original", "structural", "n", F.coalesce("m", F.lit(0)).alias("m"), F.explode(F.split("pairs", r"\|")).alias("pair"))
    limit = (
        F.when(~F.col("structural"), F.greatest(F.lit(1.0), RARE_PAIR * F.col("n")))
        .when(F.substring_index("pair", ">", -1).isin(*CYRILLIC), RARE_PAIR * F.col("n"))
        .otherwise(RARE_BYTES * F.col("n"))
    )
    counted = stage(each.withColumn("proves", F.col("m") > limit), "forms")
    rare = counted.where(~F.col("proves"))
    frequent = counted.where(F.col("proves") & ~F.col("structural") & ~F.col("pair").rlike("^(utf-8|gbk)>")).mapInPandas(prove, counted.schema)
    best = rare.unionByName(frequent).groupBy("seen", "pair").agg(F.max(F.struct("n", "original", "structural", "proves", "m")).alias("b"))
    rows = best.select("seen", "pair", "b.*").limit(MAX_PATTERNS + 1).collect()
    drop(counted)
    if len(rows) > MAX_PATTERNS:
        raise ValueError("too many garbled patterns")
    for r in rows:
        known = _keeps(r["seen"], r["pair"], r["structural"], r["n"], r["m"])
        if known or r["proves"]:
            yield r["seen"], r["original"], r["pair"] if known else TOLD + r["pair"], r["structural"]


class Judged(NamedTuple):
    """What is known of a run of characters beyond ASCII; places are counted from its start."""

    #: by the counts: (start, end, original) and the pairs that say so
    whole: tuple[tuple[tuple[int, int, str], tuple[str, ...]], ...]
    #: may be UTF-8 by its form: (start, end, original, read, whether sure)
    form: tuple[tuple[int, int, str, str, bool], ...]
    #: ``written>read`` and the matches that are kept for how they are written
    told: tuple[tuple[str, tuple[tuple[int, int, str], ...]], ...]
    lost: bool


#: A fixed pattern that only a failed decoding leaves.
LOST = ()


@lru_cache(maxsize=1)
def fixed_patterns() -> dict[str, tuple[str, ...]]:
    """The first two characters of all UTF-8 sequences with the encodings that show them so, and the characters of failed decodings (``LOST``).

    About 30,000, whatever the corpus.
    """
    out: dict[str, tuple[str, ...]] = defaultdict(tuple)
    for read in (*WESTERN, *CYRILLIC):
        shown = {b: c for c, b in _byte_of(read).items()}
        for lead in range(0xC2, 0xF5):
            for trail in range(0x80, 0xC0):
                if lead in shown and trail in shown:
                    out[shown[lead] + shown[trail]] += (read,)
    return {**out, **{chr(c): LOST for c in (*range(0x80, 0x85), *range(0x86, 0xA0), 0xFFFD)}}


class Matcher:
    """All patterns in one automaton: those of the corpus, and the fixed ones of ``fixed_patterns``."""

    def __init__(self, patterns: list[tuple[str, str, str, bool]]):
        import ahocorasick

        by: dict[str, list[tuple[str, str, bool]]] = defaultdict(list)
        for seen, original, pair, structural in patterns:
            by[seen].append((original, pair, structural))
        fixed = fixed_patterns()
        self.automaton = ahocorasick.Automaton()
        for seen in {*by, *fixed}:
            self.automaton.add_word(seen, (len(seen), tuple(by.get(seen, ())), fixed.get(seen)))
        self.automaton.make_automaton()
        self.judged = lru_cache(maxsize=JUDGED)(self._judge)

    def _judge(self, before: str, run: str, after: str) -> Judged | None:
        """What the matches in and around a run say, places counted from the run's start; None if there are none."""
        found = [*self.automaton.iter(before + run + after)]
        if not found:
            return None
        shift, size = len(before), len(run)
        whole, windows, settled, stretches, reads, lost = defaultdict(list), defaultdict(list), {}, {}, set(), False
        for end, (length, means, fixed) in found:
            start, stop = end + 1 - length - shift, end + 1 - shift
            inside = start >= 0 and stop <= size
            if inside and fixed is not None:
                lost |= fixed == LOST
                reads.update(fixed)
            for original, pair, structural in means:
                if not structural:
                    windows[pair].append((start, stop, original))
                # what lies in a stretch that was replaced as a whole needs no look of its own
                elif inside and start >= settled.get(pair, 0):
                    read = pair.split(">")[1]
                    if read not in stretches:
                        stretches[read] = utf8_stretches(run, read)
                    widest = _widest(run, start, stop, original, stretches[read])
                    whole[widest].append(pair)
                    settled[pair] = widest[1]
        told = []
        for pair, some in windows.items():
            if not pair.startswith(TOLD):
                for w in _agreed(run, some):
                    whole[w].append(pair)
                continue
            bare = pair.removeprefix(TOLD)
            sure = _agreed(run, some + windows.get(bare, []))
            if sure:
                told.append((bare, tuple(sure)))
        form = _run_spans(before[-1:], run, after[:1], reads) if reads and size > 1 else ()
        return Judged(tuple((w, tuple(pairs)) for w, pairs in whole.items()), form, tuple(told), lost) if whole or form or told or lost else None

    def look(self, text: str) -> tuple[list[tuple[int, int, str]], bool]:
        """Spans to replace, (start, end, original), left to right and not overlapping, and whether a character of a failed decoding is there."""
        if text.isascii():
            return [], False
        plain = _codes(text).tobytes().decode("utf-32-le", "surrogatepass")
        whole, form, told, sure, lost = {}, [], defaultdict(set), set(), False
        for found in _RUN.finditer(plain):
            at, end = found.span()
            judge = self.judged if end - at <= SHORT_RUN else self._judge
            says = judge(plain[max(0, at - 2) : at], found.group(), plain[end : end + 2])
            if says is None:
                continue
            lost |= says.lost
            for (a, b, original), pairs in says.whole:
                whole[at + a, at + b, original] = pairs
            for a, b, original, read, certain in says.form:
                form.append((at + a, at + b, original, read))
                if certain:
                    sure.add(read)
            for pair, spans in says.told:
                told[pair].update((at + a, at + b, original) for a, b, original in spans)
        if not (whole or form or told):
            return [], lost
        # what the corpus shows goes before what the form alone says, and the pair that explains more of the text before others
        weight = Counter(chain.from_iterable(whole.values()))
        shown = sorted(whole, key=lambda s: (s[0], s[0] - s[1], -max(weight[p] for p in whole[s]), s[2]))
        by_form = sorted((x[:3] for x in form if x[3] in sure), key=lambda s: (s[0], s[0] - s[1]))
        out: list[tuple[int, int, str]] = []
        taken = bytearray(len(text))

        def take(spans: Iterable[tuple[int, int, str]]) -> None:
            for start, end, original in spans:
                if not any(taken[start:end]):
                    out.append((start, end, original))
                    taken[start:end] = b"\1" * (end - start)

        take(shown)
        take(by_form)
        # a pair whose matches are all explained already says nothing of the rest of their lines
        rest = {pair: new for pair, spans in told.items() if (new := [s for s in spans if not any(taken[s[0] : s[1]])])}
        undone = [_lines_undone(text, spans, *pair.split(">")) + sorted(spans, key=lambda s: (s[0], s[0] - s[1])) for pair, spans in sorted(rest.items())]
        for spans in sorted(undone, key=len, reverse=True):
            take(spans)
        return sorted(out), lost

    def opened(self, text: str) -> str:
        """The text with those character references opened that stand for garbled characters.

        Others stay references, unless nothing but references is garbled:
        then the text was escaped as a whole, and all are opened.
        """
        if "&" not in text:
            return text
        pieces, places, last, at = [], [], 0, 0
        for found in _ENTITY.finditer(text):
            means = html.unescape(found.group())
            pieces += [text[last : found.start()], means]
            at += found.start() - last
            places.append((at, at + len(means), *found.span(), means))
            at, last = at + len(means), found.end()
        if not places:
            return text
        spans, _ = self.look("".join([*pieces, text[last:]]))
        starts = [s for s, _, _ in spans]
        out, last = [], 0
        for a, b, start, end, means in places:
            i = bisect_right(starts, b - 1) - 1
            if means != text[start:end] and i >= 0 and spans[i][1] > a:
                out += [text[last:start], means]
                last = end
        if last and not self.look(text)[0]:
            return html.unescape(text)
        return "".join([*out, text[last:]])

    def examine(self, text: str) -> tuple[bool, str, bool]:
        """(garbled, restored text, whether nothing was lost).

        Matched spans are replaced again and again, for text garbled more
        than once, until nothing matches; text that would come back to what
        it was before isn't restored completely.
        """
        now = self.opened(text)
        been = {text, now}
        found, turns = now != text, False
        while True:
            spans, lost = self.look(now)
            if not spans:
                break
            found, out, last = True, [], 0
            for start, end, original in spans:
                out += [now[last:start], _with_digits(now[start:end], original)]
                last = end
            then = "".join([*out, now[last:]])
            if then in been:
                turns = True
                break
            been.add(then)
            now = then
        return found or lost, now, not lost and not turns


def _widest(text: str, start: int, end: int, original: str, stretches: list[tuple[int, int, str]]) -> tuple[int, int, str]:
    """A structural match, widened to the stretch of whole UTF-8 sequences it lies in, however long.

    A short stretch that isn't the whole run around it may be UTF-8 by chance
    under this reading, so there the match stands alone.
    """
    i = bisect_right(stretches, start, key=lambda s: s[0]) - 1
    if i >= 0 and stretches[i][1] >= end:
        a, b, _ = stretches[i]
        if b - a >= CERTAIN or ((a == 0 or text[a - 1].isascii()) and (b == len(text) or text[b].isascii())):
            return stretches[i]
    return start, end, original


def utf8_stretches(text: str, read: str) -> list[tuple[int, int, str]]:
    """(start, end, decoded) of the longest spans that are nothing but UTF-8 read as ``read``."""
    out: list[tuple[int, int, list[str]]] = []
    for a, b, c in utf8_pieces(text, read):
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b, out[-1][2])
            out[-1][2].append(c)
        else:
            out.append((a, b, [c]))
    return [(a, b, "".join(c)) for a, b, c in out]


def _lines_undone(text: str, sure: list[tuple[int, int, str]], written: str, read: str) -> list[tuple[int, int, str]]:
    """All that isn't ASCII in those lines of ``sure`` that are plain text as a whole under the other reading."""
    out, last, means = [], -1, _means(written, read)
    for start, _, _ in sorted(sure):
        if start < last:
            continue
        first = text.rfind("\n", 0, start) + 1
        last = text.find("\n", start)
        last = len(text) if last < 0 else last
        line = text[first:last]
        seen = line.translate(means)
        if len(seen) != len(line) or _UNSAID in seen or strained(seen) or any(ord(c) > 127 and not (c.isalpha() or c in _BESIDE or c in "¿¡") for c in seen):
            continue
        out += [(*run.span(), seen[run.start() - first : run.end() - first]) for run in _RUN.finditer(text, first, last)]
    return out


#: Stands for a character that the other reading can't have shown.
_UNSAID = "\ufdd0"


class _Means(dict):
    def __missing__(self, code: int) -> str:
        return _UNSAID


@lru_cache(maxsize=None)
def _means(written: str, read: str) -> _Means:
    """What a character shown by ``read`` means in ``written``, both of one byte a character; by code points."""
    back = {b: c for c, b in _byte_of(written).items()}
    return _Means({c: c for c in range(128)} | {ord(c): back.get(b, _UNSAID) for c, b in _byte_of(read).items()})


@lru_cache(maxsize=None)
def _byte_of(read: str) -> dict[str, int]:
    """The byte beyond ASCII that each character was, as ``read`` shows it."""
    return {c: b for b in range(0x80, 0x100) if (c := _decode(bytes([b]), read))}


@lru_cache(maxsize=None)
def _sequences(read: str) -> re.Pattern:
    """Lead and trail characters as ``read`` shows the UTF-8 of one character."""
    of = _byte_of(read)
    some = lambda low, high: "[" + "".join(re.escape(c) for c, b in of.items() if low <= b <= high) + "]"
    trail = some(0x80, 0xBF)
    return re.compile(f"{some(0xC2, 0xDF)}{trail}|{some(0xE0, 0xEF)}{trail}{{2}}|{some(0xF0, 0xF4)}{trail}{{3}}")


def utf8_pieces(run: str, read: str) -> list[tuple[int, int, str]]:
    """(start, end, character) of each valid UTF-8 sequence in a run, left to right."""
    of, out = _byte_of(read), []
    for found in _sequences(read).finditer(run):
        try:
            out.append((*found.span(), bytes(of[c] for c in found.group()).decode("utf-8")))
        except UnicodeDecodeError:
            pass
    return out


def _in_use(c: str) -> bool:
    return any(low <= ord(c) <= high for low, high in IN_USE)


def _improbable(before: str, seq: str, after: str) -> bool:
    """Whether clean text hardly writes a lead and its trail characters so; a letter with closing signs, or letters in usual case, it does."""
    lead, trail = seq[0], seq[1:]
    if lead.isalpha():
        if any(not t.isalpha() and t not in _CLOSING for t in trail) or (lead.isupper() and before.islower()):
            return True
        if before.isalpha() and "" != _script(before) != _script(lead) != "":
            return True
        if any(a.islower() and b.isupper() for a, b in zip(seq, seq[1:], strict=False)):
            return True
        if any(t.isalpha() for t in trail):
            return False
        if after.isalpha() and trail[-1] not in "’‘–—·•":
            return True
        return not before.isalpha() and (lead in "ÂÃĂ" or (lead in "ВГ" and all(t in "±×÷°²³¹®·¼½¾" for t in trail)))
    if unicodedata.category(lead)[0] == "P" and len(seq) == 2:
        return not trail.isalpha() and trail not in _CLOSING
    # a drawn line may meet another one, or a word
    drawn = [0x2500 <= ord(c) <= 0x259F for c in (before or " ") + seq]
    return not (drawn[1] and (drawn[0] or all(drawn[1:])))


def _run_spans(before: str, run: str, after: str, reads: Collection[str]) -> tuple[tuple[int, int, str, str, bool], ...]:
    """(start, end, original, read, whether sure) of what may be UTF-8 in a run; unsure ones need a sure one in the document."""
    best, reach = (), (False, 0)
    for read in (*WESTERN, *CYRILLIC):
        if read not in reads:
            continue
        pieces = utf8_pieces(run, read)
        if not pieces:
            continue
        odd = [_improbable(run[a - 1] if a else before, run[a:b], run[b] if b < len(run) else after) for a, b, _ in pieces]
        whole = sum(b - a for a, b, _ in pieces) == len(run)
        spans = []
        if whole and (any(odd) and len(pieces) > 1 and all(c.isprintable() or _in_use(c) for _, _, c in pieces) or all(_in_use(c) for _, _, c in pieces)):
            spans = [(0, len(run), "".join(c for _, _, c in pieces), read, any(odd))]
        elif not whole:
            spans = [(a, b, c, read, True) for (a, b, c), o in zip(pieces, odd, strict=True) if o and run[a].isalpha() and _in_use(c) and not (read in CYRILLIC and run[a:b].isalpha())]
        # the reading that explains most of the run counts, of equal ones the more usual
        explains = (any(x[4] for x in spans), sum(x[1] - x[0] for x in spans))
        if spans and explains > reach:
            best, reach = tuple(spans), explains
    return best


def _agreed(run: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Matches of one encoding pair with a character of the run on which three of them agree, two of these of three characters."""
    size = len(run)
    if len(found) < 3:
        return []
    at, long = [0] * size, [0] * size
    for start, end, _ in found:
        for i in range(max(start, 0), min(end, size)):
            at[i] += 1
            long[i] += end - start == 3
    agrees = [a >= 3 and n >= 2 for a, n in zip(at, long, strict=True)]
    return [w for w in found if any(agrees[max(w[0], 0) : w[1]])] if any(agrees) else []


def _with_digits(seen: str, original: str) -> str:
    """Patterns hold 0 for every digit; the digits of the text come back in their order."""
    digits = iter([c for c in seen if c in "0123456789"])
    return "".join(next(digits, c) if c == "0" else c for c in original)


@lru_cache(maxsize=2)
def _matcher(key: str, patterns: tuple) -> Matcher:
    return Matcher(list(patterns))


def examine_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per garbled document: ``key``, ``restored`` and ``complete`` (whether all could be restored).

    Null, empty and ASCII texts without character references are never
    garbled. Rows with the same key are judged one by one. Other columns are
    ignored. Texts of any length are read whole.
    """
    spark = docs.sparkSession
    patterns = spark.sparkContext.broadcast(tuple(find_patterns(docs, text)))
    kind = dict(docs.dtypes)[key]

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = _matcher("patterns", patterns.value)
        for b in batches:
            rows = [(k, r, c) for k, x in zip(b["key"], b["text"], strict=True) for g, r, c in [matcher.examine(x)] if g]
            yield pd.DataFrame(rows, columns=["key", "restored", "complete"])

    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    return texts.mapInPandas(judge, f"key {kind}, restored string, complete boolean").withColumnRenamed("key", key)
