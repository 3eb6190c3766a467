"""Freely typed values to the entries of a canonical list.

Values are de-duplicated, normalised, and de-duplicated again. Candidates
come from an inverted index of the character 2- and 3-grams of all names
(entries and aliases); they are scored by the cosine of gram vectors weighted
with the grams' rarity among the names. Every name whose cosine reaches ``least``, or
``least_plain`` without the weights (where many names are alike, a common gram
weighs next to nothing), is a candidate, however many there are. Candidates
that can still decide the answer are then compared letter by letter (edit distance with
swaps), which settles short words whose few grams one typing slip can destroy.
A value is accepted if cosine plus edit similarity reaches ``threshold`` and
leads the next entry by ``margin``.

The index isn't asked for a value's commonest grams as long as these alone
can't make either cosine: a name that shares nothing else is no candidate by
the Cauchy-Schwarz inequality, so none is lost.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Collection, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import hot_keys, lookup, salted_join
from ..storage import stage

#: Words that are all of ``parts`` mean an entry only if so much like its whole name.
PARTS_ALIKE = 0.8
#: Below this share of a name's letters, every word of the name has to be hinted at.
SHORT = 0.75
#: A word far from all names is decoration if it is in this share of the distinct values, and in so many at least.
OFTEN, LEAST_VALUES = 0.001, 5
#: A word so much like a word of a name isn't decoration.
RESEMBLES = 2 / 3


def normalise(value: str) -> str:
    """Lower-case words of plain letters; camel case is cut, digits, version marks and accents go."""
    value = re.sub(r"([a-z])([A-Z])", r"\1 \2", value)
    value = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c)).lower()
    return re.sub(r"[\W\d_]+", " ", re.sub(r"\bv\d+\b", " ", value.replace("_", " "))).strip()


def readings(words: Sequence[tuple[str, str | None]], tails: Collection[str]) -> list[str]:
    """The one or two word sequences a value can mean once noise and decorations are taken off.

    ``words`` are (word, kind), kind being ``noise``, ``decoration`` or None;
    a word of ``tails`` right behind noise may belong to it.
    """
    kept, bare = [], []
    after_noise = False
    for w, kind in words:
        if kind == "noise":
            after_noise = True
            continue
        if kind is None:
            bare.append(w)
            if not (after_noise and w in tails):
                kept.append(w)
        after_noise = False
    return list(dict.fromkeys(" ".join(x) for x in (kept, bare) if x))


def grams(words: str) -> Counter:
    """2- and 3-grams of every word with its ends marked, so the order of words doesn't matter."""
    out: Counter = Counter()
    for w in words.split():
        marked = f"^{w}$"
        out.update(marked[i : i + n] for n in (2, 3) for i in range(len(marked) - n + 1))
    return out


def edit_similarity(a: str, b: str) -> float:
    """1 minus the edit distance (a swap of neighbours counts once) over the longer length."""
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        two, one = one, row
    return 1 - one[-1] / longer


def names_every_word(reading: str, name: str) -> bool:
    """Whether a reading much shorter than a name still hints at each of the name's words, as abbreviations do."""
    said, meant = reading.split(), name.split()
    letters, whole = sum(map(len, said)), sum(map(len, meant))
    if letters >= SHORT * whole:
        return True
    starts = {w[0] for w in said}
    if len(said) == 1 and letters >= 0.6 * whole:
        starts |= set(said[0])  # words written together
    return all(w[0] in starts for w in meant)


def resembles(word: str, ref: str) -> bool:
    """Whether a word may stand for another: it is much like it, or leaves out letters behind its first."""
    left = iter(ref)
    return (len(word) > 1 and word[0] == ref[0] and all(c in left for c in word)) or edit_similarity(word, ref) >= RESEMBLES


def decorations(words: DataFrame, names: DataFrame) -> DataFrame:
    """``word``: words of many values that resemble nothing in any name.

    ``words`` has ``label`` and ``word``, ``names`` the names' ``words``. At
    most 1 / ``OFTEN`` times the words of an average value are looked at, and
    only beside words of names with which they share a 2-gram, as every word
    does that they resemble.
    """

    def bigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({(w, m[i : i + 2]) for w in b["word"] for m in [f"^{w}$"] for i in range(len(m) - 1)}, columns=["word", "gram"])

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[resembles(w, r) for w, r in zip(b["word"], b["ref"], strict=True)], ["word"]]

    labels = words.select("label").distinct().count()
    held = words.select("label", "word").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    frequent = held.where(F.col("n") >= max(LEAST_VALUES, labels * OFTEN)).select("word")
    refs = names.select(F.explode(F.concat(F.split("words", " "), F.array(F.replace("words", F.lit(" "), F.lit(""))))).alias("word")).distinct()
    cut = lambda df: df.mapInPandas(bigrams, "word string, gram string")
    near = cut(frequent).join(cut(refs).withColumnRenamed("word", "ref"), "gram").select("word", "ref").distinct().mapInPandas(alike, "word string")
    return frequent.join(near, "word", "left_anti")


def match_values(
    values: DataFrame,
    value: str,
    names: DataFrame,
    noise: DataFrame | Collection[str] = (),
    threshold: float = 0.85,
    margin: float = 0.05,
    least: float = 0.2,
    least_plain: float = 0.3,
    parts: Collection[str] = (),
    tails: Collection[str] = (),
) -> DataFrame:
    """One row per distinct non-null ``value``: ``label``, ``entry`` (null if none is meant), ``score``, ``lead``.

    ``values`` has free text in the column ``value``, other columns are
    ignored; ``names`` has ``entry`` and ``name``, several rows per entry for
    aliases. ``noise`` are words that never belong to a name, as a list or a
    table with ``word``; ``tails`` words that may belong to the noise before
    them; ``parts`` words that alone mean nothing. Decorations are found in
    the values themselves. Empty values, values without letters and values of
    only noise, decorations or parts get a null entry. Ties between entries
    are within the margin and so unmatched; the lead is over the next entry,
    not over other names of the same. An empty list of names matches nothing.
    ``score`` is null if no entry could come within the margin of the
    threshold.
    """
    tails, parts = frozenset(tails), frozenset(parts)
    spark = values.sparkSession

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(x, i, w) for x in b["label"] for i, w in enumerate(normalise(x).split())], columns=["label", "place", "word"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(x, r) for x, words in zip(b["label"], b["words"], strict=True) for r in readings([(w["word"], w["kind"]) for w in words], tails)]
            yield pd.DataFrame(found, columns=["label", "reading"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(x, g, n**0.5) for x in b["words"] for g, n in grams(x).items()], columns=["words", "gram", "tf"])

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            scores = []
            for reading, name, cosine in zip(b["reading"], b["name"], b["cosine"], strict=True):
                alike = edit_similarity(reading.replace(" ", ""), name.replace(" ", ""))
                unsaid = (alike < PARTS_ALIKE and all(w in parts for w in reading.split())) or not names_every_word(reading, name)
                scores.append(0.0 if unsaid else cosine + alike)
            b["score"] = scores
            yield b[["reading", "entry", "score"]]

    spelled = F.trim(F.regexp_replace(F.lower("name"), r"[^\p{L}]+", " ")).alias("words")
    listed = names.where(F.col("name").isNotNull() & F.col("entry").isNotNull()).select("entry", spelled).where("words != ''").distinct()

    # values to readings
    labels = values.select(F.col(value).cast("string").alias("label")).where(F.col("label").isNotNull()).distinct()
    worded = stage(labels.mapInPandas(split, "label string, place int, word string"), "words")
    silent = noise if isinstance(noise, DataFrame) else spark.createDataFrame([(w,) for w in noise], "word string")
    silent = silent.select("word").where("word is not null").distinct()
    loud = worded.join(silent, "word", "left_anti")
    kinds = stage(silent.withColumn("kind", F.lit("noise")).unionByName(decorations(loud, listed).withColumn("kind", F.lit("decoration"))), "kinds")
    known = lookup(worded, kinds, "word", hot_keys(worded, "word", worded.count()), "left")
    ordered = known.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("place", "word", "kind"))).alias("words"))
    read_as = stage(ordered.mapInPandas(read, "label string, reading string"), "readings")

    # names to the index
    gram_schema = "words string, gram string, tf double"
    total = listed.select("words").distinct().count()
    name_grams = listed.select("words").distinct().mapInPandas(cut, gram_schema)
    rarity = name_grams.groupBy("gram").agg(F.log(1 + F.lit(float(total)) / F.count(F.lit(1))).alias("idf"))
    weighted = name_grams.join(rarity, "gram").select("words", "gram", "tf", (F.col("tf") * F.col("idf")).alias("w"), "idf")
    length = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)))
    whole = weighted.groupBy("words").agg(length("w").alias("norm"), length("tf").alias("size"))
    index = stage(weighted.join(whole, "words").select(F.col("words").alias("name"), "gram", (F.col("w") / F.col("norm")).alias("share"), (F.col("tf") / F.col("size")).alias("plain"), "idf"), "index")

    # readings to unit vectors, their commonest grams apart
    unseen = F.log(F.lit(1 + 2.0 * max(total, 1)))
    spread = read_as.select(F.col("reading").alias("words")).distinct().mapInPandas(cut, gram_schema).withColumnRenamed("words", "reading")
    weights = spread.join(index.select("gram", "idf").distinct(), "gram", "left").select("reading", "gram", "tf", (F.col("tf") * F.coalesce("idf", unseen)).alias("w"))
    of_reading = Window.partitionBy("reading")
    up_to = of_reading.orderBy("w", "gram").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = lambda c, w: F.sqrt(F.sum(F.col(c) * F.col(c)).over(w))
    units = weights.select(
        "reading", "gram", (F.col("w") / over("w", of_reading)).alias("u"), (F.col("tf") / over("tf", of_reading)).alias("p"),
        (over("w", up_to) / over("w", of_reading)).alias("u_to"), (over("tf", up_to) / over("tf", of_reading)).alias("p_to"),
    )
    query = stage(units.select("reading", "gram", "u", "p", ((F.col("u_to") < least) & (F.col("p_to") < least_plain)).alias("light")), "grams")
    asked = query.where(~F.col("light")).select("reading", "gram", "u", "p")
    met = salted_join(asked, index.select("name", "gram", "share", "plain"), "gram", hot_keys(asked, "gram", asked.count()), "reading")
    rest = query.where("light").groupBy("reading").agg(F.collect_list(F.struct("gram", "u", "p")).alias("rest"), length("u").alias("u_rest"), length("p").alias("p_rest"))
    dots = met.groupBy("reading", "name").agg(F.sum(F.col("u") * F.col("share")).alias("u"), F.sum(F.col("p") * F.col("plain")).alias("p")).join(rest, "reading", "left")
    or_none = lambda c: F.coalesce(c, F.lit(0.0))
    may = (F.col("u") + or_none("u_rest") >= least) | (F.col("p") + or_none("p_rest") >= least_plain)
    partly = stage(dots.where(may).select("reading", "name", "u", "p", "rest"), "partly")
    entries = listed.groupBy(F.col("words").alias("name")).agg(F.collect_set("entry").alias("entries"))
    shares = index.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("gram", F.struct("share", "plain").alias("s")))).alias("shares")).join(entries, "name")
    full = lookup(partly, shares, "name", hot_keys(partly, "name", partly.count()))
    left_out = lambda mine, its: F.aggregate(F.coalesce("rest", F.array()), F.lit(0.0), lambda a, e: a + e[mine] * or_none(F.try_element_at("shares", e["gram"])[its]))
    both = full.select("reading", "name", F.explode("entries").alias("entry"), (F.col("u") + left_out("u", "share")).alias("cosine"), (F.col("p") + left_out("p", "plain")).alias("plain"))
    cosine = both.where((F.col("cosine") >= least) | (F.col("plain") >= least_plain))

    # a swap counts twice in Spark's distance, so half of it is the least that ours can be
    bare = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    at_best = 1 - F.ceil(F.levenshtein(bare("reading"), bare("name")) / 2) / F.greatest(F.length(bare("reading")), F.length(bare("name")))
    compared = cosine.where(F.col("cosine") + at_best >= threshold - margin).mapInPandas(spell, "reading string, entry string, score double")
    scored = read_as.join(compared, "reading").groupBy("label", "entry").agg(F.max("score").alias("score"))
    by_score = Window.partitionBy("label").orderBy(F.desc("score"), "entry")
    ranked = scored.select("label", "entry", "score", F.row_number().over(by_score).alias("place"), F.lead("score").over(by_score).alias("next"))
    lead = F.col("score") - F.coalesce("next", F.lit(0.0))
    winners = ranked.where("place = 1").select(
        "label", F.when((F.col("score") >= threshold) & (lead >= margin), F.col("entry")).alias("entry"), "score", lead.alias("lead")
    )
    return labels.join(winners, "label", "left")


def fill(rows: DataFrame, value: str, matches: DataFrame) -> DataFrame:
    """``rows`` with the matched ``entry`` of their ``value``; a value that fills many rows is no hot task."""
    keyed = matches.select(F.col("label").alias(value), "entry")
    return lookup(rows, keyed, value, hot_keys(rows, value, rows.count()), "left")
