"""Toxicity (10): a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, strips accents, maps look-alike letters of other scripts and digits or
signs used as letters to the letter they imitate, and turns everything else into blanks. A sign
with several readings (1 for i or l, a stroke for a letter or a blank) takes the one that makes
an entry of the lexicon; every reading is tried.

The lexicon is learned from labelled training rows: words and word beginnings that toxic texts
use far more often than others, each weighted by its log odds. An entry needs uses in MIN_USES and a share of MIN_SHARE of
the different toxic training texts, beside as many different pairs of words, so that a text's
copies and near copies teach no words. Of nested entries
the longest that still covers nearly all uses stays. Phrases of an entry with its neighbour that only
non-toxic texts use are exceptions and cancel the entry's match. A text's evidence is the sum
of its matched weights divided by a length that grows with the text; a logistic curve fitted
on the training rows turns evidence into a score.

Training uses at most MAX_TRAIN labelled rows, taken in hash order (a documented bound of the
fit); scoring reads every row and whole text. Only the text is scored.

Defined results: null and empty texts have no evidence and get the curve's lowest score; a
null label or a label without a document is not used; several labels of one document each
count; without both classes among the training rows, or without an entry, nothing is learned and
every score is 0 (to 13 digits). A null doc_id hashes as the empty text. Other columns play no part.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import stored, text_of

MAX_TRAIN = 20_000
MAX_ENTRIES = 5_000
MIN_USES, MIN_SHARE = 5, 0.01
MIN_ODDS = 3.0
COVERS = 0.9
BRANCHES = 3
SHORTEST, LONGEST = 3, 8
WORDS_PER_UNIT = 400.0
THRESHOLD = 0.3
#: Look-alikes of Latin letters (Cyrillic, Greek), and digits and signs used as letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k",
    "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ѡ": "w",
    "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɡ": "g", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: What digits and signs may be read as, inside a word.
READINGS = {"0": "o", "1": "il", "2": "z ", "3": "e", "4": "a", "5": "s", "6": "gb ", "7": "t", "8": "b", "9": "gq ", "@": "a",
            "$": "s", "!": "il ", "|": "il ", "+": "t "}
#: Phrases that contain an entry but are harmless.
EXCEPTIONS = ("trash can", "trash bin", "class clown")


class _Folding(dict):
    """Code point to folded text, filled as characters occur."""

    def __missing__(self, code: int) -> str:
        c = unicodedata.normalize("NFKD", chr(code)).lower()
        out = "".join(LOOKALIKES.get(x, x if "a" <= x <= "z" else "") for x in c if not unicodedata.combining(x))
        # letters of other scripts stay themselves; what is no letter is a blank
        self[code] = out = out or (chr(code).lower() if chr(code).isalpha() else
                                   "" if unicodedata.category(chr(code)) in ("Cf", "Mn") else " ")
        return out


_PLAIN = _Folding()
_SIGNED = _Folding({ord(k): v for k, v in SIGNS.items()})


#: words with a sign in them; linear, as it only starts at the beginning of a word
_WITH_SIGN = re.compile(r"(?<!\S)[^\s0134578@$!]*[0134578@$!]\S*")


_MARKS = "!.,;:?\"')]}"


def _unsign(found: re.Match) -> str:
    """A word with letters in place of its signs. Signs at its end stay ("st0p!" keeps its mark)."""
    word = found.group()
    core = word.rstrip(_MARKS)
    return core.translate(_SIGNED) + word[len(core):] if any(c.isalpha() for c in core) else word


def fold(text: str) -> str:
    """Folded words between single blanks, with a blank at either end."""
    return f" {' '.join(_WITH_SIGN.sub(_unsign, text).translate(_PLAIN).split())} "


_WITH_READINGS = re.compile(r"(?<!\S)[^\s0-9@$!|+]*[0-9@$!|+]\S*")


class Reader:
    """Folds texts like ``fold``, but reads words with signs as the entries that they may spell:
    a walk through the tree of entries along all readings."""

    def __init__(self, entries: dict[str, float]):
        self.tree: dict = {}
        for entry, weight in entries.items():
            node = self.tree
            for c in entry:
                node = node.setdefault(c, {})
            node[""] = weight

    def __call__(self, text: str) -> str:
        return f" {' '.join(_WITH_SIGN.sub(_unsign, _WITH_READINGS.sub(self._spelled, text)).translate(_PLAIN).split())} "

    def _spelled(self, found: re.Match) -> str:
        word = found.group()
        core = word.rstrip(_MARKS)
        if not any(c.isalpha() for c in core):
            return word
        options = [READINGS.get(c) or (_PLAIN[ord(c)],) for c in core]
        out, done, k = [], 0, 0
        while k < len(core):
            best = self._entry(options, k) if not k or " " in options[k - 1] or "" in options[k - 1] else None
            if best is None:
                k += 1
                continue
            _, end, spelled = best
            before = core[done:k]
            out += [before[:-1] + " " if before and " " in options[k - 1] else before, spelled]
            done = k = end
        return "".join(out) + core[done:] + word[len(core):] if out else word

    def _entry(self, options: list, start: int) -> tuple[float, int, str] | None:
        """Weight, end and spelling of the heaviest entry that may start here."""
        best = None
        open_ = [(self.tree.get(" "), start, "")]
        while open_:
            node, at, spelled = open_.pop()
            if node is None:
                continue
            ends = " " in node and (at == len(options) or " " in options[at])
            for weight, end, text in ((node.get(""), at, spelled),
                                      (node[" "].get("") if ends else None, min(at + 1, len(options)), spelled + " ")):
                if weight is not None and at > start and (best is None or (weight, end) > best[:2]):
                    best = weight, end, text
            if at < len(options):
                for letters in options[at]:
                    below = node
                    for c in letters:
                        below = below.get(c) if below is not None and c != " " else None
                    open_.append((below, at + 1, spelled + letters))
        return best


@dataclass
class Lexicon:
    """Entries (folded, with a leading blank; a trailing one ends the word) and their weights,
    exception phrases, and the curve's two coefficients."""

    entries: dict[str, float]
    exceptions: tuple[str, ...] = ()
    bias: float = 0.0
    slope: float = 1.0

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for phrase in {fold(p) for p in self.exceptions}:
            a.add_word(phrase, (len(phrase), None))
        for entry, weight in self.entries.items():
            if entry not in a:
                a.add_word(entry, (len(entry), weight))
        a.make_automaton()
        return a

    def reader(self) -> Reader:
        return Reader(self.entries)


def matches(automaton, folded: str) -> list[tuple[int, int, float]]:
    """Entries found outside of exception phrases."""
    if not len(automaton):
        return []
    found = [(end - size + 1, end + 1, weight) for end, (size, weight) in automaton.iter(folded)]
    starts, reach = [], []  # of the exception phrases: starts, and how far those up to a start reach
    for a, b, w in sorted((x for x in found if x[2] is None), key=lambda x: x[0]):
        starts.append(a)
        reach.append(max(b, reach[-1]) if reach else b)
    spared = lambda a, b: bool(i := bisect_right(starts, a)) and reach[i - 1] >= b
    return [(a, b, w) for a, b, w in found if w is not None and not spared(a, b)]


def evidence(automaton, folded: str) -> float:
    weight = sum(w for _, _, w in matches(automaton, folded))
    return math.log1p(weight / (1.0 + folded.count(" ") / WORDS_PER_UNIT)) if weight else 0.0


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """(t, toxic) of at most ``most`` labelled rows that are not held out."""
    marked = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))) \
        .select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.orderBy(F.xxhash64("id"), "id", "toxic").limit(most)
    # at most ``most`` rows of an id and a label
    return docs.select(F.col("doc_id").alias("id"), text_of().alias("t")).join(F.broadcast(marked), "id") \
        .select("t", "toxic")


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        uses = (Counter(), Counter())
        for text, toxic in zip(batch["t"], batch["toxic"], strict=True):
            uses[1 if toxic else 0].update(set(fold(text).split()))
        words = list({*uses[0], *uses[1]})
        yield pd.DataFrame({"word": words, "clean": [uses[0][w] for w in words], "toxic": [uses[1][w] for w in words]})


def learn(train: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Lexicon, exceptions and curve from rows (t, toxic); a few small jobs over bounded rows."""
    train = stored(train.dropDuplicates(["t", "toxic"]), "toxic-train")
    size = {int(r["toxic"] != 0): r["n"] for r in train.groupBy((F.col("toxic") != 0).cast("int").alias("toxic"))
            .agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = size.get(0, 0), size.get(1, 0)
    if not clean or not toxic:
        return Lexicon({}, (), -30.0, 0.0)
    words = train.mapInPandas(_count_words, "word string, clean long, toxic long") \
        .groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    starts = F.explode(F.sequence(F.lit(SHORTEST), F.least(F.length("word") - 1, F.lit(LONGEST))))
    begins = words.where(F.length("word") > SHORTEST).withColumn("k", starts) \
        .select(F.concat(F.lit(" "), F.expr("substring(word, 1, k)")).alias("entry"), "clean", "toxic") \
        .groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    whole = words.where(F.length("word") >= 2).select(F.concat(F.lit(" "), "word", F.lit(" ")).alias("entry"), "clean", "toxic")
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    found = begins.unionByName(whole).where(F.col("toxic") >= max(MIN_USES, MIN_SHARE * toxic)).withColumn("odds", odds) \
        .where(F.col("odds") >= MIN_ODDS).orderBy(F.desc("toxic"), F.desc("odds"), "entry").limit(MAX_ENTRIES).toPandas()
    found = _varied(train, found, max(MIN_USES, MIN_SHARE * toxic))
    entries = _outermost(found)
    if not entries:
        return Lexicon({}, (), -30.0, 0.0)
    lexicon = Lexicon(entries, exceptions)
    lexicon.exceptions = (*exceptions, *_spared(train, lexicon))
    lexicon.bias, lexicon.slope = _curve(train, lexicon)
    return lexicon


def _around(folded: str, a: int, b: int) -> tuple[str, str, str]:
    """The word that a match lies in, and its neighbours."""
    end = folded.index(" ", b - 1)
    return folded[a + 1:end], folded[:a].rsplit(" ", 1)[-1], folded[end + 1:].split(" ", 1)[0]


def _varied(train: DataFrame, found: pd.DataFrame, least: float) -> pd.DataFrame:
    """The entries that toxic texts use beside at least ``least`` different pairs of words."""
    candidates = Lexicon(dict.fromkeys(found["entry"], 1.0))

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = candidates.automaton()
        for batch in batches:
            seen = set()
            for folded in map(fold, batch["t"]):
                for a, b, _ in matches(automaton, folded):
                    seen.add((folded[a:b], *_around(folded, a, b)[1:]))
            yield pd.DataFrame(list(seen), columns=["entry", "left", "right"], dtype=object)

    counts = train.where("toxic <> 0").mapInPandas(contexts, "entry string, left string, right string").distinct() \
        .groupBy("entry").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).toPandas()
    return found[found["entry"].isin(set(counts["entry"]))]


def _outermost(found: pd.DataFrame) -> dict[str, float]:
    """Of nested entries the longest that cover nearly all uses of the shortest: an entry gives
    way to at most BRANCHES continuations that together hold COVERS of its uses."""
    uses = dict(zip(found["entry"], found["toxic"], strict=True))
    odds = dict(zip(found["entry"], found["odds"], strict=True))
    below: dict[str, list[str]] = {}
    for entry in uses:
        parents = [entry[:k] for k in range(len(entry) - 1, 1, -1) if entry[:k] in uses]
        below.setdefault(parents[0] if parents else "", []).append(entry)

    chosen: dict[str, float] = {}
    open_ = below.get("", [])
    while open_:
        entry = open_.pop()
        longer = below.get(entry, [])
        if 0 < len(longer) <= BRANCHES and sum(uses[x] for x in longer) >= COVERS * uses[entry]:
            open_ += longer
        else:
            chosen[entry] = float(odds[entry])
    return chosen


def _spared(train: DataFrame, lexicon: Lexicon) -> list[str]:
    """Two-word phrases of an entry that only non-toxic training texts use."""
    def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, read = lexicon.automaton(), lexicon.reader()
        for batch in batches:
            rows = []
            for text, toxic in zip(batch["t"], batch["toxic"], strict=True):
                folded = read(text)
                seen = set()
                for a, b, _ in matches(automaton, folded):
                    word, left, right = _around(folded, a, b)
                    seen |= {f"{word} {right}".strip(), f"{left} {word}".strip()}
                rows += [(p, int(toxic == 0), int(toxic != 0)) for p in seen if " " in p]
            yield pd.DataFrame(rows, columns=["phrase", "clean", "toxic"])

    found = train.mapInPandas(phrases, "phrase string, clean long, toxic long").groupBy("phrase") \
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")) \
        .where((F.col("clean") >= MIN_USES) & (F.col("toxic") == 0)) \
        .orderBy(F.desc("clean"), "phrase").limit(MAX_ENTRIES)
    return [r["phrase"] for r in found.collect()]


def _curve(train: DataFrame, lexicon: Lexicon) -> tuple[float, float]:
    """Bias and slope of the logistic curve, fitted by Newton steps with a slight penalty on
    counts per rounded evidence."""
    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, read = lexicon.automaton(), lexicon.reader()
        for batch in batches:
            yield pd.DataFrame({"x": [round(evidence(automaton, read(t)), 2) for t in batch["t"]],
                                "y": (batch["toxic"] != 0).astype("int32")})

    h = train.mapInPandas(weigh, "x double, y int").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).toPandas()
    x, y, n = (h[c].to_numpy(np.float64) for c in ("x", "y", "n"))
    design = np.stack([np.ones_like(x), x], 1)
    beta, ridge = np.zeros(2), np.diag([1e-3, 1e-1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (n * (y - p)) - ridge @ beta
        step = np.linalg.solve(design.T @ (design * (n * p * (1 - p))[:, None]) + ridge, gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def _scores(lexicon: Lexicon, automaton, read: Reader, texts: pa.Array) -> np.ndarray:
    x = np.fromiter((evidence(automaton, read(t.as_py())) for t in texts), np.float64, len(texts))
    return 1 / (1 + np.exp(-np.clip(lexicon.bias + lexicon.slope * x, -30, 30)))


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, read = lexicon.automaton(), lexicon.reader()
        for batch in batches:
            p = _scores(lexicon, automaton, read, batch.column("t"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text).alias("t"))
    return rows.mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learn(training_rows(docs, labels)))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns: a filter on each
    row's own text, without a join or a shuffle."""
    lexicon = learn(training_rows(docs, labels))

    @F.arrow_udf("double")
    def score_of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton, read = lexicon.automaton(), lexicon.reader()
        for batch in texts:
            yield pa.array(_scores(lexicon, automaton, read, batch))

    return docs.where(score_of(text_of()) < threshold)


def op10_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return toxicity(docs, labels).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
