"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding, normalised by length, with exception phrases.

Folding lower-cases, maps homoglyphs (Cyrillic, Greek, full-width) and digit substitutions inside words to Latin
letters, drops combining and invisible marks, and makes every run of other characters one space; a folded text starts
and ends with a space. Lexicon entries are whole words (" word ") and word beginnings (" begin").
A word's last digits and signs are marks in the folded text, and letters in a second reading of that word (a$$).
Exception phrases are entries without weight: a match inside one does not count. Pairs of words are learned as such where
they set texts without toxicity apart, though one of the words is an entry.

The lexicon and the score's curve are learned from labelled rows: entries are scored by smoothed log-odds of document
counts, and a logistic curve is fitted on the weighted hits, plain and per word. Scores read texts only.

Defined cases: null and empty texts score as texts without hits; a long text is matched whole; repeated rows score
alike; without labelled rows of both kinds, or words that set them apart, the lexicon is empty and every score is 0; an empty table gives an empty
table; other columns pass through, save those named as a result column.
"""

import math
import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, REST, TEXT, ddl, in_small_batches, materialise, pack, unpack, worker_cache

#: Labelled rows that a model is fitted on at most: those with the smallest hash of their id.
FIT_ROWS = 20_000
#: Documents that must hold an entry of the lexicon, and its least weight.
LEAST_DOCS, LEAST_WEIGHT = 5, 1.5
#: Lengths of word beginnings that may become entries.
BEGINNINGS = (4, 5, 6)
#: Letters that look like Latin ones, and digits and signs written for letters inside words.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n", "ս": "u",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ⅼ": "l",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: Those of them that may end a word.
ENDINGS = "".join(k for k in SUBSTITUTES if k != "!")
LETTERS = {ord(k): v for k, v in SUBSTITUTES.items()}
#: Phrases whose words are meant otherwise, besides those learned from labels.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "clown car", "sore loser", "idiot proof")


def _fold_table() -> dict[int, str]:
    """A character's folded form, for all that change; kept for the worker's life."""

    class Table(dict):
        def __missing__(self, code: int) -> str:
            c = chr(code)
            plain = unicodedata.normalize("NFKC", c).lower()
            plain = "".join(HOMOGLYPHS.get(x, x) for x in plain)
            self[code] = out = plain if plain.isalnum() else "" if unicodedata.category(c) in ("Cf", "Mn") else " "
            return out

    return worker_cache("toxicity").setdefault("toxicity:fold", Table())


def _letters(m) -> str:
    """Signs between two letters, or digits and signs that begin a word, read as letters; "!" only between letters."""
    before = m.string[m.start() - 1] if m.start() else " "
    inside = before.isalpha() or not (before.isalnum() or before == "_" or "!" in m[0])
    return "".join(map(SUBSTITUTES.__getitem__, m[0])) if inside else m[0]


def fold(text: str) -> str:
    signs = worker_cache("toxicity").setdefault("toxicity:signs", re.compile(rf"[{re.escape(''.join(SUBSTITUTES))}]+(?=[^\W\d_])"))
    return f" {' '.join(signs.sub(_letters, text).translate(_fold_table()).split())} "


def endings(text: str) -> list[str]:
    """Other readings of words that end in digits or signs: these too read as letters, each word folded by itself."""
    tails = worker_cache("toxicity").setdefault("toxicity:tails", re.compile(rf"[{re.escape(ENDINGS)}]+(?![^\W_])"))
    out = []
    for m in tails.finditer(text):
        a = m.start()
        if a and text[a - 1].isalpha():
            while a and text[a - 1].isalnum():
                a -= 1
            out.append(fold(text[a : m.end()].translate(LETTERS)))
    return out


@dataclass
class Lexicon:
    """Entries with their weights, exception phrases, and the curve: score = 1 / (1 + exp(-(a + b·plain + c·dense)))."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] | None = None
    key: str = ""

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for e, w in self.entries.items():
            found.add_word(e, (len(e), w))
        for e in self.exceptions:
            found.add_word(f" {e} ", (len(e) + 2, None))
        if len(found):
            found.make_automaton()
        return found

    def matches(self, word: str) -> bool:
        """Whether a folded word is an entry, or begins with one."""
        return f" {word} " in self.entries or any(f" {word[:n]}" in self.entries for n in BEGINNINGS if len(word) >= n)

    def hits(self, text: str | None) -> tuple[float, float]:
        """The sum of the weights of the words that match, and that sum per 100 words."""
        folded = fold(text or "")
        cache, key = worker_cache("toxicity"), f"machine:{self.key}"
        machine = cache.get(key) or cache.setdefault(key, self.automaton())
        if not len(machine):
            return 0.0, 0.0
        best: dict[int, float] = {}  # by the place of the space that starts the word: its largest weight
        spared: list[tuple[int, int]] = []
        for end, (n, w) in machine.iter(folded):
            at = end - n + 1
            if w is None:
                spared.append((at, end))
            elif w > best.get(at, -math.inf):
                best[at] = w
        if spared:
            best = {at: w for at, w in best.items() if not any(a <= at < b for a, b in spared)}
        plain = float(sum(best.values()))
        for word in endings(text or ""):
            plain += max((w for end, (n, w) in machine.iter(word) if w is not None and end == n - 1), default=0.0)
        return plain, 100.0 * plain / max(1, folded.count(" ") - 1)

    def score(self, text: str | None) -> float:
        if self.curve is None:
            return 0.0
        plain, dense = self.hits(text)
        a, b, c = self.curve
        z = a + b * math.log1p(plain) + c * math.log1p(dense)
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def _terms(lengths):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            terms, toxic = [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(fold(text or "").split())
                found = {f" {w} " for w in words} | {f" {w[:n]}" for n in lengths for w in words if len(w) > n}
                terms += found
                toxic += [label] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(toxic, pa.int32())], names=["term", "toxic"])

    return run


def _phrases(lexicon):
    """Pairs of neighbouring words one of which is matched, once a text."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            terms, toxic = [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = fold(text or "").split()
                hit = {w for w in set(words) if lexicon.value.matches(w)}
                found = {f"{v} {w}" for v, w in zip(words, words[1:]) if v in hit or w in hit}
                terms += found
                toxic += [label] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(toxic, pa.int32())], names=["term", "toxic"])

    return run


def _measured(lexicon):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            pairs = [lexicon.value.hits(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.float64()), pa.array([d for _, d in pairs], pa.float64()), batch.column(1)], names=["plain", "dense", "toxic"])

    return run


def _curve(rows) -> tuple[float, float, float]:
    """Logistic regression on both features by Newton steps, with a small ridge."""
    import numpy as np

    x = np.array([(1.0, math.log1p(p), math.log1p(d)) for p, d, _ in rows])
    y = np.array([t for _, _, t in rows], float)
    w, ridge = np.zeros(3), np.diag([1e-3, 1e-1, 1e-1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Lexicon:
    """A lexicon from labelled rows, of which the fit_rows with the smallest hash of their id are used."""
    chosen = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(fit_rows)  # bounded: fit_rows pairs
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # bounded: the texts of fit_rows ids; written once, so that the documents are read once
    rows = materialise(texts.join(F.broadcast(chosen), "id").select("text", "toxic"), "labelled")
    spark = docs.sparkSession
    in_small_batches(spark)
    counts = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = counts.get(1, 0), counts.get(0, 0)
    if not bad or not good:
        return Lexicon(key="none")
    tallied = rows.mapInArrow(_terms(BEGINNINGS), "term string, toxic int").groupBy("term").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    # an entry must set toxic documents apart: the weight is the log-odds, less 1.5 of its standard errors
    weight = odds - 1.5 * F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    found = tallied.where(F.col("bad") >= LEAST_DOCS).select("term", "bad", weight.alias("w")).where(F.col("w") > LEAST_WEIGHT).orderBy(F.desc("bad"), F.desc("w"), "term")
    entries = {r.term: r.w for r in found.collect()}
    if not entries:
        return Lexicon(key="none")
    # a pair of words that sets texts apart the other way is an exception: its match is meant otherwise
    pairs = rows.mapInArrow(_phrases(spark.sparkContext.broadcast(Lexicon(entries, (), None, "entries"))), "term string, toxic int").groupBy("term").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    kinder = F.log((F.col("good") + 0.5) / (good + 1.0)) - F.log((F.col("bad") + 0.5) / (bad + 1.0))
    learned = [r.term for r in pairs.where(F.col("good") >= 2 * LEAST_DOCS).where(kinder > LEAST_WEIGHT).select("term").collect()]  # pairs of fit_rows texts
    exceptions = tuple(sorted({*EXCEPTIONS, *learned}))
    key = str(hash((tuple(sorted(entries.items())), exceptions)))
    sent = spark.sparkContext.broadcast(Lexicon(entries, exceptions, None, key))
    measured = rows.mapInArrow(_measured(sent), "plain double, dense double, toxic int").collect()  # three numbers for each of fit_rows
    return Lexicon(entries, exceptions, _curve([tuple(r) for r in measured]), key)


def _scorer(lexicon):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            scores = [lexicon.value.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[ID, TEXT, REST, "score"])

    return run


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with score, from 0 to 1."""
    base = pack(docs, id_col, text_col, ["score"])
    kinds = ", ".join(f"{c} {ddl(base.schema[c].dataType)}" for c in (ID, TEXT, REST))
    made = base.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(lexicon)), f"{kinds}, score double")
    return unpack(made, docs, id_col, text_col, {"score": F.col("score")})
