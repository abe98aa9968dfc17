"""Language identification by one interpolated Kneser-Ney model of characters per language.

Texts are lower-cased, everything but letters becomes one space, and n-grams of up to ``ORDER``
characters are counted. Spark draws a bounded sample of labelled documents of every language, all of
them where there are few, and counts its n-grams; the models are made of these counts on the driver and broadcast as sorted arrays of
n-gram hashes with one log probability per language. A character whose longest n-gram was seen
in any language costs a single look-up; otherwise shorter ones are tried, with the discounted
weight of the contexts. The text gets the language of lowest cross-entropy per character.

Rejection is calibrated by cross-fitting: each half of the sample is held against models of the other
half. A text is rejected if its cross-entropy is higher than anything such documents lead to expect
for a text of its length, or if it has no letter. A language with under two documents that its other
half recognises rejects nothing.

Null text and text without letters: language ``und``, score 0, rejected. Without labelled
documents every text is. Documents without text or label are no training data. A tie of two
languages goes to the first by name. Empty tables give empty results; other columns pass through
(columns named like a result are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.hashing import U64, binary, chunks, mix
from tallyline.llm.memory import give_back, tidy
from tallyline.sources.scratch import stored

ORDER = 4
SAMPLE_DOCUMENTS = 1500  # about so many labelled documents of each language
UNKNOWN = "und"
# How far above the calibrated mean a cross-entropy may lie, in deviations.
SLACK = 8.0
_SPACE = 32
_FACTOR = U64(0x9E3779B97F4A7C15)
_PIECE = 1 << 19
_ROWS = 500  # texts that are held as bytes at once


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For every code point: its lower-case letter, or a space."""
    table = np.full(0x110000, _SPACE, np.uint32)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


def normalised(text: bytes) -> np.ndarray:
    """Letters and single spaces, with a space at both ends."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    out = np.empty(len(points) + 2, np.uint32)
    out[0] = out[-1] = _SPACE
    out[1:-1] = letters()[points]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != _SPACE) | (out[:-1] != _SPACE)
    return out[keep]


def gram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters from each place."""
    size = len(points) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = out * _FACTOR + points[k : k + size] + U64(1)
    return mix(out)


class Models:
    """``languages``, and per order: sorted hashes, log2 probabilities of the n-gram's last
    character and log2 weights of it as a context, one column per language."""

    def __init__(self, languages, hashes, probability, weight, floor) -> None:
        self.languages, self.floor = languages, floor
        self.hashes, self.probability, self.weight = hashes, probability, weight
        self.limits: list[tuple[float, float]] = []

    def costs(self, points: np.ndarray) -> np.ndarray:
        """Bits of all characters but the first, per language."""
        total = np.zeros(len(self.languages))
        for at in range(1, len(points), _PIECE):
            lo = max(0, at - (ORDER - 1))
            total += self._costs(points[lo : at + _PIECE], at - lo)
        return total

    def _costs(self, points: np.ndarray, first: int) -> np.ndarray:
        """Bits of the characters from place ``first`` on."""
        ends = np.arange(first, len(points))
        back = np.zeros((len(ends), len(self.languages)), np.float32)
        total = np.zeros(len(self.languages))
        rows = np.arange(len(ends))
        for n in range(min(ORDER, len(points)), 0, -1):
            able = ends[rows] >= n - 1
            grams = gram_hashes(points, n)
            place, hit = self._find(n, grams[np.where(able, ends[rows] - (n - 1), 0)])
            hit &= able
            total -= self.probability[n - 1][place[hit]].sum(axis=0, dtype=np.float64)
            if n < ORDER:
                total -= back[rows[hit]].sum(axis=0, dtype=np.float64)
            rows = rows[~hit]
            if not len(rows):
                return total
            if n > 1:
                context = gram_hashes(points, n - 1)
                start = ends[rows] - (n - 1)
                place, known = self._find(n - 1, context[np.maximum(start, 0)])
                known &= start >= 0
                back[rows[known]] += self.weight[n - 2][place[known]]
        total -= (self.floor + back[rows]).sum(axis=0, dtype=np.float64)
        return total

    def _find(self, n: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        table = self.hashes[n - 1]
        place = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
        return place, table[place] == wanted


def counted(sample: DataFrame, order: int) -> DataFrame:
    """``lang, n, gram, context, suffix, last, count`` of the n-grams of all orders."""
    names = ("n", "gram", "context", "suffix", "count")
    schema = pa.schema([("lang", pa.string()), *((n, pa.int64()) for n in names)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in chunks(binary(batch.column(1))):
                langs = np.array(batch.column(0).slice(first, len(part)).to_pylist(), object)
                for lang in np.unique(langs.astype(str)):
                    texts = [normalised(t) for t, l in zip(part, langs) if l == lang]
                    for n in range(1, order + 1):
                        grams, contexts, suffixes = (
                            np.concatenate([side(t, n) for t in texts]) for side in (_whole, _context, _suffix)
                        )
                        if len(grams):
                            grams, at, times = np.unique(grams, return_index=True, return_counts=True)
                            columns = (grams, contexts[at], suffixes[at])
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array([lang] * len(grams)), pa.array(np.full(len(grams), n)),
                                    *(pa.array(c.astype(np.int64)) for c in columns),
                                    pa.array(times.astype(np.int64)),
                                ],
                                schema=schema,
                            )

    rows = sample.select("lang", "text").mapInArrow(
        lambda part: tidy(count(part)), "lang string, n long, gram long, context long, suffix long, count long"
    )
    return rows.groupBy("lang", "n", "gram", "context", "suffix").agg(F.sum("count").alias("count"))


def _whole(points: np.ndarray, n: int) -> np.ndarray:
    return gram_hashes(points, n)


def _context(points: np.ndarray, n: int) -> np.ndarray:
    return gram_hashes(points[:-1], n - 1) if n > 1 else np.zeros(len(points), np.uint64)


def _suffix(points: np.ndarray, n: int) -> np.ndarray:
    return gram_hashes(points[1:], n - 1) if n > 1 else np.zeros(len(points), np.uint64)


def kneser_ney(counts: pd.DataFrame, order: int) -> Models:
    """Models from the counts of all languages. Below the highest order an n-gram counts once for
    every different character before it."""
    counts = counts.astype({c: np.uint64 for c in ("gram", "context", "suffix")})
    languages = sorted(counts["lang"].unique())
    tables = [counts[counts["n"] == n] for n in range(1, order + 1)]
    unions = [t.drop_duplicates("gram").sort_values("gram") for t in tables]
    hashes = [u["gram"].to_numpy() for u in unions]
    alphabet = len(hashes[0]) + 1
    floor = np.zeros(len(languages), np.float32)
    probability = [np.zeros((len(h), len(languages)), np.float32) for h in hashes]
    weight = [np.zeros((len(h), len(languages)), np.float32) for h in hashes]
    for k, lang in enumerate(languages):
        shorter = np.full(1, 1.0 / alphabet)
        for n, table, union, known in zip(range(1, order + 1), tables, unions, hashes):
            own = table[table["lang"] == lang]
            value = own["count"].to_numpy(np.float64)
            if n < order:
                longer = tables[n]
                before = longer.loc[longer["lang"] == lang, "suffix"].value_counts()
                value = before.reindex(own["gram"]).fillna(1).to_numpy(np.float64)
            ones, twos = (value == 1).sum(), (value == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            contexts, group = np.unique(own["context"].to_numpy(), return_inverse=True)
            sums = np.bincount(group, value)
            gamma = discount * np.bincount(group) / sums
            # The chance of every n-gram of any language under the shorter model, then its own.
            if n > 1:
                chance = shorter[np.searchsorted(hashes[n - 2], union["suffix"].to_numpy())]
                context = union["context"].to_numpy()
                at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
                chance = chance * np.where(contexts[at] == context, gamma[at], 1.0)
                weight[n - 2][np.searchsorted(hashes[n - 2], contexts), k] = np.log2(gamma)
            else:
                chance = np.full(len(known), shorter[0] * gamma[0])
                floor[k] = np.log2(chance[0])
            chance[np.searchsorted(known, own["gram"].to_numpy())] += np.maximum(value - discount, 0) / sums[group]
            probability[n - 1][:, k] = np.log2(chance)
            shorter = chance
    return Models(languages, hashes, probability, weight, floor)


def sampled(labelled: DataFrame, documents: int) -> DataFrame:
    """About ``documents`` rows of each language, all of a language that has no more, with a ``fold``
    of two. Which rows, and their folds, follow from hashes of id and text."""
    sizes = stored(labelled.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    hashed = F.xxhash64("doc_id", "text")
    share = F.pmod(hashed, F.lit(1 << 30)) / float(1 << 30)
    fold = F.shiftright(hashed, 40).bitwiseAND(1).cast("int")
    return labelled.join(sizes, "lang").where(share < documents / F.col("n")).select("lang", "text", fold.alias("fold"))


def trained(labelled: DataFrame, order: int = ORDER, documents: int = SAMPLE_DOCUMENTS, slack: float = SLACK) -> Models | None:
    """Models of about ``documents`` labelled documents (``doc_id, text, lang``) of each language. What
    is expected of unseen documents comes from two further models of one fold each, held against the
    documents of the other."""
    labelled = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    rows = stored(sampled(labelled, documents), "language-sample")
    counts = counted(rows.select(F.concat(F.col("fold").cast("string"), "lang").alias("lang"), "text"), order).toArrow().to_pandas()
    if counts.empty:
        return None
    counts["fold"], counts["lang"] = counts["lang"].str[0], counts["lang"].str[1:]
    held = []
    for fold in (0, 1):
        others = counts[counts["fold"] != str(fold)].drop(columns="fold")
        if len(others):
            found = scored(rows.where(F.col("fold") == fold), kneser_ney(others, order)).select("lang", "made.*")
            held.append(found.where("lang = lang_pred").select("lang", "n_letters", "bits").toArrow().to_pandas())
    keys = ["lang", "n", "gram", "context", "suffix"]
    models = kneser_ney(counts.groupby(keys, as_index=False, sort=False)["count"].sum(), order)
    empty = pd.DataFrame({"lang": [], "n_letters": [], "bits": []})
    models.limits = limits(pd.concat(held) if held else empty, models, slack)
    return models


def limits(held: pd.DataFrame, models: Models, slack: float) -> list[tuple[float, float]]:
    """Per language: expected bits per character and deviation of a single character's bits."""
    out = []
    for lang in models.languages:
        own = held[held["lang"] == lang]
        if len(own) < 2:
            out.append((np.inf, 0.0))
            continue
        mean = own["bits"].sum() / own["n_letters"].sum()
        rest = (own["bits"] / own["n_letters"] - mean) * np.sqrt(own["n_letters"])
        out.append((float(mean), float(slack * np.sqrt((rest**2).mean()))))
    return out


_MADE = "struct<lang_pred: string, score: double, n_letters: long, bits: double, rejected: boolean>"


def scored(docs: DataFrame, models: Models | None) -> DataFrame:
    """``docs`` with a column ``made`` of the prediction."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(models)
    types = [pa.string(), pa.float64(), pa.int64(), pa.float64(), pa.bool_()]
    names = ["lang_pred", "score", "n_letters", "bits", "rejected"]

    @F.arrow_udf(_MADE)
    def predict(texts: pa.Array) -> pa.Array:
        parts = (binary(texts.slice(at, _ROWS)) for at in range(0, len(texts), _ROWS))
        rows = [predicted(shared.value, text) for part in parts for text in part]
        give_back()
        columns = zip(*rows) if rows else [[]] * len(types)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    # Not evaluated again for a filter on its result: that would take a second worker for every task.
    return docs.withColumn("made", predict.asNondeterministic()("text"))


def predicted(models: Models | None, text: bytes) -> tuple[str, float, int, float, bool]:
    points = normalised(text) if models and text else np.zeros(0, np.uint32)
    count = int(np.count_nonzero(points != _SPACE))
    if not count:
        return UNKNOWN, 0.0, 0, 0.0, True
    bits = models.costs(points)
    best = int(bits.argmin())
    size = len(points) - 1
    # How much likelier the best language makes a character than the others together, at most a
    # hundred characters long: 1 / number of languages (a tie) to 1.
    odds = np.exp2((bits[best] - bits) * min(1.0, 100.0 / size))
    limit = True
    if models.limits:
        mean, deviation = models.limits[best]
        limit = bits[best] / size <= mean + deviation / np.sqrt(size) + 0.5
    return models.languages[best], float(1 / odds.sum()), size, float(bits[best]), not limit


def identified(docs: DataFrame, models: Models | None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``bits``, ``n_letters`` and ``rejected``."""
    others = [c for c in docs.columns if c not in ("lang_pred", "score", "n_letters", "bits", "rejected")]
    rows = docs.select(F.struct(*others).alias("row"), "text")
    return scored(rows, models).select("row.*", "made.*")
