"""Language ID: interpolated Kneser-Ney character models, one for each language, in sorted hash arrays.

A text is lower-cased, each run of characters that aren't letters becomes one space, and four-grams of what is left
are 64-bit codes of four 16-bit characters (letters beyond the basic plane share one code). Spark counts the codes of
all training texts by language; the model is built from those counts, language by language, and keeps every counted
four-gram. Scoring looks each different four-gram of a batch up in each language's sorted hash arrays, and sums by text.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, pieces, ship, utf8

ORDER = 4
PIECE = 1 << 20
BLANK = 32
SPREAD = np.uint64(0x9E3779B97F4A7C15)
_codes: list[np.ndarray] = []


def codes() -> np.ndarray:
    """From code point to the model's 16-bit character: letters are themselves, all else is a blank."""
    if not _codes:
        letters = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
        _codes.append(np.where(letters, np.minimum(np.arange(sys.maxunicode + 1), 0xFFFF), BLANK).astype(np.uint16))
    return _codes[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The four-gram codes of all texts in order, and how many each text has: none if it has no letter."""
    low = [t.lower() for t in texts]
    sizes = np.array([len(t) for t in low], np.int64)
    chars = codes()[np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = chars == BLANK
    start = np.cumsum(sizes) - sizes
    before = np.empty(len(chars), bool)
    before[1:] = blank[:-1]
    before[start[sizes > 0]] = True
    keep = ~(blank & before)
    total = np.concatenate([[0], np.cumsum(keep)])
    ends = start + sizes
    kept = total[ends] - total[start]
    chars = chars[keep]
    # three characters of padding before each text: two zeros and a blank
    n = np.where(kept > 0, kept + 3, 0)
    put = np.cumsum(n) - n
    line = np.zeros(int(n.sum()), np.uint64)
    line[put[kept > 0] + 2] = BLANK
    line[np.arange(len(chars)) + np.repeat(put + 3 - (np.cumsum(kept) - kept), kept)] = chars
    if not len(line):
        return np.zeros(0, np.uint64), kept
    code = (line[:-3] << np.uint64(48)) | (line[1:-2] << np.uint64(32)) | (line[2:-1] << np.uint64(16)) | line[3:]
    own = np.arange(len(chars)) + np.repeat(put - (np.cumsum(kept) - kept), kept)
    return code[own], kept


def _merge(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, fold, gram, n) of (text, lang, fold): how often a gram stands in the texts of a fold."""
    held: dict[tuple[str, int], list] = {}
    for batch in batches:
        _, offsets = utf8(batch.column("text"))
        texts = batch.column("text").to_pylist()
        owners = list(zip(batch.column("lang").to_pylist(), batch.column("fold").to_pylist()))
        names = {o: i for i, o in enumerate(set(owners))}
        numbers = np.array([names[o] for o in owners], np.int64)
        for a, b in pieces(offsets, PIECE):
            found, n = grams([t or "" for t in texts[a:b]])
            owner = np.repeat(numbers[a:b], n)
            for name in {owners[i] for i in range(a, b)}:
                keys, count = np.unique(found[owner == names[name]], return_counts=True)
                held.setdefault(name, []).append((keys, count))
                if len(held[name]) == 8:
                    held[name] = [_merge(*map(np.concatenate, zip(*held[name])))]
    for (lang, fold), parts in held.items():
        keys, count = _merge(*map(np.concatenate, zip(*parts)))
        for a in range(0, len(keys), 100_000):
            k, n = keys[a : a + 100_000], count[a : a + 100_000].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(np.full(len(k), fold, np.int32)), pa.array(k.view(np.int64)), pa.array(n)], ["lang", "fold", "gram", "n"])


@dataclass
class HashArray:
    """Values by 64-bit code: the codes are spread by an odd factor and sorted, and found by binary search."""

    hashes: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, codes_: np.ndarray, values: np.ndarray) -> HashArray:
        hashes = codes_ * SPREAD
        order = np.argsort(hashes)
        return cls(hashes[order], values[order])

    def find(self, codes_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each code stands, and whether it is there."""
        hashes = codes_ * SPREAD
        if not len(self.hashes):
            return np.zeros(len(codes_), np.int64), np.zeros(len(codes_), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes


@dataclass
class KneserNey:
    """Interpolated Kneser-Ney estimates of one language from its four-gram counts."""

    chars: int
    probability: list[HashArray] = field(default_factory=list)  # of orders 1 to 4
    backoff: list[HashArray] = field(default_factory=list)  # of contexts of 0 to 3 characters

    @classmethod
    def fit(cls, keys: np.ndarray, n: np.ndarray, chars: int) -> KneserNey:
        levels = [(keys, n.astype(np.float64))]
        for order in range(ORDER - 1, 0, -1):
            lower, kinds = np.unique(levels[0][0] & np.uint64((1 << 16 * order) - 1), return_counts=True)
            levels.insert(0, (lower, kinds.astype(np.float64)))  # in how many contexts it goes on
        model = cls(chars)
        for keys, n in levels:
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            context, inverse = np.unique(keys >> np.uint64(16), return_inverse=True)
            total = np.bincount(inverse, n)
            weight = discount * np.bincount(inverse) / total
            lower = np.exp(model.log_p(keys, len(model.probability)))
            p = np.maximum(n - discount, 0) / total[inverse] + weight[inverse] * lower
            model.probability.append(HashArray.of(keys, np.log(p)))
            model.backoff.append(HashArray.of(context, np.log(weight)))
        return model

    def log_p(self, codes_: np.ndarray, order: int) -> np.ndarray:
        """Of each code's last character after the order - 1 before it."""
        if not order:
            return np.full(len(codes_), -math.log(self.chars + 1))
        codes_ = codes_ & np.uint64((1 << 16 * order) - 1) if order < ORDER else codes_
        at, there = self.probability[order - 1].find(codes_)
        out = self.probability[order - 1].values[at] if len(self.probability[order - 1].values) else np.zeros(len(codes_))
        if not there.all():
            rest = codes_[~there]
            up, known = self.backoff[order - 1].find(rest >> np.uint64(16))
            out[~there] = self.log_p(rest, order - 1) + np.where(known, self.backoff[order - 1].values[up], 0.0)
        return out


@dataclass
class Model:
    langs: list[str]
    models: list[KneserNey]
    mean: dict[str, float] = field(default_factory=dict)
    limit: dict[str, float] = field(default_factory=dict)

    def loss(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Negative log-likelihood in nats of each text under each language, and its number of characters."""
        found, n = grams(texts)
        out = np.zeros((len(texts), len(self.langs)))
        if not len(found) or not self.langs:
            return out, n
        kinds, inverse = np.unique(found, return_inverse=True)
        full = n > 0
        starts = (np.cumsum(n) - n)[full]
        for j, m in enumerate(self.models):
            out[full, j] = -np.add.reduceat(m.log_p(kinds, ORDER)[inverse], starts)
        return out, n


#: The weight, in characters, of a language's mean cross-entropy in that of a text: short texts are judged mildly.
PRIOR = 40
#: How far over the quantile of the texts of its language a text's cross-entropy may be: of the texts in the tables at hand
#: none is over 1.22 times it, and text of no language learned is over twice.
MARGIN = 1.5


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            _, offsets = utf8(batch.column("text"))
            texts = batch.column("text").to_pylist()
            for a, b in pieces(offsets, PIECE):
                loss, n = model.loss([t or "" for t in texts[a:b]])
                lang, score, entropy, rejected = [], [], [], []
                for own, size in zip(loss, n.tolist()):
                    if not size or not len(own):
                        lang.append("und"), score.append(0.0), entropy.append(None), rejected.append(True)
                        continue
                    best = int(own.argmin())
                    name = model.langs[best]
                    mean = own / size
                    lang.append(name)
                    score.append(float(1 / np.exp(-(mean - mean[best]) * min(size, PRIOR)).sum()))
                    entropy.append(float(mean[best]))
                    level = model.mean.get(name, mean[best])
                    rejected.append(bool((own[best] + PRIOR * level) / (size + PRIOR) > model.limit.get(name, math.inf)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.array(n), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(rejected, pa.bool_())],
                    ["id", "letters", "lang_pred", "score", "cross_entropy", "rejected"],
                )

    return run


SCORED = [("id", pa.int64()), ("letters", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("rejected", pa.bool_())]
SCHEMA = "id long, letters long, lang_pred string, score double, cross_entropy double, rejected boolean"


#: Into so many folds the training texts fall, by a hash of the text: each is scored by a model of the other folds.
FOLDS = 5
#: Width, as a share of a nat, of the classes in which a quantile is looked for.
CLASSES = 4096


def _model(counts: DataFrame, n: F.Column, langs: list[str], chars: int) -> Model:
    """A model of the counts ``n``, of the languages that have any. The driver gets the counts of one language at a time."""
    model = Model([], [])
    for lang in langs:
        own = counts.filter(F.col("lang") == lang).select("gram", n.alias("n")).filter("n > 0").toArrow()
        if own.num_rows:
            model.langs.append(lang)
            model.models.append(KneserNey.fit(own.column("gram").to_numpy().view(np.uint64), own.column("n").to_numpy(), chars))
    return model


def _quantile(found: DataFrame, value: F.Column, share: float) -> dict[str, float]:
    """For each lang_pred the smallest value that at least ``share`` of its rows don't exceed, exactly: the driver gets the sizes of
    classes of values, and then the values of one class of each language."""
    found = found.select("lang_pred", value.alias("value")).withColumn("class", F.floor(F.col("value") * CLASSES))
    classes: dict[str, list] = {}
    for lang, at, n in found.groupBy("lang_pred", "class").count().collect():
        classes.setdefault(lang, []).append((at, n))

    def reach(sizes: list, rank: int) -> tuple:
        """Where the row of that rank stands, and its rank there."""
        for at, n in sorted(sizes):
            if rank <= n:
                return at, rank
            rank -= n

    place = {lang: reach(sizes, max(1, math.ceil(share * sum(n for _, n in sizes)))) for lang, sizes in classes.items()}
    if not place:
        return {}
    wanted = F.create_map(*[F.lit(x) for lang, (at, _) in place.items() for x in (lang, at)])
    values: dict[str, list] = {}
    for lang, v, n in found.filter(F.col("class") == wanted[F.col("lang_pred")]).groupBy("lang_pred", "value").count().collect():
        values.setdefault(lang, []).append((v, n))
    return {lang: reach(values[lang], rank)[0] for lang, (_, rank) in place.items()}


def fit(labelled: DataFrame, *, quantile: float = 0.999, margin: float = MARGIN) -> Model:
    """A model of the columns text and lang; rows without a lang teach nothing.

    All texts are counted, and the model keeps every counted four-gram of every language. The driver gets the counts of one
    language at a time; the model, about 16 bytes for each language's four-gram and each of its shorter ones, is broadcast.
    Rejection is calibrated on all texts, in FOLDS folds by a hash of the text: each is scored by a model of the other folds,
    which has not seen it or a copy of it. One such model at a time is in memory, and each text is scored once. A text is rejected when
    its cross-entropy, with the weight of PRIOR characters of the mean, is over ``margin`` times the ``quantile`` of its language's texts.
    Only texts of a language that stands in no other fold calibrate nothing, as no model that has not seen them knows it; a language
    without a text that calibrates rejects none.
    """
    spark = labelled.sparkSession
    ship(spark)
    labelled = labelled.select("text", "lang").filter("lang is not null and text is not null").withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))
    own = [F.sum(F.when(F.col("fold") == i, F.col("n")).otherwise(0)).alias(f"fold{i}") for i in range(FOLDS)]
    counts = labelled.mapInArrow(_count, "lang string, fold int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"), *own)
    counts = cut(counts)
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    chars = counts.select(F.col("gram").bitwiseAND(F.lit(0xFFFF).cast("long"))).distinct().count()
    found = None
    for i in range(FOLDS):
        others = _model(counts, F.col("n") - F.col(f"fold{i}"), langs, chars)
        if not others.langs:
            continue
        shared = spark.sparkContext.broadcast(others)
        part = labelled.filter((F.col("fold") == i) & F.col("lang").isin(others.langs)).select(F.lit(0).cast("long").alias("id"), "text")
        scored = cut(part.mapInArrow(_score(shared), SCHEMA).filter("letters > 0").select("lang_pred", "letters", "cross_entropy"))
        shared.destroy()
        found = scored if found is None else found.unionByName(scored)
    model = _model(counts, F.col("n"), langs, chars)
    if found is not None:
        model.mean = {r[0]: r[1] for r in found.groupBy("lang_pred").agg(F.sum(F.col("cross_entropy") * F.col("letters")) / F.sum("letters")).collect()}
    if model.mean:
        mean = F.create_map(*[F.lit(x) for kv in model.mean.items() for x in kv])
        smooth = (F.col("cross_entropy") * F.col("letters") + PRIOR * mean[F.col("lang_pred")]) / (F.col("letters") + PRIOR)
        model.limit = {lang: v * margin for lang, v in _quantile(found, smooth, quantile).items()}
    return model


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, letters, lang_pred, score, cross_entropy in nats a character, rejected), a row for each row of ``docs``.

    lang_pred has the lowest cross-entropy, ties to the name that sorts first; ``und`` with score 0, rejected, if the
    text is null or has no letter, or if the model knows no language. score is the softmax of the length-normalised
    log-likelihoods times the number of characters, PRIOR of them at most. Repeated rows and null ids are kept.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_score(shared), SCHEMA).withColumnRenamed("id", id_col)


def annotate(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns lang_pred and rejected, without a join: the rows pass through as they are."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "rejected")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _score(shared)
        for batch in batches:
            own = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(text_col)], ["id", "text"])
            found = pa.Table.from_batches(list(score(iter([own]))), pa.schema(SCORED)).combine_chunks()
            columns = [found.column(c).combine_chunks() for c in ("lang_pred", "rejected")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "lang_pred", "rejected"])

    schema = docs.schema
    return docs.mapInArrow(run, T.StructType([*schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("rejected", T.BooleanType())]))


def identify_held_out(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, cross_entropy, rejected), a row for each row of ``docs``: learned from the rows that aren't
    held out, by their ids alone, and have an id and a lang.

    Null and empty texts, or ones without a letter, are ``und``; so is every text where nothing could be learned. Rows with a null id aren't
    held out but teach nothing. Repeated rows are kept, and teach as often as they stand. An empty table gives an empty one."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))).filter("doc_id is not null"))
    out = identify(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
