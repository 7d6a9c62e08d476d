"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

Training counts every character n-gram (inside words, with a mark at both ends) of all labelled rows: tasks count the
distinct words of their rows, then those words' n-grams, and Spark sums them. Continuation counts, discounts and
back-off weights are aggregates over the table of distinct n-grams. The model keeps, for each order, sorted hashes of
n-grams and of contexts with a value per language. Hashes have 64 bits, so that no n-grams share one: a model has a row of
4 * languages + 8 bytes for each distinct n-gram and context and grows with them; that is what is broadcast.

A text gets the language of the lowest cross-entropy per character. It is rejected when that lies above what the
language's own training texts show, by more than ``slack`` nats and ``z`` deviations for its length: texts that mix two
learned languages stay, texts in none of them go.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_worker_caches, stored
from .shingles import STEP, U, mix

UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
SLICE = 3 << 20  # bytes of text whose words are counted at once
ALPHABET = 1024  # characters that share the mass of unseen ones


@dataclass
class Model:
    languages: list[str]
    order: int
    grams: list[tuple[np.ndarray, np.ndarray]]  # per order: sorted hashes, discounted probabilities
    contexts: list[tuple[np.ndarray, np.ndarray]]  # per order: sorted hashes, back-off weights
    entropy: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))  # mean and deviation per language

    def size(self) -> int:
        return sum(a.nbytes for pairs in (self.grams, self.contexts) for pair in pairs for a in pair)


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def clean(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def char_grams(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each predicted character of ``words``: its code and those before it, newest first (0 before the word's mark), and its word.

    A word is read as a mark, its letters and a mark; every character but the first mark is predicted.
    """
    lengths = np.array([len(w) + 2 for w in words], dtype=np.int64)
    codes = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le"), dtype=np.uint32).astype(U)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - starts[owner]
    keep = place > 0
    at, place = np.flatnonzero(keep), place[keep]
    table = np.zeros((order, len(at)), dtype=U)
    for k in range(order):
        table[k] = np.where(place >= k, codes[np.maximum(at - k, 0)], U(0))
    return table, owner[keep], place


def slot(codes: np.ndarray) -> np.ndarray:
    """64-bit hash of n-grams given as one row per character, newest first."""
    h = np.full(codes.shape[1], U(len(codes) * 0x9E3779B97F4A7C15 % 2**64), dtype=U)
    for k, row in enumerate(codes):
        h += row * STEP[k]
    return mix(h)


def _count(order: int, most_words: int = 300_000):
    def flush(words: Counter) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, list[tuple[str, int]]] = {}
        for (lang, w), n in words.items():
            if w := clean(w):
                by_lang.setdefault(lang, []).append((w, n))
        for lang, pairs in by_lang.items():
            names = [w for w, _ in pairs]
            table, owner, place = char_grams(names, order)
            keys = np.zeros(table.shape[1], dtype=U)
            for k in range(order):
                keys = mix(keys ^ (table[k] * STEP[k]))
            _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
            n = np.bincount(inverse, weights=np.array([c for _, c in pairs], dtype=np.float64)[owner]).astype(np.int64)
            grams = []
            for i in first.tolist():
                word, p = f" {names[owner[i]]} ", int(place[i])
                grams.append(word[max(0, p - order + 1) : p + 1])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(n)], names=["lang", "gram", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_caches()
        words: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                if text.is_valid:
                    for w, n in Counter(words_of(text.as_py())).items():
                        words[lang, w] += n
                if len(words) > most_words:
                    yield from flush(words)
                    words.clear()
        yield from flush(words)

    return count


def _slots():
    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, dtype=U)
            grams = batch["gram"].to_pylist()
            for n in set(map(len, grams)):
                at = [i for i, g in enumerate(grams) if len(g) == n]
                if n:
                    codes = np.frombuffer("".join(grams[i] for i in at).encode("utf-32-le"), dtype=np.uint32).reshape(-1, n).T[::-1].astype(U)
                else:
                    codes = np.zeros((0, len(at)), dtype=U)
                out[at] = slot(codes)
            yield pa.RecordBatch.from_arrays([batch["kind"], batch["n"], batch["lang"], pa.array(out.view(np.int64)), batch["value"]], names=["kind", "n", "lang", "slot", "value"])

    return slots


def kneser_ney(counts: DataFrame, order: int) -> DataFrame:
    """``counts`` (lang, gram, n) to (kind, n, lang, gram, value): probabilities less the discount, and contexts' back-off weights."""
    raw = counts.groupBy("lang", "gram").agg(F.sum("n").alias("c"))
    raw = stored(raw, "language-counts")
    level, out = None, []
    for n in range(order, 0, -1):
        rows = raw.where(F.length("gram") == n)
        if level is not None:
            left = level.where(F.length("gram") == n + 1).groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("c"))
            rows = rows.unionByName(left).groupBy("lang", "gram").agg(F.sum("c").alias("c"))
        level = stored(rows, f"language-order{n}")
        ones = level.groupBy("lang").agg(F.sum((F.col("c") == 1).cast("long")).alias("n1"), F.sum((F.col("c") == 2).cast("long")).alias("n2"))
        discount = ones.select("lang", F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(F.lit(0.5)).alias("d"))
        rows = level.withColumn("context", F.expr(f"substring(gram, 1, {n - 1})"))
        context = rows.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"))
        rows = rows.join(context, ["lang", "context"]).join(discount, "lang")
        out.append(rows.select(F.lit(0).alias("kind"), F.lit(n).alias("n"), "lang", "gram", ((F.col("c") - F.col("d")) / F.col("total")).alias("value")))
        out.append(context.join(discount, "lang").select(
            F.lit(1).alias("kind"), F.lit(n).alias("n"), "lang", F.col("context").alias("gram"), (F.col("d") * F.col("kinds") / F.col("total")).alias("value")
        ))
    both = out[0]
    for x in out[1:]:
        both = both.unionByName(x)
    return both


def learn(rows: DataFrame, *, order: int = 4) -> Model:
    """Model from ``rows`` (text, lang), all of them, without thresholds; null texts and null languages teach nothing."""
    rows = rows.where("lang is not null").select("text", "lang")
    counts = rows.mapInArrow(_count(order), "lang string, gram string, n long")
    values = kneser_ney(counts, order).mapInArrow(_slots(), "kind int, n int, lang string, slot long, value double")
    found = values.toArrow()
    languages = sorted(set(found["lang"].to_pylist()))
    kind, n, at = found["kind"].to_numpy(), found["n"].to_numpy(), found["slot"].to_numpy().view(U)
    lang = np.searchsorted(languages, found["lang"].to_numpy(zero_copy_only=False).astype(str)) if languages else np.zeros(0, dtype=int)
    value = found["value"].to_numpy()

    def array_of(k: int, o: int) -> tuple[np.ndarray, np.ndarray]:
        own = (kind == k) & (n == o)
        keys, inverse = np.unique(at[own], return_inverse=True)
        out = np.full((len(keys), len(languages)), float(k), dtype=np.float32)  # no such context: all mass backs off
        out[inverse, lang[own]] = value[own]
        return keys, out

    return Model(languages, order, [array_of(0, o) for o in range(1, order + 1)], [array_of(1, o) for o in range(1, order + 1)])


def calibrated(model: Model, scored: DataFrame) -> Model:
    """The model with thresholds from scored texts (lang, _text, _lang, _entropy, _letters; _text tells texts apart).

    Mean and deviation of the cross-entropy, for rejection, are those of all of a language's distinct texts of 100 letters or
    more that it gets. Without such texts they are taken over its shorter ones by letters, and without any that get the language, the
    largest of the other languages.
    """
    model.entropy = np.tile([np.log(ALPHABET), 0.0], (len(model.languages), 1))
    if model.languages:
        seen = scored.where("lang = _lang").select("lang", "_text", "_entropy", "_letters").dropDuplicates(["lang", "_text"])
        by_letters = F.sum(F.col("_entropy") * F.col("_letters")) / F.sum("_letters")
        long = F.when(F.col("_letters") >= 100, F.col("_entropy"))
        stats = seen.groupBy("lang").agg(F.coalesce(F.avg(long), by_letters), F.coalesce(F.stddev_pop(long), F.lit(0.0))).collect()
        if stats:
            model.entropy[:] = max(m for _, m, _ in stats), max(d for _, _, d in stats)
        for name, mean, deviation in stats:
            model.entropy[model.languages.index(name)] = (mean, deviation)
    return model


def train_models(rows: DataFrame, *, order: int = 4) -> Model:
    """Model from ``rows`` (text, lang) with thresholds from the same rows: ``learn``, then ``calibrated``."""
    rows = rows.where("lang is not null").select("text", "lang")
    model = learn(rows, order=order)
    texts = rows.where("text is not null").withColumn("_text", F.xxhash64("text"))
    return calibrated(model, scored(texts, model))


def train_and_identify(docs: DataFrame, *, teaches: Column | None = None, order: int = 4) -> DataFrame:
    """``identify`` with a model from the rows of ``docs`` (text, lang) that teach, by default all; every text is scored once.

    The scores are stored with the columns of ``docs``; thresholds are read from the stored scores of the rows that teach.
    """
    teaches = F.lit(True) if teaches is None else F.coalesce(teaches, F.lit(False))
    rows = docs.withColumns({"_teaches": teaches & F.col("lang").isNotNull() & F.col("text").isNotNull(), "_text": F.xxhash64("text")})
    model = learn(rows.where("_teaches"), order=order)
    found = stored(scored(rows, model).drop("text"), "language-scores")
    return accepted(found.drop("_teaches", "_text"), calibrated(model, found.where("_teaches")))


def _value(pair: tuple[np.ndarray, np.ndarray], keys: np.ndarray, default: float) -> np.ndarray:
    hashes, values = pair
    if not len(hashes):
        return np.full((len(keys), values.shape[1]), default, dtype=np.float32)
    i = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
    out = values[i]
    out[hashes[i] != keys] = default
    return out


def word_scores(model: Model, words: list[str]) -> np.ndarray:
    """Log-probability of each word in each language."""
    table, owner, place = char_grams(words, model.order)
    keys = np.zeros(table.shape[1], dtype=U)
    for k in range(model.order):
        keys = mix(keys ^ (table[k] * STEP[k]))
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    table, place = table[:, first], place[first]
    p = np.full((len(first), len(model.languages)), 1 / ALPHABET)
    for n in range(1, model.order + 1):
        inside = place >= n - 1
        codes = table[:n, inside]
        p[inside] = _value(model.grams[n - 1], slot(codes), 0.0) + _value(model.contexts[n - 1], slot(codes[1:]), 1.0) * p[inside]
    logs = np.log(p)[inverse]
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    return np.add.reduceat(logs, starts, axis=0)


def _identify(model: Model, keep: list[str], text_col: str = "text", sharp: float = 12.0):
    count = len(model.languages)

    def of(texts: list[str | None]) -> tuple[list, ...]:
        counters = [Counter(words_of(t)) if t else Counter() for t in texts]
        names = list(dict.fromkeys(w for c in counters for w in c))
        known = [w for w in names if clean(w)]
        logs = np.zeros((len(names) + 1, count + 1))
        index = {w: i for i, w in enumerate(names)}
        if known and count:
            at = [index[w] for w in known]
            cleaned = [clean(w) for w in known]
            logs[at, :count] = word_scores(model, cleaned)
            logs[at, count] = [len(w) + 1 for w in cleaned]
        langs, scores, entropies, letters = [], [], [], []
        for c in counters:
            total = logs[[index[w] for w in c], :].T @ np.fromiter(c.values(), dtype=np.float64, count=len(c)) if c else np.zeros(count + 1)
            n = total[count]
            if not n:
                langs.append(UNKNOWN), scores.append(0.0), entropies.append(None), letters.append(0)
                continue
            mean = total[:count] / n
            best = int(np.argmax(mean))
            langs.append(model.languages[best])
            scores.append(float(1 / np.exp(sharp * (mean - mean[best])).sum()))
            entropies.append(float(-mean[best]))
            letters.append(int(n))
        return langs, scores, entropies, letters

    kinds = [("_lang", pa.string()), ("_score", pa.float64()), ("_entropy", pa.float64()), ("_letters", pa.int64())]

    def identify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_caches()
        for whole in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(whole[text_col]), 0).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < whole.num_rows:  # a few MB of text at once: the words of a text take far more memory than the text
                base = sizes[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(sizes, base + SLICE, side="right")))
                batch = whole.slice(lo, hi - lo)
                found = of(batch[text_col].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch[c] for c in keep] + [pa.array(x, t) for x, (_, t) in zip(found, kinds, strict=True)], names=keep + [c for c, _ in kinds]
                )
                lo = hi

    return identify_batches


ADDED = ("_lang", "_score", "_entropy", "_letters")


def scored(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """Every row with all its columns, and _lang, _score (0 to 1), _entropy, _letters; columns with these names are replaced."""
    keep = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep])
    added = [T.StructField(c, kind) for c, kind in zip(ADDED, (T.StringType(), T.DoubleType(), T.DoubleType(), T.LongType()), strict=True)]
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # arrays and names only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _identify(Model(**shared.value), keep, text_col)(batches)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *added]))


def accepted(rows: DataFrame, model: Model, *, z: float = 6.0, slack: float = 0.8, spread: float = 3.0) -> DataFrame:
    """Scored rows with _accepted: the entropy is no more than ``slack`` and ``z`` deviations, for the text's length, above the language's mean."""
    means, deviations = (
        F.create_map(*[F.lit(x) for name, pair in zip(model.languages, model.entropy, strict=True) for x in (name, float(pair[i]))]) if model.languages else F.lit(None)
        for i in (0, 1)
    )
    of = lambda table: F.try_element_at(table, F.col("_lang")) if model.languages else F.lit(None).cast("double")
    most = of(means) + slack + z * F.sqrt(F.pow(of(deviations), F.lit(2.0)) + spread**2 / F.col("_letters"))
    return rows.withColumn("_accepted", F.coalesce((F.col("_letters") > 0) & (F.col("_entropy") <= most), F.lit(False)))


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", z: float = 6.0, slack: float = 0.8) -> DataFrame:
    """Every row with all its columns, and _lang, _score (0 to 1), _entropy, _letters, _accepted.

    Null texts and texts without a letter get ``und``, score 0, and are not accepted; so does everything if nothing was
    learned. Long texts are read whole. Repeated rows get equal results. Columns of ``docs`` with the added names are replaced.
    """
    return accepted(scored(docs.drop("_accepted"), model, text_col=text_col), model, z=z, slack=slack)
