"""Language ID: presence kernels of blended n-gram spectra, Nyström landmarks and one-versus-rest ridge regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evidentia.llm.common import map_arrow, stored

#: Longest n-gram of the blended spectrum (1 to this).
LONGEST = 4
#: n-grams are addressed by this many bits of a hash.
HASH_BITS = 21
#: Bounds of the training sample: texts per language, landmarks per language, code points of a training text, and
#: code points of all training texts, which the languages share.  Each language that is labelled keeps one text at least.
PER_LANGUAGE, LANDMARKS, TRAIN_CHARS, TOTAL_CHARS = 400, 48, 20_000, 32_000_000
#: Texts scored by one matrix product.
BLOCK = 48


def _letter_codes() -> np.ndarray:
    """Code of each code point below 65,536: that of its lower-case letter, or 0 for what is no letter."""
    codes = np.zeros(65_536, np.uint32)
    for c in range(65_536):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = chr(c).lower()
            codes[c] = ord(low) if len(low) == 1 else c
    return codes


def _grams(text: str, codes: np.ndarray) -> tuple[np.ndarray, bool]:
    """Hashed n-grams of the text's letters, runs of other characters counting as one space; whether it has a letter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    high = points > 0xFFFF
    letters = codes[np.where(high, 0, points)]
    if high.any():
        letters = letters.copy()
        at = np.flatnonzero(high)
        letters[at] = [p if chr(p).isalpha() else 0 for p in points[at].tolist()]
    some = letters > 0
    if not some.any():
        return np.empty(0, np.uint32), False
    keep = some.copy()
    keep[1:] |= some[:-1]
    row = np.concatenate(([0], letters[keep], [0])).astype(np.uint32)
    out, h = [], row * np.uint32(2654435761)
    h ^= h >> np.uint32(15)
    one = h
    for n in range(1, LONGEST + 1):
        if n > 1:
            if len(row) < n:
                break
            h = (h[:-1] * np.uint32(0x9E3779B1) + one[n - 1 :]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
        out.append(((h + np.uint32(n * 0x12BE5AB)) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - HASH_BITS))
    return np.concatenate(out), True


@dataclass
class Model:
    """``slots`` addresses n-grams to columns (-1: none); ``weights`` holds the columns' share in each class's score.

    ``limit`` is the least score that a training text gets for its own language when the regression leaves it out.
    """

    classes: list[str]
    slots: np.ndarray
    weights: np.ndarray
    limit: float = 0.0


def _kernel(rows: list[np.ndarray], held: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """K(x, z) of rows of n-grams to landmarks, as batched matrix products of BLOCK rows at a time.

    ``held`` has a column per landmark, 1 over the root of its own number for each n-gram that it holds.
    """
    out = np.empty((len(rows), held.shape[1]))
    for start in range(0, len(rows), BLOCK):
        out[start : start + BLOCK] = _presence(rows[start : start + BLOCK], slots, held.shape[0]) @ held
    return out


def _presence(rows: list[np.ndarray], slots: np.ndarray, width: int) -> np.ndarray:
    """One row per text: 1 over the root of the number of its n-grams, for each of them that a landmark holds."""
    out = np.zeros((len(rows), width), np.float32)
    for i, grams in enumerate(rows):
        at = slots[grams]
        out[i, at[at >= 0]] = 1 / np.sqrt(max(1, len(grams)))
    return out


def train(texts: list[str], langs: list[str], per_class_landmarks: int = LANDMARKS, ridge: float = 1e-2) -> Model | None:
    """Fit on bounded lists.  K(x, z) is the number of n-grams in both over the root of the product of their numbers.

    All n-grams of all landmarks count: a text's other n-grams are in no landmark, so add to its number only.
    """
    codes = _letter_codes()
    rows, labels = [], []
    for text, lang in zip(texts, langs, strict=True):
        grams = _grams(text, codes)[0]
        if len(grams):
            rows.append(np.unique(grams))
            labels.append(lang)
    classes = sorted(set(labels))
    if not classes:
        return None
    taken: dict[str, int] = {}
    marks = []
    for i, lang in enumerate(labels):
        if taken.setdefault(lang, 0) < per_class_landmarks:
            taken[lang] += 1
            marks.append(i)
    words = np.unique(np.concatenate([rows[i] for i in marks]))
    slots = np.full(1 << HASH_BITS, -1, np.int32)
    slots[words] = np.arange(len(words))
    held = np.zeros((len(words), len(marks)), np.float32)
    for j, i in enumerate(marks):
        held[slots[rows[i]], j] = 1 / np.sqrt(len(rows[i]))
    among = _kernel([rows[i] for i in marks], held, slots)
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    features = _kernel(rows, held, slots) @ root
    number = {c: i for i, c in enumerate(classes)}
    own_class = np.array([number[lang] for lang in labels])
    goal = np.where(own_class[:, None] == np.arange(len(classes)), 1.0, -1.0)
    balance = (1.0 / np.bincount(own_class))[own_class][:, None]
    spread = np.linalg.solve(features.T @ (features * balance) + ridge * np.eye(len(marks)), features.T)
    solved = spread @ (goal * balance)
    # Leaving a row out of a ridge regression has a closed form: its leverage takes its own goal off its value.
    leverage = np.einsum("ij,ji->i", features, spread)[:, None] * balance
    without = (features @ solved - leverage * goal) / np.maximum(1 - leverage, 1e-6)
    own = without[np.arange(len(rows)), own_class][without.argmax(1) == own_class]
    limit = float(np.clip((own.min() + 1) / 2, 0, 1)) if len(own) else 0.0
    return Model(classes, slots, held @ (root @ solved).astype(np.float32), limit)


def training_sample(documents: DataFrame, usable: Column, per_language: int = PER_LANGUAGE, most_chars: int = TRAIN_CHARS, total_chars: int = TOTAL_CHARS) -> tuple[list[str], list[str]]:
    """Usable texts of each language that is labelled, chosen by a hash of doc_id, in a fixed order.

    A language has at most ``per_language`` texts, and as many as fit in its share of ``total_chars``, but at least
    one.  Counts per language first give a share of rows by hash, so that only about twice the bound is ranked.
    """
    fit = documents.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= most_chars))
    counts = fit.groupBy("lang").agg(F.count("*").alias("n"))
    counts = stored(counts.withColumnRenamed("lang", "_lang"), "languages")
    languages = counts.count()
    if not languages:
        return [], []
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    near = fit.join(counts, F.col("lang") == F.col("_lang")).where(slot < F.expr(f"{2_000_000 * per_language} div n + 200")).select("text", "lang", F.xxhash64("doc_id").alias("h"))
    order = W.partitionBy("lang").orderBy("h", "text")
    ranked = near.withColumn("rn", F.row_number().over(order)).withColumn("upto", F.sum(F.length("text")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    rows = ranked.where((F.col("rn") <= per_language) & ((F.col("rn") == 1) | (F.col("upto") <= total_chars // languages))).select("text", "lang", "rn").collect()
    rows.sort(key=lambda r: (r.lang, r.rn))
    return [r.text for r in rows], [r.lang for r in rows]


def _scores(texts: list[str | None], model: Model, codes: np.ndarray) -> list[tuple[str, float]]:
    out: list[tuple[str, float]] = []
    for start in range(0, len(texts), BLOCK):
        block = texts[start : start + BLOCK]
        found = [_grams(text, codes) if text else (np.empty(0, np.uint32), False) for text in block]
        letters = [some for _, some in found]
        values = _presence([np.unique(grams) for grams, _ in found], model.slots, len(model.weights)) @ model.weights
        best = values.argmax(1)
        for i in range(len(block)):
            if letters[i]:
                out.append((model.classes[best[i]], float(np.clip((values[i, best[i]] + 1) / 2, 0, 1))))
            else:
                out.append(("und", 0.0))
    return out


def fit_language_model(documents: DataFrame) -> Model | None:
    """A model from documents whose crc32(doc_id as text) mod 3 is not 1; null if there are none with a language."""
    usable = F.col("doc_id").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1)
    return train(*training_sample(_columns(documents), usable))


def _columns(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("text", "lang")))


def identify_language(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each whole text.

    ``und`` with score 0 if the text is null or has no letter, or if there is nothing to learn from.  A null doc_id
    is not held out and not learned from; repeated rows stay.  Prediction reads the text alone.
    """
    documents = _columns(documents)
    model = model or fit_language_model(documents)
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    rows = documents.select("doc_id", "text", held_out.alias("held_out"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = documents.sparkSession.sparkContext.broadcast((model.classes, model.slots, model.weights))

    def run(batch: pa.RecordBatch, state) -> pa.RecordBatch:
        langs, scores = zip(*_scores(batch.column("text").to_pylist(), *state), strict=True)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    return map_arrow(rows, run, "doc_id bigint, held_out boolean, lang_pred string, score double", lambda: (Model(*sent.value), _letter_codes()))


def with_language(documents: DataFrame, model: Model | None, names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """The documents, all columns, with the prediction and its score in columns of these names; existing ones give way.

    A text without a letter is ``und`` with score 0.  Without a model, other texts have null in both columns.
    """
    kept = documents.drop(*names)
    sent = documents.sparkSession.sparkContext.broadcast((model.classes, model.slots, model.weights) if model else None)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def run(batch: pa.RecordBatch, state) -> pa.RecordBatch:
        model, codes = state
        texts = batch.column("text").to_pylist()
        found = _scores(texts, model, codes) if model else [(None, None) if any(map(str.isalpha, t or "")) else ("und", 0.0) for t in texts]
        langs, scores = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, *names])

    return map_arrow(kept, run, f"{shape}, `{names[0]}` string, `{names[1]}` double", lambda: (Model(*sent.value) if sent.value else None, _letter_codes()))
