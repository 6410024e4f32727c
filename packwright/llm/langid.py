"""Language ID by hyperdimensional profiles: bound and permuted letter vectors, bundled, compared by cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.llm.common import bound_batches, held_out, map_pandas

#: Dimensions of the vectors, letters of an n-gram, and letter symbols (blank, a-z, and hashed others).
DIM, ORDER, SYMBOLS = 1024, 3, 64
SEED = 20_240_229
#: Documents whose n-gram counts are multiplied by the n-gram vectors at once.
BLOCK = 128
UNKNOWN = "und"
#: Cosine with its prototype under which a text counts as in none of the languages.
LEAST_COSINE = 0.05
_cache: dict[str, np.ndarray] = {}


def letter_vectors() -> np.ndarray:
    """ORDER x SYMBOLS x DIM of -1 and 1: random letter vectors, and what 1, 2, ... cyclic permutations make of them."""
    if "letters" not in _cache:
        base = np.random.RandomState(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIM))
        _cache["letters"] = np.stack([np.roll(base, ORDER - 1 - k, axis=1) for k in range(ORDER)])
    return _cache["letters"]


def gram_vectors(codes: np.ndarray) -> np.ndarray:
    """The bound vector of each n-gram code: the product of its letters' vectors, each permuted by its place."""
    letters = letter_vectors()
    out = letters[ORDER - 1][codes % SYMBOLS]
    for k in range(2, ORDER + 1):
        out = out * letters[ORDER - k][codes // SYMBOLS ** (k - 1) % SYMBOLS]
    return out.astype(np.float32)


def _symbol_table() -> np.ndarray:
    """Symbol of each code point: 0 no letter, 1-26 a-z, else a hash over the others."""
    if "symbols" not in _cache:
        table = np.zeros(0x110000, np.uint8)
        letters = np.frombuffer(bytes(chr(i).isalpha() for i in range(0x110000)), np.uint8).astype(bool)
        at = np.flatnonzero(letters)
        table[at] = 27 + (at * 2654435761 % (1 << 32) >> 16) % (SYMBOLS - 27)
        table[97:123] = np.arange(1, 27)
        _cache["symbols"] = table
    return _cache["symbols"]


def gram_codes(text: str | None) -> np.ndarray:
    """Codes of the n-grams of the lower-cased whole text; a run of anything but letters is one blank. Empty without a letter."""
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _symbol_table()[raw]
    if not s.any():
        return np.zeros(0, np.int64)
    s = np.concatenate([np.zeros(1, np.uint8), s, np.zeros(1, np.uint8)])
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])].astype(np.int64)
    s = np.concatenate([s, np.zeros(max(0, ORDER - len(s)), np.int64)])
    return sum(s[k : len(s) - ORDER + 1 + k] * SYMBOLS ** (ORDER - 1 - k) for k in range(ORDER))


def bundle(texts: list[str | None]) -> np.ndarray:
    """The unit vector of each text: the sum of its n-grams' vectors over its length; zero without a letter."""
    out = np.zeros((len(texts), DIM), np.float32)
    for at in range(0, len(texts), BLOCK):
        grams = [gram_codes(t) for t in texts[at : at + BLOCK]]
        doc = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        if not len(doc):
            continue
        used, column = np.unique(np.concatenate(grams), return_inverse=True)
        counts = np.bincount(doc * len(used) + column, minlength=len(grams) * len(used)).reshape(len(grams), len(used)).astype(np.float32)
        out[at : at + len(grams)] = counts @ gram_vectors(used)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def learn_prototypes(documents: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit vectors: bundles over all documents that have a lang and are not held out.

    Each text adds its n-grams over their number. Bundling is linear, so a task sums
    counts by language first and binds vectors once. The driver gets DIM sums for a language."""
    bound_batches(documents.sparkSession)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                grams = gram_codes(text)
                if len(grams):
                    if lang not in sums:
                        sums[lang] = np.zeros(SYMBOLS**ORDER)
                    used, n = np.unique(grams, return_counts=True)
                    sums[lang][used] += n / len(grams)
        for lang, total in sums.items():
            used = np.flatnonzero(total)
            vector = np.zeros(DIM)
            for at in range(0, len(used), 8192):
                part = used[at : at + 8192]
                vector += total[part].astype(np.float32) @ gram_vectors(part)
            yield pd.DataFrame({"lang": lang, "at": np.arange(DIM), "value": vector})

    train = documents.where(~held_out() & F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = train.transform(map_pandas, partial, "lang string, at int, value double").groupBy("lang", "at").agg(F.sum("value").alias("value")).collect()
    langs = sorted({r["lang"] for r in rows})
    vectors = np.zeros((len(langs), DIM))
    index = {x: k for k, x in enumerate(langs)}
    for lang, at, value in rows:
        vectors[index[lang], at] = value
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return langs, (vectors / np.where(norm > 0, norm, 1)).astype(np.float32)


def identify(documents: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of documents.

    train: the labelled documents (by default the same). lang_pred has the greatest
    cosine (of equal ones the first by name), score is that cosine, 0 if negative.
    Null texts, texts without a letter, and all texts where nothing was learned are
    "und" with score 0. A null doc_id is not held out. Other columns are left out."""
    langs, prototypes = learn_prototypes(documents if train is None else train)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = np.array([*langs, UNKNOWN], object)
        for b in batches:
            vectors = bundle(list(b["text"]))
            cosine = vectors @ prototypes.T if langs else np.zeros((len(b), 1))
            known = vectors.any(axis=1) & bool(langs)
            best = np.where(known, cosine.argmax(axis=1), len(langs)) if len(b) else np.zeros(0, int)
            score = np.where(known, np.clip(cosine.max(axis=1), 0, 1), 0.0).astype(float) if len(b) else np.zeros(0)
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": names[best], "score": score})

    rows = documents.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.transform(map_pandas, predict, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(documents: DataFrame, train: DataFrame | None = None, least: float = LEAST_COSINE) -> DataFrame:
    """The rows of documents whose language is not "und" and whose cosine is at least `least`, all columns as they are.

    Where nothing was learned, nothing is rejected. Rows are judged where they are, so no text is shuffled."""
    langs, prototypes = learn_prototypes(documents if train is None else train)
    if not langs:
        return documents

    @F.pandas_udf("double")
    def cosine(text: pd.Series) -> pd.Series:
        vectors = bundle(list(text))
        return pd.Series(np.where(vectors.any(axis=1), (vectors @ prototypes.T).max(axis=1), -1.0))

    return documents.where(cosine(F.col("text").cast("string")) >= least)
