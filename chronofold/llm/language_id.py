"""Language identification: the family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from chronofold.llm import kernels as K

#: Languages by family (fixed values); a label that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "hr", "sr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk"),
    "semitic": ("ar", "he"),
    "sinitic": ("zh", "yue"),
}
#: Hash places of the byte one- to three-grams that a text is described by.
PLACES = 2048
#: Labelled texts of a language that the classifiers are fitted on.
SAMPLE_A_LANGUAGE = 1000
#: Answer for texts without a letter.
UNDETERMINED = "und"

_FOLD = np.arange(256, dtype=np.int64)
_FOLD[65:91] += 32
_FOLD[[*range(0x21), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80), *range(0x21, 0x3A)]] = 32


def describe(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row for each text: square roots of its gram shares, of length one (zeros for an empty text).

    All bytes of the text count; small letters, everything else in ASCII as a space.
    """
    n = len(offsets) - 1
    out = np.zeros((n, PLACES), np.float32)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        counts = np.zeros(PLACES, np.int64)
        for lo in range(a, b, K.SLICE_BYTES):  # grams over the cut are counted from the two bytes before it
            x = _FOLD[data[max(a, lo - 2):min(b, lo + K.SLICE_BYTES)]]
            skip = min(2, lo - a)
            pairs = x[:-1] * 263 + x[1:]
            for g in (x[skip:] * 7919 + 11, (pairs * 40503 + 57)[max(0, skip - 1):], pairs[:-1] * 69061 + x[2:] * 1_000_003):
                counts += np.bincount(((g ^ (g >> 11)) * 2_654_435_761 >> 13) & (PLACES - 1), minlength=PLACES)
        if counts.any():
            row = np.sqrt(counts.astype(np.float32))
            out[i] = row / np.linalg.norm(row)
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 120) -> np.ndarray:
    """Weights (bias last) of a linear SVM with squared hinge loss; classes weigh alike.  y is +1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float32)
    y = y.astype(np.float32)
    share = np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y < 0).sum())).astype(np.float32) * np.float32(len(y) / 2)
    w = ahead = np.zeros(x.shape[1], np.float32)
    rate = np.float32(1 / (1 + 2 * cost * 2 * share.max()))  # a row has length at most the root of two
    for t in range(steps):  # accelerated gradient descent on |w|^2 / 2 + cost * mean(share * hinge^2)
        slack = np.maximum(0, 1 - y * (x @ ahead))
        step = ahead - rate * (ahead - np.float32(2 * cost / len(y)) * (x.T @ (share * y * slack)))
        ahead = step + np.float32(t / (t + 3)) * (step - w)
        w = step
    return w


def _sure(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-2 * margin))


@dataclass
class LanguageModel:
    """One SVM for each family against the others, one for each pair of languages within a family."""

    families: dict[str, list[str]]
    of_family: dict[str, np.ndarray] = field(default_factory=dict)
    of_pair: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str]) -> LanguageModel:
        home = {lang: f for f, members in FAMILIES.items() for lang in members}
        families: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            families.setdefault(home.get(lang, lang), []).append(lang)
        model = cls(dict(sorted(families.items())))
        langs = np.array(langs)
        own = np.array([home.get(lang, lang) for lang in langs])
        if len(families) > 1:
            for f in model.families:
                model.of_family[f] = fit_svm(x, np.where(own == f, 1.0, -1.0))
        for members in model.families.values():
            for a, b in combinations(members, 2):
                rows = (langs == a) | (langs == b)
                model.of_pair[a, b] = fit_svm(x[rows], np.where(langs[rows] == a, 1.0, -1.0))
        return model

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        names, pairs = list(self.families), list(self.of_pair)
        weights = np.array([*self.of_family.values(), *self.of_pair.values()], np.float32).reshape(-1, PLACES + 1)
        margins = x @ weights[:, :-1].T + weights[:, -1]
        if self.of_family:
            best, sure = margins[:, :len(names)].argmax(axis=1), _sure(margins[:, :len(names)].max(axis=1))
        else:
            best, sure = np.zeros(len(x), int), np.ones(len(x))
        of_pair = {p: margins[:, len(self.of_family) + i] for i, p in enumerate(pairs)}
        langs, scores = [""] * len(x), np.zeros(len(x))
        for i, f in enumerate(names):
            rows, members = np.flatnonzero(best == i), self.families[f]
            if not len(rows):
                continue
            votes, margin = np.zeros((len(rows), len(members))), np.full((len(rows), len(members)), np.inf)
            for (a, b) in combinations(range(len(members)), 2):
                m = of_pair[members[a], members[b]][rows]
                votes[:, a] += m >= 0
                votes[:, b] += m < 0
                margin[:, a], margin[:, b] = np.minimum(margin[:, a], m), np.minimum(margin[:, b], -m)
            # Most votes; among equals the language whose worst duel went best.
            top = np.where(votes == votes.max(axis=1, keepdims=True), margin, -np.inf).argmax(axis=1)
            worst = margin[np.arange(len(rows)), top]
            scores[rows] = sure[rows] * np.where(np.isinf(worst), 1, _sure(worst))
            for r, t in zip(rows, top):
                langs[r] = members[t]
        return langs, scores


def fit(labelled: DataFrame, sample: int = SAMPLE_A_LANGUAGE) -> LanguageModel | None:
    """A model from (doc_id, text, lang); about `sample` whole texts of each
    language (twice that for all at most), chosen by the hash of doc_id, come to the driver as gram shares.

    Null texts and null labels teach nothing.  None if there is no labelled text.
    """
    real = labelled.where("text is not null and lang is not null and length(text) > 0")
    counts = {r.lang: r.n for r in real.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    chosen = F.lit(False)
    for lang, n in sorted(counts.items()):
        chosen = chosen | ((F.col("lang") == lang) & (place < int((1 << 40) * min(1.0, sample / n))))

    def grams(batches):
        for batch in batches:
            for lo, hi, data, offsets in K.texts_of(batch.column("text")):
                rows = [r.tobytes() for r in describe(data, offsets).astype(np.float16)]
                yield pa.RecordBatch.from_arrays([batch.column("lang")[lo:hi], pa.array(rows, pa.binary())], ["lang", "x"])

    rows = real.where(chosen).select("text", "lang").mapInArrow(grams, "lang string, x binary").limit(2 * sample * len(counts)).collect()
    rows.sort(key=lambda r: (r.lang, bytes(r.x)))
    x = np.stack([np.frombuffer(r.x, np.float16) for r in rows]).astype(np.float32)
    return LanguageModel.fit(x, [r.lang for r in rows])


def identify(docs: DataFrame, model: LanguageModel | None, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with two more columns: the language of each whole text and how sure it is, 0 to 1.

    Only the column text is read.  A null text or one without a letter is `und` with score 0, as is
    every text if there is no model.  All rows and columns stay; the new names
    may not be among them.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches):
        import regex
        letter = regex.compile(r"\p{L}").search
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            for lo, hi, data, offsets in K.texts_of(texts):
                langs, scores = model.predict(describe(data, offsets)) if model else ([UNDETERMINED] * (hi - lo), np.zeros(hi - lo))
                some = [x is not None and letter(x) is not None for x in texts[lo:hi].to_pylist()]
                part = batch.slice(lo, hi - lo)
                part = part.append_column(lang, pa.array([x if s else UNDETERMINED for x, s in zip(langs, some)], pa.string()))
                yield part.append_column(score, pa.array(np.where(some, scores, 0.0)))

    return docs.mapInArrow(run, schema)
