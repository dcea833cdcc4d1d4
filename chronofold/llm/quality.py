"""Quality classifier: gated attention over a text's passages, learned from document labels."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from chronofold.llm import kernels as K

#: Bytes of a passage; the last one of a text may be shorter.
PASSAGE = 1000
#: Hash places of byte pairs, next to the shares that `encode_passages` names.
PLACES = 96
SHARES = 12
WIDTH = PLACES + SHARES
#: Labelled texts of each label that the classifier is fitted on, and bytes of text of a label, in whole texts; every passage of them counts.
SAMPLE_A_LABEL, FIT_BYTES = 1500, 32 << 20
#: Width of the representation and of the attention.
HIDDEN, GATE = 16, 8
#: A text is called good from this score on.
LEAST_SCORE = 0.3

_KIND = np.full(256, 4, np.uint8)  # 0 small letter or byte beyond ASCII, 1 capital, 2 digit, 3 white space, 4 other
_KIND[97:123] = 0
_KIND[128:] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[32, *range(9, 14)]] = 3


def encode_passages(data: np.ndarray, a: int, b: int) -> np.ndarray:
    """One row for each passage of bytes a to b: shares of kinds of bytes, of repeats and of hashed byte pairs."""
    starts = list(range(a, b, PASSAGE)) or [a]
    if len(starts) > 1 and b - starts[-1] < PASSAGE // 4:
        starts.pop()
    out = np.zeros((len(starts), WIDTH), np.float32)
    for i, lo in enumerate(starts):
        x = data[lo:starts[i + 1] if i + 1 < len(starts) else b]
        n = len(x)
        if n == 0:
            continue
        kinds = _KIND[x]
        row = out[i]
        row[:5] = np.bincount(kinds, minlength=5) / n
        change = np.count_nonzero(kinds[1:] != kinds[:-1])
        row[5] = change / n
        words, _ = K.words(x, np.array([0, n]))
        w = len(words)
        if w:
            row[6] = len(np.unique(words)) / w
            row[7] = np.count_nonzero(words[1:] == words[:-1]) / w
            row[8] = min(1.0, n / w / 20)
        row[9] = np.count_nonzero(x == 10) / n * 10
        odd = kinds == 4
        row[10] = np.count_nonzero(odd[1:] & odd[:-1]) / n
        row[11] = min(1.0, n / PASSAGE)
        if n > 1:
            pair = x[:-1].astype(np.int64) * 251 + x[1:]
            h = np.sqrt(np.bincount((pair * 40503 >> 7) % PLACES, minlength=PLACES))
            row[SHARES:] = h / np.linalg.norm(h)
    return out


@dataclass
class AttentionModel:
    """h = tanh(x E); attention softmax((tanh(h V) * sigmoid(h U)) w); score sigmoid(c . sum(attention * h) + b)."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    @classmethod
    def fit(cls, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 60, rate: float = 0.02, seed: int = 3) -> AttentionModel:
        rng = np.random.default_rng(seed)
        every = np.vstack(bags)
        mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
        p = {"E": rng.normal(0, WIDTH ** -0.5, (WIDTH, HIDDEN)), "V": rng.normal(0, 0.3, (HIDDEN, GATE)), "U": rng.normal(0, 0.3, (HIDDEN, GATE)),
             "w": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, HIDDEN), "b": np.zeros(1)}
        m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
        model = cls(mean, scale, p)
        bags = [(x - mean) / scale for x in bags]
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for lo in range(0, len(order), 64):
                part = order[lo:lo + 64]
                g = model._gradient([bags[i] for i in part], labels[part])
                step += 1
                for k in p:  # Adam
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    p[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        return model

    def _forward(self, bags: list[np.ndarray]):
        x = np.vstack(bags)
        n = np.array([len(b) for b in bags])
        first, bag = np.cumsum(n) - n, np.repeat(np.arange(len(bags)), n)
        h = np.tanh(x @ self.p["E"])
        t, s = np.tanh(h @ self.p["V"]), 1 / (1 + np.exp(-(h @ self.p["U"])))
        e = (t * s) @ self.p["w"]
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        y = 1 / (1 + np.exp(-(z @ self.p["c"] + self.p["b"])))
        return x, first, bag, h, t, s, a, z, y

    def _gradient(self, bags: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x, first, bag, h, t, s, a, z, y = self._forward(bags)
        dz_ = (y - labels) / len(bags)
        dz = dz_[:, None] * p["c"]
        da = (dz[bag] * h).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, first)[bag])
        dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
        dh = a[:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T
        g = {"c": z.T @ dz_, "b": np.array([dz_.sum()]), "w": (t * s).T @ de, "V": h.T @ dt, "U": h.T @ ds, "E": x.T @ (dh * (1 - h * h))}
        return {k: v + 1e-4 * p[k] for k, v in g.items()}

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        return self._forward([(b - self.mean) / self.scale for b in bags])[-1]


def fit(labelled: DataFrame, sample: int = SAMPLE_A_LABEL, fit_bytes: int = FIT_BYTES) -> AttentionModel | float:
    """A model from (doc_id, text, quality 0/1).

    About `sample` texts of each label, chosen by a hash of doc_id before texts are joined or moved, come to the driver as
    passage rows, all passages of a text: the first in the order of the hash, twice `sample` and `fit_bytes` of text at most, one of each
    label at least.  Null labels and null texts teach nothing, repeated rows count once.  With fewer than two different labels the
    result is the constant score.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    real = labelled.where("text is not null and quality in (0, 1)").select(
        "doc_id", "text", F.col("quality").cast("int").alias("quality"), place.alias("place"), F.xxhash64("text").alias("hash"))
    counts = {r.quality: r.n for r in real.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return float(next(iter(counts), 0))
    taken, widest = F.lit(False), 0
    for label, n in sorted(counts.items()):
        mine = real.where(F.col("quality") == label)
        share = F.col("place") < int((1 << 40) * min(1.0, sample / n))
        ordered = lambda rows: rows.groupBy("place", "hash").agg(F.max(F.octet_length("text")).alias("size")).orderBy("place", "hash")
        sizes = ordered(mine.where(share)).limit(2 * sample).collect() or ordered(mine).limit(1).collect()
        total, last = 0, sizes[0]
        for r in sizes:
            total += r["size"]
            if total > fit_bytes and r is not sizes[0]:
                break
            last = r
        first = (F.col("place") < last.place) | ((F.col("place") == last.place) & (F.col("hash") <= last.hash))
        taken, widest = taken | ((F.col("quality") == label) & first), max(widest, last.place)

    def passages(batches):
        for batch in batches:
            for lo, hi, data, offsets in K.texts_of(batch.column("text")):
                rows = [encode_passages(data, a, b).tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[lo:hi] for c in ("place", "hash", "quality")), pa.array(rows, pa.binary())],
                                                 ["place", "hash", "quality", "x"])

    # A bound on doc_id alone goes below a join of texts and labels, to both sides.
    rows = real.where(F.col("place") <= widest).where(taken).select("place", "hash", "text", "quality").mapInArrow(passages, "place long, hash long, quality int, x binary")
    rows = rows.dropDuplicates(["place", "hash", "quality"]).collect()
    rows.sort(key=lambda r: (r.quality, r.place, r.hash))
    return AttentionModel.fit([np.frombuffer(r.x, np.float32).reshape(-1, WIDTH).astype(float) for r in rows],
                              np.array([r.quality for r in rows], float))


def score(docs: DataFrame, model: AttentionModel | float, name: str = "score") -> DataFrame:
    """docs with one more column: the score of each whole text, 0 to 1, higher when label 1 is likelier.

    Only the column text is read; every passage of it counts.  A null text is scored as an empty one.  All rows and columns
    stay; the new name may not be among them.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            for lo, hi, data, offsets in K.texts_of(column):
                if isinstance(model, float):
                    scores = np.full(hi - lo, model)
                else:
                    scores = model.score([encode_passages(data, a, b) for a, b in zip(offsets[:-1], offsets[1:])])
                yield batch.slice(lo, hi - lo).append_column(name, pa.array(scores))

    return docs.mapInArrow(run, schema)
