"""Benchmark decontamination: pigeonhole pieces, exact hits, Myers bit-parallel distance."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Errors allowed for each character of an item.
ERROR_RATE = 0.08
#: Items shorter than this in normal form must be the whole document.
LEAST = 16
#: Bytes of items in one automaton; a larger benchmark is searched in several blocks.
BLOCK_BYTES = 4 << 20

#: Letters of the runs that are counted before a distance is computed.
GRAM = 4

_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[:128] = [c if chr(c).isalnum() else 0x20 for c in range(128)]


def normal(text: str) -> str:
    """Small letters; runs of ASCII characters other than letters and digits are one space.

    One character of the result is one byte of UTF-8 (read as Latin-1), so that
    positions and distances are counted in bytes.
    """
    data = _TABLE[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)]
    keep = data != 0x20
    if len(data):
        keep[1:] |= data[:-1] != 0x20
    return data[keep].tobytes().decode("latin-1").strip(" ")


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces of nearly equal length; budget edits leave one of them whole."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def letter_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def nearest(masks: dict[str, int], m: int, window: str) -> int:
    """Smallest edit distance of the item to any part of the window (Myers, one machine word of any length)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = score
    for c in window:
        eq = masks.get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(across | plus)
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best = score
        up, down = up << 1, down << 1
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical & full
    return best


class Searcher:
    """All items of one block, searched for in a text at once."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        self.items, self.whole = {}, {}
        self.automaton = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = normal(text)
            if len(text) < LEAST:
                if text:
                    self.whole.setdefault(text, set()).add(item_id)
                continue
            budget = int(len(text) * rate)
            number = len(self.items)
            grams = {text[i:i + GRAM] for i in range(len(text) - GRAM + 1)}
            self.items[number] = (item_id, text, budget, letter_masks(text), grams)
            for offset, piece in pieces(text, budget):
                at.setdefault(piece, []).append((number, offset))
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        if at:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, int]:
        """Distance of each item within its budget of some part of the text."""
        text = normal(text)
        found = dict.fromkeys(self.whole.get(text, ()), 0)
        if not self.items or not text:
            return found
        windows: dict[int, list[list[int]]] = {}
        for end, (length, places) in self.automaton.iter(text):
            for number, offset in places:
                _, item, budget, _, _ = self.items[number]
                lo = end + 1 - length - offset - budget
                hi = lo + len(item) + 2 * budget
                spans = windows.setdefault(number, [])
                if spans and lo <= spans[-1][1]:  # hits come in order of their ends, so spans may start a little earlier
                    spans[-1][0] = min(lo, spans[-1][0])
                    spans[-1][1] = max(hi, spans[-1][1])
                else:
                    spans.append([lo, hi])
        for number, spans in windows.items():
            item_id, item, budget, masks, grams = self.items[number]
            best = budget + 1
            for lo, hi in spans:
                window = text[max(0, lo):hi]
                if item in window:
                    best = 0
                    break
                # An edit spoils GRAM runs at most; a window with fewer of the item's runs is out of reach.
                if sum(window[i:i + GRAM] in grams for i in range(len(window) - GRAM + 1)) > len(item) - GRAM - budget * GRAM:
                    best = min(best, nearest(masks, len(item), window))
            if best <= budget:
                found[item_id] = min(best, found.get(item_id, best))
        return found


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, some megabytes at a time; each block is bounded, their number grows with the benchmark."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    for b in range(n):
        yield [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).toLocalIterator()]


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """(doc_id, item_id, distance): the benchmark items that stand in each document.

    docs: doc_id, text; benchmark: item_id, text.  Both texts are compared in normal form:
    small letters, ASCII punctuation and white space as one space.  An item of m
    bytes is found when some part of the document is within floor(rate * m)
    edits of it; distance is the smallest.  An item shorter than 16 must be the whole
    document.  Null or empty texts match nothing, nor do items with a null id;
    a document's repeated rows give repeated results, repeated item ids give the
    smallest distance.  Rows with a null doc_id are searched as well.  Empty tables give no rows.
    """
    out = None
    kind = docs.select(F.col("doc_id").alias("doc_id")).schema
    schema = T.StructType([kind["doc_id"], T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType())])
    for block in _blocks(benchmark):
        def search(batches, block=block):
            searcher = Searcher(block, rate)
            for batch in batches:
                ids, items, distances = [], [], []
                for i, text in enumerate(batch.column("text")):
                    text = text.as_py()
                    for item, d in searcher.find(text).items() if text else ():
                        ids.append(i)
                        items.append(item)
                        distances.append(d)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(items, pa.int64()),
                                                  pa.array(distances, pa.int32())], ["doc_id", "item_id", "distance"])
        found = docs.select("doc_id", "text").mapInArrow(search, schema)
        out = found if out is None else out.unionAll(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """docs without the documents in which a benchmark item stands; see contaminated()."""
    for block in _blocks(benchmark):
        def clean(batches, block=block):
            searcher = Searcher(block, rate)
            for batch in batches:
                texts = (x.as_py() for x in batch.column("text"))
                yield batch.filter(pa.array([not (t and searcher.find(t)) for t in texts], pa.bool_()))
        docs = docs.mapInArrow(clean, docs.schema)
    return docs
