"""Byte-level BPE: whole texts to ids and back; long unsplit text by tree concatenation."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from chronofold.llm import kernels as K

#: A run of this many characters without white space, or of white space alone, is long unsplit text.
LONG = 4096
#: Characters of a leaf of the tree.
LEAF = 1024
#: Tokens on each side of a join that are encoded anew at first.
WINDOW = 8
#: Words whose tokens a task remembers.
REMEMBERED = 200_000

# Fixed values of byte-level BPE: the characters that stand for bytes.
PLAIN_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: chr(b) for b in PLAIN_BYTES} | {
    b: chr(0x100 + i) for i, b in enumerate(x for x in range(256) if x not in set(PLAIN_BYTES))}

#: The same splits for texts of these characters alone, without tables of letters; other texts are
#: left to the library, whose tables may be of another Unicode version.
LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
COMMON = "[\t\n\r\x20-\x7e\u00a0-\u017f\u2010-\u2027\u2030-\u205e]*"
COMMON_PATTERN = ("'s|'t|'re|'ve|'m|'ll|'d| ?[" + LETTERS + "]+| ?[0-9\u00b2\u00b3\u00b9\u00bc-\u00be]+"
                  "| ?[^\\s" + LETTERS + "0-9\u00b2\u00b3\u00b9\u00bc-\u00be]+|\\s+(?!\\S)|\\s+")


def byte_string(text: str) -> str:
    return "".join(map(BYTE_CHARS.__getitem__, text.encode("utf-8")))


#: What is made of encoded batches: its schema and the function.
Step = tuple[T.StructType, Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]]


class Codec:
    """One tokenizer in one task."""

    def __init__(self, path: str | bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_buffer(path) if isinstance(path, bytes) else Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.split = re.compile(COMMON_PATTERN).findall
        self.common = re.compile(COMMON).fullmatch
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.words: dict[str, bytes] = {}

    def learn(self, words: Iterable[str]) -> None:
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > REMEMBERED:
            self.words.clear()
            new = list(words)
        for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            self.words[w] = np.array(e.ids, np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text.  A word's ids do not depend on what stands around it, so each word is encoded once."""
        cut = [self.split(t) if self.common(t) and not any(s in t for s in self.special) else None for t in texts]
        need = set().union(*(c for c in cut if c is not None))
        self.learn(need)
        get = self.words.__getitem__
        return [np.frombuffer(b"".join(map(get, c)), np.int32) if c is not None
                else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int32) for c, t in zip(cut, texts)]

    def merge(self, chars: str) -> list[int]:
        """Ids of text that is not split: bytes as characters, merged from end to end."""
        return [t.id for t in self.tokenizer.model.tokenize(chars)] if chars else []

    def chars(self, ids: list[int]) -> str:
        return "".join(map(self.tokenizer.id_to_token, ids))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of two unsplit neighbours from their own: growing windows are
        encoded anew until their outermost tokens are those of both sides.

        Neighbouring tokens that stay as they are when the two are encoded
        together show that the whole is encoded right; inside a side that held before.
        """
        w = WINDOW
        while True:
            a, b = left[-w:], right[:w]
            anew = self.merge(self.chars(a) + self.chars(b))
            if (len(a) == len(left) or anew[:1] == a[:1]) and (len(b) == len(right) or anew[-1:] == b[-1:]):
                return left[:len(left) - len(a)] + anew + right[len(b):]
            w *= 2

    def tree(self, parts: list[list[int]]) -> list[int]:
        while len(parts) > 1:
            parts = [self.join(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def segments(self, text: str) -> Iterable[tuple[str, bool]]:
        """(text, unsplit): the text in order; unsplit pieces are single words of LEAF characters or more."""
        plain: list[str] = []
        for run in re.split("(" + "|".join(map(re.escape, self.special)) + ")", text) if self.special else [text]:
            if run in self.special:
                plain.append(run)
                continue
            for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(run) if not self.common(run) else ((w, None) for w in self.split(run)):
                known = self.common(run)
                if len(word) < LEAF:
                    plain.append(word if known else bytes(CHAR_BYTES[c] for c in word).decode("utf-8"))
                    continue
                if plain:
                    yield "".join(plain), False
                    plain = []
                yield byte_string(word) if known else word, True
        if plain:
            yield "".join(plain), False


CHAR_BYTES = {c: b for b, c in BYTE_CHARS.items()}


def halves(chars: str) -> list[str]:
    """The leaves of the tree over an unsplit piece, in order."""
    if len(chars) <= LEAF:
        return [chars]
    middle = len(chars) // 2
    return halves(chars[:middle]) + halves(chars[middle:])


def _is_long(column: str):
    return F.coalesce((F.length(column) >= LONG) & F.col(column).rlike(rf"(?<!\S)\S{{{LONG}}}|(?<!\s)\s{{{LONG}}}"), F.lit(False))


def _slices(column: pa.Array):
    at = 0
    texts = column.to_pylist()
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size < K.SLICE_BYTES:
            size += len(texts[end] or "")
            end += 1
        yield at, end, [t or "" for t in texts[at:end]]
        at = end


def _lists(ids: list[np.ndarray]) -> pa.Array:
    return K.lists(np.concatenate(ids) if ids else np.zeros(0, np.int32), np.array([len(x) for x in ids], np.int64))


def encode(docs: DataFrame, tokenizer: str | bytes, then: Step | None = None) -> DataFrame:
    """(doc_id, ids array<int>): the ids of each whole text, as the tokenizers library gives them.

    docs: doc_id (any type, null too), text; null is empty.  tokenizer: path of a byte-level BPE
    file of that library, which every executor can read, or its content as
    bytes.  Special tokens in a text are taken as such; none is added.
    Rows stay rows: repeated ones are encoded alike.  An empty table gives none.

    Texts with a run of 4096 characters that may hold no split go another way to the
    same ids: their unsplit pieces are halved to leaves, the leaves of all
    texts are dealt out and encoded in parallel, and the leaves of a text are
    joined pair by pair.

    then: (schema, function) of Arrow batches of doc_id and ids; its batches are returned
    instead, made in the same Python worker.
    """
    key = docs.schema["doc_id"]
    docs = docs.select("doc_id", "text")

    def whole(batches):
        codec = Codec(tokenizer)
        for batch in batches:
            for lo, hi, texts in _slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], _lists(codec.encode(texts))], ["doc_id", "ids"])

    schema = T.StructType([key, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    last, step = (schema, None) if then is None else then
    plain = docs.where(~_is_long("text")).mapInArrow(whole if step is None else lambda batches: step(whole(batches)), last)

    long = docs.where(_is_long("text")).withColumn("h", F.sha2("text", 256))

    def leaves(batches):
        codec = Codec(tokenizer)
        for batch in batches:
            for h, text in zip(batch.column("h"), batch.column("text")):
                rows = [(h.as_py(), n, m, unsplit, leaf) for n, (piece, unsplit) in enumerate(codec.segments(text.as_py()))
                        for m, leaf in enumerate(halves(piece) if unsplit else [piece])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["h", "piece", "leaf", "unsplit", "part"])

    def leaf_ids(batches):
        codec = Codec(tokenizer)
        for batch in batches:
            ids = [np.array(codec.merge(p) if u else codec.encode([p])[0], np.int32)
                   for u, p in zip(batch.column("unsplit").to_pylist(), batch.column("part").to_pylist())]
            yield batch.drop_columns(["part"]).append_column("ids", _lists(ids))

    def joined(key, group):
        codec = Codec(tokenizer)
        group = group.sort_values(["piece", "leaf"])
        ids = []
        for _, piece in group.groupby("piece", sort=True):
            parts = [list(map(int, x)) for x in piece["ids"]]
            ids += codec.tree(parts) if bool(piece["unsplit"].iloc[0]) else parts[0]
        import pandas as pd
        return pd.DataFrame({"h": [key[0]], "ids": [ids]})

    parts = (long.select("h", "text").dropDuplicates(["h"])
             .mapInArrow(leaves, "h string, piece long, leaf long, unsplit boolean, part string"))
    encoded = (parts.repartition("h", "piece", "leaf")
               .mapInArrow(leaf_ids, "h string, piece long, leaf long, unsplit boolean, ids array<int>")
               .groupBy("h").applyInPandas(joined, "h string, ids array<int>"))
    rest = long.select("doc_id", "h").join(encoded, "h").select("doc_id", "ids")
    return plain.unionAll(rest if step is None else rest.mapInArrow(step, last))


class Strings:
    """A byte string for each id; those of many ids are gathered at once."""

    def __init__(self, strings: list[bytes]) -> None:
        self.lengths = np.array([len(s) for s in strings], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def of(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids) or not ends[-1]:
            return b""
        return self.data[np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(ends[-1])].tobytes()


def token_bytes(tokenizer: str | bytes) -> Strings:
    codec = Codec(tokenizer)
    table = [b""] * codec.tokenizer.get_vocab_size(with_added_tokens=True)
    for token, i in codec.tokenizer.get_vocab(with_added_tokens=True).items():
        table[i] = token.encode("utf-8") if token in codec.special else bytes(CHAR_BYTES[c] for c in token)
    return Strings(table)


def decode(encoded: DataFrame, tokenizer: str | bytes) -> DataFrame:
    """encoded (with ids array<int>) with the column text: the decoded ids, special tokens included.

    Bytes that are no UTF-8 become U+FFFD; null ids give null.
    """
    schema = T.StructType([*encoded.schema.fields, T.StructField("text", T.StringType())])

    def run(batches):
        table = token_bytes(tokenizer)
        for batch in batches:
            column = batch.column("ids")
            flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
            texts = [table.of(flat[a:b]).decode("utf-8", "replace") if ok else None
                     for a, b, ok in zip(ends[:-1], ends[1:], column.is_valid().to_pylist())]
            yield batch.append_column("text", pa.array(texts, pa.string()))

    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, tokenizer: str | bytes) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids in decimal, joined by commas), decoded_sha256 of encode() and decode() of the texts."""
    def run(batches):
        from hashlib import sha256
        table = token_bytes(tokenizer)
        numbers = Strings([b"%d," % i for i in range(len(table.lengths))])
        for batch in batches:
            column = batch.column("ids")
            flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
            ids = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
            marks = [sha256(numbers.of(x)[:-1]).hexdigest() for x in ids]
            texts = [sha256(table.of(x).decode("utf-8", "replace").encode("utf-8")).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), pa.array(marks, pa.string()),
                                              pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                           T.StructField("decoded_sha256", T.StringType())])
    return encode(docs, tokenizer, (schema, run))
