"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces come from a public model file, whose path is a parameter. A unigram model's scores are used as they are. A
model of the merge kind has ranks instead of log scores; its piece of rank r gets the log probability of Zipf's law,
log(1 / (r + 2)) less the log of the sum over all pieces.

The text gets a leading space, and each space becomes the marker U+2581. Of all ways to write it as pieces, the one with
the greatest sum of scores is taken (the longer last piece among equals). A character that is no piece, and a marker that the text itself
holds, is written as one byte piece for each of its UTF-8 bytes, at a score 10 below the least. Decoding joins the
pieces, reads bytes as UTF-8, turns markers into spaces and drops the first one. Encoding then decoding gives every
text back exactly.

A piece has the marker at its start or not at all, so a text falls into units (spaces with the word after them) that
can be encoded on their own; a worker keeps the units it has seen, up to a bound. Line feeds are units too where no
piece holds one.

Null texts have null ids; empty texts have none. Repeated rows are encoded alike; extra columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
#: Units that a worker remembers, and the longest of them.
REMEMBER, LONGEST = 500_000, 48


@dataclass
class Vocabulary:
    """Pieces with log scores. byte_ids: the piece of each byte."""

    pieces: list[str]
    scores: list[float]
    normal: list[int]
    byte_ids: list[int]
    unk: float = field(init=False)

    def __post_init__(self):
        self.unk = min((self.scores[i] for i in self.normal), default=0.0) - 10.0


def load(path: str) -> Vocabulary:
    """The vocabulary of a model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    scores = [sp.get_score(i) for i in range(n)]
    ranks = sorted(-scores[i] for i in normal if scores[i] > -1e8)
    if ranks and all(r == int(r) for r in ranks) and ranks[-1] > 1000:  # whole numbers in steps: ranks of merges
        whole = np.log(sum(1 / (r + 2) for r in ranks))
        last = ranks[-1]
        scores = [-float(np.log(min(-s, last) + 2) + whole) for s in scores]
    return Vocabulary(pieces, scores, normal, byte_ids)


class DoubleArray:
    """A trie over byte strings: from node s, byte c leads to base[s] + c + 1 if check of that is s; value: the piece's id."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        keys = sorted(keys)
        size = 1 << 16
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        self.check[0] = 0
        low = 1  # cells below are taken
        todo = [(0, 0, len(keys), 0)]
        while todo:
            node, lo, hi, depth = todo.pop()
            if lo < hi and len(keys[lo][0]) == depth:
                self.value[node] = keys[lo][1]
                lo += 1
            starts: list[tuple[int, int]] = []
            for i in range(lo, hi):
                c = keys[i][0][depth]
                if not starts or starts[-1][0] != c:
                    starts.append((c, i))
            if not starts:
                continue
            first = starts[0][0] + 1
            while self.check[low] >= 0:
                low += 1
                if low + 300 > len(self.check):
                    self._grow()
            at = max(low, first)
            tries = 0
            while True:
                if at + 300 > len(self.check):
                    self._grow()
                b = at - first
                if self.check[at] < 0 and all(self.check[b + c + 1] < 0 for c, _ in starts):
                    break
                at += 1
                tries += 1
                if tries > 2000 and at - low > 4000:
                    low = at  # crowded: leave the few holes below
                    tries = 0
            self.base[node] = b
            for k, (c, i) in enumerate(starts):
                self.check[b + c + 1] = node
                todo.append((b + c + 1, i, starts[k + 1][1] if k + 1 < len(starts) else hi, depth + 1))

    def _grow(self) -> None:
        n = len(self.check)
        self.base += [0] * n
        self.check += [-1] * n
        self.value += [-1] * n

    def find(self, key: bytes) -> int:
        """The key's id, or -1."""
        node = 0
        for c in key:
            to = self.base[node] + c + 1
            if self.check[to] != node:
                return -1
            node = to
        return self.value[node]


class Codec:
    """Encodes and decodes texts with a vocabulary."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.trie = DoubleArray([(vocab.pieces[i].encode(), i) for i in vocab.normal])
        whole = "".join(vocab.pieces[i] for i in vocab.normal)
        if any(MARK in vocab.pieces[i].lstrip(MARK) for i in vocab.normal):
            raise ValueError("a piece holds the marker after another character")
        self.units = re.compile(r" *[^ ]+| +" if "\n" in whole else r"\n| *[^ \n]+| +")
        self.byte_of = {i: b for b, i in enumerate(vocab.byte_ids)}
        self.seen: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.__dict__ | {"seen": {}}

    def viterbi(self, text: str) -> tuple[int, ...]:
        """Best pieces of a text whose spaces still are spaces; markers of the text itself go to bytes."""
        raw = text.replace(MARK, "\0\0\0").replace(" ", MARK).encode("utf-8", "surrogatepass")
        own = {i for i in range(len(raw)) if raw[i] == 0} if MARK in text else ()
        n, scores, unk = len(raw), self.vocab.scores, self.vocab.unk
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        never = float("-inf")
        best = [never] * (n + 1)
        begin_of, piece_of = [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        at = 0
        while at < n:
            here, lead = best[at], raw[at]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            if here > never:
                single, node, end = False, 0, at
                if at in own:
                    end = n
                while end < n:
                    to = base[node] + raw[end] + 1
                    if check[to] != node:
                        break
                    node, end = to, end + 1
                    piece = value[node]
                    if piece >= 0:
                        if end - at == width:
                            single = True
                        s = here + scores[piece]
                        if s > best[end]:
                            best[end], begin_of[end], piece_of[end] = s, at, piece
                if not single:
                    s, end = here + unk, at + width
                    if s > best[end]:
                        best[end], begin_of[end], piece_of[end] = s, at, -1
            at += width
        out: list[int] = []
        at = n
        if own:
            real = text.replace(" ", MARK).encode("utf-8", "surrogatepass")
        else:
            real = raw
        while at > 0:
            begin, i = begin_of[at], piece_of[at]
            if i >= 0:
                out.append(i)
            else:
                out.extend(self.vocab.byte_ids[b] for b in reversed(real[begin:at]))
            at = begin
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        seen = self.seen
        for unit in self.units.findall(" " + text):
            ids = seen.get(unit)
            if ids is None:
                ids = self.viterbi(unit)
                if len(unit) <= LONGEST:
                    if len(seen) >= REMEMBER:
                        seen.clear()
                    seen[unit] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        parts: list[str] = []
        held = bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                held.append(b)
                continue
            if held:
                parts.append(held.decode("utf-8", "surrogatepass"))
                held.clear()
            parts.append(self.vocab.pieces[i].replace(MARK, " "))
        if held:
            parts.append(held.decode("utf-8", "surrogatepass"))
        return "".join(parts)[1:]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """docs with piece_ids and piece_text (the text as decoded from them); columns of those names are replaced.

    The vocabulary goes to the executors as a broadcast value; its size is that of the model file.
    """
    codec = docs.sparkSession.sparkContext.broadcast(Codec(load(path or default_path())))
    kept = docs.drop("piece_ids", "piece_text")
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids: list[np.ndarray | None] = []
                texts: list[str | None] = []
                for value in part.column(at):
                    text = value.as_py()
                    found = None if text is None else coder.encode(text)
                    ids.append(None if found is None else np.asarray(found, np.int32))
                    texts.append(None if found is None else coder.decode(found))
                arrays = [*part.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names, "piece_ids", "piece_text"])

    new = [T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("piece_text", T.StringType())]
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *new]))


def query(spark, sf_dir: str) -> DataFrame:
    """Pieces of every whole text: how many, a digest of their ids, and whether they decode to the text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs).select(
        "doc_id",
        F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"),
        F.sha2(F.array_join(F.transform("piece_ids", lambda i: i.cast("string")), " "), 256).alias("ids_sha256"),
        F.sha2(F.coalesce("piece_text", F.lit("")), 256).alias("decoded_sha256"),
        F.col("piece_text").eqNullSafe(F.col("text")).alias("round_trip"),
    )
