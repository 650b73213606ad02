"""Harmonic packing of tokenised documents into fixed-capacity training sequences.

Classes are reciprocal in the capacity C: class k takes lengths in (C/(k+1), C/k], and each of its bins takes
exactly k of them, so a worker fills the bins of a class without a look at any other class or worker. Documents
may be cut freely: a document gives up whole sequences (class 1), and its tail of fewer than C tokens goes to the
class of its length. A bin that has its k tails still lacks up to C/(k+1) tokens or so; the next document of the
worker begins there, so the sequence is full. What a worker still holds when its input ends is filled up
in the same way, and its very last tokens, fewer than C, are cut at powers of two, which need no padding.

The job is one narrow stage: scan, tokenise, cut, pack. Nothing is shuffled, and a lost task is run again
over the same split, which gives the same sequences under the same ids.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release_memory

CAPACITY = 1024
END_ID = 0
#: Fixed value: how a byte-level tokenizer parts a text.
BYTE_LEVEL_WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters tokenised at once, which bounds the memory of a worker besides its Arrow batch.
GROUP_CHARS = 1 << 19

#: Where the ids of a text may be taken apart: before a space or line feed that stands alone.
_BREAK = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Code points whose regular-expression classes no Unicode version has changed.
_SETTLED = re.compile("[\\t\\n\\r -~\u00a1-\u024f]*")
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, exactly as the tokenizer file gives them.

    A byte-level BPE never merges across a space or a line feed that stands alone between two visible
    characters, so a text's ids are those of the runs between such places in a row. Where `same_merges` proves
    that the vocabulary alone gives the same merges, runs of settled code points go through the ranks of that
    vocabulary (tiktoken, several times as fast); all others, and all of any other tokenizer, go through the
    tokenizer itself."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ranked = same_merges(path, self.tokenizer)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or r"(?!)")

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _settled(self, text: str) -> bool:
        return bool(_SETTLED.fullmatch(text)) and not self.added.search(text)

    def _runs(self, text: str) -> Iterator[tuple[bool, str]]:
        """(settled, run) in order; runs of settled words have about GROUP_CHARS characters at most."""
        if len(text) <= GROUP_CHARS and self._settled(text):
            yield True, text
            return
        at, end, settled = 0, 0, True
        for m in chain(_BREAK.finditer(text), [None]):
            stop = m.start() if m else len(text)
            same = self._settled(text[end:stop])
            if end > at and (same != settled or end - at >= GROUP_CHARS):
                yield settled, text[at:end]
                at = end
            settled, end = same, stop
        yield settled, text[at:end]

    def encode(self, text: str) -> bytes:
        if not self.ranked:
            return self._whole(text)
        return b"".join(array("I", self.ranked(t)).tobytes() if settled else self._whole(t) for settled, t in self._runs(text))

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()


def same_merges(path: str, tokenizer) -> Callable[[str], list[int]] | None:
    """An encoder of plain text by ranks alone that gives the tokenizer's ids, or None if that is not certain.

    Ranks merge any neighbours whose join is a token, merges only the listed pairs. While a token's borders
    stand, merges inside them run as if it stood alone, and alone it ends in the pair that its own merge lists;
    so the two agree if ids rise with the merges and the tokenizer makes each token's text into that token."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space"):
        return None
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    vocabulary = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocabulary[a + b] for a, b in pairs]
    single = sorted(i for t, i in vocabulary.items() if len(t) == 1)
    bpe = tokenizer.model
    if single + made != list(range(len(vocabulary))) or any(len(bpe.tokenize(t)) != 1 for t in vocabulary):
        return None
    shown = byte_alphabet()
    ranks = {bytes(shown[c] for c in t): i for t, i in vocabulary.items()}
    return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary shows: printable Latin-1 shows itself, the other
    bytes in order are shown by the code points from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class HarmonicBins:
    """The bins of one worker: at most one open bin for each reciprocal class, and those that lack a filling."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {}
        self.filling: list[list] = []  # [tokens it lacks, pieces]

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        at, out = 0, []
        total = sum(p[2] for p in pieces)
        for p in pieces:
            out.append((*p, self.next_id, at, total))
            at += p[2]
        self.next_id += 1
        return out

    def add(self, doc, body: bytes) -> list[tuple]:
        """Cut a document's ids into pieces (doc, start, length, ids, doc_tokens); return the sequences it closes."""
        out, at, total = [], 0, len(body) // 4
        piece = lambda n: (doc, at, n, body[4 * at : 4 * (at + n)], total)
        while self.filling and at < total:
            lack, pieces = self.filling[-1]
            n = min(lack, total - at)
            pieces.append(piece(n))
            at += n
            self.filling[-1][0] -= n
            if n == lack:
                out += self._close(self.filling.pop()[1])
        while total - at >= self.capacity:
            out += self._close([piece(self.capacity)])
            at += self.capacity
        if at < total:
            k = self.capacity // (total - at)
            held = self.open.setdefault(k, [])
            held.append(piece(total - at))
            if len(held) == k:
                del self.open[k]
                lack = self.capacity - sum(p[2] for p in held)
                if lack:
                    self.filling.append([lack, held])
                else:
                    out += self._close(held)
        return out

    def finish(self) -> list[tuple]:
        """Fill sequences with what is left, less than one bin of each class, and cut the last at powers of two."""
        rest = [p for _, held in self.filling for p in held] + [p for held in self.open.values() for p in held]
        left = sum(p[2] for p in rest)
        sizes = [self.capacity] * (left // self.capacity)
        sizes += [1 << b for b in range((left % self.capacity).bit_length() - 1, -1, -1) if left % self.capacity >> b & 1]
        out, pieces, room = [], [], iter(sizes)
        lack = next(room, 0)
        for doc, start, length, ids, total in rest:
            at = 0
            while at < length:
                n = min(lack, length - at)
                pieces.append((doc, start + at, n, ids[4 * at : 4 * (at + n)], total))
                at, lack = at + n, lack - n
                if not lack:
                    out += self._close(pieces)
                    pieces, lack = [], next(room, 0)
        self.open.clear()
        self.filling.clear()
        return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise, cut and pack `docs`; a row for each piece:

    <id_col>, start (tokens of its document before it), length, ids (binary: little-endian unsigned 32-bit
    token ids), doc_tokens (of the document, closing id included), sequence_id, offset (in the sequence,
    gapless from 0), sequence_length.

    Null and empty texts are documents of the closing id alone. Null and repeated ids are kept as they are:
    every row is a document of its own. Very long texts are cut into many sequences. An empty table gives no
    rows; further columns of `docs` are not read."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type)] + [T.StructField(n, t) for n, t in (("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()), ("sequence_length", T.LongType()))])
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer_path)
        bins = HarmonicBins(capacity, TaskContext.get().partitionId() << 32)
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            order = (0, 1, 2, 3, 4, 5, 6, 7)
            out = pa.RecordBatch.from_arrays([pa.array(cols[i], type=t) for i, t in zip(order, arrow, strict=True)], names=[f.name for f in schema])
            rows.clear()
            return out

        arrow = None
        for batch in batches:
            if arrow is None:
                arrow = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = encoder.encode(text.as_py() or "") + end
                rows += bins.add(doc, body)
                if len(rows) >= 4096:
                    yield flush()
        rows += bins.finish()
        if rows:
            yield flush()
        release_memory()

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def padding(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, tokens, pads (to the capacity, none where the length is a power of two)."""
    one = pieces.filter(F.col("offset") == 0).select("sequence_length")
    pads = F.when(F.expr("sequence_length & (sequence_length - 1)") == 0, 0).otherwise(F.lit(capacity) - F.col("sequence_length"))
    return one.agg(F.count("*").alias("sequences"), F.sum("sequence_length").alias("tokens"), F.sum(pads).alias("pads"))
