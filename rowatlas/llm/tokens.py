"""Token-ID output: ORC files of integer run-length stripes with indexes and Bloom filters.

Documents are dealt by ranges of the id and sorted, so files, stripes and row groups
hold disjoint id ranges: their statistics prune range reads, the Bloom filters on
``doc_id`` prune point reads, and any number of tasks can read stripes side by side.
Each row carries its place inside its segment (one write task); a table with one
row per segment then turns places into offsets over all documents.

Defined cases: a null text is empty; an empty text is the end id alone; a null
doc_id sorts first; rows that share a doc_id are ordered by a hash of
their text; an empty table writes no segment; added tokens of the tokenizer that stand in a text are what the
tokenizer makes of them; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowatlas.llm import scratch

#: Written files whose offsets are broadcast at most (12 bytes each).
BROADCAST_SEGMENTS = 1_000_000
#: Bytes of text that are encoded at once (a longer text goes alone), and words that a worker keeps: beyond, its
#: words are forgotten and learned again, never the data.
SLICE_BYTES, KEPT_WORDS = 2 << 20, 300_000
#: Texts that are encoded whole: empty ones, and those where white space is more than one space or line feed between two words.
_UNEVEN = r"^$|^[ \n]|[ \n]$|[ \n][ \n]|[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Letters of every version of Unicode, and the ASCII characters that are neither letter, digit nor white space.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_FIRST, _END = "\r", "\t"


def _byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Encoder:
    """Exact ``encode(..., add_special_tokens=False)`` of a byte-level BPE tokenizer, by distinct words.

    The pre-tokenizer never joins characters over a single space or line feed between two
    words, so a slice of texts is cut into words in Arrow and each distinct word is encoded once,
    with the white space before it. A word of letters with marks behind is two pieces of the
    pre-tokenizer: its letters go straight to the tokenizer's model and are kept, whatever marks follow. Other
    words are encoded many in one call. Texts with other white space or with an added token of the
    tokenizer are encoded whole, and so is everything if the tokenizer is of another kind.
    """

    def __init__(self, path: str, end_id: int = 0, kept: int = KEPT_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.kept = Tokenizer.from_file(path), end_id, kept
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_words = self._splits_at_spaces()
        if self.by_words:
            self.letters, self.model = _byte_letters(), self.tokenizer.model
            (self.newline,) = self._whole(["\n"])[0]
            self._forget()

    def _splits_at_spaces(self) -> bool:
        said = json.loads(self.tokenizer.to_str())
        cut, model = said.get("pre_tokenizer") or {}, said["model"]
        plain = not any(said.get(k) for k in ("normalizer", "truncation", "padding")) and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        bytes_ = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        return bool(plain and bytes_ and model.get("type") == "BPE" and not any(re.search(r"\s", t) for t in self.added))

    def _forget(self) -> None:
        """Start over: number 0 is nothing, then the end id, then each single mark."""
        self.known: dict[str, int] = {"": 0, _END: 1}
        self.ids, self.ends = array("i", [self.end_id]), array("q", [0, 1])
        self.mark = np.zeros(256, np.int64)
        for m in _MARKS:
            self.mark[ord(m)] = self._learn(_END + m, self._piece(m))

    def _learn(self, key: str, ids: list[int]) -> int:
        self.known[key] = number = len(self.ends)
        self.ids.extend(ids)
        self.ends.append(len(self.ids))
        return number

    def _piece(self, piece: str) -> list[int]:
        """Ids of one piece of the pre-tokenizer."""
        if piece.isascii():
            return [t.id for t in self.model.tokenize(piece.replace(" ", self.letters[32]))]
        return [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, piece.encode())))]

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _numbers(self, words: list[str], of_letters: bool) -> np.ndarray:
        """The number of each word; unknown ones are learned. A word stands behind a space, or behind its line feed, or (_FIRST) behind nothing."""
        out = np.fromiter((self.known.get(w, -1) for w in words), np.int64, len(words))
        fresh = np.flatnonzero(out < 0).tolist()
        if of_letters:
            for k in fresh:
                w = words[k]
                ids = self._piece(w[1:] if w[0] == _FIRST else w[1:] if w[0] == "\n" else " " + w)
                out[k] = self._learn(w, [self.newline, *ids] if w[0] == "\n" else ids)
            return out
        for at in range(0, len(fresh), 500):  # as lines of one text
            part = [words[k] for k in fresh[at : at + 500]]
            ids = self._whole(["\n".join(w[1:] if w[0] in ("\n", _FIRST) else " " + w for w in part)])[0]
            cuts = [-1, *(k for k, x in enumerate(ids) if x == self.newline), len(ids)]
            if len(cuts) != len(part) + 1:
                raise ValueError("the vocabulary joins line feeds to words")
            for k, w, a, b in zip(fresh[at:], part, cuts, cuts[1:], strict=False):
                out[k] = self._learn(w, [self.newline] * (w[0] == "\n") + ids[a + 1 : b])
        return out

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the numbered words, and how many each has."""
        ids, ends = np.frombuffer(self.ids, np.int32), np.frombuffer(self.ends, np.int64)
        return _picked(ids, ends[numbers - (numbers > 0)], np.where(numbers > 0, ends[numbers] - ends[numbers - (numbers > 0)], 0))

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.kept:
            self._forget()
        marked = pc.binary_join_element_wise(_FIRST, pc.replace_substring(texts, "\n", " \n"), " " + _END, "")
        cut = pc.split_pattern(marked, " ")
        coded = cut.flatten().dictionary_encode()
        words, places = coded.dictionary, coded.indices.to_numpy()
        stem = pc.utf8_rtrim(words, _MARKS)
        tail = pc.subtract(pc.binary_length(words), pc.binary_length(stem)).to_numpy()
        stems = stem.dictionary_encode()
        lettered = pc.match_substring_regex(stems.dictionary, f"^[\\r\\n]?[{_LETTERS}]+$").to_numpy(zero_copy_only=False)
        of_stem = np.zeros(len(stems.dictionary), np.int64)
        of_stem[lettered] = self._numbers(_strings(stems.dictionary.filter(pa.array(lettered))), True)
        at = stems.indices.to_numpy()
        number, behind, plain = of_stem[at], np.zeros(len(words), np.int64), lettered[at]
        number[~plain] = self._numbers(_strings(words.filter(pa.array(~plain))), False)
        ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset + 1 : words.offset + 1 + len(words)]
        one = plain & (tail == 1)
        behind[one] = self.mark[np.frombuffer(words.buffers()[2], np.uint8)[ends[one] - 1]]
        more = np.flatnonzero(plain & (tail > 1))
        for k, w in zip(more.tolist(), _strings(words.take(pa.array(more))), strict=True):
            key = _END + w[len(w) - int(tail[k]) :]
            behind[k] = self.known[key] if key in self.known else self._learn(key, self._piece(key[1:]))
        ids, n = self._gather(np.stack([number, behind], 1).ravel())
        n = n.reshape(-1, 2).sum(1)
        ids, each = _picked(ids, (np.cumsum(n) - n)[places], n[places])
        return ids, np.add.reduceat(each, cut.offsets.to_numpy()[:-1])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (none null), each with the end id, and the length of each."""
        whole = np.ones(len(texts), bool)
        if self.by_words:
            whole = pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False)
            for t in self.added:
                whole = whole | pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        n = np.zeros(len(texts), np.int64)
        cut = np.empty(0, np.int32)
        if not whole.all():
            cut, n[~whole] = self._by_words(texts.filter(pa.array(~whole)) if whole.any() else texts)
        if not whole.any():
            return cut, n
        said = iter(self._whole(_strings(texts.filter(pa.array(whole)))))
        parts, at = [], 0
        for k, w in enumerate(whole.tolist()):
            if w:
                parts.append(np.array([*next(said), self.end_id], np.int32))
                n[k] = len(parts[-1])
            else:
                parts.append(cut[at : at + n[k]])
                at += n[k]
        return np.concatenate([np.empty(0, np.int32), *parts]), n


def _picked(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``values``, one after the other, and their sizes."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - ends + sizes, sizes) + np.arange(total)], sizes


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


_encoders: dict[tuple[str, int], Encoder] = {}


def _encoder(path: str, end_id: int) -> Encoder:
    """The encoder of this worker; its words serve all tasks that the worker runs."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def _slices(text: pa.Array) -> list[tuple[int, int]]:
    """Start and length of runs of SLICE_BYTES at most, or of one text."""
    out, first, size = [], 0, 0
    for k, n in enumerate(pc.binary_length(text).to_pylist()):
        if size and size + n > SLICE_BYTES:
            out.append((first, k - first))
            first, size = k, 0
        size += n + 1
    return [*out, (first, len(text) - first)] if len(text) > first else out


def _encoding(tokenizer: str, end_id: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, segment, at = _encoder(tokenizer, end_id), TaskContext.get().partitionId(), 0
        for whole in batches:
            for first, length in _slices(whole.column("text")):
                batch = whole.slice(first, length)
                ids, n = encoder.encode(batch.column("text"))
                ends = np.cumsum(n)
                column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(len(n), segment, np.int32)), pa.array(at + ends - n), pa.array(n), column], ["doc_id", "segment", "place", "n_tokens", "ids"])
                at += int(ends[-1])
        scratch.give_back()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, stripe_bytes: int = 32 << 20, rows_per_index: int = 1000, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every text and write ``doc_id, segment, place, n_tokens, ids`` as ORC in ascending order of the id.

    The one shuffle deals texts by ranges of id, then of a hash of the text, then of the row's place in the
    input: ranges are sampled, so no task grows with the input, nor with the rows of one id or of one text.
    ``docs`` must give its rows in the same order when it is read again, as files do.
    """
    wanted = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("place"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("place")]
    ordered = wanted.repartitionByRange(*order).sortWithinPartitions(order[0], order[1], "text", "place").select("doc_id", "text")
    encoded = ordered.mapInArrow(_encoding(tokenizer, end_id), "doc_id long, segment int, place long, n_tokens long, ids array<int>")
    encoded.write.format("orc").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true").option("orc.row.index.stride", str(rows_per_index)).option("orc.stripe.size", str(stripe_bytes)).option("orc.compress", "ZSTD").save(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The written rows, with ``start``: ids of all documents before.

    Offsets need one row per segment. The window over them runs in one task and is
    bounded by the number of written files, not by documents.
    """
    schema = "doc_id long, segment int, place long, n_tokens long, ids array<int>"
    rows = spark.read.schema(schema).orc(path)
    totals = rows.groupBy("segment").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("segment", (F.sum("total").over(Window.orderBy("segment")) - F.col("total")).alias("before"))
    few = before.count() <= BROADCAST_SEGMENTS
    return rows.join(F.broadcast(before) if few else before, "segment").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids")


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("ids")
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        crc = pa.array([zlib.crc32(flat[i:j].tobytes()) for i, j in zip(at[:-1], at[1:], strict=True)], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(np.diff(at).astype(np.int64)), crc], ["doc_id", "start", "n_tokens", "ids_crc32"])
    scratch.give_back()


def digests(rows: DataFrame) -> DataFrame:
    """Length and CRC-32 of the ids that were read, little-endian unsigned 32-bit."""
    return rows.select("doc_id", "start", "ids").mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    path = scratch.new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer)
    return digests(read_tokens(spark, path))
