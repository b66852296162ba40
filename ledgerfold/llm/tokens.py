"""Token counts and ids in bulk, equal to the tokenizer's over the whole text.

A byte-level BPE tokenizer splits a text into pretokens before it merges. A
single space or newline between two characters that aren't white space always
starts a pretoken, whatever surrounds it; added tokens hold no white space.
Cutting a text there changes nothing, so a batch of texts becomes a batch of
short chunks, of which each distinct one is encoded once, joined to calls of about
equal bytes: as tokens keep the bytes of a text, their widths tell where each
chunk's tokens end. A text of any length is just more chunks. Chunks met before
are kept in a bounded cache until the task ends.
"""

from __future__ import annotations

import os
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import STEP_BYTES, buffers, gathered, steps, tidy

#: Bytes of distinct chunks that go to the tokenizer in one call.
CALL_BYTES = 16 * 1024
#: Distinct chunks that are Python objects at a time.
CALL_CHUNKS = 32 * 1024
#: Chunks that a task remembers, the first that it met, and the longest of them.
REMEMBERED, LONGEST = 250_000, 48
#: Bytes of text that are handled at a time.
BATCH_BYTES = 8 * 1024 * 1024

#: First bytes of the UTF-8 forms of white space outside ASCII.
_TWO, _THREE = 0xC2, (0xE1, 0xE2, 0xE3)


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def safe_cuts(data: np.ndarray) -> Iterator[np.ndarray]:
    """Positions of single spaces or newlines between characters that surely aren't white space, a range of data at a time."""
    for start in range(0, len(data), STEP_BYTES):
        own = max(start - 3, 0)  # what stands in front of a range's first bytes decides as well
        cuts = own + _cuts(data[own : start + STEP_BYTES + 1])
        yield cuts[cuts >= start]


def _cuts(data: np.ndarray) -> np.ndarray:
    mark = np.flatnonzero((data == 0x20) | (data == 0x0A))
    mark = mark[(mark > 0) & (mark < len(data) - 1)]
    before, after = data[mark - 1], data[mark + 1]
    two, three = data[np.maximum(mark - 2, 0)], data[np.maximum(mark - 3, 0)]
    doubtful = (before >= 0x80) & ((two == _TWO) | np.isin(three, _THREE))
    return mark[(before > 0x20) & (after > 0x20) & ~doubtful & (after != _TWO) & ~np.isin(after, _THREE)]


def _joinable(chunk: bytes) -> bool:
    """Whether a chunk still begins and ends a pretoken between other such chunks."""
    return len(chunk) > 1 and chunk[0] in (0x20, 0x0A) and chunk[1] > 0x20 and chunk[1] != _TWO and chunk[1] not in _THREE and 0x20 < chunk[-1] < 0x80


def _check_cuts(tokenizer) -> None:
    """Refuse a tokenizer for which the cuts of `safe_cuts` may change a text's ids.

    Its file must name byte-level BPE without a normalizer or an inserted space, and its
    pretokenizer must begin a pretoken at a single space or newline between
    characters of any two kinds; added tokens must hold no white space.
    """
    said = json.loads(tokenizer.to_str())
    if said["model"]["type"] != "BPE" or said["normalizer"] or tokenizer.pre_tokenizer is None:
        raise ValueError("only byte-level BPE tokenizers without a normalizer are supported")
    if any(c.isspace() for t in tokenizer.get_added_tokens_decoder().values() for c in t.content):
        raise ValueError("an added token holds white space")
    kinds = ["a", "Z", "7", ".", "'", "-", "_", "é", "中", "(", '"', "…", "\U0001f600", "\u0301"]
    for mark in " \n":
        for left in kinds:
            for right in kinds:
                begins = {a for _, (a, _) in tokenizer.pre_tokenizer.pre_tokenize_str(f"{left}{mark}{right}")}
                if 0 not in begins or 1 not in begins:
                    raise ValueError(f"this tokenizer's pretokens span {mark!r} between {left!r} and {right!r}")


class Encoder:
    """Ids of chunks by one tokenizer file, with memory."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        _check_cuts(self.tokenizer)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of text that a token stands for
        for token, i in vocabulary.items():
            self.width[i] = len(token)  # a character for each byte
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            self.width[i] = len(token.content.encode())
        self.known: dict[bytes, bytes] = {}

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        coded = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in coded]

    def _joined(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of joinable chunks, from one text of them all."""
        (ids,) = self._encode([b"".join(chunks)])
        ends = np.cumsum(self.width[ids])
        want = np.cumsum([len(c) for c in chunks])
        at = np.searchsorted(ends, want) + 1
        if len(ids) < at[-1] or (ends[at - 1] != want).any():
            raise ValueError("the tokenizer doesn't keep the bytes of a text")
        return [ids[i:j].tobytes() for i, j in zip([0, *at[:-1].tolist()], at.tolist(), strict=True)]

    def ids(self, chunks: list[bytes]) -> list[bytes]:
        """Each chunk's ids as little-endian unsigned 32-bit numbers."""
        known = self.known
        found = [known.get(c) for c in chunks]
        new = [i for i, x in enumerate(found) if x is None]
        alone = [i for i in new if not _joinable(chunks[i])]
        for i, x in zip(alone, self._encode([chunks[i] for i in alone]), strict=True):
            found[i] = x.tobytes()
        part, size = [], 0
        for i in new:
            if found[i] is not None:
                continue
            part.append(i)
            size += len(chunks[i])
            if size >= CALL_BYTES:
                for j, x in zip(part, self._joined([chunks[k] for k in part]), strict=True):
                    found[j] = x
                part, size = [], 0
        if part:
            for j, x in zip(part, self._joined([chunks[k] for k in part]), strict=True):
                found[j] = x
        for i in new:
            if len(known) >= REMEMBERED:
                break
            if len(chunks[i]) <= LONGEST:
                known[chunks[i]] = found[i]
        return found


#: A worker's tokenizers with the chunks that they know, at most REMEMBERED each; they stay for later partitions.
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(ids of each distinct chunk, chunk numbers in text order, offsets into these by text)."""
    mark = np.zeros(len(data) + 1, bool)
    for part in safe_cuts(data):
        mark[part] = True
    mark[offsets] = True
    cuts = np.flatnonzero(mark)
    del mark
    chunks = pa.Array.from_buffers(
        pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    ).dictionary_encode()
    at = np.searchsorted(cuts, offsets)
    order, distinct = chunks.indices.to_numpy(zero_copy_only=False), chunks.dictionary
    del chunks, cuts
    ids: list[bytes] = []
    for start in range(0, len(distinct), CALL_CHUNKS):
        ids += encoder(path).ids(distinct.slice(start, CALL_CHUNKS).to_pylist())
    return ids, order, at


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens, over_limit.

    n_tokens is the length of the tokenizer's encoding of the whole text without
    begin or end tokens; special strings inside a text are handled as the
    tokenizer file says. Null and empty texts have none; texts of any length are
    read whole. Rows that repeat an id each get a row; a null id stays null.
    Other columns are not read. path: the file of a byte-level BPE tokenizer
    without normalizer, at the same place on every executor; others are refused.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, BATCH_BYTES):
            data, offsets = buffers(batch.column(1))
            for a, b in steps(offsets, BATCH_BYTES):
                own = offsets[a : b + 1] - offsets[a]
                ids, order, at = encoded(data[offsets[a] : offsets[b]], own, path)
                length = np.array([len(x) for x in ids], np.int64) // 4
                before = np.concatenate(([0], np.cumsum(length[order])))
                n = np.diff(before[at])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(own)), pa.array(n), pa.array(n > limit)],
                    ["id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        rows, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
