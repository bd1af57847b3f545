"""BPE encoding and decoding with a contiguous rank array.

The vocabulary file (JSON of the ``tokenizers`` format: NFC, white space
folding and lower case, then words, byte-level symbols and an end-of-word
mark) is a parameter, read once in each Python worker. A short word is
encoded by ``pieces.RankArray``: it holds the part boundaries and the merge
ranks of adjacent parts contiguously, finds the smallest rank, deletes that
boundary and refreshes the neighbouring ranks, until no pair has a rank.

Defined cases: a null or empty text has no ids and decodes to an empty text;
special tokens spelled out in a text become their ids; every row gives a
row, repeated or not; a null id stays null; other columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from . import text_arrays as ta
from .staging import bounded_batches

class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.bpe = pieces.RankArray(spec)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {**spec["model"]["vocab"], **self.special}
        self.tokens = [""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            self.tokens[i] = token
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        words = [regex.escape("'" + x) for x in pieces._ENDINGS]
        self.word = regex.compile("|".join([*words, r"\p{L}+", r"\p{N}", r"[^\p{White_Space}\p{L}\p{N}]+"]))
        self.cache = pieces.PieceCache(self.bpe.encode)
        raw = [t.encode() for t in self.tokens]
        self.token_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.token_edge = np.append(0, np.cumsum([len(t) for t in raw])).astype(np.int64)

    def encode_any(self, text: str) -> list[int]:
        """Any text: other scripts, special tokens."""
        out: list[int] = []
        for part in self.split.split(text):
            if part in self.special:
                out.append(self.special[part])
                continue
            # letter by letter, as the vocabulary's lower case has no final sigma
            part = unicodedata.normalize("NFC", part).replace("\u03a3", "\u03c3").lower()
            words = [w.encode() for w in self.word.findall(part)]
            if words:
                ends = np.cumsum([len(w) for w in words])
                data = np.frombuffer(b"".join(words), np.uint8)
                out += self.bpe.encode(data, np.append(0, ends[:-1]), ends)[0].tolist()
        return out

    def encode_column(self, texts: pa.Array) -> pa.ListArray:
        data, offsets = ta.buffers(texts)
        general = ~pieces.plain(data, offsets)
        for token in self.special:
            general |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        low = pc.if_else(pa.array(general), "", pc.utf8_lower(texts.fill_null("")))
        data, offsets = ta.buffers(low)
        ids, before = self.cache.ids(data, *pieces.cut(data, offsets, spaced=False))
        if general.any():
            own = {int(i): np.array(self.encode_any(texts[int(i)].as_py()), np.int32) for i in np.flatnonzero(general)}
            parts = [own.get(i, ids[before[i]:before[i + 1]]) for i in range(len(general))]
            ids, before = np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
        return pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(ids, pa.int32()))

    def decode_column(self, ids: pa.ListArray) -> pa.Array:
        size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        return ta.join_spans(self.token_bytes, self.token_edge[flat], self.token_edge[flat + 1],
                             np.append(0, np.cumsum(size)).astype(np.int64))


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def _encode(batches, path: str):
    codec = word_bpe(path)
    for chunk in ta.chunks(batches):
        yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), codec.encode_column(chunk.column("text"))], ["doc_id", "ids"])


def _decode(batches, path: str, keep_ids: bool):
    codec = word_bpe(path)
    for batch in batches:
        text = codec.decode_column(batch.column("ids"))
        yield (pa.RecordBatch.from_arrays([*batch.columns, text], ["doc_id", "ids", "decoded"]) if keep_ids else
               pa.RecordBatch.from_arrays([batch.column("doc_id"), text], ["doc_id", "text"]))


def _round_trip(batches, path: str):
    return _decode(_encode(batches, path), path, True)


def _input(docs: DataFrame, column: str) -> DataFrame:
    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), column)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of (doc_id, text)."""
    return _input(docs, "text").mapInArrow(partial(_encode, path=path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): the tokens joined by spaces."""
    return _input(encoded, "ids").mapInArrow(partial(_decode, path=path, keep_ids=False), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): ``encode`` and ``decode`` in one pass over the rows."""
    return _input(docs, "text").mapInArrow(partial(_round_trip, path=path), "doc_id long, ids array<int>, decoded string")
