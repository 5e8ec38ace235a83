"""Encoding a whole corpus with a public byte-level tokenizer, and decoding it again.

Texts run through the tokenizers library in Arrow batches, each distinct text of a batch once. The
tokenizer's file (a megabyte or two, its size is checked) is broadcast, so executors need no copy.

Defined results: an empty and a null text give no ids; strings that look like special tokens are ordinary
text; no special tokens are added; a text of any length is encoded whole; repeated rows give repeated
results; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME = "byte_bpe_50k.json"
#: Bytes of a tokenizer's file that may be broadcast.
MOST_BYTES = 64 * 2**20
#: Texts, and characters of texts, that are encoded at once.
_AT_ONCE, _CHARS_AT_ONCE = 512, 2_000_000


def tokenizer_path(name: str = NAME) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _definition(df: DataFrame, path: str | None):
    path = path or tokenizer_path()
    if (size := Path(path).stat().st_size) > MOST_BYTES:
        raise ValueError(f"{path} has {size} bytes; at most {MOST_BYTES} are broadcast")
    return df.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))


@lru_cache(maxsize=2)
def _tokenizer(definition: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores run tasks already
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(definition)
    t.encode_special_tokens = True
    t.no_truncation()
    t.no_padding()
    return t


def byte_table() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, reversed.

    Bytes with a visible Latin-1 character stand for themselves; the others take the characters from
    U+0100 on, in order.
    """
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def vocabulary(definition: str) -> dict[int, bytes]:
    """The bytes of each id; added tokens are their own UTF-8."""
    spec, table = json.loads(definition), byte_table()
    out = {i: bytes(table[c] for c in word) for word, i in spec["model"]["vocab"].items() if all(c in table for c in word)}
    out |= {a["id"]: a["content"].encode() for a in spec.get("added_tokens", ())}
    return out


def decode(ids: list[int], words: dict[int, bytes]) -> tuple[str, bytes, bytes]:
    """The text of ids, and the bytes at its start and end that are parts of split characters.

    A run of ids cut out of a text may begin or end inside a character; those bytes are handed back rather
    than replaced, so that neighbouring runs can be joined without loss.
    """
    raw = b"".join(words[i] for i in ids)
    begin = 0
    while begin < min(3, len(raw)) and raw[begin] & 0xC0 == 0x80:
        begin += 1
    end = len(raw)
    for back in range(1, min(4, len(raw) - begin) + 1):
        lead = raw[-back]
        if lead & 0xC0 != 0x80:
            need = 1 if lead < 0x80 else 2 if lead >> 5 == 6 else 3 if lead >> 4 == 14 else 4
            end -= back if need > back else 0
            break
    return raw[begin:end].decode("utf-8", "replace"), raw[:begin], raw[end:]


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    block, size = [], 0
    for t in texts:
        if block and (len(block) == _AT_ONCE or size + len(t) > _CHARS_AT_ONCE):
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t)
    if block:
        yield block


def _encoded(texts: list[str | None], tokenizer, read) -> list:
    """What ``read`` takes from the encoding of each text; null counts as empty."""
    distinct = list(dict.fromkeys(t or "" for t in texts))
    found: dict[str, object] = {}
    for block in _blocks(distinct):
        found |= zip(block, map(read, tokenizer.encode_batch(block, add_special_tokens=False)), strict=True)
    return [found[t or ""] for t in texts]


def encode(df: DataFrame, row_id: str, text: str, path: str | None = None) -> DataFrame:
    """(row_id, ids) of each row's text."""
    spec, kind = _definition(df, path), df.schema[row_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(spec.value)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(_encoded(b.column(1).to_pylist(), t, lambda e: e.ids), pa.list_(pa.int32()))], names=["row_id", "ids"])

    return df.select(F.col(row_id).alias("row_id"), F.col(text).alias("text")).mapInArrow(run, f"row_id {kind}, ids array<int>")


def spans(df: DataFrame, row_id: str, text: str, path: str | None = None) -> DataFrame:
    """(row_id, ids, begins, ends): the characters that each id covers; ids that share a character repeat its span."""
    spec, kind = _definition(df, path), df.schema[row_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, ints = _tokenizer(spec.value), pa.list_(pa.int32())
        for b in batches:
            got = _encoded(b.column(1).to_pylist(), t, lambda e: (e.ids, [x for x, _ in e.offsets], [y for _, y in e.offsets]))
            yield pa.record_batch([b.column(0), *(pa.array(list(c), ints) for c in zip(*got, strict=True))], names=["row_id", "ids", "begins", "ends"])

    return df.select(F.col(row_id).alias("row_id"), F.col(text).alias("text")).mapInArrow(run, f"row_id {kind}, ids array<int>, begins array<int>, ends array<int>")


def decode_all(df: DataFrame, row_id: str, ids: str, path: str | None = None) -> DataFrame:
    """(row_id, text) of each row's ids; a null list gives the empty text."""
    spec, kind = _definition(df, path), df.schema[row_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(spec.value)
        for b in batches:
            texts = []
            for x in b.column(1).to_pylist():
                body, head, tail = decode(x or [], words)
                texts.append(head.decode("utf-8", "replace") + body + tail.decode("utf-8", "replace"))
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], names=["row_id", "text"])

    return df.select(F.col(row_id).alias("row_id"), F.col(ids).alias("ids")).mapInArrow(run, f"row_id {kind}, text string")


def count_tokens(df: DataFrame, keep: list[Column], text: Column, path: str | None = None) -> DataFrame:
    """The ``keep`` columns with ``n_tokens`` of a text; the text itself isn't carried on."""
    spec = _definition(df, path)
    rows = df.select(*keep, text.alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(spec.value)
        for b in batches:
            n = pa.array(_encoded(b.column(b.num_columns - 1).to_pylist(), t, lambda e: len(e.ids)), pa.int64())
            yield pa.record_batch([*b.columns[:-1], n], names=[*b.schema.names[:-1], "n_tokens"])

    return rows.mapInArrow(run, f"{kinds}, n_tokens bigint")
