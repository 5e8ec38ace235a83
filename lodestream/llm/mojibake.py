"""Garbled text from decoding with a wrong character encoding: finding it and restoring the original.

A corpus model counts characters and adjacent pairs of them over all distinct texts (a text counts once however
many copies it has, or a garbled one with many copies would prove itself right). A pair's score is its pointwise
mutual information less half the information of either character,

    score(x, y) = log2 p(xy) / sqrt(p(x) p(y)) = PMI(x, y) + (log2 p(x) + log2 p(y)) / 2,

which is 0 where the two always stand together and falls as they do so more rarely than either stands alone. Half
the marginals come off because plain mutual information can't tell recurring garbling apart: the characters of a
garbled letter always stand together, so it is highest there. Where such a letter meets the text around it the score
is low. Summed along a text, differences of this score are those of the text's probability as a chain of
characters. Only shares enter, so neither more text of the same kind nor text in other scripts changes a score.

1. Isolate: each pair beyond ASCII counts a threshold less its score; the maximum-scoring segments of that
   sequence are the improbable parts, and the stretches of characters beyond ASCII that they touch are the runs. The
   threshold is the corpus's mean score of pairs of an ASCII letter and a character beyond, ``IMPROBABLE`` at least.
2. Test inverse mappings inside these runs only: encode with the encoding that was wrongly used, decode with the
   right one. Where the right one is UTF-8, what is mapped must be valid UTF-8, which is evidence of its own (``VALID``
   bits for each character saved), and the score has to rise. Between two single-byte encodings anything decodes, so the
   gains of the runs' characters are summed, and only maximum-scoring segments of at least ``SEGMENT`` bits are
   mapped back.
3. Repeat while a mapping gains and gives a text that wasn't there before; neither how often a text was garbled nor
   by how many encodings its parts were is limited.

The replacement character is the trace of bytes that no encoding gives back: found, but not restorable.

Pairs with a share below ``RARE`` of all pairs beyond ASCII count as never seen, so at most 1/RARE are broadcast,
besides those of ASCII and one number for each character. A pair that was never seen counts as ``UNSEEN`` of the
square root of p(x) p(y).

Defined results: null, empty and pure ASCII texts are never affected; texts of any length are read whole;
repeated rows are each reported; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.session import materialize

IMPROBABLE, VALID, SEGMENT = -4.5, 3.0, 8.0
RARE, UNSEEN = 2.0**-21, 2.0**-10
#: Distinct pairs and characters that a task counts before it hands them on.
_HELD = 1 << 20
#: Encodings that UTF-8 is wrongly read as, and single-byte pairs (wrong, right).
OVER_UTF8 = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "cp852", "mac_roman", "iso8859-15", "iso8859-2", "cp1254", "cp1253", "cp1257", "cp866", "koi8-r")
SINGLE = (("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1251", "cp1252"), ("cp1252", "cp1251"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp850"), ("cp1252", "cp1256"), ("cp1252", "cp1250"), ("latin-1", "iso8859-2"), ("cp1250", "cp1252"))
#: Valid UTF-8 as Latin-1; in a small letter's place the no-break space of an a with grave may have become a plain one.
_UTF8 = re.compile("(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}|(?<![A-Z\xc0-\xff\u0100])\xc3 )+")
_RUN = re.compile("[^\x00-\x7f]+")
_NOT_ASCII = "[^\\x00-\\x7F]"
_DIGITS = str.maketrans("123456789", "0" * 9)
LOST = chr(0xFFFD)
_ALONE = np.uint64(0xFFFFFFFF)
#: Stands for what can't be mapped.
_NEVER = chr(0xFFFF)


def _keys(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs (as one number each) and characters (paired with ``_ALONE``) of a sequence, and their counts."""
    codes = np.where((codes >= 48) & (codes <= 57), np.uint32(48), codes).astype(np.uint64)
    x, y = codes[:-1], codes[1:]
    ascii_ = (x < 128) & (y < 128)
    plain = np.bincount((x[ascii_] << np.uint64(7) | y[ascii_]).astype(np.int64), minlength=1 << 14)
    one = np.bincount(y[y < 128].astype(np.int64), minlength=128)
    pairs, n = np.unique(x[~ascii_] << np.uint64(32) | y[~ascii_], return_counts=True)
    chars, m = np.unique(y[y > 127], return_counts=True)
    some, few = plain.nonzero()[0], one.nonzero()[0]
    keys = [(some.astype(np.uint64) >> np.uint64(7)) << np.uint64(32) | some.astype(np.uint64) & np.uint64(127), few.astype(np.uint64) << np.uint64(32) | _ALONE, pairs, chars << np.uint64(32) | _ALONE]
    return np.concatenate(keys), np.concatenate([plain[some], one[few], n, m])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def summed() -> tuple[np.ndarray, np.ndarray]:
        keys, index = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(index, np.concatenate([n for _, n in held])).astype(np.int64)

    for b in batches:
        texts = "\n".join(t for t in b.column(0).to_pylist() if t)
        # Each text stands between two line ends, so the counts don't depend on how texts fall into batches.
        held.append(_keys(np.frombuffer(f"\n{texts}\n".encode("utf-32-le", "surrogatepass"), np.uint32)))
        if sum(len(k) for k, _ in held) > _HELD:
            held = [summed()]
            if len(held[0][0]) > _HELD // 2:
                yield pa.record_batch([pa.array(held[0][0].astype(np.int64)), pa.array(held[0][1])], names=["pair", "n"])
                held = []
    if held:
        keys, n = summed()
        yield pa.record_batch([pa.array(keys.astype(np.int64)), pa.array(n)], names=["pair", "n"])


def corpus_pairs(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The corpus model of a single text column: pairs and characters (sorted numbers) of its distinct texts, and their counts."""
    # Copies are dropped on the map side first. Pure ASCII counts too: how common letters are decides what they say of their neighbours.
    once = texts.distinct()
    counted = materialize(once.mapInArrow(_count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    alone, inside = F.col("pair").bitwiseAND(F.lit(int(_ALONE))) == F.lit(int(_ALONE)), (F.shiftright("pair", 32) < 128) & (F.col("pair").bitwiseAND(F.lit(int(_ALONE))) < 128)
    beyond = counted.where(~alone & ~inside).agg(F.sum("n")).first()[0] or 0
    kept = counted.where(alone | inside | (F.col("n") >= F.lit(beyond * RARE))).toArrow()
    keys, n = kept["pair"].to_numpy().astype(np.uint64), kept["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


@lru_cache(maxsize=64)
def _to_bytes(codec: str) -> dict[int, str]:
    """Character to byte (as a Latin-1 character) of a single-byte encoding; undefined bytes are control characters."""
    out = {}
    for byte in range(0x80, 0x100):
        out[ord(bytes([byte]).decode(codec, "ignore") or chr(byte))] = chr(byte)
    return out


class _Table(dict):
    """A translation that turns what an encoding lacks into a character outside Latin-1."""

    def __missing__(self, code: int) -> int:
        return 0x100


@lru_cache(maxsize=64)
def _encoder(codec: str) -> _Table:
    return _Table({code: code for code in range(128)} | _to_bytes(codec))


@lru_cache(maxsize=64)
def _trace(codecs: tuple[str, ...]) -> re.Pattern:
    """What UTF-8 of two bytes or more begins with when read as one of some encodings: a lead and a continuation byte."""
    lead, follow, grave = set(), set(), set()
    for codec in codecs:
        for code, byte in _to_bytes(codec).items():
            (lead if "\xc2" <= byte <= "\xf4" else follow).add(chr(code))
            if byte == "\xc3":
                grave.add(chr(code))
    one = lambda chars: "[" + re.escape("".join(sorted(chars))) + "]"
    return re.compile(f"{one(lead)}{one(follow)}|{one(grave)} ")


class _Meant(dict):
    """A translation that turns what an encoding lacks into ``_NEVER``; ASCII stays."""

    def __missing__(self, code: int) -> int:
        return code if code < 128 else ord(_NEVER)


@lru_cache(maxsize=64)
def _single(wrong: str, right: str) -> _Meant:
    """Character to character for one single-byte encoding read as another."""
    meant = {code: byte.encode("latin-1").decode(right, "ignore") for code, byte in _to_bytes(wrong).items()}
    return _Meant({code: x for code, x in meant.items() if x})


_ANY_TRACE = _trace(OVER_UTF8)


def _around(text: str, begin: int, end: int) -> str:
    """A part of a text with its neighbours; a line end stands for none."""
    return (text[begin - 1] if begin else "\n") + text[begin:end] + (text[end] if end < len(text) else "\n")


def _decoded(text: str, codec: str) -> Iterator[tuple[re.Match, str]]:
    """Each part of a text that was UTF-8 read as ``codec``, and what it meant."""
    if not _trace((codec,)).search(text):
        return
    for m in _UTF8.finditer(text.translate(_encoder(codec))):
        try:
            yield m, m.group().replace("\xc3 ", "\xc3\xa0").encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            continue


def _further(text: str) -> list[str]:
    """A text and all that further mappings from UTF-8 make of it; each is shorter, so this ends."""
    found = {text: None}
    for t in (todo := [text]):
        for codec in OVER_UTF8 if _ANY_TRACE.search(t) else ():
            parts, at = [], 0
            for m, meant in _decoded(t, codec):
                parts += [t[at : m.start()], meant]
                at = m.end()
            if at and (new := "".join([*parts, t[at:]])) not in found:
                found[new] = None
                todo.append(new)
    return list(found)


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


class Restorer:
    """Finds and restores garbled runs with a corpus model."""

    def __init__(self, model: tuple[np.ndarray, np.ndarray]) -> None:
        self.keys, self.n = model
        self.total = float(max(1, self.n[(self.keys & _ALONE) == _ALONE].sum()))
        self.known: dict[str, float] = {}
        self.shares: dict[str, float] = {}
        self.gains: dict[str, dict[tuple[str, str], list[float]]] = {}
        self.risen: dict[str, list[tuple[tuple[str, str], float]]] = {}
        self.threshold = max(IMPROBABLE, self._usual())

    def _usual(self) -> float:
        """The mean score of the corpus's pairs of an ASCII letter and a character beyond ASCII."""
        x, y = self.keys >> np.uint64(32), self.keys & _ALONE
        alone = y == _ALONE
        letter = lambda c: ((c | np.uint64(32)) >= 97) & ((c | np.uint64(32)) <= 122)
        mixed = ~alone & (letter(x) & (y > 127) | letter(y) & (x > 127))
        if not mixed.any():
            return IMPROBABLE
        share = lambda c: self.n[alone][np.searchsorted(x[alone], c)]
        scores = np.log2(self.n[mixed] / np.sqrt(share(x[mixed]) * share(y[mixed]).astype(float)) + UNSEEN)
        return float(np.average(scores, weights=self.n[mixed]))

    def _share(self, x: int, y: int) -> float:
        key = np.uint64(x << 32 | y)
        i = int(np.searchsorted(self.keys, key))
        return float(self.n[i]) / self.total if i < len(self.keys) and self.keys[i] == key else 0.0

    def share(self, x: str) -> float:
        """A character's share of all characters."""
        if (got := self.shares.get(x)) is None:
            got = self.shares[x] = self._share(48 if "0" <= x <= "9" else ord(x), int(_ALONE))
        return got

    def pair(self, xy: str) -> float:
        """The score of two adjacent characters; that of a pair never seen where either was never seen."""
        if (got := self.known.get(xy)) is None:
            if len(self.known) > 500_000:
                self.known.clear()
            x, y = xy.translate(_DIGITS)
            alone = math.sqrt(self.share(x) * self.share(y))
            got = self.known[xy] = math.log2((self._share(ord(x), ord(y)) / alone if alone else 0.0) + UNSEEN)
        return got

    def chain(self, text: str) -> float:
        """The scores of a text's pairs, summed."""
        return sum(self.pair(text[i : i + 2]) for i in range(len(text) - 1))

    def improbable(self, text: str) -> list[tuple[int, int]]:
        """The runs (begin, end) of characters beyond ASCII that the improbable segments of a text touch."""
        runs, scores, owner = [], [], []
        for m in _RUN.finditer(text):
            begin, end = m.span()
            around = _around(text, begin, end)
            scores += [self.threshold - self.pair(around[i : i + 2]) for i in range(len(around) - 1)]
            owner += [len(runs)] * (len(around) - 1)
            runs.append((begin, end))
        touched = {i for a, b, _ in segments(scores) for i in owner[a:b]}
        return [runs[i] for i in sorted(touched)]

    def from_utf8(self, text: str, codec: str, runs: list[tuple[int, int]]) -> tuple[str, float]:
        """``text`` with what was UTF-8 read as ``codec`` mapped back inside its runs, and the gain.

        What a mapping gives may be garbled itself; it is then also judged by what further mappings make of it.
        """
        out, at, gain = [], 0, 0.0
        for begin, end in runs:
            low = max(0, begin - 1)
            for m, meant in _decoded(text[low : end + 1], codec):
                a, b = low + m.start(), low + m.end()
                left, right = text[a - 1] if a else "\n", text[b] if b < len(text) else "\n"
                old = self.chain(left + text[a:b] + right)
                best = 0.0, ""
                for x in _further(meant):
                    if all(map(self.share, x)):
                        best = max(best, (self.chain(left + x + right) - old + VALID * (b - a - len(x)), x))
                if best[0] > 0:
                    out += [text[at:a], best[1]]
                    at, gain = b, gain + best[0]
        return "".join([*out, text[at:]]), gain

    def single_gains(self, around: str) -> dict[tuple[str, str], list[float]]:
        """For each single-byte pair the gain of each character of a run, which is given with its neighbours; remembered."""
        if (got := self.gains.get(around)) is None:
            if len(self.gains) > 100_000:
                self.gains.clear()
            got = self.gains[around] = {}
            old = [self.pair(around[i : i + 2]) for i in range(len(around) - 1)]
            for pair in SINGLE:
                new = around[0] + around[1:-1].translate(_single(*pair)) + around[-1]
                pairs = [self.pair(new[i : i + 2]) - o for i, o in enumerate(old)]
                last = len(old) - 2
                # A pair of two characters of a run counts half for either.
                each = [pairs[i] / (1 if i == 0 else 2) + pairs[i + 1] / (1 if i == last else 2) for i in range(last + 1)]
                got[pair] = [-2 * SEGMENT if x == _NEVER else g if self.share(x) else -SEGMENT for x, g in zip(new[1:], each, strict=False)]
        return got

    def rises(self, around: str) -> list[tuple[tuple[str, str], float]]:
        """The single-byte pairs that gain anywhere in a run, and the sum of their positive gains; remembered."""
        if (got := self.risen.get(around)) is None:
            if len(self.risen) > 100_000:
                self.risen.clear()
            sums = ((pair, sum(g for g in gains if g > 0)) for pair, gains in self.single_gains(around).items())
            got = self.risen[around] = [x for x in sums if x[1] > 0]
        return got

    def from_single(self, text: str, wrong: str, right: str, runs: list[tuple[int, int]]) -> tuple[str, float]:
        """``text`` with the maximum-scoring segments of its runs mapped back from one single-byte encoding to another."""
        to = _single(wrong, right)
        spots, gains = [], []
        for begin, end in runs:
            spots += range(begin, end)
            gains += self.single_gains(_around(text, begin, end))[wrong, right]
        if not gains or max(gains) <= 0:
            return text, 0.0
        chars, total = list(text), 0.0
        for a, b, s in segments(gains):
            if s >= SEGMENT:
                total += s
                for i in spots[a:b]:
                    x = chars[i].translate(to)
                    chars[i] = chars[i] if x == _NEVER else x
        return "".join(chars), total

    def restore(self, text: str | None) -> tuple[bool, str | None]:
        """Whether a text is affected, and the text with all that can be restored."""
        if not text or text.isascii():
            return False, text
        now, before = text, {_digest(text)}
        while runs := self.improbable(now):
            best = now, 0.0
            if traced := [(a, b) for a, b in runs if _ANY_TRACE.search(now, max(0, a - 1), b + 1)]:
                best = max((self.from_utf8(now, c, traced) for c in OVER_UTF8), key=lambda t: t[1])
            if best[1] <= 0:
                # A segment's sum is at most that of the positive gains.
                most = dict.fromkeys(SINGLE, 0.0)
                for a, b in runs:
                    for pair, rises in self.rises(_around(now, a, b)):
                        most[pair] += rises
                best = max((self.from_single(now, *p, runs) for p, m in most.items() if m >= SEGMENT), key=lambda t: t[1], default=best)
            if best[1] <= 0 or (state := _digest(best[0])) in before:
                break
            now = best[0]
            before.add(state)
        return now != text or LOST in text, now


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, sum) of a sequence, by the linear-time algorithm of Ruzzo and Tompa."""
    found: list[list] = []  # begin, end, sum before, sum up to the end
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i + 1, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], i + 1, found[j][2], total]
            del found[j:]
    return [(a, b, r - le) for a, b, le, r in found]


def restored(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, text) of the affected documents, with all that can be restored."""
    model = df.sparkSession.sparkContext.broadcast(corpus_pairs(df.select(F.col(text).alias("text"))))
    kind = df.schema[row_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, done = Restorer(model.value), {}
        for b in batches:
            keep, texts = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if (got := done.get(t)) is None:
                    got = r.restore(t)
                    if len(t) < 2000 and len(done) < 50_000:  # repeated texts
                        done[t] = got
                if got[0]:
                    keep.append(i)
                    texts.append(got[1])
            yield pa.record_batch([b.column(0).take(pa.array(keep, pa.int64())), pa.array(texts, pa.string())], names=["row_id", "text"])

    rows = df.select(F.col(row_id).alias("row_id"), F.col(text).alias("text")).where(F.col("text").rlike(_NOT_ASCII))
    return rows.mapInArrow(run, f"row_id {kind}, text string")
