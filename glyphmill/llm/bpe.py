"""Byte-pair encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last 16 characters cuts texts into chunks, so a passage
that documents share is cut alike in all of them. A task encodes each distinct
chunk once. Where two chunks meet, the tokens near the cut may differ from those
of the whole text; the stretch about it is encoded again, from one sure split to
the next, or in a run without splits from wider and wider bounds until its outer
tokens agree with the chunks' own. The result is exactly that of encoding the whole
text, in time that grows with its length whatever it is made of.
"""

from __future__ import annotations

import base64
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm import _text
from glyphmill.llm._shared import col, map_rows
from glyphmill.ship import ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits text before the merges of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WINDOW = 16
_W, _P = r"\p{White_Space}", r"[^\p{White_Space}\p{L}\p{N}']"
#: A text is surely split here by PATTERN, whatever stands about it.
_EDGE = regex.compile(rf"(?<=[^{_W}])(?={_W})|(?<=\p{{L}})(?=[^\p{{L}}{_W}])|(?<=\p{{N}})(?=[^\p{{N}}{_W}])|(?<={_P})(?=[\p{{L}}\p{{N}}])|(?<=')(?=\p{{N}})")
#: Characters of one kind, between which it is surely not split.
_RUN = regex.compile(rf"\p{{L}}+|\p{{N}}+|{_P}+|{_W}+")
_CODECS: dict[tuple, Codec] = {}


def cut_points(texts: list[str], mask_bits: int = 10) -> list[np.ndarray]:
    """For each text where chunks after the first begin: where the low bits of the
    hash of the ``WINDOW`` characters before are zero, every 2**mask_bits
    characters on average."""
    h = _text.mix(_text.codepoints("".join(texts)).astype(np.uint64) + np.uint64(1))
    span = 1
    while span < WINDOW:  # h[i] becomes the hash of the last 2 * span characters
        shifted = np.zeros_like(h)
        shifted[span:] = h[:-span] * np.uint64(pow(0x9E3779B97F4A7C15, span, 1 << 64))
        h = h + shifted
        span *= 2
    at = np.flatnonzero((_text.mix(h) & np.uint64((1 << mask_bits) - 1)) == 0) + 1
    end = np.cumsum([len(t) for t in texts])
    out = []
    for e, t in zip(end.tolist(), texts, strict=True):
        b = e - len(t)
        out.append(at[np.searchsorted(at, b + WINDOW) : np.searchsorted(at, e)] - b)
    return out


class Codec:
    """A vocabulary and its encoder with a bounded store of encoded chunks."""

    def __init__(self, vocabulary: str, mask_bits: int = 10, store_chars: int = 16_000_000):
        import tiktoken

        lines = Path(vocabulary).read_bytes().split(b"\n")
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
        self.encoding = tiktoken.Encoding(Path(vocabulary).name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.mask_bits, self.store_chars = mask_bits, store_chars
        self.store: dict[str, array] = {}
        self.stored = self.encoded = self.reused = 0

    def _chunk(self, chunk: str) -> list[int]:
        got = self.store.get(chunk)
        if got is not None:
            self.reused += 1
            return got.tolist()
        self.encoded += 1
        got = self.encoding.encode_ordinary(chunk)
        if len(chunk) <= self.store_chars >> 3:
            self.stored += len(chunk)
            while self.stored > self.store_chars:  # the oldest go
                old = next(iter(self.store))
                del self.store[old]
                self.stored -= len(old)
            self.store[chunk] = array("i", got)
        return got

    def _pop(self, parts: list[list[int]], size: int) -> None:
        """Takes the tokens of the last ``size`` bytes off."""
        while size:
            last = parts[-1]
            n = 0
            while n < len(last) and size:
                n += 1
                size -= len(self.bytes[last[-n]])
            del last[len(last) - n :]
            if not last:
                parts.pop()

    def _from(self, right: list[int], size: int) -> list[int]:
        """The tokens after the first ``size`` bytes."""
        n = 0
        while size:
            size -= len(self.bytes[right[n]])
            n += 1
        return right[n:]

    def _join(self, parts: list[list[int]], right: list[int], text: str, p: int, end: int, reach: int = 256) -> None:
        """Adds ``right``, the tokens of text[p:end], to ``parts``, those of text[:p],
        which become the tokens of text[:end]. What lies between the sure splits
        about p is encoded again; in a run without one, tokens next to p."""
        a, d = text.rfind(" ", max(0, p - 64), p), text.find(" ", p + 1, min(end, p + 64))
        if a > 0 and d > 0 and not text[a - 1].isspace() and not text[d - 1].isspace():  # most often
            self._pop(parts, len(text[a:p].encode()))
            parts.append(self.encoding.encode_ordinary(text[a:d]) + self._from(right, len(text[p:d].encode())))
            return
        lo, hi = max(0, p - reach), min(end, p + reach)
        a = max((m.start() for m in _EDGE.finditer(text, lo, p)), default=0 if lo == 0 else None)
        d = next((m.start() for m in _EDGE.finditer(text, p + 1, hi)), end if hi == end else None)
        if (a is None or d is None) and self._inside(parts, right, text, p, end):
            return
        if a is None:
            while a is None:
                hi_, lo = lo, max(0, lo - 4096)
                a = max((m.start() for m in _EDGE.finditer(text, lo, hi_ + 1)), default=0 if lo == 0 else None)
        if d is None:
            d = next((m.start() for m in _EDGE.finditer(text, p + 1, end)), end)
        self._pop(parts, len(text[a:p].encode()))
        parts.append(self.encoding.encode_ordinary(text[a:d]))
        parts.append(self._from(right, len(text[p:d].encode())))

    def _inside(self, parts: list[list[int]], right: list[int], text: str, p: int, end: int) -> bool:
        """Joins within a run of one kind of characters, which no rule splits. Byte
        pairs are local: tokens are those of the whole run if each is that of itself
        and any two neighbours are those of their bytes together. So tokens about p
        are encoded again, more and more of them, until they agree with the ones
        that stay. False if they don't within reach."""
        bpe = self.encoding._encode_single_piece
        agree = lambda x, y: bpe(self.bytes[x] + self.bytes[y]) == [x, y]
        for reach in (64, 1024):
            lo, hi = max(0, p - reach), min(end, p + reach)
            if not _RUN.fullmatch(text, lo, hi):
                return False
            # apart from what a contraction before or a blank after the run may take
            room = len(text[lo + 4 * (lo > 0) : p].encode())
            ahead = len(text[p : hi - 2 * (hi < end)].encode())
            left = []
            for part in reversed(parts):
                left[:0] = part
                if len(left) > 4 * reach:  # more than so many characters have bytes
                    break
            i = j = 1
            while True:
                before, after = left[-i:], right[:j]
                if sum(len(self.bytes[x]) for x in left[-i - 1 :]) > room or sum(len(self.bytes[x]) for x in right[: j + 1]) > ahead:
                    break
                new = bpe(b"".join(self.bytes[x] for x in (*before, *after)))
                # nothing is before the text's first token, nor yet behind the last one
                x = i >= len(left) or agree(left[-i - 1], new[0])
                y = j >= len(right) or agree(new[-1], right[j])
                if x and y:
                    self._pop(parts, sum(len(self.bytes[x]) for x in before))
                    parts.append(new + right[j:])
                    return True
                i, j = i + (not x), j + (not y)
        return False

    def encode(self, text: str, cuts=None) -> np.ndarray:
        """The tokens of the whole text."""
        cuts = cut_points([text], self.mask_bits)[0] if cuts is None else cuts
        bounds = [0, *(c for c in np.asarray(cuts).tolist() if 0 < c < len(text)), len(text)]
        parts = [self._chunk(text[: bounds[1]])]
        for p, end in zip(bounds[1:-1], bounds[2:], strict=True):
            right = self._chunk(text[p:end])
            if text[p] == " " and not text[p - 1].isspace() or _EDGE.match(text, p):
                parts.append(right)
            else:
                self._join(parts, right, text, p, end)
        return np.concatenate([np.array(x, np.int32) for x in parts]) if parts else np.empty(0, np.int32)

    def decode(self, tokens) -> bytes:
        return self.encoding.decode_bytes(np.asarray(tokens).tolist())


def codec(vocabulary: str, mask_bits: int) -> Codec:
    """This process's codec of so many settings."""
    key = (vocabulary, mask_bits)
    if key not in _CODECS:
        _CODECS[key] = Codec(vocabulary, mask_bits)
    return _CODECS[key]


def bpe_encode(docs: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text", mask_bits: int = 10) -> DataFrame:
    """The documents with columns ``tokens`` (array<int>), ``n_tokens`` and
    ``round_trip`` (whether decoding gives the text's UTF-8 again); columns of these
    names already there, in any case, are replaced.

    The tokens are those of encoding each whole text at once. Null text has null
    tokens, an empty text no tokens. Repeated rows are encoded alike. ``vocabulary``
    is a file of base64 tokens and ranks that every worker can read. An empty table
    stays empty.
    """
    ship(docs.sparkSession)
    added = [T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType()), T.StructField("round_trip", T.BooleanType())]
    names = [f.name for f in added]
    kept = [f for f in docs.schema.fields if f.name.lower() not in names]
    at = [f.name for f in kept].index(text_col)

    def encode(batches):
        c = codec(vocabulary, mask_bits)
        for batch in batches:
            for first, group in _text.pieces(batch.column(at)):
                found = [c.encode(t, cuts) for t, cuts in zip(group, cut_points(group, mask_bits), strict=True)]
                null = batch.column(at).slice(first, len(group)).is_null().to_numpy(zero_copy_only=False)
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(null, False)) if null.any() else pa.array(offsets), pa.array(np.concatenate(found)))
                part = batch.slice(first, len(group))
                back = np.array([c.decode(x) == t.encode() for x, t in zip(found, group, strict=True)])
                new = [tokens, pa.array(np.diff(offsets).astype(np.int32), mask=null), pa.array(back, mask=null)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [f.name for f in (*kept, *added)])

    return map_rows(docs.select([col(f.name) for f in kept]), encode, T.StructType([*kept, *added]))


def bpe_decode(tokens: DataFrame, vocabulary: str = VOCABULARY, tokens_col: str = "tokens") -> DataFrame:
    """The rows with a column ``decoded``, the text that ``tokens_col`` encodes
    (bytes that aren't UTF-8 become U+FFFD); null tokens give null."""
    ship(tokens.sparkSession)

    @F.pandas_udf("string")
    def decode(lists):
        c = codec(vocabulary, 10)
        return lists.map(lambda x: None if x is None else c.decode(x).decode("utf-8", "replace"))

    return tokens.withColumn("decoded", decode(col(tokens_col)))
