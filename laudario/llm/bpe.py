"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse.

For a merge list, the last token of the encoding of every prefix is determined by the last token of a
shorter prefix: token t may follow token p exactly if merging the bytes of p and t alone gives back
(p, t). The transducer keeps that last token for the bytes not yet emitted. Whatever bytes come next,
the final encoding passes through one of the positions of the last `longest` bytes; what the chains of
last tokens from all these positions have in common is stable and is emitted at once. The buffer thus
never holds more than the merge list's sufficient lookahead, whatever the length of the text.

Text is cut into pieces by the tokenizer's pattern, itself as a stream: a piece is closed once three
further characters are known, and a run that stays open is fed to the transducer as it comes.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laudario.session import spread

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"

# Fixed value: the pattern that cuts text into pieces before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CONTEXT = 3  # characters after a match that may still change it


def read_ranks(path: str) -> dict[bytes, int]:
    """Bytes of each token and its id, from a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeList:
    """The vocabulary of a merge list with what the transducer needs of it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.by_end: dict[int, set[int]] = {}
        for t in ranks:
            self.by_end.setdefault(t[-1], set()).add(len(t))
        self.lengths = {b: sorted(ls, reverse=True) for b, ls in self.by_end.items()}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}

    def merge(self, piece: bytes) -> list[bytes]:
        """The encoding by definition: the adjacent pair of lowest rank is merged until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            pair = (parts[at], parts[at + 1])
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def follows(self, p: bytes, t: bytes) -> bool:
        """Whether token t may stand after token p in an encoding."""
        key = (p, t)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(p + t) == [p, t]
        return known

    def whole(self, t: bytes) -> bool:
        """Whether a token encodes to itself; tokens that don't never occur."""
        if (known := self.pairs.get((b"", t))) is None:
            known = self.pairs[(b"", t)] = self.merge(t) == [t]
        return known

    def sufficient_lookahead(self) -> int:
        """Bytes after which a token boundary can no longer change: merges times the longest token, the
        bound that holds for every merge list (a change travels at most one token further a merge)."""
        return max(1, len(self.ranks) - 256) * self.longest


class Transducer:
    """Encodes one piece, byte by byte."""

    def __init__(self, merges: MergeList):
        self.m = merges
        self.data = bytearray()
        self.last: list[bytes] = []  # last token of the prefix that ends after each buffered byte
        self.before = b""  # the token emitted last
        self.most = 0  # the largest buffer so far

    def _step(self) -> None:
        data, n = self.data, len(self.data)
        for size in self.m.lengths.get(data[-1], ()):
            if size > n:
                continue
            t = bytes(data[n - size :])
            if t not in self.m.ranks:
                continue
            p = self.last[n - size - 1] if size < n else self.before
            if self.m.follows(p, t) if p else self.m.whole(t):
                self.last.append(t)
                return
        raise ValueError("the merge list has no token for a byte")

    def feed(self, piece: bytes) -> list[int]:
        out: list[int] = []
        for b in piece:
            self.data.append(b)
            self._step()
            if len(self.data) >= 4 * self.m.longest:
                out += self._stable()
        self.most = max(self.most, len(self.data))
        return out

    def _chain(self, end: int) -> list[bytes]:
        out = []
        while end:
            out.append(self.last[end - 1])
            end -= len(out[-1])
        return out[::-1]

    def _emit(self, tokens: list[bytes]) -> list[int]:
        size = sum(map(len, tokens))
        del self.data[:size], self.last[:size]
        if tokens:
            self.before = tokens[-1]
        return [self.m.ranks[t] for t in tokens]

    def _stable(self) -> list[int]:
        """Emits what all chains from the last `longest` positions have in common."""
        n = len(self.data)
        common = self._chain(n)
        for end in range(n - 1, max(0, n - self.m.longest), -1):
            chain = self._chain(end)
            k = 0
            while k < min(len(common), len(chain)) and common[k] == chain[k]:
                k += 1
            common = common[:k]
        if n > self.m.sufficient_lookahead() and not common:
            raise ValueError("no token is stable within the sufficient lookahead")
        return self._emit(common)

    def finish(self) -> list[int]:
        out = self._emit(self._chain(len(self.data)))
        self.before = b""
        return out


class Encoder:
    """Streaming text encoder: `feed` chunks, then `finish`. Memory doesn't grow with the text."""

    OPEN = 256  # an unfinished piece longer than this goes to the transducer as it comes

    def __init__(self, merges: MergeList, pattern: str = PATTERN, cached: int = 200_000):
        self.m = merges
        self.pattern = regex.compile(pattern)
        self.kinds = {"L": regex.compile(r"\p{L}*"), "N": regex.compile(r"\p{N}*"), "S": regex.compile(r"\s*"), "O": regex.compile(r"[^\s\p{L}\p{N}]*")}
        self.cache: dict[str, list[int]] = {}
        self.cached = cached
        self.rest = ""
        self.run: tuple[str, Transducer] | None = None

    def piece(self, text: str) -> list[int]:
        if (ids := self.cache.get(text)) is None:
            t = Transducer(self.m)
            ids = t.feed(text.encode("utf-8")) + t.finish()
            if len(text) <= 64:
                if len(self.cache) >= self.cached:
                    self.cache.clear()
                self.cache[text] = ids
        return ids

    def _kind(self, c: str) -> str:
        return next(k for k, p in self.kinds.items() if p.match(c).end())

    def _continue(self, text: str, final: bool) -> tuple[list[int], str]:
        """Goes on with an open run; returns what is left of the text."""
        kind, t = self.run
        end = self.kinds[kind].match(text).end()
        out: list[int] = []
        if end < len(text) or final:
            # of white space before other text, the last character belongs to what follows
            stop = end - 1 if kind == "S" and end < len(text) else end
            out += t.feed(text[:stop].encode("utf-8")) + t.finish()
            self.run = None
            return out, text[stop:]
        stop = max(0, end - 1)
        out += t.feed(text[:stop].encode("utf-8"))
        return out, text[stop:]

    def feed(self, chunk: str, final: bool = False) -> list[int]:
        text, out = self.rest + chunk, []
        self.rest = ""
        if self.run:
            ids, text = self._continue(text, final)
            out += ids
            if self.run:
                self.rest = text
                return out
        at = 0
        safe = len(text) if final else len(text) - _CONTEXT
        cache = self.cache
        for m in self.pattern.finditer(text):
            if m.end() > safe:
                break
            p = m[0]
            ids = cache.get(p)
            out += ids if ids is not None else self.piece(p)
            at = m.end()
        self.rest = text[at:]
        if not final and len(self.rest) > self.OPEN and self.pattern.match(self.rest).end() >= len(self.rest) - _CONTEXT:
            kind = self._kind(self.rest[1] if self.rest[0] == " " else self.rest[0])
            lead = 1 if self.rest[0] == " " and kind != "S" else 0
            if self.kinds[kind].match(self.rest, lead).end() == len(self.rest):
                self.run = (kind, Transducer(self.m))
                out += self.run[1].feed(self.rest[:lead].encode("utf-8"))
                ids, self.rest = self._continue(self.rest[lead:], False)
                out += ids
        return out

    def finish(self) -> list[int]:
        out = self.feed("", final=True)
        self.rest, self.run = "", None
        return out

    def encode(self, text: str | None, chunk: int = 65_536) -> list[int]:
        """The ids of a text; NULL and empty texts have none."""
        if not text:
            return []
        out: list[int] = []
        for i in range(0, len(text), chunk):
            out += self.feed(text[i : i + chunk], final=i + chunk >= len(text))
        self.rest, self.run = "", None
        return out


class Decoder:
    """Incremental inverse: ids in, text out as soon as its bytes are complete; damaged bytes become U+FFFD."""

    def __init__(self, merges: MergeList):
        self.tokens = merges.tokens
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return "".join(self.state.decode(self.tokens[i]) for i in ids)

    def finish(self) -> str:
        out = self.state.decode(b"", True)
        self.state.reset()
        return out

    def decode(self, ids) -> str:
        return self.feed(ids) + self.finish()


def encode_column(df: DataFrame, keys: list[str], text: str, path: str = f"{TOKENIZERS}/{BYTE_BPE_50K}") -> DataFrame:
    """(keys, ids ARRAY<INT>) of every row; NULL and empty texts give an empty array. The rank file is read on the driver and broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(path))
    slim = spread(df.select(*keys, F.col(text).alias("__text")))
    fields = slim.schema.fields[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(MergeList(shared.value))
        for batch in batches:
            flat: list[int] = []
            offsets = [0]
            for t in batch.column(batch.num_columns - 1).to_pylist():
                flat += encoder.encode(t)
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=[*batch.schema.names[:-1], "ids"])

    return slim.mapInArrow(run, schema)


def decode_column(df: DataFrame, keys: list[str], ids: str = "ids", path: str = f"{TOKENIZERS}/{BYTE_BPE_50K}") -> DataFrame:
    """(keys, text) of every row of ids; NULL and empty arrays give an empty text."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(path))
    slim = df.select(*keys, F.col(ids).alias("__ids"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(MergeList(shared.value))
        for batch in batches:
            texts = pa.array([decoder.decode(x or ()) for x in batch.column(batch.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*batch.schema.names[:-1], "text"])

    return slim.mapInArrow(run, schema)


def p6_ids(documents: DataFrame, path: str = f"{TOKENIZERS}/{BYTE_BPE_50K}") -> DataFrame:
    return encode_column(documents, ["doc_id"], "text", path)
