"""Byte-level BPE encoding and decoding over Arrow batches, with the tokenizers library.

Bytes are mapped to printable characters as byte-level vocabularies have them, the text is
cut by the vocabulary's pattern, and each distinct piece is encoded once per worker (a
bounded cache; a miss only costs time). Decoding reverses the byte table, so characters
whose bytes lie in two tokens come back whole, because bytes are joined before UTF-8 is read.

Nulls encode as the empty text (no ids, empty bytes). Texts of any length are taken whole.
Rows are independent: ties and repeated rows stay as they are, empty tables give none, and
further columns pass through unless they carry the name of a result column, which wins.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, by_value, quoted

by_value(__name__)

#: Pieces and space-delimited runs that a worker remembers; the rest is encoded anew.
CACHE = 300_000
_CODECS: dict = {}


def byte_alphabet() -> list[str]:
    """The character for each byte: itself where printable, else the next from U+0100."""
    from tokenizers import pre_tokenizers

    chars = sorted(pre_tokenizers.ByteLevel.alphabet(), key=ord)
    table = {ord(c): c for c in chars if ord(c) < 256}
    rest = iter(c for c in chars if ord(c) >= 256)
    return [table.get(b) or next(rest) for b in range(256)]


class Codec:
    """Encodes and decodes by a rank file, as its byte-level BPE defines."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer, models

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        alphabet = byte_alphabet()
        self.to_char = dict(enumerate(alphabet))
        self.to_byte = {c: b for b, c in enumerate(alphabet)}
        shown = lambda b: b.decode("latin-1").translate(self.to_char)
        # Any two neighbours whose bytes together are a token may merge, the lowest rank first:
        # every split of a token into two tokens is a merge, in the order of the tokens' ranks.
        merges = [
            (shown(t[:i]), shown(t[i:]))
            for t, _ in sorted(ranks.items(), key=itemgetter(1))
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        ]
        vocab = {shown(t): r for t, r in ranks.items()}
        self.model = Tokenizer(models.BPE(vocab, merges, ignore_merges=True)).model
        self.token_bytes = {r: bytes(self.to_byte[c] for c in t) for t, r in vocab.items()}
        self.find = regex.compile(pattern).findall
        self.pieces: dict[str, tuple] = {}
        self.runs: dict[str, tuple] = {}

    def piece(self, piece: str) -> tuple:
        """Ids of one match of the pattern."""
        ids = self.pieces.get(piece)
        if ids is None:
            mapped = piece.encode().decode("latin-1").translate(self.to_char)
            ids = tuple(t.id for t in self.model.tokenize(mapped))
            if len(self.pieces) < CACHE and len(piece) < 100:
                self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.piece, self.find(text))))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def offsets(self, text: str, ids: list[int]) -> list[tuple[int, int]]:
        """Characters [start, end) that each token touches; a split character counts for all its tokens."""
        starts, at = [], 0
        for n, c in enumerate(text):
            starts += [n] * len(c.encode())
        out = []
        for i in ids:
            size = len(self.token_bytes[i])
            out.append((starts[at], starts[at + size - 1] + 1))
            at += size
        return out

    def run(self, run: str) -> tuple[str, bytes]:
        """Ids of a run as decimal text with a space before each, and the bytes those ids decode to."""
        found = self.runs.get(run)
        if found is None:
            ids = self.encode(run)
            found = "".join([f" {i}" for i in ids]), self.decode(ids)
            if len(self.runs) < CACHE and len(run) < 100:
                self.runs[run] = found
        return found

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids in decimal joined by a space, and of the decoded bytes.

        A space before a character that isn't white space always starts a match, so a text is
        cut there first; a text in which white space follows a space is matched whole.
        """
        cut = text.split(" ")
        if any(not c or c[0].isspace() for c in cut[1:]):
            cut = self.find(text)
            done = list(map(self.run, cut))
        else:
            done = list(map(self.run, [cut[0], *[" " + c for c in cut[1:]]]))
        ids = "".join([d[0] for d in done])
        decoded = b"".join([d[1] for d in done])
        return ids.count(" "), hashlib.sha256(ids[1:].encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a vocabulary: built once, kept between batches."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _mapped(df: DataFrame, text_col: str, fields: list[tuple[str, str, pa.DataType]], row) -> DataFrame:
    """df with columns computed from each text by row(text), in Arrow batches."""
    keep = [c for c in df.columns if c not in [f[0] for f in fields]]

    def work(batches):
        for batch in batches:
            done = [row(t) for t in batch.column(len(keep)).to_pylist()]
            columns = list(zip(*done, strict=True)) if done else [[] for _ in fields]
            yield batch, [pa.array(c, f[2]) for c, f in zip(columns, fields, strict=True)]

    return arrow_map(df, keep, [F.coalesce(quoted(text_col), F.lit(""))], [f[:2] for f in fields], work)


def bpe_encode(df: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Adds `ids` (array of int) and `offsets` (array of [start, end) in characters) for each text."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def row(text):
        ids = codec(path, pattern).encode(text)
        return ids, [{"start": a, "end": b} for a, b in codec(path, pattern).offsets(text, ids)]

    fields = [("ids", "array<int>", pa.list_(pa.int32())), ("offsets", "array<struct<start:int,end:int>>", span)]
    return _mapped(df, text_col, fields, row)


def bpe_decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Adds `decoded` (binary): the bytes of the ids; null ids give empty bytes, an unknown id fails."""
    keep = [c for c in df.columns if c != "decoded"]

    def work(batches):
        for batch in batches:
            yield batch, [pa.array([codec(path, pattern).decode(ids or ()) for ids in batch.column(len(keep)).to_pylist()], pa.binary())]

    return arrow_map(df, keep, [quoted(ids_col)], [("decoded", "binary")], work)


def bpe_digest(df: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Encodes and decodes each whole text; adds `n_tokens`, `ids_sha256` and `decoded_sha256`."""
    fields = [("n_tokens", "bigint", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    return _mapped(df, text_col, fields, lambda text: codec(path, pattern).digest(text))
