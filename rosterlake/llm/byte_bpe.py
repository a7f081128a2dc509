"""Byte-level BPE: texts to token ids by the tiktoken library and a local file of ranks, and ids back to raw bytes.

The library searches a whole text with the split pattern and merges each match by itself. A long text is first cut where no
match of the pattern can reach across, so that a task holds the tokens of one part at a time; the parts' ids in a row are the
ids of the whole. Ids travel as bytes, four little-endian ones an id.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_batches

#: The vocabulary's own split pattern (fixed value of the public tokenizer) and the place of its file of ranks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Bytes of a file of ranks that is sent to the tasks.
MOST_RANK_BYTES = 64 << 20

_PART = 1 << 18  # characters that are encoded at once, where the text allows a cut
_RUN = 1 << 10  # white space from this length on is encoded apart
_DECODED = 1 << 16  # ids that are decoded at once

_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LONG_RUN = re.compile(rf"{_SPACE}{{{_RUN},}}")
#: Letters of widely used scripts, and marks that are neither letters nor numbers nor white space, in every version of Unicode.
_LETTER = r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u0410-\u044f\u0621-\u063a\u0e01-\u0e30\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]"
_MARK = r"[!-/:-@\[-`{-~\u3001\u3002\u300c\u300d\uff01\uff08\uff09\uff0c\uff0e\uff1a\uff1b\uff1f]"
#: No match of the pattern holds white space after anything else, nor a letter followed by a mark.
_CUT = re.compile(rf"(?<!{_SPACE})(?={_SPACE})|(?<={_LETTER})(?={_MARK})")


def load_encoding(ranks: bytes, pattern: str = PATTERN):
    """The library's encoding of the content of a file of ranks (a line each: token in base 64, rank), without special tokens."""
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line.strip())
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


_encodings: dict[tuple[str, str], object] = {}


def _parts(text: str):
    """text in parts, cut only where no match of the pattern reaches across."""
    a = 0
    while len(text) - a > _PART:
        cut = _CUT.search(text, a + _PART)
        if cut is None:
            break
        yield text[a : cut.start()]
        a = cut.start()
    yield text[a:]


class Codec:
    """Encoder and decoder over the content of a file of ranks; a process makes each encoding once."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN) -> None:
        self.ranks, self.pattern, self.name = ranks, pattern, hashlib.sha256(ranks).hexdigest()

    @classmethod
    def read(cls, path: str, pattern: str = PATTERN) -> Codec:
        with open(path, "rb") as f:
            return cls(f.read(), pattern)

    def _encoding(self, pattern: str):
        if (self.name, pattern) not in _encodings:
            _encodings[self.name, pattern] = load_encoding(self.ranks, pattern)
        return _encodings[self.name, pattern]

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids of a text, null as the empty one; strings of special tokens are ordinary text.

        For the split pattern above: it takes a run of white space whole at the end of a text, and else but for its last
        character, which goes with what follows. Long runs are too deep for the pattern's own search, so they are cut out by
        this rule and encoded as the one piece that they are. What stands between runs is encoded in parts. Any other pattern
        is searched over the whole text.
        """
        plain, text = self._encoding(self.pattern), text or ""
        if len(text) < _RUN or self.pattern != PATTERN:
            return np.asarray(plain.encode_ordinary(text), dtype="<u4")
        whole, out, a = self._encoding("(?s:.+)"), [], 0
        for run in _LONG_RUN.finditer(text):
            stop = run.end() - (run.end() < len(text))
            out += [np.asarray(plain.encode_ordinary(p), dtype="<u4") for p in _parts(text[a : run.start()])]
            out.append(np.asarray(whole.encode_ordinary(text[run.start() : stop]), dtype="<u4"))
            a = stop
        out += [np.asarray(plain.encode_ordinary(p), dtype="<u4") for p in _parts(text[a:])]
        return np.concatenate(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for, whether or not they are valid UTF-8; an id without a token raises an error."""
        plain = self._encoding(self.pattern)
        try:
            return b"".join(plain.decode_bytes(ids[a : a + _DECODED].tolist()) for a in range(0, len(ids), _DECODED))
        except KeyError as unknown:
            raise ValueError(f"no token has the id {unknown}") from unknown


def send_codec(spark: SparkSession, ranks_path: str, pattern: str = PATTERN):
    """The file of ranks, read by the driver and sent to the tasks, so that executors need no copy of it. At most MOST_RANK_BYTES."""
    codec = Codec.read(ranks_path, pattern)
    if len(codec.ranks) > MOST_RANK_BYTES:
        raise ValueError(f"{ranks_path} holds over {MOST_RANK_BYTES} bytes")
    return spark.sparkContext.broadcast(codec)


def _other(df: DataFrame, keep: list[str] | None, gone: str, out: str) -> list[str]:
    """The columns that stay beside the new one."""
    return [c for c in (df.columns if keep is None else keep) if c.lower() not in (gone.lower(), out.lower())]


def encode_texts(docs: DataFrame, *, text: str = "text", out: str = "ids", keep: list[str] | None = None, ranks_path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """docs with out (binary, four little-endian bytes a token id) in place of text.

    keep names the columns that stay (all others by default; a column named like out is replaced). Texts are encoded whole,
    of any length; null and empty texts have no ids; repeated rows stay; an empty table gives an empty result.
    """
    text_batches(docs.sparkSession)
    sent, names = send_codec(docs.sparkSession, ranks_path, pattern), _other(docs, keep, text, out)
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col(text).cast("string").alias(out))

    def encode(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                ids = [sent.value.encode(t.as_py()).tobytes() for t in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, pa.binary())], names=part.schema.names)

    return rows.mapInArrow(encode, rows.drop(out).withColumn(out, F.lit(b"")).schema)


def decode_ids(docs: DataFrame, *, ids: str = "ids", out: str = "bytes", keep: list[str] | None = None, ranks_path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """docs with out (binary) in place of ids, as encode_texts writes them: the raw bytes, valid UTF-8 or not.

    keep names the columns that stay (all by default, ids too if named there). Null ids give null, no ids no bytes; an id without a token raises an error.
    """
    text_batches(docs.sparkSession)
    sent, names = send_codec(docs.sparkSession, ranks_path, pattern), [c for c in (docs.columns if keep is None else keep) if c.lower() != out.lower()]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col(ids).alias(out))

    def decode(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                found = [None if b is None else sent.value.decode(np.frombuffer(b, dtype="<u4")) for b in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, pa.binary())], names=part.schema.names)

    return rows.mapInArrow(decode, rows.schema)
