"""Byte-level BPE: tiktoken with a local rank file, texts in, ids out, and ids back to bytes.

A long text is cut before it is encoded, at places where the pattern's matches end whatever follows: in front of a white
space character that comes after one that is none. No match of the pattern goes from another character into white space,
and the look-ahead behind white space never reaches such a cut, so the pieces' ids in a row are the text's ids.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ships_by_value

ships_by_value(__name__)

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters of a piece, about; a text without white space is one piece.
PIECE = 50_000
#: A rank file is sent to all executors; larger ones than this are refused.
MOST_BYTES = 64_000_000
#: Texts of one Arrow batch that are held encoded at a time.
SOME = 256


def read_file(path: str) -> bytes:
    """A vocabulary file of checked size, read on the driver."""
    with open(path, "rb") as f:
        raw = f.read(MOST_BYTES + 1)
    if len(raw) > MOST_BYTES:
        raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
    return raw


def default_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encoder(raw: bytes, pat: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
    return tiktoken.Encoding("own", pat_str=pat, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> list[str]:
    """The text in pieces that can be encoded on their own."""
    import re

    if len(text) <= size:
        return [text]
    edge, out, at = re.compile(r"(?<=\S)(?=\s)"), [], 0
    while len(text) - at > size:
        m = edge.search(text, at + size)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def encode(enc, text: str) -> list[int]:
    if len(text) <= PIECE:
        return enc.encode_ordinary(text)
    return [x for piece in pieces(text) for x in enc.encode_ordinary(piece)]


def _run(docs: DataFrame, path: str | None, pat: str | None, schema: str, rows: Callable) -> DataFrame:
    """doc_id and rows(encoding, texts) for each row; the rank file goes along as a broadcast of checked size."""
    sent = docs.sparkSession.sparkContext.broadcast((read_file(path or default_path()), pat or pattern()))

    def run(batches):
        import pyarrow as pa

        enc = encoder(*sent.value)
        names = [x.split()[0] for x in schema.split(", ")]
        for whole in batches:
            for k in range(0, whole.num_rows, SOME):
                batch = whole.slice(k, SOME)
                made = rows(enc, [x or "" for x in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, {schema}")


def encode_docs(docs: DataFrame, path: str | None = None, pat: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>) of each row of docs. Null text: no ids. Other columns are ignored; rows may repeat."""

    def rows(enc, texts):
        import pyarrow as pa

        return [pa.array([encode(enc, t) for t in texts], pa.list_(pa.int32()))]

    return _run(docs, path, pat, "ids array<int>", rows)


def decode_docs(ids: DataFrame, path: str | None = None, pat: str | None = None) -> DataFrame:
    """doc_id, bytes (binary) of each row with doc_id, ids. Null ids: no bytes. Unknown ids raise an error."""
    sent = ids.sparkSession.sparkContext.broadcast((read_file(path or default_path()), pat or pattern()))

    def run(batches):
        import pyarrow as pa

        enc = encoder(*sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([enc.decode_bytes(x or []) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    return ids.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str | None = None, pat: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, and ids (array<int>) if asked for: encoded, then decoded.

    Null or empty text: no ids, the digests of nothing. Null doc_ids stay, rows may repeat, other columns are ignored
    whatever their names, and empty docs give an empty result. Texts of any length are encoded whole.
    """

    def rows(enc, texts):
        from hashlib import sha256

        import pyarrow as pa

        out = ([], [], [], [])
        for t in texts:
            ids = encode(enc, t)
            out[0].append(len(ids))
            out[1].append(sha256(str(ids)[1:-1].replace(" ", "").encode()).hexdigest())
            out[2].append(sha256(enc.decode_bytes(ids)).hexdigest())
            if with_ids:
                out[3].append(ids)
        made = [pa.array(out[0], pa.int64()), pa.array(out[1]), pa.array(out[2])]
        return [*made, pa.array(out[3], pa.list_(pa.int32()))] if with_ids else made

    return _run(docs, path, pat, "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""), rows)
