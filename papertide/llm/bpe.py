"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut at safe boundaries before they are encoded: a blank or line
feed that follows a letter.  A match of the split pattern that holds a letter never
runs on into white space, and each match depends only on what stands from its
start on, so the pieces together give exactly the ids of the whole text.  A text
without such a place stays whole.

Null texts count as empty; an empty text has no ids.  Repeated rows give repeated
rows.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from papertide.llm.shared import own


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """One per process and rank file."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, limit: int) -> Iterator[str]:
    """The text in pieces of about `limit` characters, cut only where a match must end."""
    begin = 0
    while len(text) - begin > limit:
        at = begin + limit
        while at < len(text) and not (text[at] in " \n" and text[at - 1].isalpha()):
            at += 1
        yield text[begin:at]
        begin = at
    yield text[begin:]


def encode_text(text: str, enc, limit: int = 65_536) -> list[int]:
    if len(text) <= limit:
        return enc.encode_ordinary(text)
    return [i for piece in safe_pieces(text, limit) for i in enc.encode_ordinary(piece)]


def encode_decode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", piece_chars: int = 65_536, keep_ids: bool = True) -> DataFrame:
    """Rows (id_col, n_tokens, ids, decoded, ids_sha256, decoded_sha256); ids and decoded only with keep_ids.

    `decoded` holds the raw bytes of the ids, so it needs no valid UTF-8.
    """
    rows = own(df, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded binary" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        digits = [b"%d" % i for i in range(enc.n_vocab)]
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n", "a", "b", "ids", "bytes")}
            for value in batch.column(1):
                ids = encode_text(value.as_py() or "", enc, piece_chars)
                raw = enc.decode_bytes(ids)
                out["n"].append(len(ids))
                out["a"].append(hashlib.sha256(b",".join([digits[i] for i in ids])).hexdigest())
                out["b"].append(hashlib.sha256(raw).hexdigest())
                if keep_ids:
                    out["ids"].append(ids)
                    out["bytes"].append(raw)
            columns = [batch.column(0), pa.array(out["n"], pa.int64()), pa.array(out["a"], pa.string()), pa.array(out["b"], pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns += [pa.array(out["ids"], pa.list_(pa.int32())), pa.array(out["bytes"], pa.binary())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema)
