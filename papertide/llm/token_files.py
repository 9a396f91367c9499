"""Token ids in fixed-width bit-packed files, and their reader.

A file holds the documents of one range of ids, in ascending order:

    magic "PTIDS1", bits of an id, ids of a block, a reserved field   (24 bytes)
    blocks: each `block` ids, `bits` bits an id, low bits first, padded to a byte
    block offsets, document starts (both unsigned 64-bit), document ids (Arrow IPC)
    the places of these three, number of ids, number of documents (40 bytes, at the end)

`bits` is the least that the vocabulary needs.  Block offsets give random access: a document's
ids are read from the blocks that hold them and unpacked with numpy.

Executors write into the folder that all share, each attempt under a name of its own; only
files of attempts that succeeded are named in the manifest table, so lost or repeated
tasks do no harm.  Null texts count as empty (the end id alone); null ids sort first; repeated
rows are kept.  Extra columns are ignored.
"""

from __future__ import annotations

import io
import re
import struct
import uuid
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterator
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papertide.llm.shared import new_folder, own, written

MAGIC, BLOCK = b"PTIDS1\0\0", 8_192
_HEAD, _FOOT = struct.Struct("<8sIIQ"), struct.Struct("<QQQQQ")


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flat = ((ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(flat, bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    return (flat.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


class TokenWriter:
    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.held: list[np.ndarray] = []
        self.n_held, self.at, self.offsets, self.starts, self.ids = 0, _HEAD.size, [], [0], []
        out.write(_HEAD.pack(MAGIC, bits, block, 0))

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= 16 * self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        end = len(ids) if last else len(ids) - len(ids) % self.block
        for i in range(0, end, self.block):
            data = pack(ids[i : min(end, i + self.block)], self.bits)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.held, self.n_held = [ids[end:]], len(ids) - end

    def close(self, id_type: pa.DataType) -> int:
        self._flush(True)
        sink = io.BytesIO()
        table = pa.table({"id": pa.array(self.ids, id_type)})
        with pa.ipc.new_file(sink, table.schema) as w:
            w.write_table(table)
        places = []
        for data in (np.array(self.offsets, "<u8").tobytes(), np.array(self.starts, "<u8").tobytes(), sink.getvalue()):
            places.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.out.write(_FOOT.pack(*places, self.starts[-1], len(self.ids)))
        return self.starts[-1]


class TokenReader:
    """Random access: ids(i, j) are the ids at places i to j of the file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        magic, self.bits, self.block, _ = _HEAD.unpack(self._read(0, _HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        a, b, c, self.n_ids, self.n_docs = _FOOT.unpack(self._read(size - _FOOT.size, _FOOT.size))
        self.offsets = np.append(np.frombuffer(self._read(a, b - a), "<u8"), a)
        self.starts = np.frombuffer(self._read(b, c - b), "<u8").astype(np.int64)
        self.doc_ids = pa.ipc.open_file(self._read(c, size - _FOOT.size - c)).read_all().column("id").combine_chunks()

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def ids(self, i: int, j: int) -> np.ndarray:
        if i >= j:
            return np.zeros(0, np.uint32)
        first, last = i // self.block, (j - 1) // self.block
        base = int(self.offsets[first])
        data = self._read(base, int(self.offsets[last + 1]) - base)
        n = min(self.n_ids, (last + 1) * self.block) - first * self.block
        whole = self.block * self.bits // 8
        if self.block * self.bits % 8 == 0:
            out = unpack(data, self.bits, n)
        else:
            whole = -(-self.block * self.bits // 8)
            parts = [data[k : k + whole] for k in range(0, len(data), whole)]
            out = np.concatenate([unpack(p, self.bits, min(self.block, n - k * self.block)) for k, p in enumerate(parts)])
        return out[i - first * self.block : j - first * self.block]


# The split pattern of byte-level tokenizers, and how they show bytes as characters (printable ones as themselves).
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = sorted({*range(256)} - {*_PRINTED})
_SHOWN = "".join(chr(256 + _OTHERS.index(b)) if b in _OTHERS else chr(b) for b in range(256))
_ID, _PACKS = attrgetter("id"), [struct.Struct(f"={n}I").pack for n in range(32)]


class _Cache(dict):
    """Ids, as packed bytes, of pieces of text that the pre-tokenizer never joins with what stands beside them.

    `limit` pieces make a generation.  Of the one before, those that come again are taken over, so that common pieces stay
    while those that came once go.
    """

    def __init__(self, encode, limit: int):
        self.encode, self.limit, self.old = encode, max(1, limit), {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = self.encode(piece)
            if len(piece) >= 64:
                return found
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found


class Encoder:
    """The tokenizers library, applied once to each distinct piece.

    A blank after a character that is not white space always begins a new match of the byte-level
    pre-tokenizer, so the text can be cut before it.  A line feed between two such characters is a match of its own, so the
    text can be cut before and after it.
    """

    #: White space, or a blank, after other white space: such texts are cut more carefully.
    _RUN, _UNSAFE, _SAFE = re.compile(r"\s\s"), re.compile(r"\s "), re.compile(r"(?<=\S)(?= )")

    def __init__(self, path: str, pieces: int = 400_000, added: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.normalizer is not None:
            raise ValueError("a tokenizer with a normalizer may join pieces")
        contents = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self._added = re.compile("|".join(map(re.escape, contents))) if contents else None
        self.n_vocab = self.tokenizer.get_vocab_size()
        self.bits = max(1, (self.n_vocab - 1).bit_length())
        pre = self.tokenizer.pre_tokenizer
        self._tokenize, self._pre_tokenize = self.tokenizer.model.tokenize, pre.pre_tokenize_str
        self._byte_level = type(pre).__name__ == "ByteLevel" and pre.use_regex and not pre.add_prefix_space
        self._plain, self._after_blank, self._tokens = _Cache(self._piece, pieces // 4), _Cache(self._blank_piece, pieces), _Cache(self._token, pieces // 4)

    def _blank_piece(self, word: str) -> bytes:
        """The ids of a blank and word."""
        if self._byte_level and word.isascii():
            if word.isalpha():
                return self._ids("Ġ" + word)
            if word[:-1].isalpha() and word[-1] in ".,;:!?":  # the commonest case, and never a contraction
                return self._after_blank[word[:-1]] + self._tokens[word[-1]]
        return self._piece(" " + word)

    def _piece(self, text: str) -> bytes:
        """The library splits what may hold letters that tables of characters disagree on; the rest is split here."""
        if not self._byte_level or (not text.isascii() and max(text) >= "ɐ"):
            return b"".join([self._ids(p) for p, _ in self._pre_tokenize(text)])
        word = text[1:] if text[:1] == " " else text
        if word.isalpha():
            return self._token(text)
        if word[:-1].isalpha() and word[-1] in ".,;:!?":
            return self._after_blank[word[:-1]] + self._tokens[word[-1]] if word is not text else self._plain[word[:-1]] + self._tokens[word[-1]]
        return b"".join([self._tokens[t] for t in _SPLIT.findall(text)])

    def _token(self, text: str) -> bytes:
        return self._ids(text if text.isascii() and text.isalpha() else charmap_decode(text.encode(), "strict", _SHOWN)[0])

    def _ids(self, shown: str) -> bytes:
        tokens = self._tokenize(shown)
        return _PACKS[len(tokens)](*map(_ID, tokens)) if len(tokens) < len(_PACKS) else array("I", map(_ID, tokens)).tobytes()

    def _line(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        return self._plain[first] + b"".join(map(self._after_blank.__getitem__, rest))

    def encode(self, text: str) -> np.ndarray:
        if self._added is not None and self._added.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        if self._byte_level and not self._RUN.search(text):
            data = self._plain["\n"].join(map(self._line, text.split("\n")))
        elif self._UNSAFE.search(text):
            data = b"".join(map(self._plain.__getitem__, self._SAFE.split(text)))
        else:
            data = self._line(text)
        return np.frombuffer(data, "<u4")


@lru_cache(maxsize=2)
def encoder(path: str, added: bool = False) -> Encoder:
    return Encoder(path, added=added)


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_files(df: DataFrame, tokenizer_file: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, added: bool = False) -> DataFrame:
    """Writes the files and returns their manifest (part, file, n_ids, n_docs); added: contents of added tokens in texts become these, as by the library's defaults."""
    folder = folder or new_folder(df.sparkSession, "tokens")
    rows = own(df, doc_id=id_col, text=F.coalesce(F.col(text_col), F.lit(""))).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = next(batches, None)
        while batch is not None and batch.num_rows == 0:
            batch = next(batches, None)
        if batch is None:
            return
        fs, base = open_folder(folder)
        fs.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"{base}/part-{part:06d}-{uuid.uuid4().hex}.ids"
        enc = encoder(tokenizer_file, added)
        end = np.array([end_id], np.uint32)
        id_type = batch.column(0).type
        with fs.open_output_stream(name) as out:
            writer = TokenWriter(out, enc.bits)
            while batch is not None:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    writer.add(doc_id, np.concatenate([enc.encode(text.as_py()), end]))
                batch = next(batches, None)
            n = writer.close(id_type)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([n], pa.int64()), pa.array([len(writer.ids)], pa.int64())], ["part", "file", "n_ids", "n_docs"])

    found = written(rows.mapInArrow(run, "part int, file string, n_ids long, n_docs long"), "manifest")
    return found.withColumn("root", F.lit(folder))


def read_files(manifest: DataFrame, id_type: str = "long", id_col: str = "doc_id", batch_docs: int = 2_000) -> DataFrame:
    """Rows (id_col, start, n_tokens, ids_crc32) in files of a manifest; start counts the ids of all documents before.

    The running sum is over one row a file.
    """
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("root", "file", before.alias("base"))
    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, _ = open_folder(row["root"])
                with fs.open_input_file(row["file"]) as source:
                    yield from digests(TokenReader(source), row["base"])

    def digests(reader: TokenReader, base: int) -> Iterator[pa.RecordBatch]:
        for i in range(0, reader.n_docs, batch_docs):
            j = min(reader.n_docs, i + batch_docs)
            s = reader.starts[i : j + 1]
            ids = reader.ids(int(s[0]), int(s[-1])).astype("<u4")
            crc = [zlib.crc32(ids[a - s[0] : b - s[0]].tobytes()) for a, b in zip(s[:-1].tolist(), s[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([reader.doc_ids.slice(i, j - i), pa.array(s[:-1] + base), pa.array(np.diff(s)), pa.array(crc, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])

    return files.repartition(n).mapInArrow(run, f"{id_col} {id_type}, start long, n_tokens long, ids_crc32 long")
