"""Language-model scores of whole documents, with counts over the whole corpus.

1. Words of training documents are counted (by 64-bit hash); the commonest become the model's
   vocabulary, the rest share its unknown token.
2. The gated recurrent model of `gated_lm` is trained on all training documents: their ids are written as streams
   (shards), dealt by hashes into `rounds`.  In a round each of its shards trains on from the same parameters, and what
   they come to is averaged by their numbers of tokens; an epoch is all rounds.
3. One pass scores every document by the model, and lists its words outside the vocabulary for the shards
   of their hashes; each shard counts its words over all training documents and
   returns a sum for each document.  No shard holds a common word: those are all in the vocabulary.

The score adds, for each unknown token, the log10 of (c+1)/(M+D+1): c the word's count, M and D all and distinct
training tokens outside the vocabulary; so the probabilities of all words add up to 1.  The end of a document is one
token.  Null or empty texts have the end token alone.  A null id counts as the text "".
Repeated rows give repeated rows.  Extra columns are ignored.  A very long text is scored to its end, its state carried
through all windows; it is one row, held by one task.  Words of equal count get ranks by their hashes.  An empty table gives
no rows; without training documents every word is unknown, priced alike.
"""

from __future__ import annotations

import gc
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertide.llm.gated_lm import GatedModel
from papertide.llm.shared import new_folder, own, written
from papertide.llm.words import Chunk, chunks

UNKNOWN, END = 0, 1
#: Bytes of text that are hashed at once: arrays of eight bytes for each stay in the cache.
CHUNK = 60_000
#: Hashes of training words that are counted at once, about.
COUNTED = 1 << 19
#: First bits of the hashes by which counts are dealt.
DEALT = 10
#: Bytes of text that are scored together; a longer text stands alone.
GROUP = 16_000_000
#: Training tokens outside the vocabulary that a shard of the corpus counts looks up, about.
SHARD = 1 << 20
#: Streams that a training task takes one after the other, about; they come in one batch.
SHARDS = 16
_END_HASH = np.uint64(0x8000000000000001)


def is_held_out(doc_id, folds: int = 7, fold: int = 2) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or b"").lower() for t in batch.column(1).cast(pa.binary()).to_pylist()]


def _added(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of hashes and counts -> the distinct hashes, ascending, and their counts added up."""
    h, n = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    order = np.argsort(h)
    h = h[order]
    begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    return h[begin], np.add.reduceat(n[order], begin)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t for t, i in zip(_texts(batch), batch.column(0).to_pylist(), strict=True) if not is_held_out(i)]
        found, held, size = [], [], 0
        for a, b in chunks(texts, CHUNK):
            held.append(Chunk(texts[a:b]).hashes())
            size += len(held[-1])
            if size > COUNTED or b == len(texts):
                found.append(np.unique(np.concatenate(held), return_counts=True))
                held, size = [], 0
        if texts:
            h, n = _added([*found, (np.array([_END_HASH]), np.array([len(texts)]))])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "c"])


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (shard, words, counts): hashes of training words and their numbers, packed in a row for each run of equal first bits; a row a word would cost more than counting does."""
    edges = np.arange(1, 1 << DEALT, dtype=np.uint64) << np.uint64(64 - DEALT)
    for batch in _count(batches):
        h, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
        cuts = [0, *np.searchsorted(h, edges).tolist(), len(h)]
        rows = [(s, i, j) for s, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in rows], pa.int32()), *(pa.array([x[i:j].tobytes() for _, i, j in rows], pa.binary()) for x in (h, n))], ["shard", "words", "counts"])


def _commonest(most: int):
    """Rows of _dealt sorted by shard -> (h, c, tokens, words, ends): the `most` commonest words of a task, ties by hash, and at last a row without h: all tokens, distinct words and ends, both with the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = words = ends = 0
        top = np.zeros((2, 0), np.int64)

        def close(h: np.ndarray, n: np.ndarray) -> None:
            nonlocal tokens, words, ends, top
            tokens, words, ends = tokens + int(n.sum()), words + len(h), ends + int(n[h == _END_HASH].sum())
            top = np.concatenate([top, np.stack([h.view(np.int64), n])[:, h != _END_HASH]], axis=1)
            top = top[:, np.lexsort((top[0], -top[1]))[:most]]

        now, held, size = None, [], 0
        for batch in batches:
            for shard, *packed in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if held and shard != now:
                    close(*_added(held))
                    held, size = [], 0
                now = shard
                held.append(tuple(np.frombuffer(x.as_buffer(), kind) for x, kind in zip(packed, (np.uint64, np.int64), strict=True)))
                size += len(held[-1][0])
                if size > max(COUNTED, len(held[0][0])):  # a word that many batches have is held once
                    held, size = [_added(held)], 0
        if held:
            close(*_added(held))
            k, last = top.shape[1], pa.nulls(top.shape[1], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(top[0]), pa.array(top[1]), last, last, last] if k else [pa.array([], pa.int64())] * 5, ["h", "c", "tokens", "words", "ends"])
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (None, None, tokens, words, ends)], ["h", "c", "tokens", "words", "ends"])

    return run


class Vocabulary:
    """Ids of hashes: UNKNOWN, END, then words, commonest first."""

    def __init__(self, top: list[tuple[int, int]], end_count: int):
        self.hashes = np.array([0, 0, *(h for h, _ in top)], np.int64).view(np.uint64)
        self.counts = np.array([0, end_count, *(c for _, c in top)], np.float64)
        self.size = len(self.counts)
        self.small = np.uint16 if self.size <= 1 << 16 else np.uint32
        self._table: tuple[np.uint64, np.uint64, np.ndarray, np.ndarray] | None = None  # made where it is asked for: tasks are sent without it

    def of(self, h: np.ndarray) -> np.ndarray:
        if self._table is None:
            self._table = self._slots()
        shift, mask, table, others = self._table
        ids = table[((h >> shift) & mask).view(np.int64)]
        missed = self.hashes[ids] != h
        ids[missed] = UNKNOWN
        if len(others):
            missed = np.flatnonzero(missed)
            found = others[np.minimum(np.searchsorted(self.hashes[others], h[missed]), len(others) - 1)]
            ids[missed] = np.where(self.hashes[found] == h[missed], found, UNKNOWN)
        return ids

    def _slots(self) -> tuple[np.uint64, np.uint64, np.ndarray, np.ndarray]:
        """Some bits of a hash are the place of its id in a table, bits that tell all hashes apart if there are such; the ids without a place, by hash."""
        bits = min(22, max(18, 8 + self.size.bit_length()))
        mask, words, every = np.uint64((1 << bits) - 1), self.hashes[2:], np.arange(2, self.size).astype(self.small)
        for shift in np.arange(65 - bits, dtype=np.uint64):
            slots, which = np.unique((words >> shift) & mask, return_index=True)
            if len(slots) == len(words):
                break
        table = np.zeros(1 << bits, self.small)
        table[slots.astype(np.int64)] = every[which]
        others = np.delete(every, which)
        return shift, mask, table, others[np.argsort(self.hashes[others])]


def _score(vocabulary: Vocabulary, model: GatedModel, shards: int):
    bits = np.uint64(64 - (shards - 1).bit_length())
    names = ["kind", "batch", "shard", "idx", "doc_id", "held_out", "n_tokens", "n_top", "top_sum", "model", "words", "docs", "counts", "train"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch)
            for a, b in chunks(texts, GROUP):
                yield from one(texts[a:b], batch.column(0).slice(a, b - a))

    def one(texts: list[bytes], ids: pa.Array) -> Iterator[pa.RecordBatch]:
        held = np.array([is_held_out(i) for i in ids.to_pylist()])
        key = hashlib.md5(b"\0".join([*texts, *(str(i).encode() for i in ids.to_pylist())])).digest()
        n_tokens, n_top = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        top_sum = np.zeros(len(texts))
        rare_h, rare_doc, sequences = [], [], []
        small = vocabulary.small
        for a, b in chunks(texts, CHUNK):
            chunk = Chunk(texts[a:b])
            h, owner = chunk.hashes(), chunk.text_of_word()
            v = vocabulary.of(h)
            known = v != UNKNOWN
            n_tokens[a:b] = chunk.hi - chunk.lo + 1
            n_top[a:b] = np.bincount(owner[known], minlength=b - a) + (vocabulary.counts[END] > 0)
            top_sum[a:b] = np.bincount(owner[known], np.log10(vocabulary.counts[v[known]] + 1), b - a) + np.log10(vocabulary.counts[END] + 1)
            sequences += [np.append(v[i:j], small(END)) for i, j in zip(chunk.lo.tolist(), chunk.hi.tolist(), strict=True)]
            rare_h.append(h[~known])
            rare_doc.append(owner[~known] + a)
        n, scores = len(texts), model.score(sequences)  # all of a group together, so that texts of like length share windows
        del sequences
        none, blank = pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(["doc"] * n), pa.array([key] * n), blank, pa.array(np.arange(n, dtype=np.int32)), ids, pa.array(held), pa.array(n_tokens), pa.array(n_top), pa.array(top_sum), pa.array(scores), none, none, none, none], names)
        h, doc = np.concatenate(rare_h), np.concatenate(rare_doc).astype(np.uint32)
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(h))).astype(np.uint32)
        h, doc = h[first], doc[first]
        shard = (h >> bits).astype(np.int32) if shards > 1 else np.zeros(len(h), np.int32)
        cuts = np.searchsorted(shard, np.arange(shards + 1))
        rows = [(s, i, j) for s, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if j > i]
        if rows:
            packed = lambda x: pa.array([x[i:j].tobytes() for _, i, j in rows], pa.binary())
            m, train = len(rows), np.packbits(~held).tobytes()
            null = lambda kind: pa.nulls(m, kind)
            yield pa.RecordBatch.from_arrays([pa.array(["words"] * m), pa.array([key] * m), pa.array([s for s, _, _ in rows], pa.int32()), pa.array([n] * m, pa.int32()), null(ids.type), null(pa.bool_()), null(pa.int64()), null(pa.int64()), null(pa.float64()), null(pa.float64()), packed(h), packed(doc), packed(count), pa.array([train] * m, pa.binary())], names)

    return run


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard -> for each batch in the shard the sums of its documents."""

    def shard(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        parts = [(np.frombuffer(r["words"], np.uint64), np.frombuffer(r["docs"], np.uint32), np.frombuffer(r["counts"], np.uint32), np.unpackbits(np.frombuffer(r["train"], np.uint8)).astype(bool)) for r in rows]
        h, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([p[2] * p[3][p[1]] for p in parts]), len(h))
        logs, at, out = np.log10(total + 1), 0, []
        for r, (_, doc, count, _) in zip(rows, parts, strict=True):
            k = inverse[at : at + len(doc)]
            at += len(doc)
            n = r["idx"]
            out.append((r["batch"], np.bincount(doc, count * (total[k] > 0), n).astype(np.int64).tobytes(), np.bincount(doc, count * logs[k], n).tobytes()))
        a, b, c = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (a, b, c)], ["batch", "known", "sums"])

    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["shard"] != held[0]["shard"]:
                yield from shard(held)
                held = []
            held.append(row)
    if held:
        yield from shard(held)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by batch -> (batch, idx, known, rare_sum)."""

    def close(key: bytes, known: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key] * len(known), pa.binary()), pa.array(np.arange(len(known), dtype=np.int32)), pa.array(known), pa.array(sums)], ["batch", "idx", "known", "rare_sum"])

    key, known, sums = None, None, None
    for batch in batches:
        for row in batch.to_pylist():
            k, s = np.frombuffer(row["known"], np.int64), np.frombuffer(row["sums"])
            if row["batch"] == key:
                known, sums = known + k, sums + s
            else:
                if key is not None:
                    yield close(key, known, sums)
                key, known, sums = row["batch"], k, s
    if key is not None:
        yield close(key, known, sums)


def _sequences(vocabulary: Vocabulary):
    """(lot, key, text) -> (lot, key, ids): the ids of the words and the end."""
    small = vocabulary.small

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or b"").lower() for t in batch.column(2).cast(pa.binary()).to_pylist()]
            ids: list[bytes] = []
            for a, b in chunks(texts, CHUNK):
                chunk = Chunk(texts[a:b])
                v = vocabulary.of(chunk.hashes())
                ids += [np.append(v[i:j], small(END)).tobytes() for i, j in zip(chunk.lo.tolist(), chunk.hi.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["lot", "key", "ids"])

    return run


def _streams(rounds: int):
    """Rows sorted by lot -> (round, shard, stream): a row for each lot."""

    def close(lot: int, held: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lot // rounds], pa.int32()), pa.array([b"".join(held)], pa.binary()), pa.array([lot % rounds], pa.int32())], ["shard", "stream", "round"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for lot, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and lot != now:
                    yield close(now, held)
                    held = []
                now = lot
                held.append(ids)
        if held:
            yield close(now, held)

    return run


def training_streams(rows: DataFrame, words: Vocabulary, shards: int, rounds: int) -> DataFrame:
    """(shard, stream, round): the ids of all training documents of rows (doc_id, text), each document whole in one stream."""
    train = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) != 2
    key = F.xxhash64("doc_id", "text")
    dealt = rows.where(train).select(F.pmod(key, F.lit(shards * rounds)).cast("int").alias("lot"), key.alias("key"), "text")
    listed = dealt.mapInArrow(_sequences(words), "lot int, key long, ids binary").repartition("lot").sortWithinPartitions("lot", "key", "ids")
    streams = listed.select("lot", "ids").mapInArrow(_streams(rounds), "shard int, stream binary, round int")
    path = new_folder(rows.sparkSession, "streams")
    streams.write.partitionBy("round").parquet(path)
    return rows.sparkSession.read.schema(streams.schema).parquet(path)


def _train(model: GatedModel, rate: float, pieces: int):
    """(shard, stream) -> (piece, shard, weight, part): the flat parameters after one pass over the stream, in pieces."""
    small = np.uint16 if model.n_vocab <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not gc.get_freeze_count():  # PySpark collects garbage after each task of a worker, 30 ms for what modules hold
            gc.freeze()
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                stream = np.append(small(END), np.frombuffer(data.as_buffer(), small))
                mine = GatedModel(model.n_vocab, model.hidden, p=dict(model.p))  # train() works on a copy
                mine.train(stream, 1, rows=int(np.clip(len(stream) // 1_024, 8, 256)), rate=rate)
                parts = np.array_split(mine.flat(), pieces)
                yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int32()), pa.array([shard] * pieces, pa.int32()), pa.array([len(stream) - 1] * pieces, pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], ["piece", "shard", "weight", "part"])

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by piece and shard -> (piece, part): the means of the pieces by weight."""
    now, total, weight = None, None, 0
    close = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], ["piece", "part"])
    for batch in batches:
        for row in batch.to_pylist():
            x = np.frombuffer(row["part"], np.float32).astype(np.float64) * row["weight"]
            if row["piece"] == now:
                total, weight = total + x, weight + row["weight"]
            else:
                if now is not None:
                    yield close()
                now, total, weight = row["piece"], x, row["weight"]
    if now is not None:
        yield close()


def training_tasks(shards: int, cores: int) -> int:
    """A task in a Python worker has about 50 ms of its own: four a core are enough to share the work out, but none has more than about SHARDS streams."""
    return min(shards, max(4 * cores, -(-shards // SHARDS)))


def trained(rows: DataFrame, words: Vocabulary, train_tokens: int, hidden: int, epochs: int, rounds: int = 4, shard_tokens: int = 1 << 18, pieces: int = 8) -> GatedModel:
    """The model after `epochs` over all training documents of rows (doc_id, text)."""
    model = GatedModel(words.size, hidden)
    shards = max(1, -(-train_tokens // (rounds * shard_tokens)))
    streams = training_streams(rows, words, shards, rounds)
    tasks = training_tasks(shards, rows.sparkSession.sparkContext.defaultParallelism)
    for k in range(epochs * rounds):
        each = streams.where(F.col("round") == k % rounds).select("shard", "stream").repartition(tasks).mapInArrow(_train(model, 0.01 / (1 + k / rounds), pieces), "piece int, shard int, weight long, part binary")
        found = each.repartition(pieces, "piece").sortWithinPartitions("piece", "shard").mapInArrow(_average, "piece int, part binary").collect()
        if found:  # a round of a small table may have no documents
            model.set_flat(np.concatenate([np.frombuffer(r.part, np.float32) for r in sorted(found, key=lambda r: r.piece)]))
    return model


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = 1_024, hidden: int = 24, epochs: int = 2) -> DataFrame:
    """Rows (id_col, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    spark = df.sparkSession
    rows = own(df, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    dealt = rows.mapInArrow(_dealt, "shard int, words binary, counts binary").repartition("shard").sortWithinPartitions("shard")
    found = written(dealt.mapInArrow(_commonest(vocabulary - 2), "h long, c long, tokens long, words long, ends long"), "counts")
    total, distinct, end = found.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "words", "ends"))).first()
    top = [(r.h, r.c) for r in found.where("h is not null").orderBy(F.desc("c"), "h").limit(vocabulary - 2).collect()]
    words = Vocabulary(top, end)
    rest, rest_distinct = total - int(words.counts.sum()), distinct - len(top) - bool(end)

    model = trained(rows, words, total, hidden, epochs)

    shards = 1 << (max(int(spark.conf.get("spark.sql.shuffle.partitions")), rest // SHARD) - 1).bit_length()
    schema = f"kind string, batch binary, shard int, idx int, doc_id {kind}, held_out boolean, n_tokens long, n_top long, top_sum double, model double, words binary, docs binary, counts binary, train binary"
    passed = written(rows.mapInArrow(_score(words, model, shards), schema), "scored")
    listed = passed.where("kind = 'words'").select("shard", "batch", "idx", "words", "docs", "counts", "train")
    sums = listed.repartition("shard").sortWithinPartitions("shard").mapInArrow(_look_up, "batch binary, known binary, sums binary")
    sums = sums.repartition("batch").sortWithinPartitions("batch").mapInArrow(_add_up, "batch binary, idx int, known long, rare_sum double")
    # Batches of equal rows have equal keys and equal sums times their number.
    docs = passed.where("kind = 'doc'").select("batch", "idx", "doc_id", "held_out", "n_tokens", "n_top", "top_sum", "model")
    full = docs.join(sums, ["batch", "idx"], "left")
    same = docs.where("idx = 0").groupBy("batch").agg(F.count("*").alias("times"))
    full = full.join(same, "batch")
    known = F.coalesce(F.col("known") / F.col("times"), F.lit(0)).cast("long")
    rare = F.coalesce(F.col("rare_sum") / F.col("times"), F.lit(0.0))
    n_rare = F.col("n_tokens") - F.col("n_top") if end else F.col("n_tokens") - F.col("n_top") - 1
    return full.select(
        F.col("doc_id").alias(id_col), "held_out", "n_tokens", (F.col("n_top") + known).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("top_sum") + rare - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1)))).alias("base_score"),
        (F.col("model") + rare - n_rare * F.lit(float(np.log10(rest + rest_distinct + 1)))).alias("score"),
    )
