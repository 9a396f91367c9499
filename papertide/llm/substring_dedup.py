"""Substring dedup: words covered by windows that also start elsewhere are removed.

Super-k-mer partitioning.  The minimiser of a window is the least hash among its
runs of `m` words; consecutive windows with one minimiser form a super-k-mer, one
packed string that goes to the bucket of that minimiser.  Equal windows have equal
minimisers, so each bucket can count its windows alone: it sorts them by hash and
compares the words of equal hashes.

1. Each text lists its minimisers; minimisers are counted over all texts.
2. A super-k-mer whose minimiser occurs only once holds no repeated window and
   does not travel (prose that is nobody's copy stays where it is).
3. The others travel packed to their buckets.  Buckets of more than `hot` super-k-mers
   (a passage that much of the corpus shares) are not gathered: their windows are
   combined in each task and then counted under 128-bit digests, so that a window
   of any frequency arrives as one row from each task.
4. Covered intervals return to their texts, which drop those words.

Rows are known by an MD5 of id and text.  Null or empty texts, and texts shorter
than a window, lose nothing; a null text has no words.  Repeated rows are separate
documents and cover each other.  Of equal windows none is kept.  A very long text is cut into super-k-mers
like any other; it is one row, held by one task.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertide.llm.shared import CHUNK, own, parts, pieces, row_key, written
from papertide.llm.words import Chunk, sliding_min, windows

#: A minimiser is heavy if it has more than this part of all places of shared minimisers.
HEAVY = 2_000
#: Places of windows of hot buckets that a task combines before they travel, about.
PLACES = 50_000
_SUPER, _WINDOW, _REPEATED, _COVERED = 0, 1, 2, 3
_ROUTED = pa.schema([("route", pa.int64()), ("kind", pa.int8()), ("rid", pa.binary()), ("start", pa.int32()), ("stop", pa.int32()), ("packed", pa.binary())])


def super_kmers(chunk: Chunk, k: int, m: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, text, minimiser, whether it occurs twice) of each super-k-mer; none has more than k-m+1 windows."""
    w = k - m + 1
    if chunk.size < k:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(bool)
    grams = windows(chunk.hashes(), m)
    least = sliding_min(grams, w)
    valid = chunk.window_ok(k)
    begin = valid.copy()
    begin[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    first = np.flatnonzero(begin)
    stop = valid & ~np.append(valid[1:] & (least[1:] == least[:-1]), False)
    last = np.flatnonzero(stop)
    parts = (last - first) // w + 1  # longer runs, as in periodic text, are cut
    if len(parts) and parts.max() > 1:
        base = np.repeat(first, parts)
        step = np.arange(len(base)) - np.repeat(np.cumsum(parts) - parts, parts)
        end = np.repeat(last, parts)
        first = base + step * w
        last = np.minimum(first + w - 1, end)
    value = least[first]
    span = first[:, None] + np.arange(2 * w - 1)
    inside = span <= (last + w - 1)[:, None]
    twice = ((grams[np.minimum(span, len(grams) - 1)] == value[:, None]) & inside).sum(1) > 1
    return first, last, chunk.text_of_word()[first], value.view(np.int64), twice


def _routes(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text"):
            _, _, text, value, twice = super_kmers(Chunk(texts), k, m)
            offsets = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
            lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(offsets), pa.array(x, kind))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([part.column("rid"), lists(value, pa.int64()), lists(twice.astype(np.int8) + 1, pa.int8())], ["rid", "routes", "times"])

    return run


def _pack(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[tuple[bytes, int]]] = {}  # windows of hot buckets, by digest
        held = 0
        for part, texts in pieces(batches, "text"):
            rows, places = packed(Chunk(texts), part.column("rid").to_pylist(), part.column("wanted"), seen)
            yield rows
            held += places
            if held >= PLACES:
                yield combined(seen)
                seen, held = {}, 0
        if seen:
            yield combined(seen)

    def packed(chunk: Chunk, rids: list[bytes], wanted: pa.ListArray, seen: dict[bytes, list[tuple[bytes, int]]]) -> tuple[pa.RecordBatch, int]:
        first, last, text, value, _ = super_kmers(chunk, k, m)
        before = np.searchsorted(text, np.arange(len(rids)))
        flat = wanted.flatten()
        owner = np.repeat(np.arange(len(rids)), wanted.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        chosen = before[owner] + np.asarray(flat.field("ord"))
        hot = np.zeros(len(first), bool)
        hot[chosen[np.asarray(flat.field("hot").cast(pa.int8())).astype(bool)]] = True
        cold = np.setdiff1d(chosen, np.flatnonzero(hot))
        raw, s, e = chunk.raw, chunk.starts, chunk.ends
        ids = [rids[t] for t in text[cold]]
        place = (first - chunk.lo[text])[cold].astype(np.int32)
        strings = [raw[i:j] for i, j in zip(s[first[cold]].tolist(), e[last[cold] + k - 1].tolist(), strict=True)]
        places = 0
        for f, z, t in zip(first[hot].tolist(), last[hot].tolist(), text[hot].tolist(), strict=True):
            words, at = raw[s[f] : e[z + k - 1]].split(), f - int(chunk.lo[t])
            places += z - f + 1
            for i in range(z - f + 1):
                seen.setdefault(hashlib.blake2b(b" ".join(words[i : i + k]), digest_size=16).digest(), []).append((rids[t], at + i))
        return _batch(value[cold], np.full(len(cold), _SUPER, np.int8), ids, place, place, strings), places

    def combined(seen: dict[bytes, list[tuple[bytes, int]]]) -> pa.RecordBatch:
        rows: list[tuple] = []
        covered: dict[bytes, list[int]] = {}
        for digest, places in seen.items():
            rid, p = places[0]
            rows.append((int.from_bytes(digest[:8], "little", signed=True), _WINDOW if len(places) == 1 else _REPEATED, rid, p, p + k, digest))
            if len(places) > 1:
                for rid, p in places:
                    covered.setdefault(rid, []).append(p)
        for rid, places in covered.items():
            for i, j in intervals(np.sort(np.array(places)), k):
                rows.append((int.from_bytes(rid[:8], "little", signed=True), _COVERED, rid, i, j, None))
        return _batch(*(list(c) for c in zip(*rows, strict=True)))

    return run


def _batch(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROUTED, strict=True)], schema=_ROUTED)


def intervals(starts: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The places covered by windows with these ascending starts."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > k)
    return list(zip(starts[np.append(0, gap + 1)].tolist(), (starts[np.append(gap, len(starts) - 1)] + k).tolist(), strict=True))


def repeated_windows(strings: list[bytes], k: int) -> tuple[Chunk, np.ndarray]:
    """The places, in the chunk of these strings, of windows whose words occur twice or more among them."""
    chunk = Chunk(strings)
    h, place = windows(chunk.hashes(), k), np.flatnonzero(chunk.window_ok(k))
    h = h[place]
    order = np.argsort(h, kind="stable")
    h, sorted_place = h[order], place[order]
    same = h[1:] == h[:-1]
    if not same.any():
        return chunk, place[:0]
    head = np.append(True, ~same)
    chief = sorted_place[np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))]
    alike = ~head | np.append(~head[1:], False)
    mine, chief = sorted_place[alike], chief[alike]
    back = np.argsort(mine)
    mine, chief = mine[back], chief[back]
    # Windows that run on side by side are compared as one stretch.
    other = np.flatnonzero(mine != chief)
    m2, c2 = mine[other], chief[other]
    cut = np.flatnonzero(np.append(True, (np.diff(m2) != 1) | (np.diff(c2) != 1)))
    raw, s, e = chunk.raw, chunk.starts, chunk.ends
    good, bad = np.ones(len(m2), bool), []
    for i, j in zip(cut.tolist(), np.append(cut[1:], len(m2)).tolist(), strict=True):
        a, b = m2[i], c2[i]
        n = j - i + k - 1
        x, y = raw[s[a] : e[a + n - 1]], raw[s[b] : e[b + n - 1]]
        if x != y and x.split() != y.split():
            good[i:j] = False
            bad.append((i, j))
    found = np.union1d(m2[good], c2[good])
    if bad:  # equal hashes of different words: count these windows by their words
        words: dict[tuple, list[int]] = {}
        for p in np.union1d(m2[~good], c2[~good]).tolist():
            words.setdefault(tuple(raw[s[p] : e[p + k - 1]].split()), []).append(p)
        found = np.union1d(found, [p for places in words.values() if len(places) > 1 for p in places]).astype(np.int64)
    return chunk, found


def _count(k: int, limit: int = CHUNK):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Whole buckets together, about `limit` bytes at a time."""
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in parts(batches, "packed", limit):
            held.append(batch)
            size += batch.nbytes
            if size >= limit:
                table = pa.Table.from_batches(held)
                route = table.column("route").to_numpy()
                cut = int(np.searchsorted(route, route[-1]))  # sorted: the last bucket may go on
                if cut:
                    yield table.slice(0, cut)
                    held = table.slice(cut).to_batches()
                    size = sum(b.nbytes for b in held) // 2
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches):
            kind = table.column("kind").to_numpy()
            rid, start = table.column("rid").to_pylist(), table.column("start").to_numpy()
            stop, packed = table.column("stop").to_numpy(), table.column("packed").to_pylist()
            out: list[tuple] = [(rid[i], int(start[i]), int(stop[i])) for i in np.flatnonzero(kind == _COVERED)]
            supers = np.flatnonzero(kind == _SUPER)
            if len(supers):
                chunk, found = repeated_windows([packed[i] for i in supers], k)
                owner = np.searchsorted(chunk.lo, found, "right") - 1
                for i, j in zip(np.flatnonzero(np.append(True, np.diff(owner) > 0)).tolist() if len(found) else [], [*(np.flatnonzero(np.diff(owner) > 0) + 1).tolist(), len(found)], strict=True) if len(found) else ():
                    row, base = supers[owner[i]], int(chunk.lo[owner[i]])
                    out += [(rid[row], int(start[row]) + a - base, int(start[row]) + b - base) for a, b in intervals(found[i:j], k)]
            digests: dict[bytes, list[int]] = {}
            for i in np.flatnonzero((kind == _WINDOW) | (kind == _REPEATED)).tolist():
                digests.setdefault(packed[i], []).append(i)
            for rows in digests.values():
                if len(rows) > 1:
                    out += [(rid[i], int(start[i]), int(stop[i])) for i in rows if kind[i] == _WINDOW]
            if out:
                a, b, c = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.int32()), pa.array(c, pa.int32())], ["rid", "start", "stop"])

    return run


def _strip(id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            n_words, n_removed, digest, kept_text = [], [], [], []
            for text, spans in zip(texts, batch.column("spans"), strict=True):
                words = text.split()
                n_words.append(len(words))
                if spans.is_valid:
                    keep, end = [], 0
                    for span in sorted((x["start"], x["stop"]) for x in spans.as_py()):
                        keep += words[end : span[0]] if span[0] > end else ()
                        end = max(end, span[1])
                    words = keep + words[end:]
                n_removed.append(n_words[-1] - len(words))
                kept = b" ".join(words)
                digest.append(hashlib.sha256(kept).hexdigest())
                kept_text.append(kept)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_text, pa.binary()).cast(pa.string()), batch.column("rid")], [id_col, "n_words", "n_removed", "kept_sha256", "kept_text", "rid"])

    return run


def remove_repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, minimiser: int = 8, hot: int = 5_000) -> DataFrame:
    """Rows (id_col, n_words, n_removed, kept_sha256, kept_text, rid); rid: `row_key` of id and text; hot: super-k-mers from which on a bucket is counted by digests."""
    rows = own(df, doc_id=id_col, text=text_col)
    rows = rows.withColumn("rid", row_key(F.col("doc_id"), F.col("text"))).where(F.col("rid").isNotNull())  # both joins below then share one exchange of the texts
    listed = written(rows.select("rid", "text").mapInArrow(_routes(window, minimiser), "rid binary, routes array<long>, times array<tinyint>"), "minimisers")
    each = listed.where(F.size("routes") > 0).select("rid", F.posexplode(F.arrays_zip("routes", "times")).alias("ord", "x")).select("rid", "ord", F.col("x.routes").alias("route"), F.col("x.times").alias("times"))
    shared = written(each.groupBy("route").agg(F.sum("times").alias("n")).where("n > 1").select("route", "n", (F.col("n") > hot).alias("hot")), "routes")
    # Minimisers with more than a 2,000th of all places are 2,000 at most: they are broadcast, and no key of the other join is hot.
    share = (shared.agg(F.sum("n")).first()[0] or 0) / HEAVY
    heavy, light = F.broadcast(shared.where(F.col("n") > share).select("route", "hot")), shared.where(F.col("n") <= share).select("route", "hot")
    places = each.join(heavy, "route", "left_anti").join(light, "route").unionByName(each.join(heavy, "route")).select("rid", "ord", "hot")
    wanted = places.groupBy("rid").agg(F.collect_set(F.struct("ord", "hot")).alias("wanted"))
    routed = rows.join(wanted, "rid").mapInArrow(_pack(window, minimiser), "route long, kind tinyint, rid binary, start int, stop int, packed binary")
    found = routed.repartition("route").sortWithinPartitions("route").mapInArrow(_count(window), "rid binary, start int, stop int")
    spans = found.groupBy("rid").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.join(spans, "rid", "left").mapInArrow(_strip(id_col), f"{id_col} {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string, rid binary")
