"""N-gram Jaccard join on prefix trees: documents whose shingle sets agree by a share or more.

The set of a document is its distinct `shingle`-word runs (lower-cased in ASCII), held as
64-bit hashes; a document of fewer words has its whole sequence as its one element; one
without words is linked with nothing.

1. Documents with equal sets are one node (128-bit digest of the sorted set).
2. A node's sample is its `SAMPLE` smallest hashes.  Of two linked nodes of at most
   SAMPLE * share elements the samples are the sets themselves; of larger ones the samples
   have at least `SURE` common elements but for a chance under 1e-12, which is of the order
   of what 64-bit hashes of shingles carry anyway.
3. Sample elements are put in one global order, rarest first.  By the prefix principle linked
   nodes share an element among the first |sample| - sure + 1.  Elements that no other
   node has take up room in the prefix but go nowhere: unique prose drops out here.
4. Nodes that share a prefix element form a cluster (stars, so as many rows as
   elements; never pairs), and the text of each node travels once to its cluster.
5. A cluster's whole sets stand in a prefix tree, most common elements first, so that the
   overlap with the core that near copies share is counted once for all below it; subtrees
   are left as soon as the elements that remain on either side cannot reach the share.
   A cluster beyond `block_nodes` is dealt into blocks, and each pair of blocks is a task.
6. Components of the links found.

Links are counted between documents: a node's copies count one by one.  Null ids keep their
row; a component of null ids only has a null id.  Repeated rows are documents that are copies
of each other.  Of nodes with equal sets the one with the least id, then text digest, gives its text.  A very long
text is one set, held by one task at a time.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertide.llm.components import components
from papertide.llm.shared import join_salted, own, pieces, written
from papertide.llm.words import Chunk, mix, windows

SAMPLE, SURE = 64, 24


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's set."""
    chunk = Chunk([t.lower() for t in texts])
    h = chunk.hashes()
    grams = windows(h, k)
    for lo, hi in zip(chunk.lo.tolist(), chunk.hi.tolist(), strict=True):
        if hi - lo >= k:
            yield np.unique(grams[lo : hi - k + 1])
        else:
            yield mix(windows(h[lo:hi], hi - lo) + np.uint64(hi - lo)) if hi > lo else h[:0]


def _list_sets(k: int, most: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for part, texts in pieces(batches, "text"):
            node, key, size, sample = [], [], [], []
            for text, s in zip(texts, shingle_sets(texts, k), strict=True):
                node.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                key.append(hashlib.md5(text).digest())
                size.append(len(s))
                sample.append(None if node[-1] in seen else s[:most].view(np.int64))
                if len(seen) < 200_000:
                    seen.add(node[-1])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(node, pa.binary()), pa.array(key, pa.binary()), pa.array(size, pa.int64()), pa.array(sample, pa.list_(pa.int64()))], ["doc_id", "node", "tkey", "n", "sample"])

    return run


class PrefixTree:
    """Sets as ascending arrays of ranks; a tree node is a stretch of ranks that the sets below it share."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">i4").tobytes())
        # node: (ranks of its stretch, depth at its end, children, sets that end here, least and greatest set size below)
        self.root = self._grow(sets, order, 0)

    def _grow(self, sets: list[np.ndarray], order: list[int], depth: int) -> list:
        root = [np.zeros(0, np.int32), depth, [], [], 0, 0]
        todo = [(root, order)]
        made = [root]
        while todo:
            node, members = todo.pop()
            at = node[1]
            node[3] = [i for i in members if len(sets[i]) == at]
            rest = [i for i in members if len(sets[i]) > at]
            sizes = [len(sets[i]) for i in members]
            node[4], node[5] = min(sizes, default=0), max(sizes, default=0)
            begin = 0
            while begin < len(rest):
                first = sets[rest[begin]]
                stop = begin + 1
                while stop < len(rest) and sets[rest[stop]][at] == first[at]:
                    stop += 1
                last = sets[rest[stop - 1]]  # sorted: what first and last share, all between share
                n = min(len(first), len(last))
                differ = np.flatnonzero(first[at:n] != last[at:n])
                end = at + int(differ[0]) if len(differ) else n
                child = [first[at:end], end, [], [], 0, 0]
                node[2].append(child)
                made.append(child)
                todo.append((child, rest[begin:stop]))
                begin = stop
        return root

    def matches(self, x: np.ndarray, mask: np.ndarray, num: int, den: int, sizes: list[int]) -> Iterator[int]:
        """The sets y with den * |x & y| >= num * |x | y|; mask: which ranks x has."""
        nx, todo = len(x), [(self.root, 0)]
        while todo:
            node, overlap = todo.pop()
            stretch, depth, children, ends, least, most = node
            if len(stretch):
                overlap += int(np.count_nonzero(mask[stretch]))
                left = nx - int(np.searchsorted(x, stretch[-1], "right"))
                if (den + num) * (overlap + min(left, most - depth)) < num * (nx + least):
                    continue
            for i in ends:
                if den * overlap >= num * (nx + sizes[i] - overlap):
                    yield i
            todo += [(child, overlap) for child in children]


def join_cluster(sets: list[np.ndarray], side: list[int] | None, copies: list[int], num: int, den: int) -> tuple[list[int], list[int]]:
    """(root, links) of each set.  side: None joins the sets among themselves, else those of side 0 with those of side 1."""
    every = np.concatenate(sets)
    every.sort()
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    tokens, count = every[first], np.diff(np.append(first, len(every)))
    del every, first  # np.unique with the inverse takes several times the sets
    rank = np.empty(len(tokens), np.int32)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(tokens), dtype=np.int32)
    ranked = [np.sort(rank[np.searchsorted(tokens, s)]) for s in sets]
    crossed = side is not None
    held = [i for i in range(len(sets)) if not crossed or side[i]]
    tree, sizes = PrefixTree([ranked[i] for i in held]), [len(ranked[i]) for i in held]
    root, links = list(range(len(sets))), [0] * len(sets)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    mask = np.zeros(len(tokens), bool)
    for x in range(len(sets)):
        if crossed and side[x]:
            continue
        mask[ranked[x]] = True
        for y in tree.matches(ranked[x], mask, num, den, sizes):
            other = held[y]
            if crossed or other < x:
                links[x] += copies[other]
                links[other] += copies[x]
                a, b = find(x), find(other)
                if a != b:
                    root[max(a, b)] = min(a, b)
        mask[ranked[x]] = False
    return [find(i) for i in range(len(sets))], links


def _join_clusters(k: int, num: int, den: int):
    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], list[np.ndarray]]]:
        """The nodes of each group and their sets; of texts, only those of one piece are held."""
        now, held = None, {}
        for part, texts in pieces(batches, "text"):
            for row, s in zip(part.drop_columns(["text"]).to_pylist(), shingle_sets(texts, k), strict=True):
                key = (row["label"], row["i"], row["j"])
                if held and key != now:
                    yield [r for r, _ in held.values()], [x for _, x in held.values()]
                    held = {}
                now = key
                held.setdefault((row["node"], row["side"]), (row, s))
        if held:
            yield [r for r, _ in held.values()], [x for _, x in held.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows, sets in groups(batches):
            roots, links = join_cluster(sets, [r["side"] for r in rows] if rows[0]["i"] != rows[0]["j"] else None, [r["copies"] for r in rows], num, den)
            out += [(rows[i]["node"], rows[roots[i]]["node"], links[i]) for i in range(len(rows)) if links[i]]
            if len(out) > 20_000:
                yield _links(out)
                out = []
        if out:
            yield _links(out)

    return run


def _links(out: list[tuple]) -> pa.RecordBatch:
    u, v, n = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary()), pa.array(n, pa.int64())], ["u", "v", "links"])


def prefix_elements(nodes: DataFrame, num: int, den: int, sample: int | None = SAMPLE) -> DataFrame:
    """(token, node): the elements of each node's prefix that another node's sample has too; without a sample, of its whole set."""
    whole = F.ceil(F.col("n") * num / den)
    size = F.col("n") if sample is None else F.least(F.col("n"), F.lit(sample))
    sure = whole if sample is None else F.when(F.col("n") <= sample * num // den, whole).otherwise(F.lit(SURE))
    each = nodes.select("node", (size - sure + 1).cast("int").alias("prefix"), size.cast("int").alias("size"), F.explode("sample").alias("token"))
    shared = each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    back = each.join(shared, "token").groupBy("node", "prefix", "size").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("found"))
    room = F.greatest(F.lit(0), F.col("prefix") - (F.col("size") - F.size("found")))
    return back.select("node", F.explode(F.slice("found", F.lit(1), room)).alias("x")).select(F.col("x.token").alias("token"), "node")


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100, block_nodes: int = 2_000, block_elements: int = 2_000_000, broadcast_nodes: int = 100_000, exact: bool = False) -> DataFrame:
    """Rows (id_col, n_shingles, component_id, n_links): sets link when den * |common| >= num * |union|.

    broadcast_nodes: up to how many nodes (of about 250 bytes) are broadcast to find their texts; more are joined by a shuffle of the texts.
    exact: prefixes are taken from whole sets, not from samples: no chance is left, and every shingle travels.
    """
    rows = own(df, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    listed = written(rows.mapInArrow(_list_sets(shingle, None if exact else SAMPLE), f"doc_id {kind}, node binary, tkey binary, n long, sample array<long>"), "sets")
    nodes = listed.where("n > 0").groupBy("node").agg(F.min("n").alias("n"), F.count("*").alias("copies"), F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "tkey")).alias("rep"), F.first("sample", True).alias("sample"))
    nodes = written(nodes, "nodes")

    prefix = written(prefix_elements(nodes, num, den, None if exact else SAMPLE), "prefixes")
    least = prefix.groupBy("token").agg(F.min("node").alias("v"), F.count("*").alias("k")).where("k > 1").select("token", "v")
    clusters = written(components(prefix.join(least, "token").select(F.col("node").alias("u"), "v").distinct()), "clusters")

    members = nodes.drop("sample").join(clusters, "node")
    blocks = members.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / block_nodes), F.ceil(F.sum("n") / block_elements)).cast("int").alias("blocks"))
    dealt = join_salted(members, blocks.where("blocks > 1"), "label", "node", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))  # few clusters have several
    dealt = dealt.withColumn("b", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.select("label", "node", "copies", "rep", "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    dealt = dealt.select("label", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), (F.col("b") > F.col("o")).cast("int").alias("side"), "node", "copies", F.col("rep.tkey").alias("tkey"), F.col("rep.doc_id").alias("rep_id"))
    dealt = written(dealt, "dealt")
    wanted = F.broadcast(dealt) if dealt.count() <= broadcast_nodes else dealt
    texts = rows.withColumn("tkey", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    sent = texts.join(wanted, (texts.tkey == wanted.tkey) & texts.doc_id.eqNullSafe(wanted.rep_id)).select("label", "i", "j", "side", "node", "copies", "text")
    found = sent.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j").mapInArrow(_join_clusters(shingle, num, den), "u binary, v binary, links long")
    found = written(found, "found")

    parts = components(found.select("u", "v"))
    links = found.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    named = nodes.select("node", "copies", F.col("rep.doc_id").alias("least")).join(parts, "node", "left").join(links, "node", "left")
    ids = named.where("label is not null").groupBy("label").agg(F.min("least").alias("component_id"))
    named = join_salted(named, ids, "label", "node", "left", salts=8)  # a node without links is alone: its copies' least id
    named = named.select("node", F.when(F.col("label").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    full = listed.select("doc_id", "node", "n").join(named, "node", "left")
    return full.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def error_bound(share: float, sample: int = SAMPLE, sure: int = SURE) -> float:
    """The chance that two sets linked at exactly this share have fewer than `sure` common elements in their samples."""
    return sum(math.comb(sample, i) * share**i * (1 - share) ** (sample - i) for i in range(sure))
