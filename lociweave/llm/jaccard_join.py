"""Exact self-join of word-shingle sets at Jaccard similarity >= 0.75, and its components.

The space is that of shingle sets with the distance 1 - Jaccard; links are pairs within the radius 0.25.

First pivots: the one-element sets. {s} is at distance 1 - 1/|x| from every x that holds s and at 1 from all
others, so the nearest pivots of x are its own shingles; ties go by one global order, and the region of x's
first shingle is x's home. The boundary that is replicated follows from the radius: a set that shares none of
x's first t shingles is at distance >= t / |x| from x, so once t / |x| exceeds the radius no partner is left
and x needs no further region. Reading n/20 shingles more, partners share several regions, and a document
with too few shared ones is ruled out without its text. The order puts shingles last whose cell in a table of
counts (over all documents, of fixed size) is far above the mean; any order gives the same result. (Documents
as first pivots would each be at distance 1 from nearly all others, and every window would hold every document.)

Cells: each region names the member with most regions; regions that name one document form its cell.

Recursion: a cell that is larger than a block gets ``PIVOTS`` documents as pivots. Every member goes to the
Voronoi region of its nearest one, and also to those whose pivot is at most twice the radius farther: by the
triangle inequality no pair within the radius is separated. Members within the radius of a pivot are linked to
it, and so to each other; of them only those whose distance is at most the radius below that of the nearest
member outside go on. The regions are the cells of the next level. A cell of at most a block, of two
documents, or one that its pivots could not shrink is joined at once, block by block. (Before sets are read,
larger cells are cut into bands of set sizes, and cells of at most a block into groups that share enough.)

Nothing gathers a cell: members meet pivots in blocks of ``BLOCK`` shingles, a task holds two blocks at most.
Sets of candidate documents are written once and joined by sorting, at every size; the texts they are made
of are chosen by a bitmap of fixed size, whose false positives only store sets that nothing asks for.

Defined results: sets of texts without words are empty and linked with nothing; a null text has none;
rows with one doc_id count as one document (linked); rows with a null doc_id have a null component;
repeated rows give repeated rows; an empty table gives none; very long texts are read whole (a set larger
than a block is a block of its own); other columns are ignored. Links are found up to connectivity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import brief_shuffles, discard, doc_texts, materialize, partitions, tidy
from .shingles import LOWER, mix, sequences, word_hashes

WORDS = 5
#: Similarity NUM / DEN at least.
NUM, DEN = 75, 100
#: Cells of the table of counts, and slices it is added up in.
CELLS, SLICES = 1 << 22, 64
#: Shingles of a block of sets, and what each set counts besides; pivots of a cell that is larger; a cell that
#: is not below this share of the one before is not divided further.
BLOCK, ROW, PIVOTS, SHRINK = 1 << 18, 256, 6, 0.8
#: Bits of the map of candidate documents, and slices it is made in.
MAP_BITS, MAP_SLICES = 26, 256
#: Bits of a region's number.
BITS = 44
BLOCK_CHARS = 1_000_000
_FLUSH = 1_000_000


def extra(n):
    """How many shared regions more than one a set of n asks for."""
    return n // 20


def needed(n):
    """Least overlap of a set of n with a partner."""
    return -(-n * NUM // DEN)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word sequences; of a shorter text, one of all its words."""
    h, bounds = word_hashes(texts, LOWER)
    g = mix(sequences(h, words) + np.uint64(words))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            s = g[a : b - words + 1].copy()
            s.sort()
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(mix(sequences(h[a:b], b - a)[:1] + np.uint64(b - a)))
        else:
            out.append(h[:0])
    return out


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_CHARS):
    """(ids, texts as bytes) in blocks of bounded size."""
    for b in batches:
        ids, texts, size = [], [], 0
        for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids.append(i)
            texts.append(t.as_buffer().to_pybytes() if t.is_valid else b"")
            size += len(texts[-1])
            if size >= limit:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def _cells(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def describe(docs: DataFrame, words: int) -> DataFrame:
    """Of each document: n and a 128-bit digest of its set; of each task: its part of the table of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(CELLS, dtype=np.uint16)
        for ids, texts in blocks(batches):
            sets = shingle_sets(texts, words)
            every = np.concatenate(sets)
            if len(every):
                cell, n = np.unique(_cells(every), return_counts=True)
                table[cell] = np.minimum(table[cell] + n, 65535)
            k = [[int(mix(s ^ np.uint64(c)).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0 for s in sets] for c in (0x1234567, 0x9ABCDEF0123)]
            empty = pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(k[0], pa.int64()), pa.array(k[1], pa.int64()), *empty], ["doc_id", "n", "k1", "k2", "slice", "counts"])
        parts = [x.tobytes() for x in table.reshape(SLICES, -1)]
        none = [pa.nulls(SLICES, pa.int64())] * 4
        yield pa.RecordBatch.from_arrays([*none, pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["doc_id", "n", "k1", "k2", "slice", "counts"])

    return docs.mapInArrow(tidy(run), "doc_id long, n long, k1 long, k2 long, slice int, counts binary")


def frequent(described: DataFrame) -> np.ndarray:
    """One bit per cell: far more shingles than the mean (a table of fixed size)."""
    total = described.agg(F.sum("n")).first()[0] or 0
    mean = total / CELLS
    limit = mean + 6 * mean**0.5 + 8

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(c, dtype=np.uint32 if len(c) == 4 * CELLS // SLICES else np.uint16).astype(np.uint32)
                sums[s] = sums[s] + part if s in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "counts"])

    kind = "slice int, counts binary"
    found = described.where("slice is not null").select("slice", "counts").repartition(SLICES, "slice").mapInArrow(tidy(add), kind)
    with brief_shuffles(described.sparkSession):
        bits = {r.slice: np.frombuffer(r.counts, dtype=np.uint32) > limit for r in found.collect()}  # CELLS numbers at most
    size = CELLS // SLICES
    return np.packbits(np.concatenate([bits.get(i, np.zeros(size, dtype=bool)) for i in range(SLICES)]))


def regions(docs: DataFrame, hot: np.ndarray, words: int, parts: int) -> DataFrame:
    """lm (a region), doc_id: the regions of every document, where another text may share them.

    Numbers travel packed, by range of region; a range's task sorts them and keeps regions with two
    documents. Regions of frequent cells skip that (they are shared, and may be large): their rows pass
    through any task. Equal sets within a task are sent once.
    """
    sent = docs.sparkSession.sparkContext.broadcast(hot)  # CELLS bits
    groups = 16 * parts

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(sent.value).astype(bool)
        seen: set[bytes] = set()
        cold: list[tuple[np.ndarray, np.ndarray]] = []
        warm: list[tuple[np.ndarray, np.ndarray]] = []
        held, turn = 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal turn
            rows: list[tuple[int, bool, bytes, bytes]] = []
            for kind, of in ((False, cold), (True, warm)):
                if not of:
                    continue
                lm, doc = (np.concatenate(x) for x in zip(*of, strict=True))
                order = np.argsort(lm, kind="stable")
                lm, doc = lm[order], doc[order]
                if kind:
                    cuts = range(0, len(lm), 4096)
                    at = [((turn + k) * 7919 % groups, x, min(len(lm), x + 4096)) for k, x in enumerate(cuts)]
                    turn += len(at)
                else:
                    group = (lm * groups) >> BITS
                    edge = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(lm)]])
                    at = [(int(group[a]), a, b) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                rows += [(g, kind, lm[a:b].astype("<u4").tobytes() + (lm[a:b] >> 32).astype("<u2").tobytes(), doc[a:b].tobytes()) for g, a, b in at]
                of.clear()
            for k in range(0, len(rows), 5000):
                g, kind, a, b = zip(*rows[k : k + 5000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(kind, pa.bool_()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["g", "hot", "lm", "doc"])

        for ids, texts in blocks(batches):
            for i, s in zip(ids, shingle_sets(texts, words), strict=True):
                n = len(s)
                if not n or (key := s.data.tobytes() if n < 4 else mix(s.copy()).sum().tobytes() + s[:2].tobytes()) in seen:
                    continue
                if len(seen) < 50_000:  # repeats beyond are sent again
                    seen.add(key)
                last = bits[_cells(s)]
                take = min(n, n - needed(n) + 1 + extra(n))
                first, n_cold = s[~last], n - int(last.sum())
                own = first[:take] if n_cold >= take else first
                cold.append(((own >> np.uint64(64 - BITS)).astype(np.int64), np.full(len(own), i, dtype=np.int64)))
                if n_cold < take:
                    more = s[last][: take - n_cold]
                    warm.append(((more >> np.uint64(64 - BITS)).astype(np.int64), np.full(len(more), i, dtype=np.int64)))
                held += take
            if held >= _FLUSH:
                yield from flush()
                held = 0
        yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, lms, found = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            if lms:
                lm, doc = np.concatenate(lms), np.concatenate(found)
                order = np.argsort(lm, kind="stable")
                lm, doc = lm[order], doc[order]
                same = lm[1:] == lm[:-1]
                keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
                yield pa.RecordBatch.from_arrays([pa.array(lm[keep]), pa.array(doc[keep])], ["lm", "doc_id"])
                lms.clear()
                found.clear()

        for b in batches:
            for g, h, a, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                n = len(d) // 8
                lm = np.frombuffer(a, "<u4", n).astype(np.int64) | np.frombuffer(a, "<u2", n, 4 * n).astype(np.int64) << 32
                doc = np.frombuffer(d, np.int64)
                if h:
                    yield pa.RecordBatch.from_arrays([pa.array(lm), pa.array(doc)], ["lm", "doc_id"])
                    continue
                if g != own:
                    yield from close()
                    own = g
                lms.append(lm)
                found.append(doc)
        yield from close()

    packed = docs.where("doc_id is not null").mapInArrow(tidy(deal), "g int, hot boolean, lm binary, doc binary")
    return packed.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(tidy(meet), "lm long, doc_id long")


def _bit(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64) + np.uint64(1)) >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def id_map(ids: DataFrame, parts: int) -> np.ndarray:
    """A bitmap, packed, that holds every id of the table (of fixed size; others may be in it too)."""
    size = (1 << MAP_BITS) // MAP_SLICES

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bit = np.unique(_bit(b.column(0).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([pa.array((bit // size).astype(np.int32)), pa.array((bit % size).astype(np.int32))], ["slice", "at"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, np.ndarray] = {}
        for b in batches:
            k, at = (b.column(i).to_numpy() for i in (0, 1))
            for i in np.unique(k).tolist():
                bits.setdefault(i, np.zeros(size, dtype=bool))[at[k == i]] = True
        if bits:
            yield pa.RecordBatch.from_arrays([pa.array(list(bits), pa.int32()), pa.array([np.packbits(x).tobytes() for x in bits.values()], pa.binary())], ["slice", "bits"])

    spread = ids.mapInArrow(deal, "slice int, at int").repartition(parts, "slice")
    with brief_shuffles(ids.sparkSession):
        found = {r.slice: r.bits for r in spread.mapInArrow(tidy(add), "slice int, bits binary").collect()}  # 2^MAP_BITS bits at most
    return np.frombuffer(b"".join(found.get(i, bytes(size // 8)) for i in range(MAP_SLICES)), dtype=np.uint8)


def stored_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """node, k, s binary: the sets of the documents that ids names (and of some others), k a digest."""
    sent = docs.sparkSession.sparkContext.broadcast(id_map(ids, partitions(docs)))  # 2^MAP_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bit = _bit(b.column(0).to_numpy(zero_copy_only=False))
            some = b.take(pa.array(np.flatnonzero(sent.value[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1)))
            for own, texts in blocks(iter([some])):
                sets = shingle_sets(texts, words)
                k = [int(mix(s + np.uint64(9)).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0 for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(k, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "k", "s"])

    return docs.where("doc_id is not null").mapInArrow(tidy(run), "node long, k long, s binary")


_RADIUS = 1 - NUM / DEN
#: For comparisons of distances, which are rounded.
_EPS = 1e-9


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many hashes two sorted sets have in common."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x))


def linked(n, na, nb):
    """Whether sets of na and nb with n in common are within the radius."""
    return (n > 0) & (DEN * n >= NUM * (na + nb - n))


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of x shares with each of y: products of 0/1 matrices over shared hashes."""
    flat = [np.concatenate(v) if v else np.empty(0, dtype=np.uint64) for v in (x, y)]
    row = [np.repeat(np.arange(len(v)), [len(s) for s in v]) for v in (x, y)]
    both = np.intersect1d(*flat)
    out = np.zeros((len(x), len(y)), dtype=np.float32)
    if not len(both):
        return out
    at, keep = [], []
    for f in flat:
        k = np.minimum(np.searchsorted(both, f), len(both) - 1)
        keep.append(both[k] == f)
        at.append(k)
    for start in range(0, len(both), 4096):
        m = []
        for k, ok, r, v in zip(at, keep, row, (x, y), strict=True):
            sel = ok & (k >= start) & (k < start + 4096)
            one = np.zeros((len(v), min(4096, len(both) - start)), dtype=np.float32)
            one[r[sel], k[sel] - start] = 1
            m.append(one)
        out += m[0] @ m[1].T
    return out


def forest(rows: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int]]:
    """Links of a block (side 0), or between two blocks (sides 0 and 1), of (side, id, set); of the links
    within a connected group only some."""
    up = {i: i for _, i, _ in rows}

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []

    def link(i: int, j: int) -> None:
        p, q = root(i), root(j)
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((i, j))

    one = [(i, s) for side, i, s in rows if side == 0]
    two = [(i, s) for side, i, s in rows if side == 1] or one
    if len(one) * len(two) <= 144:
        for a, (i, x) in enumerate(one):
            for j, y in two[a + 1 :] if two is one else two:
                if len(x) * DEN >= len(y) * NUM and len(y) * DEN >= len(x) * NUM and root(i) != root(j) and linked(shared(x, y), len(x), len(y)):
                    link(i, j)
        return out
    n = overlaps([s for _, s in one], [s for _, s in two]).astype(np.int64)
    na, nb = (np.array([len(s) for _, s in v]) for v in (one, two))
    found = linked(n, na[:, None], nb[None, :])
    for a, b in np.argwhere(np.triu(found, 1) if two is one else found):
        link(one[a][0], two[b][0])
    return out


def thinned(places: DataFrame) -> DataFrame:
    """cell, rep, n, solo: the first cells. One of more than a block is cut into bands of sizes: partners' sizes
    differ by 4/3 at most, so each goes to its band and the next (a representative of several sets has no one size). One of at most a block is cut into groups
    that pairs with enough shared regions connect; a member without such a partner leaves it.

    places: lm, cell, rep, n, solo.
    """
    cells = places.groupBy("cell", "rep").agg(F.max("n").alias("n"), F.max("solo").alias("solo"))

    def with_size(of: DataFrame) -> DataFrame:
        return of.join(of.groupBy("cell").agg((F.sum(F.col("n") + ROW) <= BLOCK).alias("small")), "cell")

    first = materialize(with_size(cells), "sized")
    band = F.floor(F.log("n") / F.log(F.lit(1.01 * DEN / NUM)))  # partners' bands differ by one at most, however rounded
    cut = first.where("not small and solo").withColumn("band", F.explode(F.array(band, band + 1))).select(F.xxhash64("cell", "band").alias("cell"), "rep", "n", "solo")
    odd = first.where("not small and not solo").select("cell")
    whole = first.join(odd.distinct(), "cell", "left_semi").where("not small").select("cell", "rep", "n", "solo")
    sized = materialize(first.where("small").union(with_size(cut)).union(whole.withColumn("small", F.lit(False))), "sized")
    discard(first)
    lists = places.groupBy("rep").agg(F.collect_list("lm").alias("lms"))  # of one document's set

    def groups(rows: list[tuple]) -> Iterator[tuple]:
        sets = [np.unique(r[4]).view(np.uint64) for r in rows]
        n = np.array([r[2] for r in rows])
        least = np.minimum(n[:, None], n[None, :])
        fit = overlaps(sets, sets)
        loose = ~np.array([r[3] for r in rows])  # of several sets
        fit = (fit >= 1 + extra(least)) & (least * DEN >= np.maximum(n[:, None], n[None, :]) * NUM) | (fit > 0) & (loose[:, None] | loose[None, :])
        left = set(range(len(rows)))
        while left:
            first, todo, of = min(left), [min(left)], set()
            while todo:
                i = todo.pop()
                if i in left:
                    left.discard(i)
                    of.add(i)
                    todo += np.flatnonzero(fit[i]).tolist()
            if len(of) > 1:
                yield from ((rows[i][0], rows[first][1], *rows[i][1:4]) for i in sorted(of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept = None, []
        for b in batches:
            out = []
            lms = b.column(4)
            for i, row in enumerate(zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)):
                if row[0] != key:
                    out += groups(kept) if kept else []
                    key, kept = row[0], []
                kept.append((*row, lms[i].values.to_numpy()))
            yield from batch_of(out)
        yield from batch_of(list(groups(kept)) if kept else [])

    def batch_of(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["old", "first", "rep", "n", "solo"])

    rows = sized.where("small").hint("merge").join(lists.hint("merge"), "rep").select("cell", "rep", "n", "solo", "lms")
    found = rows.repartition("cell").sortWithinPartitions("cell", "rep").mapInArrow(tidy(run), "old long, first long, rep long, n long, solo boolean")
    return found.select(F.xxhash64("old", "first").alias("cell"), "rep", "n", "solo").union(sized.where("not small").select("cell", "rep", "n", "solo"))


LEVEL = "cell long, rep long, n long, own boolean, solo boolean, up long, d array<double>, near array<boolean>, s binary"


def meet_level(rows: DataFrame) -> DataFrame:
    """Of blocks that meet: links a, b. Of members and pivots: links to the pivots, and LEVEL, d and near by pivot.

    rows: LEVEL without d and near, one, two (-1: members with pivots, else two blocks), side; in any order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept = None, []
        links: list[tuple[int, int]] = []
        for batch in batches:
            took, ds, nears = [], [], []
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            sets = batch.column(5)
            for r, (cell, one, two, side, rep) in enumerate(zip(*(c.tolist() for c in cols), strict=True)):
                if (cell, one, two) != key:
                    if key and key[2] >= 0:
                        links += forest(kept)
                    key, kept = (cell, one, two), []
                x = np.frombuffer(sets[r].as_buffer(), dtype=np.uint64)
                if two >= 0 or side == 0:
                    kept.append((side, rep, x.copy()))
                    continue
                n = [shared(x, y) for _, _, y in kept]
                near = [bool(linked(k, len(x), len(y))) for k, (_, _, y) in zip(n, kept, strict=True)]
                links += [(rep, i) for ok, (_, i, _) in zip(near, kept, strict=True) if ok and i != rep]
                if all(i != rep for _, i, _ in kept):
                    took.append(r)
                    ds.append([1 - k / max(1, len(x) + len(y) - k) for k, (_, _, y) in zip(n, kept, strict=True)])
                    nears.append(near)
            yield from batch_of(links, batch, took, ds, nears)
            links = []
        if key and key[2] >= 0:
            links = forest(kept)
        yield from batch_of(links, None, [], [], [])

    def batch_of(links, batch, took, ds, nears) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", *NAMES]
        if links:
            a, b = zip(*links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *(pa.nulls(len(a), t) for t in TYPES)], names)
        if took:
            some = batch.take(pa.array(took, pa.int64()))
            at = dict(zip(batch.schema.names, some.columns, strict=True)) | {"d": pa.array(ds, pa.list_(pa.float64())), "near": pa.array(nears, pa.list_(pa.bool_()))}
            yield pa.RecordBatch.from_arrays([pa.nulls(len(took), pa.int64()), pa.nulls(len(took), pa.int64()), *(at[n] for n in NAMES)], names)

    NAMES = ["cell", "rep", "n", "own", "solo", "up", "d", "near", "s"]
    TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.bool_()), pa.binary()]
    ready = rows.select("cell", "one", "two", "side", "rep", "s", "n", "own", "solo", "up").repartition("cell", "one", "two").sortWithinPartitions("cell", "one", "two", "side", "rep")
    return ready.mapInArrow(tidy(run), f"a long, b long, {LEVEL}")


def dealt(cells: DataFrame, level: int) -> DataFrame:
    """The rows of cells (LEVEL without d and near, with or without s) by block, and pivots with every block."""
    chosen = [F.min(F.when(F.col("own") & F.col("solo"), F.struct(F.xxhash64("rep", F.lit(level), F.lit(k)).alias("h"), F.col("rep").alias("rep"))))["rep"].alias(f"p{k}") for k in range(PIVOTS)]
    sizes = cells.groupBy("cell").agg(F.count("*").alias("c"), F.sum(F.col("n") + ROW).alias("total"), F.max("up").alias("before"), *chosen)
    at_once = (F.col("c") <= 2) | (F.col("total") <= BLOCK) | (F.col("total") > SHRINK * F.col("before")) | F.col("p0").isNull()
    blocks_ = F.ceil(F.col("total") / F.lit(BLOCK)).cast("int")
    sizes = sizes.select("cell", "total", F.when(F.col("c") <= 2, 1).otherwise(F.greatest(blocks_, F.lit(1))).alias("k"), at_once.alias("once"), F.array_distinct(F.array(*(f"p{k}" for k in range(PIVOTS)))).alias("pivots"))
    rows = cells.drop("up").join(sizes, "cell").withColumn("b", F.pmod(F.xxhash64("rep", F.lit(level)), F.col("k")).cast("int"))
    place = lambda one, two, side: F.struct(one.cast("int").alias("one"), two.cast("int").alias("two"), side.cast("int").alias("side"))
    every = F.sequence(F.lit(0), F.col("k") - 1)
    meets = F.transform(every, lambda o: place(F.least(o, F.col("b")), F.greatest(o, F.col("b")), F.when(o < F.col("b"), 1).otherwise(0)))
    member = F.array(place(F.col("b"), F.lit(-1), F.lit(1)))
    pivot = F.when(F.array_contains("pivots", F.col("rep")), F.transform(every, lambda o: place(o, F.lit(-1), F.lit(0)))).otherwise(F.array().cast("array<struct<one:int,two:int,side:int>>"))
    out = rows.withColumn("at", F.explode(F.when(F.col("once"), meets).otherwise(F.concat(member, pivot))))
    return out.withColumn("up", F.col("total")).select(*cells.columns, "at.one", "at.two", "at.side")


def regions_of(done: DataFrame, level: int) -> DataFrame:
    """The cells of the next level: Voronoi regions with their windows, without what needs no more partner."""
    nearest = (F.array_position("d", F.array_min("d")) - 1).cast("int")
    own = done.where("cell is not null").withColumn("home", nearest)
    reach = F.array_min("d") + 2 * _RADIUS + _EPS
    # a pair whose members are at home with different pivots meets in the region of the first of them
    places = F.filter(F.sequence(F.lit(0), F.col("home")), lambda j: (j == F.col("home")) | (F.get("d", j) <= reach))
    rows = own.withColumn("j", F.explode(places)).withColumn("dj", F.expr("get(d, j)")).withColumn("ok", F.expr("get(near, j)"))
    rows = rows.select(F.xxhash64("cell", "j", F.lit(level)).alias("cell"), "rep", "n", (F.col("j") == F.col("home")).alias("own"), "solo", "up", "s", "dj", "ok")
    far = rows.groupBy("cell").agg(F.min(F.when(~F.col("ok"), F.col("dj"))).alias("least"), F.max("own").alias("alive"), F.count("*").alias("c")).where("least is not null and alive and c > 1")
    return rows.join(far, "cell").where(~F.col("ok") | (F.col("dj") >= F.col("least") - _RADIUS - _EPS)).select("cell", "rep", "n", "own", "solo", "up", "s")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    parts = partitions(docs)
    own = doc_texts(docs, id_col, text_col)
    described = materialize(describe(own, words), "sets")
    hot = frequent(described)
    rows = described.where("slice is null").select("doc_id", "n", "k1", "k2")

    # classes of equal sets; solo: no other class has the same representative
    reps = rows.where("doc_id is not null and n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    reps = materialize(reps, "reps")
    solo = reps.groupBy("rep").agg((F.count("*") == 1).alias("solo"))
    known = materialize(reps.join(solo, "rep"), "reps")
    classes = materialize(rows.join(known, ["k1", "k2"], "left").select("doc_id", "n", "solo", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")), "classes")
    discard(described, reps, known)
    links = classes.where("rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    # regions, as rows of class representatives that share enough of them
    found = regions(own, hot, words, parts).join(classes.where("rep is not null").select("doc_id", "rep", "n", "solo"), "doc_id")
    members = materialize(found.select("lm", "rep", "n", "solo").distinct(), "members")
    sizes = members.groupBy("lm").agg(F.count("*").alias("c")).where("c > 1")
    enough = members.join(sizes, "lm").groupBy("rep", "n").agg(F.count("*").alias("w")).where(F.col("w") >= 1 + F.floor(F.col("n") * NUM / DEN / 20))
    enough = materialize(enough, "enough")
    left = materialize(members.join(enough, ["rep", "n"]), "members")
    discard(members)
    named = left.groupBy("lm").agg(F.max(F.struct("w", (-F.col("rep")).alias("m"))).alias("best"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    places = materialize(left.join(named.select("lm", (-F.col("best.m")).alias("cell")), "lm").select("lm", "cell", "rep", "n", "solo"), "places")
    discard(left, enough)
    cells = materialize(thinned(places).withColumn("own", F.lit(True)).withColumn("up", F.lit((1 << 63) - 1)), "cells")
    discard(places)

    sets = materialize(stored_sets(own, cells.select("rep"), words), "stored")
    one_each = sets.repartition("node").groupBy("node", "k").agg(F.first("s").alias("s"))
    here = dealt(cells, 0).hint("merge").join(one_each.select(F.col("node").alias("rep"), "s").hint("merge"), "rep")
    level, steps = 0, []
    while True:
        done = materialize(meet_level(here), "met")
        steps.append(done)
        if level == 0:
            discard(sets)
        discard(cells)
        links = links.union(done.where("a is not null").select("a", "b"))
        cells = materialize(regions_of(done, level), "cells")
        if not cells.take(1):
            break
        level += 1
        here = dealt(cells, level)
    of = materialize(components(links), "components")
    discard(cells, *steps)
    out = classes.join(of.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
