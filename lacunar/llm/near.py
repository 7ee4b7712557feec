"""N-gram Jaccard join on size-banded tiles, and the groups that its links make.

Documents with one set of shingles are a class, and only classes are compared. Two sets of like
size that are similar enough differ in at most d shingles; with the shingles dealt by hash to
d + 1 parts, some part is the same in both. Equal part signatures give candidate pairs; those are
dropped where parity bitmaps show that the sets differ by too much. What is left
gives candidate groups (every link lies within one). A group's classes are cut into tiles by size band and block; tiles of the
same or the next band are compared with hashed bitmaps, whose bit counts bound the overlap from
above, and what may still be similar by intersecting the sorted arrays. A tile gives the links
that join its classes, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from lacunar.llm._dist import components, release, row_of, unrolled
from lacunar.llm._text import lean, mix, shingle_hashes, slices, word_hashes
from lacunar.sources.store import stored

#: A tile's block holds about so many shingles, so a task's memory is bounded for sets of any size.
BLOCK_SHINGLES = 1 << 20
BLOCK_CLASSES = 2048
#: Signatures are dealt to parts of about so many, each sorted in memory at once.
PART_SIGNATURES = 1 << 21
#: Of a signature that at most so many sets have, all pairs are candidates, each of which can be ruled out. The sets of
#: others meet in tiles of two blocks of about FIRM_BLOCK, and a task compares about FIRM_ROWS.
FEW = 16
FIRM_BLOCK = 4096
FIRM_ROWS = 1 << 15
#: Of small sets; larger ones have more.
PARITY_BITS = 1024
#: The bits that signatures have.
SIGNATURE = np.uint64((1 << 48) - 1)
#: A task holds about so many before it sends them on.
HELD_SIGNATURES = 1 << 19


def sets_of(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct shingle hashes, their rows, set size of each row) for runs of rows."""
    for i, data, at in slices(texts):
        n = len(at) - 1
        h, rows = shingle_hashes(*word_hashes(data, at), n, k)
        by = np.lexsort((h, rows))
        h, rows = h[by], rows[by]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
        h, rows = h[new], rows[new]
        yield i, h, rows, np.bincount(rows, minlength=n)


def group_sums(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2**64 of uint64 values by group."""
    low = np.bincount(group, weights=(values & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)
    high = np.bincount(group, weights=(values >> np.uint64(32)).astype(np.float64), minlength=n)
    return low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))


def class_keys(h: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """int64 key of each row's set, from two independent sums over its shingles."""
    a = group_sums(mix(h + np.uint64(0x1234567)), rows, n)
    b = group_sums(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), rows, n)
    return mix(mix(a) + (b << np.uint64(1)) + b * np.uint64(0x2545F4914F6CDD1D)).view(np.int64)


def band_ratio(share: float) -> float:
    """Sizes of similar sets lie in the same band or in neighbours."""
    return 1.008 / share


class Bands:
    def __init__(self, share: float, highest: int = 1 << 31):
        self.share, self.ratio, self.first = share, band_ratio(share), [1]
        while self.first[-1] < highest:
            self.first.append(max(self.first[-1] + 1, math.ceil(self.first[-1] * self.ratio)))
        self.edges = np.array(self.first)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, sizes, "right") - 1

    def parts(self, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each band: how many groups at most two similar sets can spoil whose smaller is in the band, and how many groups to make.

        A group of one part is spoilt by a shingle that only one of the sets has; a group of three parts by
        two such shingles, as each of its signatures leaves one part out. A few more groups are made than can be
        spoilt, so that sets can leave out their weakest ones.
        """
        largest = self.edges[band + 1] - 1
        d = np.floor(largest * (1 - self.share) / self.share + 1e-9).astype(np.int64)
        spoilt = d if self.split == 1 else d // 2
        return spoilt, np.where(d > 0, spoilt + 2 + -(-spoilt // 10), 0)

    @property
    def split(self) -> int:
        """Parts a group; the lower the share, the smaller a part of one would be: about 0.9 * share / (1 - share) shingles."""
        return 1 if self.share >= 0.88 else 3

    def most_signatures(self, shingles: int, sets: int) -> float:
        """About how many signatures sets of so many shingles in all have at most."""
        spoilt = shingles * self.ratio * (1 - self.share) / self.share / (1 if self.split == 1 else 2)
        return 2 * self.split * (1.1 * spoilt + 4 * sets)


def signatures(h: np.ndarray, rows: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row): for each row as the smaller or like, and as the larger one of a pair.

    Signatures of few shingles say little. A set leaves out those of fewer than `enough`, which is chosen so that its
    groups with such a signature are fewer than the unspoilt ones of a similar pair: one of the unspoilt groups then has
    strong signatures only. Of two similar sets take the one with the larger `enough`: its strong signature, which they
    share, is strong for the other too.
    """
    out_sig, out_row = [], []
    own = bands.of(np.maximum(sizes, 1))
    for back in (0, 1):
        home = own - back
        ok = (home >= 0) & (sizes > 0)
        spoilt, m = bands.parts(np.maximum(home, 0))
        spoilt, m = np.where(ok, spoilt, 0), np.where(ok, m, 0)  # no group: only equal sets are similar
        base = np.concatenate([[0], np.cumsum(m)])
        n = int(base[-1])
        use = m[rows] > 0
        hu, ru = h[use], rows[use]
        salted = mix(hu + home[ru].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        group = base[ru] + (salted % m[ru].astype(np.uint64)).astype(np.int64)
        value = mix(salted)
        total = group_sums(value, group, n)
        count = np.bincount(group, minlength=n)
        if bands.split > 1:
            part = group * bands.split + ((value >> np.uint64(40)) % np.uint64(bands.split)).astype(np.int64)
            total = (total[:, None] - group_sums(value, part, n * bands.split).reshape(n, bands.split)).ravel()
            count = (count[:, None] - np.bincount(part, minlength=n * bands.split).reshape(n, bands.split)).ravel()
        # of each row's groups as many as a similar pair leaves unspoilt have no weaker signature than this
        row = np.repeat(np.arange(len(sizes)), m)
        least = count.reshape(n, bands.split).min(1)
        enough, some = np.zeros(len(sizes), np.int64), m > 0
        enough[some] = least[np.lexsort((least, row))][(base[:-1] + m - spoilt - 1)[some]]
        row = np.repeat(row, bands.split)
        keep = count >= enough[row]
        index = np.arange(len(row)) - base[row] * bands.split
        tag = home[row].astype(np.uint64) * np.uint64(0x100000001B3) + index.astype(np.uint64)
        out_sig.append(mix(total + mix(tag))[keep])
        out_row.append(row[keep])
    return np.concatenate(out_sig), np.concatenate(out_row)


def shared(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, node) rows, each once."""
    by = np.lexsort((node, sig))
    sig, node = sig[by] & SIGNATURE, node[by]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    return sig[new], node[new]


def parities(h: np.ndarray, rows: np.ndarray, n: int, bits: int | np.ndarray = PARITY_BITS) -> np.ndarray:
    """Of each of n sets so many bits (if one number is given, as a row): whether an odd number of its shingles fall on each.

    Two sets differ in at least as many shingles as bits. The bits are a power of two.
    """
    each = np.broadcast_to(bits, n).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(each)])
    bit = (mix(h ^ np.uint64(0x7F4A7C15F39CC060)) % each[rows].astype(np.uint64)).astype(np.int64)
    odd = np.bincount(start[rows] + bit, minlength=start[-1]) & 1
    flat = np.packbits(odd.astype(bool)).view(np.int64)
    return flat if np.ndim(bits) else flat.reshape(n, -1)


def parity_bits(sizes: np.ndarray) -> np.ndarray:
    """At least as many bits as shingles: with fewer, parities are as good as random and rule nothing out."""
    return PARITY_BITS << np.ceil(np.log2(np.maximum(sizes, PARITY_BITS) / PARITY_BITS)).astype(np.int64)


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits each row's parities differ. Of two lengths the longer one's are folded to the shorter one's."""
    words = min(x.shape[1], y.shape[1])
    x, y = (np.bitwise_xor.reduce(z.view(np.uint64).reshape(len(z), -1, words), axis=1) if z.shape[1] > words else z.view(np.uint64) for z in (x, y))
    return np.bitwise_count(x ^ y).sum(1, dtype=np.int64)


class Parities:
    """Rows of parities of different lengths."""

    def __init__(self, column: pa.Array):
        at, flat = column.offsets.to_numpy(), column.values.to_numpy()
        self.words, self.row, self.of = np.diff(at), np.zeros(len(column), np.int64), {}
        for w in np.unique(self.words):
            mine = np.flatnonzero(self.words == w)
            self.row[mine] = np.arange(len(mine))
            self.of[w] = flat[at[mine][:, None] + np.arange(w)]

    def differ(self, i: np.ndarray, other: Parities, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(j), np.int64)
        kind = np.stack([self.words[i], other.words[j]], 1)
        for v, w in np.unique(kind, axis=0):
            some = (kind[:, 0] == v) & (kind[:, 1] == w)
            out[some] = differing(self.of[v][self.row[i[some]]], other.of[w][other.row[j[some]]])
        return out


def linked(sets: list[np.ndarray], nodes: np.ndarray, left: np.ndarray, right: np.ndarray, share: float, every: bool = False) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that join the classes, and how many links each class has among those looked at: all of them if every.

    left and right: which classes are in either block. Classes that are joined already are compared only if every.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    bits = 1 << max(6, min(12, int(size.max()).bit_length()))
    rows = np.repeat(np.arange(n), size)
    bit = (mix(np.concatenate(sets)) >> np.uint64(17)) % np.uint64(bits)
    flags = np.zeros((n, bits), bool)
    flags[rows, bit.astype(np.int64)] = True
    maps = np.packbits(flags, axis=1).view(np.uint64)
    label, out, found = np.arange(n), [], np.zeros(n, np.int64)
    for i in np.flatnonzero(left):
        js = np.flatnonzero(right & (every | (label != label[i])) & (~left | (np.arange(n) > i)))
        if not len(js):
            continue
        lo, hi = np.minimum(size[i], size[js]), np.maximum(size[i], size[js])
        js = js[lo >= share * hi - 1e-9]
        if not len(js):
            continue
        mine = np.bitwise_count(maps[i] & ~maps[js]).sum(1, dtype=np.int64)
        theirs = np.bitwise_count(~maps[i] & maps[js]).sum(1, dtype=np.int64)
        most = np.minimum(size[i] - mine, size[js] - theirs)
        js = js[most * (1 + share) >= share * (size[i] + size[js]) - 1e-9]
        for j in js:
            joined = label[j] == label[i]
            if joined and not every:
                continue
            at = np.searchsorted(sets[j], sets[i])
            at[at == size[j]] = 0
            both = int((sets[j][at] == sets[i]).sum())
            if both * (1 + share) >= share * (size[i] + size[j]) - 1e-9:
                found[[i, j]] += 1
                if not joined:
                    out.append((int(nodes[i]), int(nodes[j])))
                    label[label == label[j]] = label[i]
    return out, found


def packed(sig: np.ndarray, node: np.ndarray, parts: int) -> pa.RecordBatch:
    """One row per part that has signatures: its nodes, how many signatures each has, and the signatures' 48 bits.

    A part holds few enough signatures for these to tell them apart; two that agree by chance only make a candidate more.
    """
    part = (mix(sig ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(parts)).astype(np.int64)
    by = np.lexsort((node, part))
    part, node, sig = part[by], node[by], sig[by]
    first = np.ones(len(part), bool)
    first[1:] = part[1:] != part[:-1]
    row = np.append(np.flatnonzero(first), len(part))
    first[1:] |= node[1:] != node[:-1]
    run = np.append(np.flatnonzero(first), len(part))
    counts = np.diff(run).astype(np.uint32)
    at = np.searchsorted(run, row)
    low = sig.view(np.uint8).reshape(-1, 8)[:, :6]
    columns = [_binaries(node[run[:-1]], at), _binaries(counts, at), _binaries(low, row)]
    return pa.RecordBatch.from_arrays([pa.array(part[row[:-1]]), *columns], ["part", "nodes", "counts", "sigs"])


def _binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of values[bounds[i]:bounds[i + 1]] for each i."""
    width = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    offsets = (bounds * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _joined_bytes(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8)


def pairs_of(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, firm): all pairs of the nodes of a signature that at most FEW have; of others each with the least one, firm as
    they stand for pairs that aren't made: see firm_pairs."""
    by = np.lexsort((node, sig))
    sig, node = sig[by], node[by]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node = sig[new], node[new]
    begin = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(sig)))
    out = []
    for r in range(2, FEW + 1):
        at = begin[size == r]
        i, j = np.triu_indices(r, 1)
        out.append(np.stack([node[at[:, None] + i].ravel(), node[at[:, None] + j].ravel(), np.zeros(len(at) * len(i), np.int64)]))
    head = np.repeat(node[begin], size)
    rest = np.repeat(size > FEW, size) & (node != head)
    out.append(np.stack([head[rest], node[rest], np.ones(int(rest.sum()), np.int64)]))
    a, b, firm = np.unique(np.concatenate(out, 1), axis=1)
    return a, b, firm.astype(bool)


def candidates(rows: DataFrame) -> DataFrame:
    """(a, b, firm) of classes with a signature in common, from rows of `packed`.

    A function of its own, so that nothing holds the largest shuffle's files when it is over.
    """

    def meet(t: pa.Table) -> pa.Table:
        node = np.repeat(_joined_bytes(t.column("nodes")).view(np.int64), _joined_bytes(t.column("counts")).view(np.uint32))
        sig = np.zeros((len(node), 8), np.uint8)
        sig[:, :6] = _joined_bytes(t.column("sigs")).reshape(-1, 6)
        return pa.table([pa.array(c) for c in pairs_of(sig.view(np.uint64).ravel(), node)], ["a", "b", "firm"])

    met = rows.groupBy("part").applyInArrow(meet, "a long, b long, firm boolean")
    return stored(met.groupBy("a", "b").agg(F.bool_or("firm").alias("firm")), "met")


def alike(n: np.ndarray, parity: Parities, at: np.ndarray, left: np.ndarray, right: np.ndarray, share: float) -> list[tuple[int, int]]:
    """Pairs that join all sets that may be similar: sizes and parities (rows at) don't rule out that they are.

    left and right: which sets are in either block. What is joined already is not compared.
    """
    label, out, every = np.arange(len(n)), [], np.arange(len(n))
    for i in np.flatnonzero(left):
        js = np.flatnonzero(right & (label != label[i]) & (~left | (every > i)) & (np.minimum(n[i], n) >= np.maximum(n[i], n) * share - 1e-6))
        if len(js):
            js = js[parity.differ(np.repeat(at[i], len(js)), parity, at[js]) <= most_different(n[i] + n[js], share)]
        if len(js):
            _, one = np.unique(label[js], return_index=True)
            out += [(int(i), int(j)) for j in js[one]]
            label[np.isin(label, label[js])] = label[i]
    return out


def most_different(sizes: np.ndarray, share: float) -> np.ndarray:
    """In how many shingles two similar sets of so many in all differ at most."""
    return sizes * ((1 - share) / (1 + share)) + 1e-6


def firm_pairs(firm: DataFrame, known: DataFrame, share: float) -> DataFrame:
    """Pairs (a, b) that join all sets which share a head and may be similar.

    firm: each head (a) and the sets (b) with a signature in common with it; known: node, n, parity. So sets that share a
    frequent signature share a head. A head's sets are dealt to blocks, each two of which meet in a tile.
    """
    held = firm.select(F.col("a").alias("head"), F.col("b").alias("node")).unionByName(firm.select(F.col("a").alias("head"), F.col("a").alias("node")).distinct())
    heads = stored(held.groupBy("head").agg(F.ceil(F.count("*") / FIRM_BLOCK).cast("int").alias("blocks"), F.count("*").alias("rows")), "heads")
    total = heads.agg(F.coalesce(F.sum(F.col("blocks") * F.col("rows")), F.lit(0)).alias("rows")).first()["rows"]
    own, x = F.col("own"), F.col("x")
    dealt = held.join(heads, "head").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("head", F.least(own, x).alias("i"), F.greatest(own, x).alias("j"), "node", (own <= x).alias("left"), (own >= x).alias("right")).join(known, "node")

    def compared(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("head", "i", "j", "node")]).combine_chunks()
        at = np.stack([t.column(c).to_numpy() for c in ("head", "i", "j")])
        first = np.flatnonzero(np.append(True, (at[:, 1:] != at[:, :-1]).any(0)))
        node, n, left, right = (t.column(c).to_numpy() for c in ("node", "n", "left", "right"))
        parity, rows = Parities(t.column("parity").chunk(0)), np.arange(len(node))
        out = [np.zeros((0, 2), np.int64)]
        for low, high in zip(first, np.append(first[1:], len(node))):
            joined = alike(n[low:high], parity, *(c[low:high] for c in (rows, left, right)), share)
            out.append(node[low:high][np.array(joined, np.int64).reshape(-1, 2)])
        a, b = np.unique(np.concatenate(out), axis=0).T
        return pa.table([pa.array(a), pa.array(b)], ["a", "b"])

    task = F.pmod(F.xxhash64("head", "i", "j"), F.lit(1 + total // FIRM_ROWS))
    return dealt.groupBy(task.alias("task")).applyInArrow(compared, "a long, b long")


def possible(met: DataFrame, sets: DataFrame, classes: DataFrame, share: float) -> DataFrame:
    """Pairs (a, b) that join all those with a signature in common that may be similar: sizes and parities don't rule it out."""
    nodes = met.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    chosen = classes.join(nodes, "node", "left_semi").select(F.col("node").alias("its"), "rep")
    known = sets.join(chosen, (F.col("node") == F.col("its")) & (F.col("doc_id") == F.col("rep"))).select("node", "n", "parity").dropDuplicates(["node"])
    known = stored(known, "parities")
    side = lambda x: known.select(F.col("node").alias(x), F.struct("n", "parity").alias(f"of_{x}"))
    loose = met.where("not firm").join(side("a"), "a").join(side("b"), "b")
    n_a, n_b = F.col("of_a.n"), F.col("of_b.n")
    loose = loose.where(F.least(n_a, n_b) >= F.greatest(n_a, n_b) * share - 1e-6).select("a", "b", (n_a + n_b).alias("n"), F.col("of_a.parity").alias("x"), F.col("of_b.parity").alias("y"))

    @lean
    def left_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.arange(batch.num_rows)
            keep = Parities(batch.column(3)).differ(rows, Parities(batch.column(4)), rows) <= most_different(batch.column(2).to_numpy(), share)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return loose.mapInArrow(left_over, "a long, b long").unionByName(firm_pairs(met.where("firm").select("a", "b"), known, share))


def near_groups(docs: DataFrame, k: int = 5, share: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links (Jaccard similarity of at least share) reach.

    A text without words, or null, has no shingles and is linked with nothing; fewer than k words are one
    shingle. Rows with one doc_id are variants of one document, and each gets its own links' component. Documents
    without doc_id are left out. An empty table gives no rows; long texts are taken whole.
    """
    return near_rows(docs, k, share).select("doc_id", "n_shingles", "component_id")


def near_links(docs: DataFrame, k: int = 5, share: float = 0.8) -> DataFrame:
    """near_groups with n_links: with how many other sets of shingles a row's own is linked. All candidates are verified.

    Rows of one set have the same links and aren't counted as links themselves.
    """
    return near_rows(docs, k, share, every=True).select("doc_id", "n_shingles", "component_id", "n_links")


def one_of_each(docs: DataFrame, k: int = 5, share: float = 0.8) -> DataFrame:
    """docs without near copies: of the texts that links join, one of the smallest doc_id stays, in one row.

    Where that doc_id has several of these texts, the one with the least hash stays, and of rows alike in doc_id and
    text the one with the least hash over all columns. Texts of one doc_id that no links join both stay. A text
    without words is joined with equal ones of its doc_id only. Rows without doc_id stay as they are.
    """
    rows = near_rows(docs, k, share).where("doc_id = component_id")
    kept = rows.groupBy(F.col("n_shingles") > 0, "label").agg(F.min(F.struct("doc_id", "key")).alias("least")).select(F.col("least.doc_id").alias("kept_id"), F.col("least.key").alias("kept_key"))
    text = F.col("text").cast("string")
    whole = docs.where("doc_id is not null").select(row_of(docs), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("key"))
    met = whole.join(kept, (F.col("id") == F.col("kept_id")) & (F.col("key") == F.col("kept_key")), "left_semi")
    one = met.groupBy("id", "key").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return one.select(*unrolled(docs.columns)).unionByName(docs.where("doc_id is null"))


def near_rows(docs: DataFrame, k: int, share: float, every: bool = False) -> DataFrame:
    """doc_id, key (hash of the text), n_shingles, component_id, label (the same for texts that links join) of each row; n_links if every."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    bands = Bands(share)

    @lean
    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, h, rows, sizes in sets_of(b.column(1), k):
                n = len(sizes)
                bits = parity_bits(sizes)
                parity = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(bits // 64)]), pa.int32()), pa.array(parities(h, rows, n, bits)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, n), b.column(2).slice(i, n), pa.array(sizes), pa.array(class_keys(h, rows, n)), parity], ["doc_id", "key", "n", "node", "parity"])

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    sets = stored(keyed.mapInArrow(classed, "doc_id long, key long, n long, node long, parity array<long>"), "sets")
    classes = sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("rows")).first()
    parts = 1 + int(bands.most_signatures(total["n"], total["rows"])) // PART_SIGNATURES

    @lean
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def answer() -> pa.RecordBatch:
            return packed(*shared(*(np.concatenate(c) for c in zip(*held))), parts)

        for b in batches:
            for _, h, rows, sizes in sets_of(b.column(0), k):
                s, r = signatures(h, rows, sizes, bands)
                held.append((s, class_keys(h, rows, len(sizes))[r]))
                if sum(len(s) for s, _ in held) >= HELD_SIGNATURES:
                    yield answer()
                    held.clear()
        if any(len(s) for s, _ in held):
            yield answer()

    met = candidates(docs.select("text").mapInArrow(signed, "part long, nodes binary, counts binary, sigs binary"))
    release(docs.sparkSession)
    groups = components(possible(met, sets, classes, share)).withColumnRenamed("component", "grp")

    edge = F.floor(F.log(F.col("n").cast("double")) / math.log(band_ratio(share)) + 1e-9).cast("int")
    members = stored(groups.join(classes, "node").withColumn("band", edge), "members")
    a_block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_CLASSES), F.floor(F.lit(BLOCK_SHINGLES) / F.max("n"))))
    tiles = members.groupBy("grp", "band").agg(F.ceil(F.count("*") / a_block).cast("int").alias("blocks"), (F.count("*") > 1).alias("several"))
    tiles = stored(tiles, "tiles")
    below = tiles.select("grp", (F.col("band") + 1).alias("band"), F.col("blocks").alias("blocks_below"))
    above = tiles.select("grp", (F.col("band") - 1).alias("band"), F.col("blocks").alias("blocks_above"))
    tiles = tiles.join(below, ["grp", "band"], "left").join(above, ["grp", "band"], "left").na.fill(0, ["blocks_below", "blocks_above"])
    tiles = stored(tiles, "tiles")  # the join's both sides are dealt alike then, and Spark may split a large group
    dealt = members.join(tiles, ["grp", "band"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    tile = lambda band, i, up, j, left, right: F.struct(band.alias("band"), i.alias("i"), up.alias("up"), j.alias("j"), left.alias("left"), right.alias("right"))
    band, own, yes, no = F.col("band"), F.col("own"), F.lit(True), F.lit(False)
    # A band of one block is compared with itself in the tile where it meets the next band's first block.
    merged = (F.col("blocks") == 1) & (F.col("blocks_above") > 0)
    same = F.transform(upto(F.when(F.col("several") & ~merged, F.col("blocks")).otherwise(0)), lambda x: tile(band, F.least(own, x), F.lit(0), F.greatest(own, x), own <= x, own >= x))
    up = F.transform(upto(F.col("blocks_above")), lambda x: tile(band, own, F.lit(1), x, yes, merged & (x == 0)))
    down = F.transform(upto(F.col("blocks_below")), lambda x: tile(band - 1, x, F.lit(1), own, no, yes))

    @lean
    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, h, rows, sizes in sets_of(b.column(1), k):
                n = len(sizes)
                keys = class_keys(h, rows, n)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                arrays = pa.ListArray.from_arrays(offsets, pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, n), pa.array(keys), arrays], ["at", "key", "shingles"])

    # The places go to the texts, so that arrays are shuffled once, to their tiles.
    placed = dealt.select("rep", F.struct("node", "grp", F.concat(same, up, down).alias("tiles")).alias("p")).where(F.size("p.tiles") > 0)
    placed = placed.groupBy("rep").agg(F.collect_list("p").alias("p"))
    texts = docs.join(placed, docs["doc_id"] == placed["rep"]).select("p", "text")
    kind = StructType([StructField("at", texts.schema["p"].dataType), StructField("key", LongType()), StructField("shingles", ArrayType(LongType()))])
    arrays = texts.mapInArrow(as_sets, kind).withColumn("p", F.explode("at")).where("p.node = key")
    full = arrays.select(F.col("p.node").alias("node"), F.col("p.grp").alias("grp"), F.explode("p.tiles").alias("t"), "shingles").select("node", "grp", "t.*", "shingles")

    def joined(t: pa.Table) -> pa.Table:
        nodes, one = np.unique(t.column("node").to_numpy(), return_index=True)  # rows repeated under one doc_id
        t = t.take(pa.array(one)).combine_chunks()
        flat = t.column("shingles").chunk(0)
        at = flat.offsets.to_numpy()
        values = flat.values.to_numpy().view(np.uint64)
        sets_ = [values[a:b] for a, b in zip(at, at[1:])]
        found, counts = linked(sets_, nodes, *(t.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right")), share, every) if len(nodes) > 1 else ([], np.zeros(0, np.int64))
        some = np.flatnonzero(counts) if every else counts[:0]
        a, b = [x[0] for x in found] + nodes[some].tolist(), [x[1] for x in found] + [None] * len(some)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([None] * len(found) + counts[some].tolist(), pa.int64())], ["a", "b", "n"])

    links = stored(full.groupBy("grp", "band", "i", "up", "j").applyInArrow(joined, "a long, b long, n long"), "links")
    ends = components(links.where("b is not null")).withColumnRenamed("component", "label")
    lowest = ends.join(classes, "node").groupBy("label").agg(F.min("rep").alias("low"))
    of_class = classes.join(ends, "node", "left").join(lowest, "label", "left").select("node", F.coalesce("low", "rep").alias("component_id"), F.coalesce("label", "node").alias("label"))
    counted = []
    if every:
        of_class = of_class.join(links.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links")), "node", "left")
        counted = [F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")]
    out = sets.join(of_class, "node", "left")
    some = F.col("n") > 0
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), F.when(some, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(some, F.col("label")).otherwise(F.xxhash64("doc_id", "key")).alias("label"), *counted)
