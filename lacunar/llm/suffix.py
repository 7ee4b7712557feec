"""Removal of repeated byte strings with suffix arrays.

A string of LENGTH bytes is anchored at its least hashed K-gram (the leftmost of equal ones), so equal
strings have equal anchors at equal places. Each anchor owns a run of string starts, with the bytes
that these strings span as its context. Contexts alike are one; of a context's occurrences all but
the earliest are repeats outright. Only anchors with several different contexts need a closer look:
their contexts meet by anchor, are narrowed to what may be in another one (alike ones being one
again), and a suffix array over what is left brings equal strings together.

The suffix array is made by linear grouping: suffixes are grouped by their longest Lyndon prefix so
far, and groups are taken in descending order; each member's pointer to the previous smaller suffix
says which suffix's prefix the group's word extends. A last pass over the groups in ascending order
emits each group's members by the rank of what follows their Lyndon prefix. Nothing is renamed or
sorted recursively.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from lacunar.llm._text import _BASE, _INVERSE, lean, mix, powers, slices
from lacunar.sources.store import stored

LENGTH = 100
K = 32
#: A suffix array takes contexts of about so many bytes at once, before they are narrowed.
ARRAY_BYTES = 1 << 19
#: Anchors in more rows than this are resolved string by string, with sums made before the shuffle.
HOT_ROWS = 4096
#: Anchors with more than this share of all rows, as one in GUESS documents tells, have them dealt to SALTS tasks.
HOT_SHARE, GUESS, SALTS = 1e-4, 16, 64
#: A longer text's anchors are found in pieces of so many string starts.
PIECE = 1 << 20

SPANS = "doc_id long, b long, e long"


def suffix_array(text: list[int]) -> list[int]:
    """The suffixes of text in order; its last symbol must be less than all others."""
    n = len(text)
    if n < 2:
        return list(range(n))
    sa = sorted(range(n), key=text.__getitem__)
    group, place, size = [0] * n, [0] * n, {}
    start = 0
    for at, s in enumerate(sa):
        if text[s] != text[sa[start]]:
            size[start] = at - start
            start = at
        group[s], place[s] = start, at
    size[start] = n - start
    prev = [-1] * n
    end = n
    while end > 0:
        g = group[sa[end - 1]]
        members = sa[g:end] if end - g == 1 else sorted(sa[g:end])
        counts: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] > g:
                j = prev[j]
            if j >= 0 and group[j] == g:
                j = prev[j]  # the word repeats: both extend the same suffix
            prev[i] = j
            if j >= 0:
                counts[j] = counts.get(j, 0) + 1
        if len(counts) == 1:
            (p, _), = counts.items()
            h = group[p]
            m = size[h]
            if m > 1:  # p alone goes to the end of its group
                last = h + m - 1
                q, at = sa[last], place[p]
                sa[at], sa[last] = q, p
                place[q], place[p] = at, last
                size[h] = m - 1
                group[p] = last
                size[last] = 1
        elif counts:
            by: dict[int, list[int]] = defaultdict(list)
            for p, c in counts.items():
                by[c].append(p)
            for c in sorted(by, reverse=True):
                moved: dict[int, int] = {}
                for p in by[c]:
                    h = group[p]
                    last = h + size[h] - 1 - moved.get(h, 0)
                    q, at = sa[last], place[p]
                    sa[at], sa[last] = q, p
                    place[q], place[p] = at, last
                    moved[h] = moved.get(h, 0) + 1
                for h, m in moved.items():
                    first = h + size[h] - m
                    if m < size[h]:
                        for at in range(first, first + m):
                            group[sa[at]] = first
                        size[first] = m
                        size[h] -= m
        end = g
    done = bytearray(n)
    out, free = [0] * n, {}
    out[0] = n - 1
    done[n - 1] = 1
    for at in range(n):
        s = out[at] - 1
        while s >= 0 and not done[s]:
            done[s] = 1
            slot = group[s]
            nxt = free.get(slot, slot)
            out[nxt] = s
            free[slot] = nxt + 1
            s = prev[s]
    return out


def _alike(rows: list[tuple[int, bytes]]) -> list[int]:
    """Of each (anchor, bytes): how many first bytes it shares at most with another row of its anchor."""
    out = [0] * len(rows)
    order = sorted(range(len(rows)), key=rows.__getitem__)
    for i, j in zip(order, order[1:]):
        if rows[i][0] == rows[j][0]:
            a, b = rows[i][1], rows[j][1]
            n = min(len(a), len(b))
            differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
            same = n - (differ.bit_length() + 7) // 8
            out[i], out[j] = max(out[i], same), max(out[j], same)
    return out


def narrowed(rows: list[tuple[int, int, int, bytes, int]], length: int = LENGTH) -> list[tuple[int, int, bytes]]:
    """(document, start, context) of what another context of the same anchor may hold too.

    rows: anchor, document, start, context, and the anchor's place in it. Equal strings agree to the left and to the
    right of their anchor, so a string that goes further on either side than any other context agrees is alone.
    """
    left = _alike([(kh, context[:a][::-1]) for kh, _, _, context, a in rows])
    right = _alike([(kh, context[a:]) for kh, _, _, context, a in rows])
    out = []
    for (_, doc, s0, context, a), x, y in zip(rows, left, right):
        first, last = a - x, min(a + y, len(context)) - length
        if last >= first:
            out.append((doc, s0 + first, context[first : last + length]))
    return out


def firsts_of(contexts: list[tuple[int, int, bytes]]) -> tuple[list, list]:
    """The earliest of each (document, start, context) alike in context, and the others, which are repeats outright."""
    first: dict[bytes, tuple[int, int, bytes]] = {}
    later = []
    for x in sorted(contexts, key=lambda x: x[:2]):
        if first.setdefault(x[2], x) is not x:
            later.append(x)
    return list(first.values()), [x for x in later if x[:2] != first[x[2]][:2]]


def repeated_starts(contexts: list[bytes], at: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """(document, start) of each string of the contexts that is also in them at an earlier one; at: where each context begins."""
    text: list[int] = []
    owner, begin = [], []
    for c, context in enumerate(contexts):
        owner += [c] * (len(context) + 1)
        begin.append(len(text))
        text += [b + 2 for b in context]
        text.append(1)
    text.append(0)
    raw = b"\0".join(contexts)
    out, run, last = [], [], None

    def close():
        if len(run) > 1:
            where = sorted((at[owner[p]][0], at[owner[p]][1] + p - begin[owner[p]]) for p in run)
            out.extend(x for x in where[1:] if x != where[0])

    for p in suffix_array(text):
        if p >= len(owner) or p - begin[owner[p]] + length > len(contexts[owner[p]]):
            continue
        this = raw[p : p + length]
        if this != last:
            close()
            run, last = [], this
        run.append(p)
    close()
    return out


def anchors(data: np.ndarray, at: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """Of the rows that begin at `at`: each anchor's hash, context hash, row, first and last string start and own place (within data)."""
    n = len(data)
    none = (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 4
    if n < length:
        return none
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=sums[1:])
    back = powers(_INVERSE, n + 1)
    h = mix((sums[k:] - sums[:-k]) * back[: n - k + 1])
    low = np.uint64((1 << 28) - 1)
    code = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    w, step = length - k + 1, 1
    best = code
    while step * 2 <= w:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    if step < w:
        best = np.minimum(best[: n - length + 1], best[w - step : w - step + n - length + 1])
    best = best[: n - length + 1]
    row = np.searchsorted(at, np.arange(len(best)), "right") - 1
    inside = np.arange(len(best)) + length <= at[row + 1]
    start = np.flatnonzero(inside)
    if not len(start):
        return none
    anchor, row = (best[start] & low).astype(np.int64), row[start]
    first = np.ones(len(start), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    s0 = start[first]
    s1 = start[np.append(np.flatnonzero(first)[1:] - 1, len(start) - 1)]
    a = anchor[first]
    context = (sums[s1 + length] - sums[s0]) * back[s0]
    context = mix(context + ((a - s0) * 4096 + (s1 - s0)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h[a], context, row[first], s0, s1, a


def _found(batch: pa.RecordBatch, length: int, piece: int):
    """Anchor, context, document, first and last start and own place within it, of a batch's anchors, whether the batch has the context earlier, and whether the same row."""
    parts = []
    ids = np.asarray(batch.column(0))
    for i, data, at in slices(batch.column(1), piece):
        if len(at) > 2 or len(data) < piece + length:
            pieces = [(0, data, at)]
        else:  # a run of strings that is cut in two makes two contexts of one anchor, which meet like others
            pieces = [(c, d := data[c : c + piece + length - 1], np.array([0, len(d)])) for c in range(0, len(data) - length + 1, piece)]
        for c, data, at in pieces:
            kh, ch, row, s0, s1, own = anchors(data, at, length)
            parts.append((kh.view(np.int64), ch.view(np.int64), ids[i + row], c + s0 - at[row], c + s1 - at[row], c + own - at[row]))
    kh, ch, doc, s0, s1, own = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 6
    by = np.lexsort((s0, doc, ch, kh))
    kh, ch, doc, s0, s1, own = (c[by] for c in (kh, ch, doc, s0, s1, own))
    again = np.zeros(len(kh), bool)
    again[1:] = (kh[1:] == kh[:-1]) & (ch[1:] == ch[:-1])
    if again.any():  # one document's row repeated is not earlier than itself
        head = np.maximum.accumulate(np.where(again, 0, np.arange(len(kh))))
        same = (doc == doc[head]) & (s0 == s0[head])
        return kh, ch, doc, s0, s1, own, again & ~same, again & same
    return kh, ch, doc, s0, s1, own, again, again


def united(doc: np.ndarray, b: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal spans by document."""
    by = np.lexsort((b, doc))
    doc, b, e = doc[by], b[by], e[by]
    out: list[list[int]] = []
    for d, x, y in zip(doc.tolist(), b.tolist(), e.tolist()):
        if out and out[-1][0] == d and x <= out[-1][2]:
            out[-1][2] = max(out[-1][2], y)
        else:
            out.append([d, x, y])
    return tuple(np.array(c, np.int64) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, b, e: byte spans, which may overlap, that make up all bytes in a string of `length` bytes that starts earlier.

    Earlier is a smaller doc_id or, in one document, an earlier start. A null or short text has none; a null doc_id
    takes no part. Rows repeated under one doc_id are one document.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")

    def table(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    piece = PIECE

    @lean
    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kh, ch, doc, s0, s1, own, again, twin = _found(batch, length, piece)
            keep = np.flatnonzero(~again & ~twin)
            for i in range(0, len(keep), 1 << 17):
                j = keep[i : i + (1 << 17)]
                yield table([kh[j], ch[j], doc[j], s0[j] << 16 | (s1 - s0)[j] << 8 | (own - s0)[j]], ["kh", "ch", "doc_id", "at"])

    @lean
    def again_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, doc, s0, s1, _, again, _ = _found(batch, length, piece)
            yield table(list(united(doc[again], s0[again], s1[again] + length)), ["doc_id", "b", "e"])

    anchored = lambda x: x.mapInArrow(firsts, "kh long, ch long, doc_id long, at long")
    # Which anchors are hottest is guessed from one in GUESS documents. Their rows are dealt out by context too; a guess
    # changes only where rows meet, not the result.
    seen = Observation()
    some = anchored(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(GUESS)) == 0)).groupBy("kh").count().observe(seen, F.sum("count").alias("rows"))
    often = some.where(F.col("count") > HOT_ROWS / GUESS).orderBy(F.desc("count"), "kh").limit(int(1 / HOT_SHARE)).collect()
    hottest = [(r["kh"], True) for r in often if r["count"] > HOT_SHARE * seen.get["rows"]]
    rows = anchored(docs)
    rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(hottest, "kh long, hot boolean")), "kh", "left") if hottest else rows.withColumn("hot", F.lit(None).cast("boolean"))
    rows = rows.withColumn("salt", F.when(F.col("hot"), F.pmod("ch", F.lit(SALTS))).otherwise(0))
    anchor = Window.partitionBy("kh", "salt")
    occurrence = Window.partitionBy("kh", "salt", "ch").orderBy("doc_id", "at")
    hits = rows.withColumn("r", F.rank().over(occurrence)).withColumn("n", F.count("*").over(anchor))
    # where an anchor's rows are apart, a closer look is taken at any of its contexts
    hits = hits.withColumn("several", F.coalesce("hot", F.min("ch").over(anchor) != F.max("ch").over(anchor)))
    hits = hits.where("(n > 1 or hot) and (r > 1 or several)")
    start = F.shiftright("at", 16)
    last, own = start + F.shiftright("at", 8).bitwiseAND(F.lit(255)), F.col("at").bitwiseAND(F.lit(255))
    hits = stored(hits.select("kh", "doc_id", start.alias("s0"), last.alias("s1"), own.alias("a"), (F.col("r") > 1).alias("again"), F.coalesce("hot", F.col("n") > HOT_ROWS).alias("hot")), "hits")
    known = hits.where("again").select("doc_id", F.col("s0").alias("b"), (F.col("s1") + length).alias("e"))

    wanted = hits.where("not again").groupBy("doc_id").agg(F.collect_list(F.struct("kh", "s0", "s1", "a", "hot")).alias("w")).select(F.col("doc_id").alias("_id"), "w")

    @lean
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text, asked in zip(*(c.to_pylist() for c in b.columns)):
                raw = text.encode()
                for x in asked:
                    for column, value in zip(out, (x["kh"], doc, x["s0"], raw[x["s0"] : x["s1"] + length], x["a"], x["hot"])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_()))], ["kh", "doc_id", "s0", "context", "a", "hot"])

    met = docs.dropDuplicates(["doc_id"]).join(wanted, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "w")
    close = stored(met.mapInArrow(contexts, "kh long, doc_id long, s0 long, context binary, a long, hot boolean"), "contexts")

    @lean
    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes, int]] = []
        size = 0

        def answer() -> pa.RecordBatch:
            left, later = firsts_of(narrowed(held, length))
            starts = repeated_starts([x[2] for x in left], [x[:2] for x in left], length)
            spans = np.array([(doc, b, b + length) for doc, b in starts] + [(doc, b, b + len(x)) for doc, b, x in later], np.int64).reshape(-1, 3)
            return table(list(united(*spans.T)), ["doc_id", "b", "e"])

        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= ARRAY_BYTES and x[0] != held[-1][0]:
                    yield answer()
                    held, size = [], 0
                held.append(x)
                size += len(x[3])
        if held:
            yield answer()

    cold = close.where("not hot").select("kh", "doc_id", "s0", "context", "a").repartition("kh").sortWithinPartitions("kh", "doc_id", "s0")
    closer = cold.mapInArrow(arrays, SPANS)

    @lean
    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1 << 10):
                rows = list(zip(*(c.to_pylist() for c in whole.slice(at, 1 << 10).columns)))
                made = [(context[i : i + length], doc, s0 + i) for doc, s0, context in rows for i in range(len(context) - length + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.binary(), pa.int64(), pa.int64()))], ["g", "doc_id", "s"])

    each = close.where("hot").select("doc_id", "s0", "context").mapInArrow(strings, "g binary, doc_id long, s long").select(F.xxhash64("g").alias("g"), F.xxhash64(F.lit(1), "g").alias("g2"), "doc_id", "s")
    least = each.groupBy("g", "g2").agg(F.min(F.struct("doc_id", "s")).alias("least"), F.count("*").alias("n")).where("n > 1")
    hotter = each.join(least, ["g", "g2"]).where(F.struct("doc_id", "s") != F.col("least")).select("doc_id", F.col("s").alias("b"), (F.col("s") + length).alias("e"))
    return known.unionByName(closer).unionByName(hotter).unionByName(docs.mapInArrow(again_, SPANS))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, spans (array of struct b, e: maximal removed byte spans), kept (the remaining bytes) of every row."""
    spans = repeats(docs, length).groupBy("doc_id").agg(F.collect_list(F.struct("b", "e")).alias("s")).select(F.col("doc_id").alias("_id"), "s")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    met = whole.join(spans, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "s")

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, spans, kept = [], [], []
            for text, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw, at, parts, runs = text.encode(), 0, [], []
                for x in sorted((x["b"], x["e"]) for x in s or []):
                    if runs and x[0] <= runs[-1]["e"]:
                        runs[-1]["e"] = max(runs[-1]["e"], min(x[1], len(raw)))
                    elif x[0] < len(raw):
                        runs.append({"b": x[0], "e": min(x[1], len(raw))})
                for r in runs:
                    parts.append(raw[at : r["b"]])
                    at = r["e"]
                parts.append(raw[at:])
                n_bytes.append(len(raw))
                spans.append(runs)
                kept.append(b"".join(parts))
            kind = pa.list_(pa.struct([("b", pa.int64()), ("e", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return met.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<b:long,e:long>>, kept binary")
