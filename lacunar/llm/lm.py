"""Document log-likelihood by a gated recurrent language model in numpy.

Counts of every training token come from the whole training corpus. The network has an output for the
end, for each of the most frequent words, and for each spelling: all other words are dealt to
spellings by their last two bytes, and within a spelling smoothed counts share out its probability. So
each word, seen in training or not, has a proper probability that depends on what is before it. The
number of outputs grows as the square root of the number of distinct words. The softmax is factored: first
a class of outputs, then the output within it, with as many classes as a class has outputs.

Training is truncated backpropagation through windows of WINDOW tokens with the state carried on; each
of a number of replicas that grows with the input trains on its own documents, and the replicas'
weights are averaged each round. The rounds and replicas share out all training documents, each of which
is learnt from once. In scoring the state is carried across windows to the end of each document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacunar.llm._dist import salt
from lacunar.llm._text import lean, lowered, mix, slices, span_hashes, words
from lacunar.sources.store import stored

HELD_OUT = (7, 2)
#: The classes are OUTPUT_GROWTH times the fourth root of the number of distinct words, rounded up to a multiple of 8.
OUTPUT_GROWTH = 1.25
#: One output in so many stands for a spelling.
SPELLING_SHARE = 4
HIDDEN = 16
WINDOW = 16
LANES = 128
LEAST_WINDOWS = 32
ROUNDS = 2
REPLICA_TOKENS = 1_000_000
RATE = 0.01
#: Counts of at most so many tokens, the most frequent ones, are broadcast; the others' are joined.
BROADCAST_COUNTS = 1 << 18
SCORE_WINDOW = 32
SCORE_BLOCK = 1 << 16
#: Texts are taken apart in slices of about so many bytes, which a core's cache holds.
SLICE = 1 << 17
#: Within a block, so many tokens' scores are made at once: as many as a core's cache holds.
CACHED_ROWS = 1 << 10
#: exp of scores within this is exact enough as they are.
FAR = 60.0
#: Weights are summed over replicas in parts of so many.
WEIGHTS_A_PART = 1 << 12
END = 0
#: Stands for the end token among word hashes.
END_HASH = -(1 << 63) + 12345


def shapes(classes: int, hidden: int) -> dict[str, tuple[int, ...]]:
    k, n = classes, hidden
    return {"E": (k * k, n), "W": (n, 3 * n), "b": (3 * n,), "U": (n, 3 * n), "C": (n, k), "c": (k,), "O": (k, k, n), "o": (k, k)}


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([a.ravel() for a in p.values()])


def unflat(x: np.ndarray, classes: int, hidden: int) -> dict[str, np.ndarray]:
    """Views of x."""
    out, at = {}, 0
    for name, s in shapes(classes, hidden).items():
        n = int(np.prod(s))
        out[name] = x[at : at + n].reshape(s)
        at += n
    return out


def initial(mass: np.ndarray, hidden: int = HIDDEN, seed: int = 5) -> dict[str, np.ndarray]:
    """Small random weights; biases that give the outputs' probabilities `mass`, a square number of them."""
    k = int(round(len(mass) ** 0.5))
    rng = np.random.default_rng(seed)
    p = {name: rng.normal(0, 0.15 if name in "EWU" else 0.05, s).astype(np.float32) for name, s in shapes(k, hidden).items()}
    q = np.maximum(mass, 1e-12).reshape(k, k)
    p["b"][:] = 0
    p["c"] = np.log(q.sum(1)).astype(np.float32)
    p["o"] = (np.log(q) - np.log(q.sum(1, keepdims=True))).astype(np.float32)
    return p


def by_gate(w: np.ndarray) -> np.ndarray:
    """The columns of each gate by themselves: (3, rows, hidden). Gates apart are contiguous."""
    return np.ascontiguousarray(w.reshape(len(w), 3, -1).transpose(1, 0, 2))


def turned(w: np.ndarray) -> np.ndarray:
    """by_gate's weights with those of update and reset negated: their sigmoid is 1 / (1 + exp(-x))."""
    return w * np.array([-1, -1, 1], w.dtype)[:, None, None]


def step(x: np.ndarray, h: np.ndarray, a: np.ndarray, zr: np.ndarray, cand: np.ndarray, out: np.ndarray) -> None:
    """One gated recurrent step into zr, cand and out; x and a: the input's and the state's parts of the gates, turned."""
    np.add(x[:2], a[:2], out=zr)
    np.exp(zr, out=zr)  # where it overflows, the sigmoid is 0
    zr += 1
    np.reciprocal(zr, out=zr)
    np.multiply(zr[1], a[2], out=cand)
    cand += x[2]
    np.tanh(cand, out=cand)
    np.subtract(h, cand, out=out)
    out *= zr[0]
    out += cand


def exponents(s: np.ndarray) -> np.ndarray:
    """exp of each row's scores, in place, less their largest where they are far from 0; the row sums."""
    if s.size and not -FAR < s.min() <= s.max() < FAR:
        s -= s.max(1, keepdims=True)
    np.exp(s, out=s)
    return s @ np.ones(s.shape[1], s.dtype)  # much faster than a sum along a short axis


def by_class(y: np.ndarray, classes: int):
    """Order by class; of the ordered tokens: class, place in it; and each class that occurs with its slice."""
    cls = y // classes
    by = np.argsort(cls.astype(np.uint16), kind="stable")  # short numbers are sorted by their digits
    cls = cls[by]
    cuts = np.append(0, np.cumsum(np.bincount(cls, minlength=classes))).tolist()
    parts = [(c, slice(cuts[c], cuts[c + 1])) for c in range(classes) if cuts[c] < cuts[c + 1]]
    return by, cls, y[by] - cls * classes, parts


def with_one(a: np.ndarray) -> np.ndarray:
    """A last column of ones, whose weights are biases: products then add these and sum their gradients."""
    out = np.empty((len(a), a.shape[1] + 1), a.dtype)
    out[:, :-1], out[:, -1] = a, 1
    return out


def softmax_weights(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of the classes (hidden + 1, classes) and, in each class, of its outputs (classes, outputs, hidden + 1), biases last."""
    return np.concatenate([p["C"], p["c"][None]]), np.concatenate([p["O"], p["o"][:, :, None]], axis=2)


def log_probabilities(weights: tuple[np.ndarray, np.ndarray], hs: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log probability of each token y after the state hs; the scores of so many tokens at once as caches hold."""
    top, low = weights
    by, cls, place, parts = by_class(y, len(low))
    h, out = with_one(hs.take(by, axis=0)), np.empty(len(y))

    def found(i: slice, w: np.ndarray, target: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        for a in range(i.start, i.stop, CACHED_ROWS):
            j = slice(a, min(a + CACHED_ROWS, i.stop))
            s = h[j] @ w
            total = exponents(s)
            yield j, np.log(np.maximum(s.reshape(-1).take(np.arange(len(s)) * s.shape[1] + target[j]) / total, 1e-37))

    for j, logs in found(slice(0, len(y)), top, cls):
        out[j] = logs
    for c, i in parts:
        for j, logs in found(i, low[c].T, place):
            out[j] += logs
    back = np.empty_like(out)
    back[by] = out
    return back


@np.errstate(over="ignore")
def loss_and_gradient(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, h: np.ndarray):
    """Mean loss, gradient and last state over a window; x, y: (steps, lanes) token ids. State restarts after an end."""
    steps, lanes = x.shape
    n, k, kind = h.shape[1], len(p["c"]), h.dtype
    total = steps * lanes
    ids = x.ravel()
    e = p["E"].take(ids, axis=0)  # much faster than [ids]
    w, u = by_gate(p["W"]), by_gate(p["U"])
    gates = e @ turned(w)
    gates += turned(by_gate(p["b"][None]))
    gates = gates.reshape(3, steps, lanes, n)
    live = np.repeat(x != END, n).astype(kind).reshape(steps, lanes, n)
    prev, cand, hs = (np.empty((steps, lanes, n), kind) for _ in range(3))
    a, zr, uses = np.empty((3, steps, lanes, n), kind), np.empty((2, steps, lanes, n), kind), turned(u)
    for t in range(steps):
        np.multiply(h, live[t], out=prev[t])
        np.matmul(prev[t], uses, out=a[:, t])
        step(gates[:, t], prev[t], a[:, t], zr[:, t], cand[t], hs[t])
        h = hs[t]
    by, cls, place, parts = by_class(y.ravel(), k)
    states, at = with_one(hs.reshape(total, n).take(by, axis=0)), np.arange(total) * k

    def of(s: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray]:
        """The loss of scores s, and what their gradient, which s becomes, is yet to be multiplied by."""
        sums = exponents(s)
        cells, flat_s = at + target, s.reshape(-1)
        got = flat_s.take(cells)
        flat_s[cells] = got - sums
        return float(np.log(sums).sum() - np.log(np.maximum(got, 1e-37)).sum()), (1 / (sums * total))[:, None].astype(kind)

    g: dict[str, np.ndarray] = {}
    top_weights, low_weights = softmax_weights(p)
    top = states @ top_weights
    loss, scale = of(top, cls)
    got = top.T @ (states * scale)
    g["C"], g["c"] = got[:, :-1].T, got[:, -1]
    back = top @ p["C"].T
    back *= scale
    s = np.empty((total, k), kind)
    for c, i in parts:
        np.dot(states[i], low_weights[c].T, out=s[i])
    lost, scale = of(s, place)
    loss += lost
    states *= scale
    got, low = np.zeros_like(low_weights), np.empty_like(back)
    for c, i in parts:
        np.dot(s[i].T, states[i], out=got[c])
        np.dot(s[i], p["O"][c], out=low[i])
    g["O"], g["o"] = got[:, :, :-1], got[:, :, -1]
    low *= scale
    back += low
    dh = np.empty_like(back)
    dh[by] = back
    dh = dh.reshape(steps, lanes, n)
    z, r = zr
    carry, ut, rest = np.zeros((lanes, n), kind), u.transpose(0, 2, 1), 1 - z
    one, two = np.empty((2, steps, lanes, n), kind), np.empty((2, steps, lanes, n), kind)
    np.multiply(cand, cand, out=one[0])
    np.subtract(1, one[0], out=one[0])
    one[0] *= rest
    np.subtract(prev, cand, out=one[1])
    one[1] *= z
    one[1] *= rest
    two[1] = r
    np.subtract(1, r, out=two[0])
    two[0] *= r
    two[0] *= a[2]
    d = np.empty((4, steps, lanes, n), kind)  # of candidate, update, reset, and the candidate's part of the state
    for t in range(steps - 1, -1, -1):
        carry += dh[t]
        np.multiply(carry, one[:, t], out=d[:2, t])
        np.multiply(d[0, t], two[:, t], out=d[2:, t])
        carry *= z[t]
        for part in np.matmul(d[1:, t], ut):
            carry += part
        carry *= live[t]
    d = d.reshape(4, total, n)
    g["U"] = (prev.reshape(total, n).T @ d[1:]).transpose(1, 0, 2).reshape(n, 3 * n)
    g["W"] = (e.T @ d[:3])[[1, 2, 0]].transpose(1, 0, 2).reshape(n, 3 * n)
    g["b"] = (np.ones(total, kind) @ d[:3])[[1, 2, 0]].ravel()
    de = d[0] @ w[2].T
    de += d[1] @ w[0].T
    de += d[2] @ w[1].T
    order = np.argsort(ids.astype(id_type(k)), kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    g["E"] = np.zeros_like(p["E"])
    g["E"][ids[first]] = np.add.reduceat(de.take(order, axis=0), first, axis=0)
    return loss / total, {name: g[name] for name in p}, h


def train(p: dict[str, np.ndarray], stream: np.ndarray, lanes: int = LANES, window: int = WINDOW, rate: float = RATE, least_windows: int = LEAST_WINDOWS) -> dict[str, np.ndarray]:
    """One pass of truncated backpropagation over a token stream in which each document ends with END.

    The stream is cut into lanes that run side by side, of at least so many windows each.
    """
    lanes = max(1, min(lanes, len(stream) // window // least_windows))
    length = len(stream) // lanes
    if length < 1:
        return p
    before, dealt = np.append(END, stream[:-1]), lanes * length
    x, y = (a[:dealt].reshape(lanes, length).T.copy() for a in (before, stream))
    parts = [(x[a : a + window], y[a : a + window]) for a in range(0, length, window)]
    if dealt < len(stream):  # what the lanes leave over goes on from the last lane
        parts.append((before[dealt:, None], stream[dealt:, None]))
    classes, hidden = len(p["c"]), p["U"].shape[0]
    h, w = np.zeros((lanes, hidden), np.float32), flat(p).astype(np.float32)
    m, v, p = np.zeros_like(w), np.zeros_like(w), unflat(w, classes, hidden)
    for i, (x, y) in enumerate(parts, 1):
        _, g, h = loss_and_gradient(p, x, y, h[-x.shape[1] :])
        g = flat(g)
        if (size := float(np.sqrt(g @ g))) > 1:
            g *= np.float32(1 / size)
        # m and v are sums, not means: 10 and 200 times the means of the gradient and of its square
        damp = (1 - 0.9**i) / (0.1 * rate)
        root, least = np.float32(damp * np.sqrt(0.005 / (1 - 0.995**i))), np.float32(damp * 1e-6)
        m *= np.float32(0.9)
        m += g
        v *= np.float32(0.995)
        g *= g
        v += g
        np.sqrt(v, out=g)
        g *= root
        g += least
        np.divide(m, g, out=g)
        w -= g
    return p


def tokens(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, number of rows, and of their words: hashes, rows, last two bytes as a code) for runs of rows."""
    for i, data, at in slices(texts, SLICE):
        starts, ends, rows = words(data, at)
        low = lowered(data)
        last = low[ends - 1].astype(np.int32)
        before = np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)].astype(np.int32), 256)
        yield i, len(at) - 1, span_hashes(low, starts, ends).view(np.int64), rows, last * 257 + before


def together(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that brings equal hashes together, the hashes in it, and where a run of equal ones begins.

    The order is sorted in the hashes' own low bits, which numpy does far faster than it sorts places by hash; where
    only these bits tell two hashes apart, either may have several runs.
    """
    low = (1 << len(h).bit_length()) - 1
    order = np.sort(h & ~low | np.arange(len(h))) & low
    h = h.take(order)
    return order, h, np.flatnonzero(np.append(len(h) > 0, h[1:] != h[:-1]))


def spelling(code: np.ndarray, spellings: int) -> np.ndarray:
    return (mix(code.astype(np.uint64)) % np.uint64(spellings)).astype(np.int64)


@dataclass
class Vocabulary:
    """What all tasks need of the counts, of bounded size: hashes in order, log10(count + 1), output ids (-1: that of its spelling)."""

    hashes: np.ndarray
    logs: np.ndarray
    outputs: np.ndarray
    #: Output id of each spelling, and log10 of what its words share: their tokens and distinct words, and one for unseen ones.
    spelling_outputs: np.ndarray
    spelling_logs: np.ndarray
    mass: np.ndarray
    tokens: int  # N
    distinct: int  # V
    ends: int

    @property
    def classes(self) -> int:
        return int(round(len(self.mass) ** 0.5))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of each hash, and whether it is there."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        last = len(self.hashes) - 1
        at = np.minimum(self.begins.take(self.prefix(h)), last)
        late = np.flatnonzero(self.hashes.take(at) < h)
        while len(late):  # hashes are even, so that hardly any of them share a prefix
            late = late[at[late] < last]
            at[late] += 1
            late = late[self.hashes.take(at[late]) < h[late]]
        return at, self.hashes.take(at) == h

    def prefix(self, h: np.ndarray) -> np.ndarray:
        bits = len(self.hashes).bit_length() + 1
        return (h >> (64 - bits)) + (1 << (bits - 1))

    @cached_property
    def begins(self) -> np.ndarray:
        """Position of the first hash of each prefix."""
        count = np.bincount(self.prefix(self.hashes), minlength=1 << (len(self.hashes).bit_length() + 1))
        return (np.cumsum(count) - count).astype(np.int32)


def in_training(of: int = HELD_OUT[0], held: int = HELD_OUT[1]) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of, F.lit(-1)) != held


def count_tokens(docs: DataFrame) -> DataFrame:
    """(h, code, c): how often each token is in the texts, ends among them; counted per batch before the shuffle."""

    @lean
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [(np.array([END_HASH]), np.zeros(1, np.int32), np.array([b.num_rows]))]
            for _, _, h, _, code in tokens(b.column(0)):
                order, h, first = together(h)
                parts.append((h[first], code.take(order.take(first)), np.diff(first, append=len(h))))
            h, code, c = (np.concatenate(x) for x in zip(*parts))
            order, h, first = together(h)
            u, code, total = h[first], code.take(order.take(first)), np.add.reduceat(c.take(order), first)
            for i in range(0, len(u), 1 << 17):
                j = slice(i, i + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(u[j]), pa.array(code[j].astype(np.int32)), pa.array(total[j])], ["h", "code", "c"])

    return docs.select("text").mapInArrow(counted, "h long, code int, c long").groupBy("h").agg(F.min("code").alias("code"), F.sum("c").alias("c"))


def classes_for(distinct: int, growth: float = OUTPUT_GROWTH) -> int:
    return max(8, 8 * int(np.ceil(growth * max(1, distinct) ** 0.25 / 8)))


def vocabulary(counts: DataFrame, most: int = BROADCAST_COUNTS, growth: float = OUTPUT_GROWTH) -> Vocabulary:
    """From counts of training tokens. The driver gets the `most` most frequent ones and a row for each two last bytes."""
    seen = counts.where(F.col("h") != END_HASH)
    by_code = seen.groupBy("code").agg(F.sum("c").alias("c"), F.count("*").alias("v")).toArrow()
    ends = counts.where(F.col("h") == END_HASH).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    code, code_c, code_v = (by_code.column(i).to_numpy() for i in range(3))
    distinct = int(code_v.sum()) + (1 if ends else 0)
    k = classes_for(distinct, growth)
    spellings = max(1, k * k // SPELLING_SHARE)
    top = seen.orderBy(F.desc("c"), "h").limit(max(most, k * k)).toArrow()
    h, c, its_code = (top.column(x).to_numpy() for x in ("h", "c", "code"))
    own = min(len(h), k * k - 1 - spellings)
    shared = np.bincount(spelling(code, spellings), weights=code_c, minlength=spellings) - np.bincount(spelling(its_code[:own], spellings), weights=c[:own], minlength=spellings)
    kinds = np.bincount(spelling(code, spellings), weights=code_v, minlength=spellings) - np.bincount(spelling(its_code[:own], spellings), minlength=spellings)
    mass = np.concatenate([c[:own], shared])
    by = np.argsort(-mass, kind="stable")
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(1, len(by) + 1)  # frequent outputs share classes
    full = np.zeros(k * k)
    full[END], full[1 : len(by) + 1] = ends, mass[by]
    full = (full + 0.5) / (full + 0.5).sum()
    outputs = np.full(len(h), -1, np.int64)
    outputs[:own] = place[:own]
    order = np.argsort(h)
    return Vocabulary(h[order], np.log10(c[order] + 1.0), outputs[order], place[own:], np.log10(shared + kinds + 1.0), full, int(code_c.sum()) + ends, distinct, ends)


def prepared(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Every row (doc_id, text) once: doc_id, key, words, known, logs, rest, ids (output ids and an end), rare (hashes that aren't broadcast).

    logs: the sum of the broadcast words' log10(c + 1); rest: what words without outputs of their own add to a score, but
    for the rare ones' counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    width = id_type(vocab.classes)

    @lean
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        for b in batches:
            for i, n, h, rows, code in tokens(b.column(2)):
                at, there = vocab.find(h)
                own = there & (vocab.outputs[at] >= 0) if len(vocab.outputs) else there
                kind = spelling(code, len(vocab.spelling_logs))
                logs = np.where(there, vocab.logs[at], 0.0) if len(vocab.logs) else np.zeros(len(h))
                ids = np.where(own, vocab.outputs[at] if len(vocab.outputs) else 0, vocab.spelling_outputs[kind])
                each = lambda w: np.bincount(rows, weights=w, minlength=n).astype(float)
                count, begin = np.bincount(rows, minlength=n), np.arange(n + 1)
                begin[1:] += np.cumsum(count)
                stream = np.insert(ids, np.cumsum(count), END).astype(width)
                rare = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(each(~there))).astype(np.int32)), pa.array(h[~there]))
                packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((begin * width().itemsize).astype(np.int32).tobytes()), pa.py_buffer(stream.tobytes())])
                columns = [pa.array(count), pa.array(each(there).astype(np.int64)), pa.array(each(logs)), pa.array(each(~own * (logs - vocab.spelling_logs[kind]))), packed, rare]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, n), b.column(1).slice(i, n), *columns], ["doc_id", "key", "words", "known", "logs", "rest", "ids", "rare"])

    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    rows = keyed.mapInArrow(made, "doc_id long, key long, words long, known long, logs double, rest double, ids binary, rare array<long>")
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "tokens")


def id_type(classes: int):
    return np.uint16 if classes <= 256 else np.uint32


def read_ids(column: pa.ChunkedArray | pa.Array, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows' ids one after another, and where each begins."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    width = id_type(classes)
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if column.type == pa.large_binary() else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(width).astype(np.int64), (at - at[0]) // width().itemsize


def fit(rows: DataFrame, vocab: Vocabulary, hidden: int = HIDDEN, rounds: int = ROUNDS, replica_tokens: int = REPLICA_TOKENS) -> dict[str, np.ndarray]:
    """Weights after `rounds` rounds; rows (key, ids) are the training documents, each in one round and replica.

    A replica's weights are summed with others' in two steps, each over about the root of the number of replicas.
    """
    classes = vocab.classes
    x = flat(initial(vocab.mass, hidden))
    spark = rows.sparkSession
    replicas = max(1, round(vocab.tokens / rounds / replica_tokens))

    def trainer(weights):
        def trained(t: pa.Table) -> pa.Table:
            replica = t.column("replica")[0].as_py()
            stream, _ = read_ids(t.sort_by("key").column("ids"), classes)
            got = flat(train(unflat(weights.value, classes, hidden), stream)).astype(np.float64) * len(stream)
            got = np.append(got, len(stream))
            parts = [got[i : i + WEIGHTS_A_PART] for i in range(0, len(got), WEIGHTS_A_PART)]
            return pa.table([pa.array(range(len(parts)), pa.int32()), pa.array([replica] * len(parts), pa.int64()), pa.array(parts, pa.list_(pa.float64()))], ["part", "replica", "w"])

        return trained

    def summed(t: pa.Table) -> pa.Table:
        w = np.sum([v.values.to_numpy() for v in t.column("w")], axis=0)
        return pa.table([t.column("part").slice(0, 1), pa.array([w], pa.list_(pa.float64()))], ["part", "w"])

    for r in range(rounds):
        weights = spark.sparkContext.broadcast(x)
        mine = rows.where(salt(rounds, "key") == r).select("key", "ids", F.pmod(F.xxhash64("key", F.lit(r)), F.lit(replicas)).alias("replica"))
        each = mine.groupBy("replica").applyInArrow(trainer(weights), "part int, replica long, w array<double>")
        some = each.withColumn("some", F.pmod("replica", F.lit(1 + int(replicas**0.5)))).groupBy("part", "some").applyInArrow(summed, "part int, w array<double>")
        got = some.groupBy("part").applyInArrow(summed, "part int, w array<double>").toArrow().sort_by("part")
        if got.num_rows:
            total = np.concatenate([v.values.to_numpy() for v in got.column("w")])
            if total[-1] > 0:
                x = (total[:-1] / total[-1]).astype(np.float32)
    return unflat(x, classes, hidden)


@np.errstate(over="ignore")
def document_scores(p: dict[str, np.ndarray], ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Natural log probability of each document ids[begin[i]:begin[i + 1]], ends included; all documents step together."""
    n = len(begin) - 1
    out = np.zeros(n)
    size = np.diff(begin)
    by = np.argsort(-size, kind="stable")
    length, start = size[by], begin[:-1][by]
    gates = p["E"] @ turned(by_gate(p["W"])) + turned(by_gate(p["b"][None]))
    u, weights = turned(by_gate(p["U"])), softmax_weights(p)
    h, last = np.zeros((n, p["U"].shape[0]), gates.dtype), np.full(n, END)
    states, targets, owners, held = [], [], [], 0

    def settle() -> None:
        nonlocal held
        if held:
            found = log_probabilities(weights, np.concatenate(states), np.concatenate(targets))
            out[:] += np.bincount(np.concatenate(owners), weights=found, minlength=n)
        states.clear(), targets.clear(), owners.clear()
        held = 0

    live = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1 if n else 1), "right")  # those that have a token at each step
    for t, m in enumerate(live.tolist()):
        a, after = h[:m] @ u, np.empty_like(h[:m])
        step(gates.take(last[:m], axis=1), h[:m], a, a[:2], np.empty_like(after), after)
        h, y = after, ids[start[:m] + t]
        states.append(h)
        targets.append(y)
        owners.append(by[:m])
        last, held = y, held + m
        if held >= SCORE_BLOCK:
            settle()
    settle()
    return out


def score_documents(docs: DataFrame, hidden: int = HIDDEN, broadcast_counts: int = BROADCAST_COUNTS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    A null or empty text is its end alone. Repeated rows are learnt from and scored each; a null doc_id is learnt
    from. Without training documents all counts are 0 and the network keeps its initial weights. An empty table gives
    no rows. Texts of any length are taken whole. log10 is used for both scores.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = stored(count_tokens(docs.where(in_training())), "counts")
    vocab = vocabulary(counts, broadcast_counts)
    rows = prepared(docs, vocab)
    p = fit(rows.where(in_training()).select("key", "ids"), vocab, hidden)
    shared = docs.sparkSession.sparkContext.broadcast((p, vocab.classes))

    @lean
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, classes = shared.value
        for b in batches:
            net = document_scores(p, *read_ids(b.column(0), classes)) / np.log(10)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(net)], ["row", "doc_id", "words", "known", "logs", "rest", "net"])

    main = rows.select("ids", "row", "doc_id", "words", "known", "logs", "rest").mapInArrow(scored, "row long, doc_id long, words long, known long, logs double, rest double, net double")
    if vocab.distinct - (1 if vocab.ends else 0) > len(vocab.hashes):
        main = stored(main, "scored")
        found = rows.select("row", F.explode("rare").alias("h")).join(counts, "h")
        sums = found.groupBy("row").agg(F.count("*").alias("rare_known"), F.sum(F.log10(F.col("c") + 1.0)).alias("rare_logs"))
        main = main.join(sums, "row", "left").na.fill(0, ["rare_known"]).na.fill(0.0, ["rare_logs"])
    else:
        main = main.withColumn("rare_known", F.lit(0).cast("long")).withColumn("rare_logs", F.lit(0.0))
    n_tokens = F.col("words") + 1
    wide = float(np.log10(vocab.tokens + vocab.distinct + 1.0))
    return main.select(
        "doc_id",
        (~in_training()).alias("held_out"),
        n_tokens.alias("n_tokens"),
        (F.col("known") + F.col("rare_known") + (1 if vocab.ends else 0)).alias("n_known"),
        F.lit(int(vocab.tokens)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("rare_logs") + F.lit(float(np.log10(vocab.ends + 1))) - n_tokens * F.lit(wide)).alias("base_score"),
        (F.col("net") + F.col("rest") + F.col("rare_logs")).alias("score"),
    )
