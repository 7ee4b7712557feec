import hashlib
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lacunar.llm import fingerprints, lines, lm, mixing, near, packing, quality, queries, suffix, topk, toxicity
from lacunar.llm._dist import components, running_total

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, rank int, key string"


def texts():
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma", "délta", "eps", "zeta,", "eta", "Theta.", "iota", "kappa"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    common = line(30)
    out = [None, "", " ", "\n\n", "one", "one", "a b", line(60), common, common + "\n" + line(8)]
    base = line(80)
    out += [base, base, base.replace("eta", "ETA"), base + " tail", line(20) + "\n" + common + "\n" + line(5), common + "\n" + common]
    out += ["x y " * 120, line(1500), "  " + common.upper() + "\t\n" + line(3)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or ""), i, "k") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i * 3, int(i % 2), int(i % 3 == 0), "x") for i in range(19)] + [(None, 1, 1, "x"), (3, None, None, "x"), (3, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")


def source(docs):
    return sorted((r["doc_id"], r["text"] or "") for r in docs.collect())


def shingles(text, k):
    w = WORD.findall(text.encode().lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_lines(docs, empty):
    keys = {}
    for i, t in source(docs):
        for x in t.split("\n"):
            k = re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
            keys.setdefault(k, set()).add(i)
    gone = {k: max(v) for k, v in keys.items() if len(k) >= 20 and len(v) >= 3}
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs, batches=3, fanout=2).collect()}
    assert len(got) == docs.count() and "rank" in next(iter(got.values())).asDict()
    for i, t in source(docs):
        kept = [x for x in t.split("\n") if gone.get(re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r")), i) == i]
        assert (got[i]["text"] or "") == "\n".join(kept) and got[i]["n_dropped"] == len(t.split("\n")) - len(kept)
    assert lines.dedup_lines(empty).count() == 0


def test_lines_of_repeated_rows(spark):
    twice, thrice = "held by two documents alone", "held by three documents, once each"
    rows = [(1, twice), (2, twice + "\n" + thrice), (2, twice + "\n" + thrice), (2, twice), (3, thrice), (4, thrice)]
    got = sorted((r["doc_id"], r["text"]) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(1, twice), (2, twice), (2, twice), (2, twice), (3, ""), (4, thrice)])


@pytest.mark.parametrize("k,share", [(3, 0.9), (5, 0.8), (2, 0.5)])
def test_near_groups(docs, empty, k, share):
    sets = {i: shingles(t, k) for i, t in source(docs)}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    got = sorted(map(tuple, near.near_groups(docs, k, share).collect()))
    assert got == [(i, len(sets[i]), root(i)) for i in sorted(sets)]
    assert near.near_groups(empty, k, share).count() == 0
    distinct = set(map(frozenset, sets.values()))
    similar = lambda a, b: len(a & b) >= share * len(a | b) - 1e-9
    got = sorted(map(tuple, near.near_links(docs, k, share).collect()))
    assert got == [(i, len(sets[i]), root(i), sum(similar(x, sets[i]) for x in distinct if x and x != sets[i]) if sets[i] else 0) for i in sorted(sets)]


def test_near_copies_of_random_sets():
    rng = np.random.default_rng(3)
    bands = near.Bands(0.8)
    for _ in range(200):
        n = int(rng.integers(5, 300))
        a = rng.integers(1, 1 << 62, n).astype(np.uint64)
        both = int(np.ceil(0.8 * n))
        b = np.concatenate([a[:both], rng.integers(1, 1 << 62, int(both / 0.8) - n if both / 0.8 > n else 0).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        if len(np.intersect1d(a, b)) < 0.8 * len(np.union1d(a, b)) or len(a) == len(b) and (a == b).all():
            continue
        one, _ = near.signatures(a, np.zeros(len(a), np.int64), np.array([len(a)]), bands)
        two, _ = near.signatures(b, np.zeros(len(b), np.int64), np.array([len(b)]), bands)
        assert len(np.intersect1d(one, two))


@pytest.mark.parametrize("share", [0.8, 0.9])
def test_candidates_keep_every_similar_pair_together(share):
    rng = np.random.default_rng(5)
    common = [rng.integers(1, 1 << 62, int(n)) for n in rng.integers(2, 30, 12)]
    sets = []
    for _ in range(150):
        own = [rng.integers(1, 1 << 62, int(rng.integers(1, 40))), *[common[i] for i in rng.integers(0, 12, rng.integers(0, 4))]]
        base = np.unique(np.concatenate(own))
        for _ in range(int(rng.choice([1, 1, 2, 3, 20]))):
            x = base[rng.random(len(base)) > rng.choice([0, 0.02, 0.1])]
            sets.append(np.unique(np.concatenate([x, rng.integers(1, 1 << 62, int(rng.integers(0, 3)))])).astype(np.uint64))
    sets = [x for x in {x.tobytes(): x for x in sets if len(x)}.values()]
    bands, size, parity = near.Bands(share), np.array([len(x) for x in sets]), near.parities(np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets]), len(sets))
    rows = []
    for part in np.array_split(rng.permutation(len(sets)), 3):
        h, r = np.concatenate([sets[i] for i in part]), np.repeat(np.arange(len(part)), size[part])
        sig, row = near.signatures(h, r, size[part], bands)
        rows.append(near.shared(sig, part[row].astype(np.int64)))
    a, b, firm = near.pairs_of(*(np.concatenate(c) for c in zip(*rows)))
    differ = np.bitwise_count((parity[a] ^ parity[b]).view(np.uint64)).sum(1)
    truly = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(a, b)])
    assert (differ <= truly).all() and firm.any() and not firm.all()
    keep = firm | (differ <= (size[a] + size[b]) * (1 - share) / (1 + share) + 1e-6)
    label = np.arange(len(sets))
    for i, j in zip(a[keep], b[keep]):
        label[label == label[j]] = label[i]
    links = 0
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both >= share * (size[i] + size[j] - both):
                links += 1
                assert label[i] == label[j]
    assert links > 200


def test_fingerprints(docs, empty):
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(docs, buckets=3).collect()}
    order = source(docs)[::-1]
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        assert got[i]["edited"] == t[: len(t) - half] + u[:half]
        assert 0 <= got[i]["near_edited"] <= 1 and (got[i]["near_edited"] == 1 or got[i]["edited"] != t)
    same = {}
    for i, t in order:
        assert same.setdefault(t, got[i]["sketch"]) == got[i]["sketch"]
    assert fingerprints.edited_fingerprints(empty).count() == 0
    assert fingerprints.edited_fingerprints(docs.limit(1)).count() == 1


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(300):
        t = [rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(1, 60))] + [0]
        assert suffix.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


@pytest.mark.parametrize("hot,piece", [(4096, 1 << 20), (1, 700)])
def test_repeated_bytes(docs, empty, monkeypatch, hot, piece):
    monkeypatch.setattr(suffix, "HOT_ROWS", hot)
    monkeypatch.setattr(suffix, "PIECE", piece)
    got = {r["doc_id"]: r for r in suffix.without_repeats(docs).collect()}
    seen = set()
    for i, t in source(docs):
        raw, gone = t.encode(), bytearray(len(t.encode()))
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(raw[s : s + 100])
        assert bytes(got[i]["kept"]) == bytes(b for b, g in zip(raw, gone) if not g) and got[i]["n_bytes"] == len(raw)
    assert suffix.without_repeats(empty).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)] + [(100, [float("nan")] * 8), (101, None), (None, [0.0] * 8), (200, rows_tie := [0.5] * 8), (201, rows_tie)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    made = topk.integer_vectors(table)
    got = [tuple(r) for r in topk.top_k(made, made.where("id % 10 = 0"), 5, 16, 4).orderBy("query_id", "rank").collect()]
    v = {i: [int(np.floor(x * 1024)) for x in e] for i, e in rows if i is not None and e and not np.isnan(e).any()}
    want = []
    for q in sorted(i for i in v if i % 10 == 0):
        best = sorted((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in v if i != q)[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == want
    assert topk.top_k(made.limit(0), made.limit(0)).count() == 0


def test_top_k_of_large_numbers_and_repeated_ids(spark):
    rows = [(1, [1e10, 1e10]), (2, [1e10, 1e10]), (3, [1e300, 1.0]), (4, [-1e300, 1.0]), (5, [2.0, 3e15]), (6, [0.25, -7.0]), (7, [1e306, 0.0]), (8, [1.0]), (9, [])]
    made = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [tuple(r) for r in topk.top_k(made, made, 10, 2, 2).orderBy("query_id", "rank").collect()]
    v = {i: [int(np.floor(x * 1024)) for x in e] for i, e in rows if i != 7 and e}
    inside = lambda x: max(-(2**63), min(2**63 - 1, x))
    want = []
    for q in sorted(v):
        best = sorted((-inside(sum(a * b for a, b in zip(v[q], v[i]))), i) for i in v if i != q and len(v[i]) == len(v[q]))
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == want
    rows = [(100, [1.0, 0.0]), (100, [0.0, 1.0]), (100, [0.0, 1.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0])]
    made = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(made, made.where("id = 100"), 2).collect())
    one = 1024 * 1024
    assert got == sorted([(1, 1, 2 * one), (2, 1, 2 * one), (1, 2, 3 * one), (2, 1, 0)])


def test_mixing(docs, empty):
    got = mixing.mix_documents(docs, block=4).collect()
    sizes = {i: len(WORD.findall(t.encode())) for i, t in source(docs)}
    assert {r["doc_id"]: r["size"] for r in got} == sizes and all(r["taken"] <= 2 * r["size"] for r in got)
    total = sum(sizes.values())
    for r in got:
        near_ = sum(x["taken"] for x in got if x["target"] == r["target"])
        assert abs(near_ - r["target"]) <= 0.05 * total
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_documents(docs, block=4).collect()))
    mixed = {r["doc_id"]: r["text"] for r in mixing.mixed_texts(docs, block=4).collect()}
    taken = {r["doc_id"]: r["taken"] for r in got if r["taken"]}
    assert {i: len(t.split()) for i, t in mixed.items()} == taken
    assert mixing.mix_documents(empty).count() == 0
    assert sorted(mixing.permuted(np.arange(37), np.full(37, 37), np.full(37, 5, np.uint64))) == list(range(37))
    assert mixing.targets([10, 100], [3, 1], 60) == [20, 40]


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    files = queries.tokenizer_files()
    full = Tokenizer.from_file(files[0])
    got = packing.pack_documents(docs, *files, capacity=64).collect()
    pieces = {(r["doc_id"], r["piece"]): r for r in got}
    for i, t in source(docs) + [(None, "")]:
        if i is None:
            continue
        ids = full.encode(t, add_special_tokens=False).ids + [2]
        at, cut, p = 0, len(ids) % 64 or 64, 0
        while at < len(ids):
            r = pieces.pop((i, p))
            assert (r["start"], r["length"], r["ids_crc32"]) == (at, cut - at, zlib.crc32(np.array(ids[at:cut], "<u4").tobytes()))
            at, cut, p = cut, cut + 64, p + 1
    assert not pieces
    ends = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 64 and len(ends) <= -(-sum(ends.values()) // 64) + 1
    assert packing.pack_documents(empty, *files).count() == 0
    assert packing.fullest(10, [(7, 1), (4, 3), (3, 1)]) in ({7: 1, 3: 1},)
    encoder = packing.Encoder(*files)
    for t in ["a  b", " a", "a ", "a\n b\n\n c", "it's <|endoftext|> x", "\t \tz", "naïve  \n ö", "a  b"]:
        assert encoder.encode(t) == np.array(full.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def plain_step(p, x, h):
    """One step of the network, written out."""
    n = len(h)
    sig = lambda v: 1 / (1 + np.exp(-v))
    g, a = p["E"][x] @ p["W"] + p["b"], h @ p["U"]
    z, r = sig(g[:n] + a[:n]), sig(g[n : 2 * n] + a[n : 2 * n])
    return z * h + (1 - z) * np.tanh(g[2 * n :] + r * a[2 * n :])


def plain_log_probability(p, ids):
    """Of one document's outputs, its end last, each step's softmax over all classes and all outputs of the class."""
    k, h, last, out = len(p["c"]), np.zeros(p["U"].shape[0]), lm.END, 0.0
    for y in ids:
        h = plain_step(p, last, h)
        top, low = h @ p["C"] + p["c"], p["O"][y // k] @ h + p["o"][y // k]
        out += top[y // k] - np.log(np.exp(top).sum()) + low[y % k] - np.log(np.exp(low).sum())
        last = y
    return out


@pytest.mark.parametrize("broadcast_counts", [lm.BROADCAST_COUNTS, 5])
def test_language_model(docs, empty, broadcast_counts, monkeypatch):
    fitted, made = lm.fit, []
    monkeypatch.setattr(lm, "OUTPUT_GROWTH", 1.0)
    monkeypatch.setattr(lm, "fit", lambda rows, vocab, hidden: made.append((vocab, fitted(rows, vocab, hidden))) or made[-1][1])
    got = {r["doc_id"]: r for r in lm.score_documents(docs, broadcast_counts=broadcast_counts).collect()}
    vocab, p = made[0]
    p = {k: v.astype(float) for k, v in p.items()}
    tokens = {i: WORD.findall(t.encode().lower()) + [None] for i, t in source(docs)}
    c = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    k, spellings = vocab.classes, vocab.classes**2 // lm.SPELLING_SHARE
    own = {lm_hash(w): w for w in c if w is not None}
    own = {own[h] for h in vocab.hashes[vocab.outputs >= 0].tolist()}
    kind = lambda w: int(lm.spelling(np.array([w[-1] * 257 + (w[-2] if len(w) > 1 else 256)]), spellings)[0])
    rest = Counter()
    for w in c:
        if w is not None and w not in own:
            rest[kind(w)] += c[w] + 1
    output = {w: int(vocab.outputs[vocab.hashes == lm_hash(w)][0]) for w in own} | {None: lm.END}
    for i, ws in tokens.items():
        assert got[i]["base_score"] == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws), abs=1e-6)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        ids = [output[w] if w in output else int(vocab.spelling_outputs[kind(w)]) for w in ws]
        inside = sum(np.log10((c[w] + 1) / (rest[kind(w)] + 1)) for w in ws if w not in output)
        assert got[i]["score"] == pytest.approx(plain_log_probability(p, ids) / np.log(10) + inside, rel=1e-5, abs=1e-5)
    assert lm.score_documents(empty).count() == 0


def lm_hash(word):
    return next(lm.tokens(pa.array([word.decode()])))[2][0]


def test_language_model_probabilities_sum_to_one(spark):
    d = spark.createDataFrame([(i, f"w{i % 40} common ta{i % 7}") for i in range(200)], "doc_id long, text string")
    counts = lm.count_tokens(d)
    vocab = lm.vocabulary(counts, most=3, growth=1.0)
    seen = {r["h"]: r for r in counts.collect() if r["h"] != lm.END_HASH}
    mass = Counter()
    for h, r in seen.items():
        at = np.flatnonzero((vocab.hashes == h) & (vocab.outputs >= 0))
        if not len(at):
            mass[int(lm.spelling(np.array([r["code"]]), len(vocab.spelling_logs))[0])] += r["c"] + 1
    assert all(m + 1 == pytest.approx(10 ** vocab.spelling_logs[s]) for s, m in mass.items())
    assert vocab.mass.sum() == pytest.approx(1) and len(vocab.mass) == vocab.classes**2
    assert vocab.tokens == sum(r["c"] for r in counts.collect()) and vocab.distinct == len(seen) + 1


def test_outputs_grow_with_the_vocabulary():
    sizes = [lm.classes_for(10**i) for i in range(1, 12)]
    assert sizes == sorted(sizes) and sizes[-1] > 8 * sizes[3]


def test_language_model_gradient_and_carried_state():
    rng = np.random.default_rng(0)
    mass = rng.random(64)
    p = {k: v.astype(np.float64) for k, v in lm.initial(mass / mass.sum(), 6).items()}
    x, y, h = rng.integers(0, 64, (5, 3)), rng.integers(0, 64, (5, 3)), rng.normal(size=(3, 6))
    _, g, _ = lm.loss_and_gradient(p, x, y, h)
    for k in p:
        for _ in range(3):
            i = tuple(int(rng.integers(0, n)) for n in p[k].shape)
            i = (int(x.ravel()[0]), *i[1:]) if k == "E" else i
            old, ends = p[k][i], []
            for e in (1e-5, -1e-5):
                p[k][i] = old + e
                ends.append(lm.loss_and_gradient(p, x, y, h)[0])
            p[k][i] = old
            assert g[k][i] == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-6)
    texts = [rng.integers(2, 64, n).tolist() + [lm.END] for n in (75, 0, 3, 200, 75)]
    got = lm.document_scores(p, np.concatenate(texts), np.cumsum([0] + [len(t) for t in texts]))
    assert got == pytest.approx([plain_log_probability(p, t) for t in texts])
    xs = np.append(0, texts[0][:-1])[:, None]
    loss, _, _ = lm.loss_and_gradient(p, xs, np.array(texts[0])[:, None], np.zeros((1, 6)))
    assert got[0] == pytest.approx(-loss * 76)


def test_language_model_scores_in_little_memory():
    rng = np.random.default_rng(2)
    p, ids = lm.initial(np.full(4096, 1 / 4096)), rng.integers(0, 4096, 70_000)
    tracemalloc.start()
    got = lm.document_scores(p, ids, np.arange(0, 70_001, 100))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[::100] == pytest.approx([plain_log_probability(p, ids[i : i + 100]) for i in range(0, 70_000, 10_000)], rel=1e-4)
    assert peak < 40e6  # one block's scores of all classes and outputs alone are 34 MB


def test_language_model_finds_and_groups_hashes():
    rng = np.random.default_rng(3)
    h = np.sort(rng.integers(-(1 << 63), (1 << 63) - 1, 1 << 18))
    near = np.concatenate([h[:50], h[-50:], h[:50] + 1, h[-50:] - 1, [-(1 << 63), (1 << 63) - 1, 0]])
    for some in (h, h[:0], h[:1], h[:3], np.arange(-70, 70), np.arange(40) + (1 << 62)):
        vocab = lm.Vocabulary(some, *[None] * 5, 0, 0, 0)
        sought = np.concatenate([near, some[:200]])
        at, there = vocab.find(sought)
        assert there.tolist() == np.isin(sought, some).tolist() and (some[at[there]] == sought[there]).all()
    for many in (near, h[:0], np.repeat(near, 3), np.arange(9)[::-1] % 4):
        order, ordered, first = lm.together(many)
        assert sorted(order.tolist()) == list(range(len(many))) and (many[order] == ordered).all()
        runs = Counter(np.repeat(ordered[first], np.diff(first, append=len(many))).tolist())
        assert runs == Counter(many.tolist()) and all(len(set(r.tolist())) == 1 for r in np.split(ordered, first[1:]) if len(r))
    vocab, sought, took = lm.Vocabulary(h, *[None] * 5, 0, 0, 0), rng.permutation(h), {}
    for _ in range(3):
        for name, find in (("find", vocab.find), ("bisect", lambda x: np.searchsorted(h, x))):
            begun = time.thread_time()
            find(sought)
            took[name] = min(took.get(name, 1e9), time.thread_time() - begun)
    assert took["find"] < 0.7 * took["bisect"]


def test_language_model_learns_from_every_training_document(spark):
    rows = [(i, f"w{i}a w{i}b w{i}c") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string").where(lm.in_training())
    vocab = lm.vocabulary(lm.count_tokens(d), growth=8.0)
    first = lm.initial(vocab.mass)
    for replica_tokens in (50, 1000):
        last = lm.fit(lm.prepared(d, vocab), vocab, replica_tokens=replica_tokens)
        moved = np.abs(last["E"] - first["E"]).max(1) > 1e-5
        assert (vocab.outputs >= 0).all() and len(vocab.outputs) == 3 * d.count()
        assert moved[vocab.outputs].all()


def test_language_model_trains_on_what_the_lanes_leave_over():
    p = lm.initial(np.full(64, 1 / 64), 6)
    stream = np.arange(37) + 2
    got = lm.train(p, stream, lanes=4, window=8, least_windows=1)
    assert (np.abs(got["E"] - p["E"]).max(1) > 1e-5)[stream[:-1]].all()


def test_language_model_beats_counts(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        w, ws = rng.randrange(30), []
        for _ in range(60):
            w = (w * 7 + rng.choice([1, 1, 1, 5])) % 30
            ws.append(f"word{w}")
        rows.append((i, " ".join(ws)))
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert got["s"] > 0.9 * got["b"]


def test_classifiers_take_anything(spark, docs, empty, labels):
    for make in (lambda d, x: quality.classify(d, x), lambda d, x: toxicity.grade(d, x)):
        assert make(docs, labels).count() == docs.count()
        assert make(docs, labels.limit(0)).count() == docs.count()
        assert make(empty, labels).count() == 0


def test_classifiers_learn(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 7)))
    rows, marks = [], []
    for i in range(400):
        good, toxic = i % 4 != 0, i % 5 == 0
        ws = [word() if good else word() + "###" for _ in range(80)]
        if toxic:
            ws[rng.randrange(80)] = rng.choice(["vile", "rotten"])
        rows.append((i, " ".join(ws)))
        marks.append((i, int(good), int(toxic)))
    d, x = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    q = {r["doc_id"]: r for r in quality.classify(d, x).where("held_out").collect()}
    assert np.mean([r["predicted"] == int(i % 4 != 0) for i, r in q.items()]) > 0.95
    t = {r["doc_id"]: r for r in toxicity.grade(d, x).where("held_out").collect()}
    assert np.mean([r["toxic"] == int(i % 5 == 0) for i, r in t.items()]) > 0.95
    assert all(0 <= r["severity"] <= 2 for r in t.values())


def test_helpers(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 5), (7, 9), (2, 2)], "a long, b long")
    assert {r[0]: r[1] for r in components(edges).collect()} == {5: 3, 4: 3, 3: 3, 9: 7, 8: 7, 7: 7}
    df = spark.createDataFrame([(g, i % 3, i, i + 1) for g in "ab" for i in range(10)], "g string, c int, i int, v int")
    from pyspark.sql import functions as F

    got = {(r["g"], r["i"]): r["t"] for r in running_total(df, ["g"], "c", ["i"], F.col("v"), "t").collect()}
    total = 0
    for i in sorted(range(10), key=lambda i: (i % 3, i)):
        assert got["a", i] == got["b", i] == total
        total += i + 1


def test_pipeline(docs, labels, spark, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    held = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, str(tmp_path))
        assert held.columns == docs.columns, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_registry_covers_every_operator():
    names = queries.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert hashlib.sha256(b"").hexdigest()


def test_sets_of_a_frequent_signature_make_no_large_group(spark, monkeypatch):
    monkeypatch.setattr(near, "FIRM_BLOCK", 16, raising=False)
    rng = np.random.default_rng(7)
    docs = [" ".join([*"all that they have in common is".split(), *(f"w{x}" for x in rng.integers(0, 1 << 30, 12))]) for _ in range(120)]
    docs += [" ".join(f"{i % 3}x{x}" for x in range(60)) + f" {i}" for i in range(90)]  # three groups of near copies
    texts = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    seen = []
    possible = near.possible
    monkeypatch.setattr(near, "possible", lambda *a: seen.append((a[0], out := possible(*a))) or out)
    got = {r["doc_id"]: r["component_id"] for r in near.near_groups(texts).collect()}
    assert got == {i: i if i < 120 else 120 + i % 3 for i in range(210)}
    met, out = seen[0]
    assert met.where("firm").count()
    groups = near.components(out).groupBy("component").count().collect()
    assert max(r["count"] for r in groups) == 30


@pytest.mark.parametrize("n", [700, 3000, 9000])
def test_parities_tell_large_sets_apart(spark, n):
    rng = np.random.default_rng(n)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 1 << 40, n)) for _ in range(3)]
    texts.append(texts[0] + " and " + " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, n // 8)))  # over the next power of two for some n
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [np.array(sorted({hash(s) & (1 << 62) - 1 for s in shingles(t, 5)}), np.uint64) for t in texts]
    size = np.array([len(s) for s in sets])
    got = near.parities(np.concatenate(sets), np.repeat(np.arange(4), size), 4, near.parity_bits(size))
    at = np.concatenate([[0], np.cumsum(near.parity_bits(size) // 64)])
    rows = [got[a:b].reshape(1, -1) for a, b in zip(at, at[1:])]
    differ = lambda i, j: int(near.differing(rows[i], rows[j])[0])
    assert differ(0, 3) <= len(np.setxor1d(sets[0], sets[3])) <= near.most_different(size[0] + size[3], 0.8)
    assert all(differ(i, j) > near.most_different(size[i] + size[j], 0.8) for i, j in ((0, 1), (0, 2), (1, 2), (1, 3)))
    assert [r["component_id"] for r in near.near_groups(docs).orderBy("doc_id").collect()] == [0, 1, 2, 0]
