"""Registered queries and pipeline stages against plain Python, on tables with repeated rows, nulls and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lacunar.llm import fingerprints, lines, lm, mixing, near, packing, quality, queries, suffix, topk, toxicity
from lacunar.llm._labels import labelled_sample

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Names that operators use or once used inside, or return.
CLASHING = "score _id parts _k n_lines n_dropped row id key node label kept gone first words reads taken size source_size target component_id n_shingles piece length payload sequence_id offset h h1 y _c _v _s marks which vector text2 held_out predicted".split()


def base_texts():
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "délta", "eps", "zeta,", "eta", "Theta.", "iota", "kappa", "lambda", "mu"]
    line = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    common, long_ = line(12), line(120)
    out = [None, "", " ", "one", "one two three", line(60), common, common + "\n" + line(8), line(9) + "\n" + common, long_, long_, long_ + " tail", long_.replace("alpha", "ALPHA")]
    out += [line(30) for _ in range(8)] + [line(400), line(7), "a b c d e f g h i j", "\n\n\n", common.upper() + "\n" + common]
    return out


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder with documents and labels: repeated rows, one doc_id with unlike texts, null ids and clashing names."""
    texts = base_texts()
    rows = [(10 * i, t, "en", None if i % 6 == 0 else f"s{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], rows[9], (50, texts[20], "de", "s1", 3), (90, texts[0], "de", "s1", 3), (None, texts[5], "en", "s2", 1), (None, None, None, None, None)]
    rows = [(*r, *[j for j in range(len(CLASHING))]) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} int" for c in CLASHING)
    at = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(rows, schema).write.parquet(str(at / "documents.parquet"))
    marks = [(10 * i, int(i % 2), int(i % 3 == 0), 1.0) for i in range(len(texts))] + [(None, 1, 1, 1.0), (30, None, None, 1.0), (30, 0, 1, 1.0)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int, score double").write.parquet(str(at / "labels.parquet"))
    return str(at)


def rows_of(spark, odd):
    return [(r["doc_id"], r["text"]) for r in queries.table(spark, odd, "documents").select("doc_id", "text").collect()]


def shingles(text, k):
    w = WORD.findall((text or "").encode().lower())
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def linked(texts, k, share):
    """A number for each text, the same for texts that links join."""
    sets = [shingles(t, k) for t in texts]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) >= share * len(a | b) - 1e-9:
                up[root(i)] = root(j)
    return [root(i) for i in range(len(sets))], sets


@pytest.mark.parametrize("dense,scale", [(64, 8), (4, 3)])
def test_op2(spark, odd, monkeypatch, dense, scale):
    monkeypatch.setattr(fingerprints, "DENSE", dense)
    docs = queries.table(spark, odd, "documents")
    made = fingerprints.edited_fingerprints(docs, scale=scale, buckets=5)
    got = [(r["doc_id"], r["text"], r["edited"], r["fp"], r["efp"], r["near_edited"], r["near_next"], r["in_next"]) for r in made.withColumns({"fp": fingerprints.as_text(F.col("sketch")), "efp": fingerprints.as_text(F.col("edited_sketch"))}).collect()]
    assert Counter((i, t) for i, t, *_ in got) == Counter((i, t or "") for i, t in rows_of(spark, odd))
    plain = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t.lower()) if w]
    runs = {t: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := plain(t)) else set() for _, t, e, *_ in got for t in (t, e)}
    every = sorted(set().union(*runs.values()))
    hashed = {tuple(r["w"]): r["h"] for r in spark.createDataFrame([(list(x),) for x in every], "w array<string>").withColumn("h", F.xxhash64("w")).collect()}
    limit = -(1 << 63) + (1 << 64) // scale
    sketch = {t: (len(x) <= dense, {h for h in map(hashed.get, x) if len(x) <= dense or h < limit}) for t, x in runs.items()}
    text = lambda s: ("w" if s[0] else "s") + "".join(f"{h & (1 << 64) - 1:016x}" for h in sorted(s[1]))

    def parts(a, b):
        return (a[1], b[1]) if a[0] and b[0] else ({h for h in a[1] if h < limit}, {h for h in b[1] if h < limit})

    def like(a, b):
        x, y = parts(a, b)
        return len(x & y) / len(x | y) if x | y else float(a[0] and b[0])

    followers = defaultdict(set)
    order = sorted(got, key=lambda r: -(1 << 63) if r[0] is None else r[0], reverse=True)
    groups = {}
    for r in order:
        groups.setdefault(r[0], []).append(r)
    ids = list(groups)
    for a, b in zip(ids, ids[1:] + ids[:1]):
        for r in groups[a]:
            followers[a] |= {x[1] for x in groups[b]} | ({x[1] for x in groups[a]} if len(groups[a]) > 1 else set())
    for i, t, edited, fp, efp, near_edited, near_next, in_next in got:
        half = len(t) // 2
        nexts = [u for u in followers[i] if edited == t[: len(t) - half] + u[:half]]
        assert nexts and fp == text(sketch[t]) and efp == text(sketch[edited])
        assert near_edited == pytest.approx(like(sketch[t], sketch[edited]))
        assert any(near_next == pytest.approx(like(sketch[t], sketch[u])) for u in nexts)
        wanted = []
        for u in nexts:
            x, y = parts(sketch[t], sketch[u])
            wanted.append(len(x & y) / len(x) if x else None if sketch[t][1] else 1.0)
        assert in_next in wanted or any(w is not None and in_next == pytest.approx(w) for w in wanted)
    registered = queries.op2_fingerprints(spark, odd)
    assert registered.count() == len(got) and registered.columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    if dense == 64:
        want = Counter((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fp) for i, t, e, fp, *_ in got)
        full = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"]) for r in registered.collect())
        assert Counter((i, n, fp) for i, n, _, fp in full.elements()) == Counter((i, n, fp) for i, n, _, fp in want.elements())


def test_containment_of_unequal_texts_and_merging(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**9)}" for _ in range(4000)]
    pieces = [" ".join(words[i * 19 : i * 19 + 8]) for i in range(200)] + [" ".join(words[:2000] + [f"x{i}" for i in range(2000)]), "unlike " * 6, ""]
    whole = " ".join(words)
    d = spark.createDataFrame([(i, p, whole) for i, p in enumerate(pieces)], "i int, p string, w string").withColumns({"a": fingerprints.sketch(F.col("p")), "b": fingerprints.sketch(F.col("w"))})
    got = [r["c"] for r in d.withColumn("c", fingerprints.containment(F.col("a"), F.col("b"))).orderBy("i").collect()]
    some = [c for c in got[:200] if c is not None]
    assert set(some) == {1.0} and len(some) > 40  # what can be told is right; the rest is known to be unknown
    assert got[200] == pytest.approx(0.5, abs=0.1) and got[201] in (0.0, None) and got[202] == 1.0
    for n, m in ((10, 20), (50, 60), (10, 500), (600, 700)):
        a, b = " ".join(words[:n]), " ".join(words[n // 2 : n // 2 + m])
        row = spark.createDataFrame([(a, b)], "a string, b string").select(*[fingerprints.sketch(c, 1).alias(x) for c, x in ((F.col("a"), "a"), (F.col("b"), "b"), (F.concat("a", F.lit(" "), "b"), "u"))])
        r = row.select("u", fingerprints.merge(F.col("a"), F.col("b")).alias("m")).first()
        assert r["u"] == r["m"]


def test_op1_loss_and_grades(spark, odd):
    rng = np.random.default_rng(4)
    rows = np.repeat(np.arange(50), 6)
    words = rng.integers(0, 20, len(rows))
    y, w, cuts = rng.integers(0, 3, 50), rng.normal(size=20), np.array([-0.5, 0.7])
    loss, g, gc = toxicity.loss_and_gradient(w, cuts, words, rows, y)
    sig = lambda v: 1 / (1 + np.exp(-v))
    plain = 0.0
    for i in range(50):
        s = w[words[rows == i]].sum()
        over = [1.0, sig(s - cuts[0]), sig(s - cuts[1]), 0.0]
        plain -= np.log(over[y[i]] - over[y[i] + 1]) / 50
    assert loss == pytest.approx(plain)
    for k in range(20):
        e = np.eye(20)[k] * 1e-6
        assert g[k] == pytest.approx((toxicity.loss_and_gradient(w + e, cuts, words, rows, y)[0] - toxicity.loss_and_gradient(w - e, cuts, words, rows, y)[0]) / 2e-6, abs=1e-6)
    for k in range(2):
        e = np.eye(2)[k] * 1e-6
        assert gc[k] == pytest.approx((toxicity.loss_and_gradient(w, cuts + e, words, rows, y)[0] - toxicity.loss_and_gradient(w, cuts - e, words, rows, y)[0]) / 2e-6, abs=1e-6)
    docs, labels = queries.table(spark, odd, "documents"), queries.table(spark, odd, "labels")
    model = toxicity.fit(docs, labels)
    got = queries.op1_toxicity(spark, odd).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows_of(spark, odd))
    want = defaultdict(list)
    for i, t in rows_of(spark, odd):
        runs = {h for _, ws, _, _ in toxicity.words_of(pa.array([t or ""])) for h in ws.tolist()}
        s = sum(float(model.weights[h]) for h in runs)
        want[i].append(sig(s - model.cuts).sum())
    for r in got:
        assert any(r["severity"] == pytest.approx(s, abs=1e-5) for s in want[r["doc_id"]]) and r["toxic"] == int(r["p_toxic"] >= toxicity.LEAST_P)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_op1_fit_is_an_optimum():
    rng = np.random.default_rng(6)
    rows = np.repeat(np.arange(300), 8)
    words = rng.integers(0, 40, len(rows))
    words, rows = np.array(sorted(set(zip(rows.tolist(), words.tolist())))).T[::-1]
    toxic = np.bincount(rows, weights=words < 3, minlength=300) + rng.normal(0, 0.3, 300) > 0.6
    model = toxicity.fit_arrays(words, rows, toxic, steps=3000, penalty=2e-3)
    y = toxicity.grades(words, rows, toxic)
    goal = lambda w, c: toxicity.loss_and_gradient(w, c, words, rows, y)[0] + 2e-3 * np.abs(w).sum()
    w = model.weights[:40].astype(float)
    best = goal(w, model.cuts)
    for _ in range(200):
        assert goal(w + rng.normal(0, 0.02, 40) * (rng.random(40) < 0.2), model.cuts + rng.normal(0, 0.02, 2)) > best - 1e-5


def test_sample_of_labelled_rows(spark, odd):
    docs, labels = queries.table(spark, odd, "documents"), queries.table(spark, odd, "labels")
    got = [(r["doc_id"], r["text"], r["y"]) for r in labelled_sample(docs, labels, "quality", 5).collect()]
    assert len(got) == len({i for i, *_ in got}) == 5
    assert sorted(got) == sorted((r["doc_id"], r["text"], r["y"]) for r in labelled_sample(docs.repartition(7), labels, "quality", 5).collect())
    every = {r["doc_id"]: r for r in labelled_sample(docs, labels, "toxic", 100).collect()}
    assert all(zlib.crc32(str(i).encode()) % 5 for i in every) and (30 not in every or every[30]["y"] == 1.0)


def test_op4_votes(spark):
    rng = np.random.default_rng(7)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)]
    texts = [" ".join(rng.choice(vocabulary[: 30 if i % 3 else 60], rng.integers(1, 60))) for i in range(90)] + ["", "ab", "x" * 300]
    x = np.concatenate([f for _, f in quality.features(pa.array(texts))])
    for i in (0, 5, 91):  # the counts of byte trigrams, one by one
        low = texts[i].lower().encode()
        seen = Counter()
        for a, b, c in zip(low, low[1:], low[2:]):
            code = (a * 0x9E3779B1 & 0xFFFFFFFF) ^ (b * 0x85EBCA6B & 0xFFFFFFFF) ^ (c * 0xC2B2AE35 & 0xFFFFFFFF)
            code = ((code ^ code >> 15) * 0x2C1B3C6D) & 0xFFFFFFFF
            seen[(code >> 8) % quality.HASHED] += 1
        assert np.allclose(x[i, : quality.HASHED], [np.log1p(seen[j]) for j in range(quality.HASHED)])
        assert x[i, quality.HASHED :].sum() == 3
    y = (np.arange(93) % 3 > 0).astype(float)
    idf = rng.uniform(0.5, 3, quality.FEATURES).astype(np.float32)
    model = quality.Model(idf, lambda: iter([x[:50], x[50:93]]), y, rank=20, k=7)
    a = (x * idf).astype(float)
    a[:, : quality.HASHED] /= np.maximum(np.linalg.norm(a[:, : quality.HASHED], axis=1, keepdims=True), 1e-9)
    a[:, quality.HASHED :] *= quality.PSEUDO_WEIGHT / (idf.max() * 3)
    _, _, v = np.linalg.svd(a, full_matrices=False)
    latent = a @ v[:20].T
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    cosines = latent @ latent.T
    for i, got in enumerate(model.score(x)):
        near_ = np.argsort(-cosines[i], kind="stable")[:7]
        w = np.maximum(cosines[i, near_], 1e-6)
        assert got == pytest.approx((w * y[near_]).sum() / w.sum(), abs=2e-3)


def test_op9_draws_are_multinomial():
    for shards, width in ((1, 4), (7, 4), (40, 8), (33, 1024)):
        parts = [mixing.shard_counts(1000, shards, c, [1, 2], width) for c in range(-(-shards // width))]
        counts = np.concatenate([c for _, c in parts])
        assert len(counts) == shards and counts.sum() == 1000
        assert [b for b, _ in parts] == [0, *np.cumsum([c.sum() for _, c in parts])[:-1]]
    draws = np.array([np.concatenate([mixing.shard_counts(2000, 20, c, [s, 0], 4)[1] for c in range(5)]) for s in range(400)])
    assert abs(draws.mean(0) - 100).max() < 3 and draws.var(0) == pytest.approx(np.full(20, 2000 / 20 * 19 / 20), rel=0.35)
    assert np.corrcoef(draws[:, 0], draws[:, 1])[0, 1] == pytest.approx(-1 / 19, abs=0.12)


def test_op9_takes_blocks(spark):
    rng = np.random.default_rng(8)
    sizes = rng.integers(0, 90, 120)
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(n)) if n or i % 2 else None, None if i % 5 == 0 else "ab"[i % 2]) for i, n in enumerate(sizes.tolist())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in (1, 2):
        got = {r["doc_id"]: r for r in mixing.mix_documents(docs, seed, block=8, shard_slots=20).collect()}
        texts = {r["doc_id"]: r["text"] for r in mixing.mixed_texts(docs, seed, block=8, shard_slots=20).collect()}
        total = sizes.sum()
        by_source = defaultdict(int)
        for i, _, s in rows:
            by_source[s] += int(sizes[i])
        order = sorted(by_source, key=lambda s: (s is None, s or ""))
        goal = dict(zip(order, mixing.targets([by_source[s] for s in order], [3, 1, 2], 1.5 * total)))
        taken = defaultdict(int)
        for i, t, s in rows:
            reads = Counter(texts.get(i, "").split())
            assert got[i]["taken"] == sum(reads.values()) and got[i]["size"] == sizes[i] and got[i]["source_size"] == by_source[s]
            assert set(reads) <= set((t or "").split()) and max(reads.values(), default=0) <= 2 and got[i]["target"] == pytest.approx(goal[s])
            taken[s] += got[i]["taken"]
        for s in order:  # a whole number of blocks, of which one may be short
            assert abs(taken[s] - goal[s]) <= 16
        _, slots, _ = mixing.mixture(mixing.sizes_of(docs), seed, block=8, shard_slots=20)
        drawn = slots.groupBy("shard", "sid").count().collect()
        reads = Counter()
        for r in slots.select("sid", "block").collect():
            reads[r["sid"], r["block"]] += 1
        assert len({r["count"] for r in drawn}) > 3 and max(reads.values()) <= 2
        for sid, s in enumerate(order):
            n = -(-by_source[s] // 8)
            assert sum(v for (k, _), v in reads.items() if k == sid) == min(round(goal[s] * n / by_source[s]), 2 * n) and all(b < n for k, b in reads if k == sid)
    assert {i: r["taken"] for i, r in got.items()} != {r["doc_id"]: r["taken"] for r in mixing.mix_documents(docs, 1, block=8, shard_slots=20).collect()}


def test_registered_queries_take_repeated_rows_and_clashing_names(spark, odd):
    docs = rows_of(spark, odd)
    ids = Counter(i for i, _ in docs)
    for name in ("op1_toxicity", "op2_fingerprints", "op4_quality", "op5_lm_scoring", "op7_line_dedup", "op9_mixing"):
        got = queries.queries()[name](spark, odd)
        assert got.columns[0] == "doc_id" and Counter(r["doc_id"] for r in got.select("doc_id").collect()) == ids, name
    got = queries.op3_suffix_dedup(spark, odd).collect()
    assert Counter((r["doc_id"], r["n_bytes"]) for r in got) == Counter((i, len((t or "").encode())) for i, t in docs)
    groups, _ = linked([t for _, t in docs], 3, 0.9)
    least = {}
    for (i, t), g in zip(docs, groups):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = Counter((i, len(shingles(t, 3)), least[g] if shingles(t, 3) else i) for (i, t), g in zip(docs, groups) if i is not None)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in queries.op8_ngram_jaccard(spark, odd).collect()) == want
    assert packed(queries.op10_packing(spark, odd), docs) <= 3


def packed(result, docs, capacity=1024):
    """Checks pieces against the whole tokenizer; how many more sequences there are than there must be."""
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(queries.tokenizer_files()[0])
    want, got, ends = Counter(), Counter(), Counter()
    for i, t in docs:
        ids = full.encode(t or "", add_special_tokens=False).ids + [2]
        at, cut, p = 0, len(ids) % capacity or capacity, 0
        while at < len(ids):
            want[i, p, at, cut - at, zlib.crc32(np.array(ids[at:cut], "<u4").tobytes())] += 1
            at, cut, p = cut, cut + capacity, p + 1
    for r in sorted(result.collect(), key=lambda r: (r["sequence_id"], r["offset"])):
        got[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert got == want and max(ends.values()) <= capacity
    return len(ends) - -(-sum(ends.values()) // capacity)


def plain_lines(rows):
    """What line dedup leaves of (doc_id, text) rows."""
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                held[key(x)].add(i)
    owner = {k: max(v) for k, v in held.items() if len(k) >= 20 and len(v) >= 3}
    out = []
    for i, t in rows:
        stay = [x for x in (t or "").split("\n") if i is None or owner.get(key(x), i) == i]
        out.append((i, t if len(stay) == len((t or "").split("\n")) else "\n".join(stay)))
    return out


def test_stages(spark, odd, tmp_path):
    docs = queries.table(spark, odd, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]

    def run(name, held):
        out = stages[name](spark, held, odd)
        if name != "best-fit packing":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        out = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        if name != "best-fit packing":
            other = out.select(*CLASHING).distinct().collect()
            assert [tuple(r) for r in other] in ([tuple(range(len(CLASHING)))], [])
        return out

    pairs = lambda d: Counter((r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect())
    good = run("quality classifier", docs)
    score = {}
    model = quality.fit(docs, queries.table(spark, odd, "labels"))
    texts = sorted({t or "" for _, t in rows_of(spark, odd)})
    for t, s in zip(texts, np.concatenate([model.score(x) for _, x in quality.features(pa.array(texts))])):
        score[t] = s
    assert pairs(good) == Counter((i, t) for i, t in rows_of(spark, odd) if score[t or ""] >= quality.THRESHOLD)

    deduped = run("line dedup", docs)
    assert pairs(deduped) == Counter(plain_lines(rows_of(spark, odd))) and pairs(deduped) != pairs(docs)
    changed = {r["text"]: r["n_chars"] for r in deduped.collect() if r["doc_id"] in (60, 70)}
    assert all(n == len(t) for t, n in changed.items())

    kept = run("n-gram Jaccard join", docs)
    rows = rows_of(spark, odd)
    groups, sets = linked([t for _, t in rows], 5, 0.8)
    want = {}
    for (i, t), g, s in zip(rows, groups, sets):
        if i is not None:
            g = ("text", g) if s else ("none", i, t)
            want[g] = min(want.get(g, i), i)
    got = pairs(kept)
    of = {(i, t): ("text", g) if s else ("none", i, t) for (i, t), g, s in zip(rows, groups, sets)}
    assert Counter(of[i, t] for i, t in got.elements() if i is not None) == Counter(want.keys()) and all(want[of[i, t]] == i for i, t in got if i is not None)
    assert sum(n for (i, _), n in got.items() if i is None) == 2
    assert pairs(run_again(stages["n-gram Jaccard join"], spark, docs.repartition(5), odd)) == got

    mixed = run("mixing sources to target weights", docs)
    before = Counter((i, t) for i, t in rows)
    for r in mixed.collect():
        own = [t for i, t in before if i == r["doc_id"] and t and set(r["text"].split()) <= set(t.split())]
        assert own and r["n_chars"] == len(r["text"]), (r["doc_id"], r["text"], r["n_chars"])
    assert len(pairs(mixed)) == mixed.count()

    few = run("best-fit packing", deduped)
    assert packed(few, [(r["doc_id"], r["text"]) for r in deduped.collect()]) <= 3

    nothing = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, odd).count() == 0
    whole = corpus_pipeline.run(spark, odd)
    assert whole.count() > 0


def run_again(stage, spark, docs, odd):
    return stage(spark, docs, odd)


def test_long_texts(spark, tmp_path):
    """A text of 5 MB among short ones; each operator takes the whole of it."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(30_000)]
    big = "\n".join(" ".join(rng.choice(words) for _ in range(20)) for _ in range(42_000))
    assert len(big) > 5_000_000
    tail = big[-3000:]
    rows = [(1, big, "s"), (2, big, "s"), (3, tail, "s"), (4, "short text", "s"), (5, tail + " more", None)]
    at = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 6)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    n_words = {i: len(t.split()) for i, t, _ in rows}
    assert {r["doc_id"]: r["n_tokens"] for r in queries.op5_lm_scoring(spark, at).collect()} == {i: n + 1 for i, n in n_words.items()}
    assert {r["doc_id"]: r["size"] for r in queries.op9_mixing(spark, at).collect()} == n_words
    got = {r["doc_id"]: r for r in queries.op3_suffix_dedup(spark, at).collect()}
    assert got[2]["n_removed"] == len(big) and got[3]["n_removed"] == 3000 and got[1]["n_removed"] == 0 and got[5]["n_removed"] == 3000
    got = {r["doc_id"]: r["component_id"] for r in queries.op8_ngram_jaccard(spark, at).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 3}
    by_id = lambda name: {r["doc_id"]: r for r in queries.queries()[name](spark, at).collect()}
    lines_ = by_id("op7_line_dedup")
    assert lines_[1]["n_lines"] == 42_000 and lines_[1]["n_dropped"] > 0
    left = dict(plain_lines([(i, t) for i, t, _ in rows]))
    assert all(lines_[i]["kept_sha256"] == hashlib.sha256(left[i].encode()).hexdigest() for i in left)
    sketches = by_id("op2_fingerprints")
    assert sketches[1]["n_chars"] == len(big) and sketches[1]["fingerprint"] == sketches[2]["fingerprint"] and sketches[3]["in_next"] is not None
    assert sum(r["length"] for r in queries.op10_packing(spark, at).where("doc_id = 1").collect()) > 1_000_000
    assert len(by_id("op1_toxicity")) == len(by_id("op4_quality")) == 5
    assert near.near_groups(docs).count() == 5 and {r["doc_id"] for r in near.one_of_each(docs).collect()} == {1, 3, 4}


def test_operators_have_the_named_parts():
    assert suffix.LENGTH == 100 and lm.END == 0 and topk.LEVELS > 1 and packing.CAPACITY == 1024 and lines.LEAST_DOCS == 3
