"""Each operator against a plain restatement of its contract, and on the awkward rows all of them must bear."""

import collections
import hashlib
import html as html_module
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("skyloom.llm.queries")
from skyloom.llm import bpe, components, edits, language, lines, lm, mixing, quality, shingles, topk  # noqa: E402
from skyloom.llm import html as pages_of  # noqa: E402

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n int, size long, h long, row string"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def corpus(seed=1, n=120):
    """Random prose with exact and near copies, shared passages, repeated lines, nulls, blanks and a long text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeéñß", k=rng.randint(1, 6))) for _ in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts = []
    for i in range(n):
        made = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 40))).capitalize() for _ in range(rng.randint(1, 6))]
        if i % 5 == 0:
            made.insert(rng.randint(0, len(made)), passage)
        texts.append("\n".join(made))
    for i in range(0, n, 4):
        copied = texts[i].split(" ")
        for _ in range(rng.randint(0, 4)):
            copied[rng.randrange(len(copied))] = rng.choice(vocabulary)
        texts.append(" ".join(copied))
    texts += [None, "", "  \n\n ", "a", "a b c", "A B  c", texts[0], texts[0], " ".join(rng.choices(vocabulary, k=30000)), "x" * 50000, "    日本語 😀 it's"]
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None, "s1"]), None, 0.5, 1, 2, 3, "r") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_fingerprints(docs, rows, empty):
    got = {r.doc_id: r for r in edits.edited_fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for i, row in enumerate(rows):
        text, other = row[1] or "", rows[(i + 1) % len(rows)][1] or ""
        assert got[row[0]].n_chars == len(text)
        assert got[row[0]].edited_sha256 == hashlib.sha256(edits.replaced(text, other).encode()).hexdigest()
        mine, theirs, following = edits.fingerprints_of([text, edits.replaced(text, other), other])
        assert (got[row[0]].fingerprint, got[row[0]].edited_fingerprint) == (mine, theirs)
        assert got[row[0]].near_edited == pytest.approx(edits.likeness(mine, theirs))
        assert got[row[0]].near_next == pytest.approx(edits.likeness(mine, following))
    assert edits.edited_fingerprints(empty).count() == 0


def test_fingerprint_follows_edit_distance():
    rng = random.Random(3)
    text = "".join(rng.choices("abcdefghij ", k=4000))
    near = []
    for n in (0, 10, 200, 2000):
        chars = list(text)
        for _ in range(n):
            chars[rng.randrange(len(chars))] = rng.choice("klm")
        near.append(edits.likeness(*edits.fingerprints_of([text, "".join(chars)])))
    assert near[0] == 1 and near[0] > near[1] > near[2] > near[3]
    assert edits.likeness("", "") == 1 and edits.likeness("", edits.fingerprints_of(["a"])[0]) == 0


def plain_walk(text):
    """The walk step by step: copy the character under the pointer, then move on if the coin of step and character says so."""
    stays, kinds, symbols = edits._stays().reshape(edits.KINDS, edits.PERIOD), edits._kinds() // edits.PERIOD, edits._symbols()
    copied, at, step = [], 0, 0
    while at < len(text):
        copied.append(symbols[ord(text[at])])
        at += int(stays[kinds[ord(text[at])], step % edits.PERIOD] == 1)
        step += 1
    return copied


def test_fingerprints_are_samples_of_the_plain_walk():
    rng = random.Random(13)
    for n in (0, 1, 5, 70, 900):
        text = "".join(rng.choices("abc é日\n", k=n))
        copied = plain_walk(text)
        levels = 0 if not copied else 1 + max(0, (len(copied) - 1) // edits.SAMPLES).bit_length()
        places = edits._sampled()[: levels * edits.SAMPLES]
        want = bytes(copied[p] if p < len(copied) else 46 for p in places.tolist()).decode()
        assert edits.fingerprints_of([text]) == [want]


def test_awkward_rows(spark):
    """String and null ids, repeated rows and bytes that are no UTF-8, through each operator that reads texts in Python."""
    made = [("b", "two words"), ("a", "one"), (None, "none"), ("b", "two words"), (None, None), ("c", "")]
    df = spark.createDataFrame(made, "doc_id string, text string").unionByName(spark.sql("select 'd' doc_id, cast(X'61FF20C328' as string) text"))
    df = df.selectExpr("*", "'en' lang", "1 n_tokens", "2.0 score", "'x' fingerprint", "3 node")
    texts = dict(r for r in made if r[0]) | {"d": "a\ufffd \ufffd("}
    got = edits.edited_fingerprints(df).collect()
    order = [(None, ""), (None, "none"), *sorted((k, t) for k, t in [*made, ("d", texts["d"])] if k)]
    want = collections.Counter((k, len(t), hashlib.sha256(edits.replaced(t, order[(i + 1) % len(order)][1]).encode()).hexdigest()) for i, (k, t) in enumerate(order))
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    codec = bpe.Codec(bpe.serialise([bytes([i]) for i in range(256)]), [bytes([i]) for i in range(256)], r"\S+|\s+")
    assert codec.decode(codec.encode(texts["d"])) == texts["d"].encode()
    tokenizers = pytest.importorskip("public_tokenizers")
    encoded = bpe.encode_documents(df, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN).collect()
    digests = collections.Counter((k, hashlib.sha256((t or "").encode()).hexdigest()) for k, t in [*made, ("d", texts["d"])])
    assert collections.Counter((r.doc_id, r.decoded_sha256) for r in encoded) == digests
    assert language.predict(df, language.train(df, F.lit(True))).count() == len(made) + 1
    labels = spark.createDataFrame([("a", 1), ("b", 0), (None, 1)], "doc_id string, quality int")
    scored = quality.predict(df, quality.train(df, labels, F.lit(True)))
    assert scored.columns == [*(c for c in df.columns if c != "score"), "score"] and scored.where("score between 0 and 1").count() == len(made) + 1
    counted = lm.score(df, lm.train(df)).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in counted} == {"a": 1, "b": 2, "c": 1, "d": 1, None: 2}
    kept = lines.dedup_lines(df).select("doc_id", "n_kept").collect()
    assert collections.Counter(map(tuple, kept)) == collections.Counter({("b", 1): 2, ("a", 1): 1, (None, 1): 1, (None, 0): 1, ("c", 0): 1, ("d", 1): 1})
    taken = mixing.mix_sources(df.withColumn("source", F.lit("s"))).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in taken} == {"a": 1, "b": 2, "c": 1, "d": 1, None: 2}
    members = {r.doc_id: r.component_id for r in shingles.jaccard_components(df).collect()}
    assert members == {"a": "a", "b": "b", "c": "c", "d": "d", None: None}


def near_copies(rng):
    """Texts with edits at the start, in the middle and at the end, and some that share an opening only."""

    def made(n):
        return "".join(rng.choices("abcdefghij ", k=n))

    opening, texts, copies = made(300), [], []
    for place in (0, 0.5, 1):
        for _ in range(30):
            body = list(made(rng.randint(300, 5000)))
            texts.append("".join(body))
            at = int(place * (len(body) - 12))
            for i in range(at, at + 12, 4):
                body[i] = rng.choice("xyz")
            texts.append("".join(body))
            copies.append((len(texts) - 2, len(texts) - 1))
    return texts + [opening + made(3000) for _ in range(20)], copies


def test_near_pairs_and_components(spark):
    texts, copies = near_copies(random.Random(5))
    prints = edits.fingerprints_of(texts)
    near = {(i, j) for j in range(len(texts)) for i in range(j) if edits.likeness(prints[i], prints[j]) >= 0.9}
    assert len(near & set(copies)) > 80 and near <= set(copies)
    near = {(i, j) for i, j in near if prints[i] != prints[j]}  # equal fingerprints are one class
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[4]), (500, None), (501, "")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, key int")
    members, pairs = edits.near_pairs(df, least=0.9)
    got = [(r.other_id, r.class_id) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) <= {(b, a) for a, b in near} | near
    assert len(got) >= 0.95 * len(near)
    for part in range(3):
        wanted = near & set(copies[30 * part : 30 * part + 30])
        assert len(wanted & {tuple(sorted(p)) for p in got}) >= 0.9 * len(wanted)
    classes = collections.Counter(map(tuple, members.collect()))
    assert classes[3, 3] == 2 and classes[None, 4] == 1 and classes[500, 500] == classes[501, 500] == 1 and len(classes) == len(texts) + 3
    assert all(classes[i, prints.index(p)] for i, p in enumerate(prints))
    found = edits.with_near(edits.edited_fingerprints(df), least=0.9).collect()
    assert len(found) == len(rows)
    linked = {max(p): min(p) for p in got}
    assert all(r.near_id == linked.get(r.class_id, r.class_id) for r in found)
    assert edits.with_near(edits.edited_fingerprints(df.where("false"))).count() == 0


def brute_components(rows):
    own = {}
    for r in rows:
        w = words(r[1])
        own[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in own}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(own)
    for a in ids:
        for b in ids:
            if a < b and own[a] and own[b] and 100 * len(own[a] & own[b]) >= 75 * len(own[a] | own[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(own[i]), find(i)) for i in ids}


@pytest.mark.parametrize("sample, heavy, frequent", [(16, 8, 128), (1, 2, 2), (1, 4, 1)])
def test_jaccard(docs, rows, empty, monkeypatch, sample, heavy, frequent):
    for name, value in (("SAMPLE", sample), ("HEAVY", heavy), ("FREQUENT", frequent)):
        monkeypatch.setattr(shingles, name, value)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingles.jaccard_components(docs).collect()}
    assert got == brute_components(rows)
    if sample == 16:
        assert shingles.jaccard_components(empty).count() == 0


def test_jaccard_of_repeated_rows_and_null_ids(spark, rows):
    made = [r for r in rows[:40] if r[1]]
    again = made + made[:7] + [(None, r[1], *r[2:]) for r in made[3:12]] + [(None, made[0][1] + " end", *made[0][2:])] * 2
    got = collections.Counter((r.doc_id, r.component_id) for r in shingles.jaccard_components(spark.createDataFrame(again, SCHEMA)).collect())
    component = brute_components(made)
    of_text = {r[1]: component[r[0]][1] for r in made}
    of_text[made[0][1] + " end"] = of_text[made[0][1]]
    assert got == collections.Counter((r[0], of_text[r[1]]) for r in again)


@pytest.mark.parametrize("sample, heavy, frequent", [(16, 8, 128), (1, 2, 2)])
def test_jaccard_links(spark, rows, monkeypatch, sample, heavy, frequent):
    """All links, those of documents connected through others included."""
    for name, value in (("SAMPLE", sample), ("HEAVY", heavy), ("FREQUENT", frequent)):
        monkeypatch.setattr(shingles, name, value)
    run = [f"w{i}" for i in range(108)]
    chain = [" ".join(run[i : i + 100]) for i in range(0, 9, 2)] * 2  # each links with several others
    rows = rows + [(1000 + i, t, *rows[0][2:]) for i, t in enumerate(chain)] + [(None, chain[0], *rows[0][2:])]
    members, found = shingles.jaccard_links(spark.createDataFrame(rows, SCHEMA))
    own = []
    for r in rows:
        w = words(r[1])
        own.append((r[0], {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    linked = [[b for b, (_, y) in enumerate(own) if b != a and x and y and 100 * len(x & y) >= 75 * len(x | y)] for a, (_, x) in enumerate(own)]
    members = members.collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.n_links) for r in members) == collections.Counter((i, len(s), len(linked[a])) for a, (i, s) in enumerate(own))
    node = {r.doc_id: r.node for r in members}
    pairs = [(r.node, r.other) for r in found.collect()]
    wanted = {tuple(sorted((node[own[a][0]], node[own[b][0]]))) for a in range(len(own)) for b in linked[a] if own[a][1] != own[b][1]}
    assert len(pairs) == len(set(pairs)) and set(pairs) == wanted and len(wanted) > 8


def test_jaccard_prefix_keys_lose_no_link():
    rng = np.random.default_rng(2)
    linked = 0
    for turn in range(3000):
        n = int(rng.integers(1, (60, 300, 3000)[turn % 3]))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate((x[rng.random(len(x)) > rng.random() * 0.3], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 3))).astype(np.uint64))))
        if not len(y) or not shingles.links(x.tobytes(), y.tobytes()):
            continue
        linked += 1
        (p, k), (q, m) = shingles.first_look(x), shingles.first_look(y)
        assert len(np.intersect1d(p, y)) >= k and len(np.intersect1d(q, x)) >= m
        # an order of what is not in one of them alone, rare first
        alone = np.concatenate([rng.permutation(a)[: int(rng.integers(0, len(a) + 1))] for a in (np.setdiff1d(x, y), np.setdiff1d(y, x))])
        pool = np.setdiff1d(np.unique(np.concatenate((x, y))), alone)
        rank, rare = rng.permutation(len(pool)), int(rng.random() ** 2 * len(pool))
        found = []
        for s in (x, y):
            own = np.sort(rank[np.searchsorted(pool, np.intersect1d(s, pool))])
            keys, places = shingles.keys_of(len(s), len(s) - len(own), pool[np.argsort(rank)][own], int((own < rare).sum()))
            assert len(keys) <= 12 * len(s)
            found.append((len(s), len(s) - len(own), keys, places))
        (n, u, k, i), (m, v, q, j) = found
        need = -(-75 * (n + m) // 175)
        assert min(n - u, m - v) >= need
        common, a, b = np.intersect1d(k, q, return_indices=True)
        assert ((i[a] <= n - need) & (j[b] <= m - need)).any()
    assert linked > 500


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 103), (103, 101), (7, 3)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


def kneser_ney(train):
    unigrams = collections.Counter(w for x in train for w in x)
    pairs = collections.Counter(p for x in train for p in zip(["<s>", *x], x, strict=False))
    context, kinds, after = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0, 0]), collections.Counter()
    for (u, w), c in pairs.items():
        context[u] += c
        kinds[u][min(c, 3)] += 1
        after[w] += 1

    def discounts(counts):
        return [0, *lm.discounts([sum(c == i for c in counts) for i in (1, 2, 3, 4)])]

    high, low = discounts(pairs.values()), discounts(after.values())
    rest, total, size = sum(low[min(c, 3)] for c in after.values()), sum(after.values()), len(unigrams)

    def lower(w):
        return (max(after[w] - low[min(after[w], 3)], 0) + rest / (size + 1)) / total

    def p(u, w):
        if not context[u]:
            return lower(w)
        c = pairs[u, w]
        return max(c - high[min(c, 3)], 0) / context[u] + sum(high[i] * kinds[u][i] for i in (1, 2, 3)) / context[u] * lower(w)

    return unigrams, p


def test_language_model(docs, rows, empty):
    part = "pmod(crc32(cast(cast(doc_id as string) as binary)), 10) <> 0"
    train = [words(r[1]) + ["</s>"] for r in rows if zlib.crc32(str(r[0]).encode()) % 10]
    unigrams, p = kneser_ney(train)
    total, size = sum(unigrams.values()), len(unigrams)
    model = lm.train(docs.where(part))
    got = {r.doc_id: r for r in lm.score(docs, model).collect()}
    for r in rows:
        x = words(r[1]) + ["</s>"]
        g = got[r[0]]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(x), sum(unigrams[w] > 0 for w in x), total)
        assert g.base_score == pytest.approx(sum(math.log10((unigrams[w] + 0.1) / (total + 0.1 * (size + 1))) for w in x))
        assert g.score == pytest.approx(sum(math.log10(p(u, w)) for u, w in zip(["<s>", *x], x, strict=False)), rel=1e-6)
    untrained = lm.score(docs, lm.train(empty)).collect()
    assert len(untrained) == len(rows) and all(abs(r.score) < 1e-9 and r.train_tokens == 0 for r in untrained)


def test_hash_tables_are_dealt_as_spark_does(spark):
    keys = np.random.default_rng(1).integers(0, 1 << 63, 500)
    got = spark.createDataFrame([(int(k),) for k in keys], "key long").select("key", F.expr("pmod(xxhash64(key), 13)").alias("s")).collect()
    assert [r.s for r in got] == lm.spread(np.array([r.key for r in got]).view(np.uint64), 13).tolist()


def test_top_k(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(v) for v in rng.normal(0, 1, 8).round(1)]) for i in range(300)]
    vectors += [(50, vectors[3][1]), (301, None), (350, [None] * 8), (400, [float("nan")] * 8), (450, [float("inf")] * 8), (303, vectors[0][1]), (304, [1.0, 2.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3)
    got = collections.Counter(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0")).collect()))
    valid = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v in vectors if v and None not in v and np.isfinite(v).all()]
    want = collections.Counter()
    for i, q in valid:
        if i % 50 == 0:
            best = sorted((-int(q @ v), j) for j, v in valid if j != i and len(v) == len(q))[:5]
            want.update((i, k + 1, j, -s) for k, (s, j) in enumerate(best))
    assert got == want
    assert topk.top_k(df.where("false"), df.where("false")).count() == 0


def test_top_k_of_large_components(spark):
    vectors = [(i, [float(i % 7), -float(i % 5), 1.0]) for i in range(40)] + [(50, [300000.0, 1.0, 0.0]), (51, [-3e6, 2.5, 1.0]), (100, [4e6, 5e6, -6e6]), (101, [1e7, 0.0, 0.0]), (150, [0.25, 0.0, -2.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(2)
    got = collections.Counter(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0")).collect()))
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in vectors]
    want = collections.Counter()
    for i, q in whole:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in whole if j != i)[:5]
            want.update((i, k + 1, j, -s) for k, (s, j) in enumerate(best))
    assert len(want) == 20 and got == want
    with pytest.raises(Exception, match="beyond 64 bits"):
        far = spark.createDataFrame([(1, [1e30]), (2, [1e30])], "vec_id long, embedding array<float>")
        topk.top_k(far, far).collect()


def test_top_k_with_a_common_vector_and_other_columns(spark):
    rng = random.Random(7)
    vectors = [(i, [1.0, 0.5, -1.0] if i % 3 else [rng.uniform(-1, 1) for _ in range(3)]) for i in range(2500)]
    vectors += [(100, [1.0, 0.5, -1.0])] * 9 + [(7, [2.0, 1.0, 0.0])] * 9
    df = spark.createDataFrame([(i, v, 1, "x", 2.0, 3) for i, v in vectors], "vec_id long, embedding array<double>, h int, exact string, score double, rank int")
    got = collections.Counter(map(tuple, topk.top_k(df, df.where("vec_id % 100 = 0")).collect()))
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors]
    want = collections.Counter()
    for i, q in whole:
        if i % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in whole if j != i)[:5]
            want.update((i, k + 1, j, -s) for k, (s, j) in enumerate(best))
    assert got == want


def test_approximation_bounds_hold():
    rng = np.random.default_rng(5)
    for size in (500, 1 << 40):
        exact = rng.integers(-size, size, (700, 16))
        exact[3] = 0
        queries = rng.integers(-size, size, (20, 16))
        low, up = topk.Approximation(exact.astype(float)).bounds(queries.astype(float))
        true = queries.astype(object) @ exact.T.astype(object)
        assert (low <= true).all() and (true <= up).all()


def test_mixing(spark, docs, rows, empty):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    size = {r[0]: len(words(r[1])) for r in rows}
    total = collections.Counter()
    for r in rows:
        total[r[3]] += size[r[0]]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, whole = {}, 1.5 * sum(total.values())
    while True:
        left = [s for s in names if s not in target]
        share = {s: (whole - sum(target.values())) * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 2 * total[s]]
        target |= {s: 2 * total[s] for s in over} if over else share
        if not over:
            break
    taken = collections.Counter()
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == total[r.source] and r.taken <= 2 * r.size
        assert r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    largest = max(size.values())
    assert all(abs(taken[s] - target[s]) <= largest for s in names)
    again = {(r.doc_id, r.taken) for r in mixing.mix_sources(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    assert mixing.mix_sources(empty).count() == 0
    twice = mixing.mix_sources(docs.union(docs)).groupBy("doc_id").count().select("count").distinct().collect()
    assert [r[0] for r in twice] == [2]


def test_mixing_rounds_near_its_targets(spark):
    rng = random.Random(9)
    data = [(i, " ".join(["w"] * rng.randint(1, 80)), f"s{rng.randrange(4)}") for i in range(5000)]
    got = mixing.mix_sources(spark.createDataFrame(data, "doc_id long, text string, source string"))
    for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) < 0.02 * r.target


def test_bpe_agrees_with_a_public_library(docs, rows, empty):
    tokenizers, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = bpe.read_ranks(path)
    other = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    got = {r.doc_id: r for r in bpe.encode_documents(docs, path, tokenizers.PATTERN).collect()}
    for r in rows:
        ids = other.encode_ordinary(r[1] or "")
        g = got[r[0]]
        assert g.n_tokens == len(ids) and bytes(g.ids) == np.array(ids, dtype="<u4").tobytes()
        assert g.ids_sha256 == hashlib.sha256(bytes(g.ids)).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256((r[1] or "").encode()).hexdigest()
    assert bpe.encode_documents(empty, path, tokenizers.PATTERN).count() == 0
    rng = random.Random(1)
    parts = ["'", "s", "t", "re", "ll", " ", "  ", "\n", "\t", "a", "é", "1", "²", "!", " ", "　", "日", "😀", "\x1c", "́", "_", "Z"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(3000)]
    codec, slow = (bpe.Codec(bpe.serialise(tokens), tokens, p) for p in (tokenizers.PATTERN, f"(?:{tokenizers.PATTERN})"))
    for text in texts:
        assert codec.encode(text) == other.encode_ordinary(text)
        assert codec.decode(codec.encode(text)) == text.encode()
    assert [slow.encode(t) for t in texts[:300]] == [codec.encode(t) for t in texts[:300]]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li>Menu</ul></nav>
<div class="site-top">Welcome to {host}</div>{body}<div class="ad-slot">Buy</div><aside>Side</aside>
<form>Name <input></form><script>if (a < b) "</p>"</script><!-- <p>no</p> --><section id="comments"><p>Me too</p></section>
<footer>&copy; {host}</footer></body></html>"""


def test_html(spark):
    rows = []
    for i in range(12):
        body = f"<article><h1>Head {i}</h1><p>One &amp; <b>two</b>\n  three<p>x &lt; y<br>z &#233;</article>"
        rows.append((i, f"http://a.example/{i}", PAGE.format(host="a.example", body=body), "x"))
    for i in range(12, 24):
        body = f"<div><p>Plain text {i}</p><ul><li>first<li>second {i}</ul></div>"
        rows.append((i, f"https://b.example:80/{i}", PAGE.format(host="b.example", body=body), "x"))
    rows += [(90, None, None, "x"), (91, "", "", "x"), (92, "http://c.example", "<p>open <b>bold", "x"), (93, "http://c.example", "no tags 1 < 2 &am", "x"), (90, None, None, "x"), (94, "http://c.example", "<article></article>", "x")]
    got = collections.defaultdict(list)
    for r in pages_of.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect():
        got[r.page_id].append(r.text)
    for i in range(12):
        assert got[i] == [f"Head {i}\nOne & two three\nx < y\nz é"]
    for i in range(12, 24):
        assert got[i] == [f"Plain text {i}\nsecond {i}"]  # the item that all of the host's pages have is template
    assert got[90] == ["", ""] and got[91] == [""] and got[94] == [""]
    assert got[92] == ["open bold"] and got[93] == ["no tags 1 < 2 " + html_module.unescape("&am")]
    assert pages_of.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_templates_in_main(spark):
    rows = []
    for i in range(10):
        box = '<div class="cta-box"><p>Read our paper</div><ul class="tools"><li>Print<li>Mail</ul>'
        reader = f'<article class="comment"><p>Reader {i}</article>'
        body = f'<main><p>Lead {i}<article><h2 id="refs">Refs</h2><p>Same words<p><b>Note:</b> text {i}{box}{reader}</article></main>'
        rows.append((i, f"http://a.example/{i}", f"<body>{body}</body>"))
        rows.append((100 + i, f"http://copy.example/{i}", "<main><h1>One</h1><div class=body><p>The copied text</div></main>"))
        rows.append((200 + i, f"http://few.example/{i // 4}", f'<article><p>Text {i}{"<div class=cta-box>Now and then</div>" if i < 4 else ""}</article>'))
        rows.append((300 + i, f"http://d.example/{i}", f"<div><p><b>Note:</b> plain {i}</div><div>Terms</div>"))
    got = {r.page_id: r.text for r in pages_of.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(10):
        assert got[i] == f"Lead {i}\nRefs\nSame words\nNote: text {i}"
        assert got[100 + i] == "One\nThe copied text"
        assert got[200 + i] == (f"Text {i}\nNow and then" if i < 4 else f"Text {i}")
        assert got[300 + i] == f"Note: plain {i}"


def test_html_counts_templates_as_plain_python_does(spark):
    """Menus and footers of a host are told by repetition, adverts of their own by kind; a host of a third of all pages."""
    rng = random.Random(12)
    rows = []
    for i in range(90):
        host = "big.example" if i % 3 else f"h{i % 4}.example"
        nav = f'<nav><ul><li><a href="/a">A of {host}</a><li>B</ul></nav>'
        extra = f"<nav>page {i}</nav>" if i % 5 == 0 else ""
        box = '<div class="tools"><p>Print this</div>' if rng.random() < 0.8 else ""
        body = f"{nav}{extra}<div class=ad>Buy {i}</div><article><h1>Head</h1><p>Text {i}</p>{box}</article><footer>&copy; {host}</footer>"
        rows.append((i, f"https://{host}/{i}", f"<html><body>{body}</body></html>"))
    rows += [rows[1], (None, "https://big.example/x", rows[1][2]), (200, None, rows[1][2])]
    parsed = [(r[0], r[1].split("/")[2] if r[1] else None, pages_of.main_blocks(r[2])) for r in rows]
    pages, seen = collections.defaultdict(set), collections.defaultdict(set)
    for _, host, (_, hashes, _, whole) in parsed:
        if host:
            pages[host].add(whole)
            for h in hashes:
                seen[host, h].add(whole)
    want = collections.Counter()
    for (key, _, _), (_, host, (blocks, hashes, listed, _)) in zip(rows, parsed, strict=True):
        gone = {h for h in hashes if host and len(seen[host, h]) >= max(pages_of.MIN_PAGES, pages_of.SHARE * len(pages[host]))}
        text = "\n".join(t for t, path in blocks if not gone & set(path))
        want[key, text, len(gone), len(set(listed) - gone)] += 1
    got = pages_of.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).drop("url").collect()
    assert collections.Counter(map(tuple, got)) == want
    assert all(n >= 2 for (key, _, n, _) in want if key != 200)  # menu and footer, and the box where a page has it
    assert all(t == f"Head\nText {key}" and m == (2 if key % 5 == 0 else 1) for (key, t, _, m) in want if key not in (None, 200) and key % 3)


@pytest.mark.parametrize(
    "page, text",
    [
        ('<div class="layout has-sidebar"><article><p>Text</article></div>', "Text"),
        ('<div id="page" class="no-sidebar nav-open"><p>Text</div>', "Text"),
        ('<div class="sidebar"><div class="sidebar"><article>Teaser</article></div><article><p>Text</article></div>', "Text"),
        ('<div class="banner"><article class="sponsored"><p>Text</article></div><div>Foot</div>', "Text"),
        ('<div><p>Text</div><section id="comments"><article><p>Me too</article></section>', "Text"),
        ('<div class="wrap comments"><main><p>Text</main></div>', "Text"),
        ('<article>Text</article><article class="comment">Me too</article>', "Text"),
        ('<article><h2 id="related">Related</h2><section id="social-history"><p>Then</section><p class="notice">Take notice</article>', "Related\nThen\nTake notice"),
        ('<article>One <span class="share">Share</span> two<div class="share box">Share</div></article>', "One\ntwo"),
    ],
)
def test_html_names(page, text):
    assert "\n".join(t for t, _ in pages_of.main_blocks(page)[0]) == text


def test_language(spark, docs, empty):
    rng = random.Random(6)
    sounds = {"en": ["th", "ing", "er", "ow"], "de": ["sch", "ung", "ei", "ü"], "fr": ["eau", "è", "que", "oi"]}
    data = [(i, " ".join("".join(rng.choices(sounds[k], k=3)) for _ in range(rng.randint(3, 60))), k) for i in range(600) for k in [rng.choice(list(sounds))]]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    learn = F.expr("pmod(crc32(cast(cast(doc_id as string) as binary)), 3) <> 1")
    model = language.train(df, learn)
    truth = {r[0]: r[2] for r in data}
    got = [r for r in language.predict(df, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.98 * len(got)
    odd = {r.doc_id: r for r in language.predict(docs, model).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, r in odd.items():
        letter = texts[i] is not None and any(map(str.isalpha, texts[i]))
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (not letter)
    assert language.predict(empty, model).count() == 0
    nothing = language.predict(df, language.train(empty, F.lit(True))).select("lang_pred").distinct().collect()
    assert [r[0] for r in nothing] == ["und"]


def test_every_language_is_learned(spark):
    """150 languages, one of them seen once; null ids, repeated rows and other columns named like the results."""
    rng = random.Random(16)
    sounds = {f"l{k:03}": [f"{chr(0x4E00 + 40 * k + j)}" for j in range(12)] for k in range(150)}
    made = [(i, "".join(rng.choices(sounds[k], k=40)), k, 0.5) for i, k in enumerate([*sort_twelve(sounds), "l149"])]
    made += made[:3] + [(None, "".join(rng.choices(sounds["l003"], k=40)), "l003", 0.5)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, score double")
    model = language.train(df, F.lit(True))
    assert model.languages == sorted(sounds)
    got = language.predict(df, model).collect()
    assert len(got) == len(made)
    truth = {r[0]: r[2] for r in made}
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) > 0.9 * len(got)


def sort_twelve(names):
    return [k for k in names for _ in range(12 if k != "l149" else 0)]


def test_quality(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(quality, "EPOCHS", 5)
    rng = random.Random(8)
    data = []
    for i in range(500):
        text = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(rng.randint(5, 150)))
        data.append((i, text if i % 3 else re.sub(r" ", "### ", text)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(500)] + [(1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(df, labels, F.col("doc_id") % 5 != 0)
    got = [r for r in quality.predict(df, model).collect() if r.doc_id % 5 == 0]
    assert sum((r.score >= 0.5) == (r.doc_id % 3 > 0) for r in got) >= 0.95 * len(got)
    odd = quality.predict(docs, model)
    assert set(odd.columns) == set(docs.columns) and odd.where("score between 0 and 1").count() == docs.count()
    assert quality.predict(empty, model).count() == 0
    one = quality.predict(df, quality.train(df, labels.where("quality = 1"), F.lit(True))).select("score").distinct().collect()
    assert [r[0] for r in one] == [1.0]


def test_chunks_cover_the_whole_text():
    for n in (0, 1, 255, 256, 257, 448, 449, 5000):
        data = np.arange(n, dtype=np.int64).astype(np.uint8)
        starts, ends, count = quality.spots(np.array([0, n, 2 * n]))
        symbols = quality.cut(np.concatenate((data, data)), starts, ends)
        assert count[0] == count[1] and (symbols[: count[0]] == symbols[count[0] :]).all()
        covered = (count[0] - 1) * quality.STEP + quality.CHUNK
        assert covered >= n and (symbols != quality.PAD).sum() >= 2 * n


def brute_lines(rows):
    seen, patterns, shorter, out = set(), set(), set(), {}
    for r in rows:
        if r[1] is None:
            out[r[0]] = (0, 0, None)
            continue
        kept, before, after = [], 0, 0
        for line in r[1].split("\n"):
            w = tuple(re.findall(WORD, line.lower()))
            n = len(w)
            if not n:
                kept.append(line)
                continue
            before += 1
            cut = [w[:i] + w[i + 1 :] for i in range(n)]
            known = w in seen or n >= 8 and (any((i, c) in patterns for i, c in enumerate(cut)) or w in shorter) or n >= 9 and any(c in seen for c in cut)
            seen.add(w)
            if n >= 8:
                patterns.update(enumerate(cut))
            if n >= 9:
                shorter.update(cut)
            if not known:
                kept.append(line)
                after += 1
        out[r[0]] = (before, after, "\n".join(kept))
    return out


def test_lines(spark, docs, rows, empty):
    out = lines.dedup_lines(docs)
    assert set(out.columns) == {*docs.columns, "n_lines", "n_kept"}
    # a word of 50,000 letters makes words long, not many
    got = {r.doc_id: (r.n_lines, r.n_kept, r.text) for r in out.collect()}
    assert got == brute_lines(rows)
    assert lines.dedup_lines(empty).count() == 0
    base = "one two three four five six seven eight nine ten"
    made = [(1, base), (2, base.replace("five", "5")), (3, base + " eleven"), (4, base.replace("one ", "")), (5, base.replace("one", "1").replace("ten", "10")), (6, "Short line"), (7, "short  LINE"), (8, "short lime"), (8, "short lime"), (None, "null id")]
    small = spark.createDataFrame(made, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_kept) for r in lines.dedup_lines(small).collect()))
    assert got == [(0, 1), (1, 1), (2, 0), (3, 0), (4, 0), (5, 1), (6, 1), (7, 0), (8, 1), (8, 1)]


def test_pipeline_stages(spark, docs, tmp_path, monkeypatch):
    pipeline = pytest.importorskip("corpus_pipeline")
    monkeypatch.setattr(quality, "EPOCHS", 2)
    labels = [(i, int(i % 7 > 0), 0) for i in range(100)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in pipeline.STAGES] == ["quality", "line_dedup", "jaccard", "mixing", "bpe"]
    rows = [tuple(r) for r in docs.collect()]
    left = pipeline.dedup_lines(spark, docs, str(tmp_path)).cache()
    assert left.columns == docs.columns
    want = {i for i, (n, k, _) in brute_lines(rows and sorted(rows)).items() if not n or k}
    assert {r.doc_id for r in left.collect()} == want
    near = pipeline.dedup_near(spark, docs, str(tmp_path))
    assert near.columns == docs.columns
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, (_, c) in brute_components(rows).items() if i == c)
    mixed = pipeline.mix(spark, docs, str(tmp_path))
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(docs).collect()}
    assert collections.Counter(r.doc_id for r in mixed.collect()) == collections.Counter({i: c for i, c in copies.items() if c})
    out = pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns) and out.count() > 0
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name


def test_pipeline_keeps_one_of_each_group_without_or_with_shared_ids(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    made = [(None, one), (None, one + " end"), (5, one), (None, two), (None, two), (7, three), (9, three + " end"), (9, two + " more"), (9, "alone"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in made], "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.dedup_near(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(5, one), (7, three), (9, two + " more"), (9, "alone"), (None, "no id")], key=repr)


def test_quality_learns_from_whole_rows(spark):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        tail = " ".join(rng.choices(["zebra!!", "quartz##"] if i % 2 else ["river", "meadow"], k=9000))
        rows.append((i, "same opening words " * 3600 + tail))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.predict(docs, quality.train(docs, labels, F.lit(True))).collect()}
    assert min(got[i] for i in range(1, 60, 2)) > max(got[i] for i in range(0, 60, 2)) + 0.1
