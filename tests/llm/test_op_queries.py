"""The registered queries over the smallest tables, against their contracts restated in plain Python and their SQL."""

import base64
import collections
import hashlib
import math
import os
import re
import zlib

import duckdb
import pytest

pytest.importorskip("skyloom.llm.queries")
from skyloom.llm import queries as module  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
WORD = r"[^\x20\x09-\x0D]+"


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return {i: t or "" for i, t in duck.execute("select doc_id, text from documents order by doc_id").fetchall()}


@pytest.fixture(scope="module")
def rows(spark):
    def run(name, key="doc_id"):
        found = module.queries()[name](spark, SF).collect()
        out = {r[key]: r for r in found}
        assert len(out) == len(found)
        return out

    return run


def test_op1(rows, texts):
    got = rows("op1_fingerprints")
    assert sorted(got) == list(texts)
    ids = list(texts)
    seen = collections.defaultdict(set)
    for at, i in enumerate(ids):
        after, half = texts[ids[(at + 1) % len(ids)]], len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + after[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(texts[i]), sha(edited))
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        seen[texts[i]].add(got[i].fingerprint)
        seen[edited].add(got[i].edited_fingerprint)
    assert all(len(prints) == 1 for prints in seen.values())


@pytest.mark.parametrize("name", ["op2_jaccard", "op4_top_k"])
def test_sql(spark, duck, name):
    df = module.queries()[name](spark, SF)
    found = duck.execute(module.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(found.fetchall())


def test_op3(rows, texts):
    got = rows("op3_language_model")
    assert sorted(got) == list(texts)
    tokens = {i: [*re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t)), None] for i, t in texts.items()}
    train = collections.Counter(w for i in texts if remainder(i, 10) for w in tokens[i])
    total, kinds = sum(train.values()), len(train)
    for i, own in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (remainder(i, 10) == 0, len(own), sum(train[w] > 0 for w in own), total)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in own))
        assert math.isfinite(r.score) and r.score < 0


def test_op5(rows, texts, duck):
    got = rows("op5_mixing")
    assert sorted(got) == list(texts)
    source = dict(duck.execute("select doc_id, source from documents").fetchall())
    size = {i: len(re.findall(WORD, t)) for i, t in texts.items()}
    whole, taken, target = collections.Counter(), collections.Counter(), {}
    for i, r in got.items():
        whole[source[i]] += size[i]
        taken[source[i]] += r.taken
        target[source[i]] = r.target
        assert r.size == size[i] and r.taken <= 2 * r.size
    assert all(r.source_size == whole[source[i]] for i, r in got.items())
    assert sum(target.values()) == pytest.approx(min(1.5, 2) * sum(size.values()))
    assert all(abs(taken[s] - target[s]) <= max(size.values()) for s in target)


def test_op6(rows, texts):
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    plain = tiktoken.Encoding("plain", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows("op6_bpe")
    assert sorted(got) == list(texts)
    for i, t in texts.items():
        ids = plain.encode_ordinary(t)
        digest = sha(b"".join(k.to_bytes(4, "little") for k in ids))
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), digest, sha(t))


def test_op7(rows, duck):
    got = rows("op7_html", "page_id")
    pages = dict(duck.execute("select page_id, url from pages").fetchall())
    assert {i: r.url for i, r in got.items()} == pages
    for r in got.values():
        assert r.n_chars == len(r.text) and all(line and line == " ".join(line.split()) for line in r.text.split("\n") if r.text)
        assert not re.search(r"</?(script|style|nav|footer|div|p)\b", r.text)


def test_op8(rows, texts, duck):
    got = rows("op8_language")
    assert sorted(got) == list(texts)
    lang = dict(duck.execute("select doc_id, lang from documents").fetchall())
    learned = {v for i, v in lang.items() if v is not None and remainder(i, 3) != 1}
    for i, r in got.items():
        assert r.held_out == (remainder(i, 3) == 1) and 0 <= r.score <= 1
        assert r.lang_pred in learned if any(c.isalpha() for c in texts[i]) else r.lang_pred == "und"
    held = [i for i, r in got.items() if r.held_out and lang[i] in learned]
    assert sum(got[i].lang_pred == lang[i] for i in held) >= 0.9 * len(held)


def test_op9(rows, texts):
    got = rows("op9_line_dedup")
    assert sorted(got) == list(texts)
    for i, r in got.items():
        assert 0 <= r.n_kept <= r.n_lines
        assert r.n_kept < r.n_lines or r.text_sha256 == sha(texts[i])
    assert got[next(iter(texts))].n_kept > 0


def test_op10(rows, texts):
    got = rows("op10_quality")
    assert sorted(got) == list(texts)
    for i, r in got.items():
        assert r.held_out == (remainder(i, 5) == 0) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.3)
