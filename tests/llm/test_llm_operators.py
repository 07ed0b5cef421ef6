"""Every operator against brute force on small fixtures with nulls, empty and long texts, ties and repeated rows."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quiresmith.llm import bpe, decontamination, embedding_dedup, language_id, ngram_join, pii, sharding, substring_dedup, suffix_dedup, token_store
from quiresmith.llm.common import components
from quiresmith.llm.suffix_array import suffix_array

SCHEMA = "doc_id long, text string, lang string, id long, h string, size int, node string, cuts string, key string"


def make(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, -1, "h", 7, "n", "c", "k") for i, t, lang in rows], SCHEMA)


def sample_texts(seed=3, n=40):
    rng = random.Random(seed)
    words = ["ab", "cde", "fg", "hijk", "l", "mn,", "Opq", "é", "日本", "x\ty"]
    long = " ".join(rng.choices(words, k=60))
    out = []
    for k in range(n):
        t = " ".join(rng.choices(words, k=rng.randint(0, 50)))
        if k % 3 == 0:
            t = t + " " + long[: rng.randint(20, len(long))]
        if k % 7 == 0 and out:
            t = out[-1][1]
        out.append((k, t, "en"))
    return [*out, (100, None, None), (101, "", None), (101, "", None), (102, long * 40, "en"), (5, out[5][1], "en"), (None, long, "en")]


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark, sample_texts()).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return make(spark, [])


def by_id(df, *cols):
    return sorted(((r["id"] is not None, r["id"] or 0, *(r[c] for c in cols)) for r in df.collect()), key=str)


def test_components(spark):
    edges = spark.createDataFrame([("d", "c"), ("c", "b"), ("b", "a"), ("x", "y"), ("q", "q"), (None, "a"), ("d", "c"), ("e", "y")], "a string, b string")
    assert {tuple(r) for r in components(edges).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "e"), ("y", "e"), ("e", "e")}


def test_base_spans_equal_plain_patterns():
    rng = random.Random(2)
    for _ in range(5000):
        t = "".join(rng.choices("ab@@.-0123459é+ ()%_٣", k=rng.randint(0, 40)))
        email = [m.span() for m in pii.EMAIL.finditer(t)]
        ip = [m.span() for m in pii.IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        assert pii.base_spans(t)[:2] == [email, ip]
    assert pii.base_spans("4111 1111-11111111 +1 (555) 010-9999")[2:] == [[(0, 18)], [(19, 36)]]
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_pii(spark, nothing):
    rows = [
        (1, "mail a.b@c.de now, ip 1.2.3.4 and 300.1.1.1", "en"), (2, None, None), (3, "", None), (4, "+1 (555) 010-9999 4111111111111111 end", "en"),
        *((10 + k, f"word {k} password={hashlib.sha1(b'%d' % k).hexdigest()[:18]} and more", "en") for k in range(30)),
        (50, "the commit 0123456789abcdef0123456789abcdef01234567 is fine", "en"), (51, "time: morning hours", "en"), (4, "+1 (555) 010-9999 4111111111111111 end", "en"),
    ]
    scanned = pii.scan(make(spark, rows)).cache()
    got = pii.label(scanned, pii.fit(scanned)).collect()
    assert len(got) == len(rows)
    spans = {r.id: r for r in got}
    assert (spans[1].n_email, spans[1].n_ip, spans[1].spans) == (1, 1, "email:5:13,ip:22:29")
    assert spans[2].spans == spans[3].spans == spans[51].spans == ""
    assert spans[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert spans[4].spans == "card:18:34,phone:0:17" and spans[4].n_card == spans[4].n_phone == 0
    assert all(spans[10 + k].spans.startswith("secret:") for k in range(30))
    redacted = {r.doc_id: r for r in pii.redact(make(spark, rows)).collect()}
    assert redacted[1].text == "mail <email> now, ip <ip> and 300.1.1.1" and redacted[2].text is None and redacted[10].h == "h"
    assert pii.label(pii.scan(nothing), pii.fit(pii.scan(nothing))).count() == 0


def test_pii_values_of_any_length(spark):
    part = lambda k, n: base64.urlsafe_b64encode(hashlib.shake_256(b"%d" % k).digest(n)).decode().rstrip("=")
    token = lambda k: f"{part(k, 30)}.{part(k + 100, 120 + 10 * k)}.{part(k + 200, 40)}"
    rows = [(k, f"the token={token(k)} and more", "en") for k in range(30)]
    url = f"see https://a.bc/{'d1/' * 90}?token={hashlib.sha1(b'u').hexdigest()[:18]}"
    rows += [(50, url, "en"), (51, f"token={token(51)}:a.b@c.de", "en")]
    found = {r.id: {(c.a, c.b) for c in r.found} for r in pii.scan(make(spark, rows)).collect()}
    assert all(found[k] == {(10, 10 + len(token(k)))} for k in range(30)) and len(token(0)) > 200
    assert (len(url) - 18, len(url)) in found[50]
    redacted = {r.doc_id: r.text for r in pii.redact(make(spark, rows)).collect()}
    assert all(redacted[k] == "the token=<secret> and more" for k in range(30))
    assert redacted[51] == "token=<secret><email>"


def test_pii_compound_names_of_secrets(spark):
    letters = lambda k: "".join(chr(97 + b % 26) for b in hashlib.sha256(b"%d" % k).digest())
    names = ("password=", "db_password=", "MYSQL_ROOT_PASSWORD=", "root_password: ", "client_token=", "deploy_key: ", "APP_SECRET=")
    rows = [(10 * k + n, f"set {name}{letters(k)[:7]}-{letters(k)[7:14]}-{letters(k)[14:22]} here", "en") for k in range(8) for n, name in enumerate(names)]
    rows += [(200 + k, f"the {letters(k)[:6]}: {letters(k)[6:18]} here", "en") for k in range(8)]
    redacted = {r.doc_id: r.text for r in pii.redact(make(spark, rows)).collect()}
    assert all(redacted[10 * k + n] == f"set {name}<secret> here" for k in range(8) for n, name in enumerate(names))
    assert all(redacted[i] == t for i, t, _ in rows if i >= 200)
    for text in ("db_password=correct-horse-battery", "MYSQL_ROOT_PASSWORD=changemenow", "root_password: swordfishes"):
        assert [text[a:b] for _, a, b, _ in pii.candidates(text, [])] == [text.split("=")[-1].split(": ")[-1]]


def minimax(sizes, k):
    lo, hi = max([0, *sizes]), sum(sizes)
    while lo < hi:
        mid, n, at = (lo + hi) // 2, 1, 0
        for s in sizes:
            n, at = (n + 1, s) if at + s > mid else (n, at + s)
        lo, hi = (lo, mid) if n <= k else (mid + 1, hi)
    return lo


@pytest.mark.parametrize(("shards", "width"), [(4, 4096), (5, 16), (90, 16)])
def test_sharding_is_minimax(spark, docs, shards, width):
    got = sharding.shard_documents(docs, shards, width=width).collect()
    assert len(got) == docs.count()
    size, home = {}, {}
    for r in got:
        size[r.key] = size.get(r.key, 0) + r["size"]
        assert home.setdefault(r.key, r.shard) == r.shard
    order = sorted(size)
    assert [home[k] for k in order] == sorted(home[k] for k in order)
    load = {}
    for r in got:
        load[r.shard] = load.get(r.shard, 0) + r["size"]
    assert max(load.values()) == minimax([size[k] for k in order], shards)
    for s in load:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    texts = {i: t for i, t, _ in sample_texts()}
    assert all(r.text_crc32 == zlib.crc32((texts[r.id] or "").encode()) for r in got)


def test_sharding_of_nothing_and_of_one_hot_group(spark, nothing):
    assert sharding.shard_documents(nothing).count() == 0
    hot = make(spark, [(k, "same", None) for k in range(50)] + [(50, "other", None), (51, None, None)])
    got = sharding.shard_documents(hot, 16).collect()
    assert len({r.shard for r in got if r["size"] == 5}) == 1 and len(got) == 52


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 64)).astype(np.float32)
    rows = [(i, (base[i % 12] + rng.normal(size=64) * rng.choice([0, 0.03, 0.1, 0.2])).astype(np.float32).tolist(), i % 2) for i in range(150)]
    rows += [(200, None, 1), (201, [0.0] * 64, 1), (202, [float("nan")] * 64, 1), (203, [None, *[1.0] * 63], 1), (204, rows[0][1], None), (205, [], 1), (206, rows[0][1], 0), (206, rows[0][1], 0), (207, [1.0, 2.0], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("same", F.lit(1)).withColumn("node", F.lit(2))
    valid = [(i, np.array(v, np.float64), label) for i, v, label in rows if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    n, near = {}, {i: {i} for i, *_ in rows}
    for a, (i, v, k) in enumerate(valid):
        n.setdefault((i, a), 0)
        for b, (j, w, m) in enumerate(valid):
            if a != b and k == m and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                n[i, a] += 1
                near[i].add(j)
    changed = True
    while changed:
        changed = False
        for i in near:
            more = set().union(*(near[j] for j in near[i]))
            changed |= more != near[i]
            near[i] = more
    want = {i: c for (i, _), c in n.items()}
    for tile in (1024, 5):
        got = embedding_dedup.near_duplicates(df, tile=tile).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.n_links == want.get(r.id, 0), r
            assert r.component_id == (None if r.id is None else min(near[r.id])), r
            assert r.kept == (r.id == r.component_id), r
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def close_vectors(n, d, seed, labels=3):
    """Vectors of which a third are near others, some very near."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) / np.sqrt(d)
    for k in range(1, n, 3):
        x[k] = x[rng.integers(0, k)] + rng.normal(size=d) * rng.choice([0.003, 0.02, 0.025, 0.03]) * 8 / d
    x = x.astype(np.float32)
    return [(k, v.tolist(), int(label)) for k, (v, label) in enumerate(zip(x, np.arange(n) // 7 % labels, strict=True))], x.astype(np.float64)


def test_embeddings_travel_as_codes(spark):
    rows, _ = close_vectors(4000, 64, 3, 1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    assert embedding_dedup.near_duplicates(df).count() == 4000
    assert written() - before < 4 * 4000 * 64 * 4


def test_embeddings_by_slabs_and_parts(spark):
    for d, cosine, cell in ((65, 0.98, 20), (20, 0.995, 20), (3, 0.999, 1000)):
        rows, x = close_vectors(240, d, d)
        u = x / np.sqrt((x * x).sum(1, keepdims=True))
        label = np.array([r[2] for r in rows])
        want = ((u @ u.T >= cosine) & (label[:, None] == label)).sum(1) - 1
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
        got = {r.id: r.n_links for r in embedding_dedup.near_duplicates(df, cosine=cosine, cell=cell, tile=16).collect()}
        assert [got[k] for k in range(240)] == want.tolist(), d


def test_near_codes_are_all_found():
    rng = np.random.default_rng(8)
    for n, w in ((2, 8), (70, 8), (3000, 8), (3000, 2), (1500, 1)):
        code = np.clip(np.rint(rng.normal(size=(n, w)) * 35), -127, 127).astype(np.int8)
        code[: n // 10] = code[n // 2 : n // 2 + n // 10] + 1
        far = ((code[:, None].astype(np.int32) - code) ** 2).sum(-1)
        for near in (3.5, 31.0):
            got = [np.stack(x) for x in embedding_dedup._near(code, w, near)]
            pairs = {tuple(sorted(p)) for p in np.concatenate(got, axis=1).T.tolist()}
            assert pairs == {(a, b) for a, b in np.argwhere(far <= near * near).tolist() if a < b}


def brute_bytes(rows, length):
    seen, out = set(), {}
    order = sorted({(i is not None, i or 0, t or "") for i, t, _ in rows})
    for known, i, t in order:
        raw = t.encode()
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        gone = gone[: len(raw)]
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out[i if known else None, t] = (len(raw), int(gone.sum()), int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1)), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_arrays():
    rng = random.Random(4)
    for _ in range(3000):
        s = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 25))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("most,batch", [(256, 8 << 20), (2, 8 << 20), (256, 150), (2, 150)])
def test_byte_dedup(docs, most, batch):
    rows = sample_texts()
    want = brute_bytes(rows, 20)
    texts = {i: t or "" for i, t, _ in rows}
    got = suffix_dedup.remove_repeats(docs, length=20, gram=8, most=most, batch_bytes=batch).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.id, texts[r.id]], r.id
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_bpe_equals_tiktoken(spark, docs, nothing):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    alphabet = [chr(c) for c in [*range(0x250), *range(0x300, 0x330), *range(0x2000, 0x2040), 0x3000, 0x1F600, 0x4E00, 0x85, 0x1C]]
    codec = bpe.codec(path, P.PATTERN)
    for t in ["", "a" * 3000, "the" * 500, "<|endoftext|>", *("".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(500))]:
        assert codec.encode(t) == known.encode_ordinary(t)
        assert codec.decode(codec.encode(t)) == t.encode()
    with pytest.raises(ValueError):
        codec.decode([10**9])
    texts = {i: t or "" for i, t, _ in sample_texts()}
    got = bpe.encode_documents(docs, path, P.PATTERN)
    for r in got.collect():
        ids = known.encode_ordinary(texts[r.id])
        assert (r.n_tokens, r.ids) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.id].encode()).hexdigest()
    assert {bytes(r.raw) for r in bpe.decode_documents(got, path, P.PATTERN).collect()} == {t.encode() for t in texts.values()}
    assert bpe.encode_documents(nothing, path, P.PATTERN).count() == 0


@pytest.mark.parametrize("buckets,batch", [(None, 8 << 20), (512, 8 << 20), (None, 150)])
def test_word_windows(docs, nothing, buckets, batch):
    import re

    rows = sample_texts()
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    count = {}
    for _, t, _ in rows:
        w = split(t)
        for k in range(len(w) - 6):
            count[tuple(w[k : k + 7])] = count.get(tuple(w[k : k + 7]), 0) + 1
    want = []
    for i, t, _ in rows:
        w = split(t)
        gone = {p for k in range(len(w) - 6) if count[tuple(w[k : k + 7])] > 1 for p in range(k, k + 7)}
        want.append((i is not None, i or 0, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    assert by_id(substring_dedup.remove_repeats(docs, width=7, buckets=buckets, batch_bytes=batch), "n_words", "n_removed", "kept") == sorted(want, key=str)
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_language(spark, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(*language_id.training_rows(docs.where(~language_id.held_out())))
    got = language_id.identify(docs, model, extra=(F.col("lang"), language_id.held_out().alias("held_out"))).where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert model.predict(None) == model.predict("") == model.predict("12 3.4 !") == ("und", 0.0, True)
    assert all(0 <= r.score <= 1 for r in got)
    odd = make(spark, [(1, None, None), (2, "12", None), (3, docs.first().text, None)])
    kept = language_id.keep_known(odd, model).collect()
    assert [(r.doc_id, r.lang) for r in kept] == [(3, docs.first().lang)]
    none = language_id.train(*language_id.training_rows(nothing))
    assert none.predict("text") == ("und", 0.0, True)
    assert language_id.keep_known(nothing, model).count() == 0


def test_language_rejects_what_it_has_not_learned(spark):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r.text and r.lang and language_id.LETTER.search(r.text)]
    rng = random.Random(11)
    noise = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(rng.randint(5, 80))) for _ in range(200)]
    some = [r for r in rows if r.lang != "de"]
    fit, rest = some[::2], [r.text for r in some[1::2]]
    model = language_id.train([r.text for r in fit], [r.lang for r in fit])
    gone = lambda texts: sum(model.predict(t)[2] for t in texts) / len(texts)
    assert gone(rest) <= 0.03
    assert gone(noise) >= 0.98 and gone([r.text for r in rows if r.lang == "de"]) >= 0.9


def test_decontamination(spark, nothing):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(3, 8)))
    items = [(k, " ".join(word() for _ in range(rng.randint(15, 50)))) for k in range(20)] + [(90, None), (91, "  "), (92, "one two")]
    rows, want = [], set()
    for k in range(120):
        n, text = rng.randrange(20), [word() for _ in range(rng.randint(0, 200))]
        item = items[n][1].split()
        if k % 2:
            some = list(item)
            for _ in range(rng.randint(0, len(item) // 10)):
                p = rng.randrange(len(some))
                some[p : p + 1] = rng.choice([[word()], [], [some[p], word()]])
            p = rng.randint(0, len(text))
            text[p:p] = [w.upper() + rng.choice(["", ",", "!!"]) for w in some]
            want.add((k, n))
        rows.append((k, " ".join(text), "en"))
    rows += [(200, None, None), (201, "", None), (202, "x One, TWO y", None), (203, " ".join(w for _, t in items[:20] for w in t.split()), "en")]
    want |= {(202, 92)} | {(203, k) for k in range(20)}
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit(1))
    got = decontamination.matches(make(spark, rows), benchmark).collect()
    assert {(r.id, r.item_id) for r in got} == want
    clean = decontamination.clean(make(spark, rows), benchmark).collect()
    assert {r.doc_id for r in clean} == {i for i, *_ in rows} - {i for i, _ in want}
    assert decontamination.matches(nothing, benchmark).count() == 0
    assert decontamination.clean(make(spark, rows), benchmark.where("false")).count() == len(rows)


def test_decontamination_where_repeats_do_not_reach_the_recall(monkeypatch):
    rng = random.Random(13)
    monkeypatch.setattr(decontamination, "MOST_REPEATS", 1)
    decontamination.repeats_for.cache_clear()
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    items = [(k, " ".join(word() for _ in range(rng.randint(40, 120)))) for k in range(30)]
    index, words, docs = decontamination.Index(items), decontamination.Words(), []
    for _, text in items:
        some = text.split()
        for _ in range(decontamination.allowed(len(some))):
            p = rng.randrange(len(some))
            some[p : p + 1] = rng.choice([[word()], [], [some[p], word()]])
        docs.append(words(" ".join([*(word() for _ in range(rng.randint(0, 90))), *some, *(word() for _ in range(rng.randint(0, 90)))])))
    assert {(d, i) for d, i, *_ in index.find(docs)} == {(k, k) for k in range(30)}
    decontamination.repeats_for.cache_clear()


def test_edit_distances_against_a_plain_table():
    rng = np.random.default_rng(8)
    for _ in range(50):
        a, b = rng.integers(1, 4, rng.integers(1, 8)), rng.integers(1, 4, rng.integers(1, 15))
        best = np.zeros(len(b) + 1, int)
        for i, x in enumerate(a):
            row = [i + 1]
            for j, y in enumerate(b):
                row.append(min(best[j + 1] + 1, row[-1] + 1, best[j] + (x != y)))
            best = np.array(row)
        assert decontamination.edit_distances(a[None].astype(np.uint64), b[None].astype(np.uint64))[0][0] == best.min()


def test_token_store(spark, docs, nothing, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    known = Tokenizer.from_file(path)
    rng = random.Random(7)
    alphabet = ["A", "b", "ß", "foo", "."] * 20 + [chr(c) for c in [*range(0x250), *range(0x300, 0x330), 0x3000, 0x1100, 0x1161, 0x3A3, 0x130]] + [" ", "\n"] * 60
    encode = token_store.WordEncoder(path)
    for _ in range(500):
        t = "".join(rng.choices(alphabet, k=rng.randint(0, 40)))
        assert np.frombuffer(encode([t])[0], "<u4").tolist() == known.encode(t, add_special_tokens=False).ids
    to = str(tmp_path / "store")
    token_store.write_store(docs, to, path)
    got = token_store.read_store(spark, to).orderBy("start").collect()
    ids = [None if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len(ids) == docs.count()
    texts, at = {i: t or "" for i, t, _ in sample_texts()}, 0
    for r in got:
        want = [*known.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (at, len(want), want)
        at += len(want)
    chunks = spark.read.parquet(f"{to}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    assert spark.read.parquet(f"{to}/manifest").agg(F.sum("n_tokens")).first()[0] == at
    bad = str(tmp_path / "bad")
    for part in ("recipes", "manifest"):
        spark.read.parquet(f"{to}/{part}").write.parquet(f"{bad}/{part}")
    chunks.withColumn("data", F.lit(token_store.pack(b"\1\0\0\0"))).write.parquet(f"{bad}/chunks")
    with pytest.raises(Exception, match="missing or damaged"):
        token_store.read_store(spark, bad).count()
    token_store.write_store(nothing, str(tmp_path / "none"), path)
    assert token_store.read_store(spark, str(tmp_path / "none")).count() == 0


def test_token_store_is_held_to_its_manifest(spark, docs, tmp_path):
    to = str(tmp_path / "store")
    token_store.write_store(docs, to, P.path("word_bpe_49k.json"))
    recipes, parts = spark.read.parquet(f"{to}/recipes"), spark.read.parquet(f"{to}/manifest")
    assert token_store.read_store(spark, to).count() == recipes.count() and parts.count() > 1
    at = recipes.orderBy("start").collect()[20]
    one, last = F.col("start") == at.start, parts.agg(F.max("part")).first()[0]
    bad = {
        "row": (recipes.where(~one), parts), "part": (recipes.where(F.col("part") != last), parts), "manifest": (recipes, parts.where(F.col("part") != last)),
        "both": (recipes.where(F.col("part") != at.part), parts.where(F.col("part") != at.part)), "none": (recipes, parts.where("false")),
        "doc_id": (recipes.withColumn("doc_id", F.when(one, 10**6).otherwise(F.col("doc_id"))), parts),
        "start": (recipes.withColumn("start", F.when(one, F.col("start") + 1).otherwise(F.col("start"))), parts),
        "twice": (recipes.unionByName(recipes.where(one)), parts),
    }
    for name, (some, held) in bad.items():
        copy = str(tmp_path / name)
        some.write.parquet(f"{copy}/recipes")
        held.write.parquet(f"{copy}/manifest")
        spark.read.parquet(f"{to}/chunks").write.parquet(f"{copy}/chunks")
        with pytest.raises(ValueError, match="don't match the manifest"):
            token_store.read_store(spark, copy)


def test_token_store_joins_chunks_where_they_lie(spark, docs, tmp_path, monkeypatch):
    to = str(tmp_path / "store")
    token_store.write_store(docs, to, P.path("word_bpe_49k.json"))
    want = sorted(map(tuple, token_store.read_store(spark, to).collect()), key=lambda r: r[1])
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = token_store.read_store(spark, to)._jdf.queryExecution().executedPlan().toString()
        data = next(x for x in plan.splitlines() if "FileScan" in x and "data#" in x)
        assert "Bucketed: true" in data and "Bucketed: false" not in data
        for hot in (3, 10**6):  # chunks used more often are dealt to several tasks
            monkeypatch.setattr(token_store, "HOT_USES", hot)
            assert sorted(map(tuple, token_store.read_store(spark, to).collect()), key=lambda r: r[1]) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(("draft_", "chunks_"))]


def test_token_store_tells_added_tokens_by_case():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    known, encode = Tokenizer.from_file(path), token_store.WordEncoder(path)
    for content in (a.content for a in known.get_added_tokens_decoder().values()):
        for mark in (content, content.upper(), content.title(), content.swapcase(), content[:4] + content[4:].upper()):
            for t in (mark, f"x {mark} y", f"Foo{mark}Bar é", f"{mark}\n{content} É {mark},", f"<|{mark}"):
                assert np.frombuffer(encode([t, "X Y", t])[2], "<u4").tolist() == known.encode(t, add_special_tokens=False).ids, t


def test_word_encoder_over_batches():
    from tokenizers import Tokenizer

    path, rng = P.path("word_bpe_49k.json"), random.Random(12)
    known, encode, lame = Tokenizer.from_file(path), token_store.WordEncoder(path), token_store.WordEncoder(path)
    lame.ends[:] = False  # ends of words that don't add up: the whole tokenizer steps in
    odd = ["", " ", "x.", "x..", "it's", "don't,", "é!", "naïve?", "été..", "3rd", "a1b2", "&&&", "a\tb", "\x00", "\xa0b", "ß;", "日本。", "e\u0301", "Σας", "İ.", "<|x|>", "a,b", "!", "."]
    for _ in range(30):
        texts = [rng.choice([" ", "\n"]).join(rng.choices([*odd, *("".join(rng.choices("aeinostr", k=rng.randint(1, 4))) + rng.choice(["", ".", ","]) for _ in range(20))], k=rng.randint(0, 30))) for _ in range(20)]
        want = [known.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == want
        assert [np.frombuffer(x, "<u4").tolist() for x in lame(texts)] == want
    encode.forget()
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == want


def test_word_encoder_keeps_no_object_for_each_word():
    """Objects for each word cost the time of op9: words lie all over memory and every look at one waits for it."""
    import tracemalloc

    rng, encode = random.Random(13), token_store.WordEncoder(P.path("word_bpe_49k.json"))
    words = list({"".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=8)) for _ in range(30_000)})
    texts = [" ".join(words[a : a + 300]) for a in range(0, len(words), 300)]
    encode(["a b"])
    tracemalloc.start()
    try:
        encode(texts)
        assert tracemalloc.get_traced_memory()[0] < 64 * len(words)
    finally:
        tracemalloc.stop()


def test_word_encoder_asks_for_each_word_once(spark, docs, tmp_path):
    path = P.path("word_bpe_49k.json")
    encode, asked = token_store.WordEncoder(path), []

    class Counted:
        def __init__(self, of):
            self.of = of

        def encode_batch_fast(self, texts, **more):
            asked.extend(w for t in texts for w in t.split())
            return self.of.encode_batch_fast(texts, **more)

        def __getattr__(self, name):
            return getattr(self.of, name)

    encode.model, encode.tokenizer = Counted(encode.model), Counted(encode.tokenizer)
    encode(["thatoun ofing schübch"])
    first = len(asked)
    encode(["thatoun. Thatoun, ofing! OFING? schübch; schübch: thatoun", "ofing,"])
    assert first == 3 and len(asked) == first
    # tasks that come after others of their run find its words, those of another run none
    to = str(tmp_path / "store")
    token_store.write_store(docs, to, path)
    for run in (to, "another"):
        count = lambda it, run=run: (pa.RecordBatch.from_pydict({"n": [len(token_store.encoder(path, run).words)]}) for _ in it)
        assert (spark.range(0, 8, 1, 8).mapInArrow(count, "n long").agg(F.max("n")).first()[0] > 0) == (run == to)


def test_word_encoder_on_marks_keys_and_dropped_words(monkeypatch):
    from tokenizers import Tokenizer

    path, rng = P.path("word_bpe_49k.json"), random.Random(14)
    known = Tokenizer.from_file(path)
    marked = [f"{a}{chr(c)}{m}{b}" for c in [*range(33, 0x180), 0x387, 0x3B1, 0x3002, 0x20AC] for m in ".;!" for a, b in (("", ""), ("a", ""), ("é", " "), ("'", ""), ("3", "'s."))]
    words = ["".join(rng.choices("abé÷'.,", k=rng.randint(0, 12))) for _ in range(400)]
    words += [a + "x" * k + b for k in (7, 8, 9, 31, 32, 33, 40, 41, 300) for a in "ab" for b in ("", "c", ".", "c." * 5)]
    texts = [*marked, *(" ".join(rng.choices(words, k=40)) for _ in range(60))]
    want = [known.encode(t, add_special_tokens=False).ids for t in texts]
    same_key = lambda words: np.full(len(words), 5, np.uint64)
    for kept, keys in ((token_store.KEPT_WORDS, token_store.word_keys), (50, token_store.word_keys), (0, token_store.word_keys), (token_store.KEPT_WORDS, same_key), (50, same_key)):
        monkeypatch.setattr(token_store, "KEPT_WORDS", kept)
        monkeypatch.setattr(token_store, "word_keys", keys)
        encode = token_store.WordEncoder(path)
        for _ in range(2):
            for a in range(0, len(texts), 37):
                got = encode(texts[a : a + 37])
                assert [np.frombuffer(x, "<u4").tolist() for x in got] == want[a : a + 37]


def test_chunks_are_cut_by_their_ids_alone():
    rng = np.random.default_rng(15)
    one, other = rng.integers(0, 49_408, 60_000).astype("<u4"), rng.integers(0, 49_408, 700).astype("<u4")
    pieces = lambda ids: [x.tobytes() for x in np.split(ids, token_store.cut_points(len(ids), token_store.cuts_in(ids).tolist())[:-1])]
    alone, moved = pieces(one), pieces(np.concatenate([other, one]))
    assert b"".join(alone) == one.tobytes() and all(token_store.LEAST <= len(x) // 4 <= token_store.MOST for x in alone[:-1])
    assert 500 < len(one) / len(alone) < 2000 and len(set(alone) & set(moved)) > 0.8 * len(alone)
    # the cuts of a document among others are its own
    cuts = token_store.cuts_in(np.concatenate([other, one]))
    assert (cuts[cuts >= len(other) + token_store.WINDOW] - len(other)).tolist() == token_store.cuts_in(one).tolist()
    same = np.full(30_000, 7, "<u4")
    assert sum(map(len, pieces(same))) == 120_000 and max(map(len, pieces(same))) <= 4 * token_store.MOST
    for n in (0, 1, token_store.WINDOW - 1, token_store.WINDOW):
        assert len(token_store.cuts_in(one[:n])) <= (n == token_store.WINDOW)


def test_ngram_join(spark, nothing):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    rows, base = [], []
    for k in range(80):
        if k % 4 == 0:
            base = rng.choices(words, k=rng.randint(3, 120))
        t = list(base)
        for _ in range(rng.randint(0, 2) * (k % 4)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((k, " ".join(t), "en"))
    rows += [(100, None, None), (101, "", None), (102, " \n", None), (103, "a b", None), (104, "a  b", None), (7, rows[7][1], "en"), (None, rows[8][1], "en"), (105, "Ünï " * 5000, "de")]
    sets = []
    for _, t, _ in rows:
        w = (t or "").split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links, near = [0] * len(rows), [{k} for k in range(len(rows))]
    for a in range(len(rows)):
        for b in range(len(rows)):
            if a != b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                near[a].add(b)
    changed = True
    while changed:
        changed = False
        for k in range(len(rows)):
            more = set().union(*(near[j] for j in near[k]))
            changed |= more != near[k]
            near[k] = more
    low = lambda k: min(((rows[j][0] is not None, rows[j][0] or 0) for j in near[k]))
    want = sorted(((i is not None, i or 0, links[k], low(k)[1] if low(k)[0] else None) for k, (i, *_) in enumerate(rows)), key=str)
    df = make(spark, rows)
    for tile in (1024, 4):
        assert by_id(ngram_join.join(df, tile=tile), "n_links", "class_id") == want
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert kept.count() == len({frozenset(g) if sets[k] else (rows[k][0], rows[k][1]) for k, g in enumerate(near)})
    assert ngram_join.join(nothing).count() == 0 and ngram_join.keep_one(nothing).count() == 0


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.95):
        bands, rows = ngram_join.choose_bands(threshold, 0.999, 64)
        assert bands * rows <= 64
        assert rows == 1 or 1 - (1 - threshold**rows) ** bands >= 0.999
