"""Operators on the documents' texts against brute force, odd rows included."""

import math
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
import xxhash

from tallyworks.llm import lm, packing, passages, privacy, quality, secrets, simhash


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize(("op", "patterns", "kinds"), [(privacy, brute.PRIVATE, privacy.KINDS), (secrets, brute.SECRET, secrets.KINDS[:3])])
def test_base_spans(docs, texts, empty, op, patterns, kinds):
    run = op.personal_data if op is privacy else op.secrets
    rows = op.digest(run(docs)).collect()
    assert len(rows) == len(texts) + 3
    for r in rows:
        expected = brute.spans(texts.get(r.doc_id), patterns)
        assert r.base_sha256 == brute.sha(expected)
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[0] == k for s in expected) for k in kinds]
        assert set(filter(None, brute.written(expected).split(","))) <= set(r.spans.split(","))
    assert op.digest(run(empty)).collect() == []


def test_contexts_find_unseen_identifiers(spark):
    seeds = [(i, f"please call him at +1 (555) 200-10{i:02d} today") for i in range(12)]
    rows = [*seeds, (50, "please call him at 555.0199.22 today"), (51, "the order number was 555.0199.23 today")]
    found = {r.doc_id: r for r in privacy.digest(privacy.personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert found[50].spans == "phone:19:30" and found[50].n_phone == 0
    assert found[51].spans == ""


def test_random_tokens_are_secrets_and_names_are_not(spark):
    import random

    rng = random.Random(1)
    token = lambda: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=40))
    rows = [(i, f"see {token()} here") for i in range(20)] + [(100 + i, f"see internationalization_committee_report_20{10 + i} here") for i in range(20)]
    found = {r.doc_id: r.spans for r in secrets.digest(secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert sum(found[i] == "random:4:44" for i in range(20)) >= 17
    assert not any(found[100 + i] for i in range(20))


def test_masking_keeps_rows_and_columns(docs, texts):
    out = secrets.masked(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    rows = by_id(out)
    assert "abcdefghijkl1234" not in rows[70].text and rows[70].n_chars == len(rows[70].text)
    assert rows[1].text == texts[1] and rows[80].text is None and rows[80].n_chars is None


def test_quality(docs, texts, empty):
    rows = quality.assess(docs).collect()
    assert len(rows) == len(texts) + 3
    for r in rows:
        expected = brute.quality(texts.get(r.doc_id))
        assert {k: r[k] for k in expected} == expected, r.doc_id
        assert r.kept is (not r.base_failed)
    assert quality.assess(empty).collect() == []


def test_quality_rejects_what_is_unlike_its_language(spark, texts):
    rows = [(i, t, "en") for i, t in texts.items() if len(t) > 300]
    rows.append((900, " ".join(w + "$$$" for w in texts[6].split()), "en"))
    kept = {r.doc_id: r.kept for r in quality.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not kept[900] and kept[6] and kept[68]


def test_simhash_groups(docs, texts, empty):
    def fingerprint(t):
        w = t.encode().lower().split()
        if not w:
            return 0
        hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), seed=42) for i in range(max(1, len(w) - 3))]
        return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64))

    f = {i: fingerprint(t or "") for i, t in {**texts, 80: None}.items()}
    parent = {i: i for i in f}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i in f:
        for j in f:
            if i < j and (f[i] ^ f[j]).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(texts) + 3
    assert all((r.fingerprint, r.component_id) == (f"{f[r.doc_id]:016x}", root(r.doc_id)) for r in rows)
    assert simhash.near_duplicates(empty).collect() == []


def test_large_shards_are_dealt_in_blocks(spark):
    rng = np.random.default_rng(0)
    base = np.uint64(0x0123456789ABCDEF)
    x = np.unique(np.array([base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 3).astype(np.uint64)) for _ in range(300)], np.uint64))
    table = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    few, many = ({(r.a, r.b) for r in simhash.links(table, 4, most).collect()} for most in (40, 20_000))

    def groups(edges):
        index = {int(v): i for i, v in enumerate(x.view(np.int64))}
        a, b = (np.array([index[e[k]] for e in edges], np.int64) for k in (0, 1))
        return simhash.stars(a, b, len(x)).tolist()

    assert groups(few) == groups(many)


def test_vantage_point_trees_miss_no_pair():
    x = np.random.default_rng(3).integers(0, 1 << 20, 900).astype(np.uint64)
    a, b = simhash.near_pairs(x, 2)
    i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 2, 1))
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == set(zip(i.tolist(), j.tolist(), strict=True))


def test_packing_round_trip(docs, texts, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    pieces = packing.pack(docs, packing.tokenizer_path()).collect()
    places, whole = defaultdict(list), defaultdict(list)
    for p in pieces:
        places[p.sequence_id].append((p.offset, p.length))
        whole[p.doc_id].append((p.start, p.ids, p.doc_tokens))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    for doc, parts in whole.items():
        ids = [*t.encode(texts.get(doc, ""), add_special_tokens=False).ids, 0]
        copies = 3 if doc == 1 else 1
        joined = sorted(parts, key=lambda x: x[0])[::copies]
        assert np.frombuffer(b"".join(bytes(x[1]) for x in joined), "<u4").tolist() == ids and parts[0][2] == len(ids)
    assert {p.doc_id for p in pieces} == {*texts, 80}
    d = packing.digest(packing.pack(docs, packing.tokenizer_path())).where("doc_id = 66").first()
    assert d.ids_crc32 == zlib.crc32(np.array([*t.encode("one").ids, 0], "<u4").tobytes())
    assert packing.pack(empty, packing.tokenizer_path()).collect() == []


def test_best_fit_is_best_fit_decreasing():
    lengths = np.random.default_rng(1).integers(1, 65, 400)
    bins, offsets, n = packing.best_fit(lengths, 64)
    room, expected = [], np.zeros(len(lengths), int)
    for i in np.argsort(-lengths, kind="stable"):
        fit = [(r, k) for k, r in enumerate(room) if r >= lengths[i]]
        if not fit:
            room.append(64)
            fit = [(64, len(room) - 1)]
        tight = min(r for r, _ in fit)
        expected[i] = tight
        room[next(k for r, k in fit if r == tight)] -= lengths[i]
    assert n == len(room) and (64 - offsets == expected).all()


def test_ids_are_the_plain_calls():
    import random

    from tokenizers import Tokenizer

    rng = random.Random(3)
    t = Tokenizer.from_file(packing.tokenizer_path())
    alphabet = "abc XYZ 0123 \n\t\r\u00a0\u2003 '!?.,;<|>é漢字ñ\u0301😀\x00"
    texts = ["", " ", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x <|endoftext|>", "it's we'll  I'D   \n\n done  ", "<|endof text|>", *("".join(rng.choices(alphabet, k=rng.randrange(80))) for _ in range(400))]
    texts += [f"{a}  <|endoftext|>{b}" for a, b in zip(texts[-20:], texts[-40:-20], strict=True)]
    assert packing.encoder(packing.tokenizer_path())(texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert packing.encoder(packing.tokenizer_path())(["a <|endoftext|> b"]) == [[64, 220, 50256, 275]]


def test_language_model(docs, texts, empty):
    words = {i: [*(t or "").encode().lower().split(), b""] for i, t in {**texts, 80: None}.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in words}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    c.update(words[1] * 2 if not held[1] else [])
    total, distinct = sum(c.values()), len(c)
    rows = lm.lm_scores(docs).collect()
    assert len(rows) == len(texts) + 3
    for r in rows:
        ws = words[r.doc_id]
        base = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), total)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9) and r.score < 0
    unseen = [r for r in rows if r.held_out and r.n_tokens > 20]
    assert unseen and sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    assert lm.lm_scores(empty).collect() == []


def test_factors_are_distributions():
    for f in (0, 1):
        p = np.exp(lm.logs(np.random.default_rng(f).normal(size=(lm.FEATURES, lm.OUTCOMES[f])), f))
        assert p.shape == (lm.CONTEXTS[f], lm.OUTCOMES[f]) and np.allclose(p.sum(1), 1)


def test_contexts_are_the_two_words_before():
    texts = [[b"alpha", b"beta", b"gamma", b""], [b""], [b"beta", b""]]
    keys = np.array([lm.key_of(w) for t in texts for w in t])
    first, k, context, slot = lm.contexts_of(keys, np.array([0, 4, 5]))
    at = 0
    for t in texts:
        for i, w in enumerate(t):
            one, two = (lm.key_of(t[i - d] if i >= d else lm.END) for d in (1, 2))
            x, y, c = one >> 8, two >> 20, lm.class_of(w)
            assert (k[at], slot[at]) == (c, lm.key_of(w) % lm.SLOTS)
            assert first[at] == x % lm.BEFORE[0] * lm.SKIPPED[0] + y % lm.SKIPPED[0]
            assert context[at] == (c * lm.BEFORE[1] + x % lm.BEFORE[1]) * lm.SKIPPED[1] + y % lm.SKIPPED[1]
            at += 1


def test_training_follows_the_gradient(spark):
    """What always follows a context becomes likely after it, in both factors."""
    rows = [(f, c, [90 if o == (c + f) % n else 1 for o in range(n)]) for f, n in enumerate(lm.OUTCOMES) for c in range(0, 40, 3)]
    weights = lm.train(spark.createDataFrame(rows, "factor int, context int, n array<long>"))
    for f, c, n in rows:
        assert int(lm.logs(weights[f], f)[c].argmax()) == int(np.argmax(n))


def test_repeated_passages(docs, texts, empty):
    rows = passages.repeated_passages(docs).collect()
    grams = defaultdict(set)
    for i, t in texts.items():
        w = t.lower().split()
        for k in range(len(w) - 49):
            grams[tuple(w[k : k + 50])].add(i)
    shared = {i for s in grams.values() if len(s) > 1 for i in s}
    found = {r.doc_id for r in rows} | {r.rep_id for r in rows}
    assert shared == found == {3, 17, 31, 5, 61, 62, 6, 63}
    r = next(r for r in rows if r.doc_id == 17)
    assert r.rep_id in (3, 31) and (r.start, r.length) == (10, 70) and r.similarity == 1
    pairs = {(r.doc_id, r.start, r.length, r.rep_id, r.rep_start, r.rep_length) for r in rows}
    assert all((e, f, g, a, b, c) in pairs for a, b, c, e, f, g in pairs if texts[a] != texts[e])
    assert passages.repeated_passages(empty).collect() == []


def test_compact_windows_stand_for_every_subsequence():
    h = np.random.default_rng(2).integers(0, 12, 60).astype(np.uint64)
    w = passages.compact_windows(h, 5)
    for i in range(60):
        for j in range(i + 4, 60):
            c = i + int(h[i : j + 1].argmin())
            assert any(l <= i and j <= r and m == c for l, m, r in w.tolist())
