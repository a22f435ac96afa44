"""Toxicity, decontamination, pages and the pipeline."""

import random
import time

import corpus_pipeline
import numpy as np
import pytest
from brute import prose

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyworks.llm import contamination, html, simhash, toxicity


def test_toxicity_learns_marked_words(spark, rng, empty):
    bad = ["zorkish", "blimfot", "grunkel", "zorkling"]
    rows, labels = [], []
    for i in range(600):
        w = prose(rng, 80).split()
        toxic = i % 5 == 0
        if toxic:
            w[rng.randrange(80)] = rng.choice(bad)
            w[rng.randrange(80)] = rng.choice(bad)
        rows.append((i, " ".join(w), "extra"))
        if i % 2 == 0 or toxic:
            labels.append((i, int(toxic)))
    rows += [(1000, None, "x"), (1001, "", "x"), (0, rows[0][1], "again"), (None, "no id", "x")]
    labels += [(5000, 1), (None, 1), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.toxicity(docs, table).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 600]
    hits = [r for r in held if r.doc_id % 5 == 0]
    assert sum(r.predicted for r in hits) >= 0.9 * len(hits) and sum(r.predicted for r in held) <= 1.1 * len(hits)
    assert toxicity.toxicity(empty, table).collect() == []
    assert {r.predicted for r in toxicity.toxicity(docs, table.where("1 = 0")).collect()} == {0}


def test_benchmark_items_and_paraphrases_are_found(spark, docs, texts, rng, empty):
    items = [(i, prose(rng, n)) for i, n in enumerate((16, 30, 45, 60, 150))] + [(90, None), (91, ""), (92, "Which word is it? " + prose(rng, 12))]
    changed = items[2][1].split()
    for k in range(4, 45, 6):
        changed[k] = "other"
    leaks = {200: items[0][1], 201: items[1][1].upper(), 202: " ".join(changed), 203: items[4][1], 204: items[7][1]}
    rows = [(i, texts[9] + ". " + t + "\n" + texts[10], "z") for i, t in leaks.items()]
    more = docs.select("doc_id", "text", "base").unionByName(spark.createDataFrame(rows, "doc_id long, text string, base string"))
    found = contamination.contaminated(more, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(200, 0), (201, 1), (202, 2), (203, 4), (204, 92)}
    assert contamination.contaminated(empty, spark.createDataFrame(items, "item_id long, text string")).collect() == []
    assert contamination.contaminated(more, spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_thousands_of_items_are_found_as_by_brute_force(spark):
    r = random.Random(8)
    # words as frequent as in real texts: rank by rank rarer
    known = ["".join(r.choices("abcdefghijklmnop", k=r.randint(3, 8))) for _ in range(3000)]
    text = lambda n: r.choices(known, [1 / (5 + i) for i in range(3000)], k=n)
    items = [text(r.randint(15, 59)) for _ in range(2000)]
    hosts = [text(300) for _ in range(250)]
    planted = set()
    for k, item in enumerate(items):
        w = list(item)
        for j in r.sample(range(len(w)), len(w) // 5 if k % 2 else 0):
            w[j] = "".join(r.choices("abcdefgh", k=9))
        d = k % len(hosts)
        hosts[d] += [*w, *text(40)]
        planted.add((d, k))
    expected = set()
    sets = [set(w) for w in items]
    for d, host in enumerate(hosts):
        there = set(host)
        for k, item in enumerate(items):
            # as many of its words at least as a common subsequence would have
            if len(sets[k] & there) >= 0.3 * len(sets[k]) and sum(w in there for w in item) >= 0.6 * len(item):
                if contamination.subsequence(item, host) >= 0.6 * len(item):
                    expected.add((d, k))
    assert planted <= expected
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(hosts)], "doc_id long, text string")
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    found = {(x.doc_id, x.item_id) for x in contamination.contaminated(docs, table).collect()}
    assert found <= expected and len(planted - found) <= 0.02 * len(planted), len(planted - found)


def test_common_subsequence_against_tables():
    r = random.Random(4)
    for _ in range(50):
        a, b = ([r.choice([b"a", b"b", b"c", b"d"]) for _ in range(r.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert contamination.subsequence(a, b) == t[-1][-1]


PAGE = "<!DOCTYPE html><html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a href=/x>Menu</a></nav>{}<footer>&copy; foot</footer></body></html>"


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<div class='ad'>Buy</div><article><h1>Head</h1><p>One &amp;  two<br><p>Three <b>four</article>", "Head\nOne & two\nThree four"),
        ("<main><aside>side</aside><p>a\n b</p><ul><li>c<li>d</ul><form>f<input></form></main>", "a b\nc\nd"),
        ("<article><p>x</p><section class='comments'><p>first!</p></section></article>", "x"),
        ("<div id=cookie-notice>ok?</div><div class=content><p>long enough text here for it</p><p>and more of the text</p></div><div class=sidebar>links</div>", "long enough text here for it\nand more of the text"),
        ("<article></article>", ""),
    ],
)
def test_pages(spark, body, text):
    page = PAGE.format(body)
    rows = [(i, f"https://h{len(body)}.example.com/{i}", page, "x") for i in range(3)] + [(9, None, None, "x")]
    out = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert out[0].text == out[2].text == text and out[0].n_chars == len(text)
    assert out[9].text == "" and out[9].n_chars == 0


def test_wrappers_collapse_repeats_and_find_optional_parts():
    page = lambda n, extra: html.tree(html.blocks(f"<body><div>{'<h2>a</h2><p>b</p>' * n}</div>{extra}</body>"))
    w = html.infer(iter([page(2, ""), page(5, "<hr><section>new</section>"), page(3, "")]))
    body = w.kids[0]
    assert [k.label for k in body.kids] == ["div", "section"] and [k.label for k in body.kids[0].kids] == ["h2", "p"]
    assert all(k.rep for k in body.kids[0].kids) and body.kids[1].n == 1 and body.kids[0].n == 3


@pytest.mark.parametrize("tag", ["button", "select", "object", "svg", "canvas", "map", "video", "audio"])
def test_an_element_without_its_end_tag_hides_no_text(tag):
    texts = lambda page: [t for _, t, _ in html.blocks(page)]
    assert texts(f"<body><p>one</p><{tag} class=x><p>two</p></body>") == ["one", "two"]
    assert texts(f"<body><p>one</p><{tag}>gone</{tag}><p>two</p><script>three") == ["one", "two"]


def test_deep_long_and_malformed_pages(spark):
    inner = "".join(f"<p>para {i}</p><h2>h {i}</h2>" for i in range(3000))
    pages = {
        "deep": "<div>" * 10_000 + "deep text" + "</div>" * 10_000,
        "long": f"<body><article>{inner}</article></body>",
        "unlike": "<body>" + "".join(f"<div class='{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100 % 6]}'>t{i}</div>" for i in range(3000)) + "</body>",
        "items": "<ul>" + "<li>x<div>" * 3000,
        "ends": "</div>" * 5000 + "<p>x</p>" + "<button>" * 3000,
    }
    rows = [(f"{k}{i}", f"https://{k}.example/{i}", v) for k, v in pages.items() for i in range(2)]
    out = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert out["deep0"] == "deep text" and out["ends1"] == "x"
    assert out["long0"].split("\n") == [x for i in range(3000) for x in (f"para {i}", f"h {i}")]
    assert out["unlike1"].split("\n") == [f"t{i}" for i in range(3000)]
    assert out["items0"] == "\n".join("x" * 3000)


def test_readers_comments_are_not_the_article(spark):
    page = PAGE.format("<article><h1>Head</h1><p>One two</p><article class='comment-body'><p>I disagree</p></article></article><article class='comment'><p>Me too</p></article>")
    out = html.extract(spark.createDataFrame([(i, "https://c.example/", page) for i in range(3)], "page_id long, url string, html string")).collect()
    assert {r.text for r in out} == {"Head\nOne two"}


def test_alignment_matches_a_common_subsequence():
    rng = np.random.default_rng(4)
    for n, m, kinds in ((6, 6, 2), (40, 30, 4), (400, 300, 5)):
        a, b = ([str(x) for x in rng.integers(0, kinds, k)] for k in (n, m))
        pairs = html._matches(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:], strict=False))
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n):
            for j in range(m):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert len(pairs) == best[n][m] if n * m <= html.CELLS else len(pairs) > best[n][m] / 4


def test_pages_of_an_empty_table(spark):
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_pipeline(spark, docs, texts, tmp_path):
    data = f"file://{tmp_path}"
    item = " ".join(texts[20].split()[:40]) if len(texts[20].split()) >= 40 else texts[68][:300]
    docs.write.parquet(f"{data}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{data}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{data}/labels.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    table = spark.read.parquet(f"{data}/documents.parquet")
    assert corpus_pipeline.reject_toxic(spark, table, data).count() == table.count()
    once = corpus_pipeline.drop_near_copies(spark, table, data)
    ids = [r.doc_id for r in once.collect()]
    assert once.columns == table.columns and len(ids) == len(set(ids)) and 5 in ids and not {61, 62} & set(ids) and ids.count(1) == 1
    clean = corpus_pipeline.decontaminate(spark, table, data)
    assert clean.columns == table.columns and {r.doc_id for r in table.select("doc_id").collect()} - {r.doc_id for r in clean.select("doc_id").collect()} == ({20} if len(texts[20].split()) >= 40 else {68})
    packed = corpus_pipeline.run(spark, data)
    assert {r.doc_id for r in packed.select("doc_id").collect()} <= set(ids)


def test_near_copies_are_dropped_by_row(spark):
    r = random.Random(12)
    a, b, c = (prose(r, n) for n in (120, 120, 600))
    near = next(t for w in [c.split()] for k in range(600) if 0 < (simhash.simhash((t := " ".join([*w[:k], "other", *w[k + 1 :]])).encode()) ^ simhash.simhash(c.encode())).bit_count() <= 4)
    rows = [(2, b), (5, a), (5, b), (7, c), (7, near), (None, a), (9, a), (None, prose(r, 90))]
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    got = sorted(map(tuple, out.collect()), key=str)
    assert len(got) == 4 and {(2, b), (5, a), rows[-1]} <= set(got) and [i for i, _ in got].count(7) == 1


def test_every_passage_counts_in_the_space(spark):
    texts = [f"w{i} w{i % 7} both w{i * i % 11}" for i in range(300)] + [" ".join(f"l{j}" for j in range(200)), "", None, "both both"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["row"]: r["v"] for r in contamination.counted(docs).collect()}
    df = np.frombuffer(rows.pop(-1), "<i8")
    at = lambda w: contamination.Hasher()[w]
    assert df[-1] == len(texts) and df[at(b"both")] == 301 and df[at(b"l199")] >= 1
    # of each word of its own one passage has it, so one row of the sketch, under a sign
    sketch = np.stack([np.frombuffer(v, "<f4") for v in rows.values()])
    words = {w for t in texts if t for w in t.encode().split()}
    alone = [w for w in words if sum(at(x) == at(w) for x in words) == 1 and sum(w in (t or "").encode().split() for t in texts) == 1]
    assert len(alone) > 200 and all(np.abs(sketch[:, at(w)]).sum() in (1, 2) for w in alone)
    # products of words are in the mean those of the passages: 301 of them have the word, one twice
    assert 150 < (sketch[:, at(b"both")] ** 2).sum() < 600


def test_toxicity_learns_from_every_label(spark):
    docs = spark.range(16_000).select(F.col("id").alias("doc_id"), F.pmod(F.xxhash64("id"), F.lit(100)).alias("r"), F.row_number().over(Window.orderBy(F.xxhash64("id"))).alias("n")).where("r < 95")
    toxic = F.col("r") < 40
    # toxic texts have one word, but the last ones in hash order another
    text = F.when(~toxic, F.concat(F.lit("plain words "), F.col("doc_id").cast("string"))).when(F.col("n") > 12_500, "some zorblax here").otherwise("some quexity here")
    table = docs.select("doc_id", text.alias("text"), toxic.cast("int").alias("toxic")).localCheckpoint()
    model = toxicity.learn(table, table)
    assert model.score("zorblax") > toxicity.TOXIC and model.score("quexity") > toxicity.TOXIC and model.score("plain words") < toxicity.TOXIC


def test_words_and_dimensions_of_a_batch_are_those_of_each_text():
    r = random.Random(6)
    letters = ["a", "B", "7", "é", "漢", "𝒳", " ", "  ", "\n", "\t", "-", ".", "_", "\x00", "\x1f", "\x7f", "\x85", "\u3000"]
    texts = ["".join(r.choices(letters, k=r.randint(0, 200))) for _ in range(300)]
    # none, blank ones, words as long as are handled together, and longer ones, also beyond a lot of words
    texts += ["", " ", "\n\n", *("x" * n for n in (63, 64, 65, 1000)), "a " + "é" * 40 + " b", "w1 w2 " * 30_000, "", "end"]
    texts = [t.encode() for t in texts]
    plain, hashed = [contamination.tokens(t) for t in texts], contamination.Hasher()
    folded, starts, ends, lengths = contamination.words_of(texts)
    assert lengths.tolist() == [len(w) for w in plain]
    assert [folded[s:e] for s, e in zip(starts, ends, strict=True)] == [w for t in plain for w in t]
    assert contamination.dimensions(folded, starts, ends).tolist() == [hashed[w] for t in plain for w in t]
    for few in ([], [b""], [b"", b" . "]):
        *words, lengths = contamination.words_of(few)
        assert len(contamination.dimensions(*words)) == 0 and lengths.tolist() == [0] * len(few)


def test_dimensions_of_words_not_seen_before_are_found_together():
    texts = [" ".join(f"{i * 7919 + j * 104_729:x}" for j in range(500)).encode() for i in range(200)]

    def seconds(work):
        t = time.process_time()
        work()
        return time.process_time() - t

    plain = min(seconds(lambda: list(map(contamination.Hasher(), map(contamination.tokens, texts)))) for _ in range(3))
    assert min(seconds(lambda: contamination.dimensions(*contamination.words_of(texts)[:3])) for _ in range(3)) < plain / 2


def test_windows_near_an_item_are_those_found_one_by_one():
    r = random.Random(9)
    known = [b"w%d" % i for i in range(300)]
    text = lambda n: r.choices(known, [1 / (3 + i) for i in range(300)], k=n)
    items = [(k, b" ".join(text(n)).decode()) for k, n in enumerate((12, 20, 24, 30, 48, 60, 150))]
    space = np.random.default_rng(1).normal(size=(contamination.DIMENSIONS, 8)).astype(np.float32)
    index = contamination.Index(items, space)
    index.__setstate__(index.__dict__)
    texts = [text(n) for n in (0, 5, 31, 32, 33, 200, 0, 1000)]
    texts += [text(40) + index.words[k] + text(50) for k in range(7)]
    hashed = contamination.Hasher()
    expected, maybe = set(), set()
    for d, words in enumerate(texts):
        for low, (longest, window, stride) in zip((0, 24, 48), contamination.SCALES, strict=True):
            for s in range(0, max(1, -(-(len(words) - window) // stride) * stride + 1) if words else 0, stride):
                there = words[s : s + window]
                v = space[hashed(there)].sum(0)
                for k, w in enumerate(index.words):
                    q = [space[hashed(p)].sum(0) for p in contamination.parts(w) if low < len(p) <= longest]
                    best = max((v @ x / np.linalg.norm(v) / np.linalg.norm(x) for x in q), default=-1)
                    if best >= contamination.COSINE - 1e-4:
                        maybe.add((d, k, s, s + len(there)))
                        # which words are in the item, not how often
                        if best >= contamination.COSINE + 1e-4 and sum(x in w for x in there) >= index.least[k]:
                            expected.add((d, k, s, s + len(there)))
    found = set(index.search(np.array([len(t) for t in texts]), hashed([w for t in texts for w in t])))
    assert expected <= found <= maybe and {(8 + k, k) for k in range(7)} <= {(d, k) for d, k, _, _ in found}
    # a block may have no item, or none with words
    for few in ([], [(1, ".")]):
        none = contamination.Index(few, space)
        none.__setstate__(none.__dict__)
        assert none.search(np.array([2, 0]), hashed([b"a", b"b"])) == []
