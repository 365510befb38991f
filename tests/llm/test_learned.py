"""Language, toxicity, language-model scores, page text and the pipeline."""

import collections
import json
import math
import random
import re
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gaugeline.llm import class_lm, html_tree, language, packing, queries, toxicity
from gaugeline.llm.class_lm import train_and_score

sys.path.insert(0, str(Path(__file__).parent))

from brute import brute_components, brute_hits  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, score string, n_tokens int"
TEST_DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sentences(seed, n):
    rng = random.Random(seed)
    parts = {"aa": "ba lo mi ta ren".split(), "zz": "zög xü kwe pft schr".split()}
    return [(k, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(2, 40))), lang, "clash", 3)
            for k in range(n) for lang in [rng.choice(("aa", "zz"))]]


def test_language_gradients():
    model = language.ByteTagger(["a", "b", "c"], hidden=4, embedding=3)
    for p in model.parameters():
        p[...] = np.random.default_rng(p.size).normal(0, 0.5, p.shape)
    runs, labels = np.array([[97, 98, 120, 99], [100, 97, 97, 200]]), np.array([0, 2])

    def loss():
        p = model.probabilities(runs)
        return -np.log(p[:, np.arange(2), labels]).mean()

    for p, grad in zip(model.parameters(), model.gradients(runs, labels)):
        at = np.unravel_index(np.abs(grad).argmax(), p.shape)
        old = p[at]
        p[at] = old + 1e-2
        high = loss()
        p[at] = old - 1e-2
        low = loss()
        p[at] = old
        assert abs((high - low) / 2e-2 - grad[at]) < 2e-3 + 0.05 * abs(grad[at])


def test_language_windows_equal_a_plain_forward_pass(monkeypatch):
    monkeypatch.setattr(language, "CORE", 20)
    monkeypatch.setattr(language, "CONTEXT", 7)
    monkeypatch.setattr(language, "CELLS", 1 << 11)
    model = language.ByteTagger(["a", "b", "c"], hidden=4, embedding=3)
    for p in model.parameters():
        p[...] = np.random.default_rng(p.size).normal(0, 0.5, p.shape)
    texts = ["", "a", "kurz!", "z" * 20, "Grüße, 12 Wörter — und mehr. " * 9, "日本語の文章です。" * 12, " \t", "x" * 41]
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    data = language.FOLD[np.frombuffer(b"".join(raw), np.uint8)]
    starts, ends, text = language.windows_of(data, at, 20)
    # Windows cover every byte once and begin with characters.
    assert sorted(b for s, e in zip(starts, ends) for b in range(s, e)) == list(range(len(data)))
    assert all(data[s] & 0xC0 != 0x80 for s in starts) and (ends - starts).max() <= 23

    def sigmoid(x):
        return 1 / (1 + np.exp(-x))

    def read(d, codes):
        n, h, states = len(d.h), np.zeros(len(d.h)), []
        for b in codes:
            x, u = model.embedding[b] @ d.x + d.b, h @ d.h
            z, r = sigmoid(x[:n] + u[:n]), sigmoid(x[n : 2 * n] + u[n : 2 * n])
            c = np.tanh(x[2 * n :] + r * u[2 * n :])
            h = z * h + (1 - z) * c
            states.append(h)
        return states

    sums, votes = np.zeros((len(raw), 3)), np.zeros((len(raw), 3))
    for s, e, t in zip(starts, ends, text):
        first, last = max(s - 7, at[t]), min(e + 7, at[t + 1])
        ahead, behind = read(model.forward, data[first:last]), read(model.backward, data[first:last][::-1])[::-1]
        for k in range(s, e):
            if language.LETTERS[data[k]]:
                logits = np.concatenate([ahead[k - first], behind[k - first]]) @ model.out + model.bias
                p = np.exp(logits) / np.exp(logits).sum()
                sums[t] += p
                votes[t, p.argmax()] += 1
    got_sums, got_votes = model.label_windows(data, at)
    assert np.allclose(got_sums, sums, rtol=1e-4, atol=1e-4) and (got_votes == votes).all()
    # The pass that training uses gives the same probabilities.
    p = model.probabilities(np.array([list(data[at[2] : at[2] + 4])]))[:, 0].sum(axis=0)
    assert np.allclose(p, model.label_windows(data[at[2] : at[2] + 4], np.array([0, 4]))[0], atol=1e-4)


def test_language_knows_rare_labels_and_keeps_clashing_columns(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    many = [(k, " ".join(rng.choice(letters) * 3 for _ in range(4)), f"l{k}", "x", 1) for k in range(270)]
    model = language.train(spark.createDataFrame(many, SCHEMA).withColumn("id", F.lit("clash")))
    assert len(model.labels) == 270
    docs = spark.createDataFrame([(1, "lomi tata", "aa", -7.0, "mine"), (2, None, "aa", -7.0, "mine")], "doc_id long, text string, letters string, c1 double, lang_pred string")
    small = language.ByteTagger(["aa", "zz"])
    assert language.identify(docs, small).columns == ["doc_id", "text", "letters", "c1", "lang_pred", "score", "lang_share"]
    kept = language.with_language(docs, small, 0.0).collect()
    assert [tuple(r) for r in kept] == [(1, "lomi tata", "aa", -7.0, "mine")]
    assert toxicity.without_toxic(docs, None).columns == docs.columns


def test_language_is_learnt_and_odd_texts_are_undetermined(spark):
    data = sentences(1, 160)
    odd = [(900, None, "aa", "x", 1), (901, "", "aa", "x", 1), (902, "123 --- !!", None, "x", 1), (903, "zögxü" * 4000, None, "x", 1), (None, "lomi tata", None, "x", 1)]
    docs = spark.createDataFrame(data + odd + data[:3], SCHEMA)
    model = language.train(docs, use=queries.fold("id", 3) != 1)
    got = language.identify(docs, model).collect()
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 900 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.95
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[k]["lang_pred"] for k in (900, 901, 902, 903, None)] == ["und", "und", "und", "zz", "aa"]
    assert len(got) == len(data) + 8 and all(0 <= r["score"] <= 1 for r in got) and got[0]["n_tokens"] == 3


def test_language_without_rows_or_labels(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert language.train(none) is None and language.identify(none, None).count() == 0
    bare = spark.createDataFrame([(1, "some text", None, "x", 1)], SCHEMA)
    assert language.identify(bare, language.train(bare)).first()["lang_pred"] == "und"


def test_toxic_words_and_their_misspellings(spark):
    rng = random.Random(3)
    data, marks = [], []
    for k in range(400):
        words = ["".join(rng.choice("ba lo mi ta ren ko su".split()) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 80))]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(1 + len(words) // 20):
                words.insert(rng.randrange(len(words)), rng.choice(("grimhold", "Zarvex,")))
        data.append((k, " ".join(words), None, "clash", 3))
        marks.append((k, int(toxic), "x"))
    marks += [(None, 1, "x"), (9999, 1, "x"), (0, None, "x")]
    extra = [(800, None, None, "x", 1), (801, "", None, "x", 1), (802, "lomi grimholdd tata balo renko", None, "x", 1), (803, "balo " * 30000 + "zarvex grimhold " + "mita " * 30000, None, "x", 1)]
    docs, labels = spark.createDataFrame(data + extra, SCHEMA), spark.createDataFrame(marks, "doc_id long, toxic int, text string")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.train(docs, labels, use=queries.fold("id", 5) != 0)).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([got[k]["predicted"] == int(k % 4 == 0) for k in held]) >= 0.95
    assert [got[k]["predicted"] for k in (800, 801, 802, 803)] == [0, 0, 1, 1]
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_toxicity_without_labels_or_rows(spark):
    docs, none = spark.createDataFrame([(1, "a b", None, "x", 1)], SCHEMA), spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(docs, none) is None
    assert [r["score"] for r in toxicity.score(docs, None).collect()] == [0.0]
    assert toxicity.score(spark.createDataFrame([], SCHEMA), toxicity.SubwordSoftmax()).count() == 0


def brute_base(data):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) for _, t, *_ in data]
    train = [zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 7 != 2 for r in data]
    count, ends = collections.Counter(w for t, use in zip(texts, train) if use for w in t), sum(train)
    n, v = sum(count.values()) + ends, len(count) + (ends > 0)
    return [(r[0], not use, len(t) + 1, sum(count[w] > 0 for w in t) + (ends > 0), n, sum(math.log10((c + 1) / (n + v + 1)) for c in [*(count[w] for w in t), ends]))
            for r, t, use in zip(data, texts, train)]


def test_lm_counts_and_base_equal_brute_force(spark):
    data = sentences(5, 120) + [(800, None, "aa", "x", 1), (801, "", "aa", "x", 1), (802, " \n ", "aa", "x", 1), (None, "lo Mi", "aa", "x", 1), (803, "rare" * 900 + " lo", "aa", "x", 1)]
    data += data[:4]
    got = train_and_score(spark.createDataFrame(data, SCHEMA).repartition(3), queries.fold("doc_id", 7) != 2).collect()
    rows = sorted(((r["doc_id"], not r["trained"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=str)
    assert rows == sorted(((*x[:5], round(x[5], 6)) for x in brute_base(data)), key=str)
    assert all(r["score"] < 0 and math.isfinite(r["perplexity"]) for r in got)


def test_lm_beats_its_base_on_other_texts(spark):
    got = train_and_score(spark.read.parquet(f"{TEST_DIR}/documents.parquet"), queries.fold("doc_id", 7) != 2).filter("not trained")
    assert got.filter("score > base_score").count() >= 0.8 * got.count() > 0


def test_lm_beats_its_base_on_more_texts(spark):
    got = train_and_score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), queries.fold("doc_id", 7) != 2).filter("not trained")
    assert got.filter("score > base_score").count() >= 0.9 * got.count() > 0


def test_lm_classes_of_words_that_are_not_the_most_frequent(spark):
    # Two families of 1500 words, all of one ending, that take turns.
    rng = random.Random(7)
    data = [(k, " ".join(f"{rng.choice('pq')}{'ab'[i % 2]}{rng.randrange(750)}ing" for i in range(40)), "aa", "x", 1) for k in range(1500)]
    docs = spark.createDataFrame(data, SCHEMA)
    shards = class_lm._shards(docs, F.lit(True), "doc_id", "text")
    model = class_lm.learn(shards.filter("part IS NULL"), class_lm._corpus_counts(shards))
    words = [f"{x}{y}{i}ing".encode() for x in "pq" for y in "ab" for i in range(750)]
    ends = np.cumsum([len(w) for w in words])
    hashes = class_lm.hash_spans(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
    of = model.unit_class[class_lm.units_of(model.core, model.core_unit, hashes, np.zeros(len(words), np.int64))]
    families = np.zeros((2, len(model.class_tokens)), int)
    np.add.at(families, (np.arange(len(words)) // 750 % 2, of), 1)
    assert len(model.core) > 2990 and len(model.class_tokens) == 54
    assert families.max(axis=0).sum() >= 0.99 * len(words)
    got = train_and_score(docs, queries.fold("doc_id", 7) != 2).filter("not trained").agg(F.expr("sum(score) / sum(n_tokens)")).first()[0]
    assert got > -math.log10(1900)


def brute_bigrams(data):
    pairs = collections.Counter()
    for t in data:
        before = None
        for w in [*re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER)), None]:
            pairs[before, w] += 1
            before = w
    return pairs


def test_lm_bigrams_of_split_units_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(("the", "the", f"w{rng.randrange(40)}")) for _ in range(rng.randrange(60))) for _ in range(200)]
    docs = spark.createDataFrame([(k, t, "aa", "x", 1) for k, t in enumerate(texts)], SCHEMA).repartition(5)
    shards = class_lm._shards(docs, F.lit(True), "doc_id", "text")
    want = brute_bigrams(texts)
    words = sorted({w for pair in want for w in pair if w})
    ends = np.cumsum([len(w) for w in words])
    hashes = class_lm.hash_spans(np.frombuffer("".join(words).encode(), np.uint8), ends - [len(w) for w in words], ends)
    core = np.sort(hashes)
    number = {w: int(np.searchsorted(core, h)) for w, h in zip(words, hashes)}
    n = len(core) + class_lm.ENDINGS + 1
    number[None] = n - 1
    tokens = np.zeros(n)
    for (_, w), c in want.items():
        tokens[number[w]] += c
    spread = class_lm.unit_spread(tokens, 1 << class_lm.range_bits(spark))
    assert spread[number["the"]] > 20 and spread.sum() <= n + 2 * (1 << class_lm.range_bits(spark))
    laid = class_lm._unit_bigrams(shards.filter("part IS NULL"), core, spread)
    got = [collections.Counter(), collections.Counter()]
    ranges = collections.Counter()
    for row in laid.collect():
        for side, (keys, counts) in enumerate((("right", "right_n"), ("left", "left_n"))):
            found = class_lm._unpack(row[keys], True)
            for key, c in zip(found.tolist(), class_lm._unpack(row[counts]).tolist()):
                pair = divmod(key, n)
                got[side][pair if side == 0 else pair[::-1]] += c
            ranges.update(set((found // n).tolist()) if side == 0 else ())
    numbered = {(number[a], number[b]): c for (a, b), c in want.items()}
    assert got[0] == got[1] == numbered
    assert ranges[number["the"]] > 10 and all(ranges[u] <= 1 for u in range(n) if spread[u] == 1)
    # Moves see a split unit whole: the same classes as without splitting.
    of = np.arange(n) % 6
    of[-1] = 6
    table = class_lm._class_table(laid, of, 7)
    whole = class_lm._unit_bigrams(shards.filter("part IS NULL"), core, np.ones(n, np.int32))
    assert (class_lm._class_table(whole, of, 7) == table).all() and table.sum() == sum(want.values())
    for turn in (None, 0, 1):
        start = np.where(np.arange(n) % 3 == 0, -1, of) if turn is None else of
        assert (class_lm._moves(laid, start, table, spread, turn) == class_lm._moves(whole, start, table, np.ones(n, np.int32), turn)).all()


def test_lm_scores_equal_a_plain_sum(spark):
    data = sentences(9, 90) + [(800, None, "aa", "x", 1), (801, "never seen wörds", "aa", "x", 1), (802, "lo " * 3000, "aa", "x", 1)]
    docs = spark.createDataFrame(data, SCHEMA).repartition(3)
    train = queries.fold("doc_id", 7) != 2
    shards = class_lm._shards(docs, train, "doc_id", "text")
    model = class_lm.learn(shards.filter("part IS NULL"), class_lm._corpus_counts(shards))
    count = collections.Counter()
    for i, t, *_ in data:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update([*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None])

    def unit(word):
        raw = np.frombuffer(word.encode(), np.uint8)
        tail = min(3, len(raw))
        ending = class_lm.mix(class_lm.hash_spans(raw, np.array([len(raw) - tail]), np.array([len(raw)]))) % np.uint64(class_lm.ENDINGS)
        return int(class_lm.units_of(model.core, model.core_unit, class_lm.hash_spans(raw, np.array([0]), np.array([len(raw)])), ending)[0])

    def plain(text):
        total, before = 0.0, model.unit_class[-1]
        for w in [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]:
            c = model.unit_class[-1 if w is None else unit(w)]
            mass = count[w] - model.discount if count[w] else model.discount * model.class_types[c] + 1
            total += model.transition[before, c] + math.log10(mass / (model.class_tokens[c] + 1))
            before = c
        return total

    got = {r["doc_id"]: r["score"] for r in train_and_score(docs, train).collect()}
    assert len(got) == len(data)
    for i, t, *_ in data:
        assert got[i] == pytest.approx(plain(t), rel=1e-9)


def test_lm_without_training_or_rows(spark):
    assert train_and_score(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    row = train_and_score(spark.createDataFrame(sentences(1, 1), SCHEMA), F.lit(False)).first()
    assert row["train_tokens"] == row["n_known"] == 0 and row["base_score"] == 0 and row["score"] < 0


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><header><h1>Site name</h1></header>
<div id='sidebar'><p>Side words</p></div><article><h1>Title</h1><p>One &amp; <b>two</b>&#33;<p>Three\n  four<br>five<div class='ad'>Buy this now</div><script>var x='<p>no</p>';</script>
<form><p>Sign up</p><input></form></article><section class='comments'><div class='comment'><p>First comment here</p></div></section><footer>&copy; us</footer>"""


@pytest.fixture(scope="module")
def page_model():
    return html_tree.train()


def test_page_text(spark):
    rows = [(1, "u", PAGE, 5), (2, "u", None, 5), (3, "u", "", 5), (4, "u", "just words", 5), (5, "u", "<p", 5), (1, "u", PAGE, 5), (None, None, "<!-- <p>x -->", 5), (6, "u", "<article>" + "<p>long text</p>" * 3000, 5), (7, "u", "<div>" * 3000 + "x", 5)]
    got = html_tree.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    want = "Title\nOne & two!\nThree four five"
    texts = [(r["page_id"], r["text"]) for r in got]
    assert texts[:6] == [(1, want), (2, ""), (3, ""), (4, "just words"), (5, "<p"), (1, want)] and texts[6] == (None, "")
    assert texts[7][1] == "\n".join(["long text"] * 3000) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_tree.extract_text(spark.createDataFrame([], "html string, text string")).count() == 0


@pytest.mark.parametrize(("inside", "want"), [
    ("<p>Area <math><mi>a</mi><mo>=</mo><mn>2</mn></math> holds</p>", "Area a=2 holds"),
    ("<p>See <object data=x>a fallback</object> here</p>", "See a fallback here"),
    ("<noscript><p>Without script</p></noscript>", "Without script"),
    ("<p>See <iframe src=x>the frame text</iframe> here</p>", "See the frame text here"),
    ("<p>As <svg><title>A chart</title><text>of steps</text></svg> shows</p>", "As A chartof steps shows"),
    ("<xmp>if a <b> c &amp; d</xmp>", "if a <b> c &amp; d"),
    ("<p>One <svg width='4'/> two <math/> three</p>", "One two three"),
    ("<p>One <svg><title/><style/><path d='x'/></svg> two</p>", "One two"),
    *((f"<p>One <{tag}> two</p>", "One two") for tag in ("svg", "math", "object", "noscript", "iframe")),
    ("<p>One</p><xmp>two", "One\ntwo"),
])
def test_page_text_of_embedded_elements(page_model, inside, want):
    closed = not inside.endswith("two")
    rest = "</article><footer>us</footer>" if closed else ""
    after = "<p>The last words</p>" if closed else ""
    page = f"<body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>First words</p>{inside}{after}{rest}"
    assert page_model.main_texts([page]) == ["\n".join(["Title", "First words", want, *(["The last words"] if closed else [])])]


def test_marginals_equal_enumeration():
    forest = html_tree.Forest([html_tree.parse("<div><p>a<b>c</b></p><ul><li>x</ul></div>"), html_tree.parse("")])
    rng = np.random.default_rng(0)
    unary, pair = rng.normal(0, 1, (len(forest.tags), 2)), rng.normal(0, 1, (3, 2, 2))
    p, _ = html_tree.marginals(forest, unary, pair)
    n, total = len(forest.tags), np.zeros((len(forest.tags), 2))
    for code in range(1 << n):
        s = [(code >> k) & 1 for k in range(n)]
        weight = math.exp(sum(unary[k, s[k]] for k in range(n)) + sum(pair[forest.kind[k], s[forest.parent[k]], s[k]] for k in range(n) if forest.parent[k] >= 0))
        for k in range(n):
            total[k, s[k]] += weight
    assert np.allclose(p, total / total.sum(axis=1, keepdims=True))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_their_sql(spark, name):
    got = queries.QUERIES[name](spark, TEST_DIR).toPandas()
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{TEST_DIR}/{table}.parquet')")
    want = con.execute(queries.ORACLE[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    as_rows = [sorted(json.dumps([str(v) for v in r]) for r in f[columns].itertuples(index=False)) for f in (got, want)]
    assert as_rows[0] == as_rows[1]


def test_pipeline_stages(spark):
    documents = spark.read.parquet(f"{TEST_DIR}/documents.parquet")
    columns, docs, kept = documents.columns, documents, [{r["doc_id"] for r in documents.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, TEST_DIR), name)
        assert docs.columns == columns
        kept.append({r["doc_id"] for r in docs.collect()})
        assert kept[-1] <= kept[-2] and len(kept[-1]) > 0.6 * len(kept[-2])
    # Copies and contamination are decided as the queries' brute force decides them.
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{TEST_DIR}/benchmark.parquet").collect()]
    roots = brute_components([(i, texts[i]) for i in kept[2]])
    assert kept[3] == {i for i in kept[2] if roots[i][1] == i}
    assert kept[4] == {i for i in kept[3] if not brute_hits(texts[i], items)[4]}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, TEST_DIR).collect()
    assert {r["doc_id"] for r in packed} == kept[4]
    assert sorted(tuple(r)[:5] for r in packed) == sorted(tuple(r)[:5] for r in packing.pack_documents(docs, queries.public_tokenizers.path("word_bpe_49k.json")).collect())


def test_pipeline_of_nothing(spark):
    none = spark.read.parquet(f"{TEST_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, TEST_DIR).count() == 0
