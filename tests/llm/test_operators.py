"""The corpus operators against brute force, exact round trips and held-out labels."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quantloom.llm import chat_format, collocations, components, cotraining, difference_cover, knn, line_dedup, mixing, oracles, packing, queries, quality, recompression, simhash, url_filter, vector_codes
from quantloom.llm import kernels as K

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TOKENS = queries.tokenizer_path("word_bpe_49k.json")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


def odd(spark):
    """Nulls everywhere, empty and blank texts, repeated rows, one very long text, clashing names."""
    rows = [(1, None, "a"), (2, "", None), (3, " \n\t", "b"), (4, "one two", "a"), (4, "one two", "a"), (None, "one two three", None), (None, None, None), (5, "word " * 30_000, "b"), (6, "x" * 5000, "b"), (6, "other text", "b")]
    clash = ("size", "key", "part", "kept", "h", "n_words", "host", "fp", "score", "ids", "start")
    return docs_of(spark, rows).withColumns({c: F.lit(1) for c in clash})


def plain(v):
    return None if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA), con.sql(oracles.ORACLES[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    a = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    b = sorted(tuple(plain(r[want.columns.index(c)]) for c in order) for r in want.fetchall())
    assert sorted(a, key=str) == sorted(b, key=str)


# 1


def test_cascade_is_exact():
    rng = np.random.default_rng(1)
    for n, m in ((0, 50), (50, 0), (1, 5000), (3000, 3000), (5000, 10)):
        h = rng.integers(0, 2**63, (2, n + m)).astype(np.uint64)
        listed = np.arange(n + m) < n
        levels = url_filter.build_levels(h[0], h[1], listed)
        assert (url_filter.in_levels(levels, h[0], h[1]) == listed).all()


def test_urls(spark, monkeypatch):
    urls = ["http://A.Example.net/en/1", "http://example.net", "x", None, "://", "http://z.org/fr/1", "http://z.org/de/?q", "ftp://bad.com#/", "http://bad.com/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit("h"), "rule": F.lit(1)})
    listed = spark.createDataFrame([("bad.com",), (None,), ("bad.com",)], "host string")
    want = {0: ("a.example.net", "/en/1", "example.net/en/", "allow"), 1: ("example.net", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("z.org", "/fr/1", "org/fr/", "allow"), 6: ("z.org", "/de/", None, "allow"), 7: ("bad.com", "", None, "block"), 8: ("bad.com", "/", None, "block")}
    for limit in (url_filter.MAX_BROADCAST, 0):  # 0: the way beyond the broadcast
        monkeypatch.setattr(url_filter, "MAX_BROADCAST", limit)
        got = url_filter.judge_urls(pages, listed, queries.URL_RULES).collect()
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == want
        assert url_filter.judge_urls(pages.union(pages), listed, queries.URL_RULES).count() == 2 * len(want)
        assert url_filter.judge_urls(pages.limit(0), listed.limit(0), queries.URL_RULES).count() == 0


def test_streamed_levels_agree_with_the_list(spark, monkeypatch):
    """Many shards and few places, a hot host, and no broadcast."""
    monkeypatch.setattr(url_filter, "MAX_BROADCAST", 0)
    monkeypatch.setattr(url_filter, "SHARD_KEYS", 50)
    monkeypatch.setattr(url_filter, "SPREAD", 3)
    hosts = [f"h{k % 700}.org" if k % 3 else "hot.com" for k in range(6000)] + [None]
    rows = spark.createDataFrame([(k, h) for k, h in enumerate(hosts)], "page_id long, key string")
    listed = spark.createDataFrame([(f"h{k}.org",) for k in range(0, 900, 7)] + [("hot.com",)], "host string")
    names = {r.host for r in listed.collect()}
    found = url_filter.Cascade.build(rows.select("key").distinct(), listed).mark(rows, "key", "listed").collect()
    assert sorted((r.page_id, r.listed) for r in found) == [(k, h in names) for k, h in enumerate(hosts)]


def test_rules_by_force():
    x = random.Random(4)
    label = lambda: x.choice(["a", "bb", "c"])
    rules = [(".".join(label() for _ in range(x.randrange(1, 4))) + "/" + "".join(x.choice("xy/") for _ in range(x.randrange(4))), x.choice(["block", "allow"])) for _ in range(3000)]
    table = url_filter.Rules(rules)
    for _ in range(500):
        host, path = ".".join(label() for _ in range(x.randrange(1, 5))), "/" * x.randrange(2) + "".join(x.choice("xy/") for _ in range(x.randrange(5)))
        fits = [(t, v) for t, v in rules if (host == t.partition("/")[0] or host.endswith("." + t.partition("/")[0])) and path.startswith("/" + t.partition("/")[2])]
        longest = max((len(t) for t, _ in fits), default=0)
        got = table.match(table.hosts(host), path)
        assert got == next(((t, v) for t, v in fits if len(t) == longest), (None, None)) or (len(got[0]) == longest and got in fits)


# 2


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>|[]/\\sINT ok</s>é\n", max_size=40), st.text(alphabet="us|>\\<er", max_size=8))
def test_escape_round_trip(text, role):
    hidden = chat_format.escape(text)
    assert chat_format.unescape(hidden) == text
    for control in ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]"):
        assert control not in hidden
    assert chat_format.read_piece(f"[INST]<|{chat_format.escape(role)}|>{hidden}[/INST]") == (role, text)


def test_parts(spark):
    part = lambda kind, **k: {"kind": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | k
    parts = [part("text", text="see <|image|>"), part("image", ref="a.png", width=56, height=29), None, part("audio", ref="b.wav", seconds=1.5), part("document", ref="c.pdf", pages=2), part(None, text="end")]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, None, None)], f"conv_id long, turn long, role string, parts {chat_format.PARTS}")
    r, empty = chat_format.format_turns(turns, queries.tokenizer_path("byte_bpe_50k.json")).orderBy("turn").collect()
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "a.png", 4), ("audio", "b.wav", 38), ("document", "c.pdf", 1152)]
    assert all(r.piece[a.at :].startswith(f"<|{a.kind}|>") for a in r.attachments) and r.n_tokens > 1194
    assert chat_format.read_piece(r.piece)[0] == "user" and empty.piece == "[INST]<||>[/INST]"
    with pytest.raises(Exception, match="video"):
        chat_format.format_turns(spark.createDataFrame([(1, 0, "user", [part("video")])], turns.schema)).collect()
    assert chat_format.digests(chat_format.read_turns(chat_format.format_turns(turns.limit(0)))).count() == 0


# 3


def repeats_by_force(rows, window):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_recompression(spark, seed):
    """Few different words and long runs, so that windows differ in their ends only."""
    x = random.Random(seed)
    passages = [[x.choice("aab") * x.choice((1, 1, 2)) if x.random() < 0.7 else str(x.randrange(9)) for _ in range(x.randrange(10, 40))] for _ in range(12)] + [["run"] * 40, ["p", "q"] * 20]
    rows = []
    for i in range(150):
        words = [w for _ in range(x.randrange(4)) for w in ([str(x.randrange(99))] * x.randrange(4) + x.choice(passages)[x.randrange(4) : x.choice((13, 14, 20, None))])]
        rows.append((i, x.choice((" ", "\n", "\t ")).join(words)))
    got = recompression.remove_repeats(docs_of(spark, [(i, t, "s") for i, t in rows])).collect()
    assert sorted(tuple(r) for r in got) == repeats_by_force(rows, 13)


def test_recompression_keeps_columns_and_odd_rows(spark):
    got = recompression.remove_repeats(odd(spark), keep=True)
    assert got.columns == [*odd(spark).columns, "repeats"] and got.count() == 10
    assert {(r.doc_id, r.repeats.n_words, r.repeats.n_removed) for r in got.collect()} >= {(4, 2, 0), (5, 30_000, 0), (None, 3, 0), (1, 0, 0)}
    assert Counter(map(str, got.drop("repeats").collect())) == Counter(map(str, odd(spark).collect()))
    with pytest.raises(ValueError, match="repeats"):
        recompression.remove_repeats(odd(spark).withColumn("Repeats", F.lit(1)), keep=True)
    texts = [(2, "a " * 20), (2, "a " * 20), (2, "b " * 20), (7, "b " * 20), (None, "a " * 20)]
    again = sorted((r.doc_id or 99, r.n_removed) for r in recompression.remove_repeats(docs_of(spark, [(i, t, "s") for i, t in texts])).collect())
    assert again == [(2, 0), (2, 0), (2, 0), (7, 20), (99, 20)]
    assert recompression.remove_repeats(odd(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        recompression.remove_repeats(odd(spark), window=12)


# 4


def test_mix(spark):
    found = mixing.mix(odd(spark)).collect()
    assert len(found) == 10 and all(0 <= r.taken <= 2 * r.size for r in found)
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in found:
        by[r.source][0] += r.size
        by[r.source][1] += r.taken
        by[r.source][2] = r.target
    for size, taken, target in by.values():
        assert abs(taken - target) <= 1 and target <= 2 * size
    assert sum(t for _, _, t in by.values()) == pytest.approx(1.5 * sum(s for s, _, _ in by.values()))
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix(odd(spark).repartition(5)).collect()))
    assert mixing.mix(odd(spark).limit(0)).count() == 0
    texts = mixing.mixed_documents(odd(spark))
    words = texts.select(F.sum(mixing.n_words(F.col("text")))).first()[0]
    assert words == sum(r.taken for r in found) and texts.columns == odd(spark).columns


def test_mixed_documents_are_what_the_mix_takes(spark):
    """One text under two sources, rows without ids, and rows that agree in all, with cut and repeated ones."""
    rows = [(1, "a b c d e f g", "big"), (1, "a b c d e f g", "small")] + [(None, f"w{i} x y z", "big") for i in range(20)] + [(2, "one two three", "big")] * 7 + [(None, "same same", None)] * 5 + [(3, None, "big"), (4, "", None)]
    docs = docs_of(spark, rows).repartition(3)
    for share in (0.3, 0.75, 1.5):
        found = mixing.mix(docs, share=share).collect()
        assert len(found) == len(rows)
        takes = Counter((r.doc_id, r.text_hash, r.source, r.taken) for r in found if r.taken)
        made = mixing.mixed_documents(docs, share=share).withColumn("n", mixing.n_words(F.col("text"))).collect()
        words = lambda rows, n: {s: sum(n(r) for r in rows if r.source == s) for s in ("big", "small", None)}
        assert words(made, lambda r: r.n) == words(found, lambda r: r.taken)
        by_id = Counter()
        for (i, _, source, taken), n in takes.items():
            by_id[i, source] += taken * n
        for r in made:
            by_id[r.doc_id, r.source] -= r.n
        assert not any(by_id.values())
        alone = [r.taken for r in found if r.doc_id is None and r.source == "big"]
        assert share > 0.5 or 0 < sum(t > 0 for t in alone) < 20  # not all or none


# 5


def test_top_k(spark, monkeypatch):
    x = random.Random(3)
    vecs = [(i, [x.choice((-0.5, 0.0, 0.25, 1e-3)) for _ in range(6)]) for i in range(400)] + [(400, None), (450, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (500, [float("nan")] * 6), (550, [float("inf")] * 6), (None, [1.0] * 6), (600, [1.0, 2.0]), (650, [3.0, 1.0])]
    rows = spark.createDataFrame(vecs, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in knn.top_k(rows, rows.where("vec_id % 50 = 0")).collect()}
    q = {i: [math.floor(256 * float(np.float32(c))) for c in v] for i, v in vecs if i is not None and v is not None and None not in v and all(map(math.isfinite, v))}
    want = {}
    for i, a in q.items():
        if i % 50 == 0:
            best = sorted((-sum(p * s for p, s in zip(a, b, strict=True)), j) for j, b in q.items() if j != i and len(a) == len(b))[:5]
            want |= {(i, n): (j, -s) for n, (s, j) in enumerate(best, 1)}
    assert got == want
    assert knn.top_k(rows.limit(0), rows.limit(0)).count() == 0
    for name, size in (("SHARD_ROWS", 30), ("GROUP_SHARDS", 3), ("BLOCK_QUERIES", 2), ("LEAF", 4)):  # many trees, groups and blocks
        monkeypatch.setattr(knn, name, size)
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in knn.top_k(rows, rows.where("vec_id % 50 = 0")).collect()} == want


def test_trees_prune_and_stay_exact():
    rng = np.random.default_rng(2)
    points = rng.integers(-50, 50, (3000, 3)) + rng.integers(0, 3, 3000)[:, None] * 400
    ids = rng.permutation(3000)
    search = knn.Search(np.array([-1, -2]), np.array([[1.0, 2, -1], [-3, 0, 1]]), 4, np.full(2, knn.LEAST))
    offered = []
    plain_offer = search._offer
    search._offer = lambda rows, i, p: (offered.append(len(rows) * len(i)), plain_offer(rows, i, p))
    opened = []
    plain_bound = search._bound
    search._bound = lambda rows, low, high: (opened.append(len(rows) * len(low)), plain_bound(rows, low, high))[1]
    search.add(*knn.build_tree(ids, points.astype(float)))
    assert sum(opened) < 60  # of 2 times 63 nodes
    for k, q in enumerate(search.q):
        s = (points @ q).astype(int)
        want = sorted(zip((-s).tolist(), ids.tolist(), strict=True))[:4]
        assert list(zip((-search.score[k]).tolist(), search.near[k].tolist(), strict=True)) == want
    assert sum(offered) < 3000


# 6


def test_quality_by_hand():
    sentence = "This is a plain sentence of nine words here. "
    good = "\n".join(sentence + str(i) + "." for i in range(9))
    n, chars, symbols, dup, rep, failed, kept, cleaned = quality.judge_text(good, quality.LineRules())
    words = good.split()
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    flags = [False] * len(words)
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            flags[i : i + 3] = [True] * 3
    assert (n, chars, symbols, dup, rep) == (len(words), sum(map(len, words)), 0, 0, sum(flags)) and failed
    clean = " ".join(f"word{i} goes over hill{i} number{i}." for i in range(20))
    assert quality.judge_text(clean, quality.LineRules())[6]
    menu = "home | news | shop | help | more | cart\n" * 1 + clean
    assert quality.judge_text(menu, quality.LineRules())[6:] == (True, clean)
    junk = "\n".join(" ".join(f"w{i}{j}$$$" for j in range(12)) for i in range(9))
    assert not quality.judge_text(junk, quality.LineRules())[6]
    assert quality.judge_text("a b\na b\na b", quality.LineRules())[3] == 2
    assert quality.judge_text("  é", quality.LineRules())[:2] == (2, 2)


def test_quality_odd_rows(spark):
    found = quality.judge_documents(odd(spark)).collect()
    assert len(found) == 10 and not any(r.kept for r in found)
    assert quality.clean_documents(odd(spark)).columns == odd(spark).columns and quality.judge_documents(odd(spark).limit(0)).count() == 0


def test_rules_agree_with_labels(spark):
    docs, labels = (queries.table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    met = quality.judge_documents(docs).join(labels, "doc_id")
    assert met.where("quality = 1 AND NOT kept AND NOT base_failed").count() == 0 and met.where("quality = 0 AND kept").count() <= 2


# 7


def test_classifier_on_unseen_labels(spark):
    docs, labels = (queries.table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    rows = cotraining.features(docs).cache()
    model = cotraining.fit(rows, train)
    found = cotraining.score(rows, model).join(test, "doc_id")
    right = found.where("kept = (quality = 1)").count()
    assert right >= 0.95 * found.count()
    assert {learner for _, learner, _, n in model.exchanged if n} == {0, 1}
    alone = cotraining.score(rows, cotraining.fit(rows, train, rounds=0)).join(test, "doc_id")
    assert right >= alone.where("kept = (quality = 1)").count()  # rounds do no harm
    assert found.where("(meta_score >= 0.5) = (quality = 1)").count() >= 0.93 * found.count() and model.mix[1] > 0.1  # nor is the page's view idle
    clash = odd(spark).withColumns({c: F.lit(1) for c in ("label", "_rank", "name", "content", "metadata", "quality")})
    odd_scores = cotraining.score(cotraining.features(clash), model).collect()
    assert len(odd_scores) == 10 and all(0 <= r.score <= 1 for r in odd_scores)
    none = cotraining.fit(cotraining.features(odd(spark)), labels.limit(0))
    assert {r.score for r in cotraining.score(cotraining.features(odd(spark)), none).collect()} == {0.5}
    assert cotraining.classified(odd(spark).limit(0), labels.limit(0)).count() == 0
    mixed = spark.createDataFrame([(1, 0), (1, 1), (2, 7), (None, 1), (77, 0)], "doc_id long, quality int")
    assert cotraining.classified(odd(spark), mixed).count() == 10


def two_views(n, seed):
    """Labels, and views that each tell them with noise of their own."""
    x = np.random.default_rng(seed)
    y = (np.arange(n) % 2).astype(float)
    content, metadata = (x.normal(size=(n, w)).astype(np.float32) for w in (cotraining.CONTENT, cotraining.METADATA))
    content[:, :12] += 2.2 * (2 * y - 1)[:, None] / 12**0.5
    metadata[:, :12] += 2.2 * (2 * y - 1)[:, None] / 12**0.5
    return content, metadata, y


def test_surest_rows_by_force(spark):
    content, metadata, _ = two_views(300, 1)
    names = np.arange(300) % 270  # some rows twice
    content[270:], metadata[270:] = content[:30], metadata[:30]
    rows = spark.createDataFrame([(int(n), bytearray(c.tobytes()), bytearray(m.tobytes())) for n, c, m in zip(names, content, metadata, strict=True)], "name long, content binary, metadata binary").repartition(7)
    c, m, y = two_views(60, 2)
    model = cotraining.Model(cotraining.View().fit(c, y), cotraining.View().fit(m, y), np.zeros(3))
    wishes, taken = [(0, 1.0, 9), (0, 0.0, 4), (1, 1.0, 3), (1, 0.0, 300)], [{1, 2, 3}, set(range(0, 300, 2))]
    for (k, label, n), found in zip(wishes, cotraining.surest_rows(rows, model, wishes, taken), strict=True):
        odds = model.views(content.astype(float), metadata.astype(float))[k]
        surety = np.round(cotraining._sigmoid(odds if label else -odds), 9)
        want = sorted({(-s, i) for s, i in zip(surety.tolist(), names.tolist(), strict=True) if i not in taken[1 - k]})[:n]
        assert found[0].tolist() == [i for _, i in want] and found[1].shape[0] == found[2].shape[0] == len(want)


def test_the_whole_query_by_force(spark):
    """All rows on one table: the surest by sorting them all, the same rounds, the same scores."""
    docs, labels = (queries.table(spark, DATA, t) for t in ("documents", "labels"))
    rows = cotraining.features(docs).withColumn("h", F.xxhash64("doc_id")).join(labels.select("doc_id", "quality"), "doc_id", "left").collect()
    content, metadata = (np.array([np.frombuffer(r[c], np.float32) for r in rows]).astype(float) for c in ("content", "metadata"))
    marked = sorted((k for k, r in enumerate(rows) if r.quality is not None), key=lambda k: (rows[k].h, rows[k].doc_id))
    rest = [k for k, r in enumerate(rows) if r.quality is None]

    def surest(model, wishes, taken):
        out = []
        for k, label, n in wishes:
            odds = model.views(content[rest], metadata[rest])[k]
            surety = np.round(cotraining._sigmoid(odds if label else -odds), 9)
            best = {}
            for s, i in sorted(zip((-surety).tolist(), rest, strict=True), key=lambda t: (t[0], rows[t[1]].name)):
                if rows[i].name not in taken[1 - k]:
                    best.setdefault(rows[i].name, i)
            pick = list(best.values())[:n]
            out.append((np.array([rows[i].name for i in pick], np.int64), content[pick], metadata[pick]))
        return out

    model = cotraining.co_train(content[marked], metadata[marked], np.array([rows[k].quality for k in marked]), surest)
    want = {r.doc_id: s for r, s in zip(rows, model.scores(content, metadata)[2].tolist(), strict=True)}
    got = {r.doc_id: r.score for r in queries.op7_co_training(spark, DATA).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)


def test_rounds_that_harm_are_dropped():
    """Confident nonsense from one view: the other one forgets it; a view that tells nothing labels nothing."""
    content, metadata, y = two_views(600, 9)
    asked = []

    def lies(model, wishes, taken):
        asked.append({k for k, *_ in wishes})
        wrong = np.arange(300, 600)
        out = []
        for k, label, n in wishes:
            odds = model.views(content, metadata)[k][wrong]
            best = wrong[np.argsort(-odds if label else odds)[:n]]
            other = (metadata if k == 0 else content).copy()
            other[best] = other[best][:, ::-1] - 4 * (2 * label - 1)  # what the learner sees of them points the other way
            rows = (content, other) if k == 0 else (other, metadata)
            out.append((best, rows[0][best], rows[1][best]))
        return out

    before = cotraining.co_train(content[:300], metadata[:300], y[:300], lies, rounds=0)
    after = cotraining.co_train(content[:300], metadata[:300], y[:300], lies, rounds=3, sure=0.6)
    loss = lambda m: cotraining._loss(np.clip(np.stack([*m.views(content[:300][4::5], metadata[:300][4::5]), np.ones(60)], 1), -10, 10) @ m.mix, y[:300][4::5])
    assert asked and loss(after) <= loss(before) + 1e-12
    noise = np.random.default_rng(4).normal(size=metadata.shape)
    asked.clear()
    cotraining.co_train(content[:300], noise[:300], y[:300], lies, rounds=1)
    assert asked == [{0}]


def test_layout_by_hand():
    text = "a\n\na\nhttp://x\n" + "w" * 40
    data, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text), len(text)])
    one, none = cotraining.layout_features(data, offsets)
    assert one[0] == pytest.approx((1 / 5) ** 0.5) and one[1] == pytest.approx((1 / 5) ** 0.5) and one[2] == pytest.approx((3 / 5) ** 0.5) and one[5] == pytest.approx((30 / len(text)) ** 0.5)
    assert none.tolist() == [0, 1, 0, 0, 0, 0] and cotraining.layout_features(data[:0], np.zeros(1, np.int64)).shape == (0, 6)


def test_pseudo_labels_cross_between_views_and_help():
    content, metadata, y = two_views(4000, 3)
    few = np.arange(100)

    def surest(model, wishes, taken):
        out = []
        for k, label, n in wishes:
            odds = model.views(content, metadata)[k]
            free = [i for i in range(100, 2000) if i not in taken[1 - k]]
            best = np.array(sorted(free, key=lambda i: -odds[i] if label else odds[i])[:n])
            out.append((best, content[best], metadata[best]))
        return out

    right = {}
    for rounds in (0, 4):
        model = cotraining.co_train(content[few], metadata[few], y[few], surest, rounds=rounds, sure=0.9)
        right[rounds] = [np.mean((odds[2000:] > 0) == (y[2000:] == 1)) for odds in model.views(content, metadata)]
    assert {(learner, label) for _, learner, label, _ in model.exchanged} == {(0, 0.0), (0, 1.0), (1, 0.0), (1, 1.0)}
    assert min(right[4]) > max(right[0]) + 0.01


# 8


def test_xxh64():
    x = random.Random(5)
    texts = [bytes(x.randrange(256) for _ in range(n)) for n in range(100)]
    ends = np.cumsum([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    got = K.xxh64_ranges(data, np.append(0, ends[:-1]), ends)
    assert got.tolist() == [xxhash.xxh64_intdigest(t, seed=42) for t in texts]


def test_simhash_components(spark):
    x = random.Random(7)
    base = [[x.choice("abcdefgh") + str(x.randrange(40)) for _ in range(120)] for _ in range(25)]
    rows = []
    for i in range(150):
        w = list(x.choice(base))
        for _ in range(x.randrange(4)):
            w[x.randrange(len(w))] = "new" + str(x.randrange(9))
        rows.append((i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, "Just Two"), (903, "just two"), (903, "just two")]
    fps = {}
    for i, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))
    least = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 4 and least[b] < least[a]:
                    least[a], changed = least[b], True
    got = simhash.near_duplicates(docs_of(spark, [(i, t, "s") for i, t in rows])).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.fp % 2**64, r.component_id) for r in got} == {(i, fps[i], least[i]) for i, _ in rows}
    assert simhash.near_duplicates(odd(spark).limit(0)).count() == 0 and simhash.near_duplicates(odd(spark)).count() == 10


def components_of(fps, distance):
    """The smallest fingerprint reachable from each, over links of distance bits."""
    parent = np.arange(len(fps))
    for k in range(0, len(fps), 256):
        near = np.bitwise_count(fps[k : k + 256, None] ^ fps[None]) <= distance
        a, b = np.nonzero(near)
        simhash.join_forest(parent, k + a, b)
    return fps[parent]


def alike(rng, n, common, bits):
    """n distinct fingerprints that differ in some of bits alone, many of them in few."""
    varying = rng.choice(64, bits, replace=False)
    some = rng.integers(0, 2, (n, bits), dtype=np.uint64)
    some[: n // 2] = some[rng.integers(0, 8, n // 2)] ^ (rng.random((n // 2, bits)) < 0.1)
    return np.unique((np.uint64(common) & ~np.uint64(sum(1 << int(v) for v in varying))) | (some << varying.astype(np.uint64)).sum(axis=1, dtype=np.uint64))


def test_components_that_fit_a_task_need_no_rounds(spark, monkeypatch):
    """Chains, stars, pairs, loops and repeated edges: the smallest nodes by force, at once, once thinned, and in rounds."""
    rng = np.random.default_rng(3)
    names = np.unique(rng.integers(-(2**62), 2**62, 1200))
    rng.shuffle(names)
    a, b = np.concatenate([np.arange(300), np.full(300, 400), np.arange(800, 1000, 2), [700] * 3]), np.concatenate([np.arange(1, 301), np.arange(401, 701), np.arange(801, 1001, 2), [700, 710, 710]])
    parent = np.arange(len(names))
    order = np.argsort(names)
    rank = np.argsort(order)
    components.join_forest(parent, rank[a], rank[b])
    want = {int(names[i]): int(names[order[parent[rank[i]]]]) for i in set(np.concatenate([a, b]).tolist())}
    rows = list(zip(names[a].tolist(), names[b].tolist(), strict=True))
    edges = spark.createDataFrame(rows, "a long, b long").repartition(8).localCheckpoint()
    dense = spark.createDataFrame(rows * 16, "a long, b long").repartition(8).localCheckpoint()
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for some, most in ((edges, 500_000), (dense, 3000), (edges, 100)):
        monkeypatch.setattr(components, "EDGES_A_TASK", most)
        spark.sparkContext.setJobGroup(f"components {most}", "")
        got = components.connected_components(spark, some, "n")
        jobs.append(len(tracker.getJobIdsForGroup(f"components {most}")))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert {r.n: r.component for r in got.collect()} == want
    assert jobs[0] <= 5 and jobs[1] <= 12 and jobs[2] > 30, jobs
    assert components.connected_components(spark, edges.limit(0), "n").count() == 0


@pytest.mark.parametrize("n, bits", [(3000, 12), (3000, 25), (2500, 43), (2000, 3)])
def test_large_sets_link_as_by_force(n, bits):
    fps = alike(np.random.default_rng(bits), n, 0x5A5A_1234_9876_FFFF, bits)
    a, b, over = simhash._links_in(fps, 4, most=64)
    assert not len(over) and (np.bitwise_count(fps[a] ^ fps[b]) <= 4).all()
    parent = np.arange(len(fps))
    simhash.join_forest(parent, a, b)
    assert (fps[parent] == components_of(fps, 4)).all()


def test_many_alike_fingerprints_take_little_time():
    import time

    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 2**25, 32_500, dtype=np.uint64)) | np.uint64(0xABC << 50)
    began = time.process_time()
    simhash._links_in(fps, 4)
    assert len(fps) > 32_000 and time.process_time() - began < 12  # some 2 s alone


def test_large_keys_are_dealt_anew(spark, monkeypatch):
    """Keys of more than LARGE fingerprints over many tasks: the same components."""
    rng = np.random.default_rng(4)
    fps = np.unique(np.concatenate([alike(rng, 1500, 0x1234_5678_9ABC_DEF0, 25), alike(rng, 900, 0xFFFF_0000_FFFF_0000, 40), rng.integers(0, 2**63, 300).astype(np.uint64)]))
    rows = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(5)
    want = dict(zip(fps.view(np.int64).tolist(), components_of(fps, 4).tolist(), strict=True))
    for large in (50, 4096):
        monkeypatch.setattr(simhash, "LARGE", large)
        links = simhash.fingerprint_links(rows, 4).collect()
        at = {int(f): k for k, f in enumerate(fps.view(np.int64))}
        a, b = (np.array([at[r[c]] for r in links], np.int64) for c in ("a", "b"))
        assert (np.bitwise_count(fps[a] ^ fps[b]) <= 4).all()
        parent = np.arange(len(fps))
        simhash.join_forest(parent, a, b)
        assert dict(zip(fps.view(np.int64).tolist(), fps[parent].tolist(), strict=True)) == want


def test_near_duplicates_of_eight_tenths_and_more(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents").where("doc_id < 400")
    sets = {r.doc_id: frozenset(zip(*[(r.text or "").lower().split()[k:] for k in range(5)], strict=False)) for r in docs.collect()}
    comp = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    like = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] and sets[b] and sets[a] & sets[b]}
    near = [p for p, j in like.items() if j >= 0.9]
    assert near and sum(comp[a] == comp[b] for a, b in near) >= 0.95 * len(near)
    kept = {r.doc_id for r in simhash.keep_one_per_group(docs).select("doc_id").collect()}
    for i in sets:
        if i not in kept and sets[i]:
            assert max(j for p, j in like.items() if i in p) >= 0.6


@pytest.mark.parametrize(("gone", "linked"), [(4, 150), (5, 0)])
def test_pairs_of_eight_tenths_link_and_lower_ones_do_not(spark, gone, linked):
    """150 pairs of 180 shingles each, of which 20 (similarity 0.8) or 25 (0.756) are a text's own."""
    x = random.Random(gone)
    rows = []
    for i in range(150):
        one = [f"w{x.randrange(10**9)}" for _ in range(184)]
        two = [f"v{x.randrange(10**9)}" if k % 12 == 10 and k < 12 * gone else w for k, w in enumerate(one)]
        rows += [(2 * i, " ".join(one), "s"), (2 * i + 1, " ".join(two), "s")]
    comp = {r.doc_id: r.component_id for r in simhash.similar_documents(docs_of(spark, rows)).collect()}
    assert sum(comp[2 * i] == comp[2 * i + 1] for i in range(150)) == linked


def test_deletion_variants_find_what_no_band_holds(spark):
    """Pairs of 9 shingles, 8 of them shared, that have no MinHash key in common and fingerprints 4 bits apart."""
    ends = [
        ("w775253 w78197 w800800 w846098 w524842 w146141 w760240 w623512 w253693 w170116 w297745 w340395", "w355599", "v285390"),
        ("w690330 w20572 w59183 w710956 w257266 w270726 w482181 w581990 w408253 w825246 w384413 w335642", "w678232", "v893894"),
        ("w784533 w966685 w762604 w594531 w779328 w38786 w279957 w36043 w530928 w564712 w951849 w490454", "w748260", "v335198"),
        ("w613577 w994198 w880205 w854839 w928294 w313636 w533005 w938061 w805251 w16364 w16368 w718757", "w51585", "v539634"),
    ]
    texts = [f"{head} {last}" for head, *lasts in ends for last in lasts]
    made = [simhash.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), 5) for t in texts]
    bands = np.concatenate([simhash.band_keys(*x) for x in made])
    assert not (bands[::2] == bands[1::2]).any()
    docs = docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()} == {i: i - i % 2 for i in range(8)}
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect()) == [0, 2, 4, 6]


def test_crowds_keep_components_of_verified_links(spark, monkeypatch):
    """Copies of one template around the threshold, in groups of many blocks, against all pairs by force."""
    monkeypatch.setattr(simhash, "BLOCK", 16, raising=False)
    x = random.Random(3)
    base = [f"w{k}" for k in range(124)]
    rows = [(i, " ".join(f"v{x.randrange(10**9)}" if x.random() < 0.026 else w for w in base), "s") for i in range(150)]
    sets = [frozenset(zip(*[t.split()[k:] for k in range(5)], strict=False)) for _, t, _ in rows]
    least = list(range(len(rows)))
    links = [(a, b) for a in least for b in least[:a] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in least:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert 20 < len(set(least)) < 130
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs_of(spark, rows)).collect()}
    assert got == dict(enumerate(least))


def test_rows_of_one_id_are_kept_by_their_texts(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(None, words(k), "s") for k in range(5)] + [(7, words(k), "s") for k in range(5, 8)] + [(8, words(0), "s"), (9, words(6), "s"), (9, words(9), "s")]
    rows += [(None, words(8), "s")] * 3 + [(None, None, "s"), (3, "", "s"), (3, " ", None)]
    got = Counter((r.doc_id, r.text) for r in simhash.keep_one_per_group(docs_of(spark, rows)).collect())
    want = {(None, words(k)) for k in (1, 2, 3, 4, 8)} | {(7, words(k)) for k in (5, 6, 7)} | {(8, words(0)), (9, words(9))}
    blank = [k for k in got if k[0] == 3]
    assert len(blank) == 1 and got == Counter([*want, *blank])


# 9


@pytest.mark.parametrize("prime", [2, 3, 5, 7, 11])
def test_difference_cover(prime):
    v, d = difference_cover.difference_cover(prime)
    assert len(d) == prime + 1 and {(a - b) % v for a in d.tolist() for b in d.tolist()} == set(range(v))


@pytest.mark.parametrize("length", [40, 200])
def test_repeated_bytes(spark, length):
    x = random.Random(length)
    blocks = ["".join(x.choice("abé ") for _ in range(x.randrange(length // 2, 2 * length))) for _ in range(10)] + ["z" * 3 * length]
    rows = [(i, "".join(str(x.random())[: x.randrange(5)] + x.choice(blocks)[x.randrange(3) :] for _ in range(x.randrange(4)))) for i in range(80)]
    rows += [(80, None), (81, ""), (82, rows[5][1]), (82, rows[5][1]), (83, "q" * (length - 1)), (84, "q" * length)]
    assert_repeats(spark, rows, length)


def assert_repeats(spark, rows, length):
    seen = Counter(t.encode()[k : k + length] for _, t in rows if t for k in range(len(t.encode()) - length + 1))
    want = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        starts, ends = K.runs(gone)
        want.append((i, len(b), int(gone.sum()), list(zip(starts.tolist(), ends.tolist(), strict=True)), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    got = difference_cover.repeated_bytes(docs_of(spark, [(i, t, "s") for i, t in rows]), length)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], r.kept_sha256) for r in got.collect()) == sorted(want)


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


def test_words_that_polynomials_confuse_are_told_apart(spark):
    """Documents alike but for a Thue-Morse string and its complement, as a word and as bytes."""
    one = thue_morse(2048)
    two = one.translate(str.maketrans("ab", "ba"))
    head = " ".join(f"h{k}" for k in range(12))
    found = recompression.remove_repeats(docs_of(spark, [(1, f"{head} {one}", "s"), (2, f"{head} {two}", "s"), (3, f"x {head} {one}", "s")])).collect()
    assert {r.doc_id: r.n_removed for r in found} == {1: 0, 2: 0, 3: 13}
    for n in (128, 256):
        rows = [(1, thue_morse(n)[:200], "s"), (2, thue_morse(n)[:200].translate(str.maketrans("ab", "ba")), "s")]
        assert {r.n_removed for r in difference_cover.repeated_bytes(docs_of(spark, rows), min(n, 200)).collect()} == {0}


def test_window_hashes_by_force():
    x = np.random.default_rng(4)
    data = x.integers(97, 99, 3000).astype(np.uint8)
    for width in (1, 2, 7, 8, 13, 100, 200):
        windows = [data[i : i + width].tobytes() for i in range(len(data) - width + 1)]
        for names in (K.byte_windows(data, width), K.byte_windows(data, width, 1), K.window_hashes(K.byte_codes(data), width)):
            assert len(set(zip(names.tolist(), windows, strict=True))) == len(set(windows)) == len(set(names.tolist()))
        assert len(K.byte_windows(data[: width - 1], width)) == len(K.window_hashes(K.byte_codes(data[: width - 1]), width)) == 0


def test_same_bytes_by_force():
    x = random.Random(6)
    data = np.array([x.choice(b"ab") for _ in range(400)] * 2, np.uint8)
    a = np.array([x.randrange(380) for _ in range(3000)])
    b = np.where(np.arange(3000) % 3 > 0, a + 400, np.roll(a, 1))
    got = difference_cover.same_bytes(data, a, b, 20)
    assert got.tolist() == [bytes(data[i : i + 20]) == bytes(data[j : j + 20]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]


def test_large_parts_go_by_their_windows(spark, monkeypatch):
    """One common string in many documents, between texts of their own and shared ones."""
    monkeypatch.setattr(difference_cover, "PART_WINDOWS", 300)
    x = random.Random(8)
    word = lambda n: "".join(x.choice("abcdefgh ") for _ in range(n))
    common, shared = word(150), [word(60) for _ in range(5)]
    rows = [(i, word(50) + x.choice(shared) + common + x.choice(shared) + word(x.randrange(99))) for i in range(60)]
    assert_repeats(spark, rows, 200)


def test_repeated_bytes_odd_rows(spark):
    found = difference_cover.repeated_bytes(odd(spark)).collect()
    assert len(found) == 10 and {r.n_removed for r in found if r.doc_id == 5} == {150_000}
    assert difference_cover.repeated_bytes(odd(spark).limit(0)).count() == 0


def test_more_rows_of_one_id_than_sixteen_bits_count(spark):
    passage = " ".join(f"p{k}" for k in range(13))
    n = 66_000
    ids = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit(passage + " u"), "id").alias("text"))
    docs = ids.unionByName(spark.createDataFrame([(1, passage)], "doc_id long, text string"))
    found = recompression.remove_repeats(docs).groupBy("doc_id", "n_removed").count().collect()
    assert {tuple(r) for r in found} == {(1, 0, 1), (None, 13, n)}
    same = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit("abcdefghij" * 4).alias("text"))
    found = difference_cover.repeated_bytes(same, 40).groupBy("n_removed").count().collect()
    assert [tuple(r) for r in found] == [(40, n)]


# 10


def test_packing(spark):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(TOKENS)
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents").unionByName(odd(spark).select("doc_id", "text", "lang", "source", "n_chars")).unionByName(docs_of(spark, [(-1, "don't É <|endoftext|> x<|y ﬁn 12ab", "s")]))
    got = packing.pack_documents(docs, TOKENS).collect()
    pieces = defaultdict(list)
    for r in docs.collect():
        ids = [*full.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[s : s + 4096], "<u4").tobytes()
            pieces[r.doc_id].append((k, s, len(part) // 4, zlib.crc32(part)))
    assert {i: sorted(p) for i, p in pieces.items()} == {i: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i) for i in pieces}
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, n in sorted(members):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(bins) <= 1.01 * sum(r.length for r in got) / 4096 + 1
    assert packing.pack_documents(docs.limit(0), TOKENS).count() == 0
    one = packing.sequences(docs, TOKENS).collect()
    assert sum(len(r.ids) for r in one) == 4 * sum(r.length for r in got)
    assert Counter(i for r in one for i in r.doc_ids) == Counter(r.doc_id for r in got)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_tokenizers_own(name):
    """Of both kinds of tokenizers, over texts of everything that parts words."""
    from tokenizers import Tokenizer

    full, x = Tokenizer.from_file(queries.tokenizer_path(name)), random.Random(1)
    bits = [*"ab zÀÉß×÷ÿ'éN<|>.,!-\n\t09٣ïﬁéΣς日本😀\x00\x1f\xa0\u2028İ", "'s", "'re", "<|endoftext|>", "<|EndOfText|>", "don't", "’s", " ", "  ", "e\u0301"]
    texts = ["".join(x.choice(bits) for _ in range(x.randrange(60))) for _ in range(2000)] + ["", "<|", " ", "x" * 50_000]
    ids, first = packing.Ids(queries.tokenizer_path(name)).of(*K.text_buffers(packing.pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [full.encode(t, add_special_tokens=False).ids for t in texts]


def test_equal_rows_are_packed_in_many_groups(spark):
    same = spark.range(900).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text"))
    pieces = packing.token_pieces(same, TOKENS)
    found = packing.pack(pieces, capacity=8, group_pieces=100).collect()
    assert len(found) == 900 and len({r.sequence_id >> 32 for r in found}) == 9
    assert max(Counter(r.sequence_id for r in found).values()) == 2 and {r.offset for r in found} == {0, 4}


def test_best_two_fit_against_every_choice():
    """Bins by the rule itself: the longest that fit, then the tightest pair in the smallest's place."""
    x = random.Random(2)
    for _ in range(60):
        lengths = [x.randrange(1, 21) for _ in range(x.randrange(1, 40))]
        left, want = sorted(lengths), []
        while left:
            inside, gap = [], 20
            while fits := [n for n in left if n <= gap]:
                inside.append(max(fits))
                left.remove(max(fits))
                gap -= max(fits)
            if gap and left:
                pairs = [left[i] + left[j] for i in range(len(left)) for j in range(i) if inside[-1] < left[i] + left[j] <= gap + inside[-1]]
                if pairs:
                    gap += inside[-1] - max(pairs)
                    one = max(b for b in left if max(pairs) - b in left and (2 * b != max(pairs) or left.count(b) > 1))
                    left = sorted([*left, inside.pop()])
                    for n in (one, max(pairs) - one):
                        inside.append(n)
                        left.remove(n)
            want.append(sorted(inside))
        bins, _ = packing.best_two_fit(np.array(lengths), 20)
        got = defaultdict(list)
        for b, n in zip(bins.tolist(), lengths, strict=True):
            got[b].append(n)
        assert sorted(map(sorted, got.values())) == sorted(want)


def test_two_replace_the_smallest():
    bins, _ = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    sizes = Counter()
    for b, n in zip(bins.tolist(), (6, 3, 2, 2), strict=True):
        sizes[b] += n
    assert sorted(sizes.values()) == [3, 10]


# 11


def nearest_by_force(x, entries):
    exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)) for c in entries] for v in x]
    return [min(range(len(entries)), key=lambda k: (d[k], k)) for d in exact], [min(d) for d in exact]


def test_nearest_entries_by_force():
    """Small and huge components, ties, equal entries, and distances that float32 can't tell apart."""
    rng = np.random.default_rng(5)
    close = np.int64(2**29) + rng.integers(-3, 4, (300, 4))
    cases = [(rng.integers(-9, 9, (500, 3)), rng.integers(-9, 9, (64, 3))), (rng.integers(-(2**28), 2**28, (200, 4)), rng.integers(-(2**28), 2**28, (64, 4))), (close, close[:64] + rng.integers(-1, 2, (64, 4))), (np.zeros((5, 2), np.int64), np.zeros((7, 2), np.int64)), (np.zeros((3, 0), np.int64), np.zeros((2, 0), np.int64))]
    for x, entries in cases:
        index, distance, decided = vector_codes.nearest(x, entries)
        assert (index.tolist(), distance.tolist()) == nearest_by_force(x, entries)
        assert decided <= len(x) * len(entries)
    *_, decided = vector_codes.nearest(rng.integers(-128, 128, (20_000, 4)), rng.integers(-128, 128, (64, 4)))
    assert decided < 1.2 * 20_000  # few entries overlap the best one's interval


def codes_by_force(rows, parts, entries, rounds):
    """rows: (id, label, vector of one length)."""
    dim = len(rows[0][2])
    cut = [0]
    for p in range(parts):
        cut.append(cut[-1] + dim // parts + (p < dim % parts))
    pieces = [[[v[a:b] for _, _, v in rows] for a, b in zip(cut, cut[1:], strict=False)]][0]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][2]))[:entries]
    books = [[of[k] for k in order] for of in pieces]
    for _ in range(rounds):
        for of, book in zip(pieces, books, strict=True):
            at, _ = nearest_by_force(of, book)
            for e in range(len(book)):
                mine = [x for x, k in zip(of, at, strict=True) if k == e]
                book[e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)] if mine else book[e]
    found = [nearest_by_force(of, book) for of, book in zip(pieces, books, strict=True)]
    return [(bytes(at[k] for at, _ in found), sum(d[k] for _, d in found)) for k in range(len(rows))], hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()


def test_codes(spark):
    """Nulls, odd components, several lengths, repeated rows and ids, clashing names, one label on most rows."""
    x = random.Random(8)
    vecs = [(i // 2 if i < 40 else i, None if i % 7 == 0 else x.choice([1, 1, 1, 2]), [x.uniform(-1, 1) if i % 3 else x.choice((0.5, -0.25)) for _ in range(10)]) for i in range(200)]
    vecs += [vecs[9], (None, 2, [0.5] * 10), (500, 1, [0.125] * 3), (501, None, [0.5, -0.5, 0.25]), (502, 2, [])]
    odd_ones = [(600, 1, None), (601, 1, [1.0, None] * 5), (602, 1, [float("nan")] * 10), (603, 1, [float("inf")] * 10)]
    schema = "vec_id long, label int, embedding array<float>"
    rows = spark.createDataFrame(vecs + odd_ones, schema).withColumns({c: F.lit(7) for c in ("id", "v", "dim", "code", "error", "_key", "_hot")}).repartition(5)
    found, books = vector_codes.compressed(rows, parts=4, entries=6, rounds=2)
    ints = [(i, label, [math.floor(256 * float(np.float32(c))) for c in v]) for i, label, v in vecs]
    want, totals = [], Counter()
    for dim in (10, 3, 0):
        mine = [r for r in ints if len(r[2]) == dim]
        codes, digest = codes_by_force(mine, 4, 6, 2)
        assert books.digest(dim) == digest
        want += [(i, label, dim, code, error) for (i, label, _), (code, error) in zip(mine, codes, strict=True)]
    for _, label, _, _, error in want:
        totals[label] += error
    assert Counter((r.vec_id, r.label, r.dim, bytes(r.code), r.error, r.label_error) for r in found.collect()) == Counter((*w, totals[w[1]]) for w in want)
    code = next(c for i, _, d, c, _ in want if i == 501 and d == 3)
    assert [*books.decode(3, code)] == next(v for i, _, v in ints if i == 501)
    empty, none = vector_codes.compressed(rows.limit(0))
    assert empty.count() == 0 and none.books == {}
    with pytest.raises(Exception, match="don't fit a long"):
        vector_codes.compressed(spark.createDataFrame([(1, 1, [1e12] * 4)], schema))


# 12


def collocations_by_force(rows, least, most_words=4, percent=80, most=2000):
    """rows: (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", lower):
            w = re.findall("[^\\x20\\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most_words + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, of in f.items():
        often = {p: c for p, c in of.items() if c >= least and len(p) > 1}
        kept = []
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (of[p[:k]] + of[p[k:]]), k, of[p[:k]], of[p[k:]]) for k in range(1, len(p)))
            kept.append((score, a, " ".join(p), left, right))
        kept.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, k, p, a, left, right, n[lang], score) for k, (score, a, p, left, right) in enumerate(kept[:most], 1)]
    return sorted(out)


def phrases_of(x, n):
    words = [x.choice(["New", "york", "CITY", "the", "of", "Ünder", "under", "a", "\u00a0b", "stra\u00dfe"]) for _ in range(n)]
    return "".join(w + x.choice([" "] * 9 + ["\t", ", ", ".", "\n", "\x0b", "? "]) for w in words)


def test_collocations(spark, monkeypatch):
    x = random.Random(12)
    rows = [(x.choice(["en", "en", "de", None]), phrases_of(x, x.randrange(60))) for _ in range(300)]
    rows += [("en", None), ("en", ""), (None, None), ("fr", " .,\n"), ("en", "the city " * 5000), ("und", "new york " * 9), ("en", rows[0][1]), ("en", rows[0][1])]
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit(7) for c in ("phrase", "n", "h", "block", "counts", "f", "a", "k", "size", "_n", "_at", "rank")}).repartition(3)
    for room, buckets in ((collocations.ROOM, collocations.MAX_BUCKETS), (20, 64)):  # 64: buckets that let all through
        monkeypatch.setattr(collocations, "ROOM", room)
        monkeypatch.setattr(collocations, "MAX_BUCKETS", buckets)
        for least, most in ((5, 2000), (3, 7)):
            got = sorted(tuple(r) for r in collocations.collocations(docs, min_count=least, most=most).collect())
            assert got == collocations_by_force(rows, least, most=most) and len(got) > 20
    assert collocations.collocations(docs, min_count=10**6).count() == 0  # counts beyond a byte
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_counts_by_bite_hold_no_hashes_and_go(spark, monkeypatch):
    kept, real = [], collocations.stored
    monkeypatch.setattr(collocations, "stored", lambda df: (kept.append(real(df)), kept[-1])[1])
    docs = spark.createDataFrame([("en", "new york city " * 40)], "lang string, text string")
    assert collocations.collocations(docs).count()
    assert not [t for t in kept if "h" in t.columns]
    assert not [f for t, f in zip(kept, (os.path.dirname(t.inputFiles()[0].removeprefix("file:").lstrip("/")) for t in kept), strict=True) if "block" in t.columns and os.path.exists(f"/{f}")]


def test_sieves_let_through_what_is_frequent_and_little_else():
    """Both bitmaps prune, and bites cut between pieces only."""
    x = random.Random(3)
    text = " ".join(f"w{min(int(x.paretovariate(0.6)), 5000)}" for _ in range(60_000)).encode()
    words = collocations.Words(["en"], [text])
    at, h = words.candidates(1, {}, {})
    two, h2 = words.longer(at, h, 1)
    bits = lambda h, n, keep: np.packbits(np.bincount((h & np.uint64(n - 1)).astype(np.int64), minlength=n) >= keep, bitorder="little")
    _, _, n, hashes = words.counted(at, h, 1)
    often = hashes.to_numpy().view(np.uint64)[n.to_numpy() >= 30]
    for frequent, bucket in ((bits(often, 1 << 20, 1), np.full(1 << 13, 255, np.uint8)), (np.full(1 << 13, 255, np.uint8), bits(h2, 1 << 16, 30)), (bits(often, 1 << 20, 1), bits(h2, 1 << 16, 30))):
        through, _ = words.candidates(2, {1: frequent}, {2: bucket})
        pairs = Counter(zip(words.word[two].tolist(), words.word[two + 1].tolist(), strict=True))
        left = Counter(zip(words.word[through].tolist(), words.word[through + 1].tolist(), strict=True))
        assert all(left[p] == c for p, c in pairs.items() if c >= 30) and len(left) < 0.6 * len(pairs)


@pytest.mark.parametrize("text", ["", "one two. " * 900_000, "x" * 6_000_000, "word " * 1_200_000 + "end"])
def test_long_texts_are_cut_between_pieces(text):
    import pyarrow as pa

    batch = pa.record_batch({"lang": ["en", "en"], "text": [text, "tail"]})
    found = list(collocations.bites(iter([batch])))
    chunks = [t for _, texts in found for t in texts]
    assert b"".join(chunks) == (text + "tail").encode()
    assert all(c.endswith((b".", b"tail")) or c.decode() in (text, "tail") or text.endswith(c.decode()) for c in chunks)


# 13


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 60_000])
def test_perfect_hash(n):
    """Every name has a number of its own below n, loaded or built; foreign names have any or none."""
    rng = np.random.default_rng(n)
    a, b = rng.integers(0, 2**63, (2, n)).astype(np.uint64)
    made = line_dedup.PerfectHash.build(a, b)
    for h in (made, line_dedup.PerfectHash.load(made.dump())):
        assert sorted(h.index(a, b).tolist()) == list(range(n))
        other = h.index(*rng.integers(0, 2**63, (2, 500)).astype(np.uint64))
        assert other.min() >= -1 and other.max() < n or n == 0
    if n > 10_000:
        assert 8 * len(made.dump()) < 4 * n
    shard = line_dedup.Shard(made, np.zeros(n, np.uint64), np.arange(n, dtype=np.uint32) + 1)
    shard.fingerprints[made.index(a, b)] = b
    assert (shard.documents(a, b) == made.index(a, b) + 1).all()
    assert not shard.documents(*rng.integers(0, 2**63, (2, 500)).astype(np.uint64)).any()


def lines_by_force(texts, min_docs, min_chars):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    docs = Counter(k for t in texts for k in {key(line) for line in (t or "").split("\n")})
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(key(x)) >= min_chars and docs[key(x)] >= min_docs)]
        out.append((None if t is None else "\n".join(stay), len(lines), len(lines) - len(stay)))
    return out


@pytest.mark.parametrize("limit", [line_dedup.MAX_BROADCAST, 0])
def test_common_lines(spark, monkeypatch, limit):
    """By broadcast and past the shards: one line in most documents, one very often in one, blanks, capitals, nulls, clashing names."""
    monkeypatch.setattr(line_dedup, "MAX_BROADCAST", limit)
    monkeypatch.setattr(line_dedup, "SHARD_LINES", 100)
    x = random.Random(13)
    some = ["Menu", "menu ", "\tMENU\r", "É", "é", "ab", "AB\x0b", "", "  ", "\u00a0menu", "x" * 300]
    texts = ["\n".join([*(["Hot line"] if i % 3 else []), *[x.choice([*some, f"only {i}", f"line {x.randrange(60)}"]) for _ in range(x.randrange(8))]]) for i in range(300)]
    texts += [None, "", "\n", "\n\n", "often here\n" * 5000, "hot line", "Menu\nmenu", texts[5], texts[5]]
    docs = spark.createDataFrame([(None if i % 50 == 1 else i // 2 if i < 20 else i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").withColumns({c: F.lit(7) for c in CLASHES}).repartition(4)
    for min_docs, min_chars in ((10, 1), (3, 3), (2, 0), (300, 1)):
        got = line_dedup.drop_common_lines(docs, min_docs, min_chars, report="made")
        assert got.columns == [*docs.columns, "made"]
        found = got.collect()
        want = Counter((r[0], *w) for r, w in zip([(None if i % 50 == 1 else i // 2 if i < 20 else i,) for i in range(len(texts))], lines_by_force(texts, min_docs, min_chars), strict=True))
        assert Counter((r.doc_id, r.text, r.made.n_lines, r.made.n_dropped) for r in found) == want and all(r[c] == 7 for r in found for c in CLASHES)
        assert sum(n for (*_, dropped), n in want.items() if dropped) > 100 or min_docs == 300
    assert line_dedup.drop_common_lines(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="name the report otherwise"):
        line_dedup.drop_common_lines(docs, report="N")


# pipeline


#: Names that the stages use inside, and others that might be.
CLASHES = "_doc _copy _text _row _z _part _near _kept repeats _id _hash _size _taken _nth _h1 _h2 row name number n taken part i epochs h1 h2 cid component n_words n_removed kept_sha256 cleaned target source_size _hot bucket".split()


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_maps(spark, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    good = "\n".join(" ".join(f"Word{i}x{k}" for k in range(9)) + "." for i in range(9))
    docs = docs_of(spark, [(1, good, "a"), (1, good, "a"), (2, good + " More.", "b"), (3, good[::-1], None)])
    docs = docs.withColumn("tags", F.when(F.col("doc_id") < 3, F.create_map(F.lit("k"), F.array(F.col("doc_id"))))).withColumn("deep", F.array(F.struct(F.create_map(F.lit(1), F.lit(2)).alias("m"))))
    got = run(spark, docs, "").collect()
    assert got and (stage == "best-fit packing" or {(r.doc_id, str(r.tags)) for r in got} <= {(1, "{'k': [1]}"), (2, "{'k': [2]}"), (3, "None")})
    if stage == "simhash near-dedup":
        assert sorted(r.doc_id for r in got) == [1, 3]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows_and_any_names(spark, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    good = "\n".join(" ".join(f"Word{i}x{k}" for k in range(9)) + "." for i in range(9))
    more = docs_of(spark, [(20, good, "b"), (20, good, "b"), (None, good, "b"), (21, good + " More.", None)])
    docs = odd(spark).select("doc_id", "text", "lang", "source", "n_chars").unionByName(more).withColumns({c: F.lit(7) for c in CLASHES})
    got = run(spark, docs, "").collect()
    assert run(spark, docs.limit(0), "").count() == 0
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    if stage == "best-fit packing":
        assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(i for i, _ in texts.elements())
        return
    assert run(spark, docs, "").columns == docs.columns and all(r[c] == 7 for r in got for c in CLASHES)
    kept = Counter((r.doc_id, r.text) for r in got)
    if stage == "quality rules":
        assert kept == Counter({(20, good): 2, (None, good): 1, (21, good + " More."): 1})
    elif stage == "simhash near-dedup":
        assert kept == Counter([(20, good), (1, None), (5, "word " * 30_000), (4, "one two"), (6, "x" * 5000), (6, "other text"), (None, "one two three")])
    elif stage == "substring dedup":
        assert kept[20, good] == 2 and (None, good) not in kept and kept[1, None] == kept[2, ""] == kept[4, "one two"] - 1 == 1
    else:
        assert kept[1, None] == 0 and sum(kept.values()) > 0


def test_pipeline(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    wide = docs.columns
    good = corpus_pipeline.quality_rules(spark, docs, "").cache()
    keep = {r.doc_id for r in quality.judge_documents(docs).where("kept").collect()}
    assert good.columns == wide and {r.doc_id for r in good.collect()} == keep
    unique = corpus_pipeline.near_duplicates(spark, good, "").cache()
    assert unique.columns == wide and unique.count() == unique.select("doc_id").distinct().count() < good.count()
    cut = corpus_pipeline.substring_dedup(spark, unique, "").cache()
    want = {i: (n - gone, sha) for i, n, gone, sha in repeats_by_force([(r.doc_id, r.text) for r in unique.collect()], 13)}
    for r in cut.collect():
        words = r.text.encode().split()
        assert want[r.doc_id] == (len(words), hashlib.sha256(b" ".join(words)).hexdigest())
    mixed = corpus_pipeline.source_mix(spark, cut, "")
    assert mixed.columns == wide
    total = lambda df: df.select(F.sum(mixing.n_words(F.col("text")))).first()[0]
    assert abs(total(mixed) - 1.5 * total(cut)) <= 30
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.01")
    assert {r.doc_id for r in packed.collect()} <= keep
    assert corpus_pipeline.best_fit_packing(spark, mixed.limit(0), "").count() == 0
