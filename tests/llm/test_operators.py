import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import chat, decontaminate, language, lm_scoring, packing, sharding, toxicity

DOCS = "doc_id long, text string"


def with_clashes(df):
    """Extra columns named like those that the operators make."""
    extra = ["shard", "slot", "h", "range", "id", "n", "token", "component", "length", "rank", "score", "segments", "target", "size"]
    return df.select("*", *[F.lit("x").alias(c) for c in extra if c not in df.columns])


def brute_sharding(rows, out, shards, slack):
    """The law, the groups and the slots of a placement."""
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in out) == sorted((i is not None, i or 0) for i, _ in rows)
    by, where = {}, {}
    for r in out:
        by.setdefault(r["shard"], []).append(r)
    total = sum(r["size"] for r in out)
    assert total == sum(len((t or "").encode()) + 1 for _, t in rows) and set(by) <= set(range(shards))
    assert all(abs(sum(r["size"] for r in by.get(s, [])) - total / shards) <= slack for s in range(shards))
    assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in by.values())
    text = dict(rows)
    for r in out:
        assert r["text_crc32"] == (None if text[r["doc_id"]] is None else zlib.crc32(text[r["doc_id"]].encode()))
        where.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    return {t: len(s) for t, s in where.items()}


def test_sharding_keeps_equal_texts_together(spark):
    rng = random.Random(1)
    texts = [f"{i} " + "w" * rng.randint(0, 200) for i in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, rng.choice(texts[:150])) for i in range(500)]
    rows += [(2000 + i, "warm " * 40) for i in range(30)] + [(2500, None), (2501, None), (2502, ""), (3000, "twice"), (3000, "twice")]
    df = with_clashes(spark.createDataFrame(rows, DOCS))
    out = sharding.shard(df, shards=4, rows_per_range=40, samples_per_range=8).collect()
    spread = brute_sharding(rows, out, 4, 450)
    assert set(spread.values()) == {1}
    assert sharding.shard(df.limit(0)).count() == 0


def test_sharding_divides_what_no_shard_has_room_for(spark):
    """Half of all rows are one text, a quarter are equal rows, and empty texts are many rows of few bytes."""
    rng = random.Random(2)
    rows = [(i, "hot " * 10) for i in range(1000)] + [(7, "same row " * 5)] * 400 + [(5000 + i, "") for i in range(600)]
    rows += [(9000 + i, "x" * rng.randint(0, 60)) for i in range(200)]
    names = {7: "same row " * 5} | {i: t for i, t in rows if i >= 5000}
    rows = [(i + 100_000 if t == "hot " * 10 else i, t) for i, t in rows]
    out = sharding.shard(spark.createDataFrame(rows, DOCS), shards=4, rows_per_range=50).collect()
    spread = brute_sharding(rows, out, 4, 100)
    assert spread["hot " * 10] <= 4 and spread[""] == 1 and sum(k > 1 for k in spread.values()) <= 2 and names
    places = sorted((r["shard"], r["slot"]) for r in out)
    assert len(set(places)) == len(rows)


def test_arranged_groups_are_divided_last():
    rng = random.Random(3)
    for _ in range(50):
        shards, large = rng.randint(1, 9), [(i, rng.randint(1, 400)) for i in range(rng.randint(0, 12))]
        total = sum(n for _, n in large) + rng.randint(0, 3000)
        if not total:
            continue
        plan = sharding.arrange(total, shards, large)
        begin, end = plan.begin, np.append(plan.begin[1:], total)
        filled = np.bincount(plan.shard, end - begin, shards)
        assert np.allclose(filled, total / shards) and begin[0] == 0
        for h, n in large:
            lo = plan.segment[h]
            pieces = ((begin < lo + n - 1e-6) & (end > lo + 1e-6)).sum()
            assert pieces == 1 or n > total / shards or len(large) > shards


def test_packing_places_every_piece(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "de", "la"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 90)))) for i in range(300)] + [(900, None), (901, ""), (902, "beta " * 500), (3, "beta"), (3, "beta")]
    path = public_tokenizers.path("word_bpe_49k.json")
    out = packing.pack(with_clashes(spark.createDataFrame(rows, DOCS)), path, capacity=64, with_ids=True).collect()
    assert len({r["sequence_id"] for r in out}) <= math.ceil(sum(r["length"] for r in out) / 64) + 1
    places = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    got = {}
    for r in sorted(out, key=lambda r: r["piece"]):
        assert zlib.crc32(r["ids"]) == r["ids_crc32"]
        if r["doc_id"] != 3:
            got.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert all(got[i] == [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in rows if i != 3)
    assert sum(r["doc_id"] == 3 for r in out) == sum(i == 3 for i, _ in rows)
    assert packing.pack(spark.createDataFrame([], DOCS), path).count() == 0


def test_plans_cover_any_histogram():
    rng = random.Random(3)
    for _ in range(20):
        cap = rng.choice([7, 32, 100])
        h = {n: rng.randint(1, 40) for n in rng.sample(range(1, cap + 1), rng.randint(1, cap))}
        plan = packing.plan(h, cap)
        used = Counter()
        for lengths, n in plan:
            assert sum(lengths) <= cap and n > 0
            for x in lengths:
                used[x] += n
        assert used == h
    assert packing.plan({}, 10) == []


def brute_chat(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def test_chat_reads_back(spark):
    odd = ["\\### Assistant: </turn> ok", "<turn/>", "\\", "\\\\n", "### ", "####  x", "<\\/turn>", "</turn></turn>\n", "\n", "", None, "<\\turn/>", "#\\## ", "é<"]
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "a\nb\\n", None]), rng.choice(odd)) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(99, None, "user", "x"), (99, 1, "user", "same"), (99, 1, "user", "same")]
    df = with_clashes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    formatted = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    for conv, turns in brute_chat(rows).items():
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == turns
        assert got[conv]["loss_text"] == "".join(x for r, x in turns if r == "assistant")
    plan = formatted._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    text = formatted.where("conv_id = 99").first()["formatted"]
    assert text == "### user:\nx<turn/>same<turn/>same</turn>\n"
    assert chat.format_conversations(df.limit(0)).count() == 0


def brute_windows(text, item, k=5):
    words = lambda s: ["".join(c for c in w) for w in __import__("re").findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in s))]
    d, m = words(text or ""), words(item)
    bag = lambda w: Counter([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])
    want, best = bag(m), 0.0
    for s in range(max(1, len(d) - len(m) + 1)):
        have = bag(d[s : s + len(m)])
        both = sum((have & want).values())
        union = sum((have | want).values())
        best = max(best, both / union if union else 0.0)
    return best


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    items = [" ".join(rng.choices(vocab, k=n)) for n in (12, 30, 30, 45, 3, 70)]
    texts = []
    for i in range(60):
        body = rng.choices(vocab, k=rng.randint(0, 120))
        item = rng.choice(items).split()
        if i % 2:
            for _ in range(rng.randint(0, 3)):
                item[rng.randrange(len(item))] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = item
        texts.append(" ".join(body).upper() if i % 5 == 0 else ", ".join(body))
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, items[1]), (902, items[1]), (903, items[4])]
    bench = with_clashes(spark.createDataFrame([*enumerate(items), (77, None), (78, "")], "item_id long, text string"))
    out = decontaminate.matches(with_clashes(spark.createDataFrame(rows, DOCS)), bench)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in out.collect()}
    want = {}
    for i, t in rows:
        for j, item in enumerate(items):
            if len(item.split()) >= 5:
                s = brute_windows(t, item)
            else:
                s = float(f" {item} " in f" {(t or '').lower().replace(',', '')} ")
            if s >= 0.8:
                want[i, j] = s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert decontaminate.matches(spark.createDataFrame(rows, DOCS), bench.limit(0)).count() == 0
    blocks = decontaminate.matches(spark.createDataFrame(rows, DOCS), bench, block_rows=2)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} == set(want)


def test_index_finds_all_fingerprints_within_the_radius_and_few_others():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 2, (800, decontaminate.BITS))
    index = decontaminate.Index([], [], 5, 63)
    index.of_length[9] = np.arange(800)
    index.columns[9] = np.ascontiguousarray(decontaminate.fingerprints(items * 2 - 1).T)
    asked = items[:300].copy()
    for row in asked:
        row[rng.choice(decontaminate.BITS, rng.integers(0, 90), replace=False)] ^= 1
    far = (asked[:, None] != items[None]).sum(2)
    for radius in (63, 75, 5):
        got = index.lookup(9, decontaminate.fingerprints(asked * 2 - 1), radius)
        assert set(got) == set(zip(*(x.tolist() for x in np.nonzero(far <= radius)), strict=True))
    index.compared = index.candidates = 0
    index.lookup(9, decontaminate.fingerprints(rng.integers(0, 2, (300, decontaminate.BITS)) * 2 - 1), 63)
    assert index.candidates < 0.01 * index.compared  # of unrelated items


def test_fingerprints_of_similar_windows_lie_within_the_radius():
    rng = np.random.default_rng(2)
    seen = 0
    for n in (5, 9, 12, 20, 40, 80):
        both = int(np.ceil(1.6 * n / 1.8))  # of two windows of n shingles at a similarity of 0.8
        for _ in range(400):
            h = rng.integers(0, 1 << 62, 2 * n - both).astype(np.uint64)
            a, b = (decontaminate.fingerprints(decontaminate._bits(x).sum(0, keepdims=True)) for x in (h[:n], h[n - both :]))
            seen += int(np.bitwise_count(a ^ b).sum() > 63)
    assert seen <= 1


def test_language_spans_and_undetermined(spark):
    en, de = "the water and the river with that thing ", "und der mann ist nicht schön mit einem "
    rows = [(i, en * 5, "en") for i in range(30)] + [(100 + i, de * 5, "de") for i in range(30)] + [(i + 500, "много слов здесь " * 9, "ru") for i in range(30)]
    train = spark.createDataFrame([*rows, (3, None, "en"), (4, "x", None)], DOCS + ", lang string")
    model = language.train(train)
    asked = [(1, en), (2, de), (3, None), (4, ""), (5, "12 34 !"), (6, en * 3 + de * 3), (7, "слов"), (8, "日本"), (1, en)]
    out = language.identify(with_clashes(spark.createDataFrame(asked, DOCS)), model, spans=True).collect()
    got = {r["doc_id"]: r for r in out}
    assert len(out) == 9 and [got[i]["lang_pred"] for i in (1, 2, 3, 4, 5, 7)] == ["en", "de", "und", "und", "und", "ru"]
    assert [s["lang"] for s in got[6]["spans"]] == ["en", "de"] and got[6]["spans"][0]["end"] <= len(en) * 3
    assert all(0 <= r["score"] <= 1 for r in out)
    none = language.identify(spark.createDataFrame([(1, "x")], DOCS), language.train(train.limit(0))).first()
    assert none["lang_pred"] == "und"


def test_viterbi_equals_the_plain_programme():
    rng = np.random.default_rng(6)
    ptr = np.array([0, 5, 5, 6, 40, 90])
    for penalty in (0.5, 2.0, 10.0):
        scores = rng.normal(0, 2, (90, 3)) + np.repeat(rng.normal(0, 1, (9, 3)), 10, 0)
        got = language.viterbi(scores, ptr, penalty)
        for a, b in zip(ptr[:-1], ptr[1:], strict=True):
            v, value = scores[a:b], None
            for row in v:
                value = row if value is None else np.maximum(value, value.max() - penalty) + row
            if b > a:
                path = got[a:b]
                mine = v[np.arange(b - a), path].sum() - penalty * (path[1:] != path[:-1]).sum()
                assert abs(mine - value.max()) < 1e-9


def test_viterbi_of_two_stretches_that_meet():
    """A third language is the best single one, but two stretches with one switch between them are better."""
    scores = np.array([[0, -12, -5], [0, -12, -5], [-12, 0, -5], [-12, 0, -5]], float)
    assert language.viterbi(scores, np.array([0, 4]), 12.0).tolist() == [0, 0, 1, 1]


def test_language_is_right_on_held_out_documents(spark):
    rng = random.Random(13)
    bits = {"a": ["ka", "lo", "mi", "ter"], "b": ["sch", "ung", "ein", "er"], "c": ["eau", "tion", "que", "le"]}
    word = lambda x: "".join(rng.choices(bits[x], k=rng.randint(1, 4)))
    rows = [(i, " ".join(word(x) for _ in range(rng.randint(3, 60))), x) for i, x in enumerate(rng.choices("abc", k=600))]
    rows += [(5000, " ".join(word("b") for _ in range(60_000)), "b")]  # a very long one
    docs = spark.createDataFrame(rows, DOCS + ", lang string")
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, model).collect()}
    asked = [(i, x) for i, _, x in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(asked) > 100 and sum(found[i] == x for i, x in asked) >= 0.98 * len(asked) and found[5000] == "b"


def test_toxicity_finds_marked_texts(spark):
    rng = random.Random(7)
    bad = ["idiot", "scum", "moron", "trash", "clown"]
    vocab = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(10)]
    rows, labels = [], []
    for i in range(600):
        words, toxic = rng.choices(vocab, k=40), i % 6 == 0
        if toxic:
            words[::8] = rng.choices(bad, k=5)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)) if i % 3 else (i, None) if i % 2 else (i, int(toxic)))
    docs = with_clashes(spark.createDataFrame([*rows, (900, None), (901, "")], DOCS))
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    assert (np.diff(model.thresholds) > 0).all()
    out = {r["doc_id"]: r for r in toxicity.grade(docs, model).collect()}
    assert [i for i, r in out.items() if r["toxic"]] == [i for i in range(0, 600, 6)]
    assert all(0 <= r["expected_severity"] <= len(model.thresholds) for r in out.values())
    assert all(r["toxic"] == (r["grade"] > 0) for r in out.values())
    twice = toxicity.grade(docs.where("doc_id in (0, 1)").unionAll(docs.where("doc_id = 0")).unionAll(spark.createDataFrame([(7, rows[0][1] + " word" * 50_000)], DOCS).select("*", *[F.lit("x").alias(c) for c in docs.columns[2:]])), model)
    assert sorted((r["doc_id"], r["toxic"]) for r in twice.collect()) == [(0, True), (0, True), (1, False), (7, True)]
    for none in (marks.limit(0), marks.where("toxic = 0"), marks.where("toxic = 1")):
        assert not toxicity.grade(docs, toxicity.train(docs, none)).where("toxic").count()
    assert toxicity.grade(docs.limit(0), toxicity.train(docs.limit(0), marks)).count() == 0


def test_grades_are_the_labels_own(spark):
    rows = [(1, 0, 0, None), (2, 1, 1, None), (3, 1, 0, None), (4, 1, None, None), (5, 1, 1, 3), (6, 0, 1, 2), (7, 1, 0, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int, quality int, severity int")
    got = {r["doc_id"]: r["g"] for r in labels.select("doc_id", toxicity.observed_grade(labels).alias("g")).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 1, 5: 3, 6: 0, 7: 1}


def test_ordinal_fit_is_a_minimum():
    """The penalised likelihood, written down plainly, is no better anywhere near the fit."""
    rng = np.random.default_rng(9)
    rows = [sorted(rng.choice(4, rng.integers(0, 4), replace=False).tolist()) for _ in range(300)]
    true = np.array([2.0, -1.0, 0.5, 1.0])
    grades = np.array([int((true[r].sum() + rng.logistic() > np.array([0.3, 1.8])).sum()) for r in rows])

    def loss(w, cuts):
        total = 0.0
        for r, g in zip(rows, grades, strict=True):
            below = [0.0, *(1 / (1 + math.exp(w[r].sum() - c)) for c in cuts), 1.0]
            total -= math.log(below[g + 1] - below[g])
        return total / len(rows) + 0.5 * 1e-3 * float(w @ w)

    w, cuts = toxicity.fit_cumulative(rows, grades, 4, 3, l2=1e-3, steps=2000)
    best = loss(w, cuts)
    assert best <= loss(true, np.array([0.3, 1.8])) + 1e-3 and np.abs(w - true).max() < 0.8
    for i in range(6):
        for step in (-0.05, 0.05):
            x = np.append(w, cuts)
            x[i] += step
            assert loss(x[:4], x[4:]) > best - 1e-6


def test_ordinal_fit_orders_thresholds_and_grades():
    rng = np.random.default_rng(8)
    rows = [[0] * int(k > 0) + ([1] if k > 1 else []) for k in rng.integers(0, 3, 400)]
    grades = np.array([len(r) for r in rows])
    w, cuts = toxicity.fit_cumulative(rows, grades, 2, 3)
    assert (w > 0).all() and cuts[0] < cuts[1]
    z = np.array([w[r].sum() for r in rows])
    assert ((z[:, None] > cuts).sum(1) == grades).mean() > 0.95


def test_lm_scores_prefer_the_target(spark):
    rng = random.Random(9)
    make = lambda v: " ".join(rng.choices(v, k=60))
    a, b = [f"aa{i}" for i in range(30)], [f"bb{i}" for i in range(30)]
    rows = [(i, make(a if i % 2 else b)) for i in range(200)] + [(900, None), (901, "")]
    docs = with_clashes(spark.createDataFrame(rows, DOCS))
    ids = spark.createDataFrame([(i,) for i in range(1, 100, 2)], "doc_id long")
    out = {r["doc_id"]: r for r in lm_scoring.score(docs, ids, lm_scoring.train(docs, ids, vocabulary_size=128, bins=1 << 12)).collect()}
    assert min(out[i]["score"] for i in range(1, 200, 2)) > max(out[i]["score"] for i in range(0, 200, 2))
    assert out[900]["score"] is None and out[901]["n_tokens"] == 0
    assert lm_scoring.score(docs.limit(0), ids, lm_scoring.train(docs.limit(0), ids)).count() == 0


def test_lm_counts_follow_the_input(spark, monkeypatch):
    """More distinct words and pairs than any table of a fixed size holds, against plain dictionaries."""
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 1 << 18)
    monkeypatch.setattr(lm_scoring, "BUCKET_BYTES", 1 << 19)
    rng = random.Random(4)
    rows = [(i, " ".join([*(f"r{rng.randrange(90000)}" for _ in range(400)), *rng.choices("abcdefgh", k=20)])) for i in range(600)]
    rows += [(600 + i, rows[i][1]) for i in range(60)] + [(900, None), (901, " "), (902, "r1"), (903, "a"), (903, "b a b a")]
    good = set(range(0, 640, 3)) | {903}
    docs, ids = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i,) for i in good], "doc_id long")
    models = lm_scoring.train(docs, ids)
    assert models.blocks > 1 and models.words > 1 << 16
    got = sorted(tuple(r) for r in lm_scoring.score(docs, ids, models).collect())

    split = [(i, (t or "").split()) for i, t in rows]
    count = [[Counter(), Counter(), Counter()] for _ in range(2)]
    own = lambda ws: (Counter(ws), Counter(["", *ws[:-1]] if ws else []), Counter(zip(["", *ws[:-1]], ws)))  # noqa: B905, E731
    for i, ws in split:
        for k in (0, 1) if i in good else (1,):
            for total, mine in zip(count[k], own(ws), strict=True):
                total.update(mine)
    totals = [sum(c[0].values()) for c in count]
    assert models.words == len(count[1][0]) and models.totals == tuple(totals)
    scale = totals[0] / totals[1]
    want = []
    for i, ws in split:
        one, ctx, two = own(ws)
        loss = [0.0, 0.0]
        for k, (x, out) in enumerate(((1.0, float(i in good)), (scale, scale))):
            for a, b in zip(["", *ws[:-1]], ws, strict=True) if ws else ():
                p = (x * count[k][0][b] - out * one[b] + 0.5) / (x * totals[k] - out * len(ws) + 0.5 * models.words)
                c = x * count[k][1][a] - out * ctx[a]
                loss[k] -= math.log((x * count[k][2][a, b] - out * two[a, b] + 50 * p) / (c + 50))
        want.append((i, len(ws), *((x / len(ws) for x in (*loss, loss[1] - loss[0])) if ws else (None,) * 3)))
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:2] == w[:2] and (g[2] is None) == (w[2] is None)
        assert g[2] is None or g[2:] == pytest.approx(w[2:], abs=1e-9)
    with pytest.raises(Exception, match="other documents"):
        lm_scoring.score(docs.where("doc_id < 900"), ids, models).collect()


def test_chat_query_equals_its_sql(spark, tmp_path):
    import duckdb

    from weftgraph.llm import queries

    rows = [(1, 0, "user", "a\\b"), (1, 1, "assistant", "x </turn>"), (1, 2, "assistant", "### y"), (2, 0, "system", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op7_chat_formatting(spark, str(tmp_path)).toPandas().sort_values("conv_id").values.tolist()
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(queries.oracle_sql()["op7_chat_formatting"]).df().sort_values("conv_id").values.tolist()
    assert got == want
    assert got[0][2] == hashlib.sha256(b"user\n\\### Assistant: </turn> ok\nassistant\n\\### Assistant: </turn> ok\n").hexdigest()


def test_held_out_rows(spark):
    got = spark.range(50).select("id", language.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in got)
    assert pytest.approx(1 / 3, abs=0.2) == sum(r["h"] for r in got) / 50


def test_sharding_places_records_without_python(spark):
    bounds = sorted((random.Random(i).getrandbits(64) - (1 << 63), i) for i in range(37))
    bounds = sorted({*bounds, (bounds[5][0], -(1 << 63)), (bounds[5][0], 99)})
    rows = [*bounds, (-(1 << 63), 0), ((1 << 63) - 1, 0), (bounds[5][0], 98)]
    found = spark.createDataFrame(rows, "h long, d long").select("h", "d", sharding._range(bounds).alias("n"))
    assert all(r["n"] == sum(b <= (r["h"], r["d"]) for b in bounds) for r in found.collect())
    layout = sharding.arrange(1000, 8, [(7, 400), (9, 150)])
    places = spark.range(-1, 1000).select(F.col("id").cast("double").alias("p"), sharding._shard(layout, F.col("id").cast("double")).alias("s"))
    for r in places.collect():
        assert r["s"] == layout.shard[max(0, int((layout.begin <= r["p"]).sum()) - 1)]
    docs = spark.createDataFrame([(i, str(i)) for i in range(50)], "doc_id long, text string")
    plan = sharding.shard(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and sharding.shard(docs).select("shard").distinct().count() == 8
