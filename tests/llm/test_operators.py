"""Each operator against a plain version on small rows, and its defined results for nulls, empty texts, ties and repeats."""

import hashlib
import math
import random
import re
import time
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm import common, fingerprints, importance_sampling, jaccard_join, language_id, mixing_model, quality_rules, sentencepiece_codec, source_mixing, suffix_dedup, url_filter

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, v string, size string, target string, hash string, kind string, score double, lang_pred string, kept string"


def long_text(seed, n):
    state, out = seed, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append("".join("aeioubcdfgst"[(state >> (5 * k)) % 12] for k in range(2 + state % 5)))
    return " ".join(out)


BASE = long_text(7, 120)
TEXTS = [
    None, "", " ", "one", "Äé ß", BASE, BASE, BASE.replace("a", "a", 1) + " end", BASE.upper(), long_text(3, 400), long_text(3, 400)[:900] + " " + long_text(5, 60), "x" * 700, "xy" * 400, BASE[:300] + "\n" + BASE[:300],
    "the same passage of text that stands in several documents and is longer than one hundred bytes, word for word, indeed. " + long_text(11, 30), "other start: the same passage of text that stands in several documents and is longer than one hundred bytes, word for word, indeed.",
    "日本語 " * 60, "a\tb\nc\x0bd " * 50, "42 " * 40, "\x00 " * 30,
]
ROWS = [(k, t, [None, "en", "fr"][k % 3], [None, "a", "b", "é"][k % 4], len(t or "")) for k, t in enumerate(TEXTS)] + [(5, BASE, "en", "a", len(BASE)), (None, BASE, None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *["clash"] * 6, 1.5, "clash", "clash") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.filter("doc_id < -1")


def words(t):
    return re.findall(WORD, t or "")


def test_common_word_hashes_follow_the_words():
    from millrace.llm.common import word_hashes

    a, b = word_hashes("ab  cd\tab".encode()), word_hashes(b"xx ab cd")
    assert len(a) == 3 and a[0] == a[2] == b[1] and a[1] == b[2] and a[0] != a[1]


def test_shares_of_a_table_hold_for_tiny_shares(spark):
    from millrace.llm.common import share_bound, share_of

    rows = spark.range(20_000)
    assert rows.filter(share_of(1.0, "id")).count() == 20_000 and rows.filter(share_of(0.0, "id")).count() == 0
    assert abs(rows.filter(share_of(0.25, "id")).count() - 5000) < 300
    assert spark.range(1).select(share_bound(1e-12)).first()[0] > -(1 << 63)  # a share below a millionth is no empty one


def test_language_id(spark, docs, nothing):
    rows = [(k, long_text(k, 40) + (" und der die" * 20 if k % 2 else " el la que" * 20), "de" if k % 2 else "es") for k in range(60)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(train, F.col("doc_id") < 40)
    out = {r.doc_id: r for r in language_id.predict(train, model).collect()}
    assert all(out[k].lang_pred == ("de" if k % 2 else "es") and not out[k].lang_rejected for k in range(40, 60))
    odd = language_id.predict(docs, model).collect()
    assert len(odd) == len(ROWS) and all(r.lang_pred == "und" and r.lang_score == 0 and r.lang_rejected for r in odd if not any(unicodedata.category(c)[0] == "L" for c in r.text or ""))
    assert model.judge(["½ ² Ⅷ ①", "ª"])[0][0] == "und"
    assert all(0 <= r.lang_score <= 1 and r.score == 1.5 for r in odd)
    assert language_id.predict(nothing, model).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, language_id.fit(nothing, F.lit(True))).collect()} == {"und"}


def test_lm_scoring(spark, docs, nothing):
    rows = {r.doc_id: r for r in mixing_model.score(docs).collect()}
    train = [(i, t) for i, t, *_ in ROWS if i is not None and zlib.crc32(str(i).encode()) % 10 != 0]
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    counts = Counter(w for _, t in train for w in tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    for i, t, *_ in ROWS[: len(TEXTS)]:
        r, ws = rows[i], tokens(t)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws), rel_tol=1e-9)
        assert r.score < 0 and r.bits_per_byte > 0
    assert mixing_model.score(docs).count() == len(ROWS)
    assert mixing_model.score(nothing).count() == 0


def test_lm_codes_are_complete():
    texts = [b"the cat of the hat \n"] * 3
    words = mixing_model.token_hashes(np.frombuffer(b"the of \n", dtype=np.uint8))[2]
    coder = mixing_model.fitted_coder(words, np.array([6, 3]), texts)
    for low, high in ((0, coder.base), (coder.base, coder.end_mark + 1)):
        assert math.isclose(sum(2.0 ** -int(n) for n in coder.length[low:high]), 1.0)


def test_lm_pairs_and_codes_come_from_all_learning_rows(spark, monkeypatch):
    rows = [(k, f"the cat of the hat {long_text(k, 5)} " + "".join(chr(97 + (k * j) % 26) for j in range(9))) for k in range(200)]
    texts, docs = [mixing_model.normal(t) for _, t in rows], spark.createDataFrame(rows, "doc_id long, text string")
    hashes, n = np.unique(mixing_model.token_hashes(np.frombuffer(b"".join(texts), dtype=np.uint8))[2], return_counts=True)
    words, times = hashes[n >= 200], n[n >= 200]
    want = mixing_model.fitted_coder(words, times, texts)
    for some in (docs, docs.repartition(7)):
        got = mixing_model.learned_coder(some, words, times, len(rows))
        assert (got.pair == want.pair).all() and (got.length == want.length).all() and (got.salt == want.salt).all()
    counts = sum(np.bincount(mixing_model.Batch(want, [t]).symbols(want).symbol, minlength=want.end_mark + 1) for t in texts)
    assert (np.where(np.arange(len(counts)) < want.base, counts, 0) == np.where(np.arange(len(counts)) < want.base, mixing_model.cold_counts(want, texts), 0)).all()
    assert counts[want.escape] == mixing_model.cold_counts(want, texts)[want.escape]
    given = []
    keep = mixing_model.learned_coder
    monkeypatch.setattr(mixing_model, "learned_coder", lambda learning, *rest: given.append(learning.count()) or keep(learning, *rest))
    mixing_model.score(docs, mixer_documents=3)
    assert given == [sum(zlib.crc32(str(k).encode()) % 10 != 0 for k, _ in rows)]


def test_lm_scores_equal_a_plain_mixer_and_beat_the_base(spark):
    dice = np.random.default_rng(4)
    stock = long_text(77, 300).split()
    after = {w: dice.choice(stock, 3).tolist() for w in stock}  # each word is followed by one of three
    rows = []
    for k in range(400):
        w = [stock[k % 300]]
        for _ in range(60):
            w.append(after[w[-1]][int(dice.integers(3))])
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = mixing_model.score(docs).collect()
    held = [r for r in out if r.held_out]
    assert len(held) > 20 and sum(r.score for r in held) > 0.6 * sum(r.base_score for r in held)
    assert sorted(out) == sorted(mixing_model.score(docs.repartition(5)).collect())

    # bit by bit: the log odds of each table, added up by the gate's weights, refined, as probabilities
    words = mixing_model.token_hashes(np.frombuffer(mixing_model.normal(" ".join(stock[:100])), dtype=np.uint8))[2]
    texts = [mixing_model.normal(t) for _, t in rows[:30]]
    coder = mixing_model.fitted_coder(words, np.arange(1, len(words) + 1), texts)
    counts = mixing_model.Counts()
    counts.add(coder, mixing_model.Batch(coder, texts[10:]))
    mixer = mixing_model.Mixer(coder, mixing_model._states(counts.n))
    mixer.learn(texts[:10], rounds=1)
    batch = mixing_model.Batch(coder, texts[:3])
    got, want = mixer.bits(batch, 3), np.zeros(3)
    for at, s in enumerate(batch.symbol):
        want[batch.owner[at]] += max(0, int(coder.length[s]) - mixing_model.DEEP)
        for d in range(min(mixing_model.DEEP, int(coder.length[s]))):
            slots = [int((int(c[at]) ^ int(coder.salt[d, s])) * 0x85EBCA6B % (1 << 32)) >> (32 - size) for c, size in zip(batch.contexts, mixing_model.SIZES)]
            states = [int(t[x]) for t, x in zip(mixer.tables, slots)]
            gate = (states[1] & 7) << 3 | states[2] & 7
            total = sum(float(mixer.weights[k, gate]) * (states[k] >> 3) for k in range(3)) + float(mixer.weights[3, gate])
            total += float(mixer.refine[gate * 33 + int(min(32, max(0, total * 2 + 16.5)))])
            p = 1 / (1 + math.exp(-total))
            want[batch.owner[at]] -= math.log2(p if coder.bit[d, s] else 1 - p)
    assert np.allclose(got, want, rtol=1e-3)


def plain_repeats(rows, n=100):
    seen, out = {}, []
    for i, raw in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        gone = np.zeros(len(raw), dtype=bool)
        for k in range(len(raw) - n + 1):
            w = raw[k : k + n]
            if w in seen and seen[w] != (i, k):
                gone[k : k + n] = True
            seen.setdefault(w, (i, k))
        out.append((i, len(raw), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows_a_batch, most", [("10000", 10_000), ("3", 1)])
def test_suffix_dedup(spark, docs, nothing, rows_a_batch, most):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
    try:
        out = suffix_dedup.remove_repeats(docs, most_phrases=most).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h"), "v").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert all(r.v == "clash" for r in out)
    assert sorted((tuple(r)[:5] for r in out), key=str) == plain_repeats([(r[0], (r[1] or "").encode()) for r in ROWS])
    assert suffix_dedup.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("length", [1, 2, 5, 8, 13, 100])
def test_suffix_ranks(length):
    rng = np.random.default_rng(length)
    data = np.concatenate((rng.integers(0, 2, 400), np.zeros(150), rng.integers(0, 256, 200), np.full(150, 255))).astype(np.uint8)
    raw = data.tobytes()
    whole = len(raw) - length + 1
    rank = suffix_dedup.suffix_ranks(data, length)[:whole]
    strings = [raw[k : k + length] for k in range(whole)]
    order = np.argsort(rank, kind="stable")
    assert [strings[k] for k in order] == sorted(strings)
    assert len(set(rank.tolist())) == len(set(strings))


def test_word_hashes_of_segments(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [b"", b" \t", b"x" * 500, b" a  bb\n", bytes(rng.choice(np.frombuffer(b"ab \n", dtype=np.uint8), 3000)) + b"tail" * 40]
    whole = [common.word_hashes(t).tolist() for t in texts]
    monkeypatch.setattr(common, "SEGMENT", 50)
    assert [common.word_hashes(t).tolist() for t in texts] == whole
    assert [b"".join(common.pieces(t)) for t in texts] == texts


def test_suffix_dedup_segments(monkeypatch):
    data = np.frombuffer((long_text(1, 900) * 2).encode(), dtype=np.uint8)
    whole = suffix_dedup.phrases(data)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    cut = suffix_dedup.phrases(data)
    starts = lambda p: sorted(x for a, b in zip(p[2], p[3]) for x in range(a, b + 1))
    assert starts(whole) == starts(cut) == list(range(len(data) - 99))


def test_sentencepiece(spark, docs, nothing):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    codec = sentencepiece_codec.codec(sentencepiece_codec.default_model())
    for t in [*(t or "" for t in TEXTS), "   a  b ", "▁▁x▁", "a" * 3000, " " * 77, "<s></s><unk>", "𝄞é퟿"]:
        ids = library.encode(t, add_eos=True)
        assert codec.encode(t) == ids == codec.encode_cached(t).tolist() and codec.decode(ids) == library.decode(ids)
    assert codec.decode([3 + 0xE6, 3 + 0x41]) == library.decode([3 + 0xE6, 3 + 0x41])
    out = {r.doc_id: r for r in sentencepiece_codec.round_trip(docs).collect()}
    ids = library.encode(TEXTS[9], add_eos=True)
    assert tuple(out[9])[1:] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert tuple(out[0])[1] == 1 and sentencepiece_codec.round_trip(nothing).count() == 0
    back = sentencepiece_codec.decode_documents(sentencepiece_codec.encode_documents(docs.filter("doc_id is not null"))).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((r[0], r[1] or "") for r in ROWS if r[0] is not None)


def test_importance_sampling(spark, docs, nothing):
    rows = [(k, (long_text(k, 50) if k % 4 else "### %%% &&& " * 20)) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = importance_sampling.sample(df, df.filter("doc_id % 4 <> 0 and doc_id < 40").select("doc_id"), keep=0.75).collect()
    assert sum(r.selected for r in out) == 60 and all(r.selected == (r.doc_id % 4 != 0) for r in out)
    # brute force: two multinomials over the hashed n-grams, the log of their ratio, the k largest keys
    every = sum(importance_sampling.ngram_counts(t) for _, t in rows) + 0.5
    good = sum(importance_sampling.ngram_counts(t) for k, t in rows if k % 4 and k < 40) + 0.5
    for r, (_, t) in zip(sorted(out), rows):
        ws = importance_sampling.ngram_counts(t)
        assert math.isclose(r.log_weight, sum(n * (math.log(good[b] / good.sum()) - math.log(every[b] / every.sum())) for b, n in enumerate(ws) if n), rel_tol=1e-9, abs_tol=1e-9)
    assert {r.doc_id for r in out if r.selected} == {r.doc_id for r in sorted(out, key=lambda r: -r.key)[:60]}
    same = spark.createDataFrame([(None, "one text")] * 10 + [(7, "two")] * 4, "doc_id long, text string")
    assert [sum(r.selected for r in importance_sampling.sample(same, df.select("doc_id"), keep=k / 14).collect()) for k in (0, 5, 13, 14)] == [0, 5, 13, 14]
    odd = importance_sampling.sample(docs, df.select("doc_id")).collect()
    assert len(odd) == len(ROWS) and not any(r.selected for r in odd if r.n_grams == 0)
    assert importance_sampling.sample(nothing, df.select("doc_id")).count() == 0
    keys = spark.createDataFrame([(float(k % 97),) for k in range(10_000)], "key double")
    assert importance_sampling.cut_for_top(keys, 2500, small=64) == sorted((float(k % 97) for k in range(10_000)), reverse=True)[2499]


def test_source_mixing(spark, docs, nothing):
    out = source_mixing.mix(docs, block_words=1).collect()
    sizes = Counter()
    for r in ROWS:
        sizes[r[3]] += len(words(r[1]))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    goal, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        for s in full or open_:
            goal[s] = 3 * sizes[s] if full else level * weight[s]
            left -= goal[s] if full else 0
        open_ -= full or open_
    source_of = {(r[0], len(words(r[1]))): r[3] for r in ROWS}
    taken = Counter()
    for r in out:
        s = source_of[(r.doc_id, r.size)]
        taken[s] += r.taken
        assert math.isclose(r.target, goal[s]) and r.source_size == sizes[s] and 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[s] - goal[s]) <= 1 for s in names)
    assert sorted(map(str, out)) == sorted(map(str, source_mixing.mix(docs.repartition(7), block_words=1).collect()))
    assert source_mixing.mix(nothing).count() == 0
    mixed = source_mixing.mixed_documents(docs, block_words=1)
    assert mixed.columns == docs.columns and sum(len(words(r.text)) for r in mixed.collect()) == sum(r.taken for r in out)


def highest_quotients(votes, seats):
    won = Counter()
    for _ in range(seats):
        best = max((p for p in votes if votes[p] > 0), key=lambda p: (votes[p] / (2 * won[p] + 1), -p))
        won[best] += 1
    return won


def test_seats_go_to_the_highest_quotients(spark):
    groups = {0: ([5, 3, 1, 0], 7), 1: ([1000, 1, 1, 1, 1, 1, 1], 12), 2: ([4, 4, 4, 4], 6), 3: ([10], 5), 4: ([7, 7, 2], 0), 5: (list(range(1, 60)), 301), 6: ([1] * 9, 4), 7: ([0, 0], 3), 8: ([0.3, 2.5, 99.75], 1000)}
    rows = [(g, p, float(v), seats) for g, (votes, seats) in groups.items() for p, v in enumerate(votes)]
    out = source_mixing.apportion(spark.createDataFrame(rows, "g long, p long, votes double, seats long"), "p", "votes", "seats", ("g",)).collect()
    for g, (votes, seats) in groups.items():
        assert {r.p: r.won for r in out if r.g == g and r.won} == dict(highest_quotients(dict(enumerate(votes)), seats if any(votes) else 0))


def test_source_mixing_by_shards(spark, docs):
    out = source_mixing.mix(docs, block_words=4, shard_words=50).collect()
    sizes, taken, goal = {}, Counter(), {}
    source_of = {(r[0], len(words(r[1]))): r[3] for r in ROWS}
    for r in out:
        s = source_of[(r.doc_id, r.size)]
        sizes[s], goal[s] = r.source_size, r.target
        taken[s] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    blocks = highest_quotients(dict(enumerate(goal[s] for s in names)), (sum(sizes.values()) + 2) // 4)
    assert all(3 * sizes[s] <= 4 * blocks[k] or taken[s] == 4 * blocks[k] or 3 * sizes[s] - taken[s] < 12 for k, s in enumerate(names))
    assert sorted(map(str, out)) == sorted(map(str, source_mixing.mix(docs.repartition(5), block_words=4, shard_words=50).collect()))


@pytest.mark.parametrize("name", ["op6_source_mixing", "op8_jaccard_join", "op10_quality_rules"])
def test_queries_equal_their_sql(spark, tmp_path, docs, name):
    import duckdb

    from millrace.llm import registry

    many = [(100 + k, f"{long_text(k % 37, 30 + k % 50)}\n{long_text(k % 11, 25)}", "en", "cd"[k % 2], 0) for k in range(300)]
    rows = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text", "lang", "source", "n_chars")
    rows.union(spark.createDataFrame(many, rows.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = con.sql(registry.ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(df.columns)
    plain = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert Counter(map(plain, df.select(*found.columns).collect())) == Counter(map(plain, found.fetchall()))


def test_url_filter(spark):
    urls = [None, "", "no scheme", "https://WWW.Example.ORG/en/1x?q#f", "https://example.org/es/a", "https://notexample.org/es/", "http://a.com/fr/b", "http://a.com/de/b?x=1&y=2", "http://com/de/", "http://x.net/en/12", "http://x.org", "http://u:p@y.org:80/p"] * 3
    df = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id long, url string, host string")
    out = {r.page_id: r for r in url_filter.judge(df, rounds=3).collect()}
    assert len(out) == len(urls)
    assert [(out[k].host, out[k].path, out[k].rule) for k in range(12)] == [
        ("", "", None), ("", "", None), ("", "", None), ("www.example.org", "/en/1x", "example.org/en/1"), ("example.org", "/es/a", "example.org/es/"), ("notexample.org", "/es/", "org/"), ("a.com", "/fr/b", "com/fr/"), ("a.com", "/de/b", "com/de/"), ("com", "/de/", "com/de/"), ("x.net", "/en/12", None), ("x.org", "", None), ("u:p@y.org:80", "/p", None)
    ]
    assert all(r.verdict in ("allow", "block") for r in out.values()) and out[4].verdict == "block" and out[6].verdict == "allow"
    assert url_filter.judge(df.filter("page_id < 0")).count() == 0
    # trees: on separable rows the margin separates
    many = spark.createDataFrame([(k, f"http://s{k % 7}.{'com' if k % 2 else 'org'}/{'de' if k % 2 else 'fr'}/" + "9" * (k % 2 * 12)) for k in range(200)] + [(1000 + k, f"http://z.net/{'9' * (k % 2 * 12)}") for k in range(10)], "page_id long, url string")
    verdicts = {r.page_id: r.verdict for r in url_filter.judge(many).filter("page_id >= 1000").collect()}
    assert all(verdicts[1000 + k] == ("block" if k % 2 else "allow") for k in range(10))


@pytest.mark.parametrize("n, least, block", [(3, 90, 2048), (5, 80, 2048), (3, 90, 2), (1, 60, 3)])
def test_jaccard_join(spark, docs, nothing, n, least, block):
    edits = [" ".join(w for j, w in enumerate(BASE.split()) if j != k) for k in range(0, 120, 9)] + [" ".join(BASE.split()[: 120 - k]) for k in range(0, 40, 4)]
    rows = [(r[0], r[1]) for r in ROWS if r[0] is not None] + [(100 + k, t) for k, t in enumerate(edits)]
    out = jaccard_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string"), words=n, least=least, task_sets=block).collect()

    def shingles(t):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= least * len(x | y):
                parent[root(a)] = root(b)
    groups = {}
    for k, (i, _) in enumerate(sets):
        groups.setdefault(root(k), []).append(i)
    want = Counter((i, len(s), min(groups[root(k)])) for k, (i, s) in enumerate(sets))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == want
    if block == 2048 and n == 3:
        assert jaccard_join.link_documents(docs).count() == len(ROWS) and jaccard_join.link_documents(nothing).count() == 0
        assert sorted(r.doc_id for r in jaccard_join.one_of_each_group(docs).filter("text is not null and doc_id is not null").collect() if r.text == BASE) == [5, 5]


def test_signatures_are_shuffled_in_packed_rows(spark):
    docs = spark.createDataFrame([(k, long_text(k // 2, 300)) for k in range(120)], "doc_id long, text string").repartition(3)
    sign, want = jaccard_join.Signatures(80), {}
    for k in range(60):
        s = jaccard_join.shingle_set(long_text(k, 300), 5)
        want[jaccard_join.set_hash(s)] = {int(x) >> 8 for x in sign.of(s, rare=s)}
    most = 9 * sum(map(len, want.values()))  # bytes, whatever the number of partitions; copies may lie in two blocks
    for partitions in ("4", "600"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            rows = jaccard_join.sets_and_signatures(docs, "doc_id", "text", 5, 80).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        name = {r.x: r.y for r in rows if r.kind == jaccard_join._NUMBER}
        packed = [r for r in rows if r.kind == jaccard_join._PACKED]
        assert sum(len(r.packed) for r in packed) < 2 * most
        found = {h: set() for h in want}
        for r in packed:
            for key, number in zip(*jaccard_join.unpacked(r.x, r.y, r.z, r.text_key, r.packed)):
                found[name[int(number)]].add(int(key))
        assert all(found[h] <= want[h] for h in want) and set().union(*found.values()) == set().union(*want.values())


def test_tables_leave_no_shuffle_files(spark):
    files = lambda: sum(f.getName().endswith(".data") for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    df, before = spark.range(1000).repartition(3, "id"), files()
    table = common.materialise(df, "shuffled")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and table.count() == 1000
    assert df.count() == 1000


def test_jaccard_join_reaches_through_rows_without_ids(spark):
    w = long_text(21, 200).split()
    a, b, c = " ".join(w[:100]), " ".join(w[4:104]), " ".join(w[8:108])
    rows = [(1, a), (None, b), (3, c), (None, c), (None, "alone"), (None, None), (9, None)]
    out = jaccard_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in out), key=str) == sorted([(1, 1), (None, 1), (3, 1), (None, 1), (None, None), (None, None), (9, 9)], key=str)


def test_unlike_texts_with_a_common_phrase_share_no_signature():
    texts = [f"{long_text(50 + k, 5)} all rights reserved by {long_text(9000 + k, 4)}" for k in range(3000)]
    notice = "permission is granted to copy this text in whole or in part as long as this notice stays with every copy of it " * 2
    texts += [f"{long_text(50 + k, 60)} {notice}" for k in range(500)]
    # where fewer shingles have to agree, those of a passage in many texts are set aside
    sets = [[jaccard_join.shingle_set(t, n) for t in texts] for n in (3, 5)]
    often = [h for h, c in Counter(h for s in sets[1] for h in s.tolist()).items() if c > 0.05 * len(texts)]
    for least, signed in ((90, [(s, len(s)) for s in sets[0]]), (80, [(np.setdiff1d(s, np.array(often, dtype=np.uint64)), len(s)) for s in sets[1]])):
        sign, met = jaccard_join.Signatures(least), {}
        for k, (s, size) in enumerate(signed):
            for x in sign.of(s, size).tolist():
                met.setdefault(x, set()).add(k)
        assert len(set().union(*(m for m in met.values() if len(m) > 1), set())) < 0.02 * len(texts)


def test_large_families_of_unlike_texts_part(spark):
    notice = "permission is granted to copy this text in whole or in part as long as this notice stays with every copy of it " * 3
    texts = [f"{long_text(50 + 977 * k, 40)} {notice}" for k in range(300)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts + [texts[7] + " end", texts[9] + " end"])], "doc_id long, text string")
    out = {r.doc_id: r.component_id for r in jaccard_join.link_documents(docs, words=5, least=80, task_sets=20).collect()}
    assert out == {k: k for k in range(300)} | {300: 7, 301: 9}


def test_forests_join_what_links_join():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 60, 50), rng.integers(0, 60, 50)
    least, other = jaccard_join.forest(a, b)

    def groups(links):
        of = {k: {k} for k in range(60)}
        for x, y in links:
            both = of[x] | of[y]
            for k in both:
                of[k] = both
        return {k: min(g) for k, g in of.items()}

    plain = groups(zip(a.tolist(), b.tolist()))
    assert groups(zip(least.tolist(), other.tolist())) == plain and len(other) == sum(k != low for k, low in plain.items())
    assert all(plain[k] == low for low, k in zip(least.tolist(), other.tolist()))


def test_components_of_chains_stars_and_loops(spark):
    rng = np.random.default_rng(6)
    names = rng.permutation(10**6)[:400].tolist()
    links = [(names[k], names[k + 1]) for k in range(150)] + [(names[200], names[201 + k]) for k in range(100)] + [(names[350], names[350]), (names[360], None)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: min(names[:151]) for k in names[:151]} | {k: min(names[200:301]) for k in names[200:301]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signatures_cover_every_pair_that_links():
    rng = np.random.default_rng(3)
    for least in (60, 80, 90):
        sign = jaccard_join.Signatures(least)
        for size in (2, 5, 9, 11, 20, 45, 150, 700):
            for _ in range(60):
                a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
                drop = rng.integers(0, max(1, size * (100 - least) // 100) + 1)
                add = rng.integers(0, 1 << 63, rng.integers(0, 3), dtype=np.uint64)
                b = np.unique(np.concatenate((a[drop:], add)))
                inter = len(np.intersect1d(a, b))
                if len(b) and 100 * inter >= least * (len(a) + len(b) - inter) and not np.array_equal(a, b):
                    assert np.intersect1d(sign.of(a), sign.of(b)).size, (least, size, drop)
                    rare = [x[x % np.uint64(3 + size % 4) != 0] for x in (a, b)]
                    assert np.intersect1d(sign.of(a, rare=rare[0]), sign.of(b, rare=rare[1])).size, (least, size, drop)


@pytest.mark.parametrize("rows_a_bucket, most_ranges", [(4, 1024), (1, 3), (2, 1), (1000, 1024)])
def test_fingerprints(spark, docs, nothing, rows_a_bucket, most_ranges):
    out = fingerprints.fingerprint_pairs(docs, rows_a_bucket=rows_a_bucket, most_ranges=most_ranges).collect()
    assert len(out) == len(ROWS)
    ordered = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want = Counter()
    for k, r in enumerate(ordered):
        t, after = r[1] or "", ordered[(k + 1) % len(ordered)][1] or ""
        cut = len(t) // 4
        want[(r[0], len(t), hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    same = {r.fingerprint for r in out if r.doc_id in (5, 6)}
    assert len(same) == 1 and fingerprints.fingerprint_pairs(nothing).count() == 0


def test_buckets_of_ids_grow_with_the_table(spark):
    ids = spark.range(40_000).select((F.col("id") * 3 - 50_000).alias("doc_id"))
    dealt = fingerprints._dealt(ids, 100, 8)
    sizes = dealt.groupBy("_bucket").count().collect()
    assert 350 <= len(sizes) <= 400 and max(r["count"] for r in sizes) <= 250
    ends = dealt.groupBy("_bucket").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).orderBy("_bucket").collect()
    assert all(x.b < y.a for x, y in zip(ends, ends[1:]))
    wide = spark.createDataFrame([(-(1 << 63),), ((1 << 63) - 1,), (None,), (0,)], "doc_id long")
    assert fingerprints._dealt(wide, 1, 2).select("_bucket").distinct().count() >= 3


def test_sketches_estimate(spark):
    a, b = long_text(1, 1200), long_text(1, 1200)
    b = " ".join(b.split()[:900]) + " " + long_text(99, 300)
    s = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    df = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    r = df.select(fingerprints.resemblance(F.col("a"), F.col("b")).alias("j"), fingerprints.containment(F.col("a"), F.col("b")).alias("c"), fingerprints.distinct_shingles(F.col("a")).alias("n")).first()
    assert abs(r.j - len(s(a) & s(b)) / len(s(a) | s(b))) < 0.15 and abs(r.c - len(s(a) & s(b)) / len(s(a))) < 0.2 and abs(r.n / len(s(a)) - 1) < 0.3
    parts = spark.createDataFrame([(1, a), (1, b), (1, a)], "g long, t string").select("g", fingerprints.sketch(F.col("t")).alias("s"))
    whole = df.select(fingerprints.merge(F.col("a"), F.col("b")).alias("m")).first().m
    assert fingerprints.merged_sketch(parts, ["g"], "s").first().s == whole


def plain_measures(t):
    w = words(t)
    repeated = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if repeated[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, nothing):
    ledger = quality_rules.measure(docs)
    out = quality_rules.apply_policy(ledger, "v1").collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == Counter((r[0], *plain_measures(r[1])) for r in ROWS)
    base = quality_rules.bits(quality_rules.POLICIES["base"])
    for r in out:
        assert bool(r.mask & base) == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (r.mask & quality_rules.bits(quality_rules.POLICIES["v1"]) == 0)
    told = {r.rule: r for r in quality_rules.ablation(ledger, "base").collect()}
    assert told["few_words"].failed == sum(r.n_words < 20 for r in out)
    assert told["few_words"].kept_without == sum(not r.mask & quality_rules.bits(("repeated_windows",)) for r in out)
    assert quality_rules.measure(nothing).count() == 0 and len(quality_rules.ablation(quality_rules.measure(nothing), "v1").collect()) == 8


def test_scratch_tables_go(spark):
    from millrace.llm.common import clear_scratch, materialise

    kept = materialise(spark.range(3).toDF("x"), "some")
    assert kept.count() == 3
    clear_scratch(spark)
    with pytest.raises(Exception):
        spark.read.parquet(kept.inputFiles()[0]).count()


def test_jaccard_join_of_wide_families_keeps_shingles_in_few_rows(spark, monkeypatch):
    """Sets of wide families are shuffled as texts: no table has a row for each of their shingles, and the groups are the same."""
    dice = random.Random(5)
    bases = [[f"w{dice.randrange(10**6)}" for _ in range(200)] for _ in range(2)]
    texts = [" ".join([*bases[k % 2][:at], f"x{k}", *bases[k % 2][at + 1 :]]) for k, at in ((k, dice.randrange(200)) for k in range(90))]
    tables = {}

    def kept(df, label, made=jaccard_join.materialise):
        out = made(df, label)
        tables[label] = max(tables.get(label, 0), out.count())
        return out

    monkeypatch.setattr(jaccard_join, "materialise", kept)
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = {r.doc_id: r.component_id for r in jaccard_join.link_documents(data, task_sets=20).collect()}
    assert seen == {k: k % 2 for k in range(90)}
    assert "wide" in tables and tables["wide"] <= 90 and "tokens" not in tables


def test_jaccard_join_counts_common_shingles_in_slots_that_grow(spark, monkeypatch):
    """A shingle of many texts stays apart from the mean of all however many there are."""
    assert [jaccard_join.slot_bits(n) for n in (0, 10**8, 10**9, 10**10, 10**12)] == [20, 21, 25, 25, 25]
    monkeypatch.setattr(jaccard_join, "_SLOT_TEXTS", 50)
    texts = [f"a b c {k} x{k} y{k}" for k in range(300)] + [None, ""]
    slots, total = jaccard_join.common_slots(spark.createDataFrame([(t,) for t in texts], "text string"), "text", 3)
    often = jaccard_join.shingle_set("a b c", 3)
    assert total == 300 * 4 and np.flatnonzero(slots).tolist() == jaccard_join._slot(often, len(slots)).tolist()


def test_lm_mixer_learns_from_all_rows(spark, monkeypatch):
    """The Newton step sees every learning row once, whatever the sample; it lowers the code length of texts whose halves are alike."""
    dice, stock = random.Random(6), ["".join(random.Random(k).choices("abcdefgh", k=5)) for k in range(60)]
    follow = {w: dice.sample(stock, 3) for w in stock}

    def text() -> str:
        words = [dice.choice(stock)]
        for _ in range(60):
            words.append(dice.choice(follow[words[-1]]))
        return " ".join(words)

    rows = [(k, text()) for k in range(400)]
    docs, seen = spark.createDataFrame(rows, "doc_id long, text string"), []
    step = mixing_model.Mixer.step
    monkeypatch.setattr(mixing_model.Mixer, "step", lambda self, sums: (seen.append(sums.copy()), step(self, sums))[1])
    after = {r.doc_id: r.bits_per_byte for r in mixing_model.score(docs, mixer_documents=5).collect() if r.held_out}
    learnt = [mixing_model.normal(t) for k, t in rows if zlib.crc32(str(k).encode()) % 10]
    monkeypatch.setattr(mixing_model.Mixer, "step", lambda self, sums: None)
    before = {r.doc_id: r.bits_per_byte for r in mixing_model.score(docs, mixer_documents=5).collect() if r.held_out}
    assert len(seen) == 1 and seen[0][4].sum() > 0
    assert sum(after.values()) < sum(before.values())
    words, times = np.unique(mixing_model.token_hashes(np.frombuffer(b"".join(learnt), dtype=np.uint8))[2], return_counts=True)
    coder = mixing_model.fitted_coder(words, times, learnt)
    mixer = mixing_model.Mixer(coder, np.zeros(int(mixing_model._OFFSETS[-1]), dtype=np.int16))
    sums = np.zeros((14, len(mixer.refine)))
    mixer.sums(mixing_model.Batch(coder, learnt), sums)
    bits = sum(int(np.minimum(coder.length[mixing_model.Batch(coder, [t]).symbols(coder).symbol], mixing_model.DEEP).sum()) for t in learnt)
    assert sums[4].sum() == bits * mixing_model._STEP / 4  # a quarter for each bit of an even guess


def test_lm_tables_and_sums_equal_those_of_plain_bits():
    """Symbols without their texts give the same contexts; tables and the Newton step's sums, bit by bit, are exact whatever the batches."""
    texts = [mixing_model.normal(t) for t in (long_text(1, 60), None, "", "a", "Zq üß x" + "y" * 40, long_text(2, 80), long_text(1, 60))]
    hashes, n = np.unique(mixing_model.token_hashes(np.frombuffer(b"".join(texts), dtype=np.uint8))[2], return_counts=True)
    coder = mixing_model.fitted_coder(hashes[n > 1], n[n > 1], texts)
    batch = mixing_model.Batch(coder, texts).symbols(coder)
    alone = [mixing_model.Batch(coder, [t]).symbols(coder) for t in texts]
    again = mixing_model.Symbols(coder, batch.symbol, batch.sizes)
    for k in range(3):
        assert (again.contexts[k] == np.concatenate([b.contexts[k] for b in alone])).all()
    for s in np.flatnonzero(again.symbol >= coder.base):  # a word starts: nothing of it has been seen
        assert again.contexts[2][s] == again.contexts[2][0]
    counts, apart = mixing_model.Counts(), mixing_model.Counts()
    counts.add(coder, again)
    for b in alone:
        apart.add(coder, b)
    want = np.zeros(len(counts.n), dtype=np.int64)
    bits = []
    for at, s in enumerate(batch.symbol):
        for d in range(min(mixing_model.DEEP, int(coder.length[s]))):
            slots = [int((int(c[at]) ^ int(coder.salt[d, s])) * 0x85EBCA6B % (1 << 32)) >> (32 - size) for c, size in zip(batch.contexts, mixing_model.SIZES)]
            bits.append((int(coder.bit[d, s]), slots))
            for low, slot in zip(mixing_model._OFFSETS, slots):
                want[2 * (int(low) + slot) + bits[-1][0]] += 1
    assert (counts.n == want).all() and (apart.n == want).all()

    mixer = mixing_model.Mixer(coder, mixing_model._states(counts.n))
    out, parted, plain = (np.zeros((14, len(mixer.refine))) for _ in range(3))
    mixer.sums(again, out)
    for b in alone:
        mixer.sums(b, parted)
    assert (out == np.rint(out)).all() and out[[0, 4, 5, 6, 7]].tolist() == parted[[0, 4, 5, 6, 7]].tolist()
    by_gate = [mixer_gates(x) for x in (out, parted)]
    assert np.array_equal(*by_gate)
    for bit, slots in bits:
        states = [int(t[x]) for t, x in zip(mixer.tables, slots)]
        gate, x = (states[1] & 7) << 3 | states[2] & 7, [(v >> 3) / 256 for v in states]
        total = sum(float(mixer.weights[k, gate]) * 256 * x[k] for k in range(3)) + float(mixer.weights[3, gate])
        p = 1 / (1 + math.exp(-total))
        spread = p * (1 - p)
        plain[:, gate * 33] += [bit - p, *((bit - p) * v for v in x), spread, *(spread * v for v in x), *(spread * x[i] * x[j] for i, j in mixing_model._PAIRS)]
    assert np.allclose(by_gate[0], plain[:, ::33], atol=0.02, rtol=1e-3)


def mixer_gates(sums: np.ndarray) -> np.ndarray:
    """The sums by gate, in whole units."""
    s = sums.reshape(14, 64, -1) / mixing_model._STEP
    units = np.repeat([1, 1, 1, 256], [1, 3, 1, 3])
    return np.concatenate((s[:8].sum(axis=2) / units[:, None], s[8:, :, 0] + s[8:, :, 1] / 65536)) - np.concatenate((np.zeros((1, 64)), s[1:4, :, 1] * (1 - 1 / 256), np.zeros((10, 64))))
