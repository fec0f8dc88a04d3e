"""The quality network and language profiles on held-out rows; tokens and shards as exact round trips."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from sylva.llm import quality_cnn, queries, rank_profiles, tiered_shards, token_arrow

SF = "/root/testdata/sf0.01"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def crc(i):
    return zlib.crc32(str(i).encode())


def test_quality_of_held_out_rows(spark):
    rows = queries.op1_quality_cnn(spark, SF).collect()
    assert len(rows) == 1000 and all(r.held_out == (crc(r.doc_id) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    score = {r.doc_id: r.score for r in rows if r.held_out}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.doc_id in score}
    good, bad = ([score[i] for i in label if label[i] == y] for y in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95 and np.mean([g >= 0.5 for g in good]) > 0.95


def test_gradients():
    net = quality_cnn.ByteConvNet(quality_cnn.Shape(embedding=3, window=4, stride=2, filters=5, hidden=4, chunk=6, step=4), 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["c"] += 0.1  # away from the kink at which an empty text stands
    bufs = [np.frombuffer(t, np.uint8) for t in (b"some bytes of a text that is longer", b"ab", b"", b"another one, another one")]
    y, w = np.array([1, 0, 1, 0], np.float32), np.array([1, 2, 1, 0.5], np.float32)

    def loss():
        z = net.scores(np.array([net.pooled(b) for b in bufs]))
        return -np.mean(w * (y * np.log(z) + (1 - y) * np.log(1 - z)))

    g = net._backward(bufs, y, w)
    for k in net.p:
        flat, gf = net.p[k].reshape(-1), g[k].reshape(-1)
        for i in np.argsort(-np.abs(gf))[:4]:
            old, h = flat[i], 1e-6
            flat[i] = old + h
            up = loss()
            flat[i] = old - h
            down = loss()
            flat[i] = old
            assert (up - down) / (2 * h) == pytest.approx(gf[i], rel=1e-3, abs=1e-6)


def test_strips_do_not_matter():
    net, buf = quality_cnn.ByteConvNet(seed=2), np.random.default_rng(0).integers(0, 256, 50_001).astype(np.uint8)
    assert np.allclose(net.pooled(buf, 1 << 10), net.pooled(buf, 1 << 24), atol=1e-5)


def test_forward_pass_against_loops():
    shape = quality_cnn.Shape(embedding=3, window=5, stride=2, filters=4, hidden=3, chunk=6, step=4)
    net = quality_cnn.ByteConvNet(shape, seed=3)
    p = {k: v.astype(float) for k, v in net.p.items()}
    for text in (b"a", b"abcde", b"The quick brown fox", "é漢字 and some more bytes than a chunk holds, twice over".encode() * 3):
        n = max(1, -(-max(0, len(text) - 5) // 2) + 1)
        padded = text + bytes((n - 1) * 2 + 5 - len(text))
        act = [[max(0.0, sum(p["E"][padded[2 * w + j]][e] * p["W"][3 * j + e][f] for j in range(5) for e in range(3)) + p["b"][f]) for f in range(4)] for w in range(n)]
        chunks = [act[a : a + 6] for a in range(0, max(1, n - 2), 4)]
        best = [[max(w[f] for w in c) for f in range(4)] for c in chunks]
        x = [max(c[f] for c in best) for f in range(4)] + [sum(c[f] for c in best) / len(best) for f in range(4)] + [min(c[f] for c in best) for f in range(4)] + [np.log1p(len(text)) / 8]
        hidden = [max(0.0, sum(x[i] * p["H"][i][h] for i in range(13)) + p["c"][h]) for h in range(3)]
        want = 1 / (1 + np.exp(-(sum(hidden[h] * p["o"][h] for h in range(3)) + p["d"][0])))
        assert net.scores(net.pooled(np.frombuffer(text, np.uint8), strip=16)[None])[0] == pytest.approx(want, abs=1e-5)


def test_training_rows_are_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_cnn.ByteConvNet, "fit", lambda self, texts, labels, **o: seen.append((texts, labels)) or self)
    rows = [(i % 20, f"text {i % 40}") for i in range(400)]
    quality_cnn.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, label int"), max_rows=12, max_bytes=70)
    (texts, labels), = seen
    assert 5 <= len(texts) <= 12 and len(set(texts)) == len(texts) and sum(map(len, texts)) <= 70 and len(labels) == len(texts)


def test_quality_of_odd_rows(spark, odd, none, odd_rows):
    labels = spark.createDataFrame([(6, 1), (15, 0), (16, 1), (None, 1), (3, None)], "doc_id long, label int")
    net = quality_cnn.train(odd, labels, epochs=1)
    got = quality_cnn.score(odd, net).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got) and quality_cnn.score(none, net).collect() == []
    assert quality_cnn.keep_good(odd, net, 0.0).count() == len(odd_rows) and quality_cnn.keep_good(odd, net).columns == odd.columns
    assert quality_cnn.train(none, labels).scores(np.zeros((1, 97))) == 0.5


def test_languages_of_held_out_rows(spark):
    rows = queries.op7_rank_profiles(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert len(rows) == 1000 and all(r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97


def plain_grams(text):
    words = "".join(c.lower() if c.isalpha() else " " for c in text).split()
    out = Counter()
    for w in words:
        w = f" {w} "
        out.update(w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1) if w[i : i + n].strip() or n == 2)
    return Counter({g: c for g, c in out.items() if g.strip() and not (len(g) == 3 and g[1] == " ")})


def test_grams_against_counting():
    text = "Für é straße, straße und-über 12 x!"
    keys, counts = rank_profiles.grams(text)
    said = {"".join(" " if c == 1 else chr(c) for c in (k >> 42, (k >> 21) & 0x1FFFFF, k & 0x1FFFFF) if c): int(n) for k, n in zip(keys.tolist(), counts)}
    assert {k: v for k, v in said.items()} == plain_grams(text)


def test_out_of_place_distance_against_loops():
    texts = {"aa": "the cat sat on the mat the cat", "bb": "der hund und die katze und der hund", "cc": "the cat sat on the mat the cat"}
    size = 12
    code = lambda g: sum((1 if c == " " else ord(c)) << (21 * i) for i, c in enumerate(reversed(g)))
    order = lambda t: [code(g) for g, _ in sorted(plain_grams(t).items(), key=lambda x: (-x[1], code(x[0])))][:size]
    profiles = rank_profiles.Profiles({k: order(t) for k, t in texts.items()}, size)
    for text in ("the mat", "und katze", "xyz", "the und", "cat"):
        own = order(text)
        want = {k: sum(abs(order(t).index(g) - r) if g in order(t) else size for r, g in enumerate(own)) / len(own) / size for k, t in texts.items()}
        assert profiles.distances(text).tolist() == pytest.approx([want[k] for k in sorted(want)])
        lang, score = profiles.predict(text)
        assert lang == min(want, key=lambda k: (want[k], k))  # a tie goes to the first name
        near = [np.exp(-20 * (d - min(want.values()))) for d in want.values()]
        assert score == pytest.approx(max(near) / sum(near))


def test_profiles_learn_from_no_more_than_asked(spark):
    seen = {}
    rows = [(i, f"w{'abcdefgh'[i % 8]}", "en" if i % 3 else "de") for i in range(600)]
    for most in (1, 7, 100, 10_000):
        profiles = rank_profiles.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_docs=most)
        seen[most] = {name: len(profiles.keys[(profiles.ranks[:-1, i] >= 0)]) for i, name in enumerate(profiles.names)}
    assert set(seen[1]) == {"en", "de"}
    assert all(n == 7 for n in seen[1].values()) and all(n <= 2 + 5 * 7 for n in seen[7].values())  # "wa" has seven n-grams, five of its own


def test_languages_of_odd_rows(spark, odd, none, odd_rows):
    profiles = rank_profiles.learn(odd)
    got = {r.doc_id: r for r in rank_profiles.identify(odd, profiles).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 17)] == ["und"] * 4 and got[0].score == 0 and got[6].lang_pred in ("en", "de")
    assert rank_profiles.identify(odd, rank_profiles.learn(none)).filter("lang_pred <> 'und'").count() == 0
    assert rank_profiles.identify(none, profiles).collect() == []


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


def test_pieces_have_the_ids_of_the_text():
    texts = [" lead", "trail ", "two  blanks", "a \n b\n\n  c", "tab\t x", "nb  sp  x", "\x1c x \x1f y", "it's we'll  'd", "x<|endoftext|> y <|endoftext|>", "é漢字 12 ½ ² a1b2", "　 z", "   ", "\n", "a\r\n b \r\n\r\n c", "", "​ ﻿ x", "\x85 y\x85\x85 z"]
    encode = token_arrow.Encoder(TOKENIZER)
    got = [np.frombuffer(b, encode.width).tolist() for b in encode(texts)]
    assert [x + [0] for x in got] == reference_ids(texts)
    column = encode.column(pa.array([*texts, None]))
    assert [np.frombuffer(b, encode.width).tolist() + [0] for b in column] == reference_ids([*texts, None])


def test_tokens_round_trip(spark, tmp_path):
    rows = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())[:300]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    ids = reference_ids([r.text for r in rows])
    folder = f"file://{tmp_path}/tokens"
    manifest = token_arrow.write(frame, TOKENIZER, folder, seq_len=64, rows=4, partitions=3)
    got = sorted(token_arrow.read_documents(manifest, folder).collect())
    start, expected = 0, []
    for r, x in zip(rows, ids):
        expected.append((r.doc_id, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert [tuple(r) for r in got] == expected
    whole, files = [], sorted(manifest.collect())
    for f in files:
        with pa.memory_map(f.path) as source:
            sequences = token_arrow.Sequences(source)
            assert len(sequences) == f.n_sequences
            order = list(range(len(sequences)))
            for i in order[::-1]:
                tokens, mask = sequences[i]
                assert len(tokens) == len(mask) == 64 and (mask.all() or i == order[-1])
            whole += [x for i in order for x in sequences[i][0][sequences[i][1]].tolist()]
    assert whole == [t for x in ids for t in x]


def test_tokens_of_odd_rows(spark, odd, none, odd_rows):
    got = token_arrow.tokenized(odd, TOKENIZER, seq_len=32, rows=2).collect()
    expected = Counter((r[0], len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, x in zip(odd_rows, reference_ids([r[1] for r in odd_rows])))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == expected
    assert token_arrow.tokenized(none, TOKENIZER).collect() == []


def test_shards_round_trip(spark):
    rows = queries.op6_sharding(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.text_crc32 for r in rows} == {i: zlib.crc32(t.encode()) for i, t in texts.items()} and len(rows) == len(texts)


def test_shards_grow_by_tiers(spark, tmp_path):
    store = tiered_shards.TieredShards(spark, f"file://{tmp_path}/s", target_bytes=40_000, fanout=2)
    for i in range(9):
        store.append(spark.range(i * 1000, i * 1000 + 1000).repartition(1))
        store.compact()
        tiers = Counter(store.tier(s) for s in store.shards())
        assert all(n < 2 for t, n in tiers.items() if t >= 0) and all(s.n_bytes < 40_000 * 1.5 for s in store.shards())
    assert sorted(r.doc.id for r in store.read().collect()) == list(range(9000))
    over = store.version()
    with pytest.raises(tiered_shards.Conflict):
        store.commit([], over - 1)
    assert store.version() == over
    sizes = defaultdict(int)
    for s in store.shards():
        sizes[s.path] += s.n_bytes
    assert len(sizes) == len(store.shards()) and store.shards(1) != store.shards()


def test_old_versions_stay_until_they_expire(spark, tmp_path):
    store = tiered_shards.TieredShards(spark, f"file://{tmp_path}/s", target_bytes=1 << 20, fanout=3)
    for i in range(3):
        store.append(spark.range(i * 10, i * 10 + 10).repartition(1))
    store.compact(final=True)
    assert store.version() == 4 and len(store.shards()) == 1
    for v in (1, 2, 3, 4):
        assert sorted(r.doc.id for r in store.read(v).collect()) == list(range(10 * min(v, 3)))
    store.expire(keep=2)
    assert sorted(r.doc.id for r in store.read(3).collect()) == sorted(r.doc.id for r in store.read().collect()) == list(range(30))
    assert len(list(tmp_path.glob("s/manifest/v*"))) == 2
    store.expire()
    assert len(list(tmp_path.glob("s/data/**/*.parquet"))) == 1 and store.read().count() == 30


def test_a_writer_that_comes_second_tries_again(spark, tmp_path, monkeypatch):
    store, other = (tiered_shards.TieredShards(spark, f"file://{tmp_path}/s", target_bytes=1 << 20, fanout=9) for _ in range(2))
    store.append(spark.range(3).repartition(1))
    real, once = tiered_shards.TieredShards.commit, []

    def late(self, shards, over):
        if self is store and not once:
            once.append(1)
            other.append(spark.range(100, 103).repartition(1))
        return real(self, shards, over)

    monkeypatch.setattr(tiered_shards.TieredShards, "commit", late)
    store.append(spark.range(10, 13).repartition(1))
    assert sorted(r.doc.id for r in store.read().collect()) == [0, 1, 2, 10, 11, 12, 100, 101, 102]
    once.clear()
    store.compact(final=True)
    assert sorted(r.doc.id for r in store.read().collect()) == [0, 1, 2, 10, 11, 12, 100, 100, 101, 101, 102, 102]


def test_names_of_columns_do_not_matter(spark, tmp_path):
    rows = [(i, "t", i, "f", 7, 8, "g") for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _group int, _file string, shard int, shard_bytes long, _Group_ string")
    got = tiered_shards.shard(frame, f"file://{tmp_path}/s", arrivals=3)
    assert sorted(tuple(r.doc) for r in got.collect()) == rows and got.select("doc.*").columns == frame.columns


def test_groups_are_as_a_plain_packing(spark, tmp_path):
    store = tiered_shards.TieredShards(spark, f"file://{tmp_path}/s", target_bytes=64 << 20, fanout=4)
    rng = np.random.default_rng(2)
    shards = [tiered_shards.Shard(f"f{i}", int(x)) for i, x in enumerate(np.exp(rng.uniform(8, 18.2, 200)))]
    groups = store.groups(shards)
    for g in groups:
        assert len(g) > 1 and len({store.tier(s) for s in g}) == 1 and sum(s.n_bytes for s in g) <= 64 << 20
    left = Counter(store.tier(s) for s in {*shards} - {s for g in groups for s in g} if s.n_bytes * 2 <= 64 << 20)
    assert all(n < 4 for n in left.values())  # what stays is too few for a tier, or the last one packed alone
    whole = store.groups(shards, True)
    assert sum(s.n_bytes for g in whole for s in g) >= sum(s.n_bytes for s in shards if s.n_bytes * 2 <= 64 << 20) - (64 << 20)


def test_shards_of_odd_rows(spark, odd, none, odd_rows):
    got = tiered_shards.shard(odd, arrivals=2, target_bytes=1 << 20)
    assert Counter(tuple(r.doc) for r in got.collect()) == Counter(odd_rows)
    assert tiered_shards.shard(none).collect() == []
