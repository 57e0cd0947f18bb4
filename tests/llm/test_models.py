import hashlib
import io
import math
import random
import tarfile
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from factweave.llm import boosting, language, lm, media, quality, tokens, toxicity
from factweave.llm.common import fold
from factweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, "s", len(t or ""), 0.5, 3) for d, t, lang in rows], SCHEMA)


def crc(d, m):
    return zlib.crc32(str(d).encode()) % m


def joined(spark, query, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES[query](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    return rows, labels


# tokens


def test_words_in_chunks(monkeypatch):
    column = pa.array(["One two", "", None, "three " * 50, "four"] * 7)
    whole = tokens.words(*tokens.raw(column))
    monkeypatch.setattr(tokens, "CHUNK", 64)
    parts = tokens.words(*tokens.raw(column))
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_words_and_shingles_equal_brute_force():
    texts = ["One  two\tTHREE", "", None, " \n ", "é É x y", "a b", "a B", "one two three four one two three"]
    h, bounds = tokens.words(*tokens.raw(pa.array(texts)))
    spoken = [w for t in texts for w in brute.words(t)]
    assert [int(b) for b in np.diff(bounds)] == [len(brute.words(t)) for t in texts]
    assert len(h) == len(spoken) and len(set(zip(h.tolist(), spoken, strict=True))) == len(set(spoken)) == len(set(h.tolist()))
    _, off = tokens.shingles(h, bounds, 3)
    assert np.diff(off).tolist() == [len(brute.shingle_set(t, 3)) for t in texts]


# toxicity and quality


def test_boosting_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = boosting.fit(x[:600], y[:600])
    assert ((model.margin(x[600:]) > 0) == y[600:]).mean() > 0.9
    knots, values = boosting.isotonic(model.margin(x[600:]), y[600:])
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all()
    assert boosting.isotonic(np.array([1.0, 2, 3, 4]), np.array([0, 1, 0, 1]))[1].tolist() == [0, 0.5, 0.5, 1]


def test_plain_forms():
    assert toxicity.unmasked("1d10t!!") == "idiot" and toxicity.plain("sooo...") == "so"
    assert toxicity.tokens_of("an i d i o t here") == ["an", "idiot", "here"]


@pytest.mark.parametrize(("query", "label", "folds", "held"), [("op3_toxicity", "toxic", 5, 0), ("op5_quality", "quality", 3, 1)])
def test_held_out_accuracy(spark, query, label, folds, held):
    rows, labels = joined(spark, query, label)
    assert all(r.held_out == (crc(r.doc_id, folds) == held) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    mine = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in mine) / len(mine) > 0.93


def test_toxicity_edges(spark):
    docs = frame(spark, [(1, None, "en"), (2, "", "en"), (3, "x " * 60000, "en"), (None, "you idiot", None), (4, "fine words", "de")] * 2)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.drop_toxic(docs, none).count() == 10
    labels = spark.createDataFrame([(1, 0, 0), (2, None, None), (None, 1, 1), (4, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 10
    assert toxicity.drop_toxic(docs.limit(0), labels).count() == 0
    model = quality.fit(docs, labels, F.lit(True))
    assert quality.score(docs, model).count() == 10 and quality.score(docs.limit(0), model).count() == 0


def test_planted_toxic_documents_go_and_clean_ones_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels, F.lit(True))
    clean = [r.text for r in docs.join(labels.where("toxic = 0 and quality = 1"), "doc_id").limit(60).collect()]
    rng = random.Random(2)
    dirty = []
    for t in clean:
        w = t.split()
        for _ in range(max(3, len(w) // 20)):
            w.insert(rng.randrange(len(w) + 1), rng.choice(["idiot", "stupid", "moron", "scum", "trash"]))
        dirty.append(" ".join(w))
    assert (model.score(clean) < 0.5).mean() > 0.97 and (model.score(dirty) >= 0.5).mean() > 0.95


# language models


def spoken(text):
    return [*brute.words(text), "\0"]


def test_lm_equals_brute_force(spark, monkeypatch):
    for name, size in (("BLOCK_BYTES", 3000), ("CHUNK_BYTES", 700), ("RANGE_BYTES", 2000)):
        monkeypatch.setattr(lm, name, size)
    rng = random.Random(6)
    vocabulary = [f"W{i}" for i in range(60)]
    texts = [" ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(60)], k=rng.randint(0, 60))) for _ in range(220)] + [None, "", "  ", "New words only", "w1 " * 9000]
    rows = list(enumerate(texts))
    model = lm.Model(frame(spark, [(d, t, "en") for d, t in rows]), fold("doc_id", 7) != 2)
    learn = [t for d, t in rows if crc(d, 7) != 2]
    one = Counter(w for t in learn for w in spoken(t))
    two = Counter(p for t in learn for p in zip(["\1", *spoken(t)], spoken(t)))
    before = Counter(w for t in learn for w in ["\1", *spoken(t)[:-1]])
    n, v = sum(one.values()), len(one)
    assert (model.tokens_n, model.kinds_n, model.texts_n) == (n, v, len(learn))
    weights = model.weights
    bucket = lambda h: min(lm.BUCKETS - 1, int(math.log2(h)) + 1) if h else 0
    got = {r.id: r for r in model.score().collect()}
    for d, t in rows:
        s = spoken(t)
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in s)
        full = 0.0
        for a, b in zip(["\1", *s], s):
            w1 = weights[0][bucket(n)]
            p = w1 * one[b] / n + (1 - w1) / (v + 1)
            h = before[a]
            w2 = weights[1][bucket(h)] if h else 0
            p = w2 * (two[a, b] / h if h else 0) + (1 - w2) * p
            full += math.log10(p)
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(s), sum(one[w] > 0 for w in s), n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(full)


def em_by_hand(texts, order):
    """Weights by deleted estimation with exact probabilities, one order upon the other."""
    grams, heads = [Counter() for _ in range(order)], [Counter() for _ in range(order)]
    lines = [(["\1"] * (order - 1), spoken(t)) for t in texts]
    for pad, s in lines:
        line = pad + s
        for i in range(order - 1, len(line)):
            for n in range(order):
                grams[n][tuple(line[i - n : i + 1])] += 1
                heads[n][tuple(line[i - n : i])] += 1
    tokens_of = [(pad + s, i) for pad, s in lines for i in range(order - 1, len(pad + s))]
    low = np.full(len(tokens_of), 1 / (len(grams[0]) + 1))
    weights = []
    for n in range(order):
        h = np.array([heads[n][tuple(line[i - n : i])] - 1 for line, i in tokens_of])
        p = np.array([(grams[n][tuple(line[i - n : i + 1])] - 1) / max(1, heads[n][tuple(line[i - n : i])] - 1) for line, i in tokens_of])
        b, w = lm.buckets(h), np.full(lm.BUCKETS, 0.5)
        for _ in range(50):
            share = w[b] * p / np.maximum(w[b] * p + (1 - w[b]) * low, 1e-300)
            for k in set(b.tolist()):
                w[k] = min(0.999, share[b == k].mean())
        w[0] = 0
        low = w[b] * p + (1 - w[b]) * low
        weights.append((w, set(b.tolist())))
    return weights


def test_lm_weights_equal_expectation_maximisation_by_hand(spark, monkeypatch):
    rng = random.Random(8)
    follows = {i: rng.choices(range(40), k=4) for i in range(40)}
    texts = []
    for _ in range(150):
        w = [rng.randrange(40)]
        for _ in range(rng.randint(5, 60)):
            w.append(rng.choice(follows[w[-1]]) if rng.random() < 0.8 else rng.randrange(40))
        texts.append(" ".join(f"w{x}" for x in w))
    monkeypatch.setattr(lm, "BIN", 0.02)  # as good as exact
    model = lm.Model(frame(spark, [(d, t, "en") for d, t in enumerate(texts)]), F.lit(True), order=3)
    for n, (w, used) in enumerate(em_by_hand(texts, 3)):
        for k in used - {0}:
            assert model.weights[n][k] == pytest.approx(w[k], abs=1e-3)


def test_lm_repeated_rows(spark):
    rows = [(1, "a b c", "en"), (2, "a b d", "en"), (3, None, "en")]
    got = [(r.id, r.train_tokens, round(r.score, 9)) for r in lm.Model(frame(spark, rows * 4), F.lit(True), order=3).score().collect()]
    assert len(got) == 12 and len(set(got)) == 3 and {n for _, n, _ in got} == {4 * 9}


def test_lm_beats_its_base_on_held_out_documents(spark):
    rows = QUERIES["op6_lm_scoring"](spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if crc(r.doc_id, 7) == 2}
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_query_knows_word_triples(spark, tmp_path):
    """Only the word before the last two tells b from d."""
    texts = {i: ("a x b", "c x d")[i % 2] for i in range(400) if crc(i, 7) != 2}
    alike, mixed = [i for i in range(400, 900) if crc(i, 7) == 2][:2]
    frame(spark, [(d, t, "en") for d, t in {**texts, alike: "a x b", mixed: "a x d"}.items()]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.score for r in QUERIES["op6_lm_scoring"](spark, str(tmp_path)).collect()}
    assert got[alike] - got[mixed] > 0.5


def test_lm_is_a_distribution_and_edges(spark):
    t = lm.Totals([np.array([2, 2, 2, 0])], [np.full(4, 6)])
    weights = np.full((1, lm.BUCKETS), 0.7)
    p = lm.mixed(lm.estimates(t, 3), t, weights).sum()
    assert p == pytest.approx(1.0)
    assert lm.Model(frame(spark, []), F.lit(True)).score().count() == 0
    (only,) = lm.Model(frame(spark, [(1, "a b", "x")]), F.lit(False)).score().collect()
    assert (only.n_tokens, only.n_known, only.train_tokens, only.base_score, only.score) == (3, 0, 0, 0, 0)


def test_packed_keys_and_counts():
    rng = np.random.default_rng(3)
    for n in (0, 1, 500):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (lm.unpack(lm.pack(keys)) == keys).all()
        counts = rng.integers(0, 400, n)
        assert (lm.large(lm.small(counts)) == counts).all()


# language identification


def test_language_held_out(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op9_language_id"](spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 and r.held_out == (crc(r.doc_id, 4) == 2) for r in rows) and len(rows) == len(lang)


def test_language_edges(spark):
    rows = [(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de") for i in range(80)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "123 !!", None), (103, "der hund " * 30000, None), (None, "the cat", "en"), (105, "\U0001f600", "en")]
    model = language.fit(frame(spark, rows), F.lit(True))
    got = {r.id: r for r in language.predict(frame(spark, rows), model).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102, 103, None, 105, 1, 2)] == ["und", "und", "und", "de", "en", "und", "en", "de"]
    assert got[100].score == 0 and got[103].score > 0.9
    empty = language.fit(frame(spark, []), F.lit(True))
    assert language.predict(frame(spark, rows[:2]), empty).first().lang_pred == "und"
    assert language.predict(frame(spark, []), model).count() == 0


TEXTS = {"en": ["the cat sat on the mat", "a cat and the dog", "the other hat"], "de": ["der hund und die katze", "das haus, der Hof", "Öl und Äther"], "fr": ["le chat noir"]}


def language_model():
    code, _ = language.characters([t for ts in TEXTS.values() for t in ts])
    alphabet = np.unique(code)
    counts = {}
    for i, ts in enumerate(TEXTS.values()):
        own, off = language.characters(ts)
        counts[i] = np.unique(language.grams(language.numbered(own, alphabet), off, language.ORDER, language.blank_of(alphabet)), return_counts=True)
    levels = language.kneser_ney(counts, len(TEXTS), len(alphabet))
    return language.Model(list(TEXTS), alphabet, levels, 1.0, np.full(len(TEXTS), np.inf))


def test_kneser_ney_sums_to_one_in_every_context():
    model = language_model()
    every = np.arange(len(model.alphabet) + 1, dtype=np.uint64)  # with the unknown character
    rng = random.Random(1)
    seen = {int(g) >> language.BITS for t in TEXTS["en"] + TEXTS["de"] for g in model.packed(*language.characters([t]))}
    contexts = [*seen, *(rng.randrange(1 << 3 * language.BITS) for _ in range(50)), *(sum(rng.randrange(len(every)) << language.BITS * k for k in range(3)) for _ in range(200))]
    for c in contexts:
        total = (10.0 ** model.log_probabilities((np.uint64(c) << np.uint64(language.BITS)) | every).astype(float)).sum(0)
        assert np.abs(total - 1).max() < 1e-6


def by_dictionaries(texts, alphabet_n):
    """Interpolated Kneser-Ney of one language as dictionaries: probability(context, character)."""
    top = Counter()
    for t in texts:
        line = " " * (language.ORDER - 1) + "".join(chr(c) for c in language.characters([t])[0])
        top.update(line[i : i + language.ORDER] for i in range(len(line) - language.ORDER + 1))
    levels = {language.ORDER: top}
    for n in range(language.ORDER - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    cuts = {n: min(0.95, max(0.1, (ones := sum(v == 1 for v in c.values())) / max(1, ones + 2 * sum(v == 2 for v in c.values())))) for n, c in levels.items()}

    def probability(context, char):
        p = 1 / (alphabet_n + 1)
        for n in range(1, language.ORDER + 1):
            head = context[len(context) - n + 1 :]
            after = {g[-1]: v for g, v in levels[n].items() if g[:-1] == head}
            total = sum(after.values())
            if total:
                p = max(after.get(char, 0) - cuts[n], 0) / total + cuts[n] * len(after) / total * p
        return p

    return probability


def test_kneser_ney_equals_dictionaries():
    model = language_model()
    asked = ["the dog sat", "die Katze im Haus", "zyx qq", "le chat", "\u4e2d\u6587 x", ""]
    got = model.entropies(*language.characters(asked))
    for i, ts in enumerate(TEXTS.values()):
        probability = by_dictionaries(ts, len(model.alphabet))
        for t, h in zip(asked, got[:, i], strict=True):
            line = " " * (language.ORDER - 1) + "".join(chr(c) for c in language.characters([t])[0])
            each = [-math.log10(probability(line[k - language.ORDER + 1 : k], line[k])) for k in range(language.ORDER - 1, len(line))]
            assert h == pytest.approx(sum(each) / len(each) if each else 0, abs=1e-5)


def test_language_sample_is_shared_out():
    assert language.quotas({"en": 10**9, "de": 10, "fr": 500}, 300) == {"de": 10, "fr": 145, "en": 145}
    assert language.quotas({}, 5) == {}


def test_language_repeated_rows(spark):
    rows = [(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de") for i in range(40)]
    model = language.fit(frame(spark, rows * 3), F.lit(True))
    got = language.predict(frame(spark, rows * 3), model).collect()
    assert len(got) == 120 and all(r.lang_pred == ("en" if r.id % 2 else "de") for r in got)


# media columns


def test_media_round_trip(spark):
    texts = ["", None, "a", "x" * 576, "y" * 577, "é" * 40000, "a", "\U0001f600"]
    rows = list(enumerate(texts))
    catalog, folder = media.media_table(frame(spark, [(d, t, "en") for d, t in rows]))
    got = {r.id: r for r in media.with_samples(catalog, folder).collect()}
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    for d, t in rows:
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.width * r.height, r.depth) == (len(data), len(payload), len(payload), 8)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        assert r.media_sha256 == r.stored_sha256
        with fs.open_input_file(f"{path}/{r.shard}") as file:
            whole = file.read()
        assert hashlib.sha256(whole[r.offset : r.offset + r.length]).hexdigest() == r.media_sha256
        with tarfile.open(fileobj=io.BytesIO(whole)) as tar:
            assert any(m.offset_data == r.offset and m.size == r.length and m.name == f"{r.media_sha256}.png" for m in tar.getmembers())
    assert got[0].media_sha256 == got[1].media_sha256 and got[2].feature == got[6].feature
    catalog, folder = media.media_table(frame(spark, []))
    assert media.with_samples(catalog, folder).count() == 0


def media_by_hand(text):
    """All columns of the query from the text alone, without arrays."""
    data = (text or "").encode()
    payload = data + b"\xff" * (-len(data) % 576 if data else 576)
    lines = b"".join(b"\0" + payload[i : i + 576] for i in range(0, len(payload), 576))
    png = b"\x89PNG\r\n\x1a\n"
    for kind, body in ((b"IHDR", (576).to_bytes(4, "big") + (len(payload) // 576).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])), (b"IDAT", zlib.compress(lines, 1)), (b"IEND", b"")):
        png += len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    mean, cell = sum(payload) / len(payload), len(payload) // 64
    spread = math.sqrt(sum((x - mean) ** 2 for x in payload) / len(payload))
    bits = "".join(str(int(sum(payload[i * cell : (i + 1) * cell]) / cell > mean)) for i in range(64))
    return (
        len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(png), hashlib.sha256(png).hexdigest(),
        f"{mean:.4f}:{spread:.4f}:{int(bits, 2):016x}", 576, len(payload) // 576,
    )


MEDIA_COLUMNS = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")


def test_media_query(spark):
    rows = QUERIES["op7_media_columns"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in MEDIA_COLUMNS) == media_by_hand(texts[r.doc_id]), r.doc_id


def test_media_query_of_rows_that_repeat(spark, tmp_path):
    texts = [None, "", "tie", "tie", "\U0001f600 " * 700, "x" * 576, "x" * 576]
    rows = [(i % 5, t, "clash") for i, t in enumerate(texts)] * 2
    spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op7_media_columns"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, *(r[c] for c in MEDIA_COLUMNS)) for r in got) == sorted((d, *media_by_hand(t)) for d, t, _ in rows)
