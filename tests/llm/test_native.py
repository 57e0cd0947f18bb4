import hashlib
import math
import random
import re
import unicodedata
from collections import defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from factweave.llm import fingerprint, mixing, pii
from factweave.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rk string, copies int, spans int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), "x", 1, 2) for d, t, s in rows], SCHEMA)


@pytest.fixture
def table(spark, tmp_path):
    def write(rows):
        frame(spark, rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
        return str(tmp_path)

    return write


# fingerprints


def test_fingerprints(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: r for r in QUERIES["op2_fingerprints"](spark, sf).collect()}

    def canon(t):
        c = lambda x: unicodedata.normalize("NFKC", x)
        return re.sub(r"[ \t\n\x0b\f\r]+", " ", c(c(t).lower())).strip(" ")

    assert len(got) == len(rows)
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == float(canon(t) == canon(edited)) and r.near_next == float(canon(t) == canon(after))
    names = defaultdict(set)
    for d, t in rows:
        names[got[d].fingerprint].add(canon(t))
    assert all(len(x) == 1 for x in names.values()) and len(names) == len({canon(t) for _, t in rows})


def test_canonical_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET", 2)
    texts = ["Straße  1", "STRAßE\n1 ", "ﬁne", "FINE", None, "", "éa", "éa", "x" * 50000, "a", "\U0001f600b", "b"]
    rows = [(i if i % 5 else None, t, "s") for i, t in enumerate(texts)] + [(3, "b", "s"), (3, "b", "s")]
    got = fingerprint.edited_fingerprints(frame(spark, rows)).collect()
    order = sorted(((d is not None, d or 0, t or "") for d, t, _ in rows))
    want = []
    for i, (_, _, t) in enumerate(order):
        half, after = len(t) // 2, order[(i + 1) % len(order)][2]
        want.append(hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest())
    assert sorted(r.edited_sha256 for r in got) == sorted(want)
    groups = {r.fingerprint: r.n_rows for r in fingerprint.duplicate_groups(frame(spark, rows)).collect()}
    assert sorted(groups.values()) == [1, 1, 1, 2, 2, 2, 2, 3]
    assert fingerprint.edited_fingerprints(frame(spark, [])).count() == 0
    (one,) = fingerprint.edited_fingerprints(frame(spark, [(1, "abcd", "s")])).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0


def test_mixed_buckets_widen(spark):
    rows = frame(spark, [(i, f"text {i}", "s") for i in range(60)] + [(99, "TEXT 5", "s")])
    assert fingerprint.verified_width(rows) == 2
    width = fingerprint.verified_width(rows, bits=2)
    assert width > 2
    prints = fingerprint.edited_fingerprints(rows, bits=2)
    assert prints.select("fingerprint").distinct().count() == 60


# mixing


def check_mix(rows, got):
    size = lambda t: len(brute.WORDS.findall(t or ""))
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, free, left = {}, set(sources), 1.5 * sum(total.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * total[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * total[s] for s in full}
        left -= sum(target[s] for s in full)
        free -= full
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    taken = defaultdict(int)
    for d, t, s in rows:
        r = by[d].pop()
        assert (r.size, r.source_size) == (size(t), total[s]) and r.target == pytest.approx(target[s])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    for s in sources:
        largest = max([size(t) for _, t, x in rows if x == s])
        assert abs(taken[s] - target[s]) <= largest / 2 + 1e-6, s


def test_mixing(spark, table):
    rng = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 40))), rng.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(900)]
    sf = table(rows)
    got = QUERIES["op8_mixing"](spark, sf).collect()
    check_mix(rows, got)
    assert sorted(got) == sorted(QUERIES["op8_mixing"](spark, sf).collect())


def test_mixing_edges(spark, table):
    rows = [(1, None, "a"), (2, "", None), (3, "one", "b"), (4, "long " * 30000, "c")]
    check_mix(rows, QUERIES["op8_mixing"](spark, table(rows)).collect())
    assert mixing.shares(frame(spark, [])).count() == 0
    assert {r.copies for r in mixing.shares(frame(spark, [(1, None, None), (1, " ", "x")])).collect()} == {0}


def test_mix_repeats_rows(spark):
    rows = [(i, "w " * (i + 1), "ab"[i % 2]) for i in range(30)] + [(5, "w " * 6, "b")] * 2 + [(None, "w", "a")]
    docs = frame(spark, rows)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    want = defaultdict(int)
    for r in mixing.shares(docs).collect():
        want[r.doc_id] += r.copies
    have = defaultdict(int)
    for r in out.collect():
        have[r.doc_id] += 1
    assert {k: v for k, v in want.items() if v} == dict(have)


# personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


def check_pii(rows, got):
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for d, t, _ in rows:
        r, want = by[d].pop(), base(t)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want) for k in BASE]
        spans = r.spans.split(",") if r.spans else []
        assert [x for x in spans if not x.startswith("term")] == want


def test_pii_on_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text, "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op10_pii"](spark, sf).collect()
    check_pii(rows, got)
    assert sum("term" in r.spans for r in got) == 0


def test_pii_random_strings(spark, table):
    rng = random.Random(8)
    bits = ["4111 1111 1111 1111", "4111-1111-1111-1112", "0", "12", " ", "-", ".", "+", "@", "a", "b.c", "_", "%", "(", ")", "256.1.1.1", "1.2.3.4", "0001.02.3.255", "x@y.z", "é", "\U0001f600", "+1 (017) 555-7713", "--", "123456789012", "\n"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14))), "") for i in range(1500)]
    rows += [(5000, None, ""), (5001, "", ""), (5002, "1" * 90000, ""), (5003, "a" * 90000 + "@b.c", ""), (5004, "1 " * 60000, ""), (5005, "a@b." * 2000, ""), (5006, "+1" + " " * 70000, "")]
    check_pii(rows, QUERIES["op10_pii"](spark, table(rows)).collect())


def test_terms_that_disclose(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    rows = [(i, " ".join([word() for _ in range(12)] + ["Zebulon", "said", "mail", "zeb@mail.org"] + [word() for _ in range(5)]), "") for i in range(5)]
    rows += [(10 + i, " ".join(["said", word(), word(), "the", "mail"]), "") for i in range(60)]
    rows += [(100, rows[0][1], "")] * 3 + [(200, "Zebulon alone", "")]
    docs = frame(spark, rows)
    spans = {r.doc_id: [s.value for s in r.spans] for r in pii.find(docs).collect()}
    assert spans[0] == ["Zebulon", "zeb@mail.org"] and spans[10] == [] and spans[200] == []
    clean = pii.sanitize(docs)
    assert clean.columns == docs.columns
    text = {r.doc_id: (r.text, r.n_chars) for r in clean.collect()}
    assert "[TERM] said mail [EMAIL]" in text[0][0] and len(text[0][0]) == text[0][1] and text[200][0] == "Zebulon alone"
    assert clean.count() == len(rows)


def test_terms_far_from_their_entity(spark):
    rng = random.Random(5)
    filler = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(30))
    rows = [(i, f"Dear Zebulon, {filler()} mail zeb@mail.org", "") for i in range(2)]
    rows += [(10 + i, f"Quentin {filler()} +44 20 7946 0958 {filler()}", "") for i in range(4)]
    rows += [(20 + i, f"dear mail {filler()}", "") for i in range(60)] + [(100, f"{filler()} one@mail.org", "")]
    spans = {r.doc_id: [s.value for s in r.spans] for r in pii.find(frame(spark, rows)).collect()}
    assert spans[0] == spans[1] == ["Zebulon", "zeb@mail.org"]
    assert all(spans[10 + i] == ["Quentin", "+44 20 7946 0958"] for i in range(4))
    assert spans[20] == [] and spans[100] == ["one@mail.org"]


def test_terms_short_numbered_and_at_the_ends(spark):
    rows = [(i, f"Kovacs: a@b.com {w} E12345", "") for i, w in enumerate(["one", "two", "ten"])]
    rows += [(10 + i, f"李明 c@d.com {w} Ng", "") for i, w in enumerate(["one", "two", "ten"])]
    rows += [(20 + i, f"778812 {w} +44 20 7946 0958 हिंदी", "") for i, w in enumerate(["one", "two", "ten"])]
    rows += [(40 + i, w, "") for w in ("one", "two", "ten") for i in range(20)] + [(90, "b com 44 e1 n", "")]
    spans = defaultdict(list)
    for r in pii.find(frame(spark, rows)).collect():
        spans[r.doc_id] += [s.value for s in r.spans]
    assert spans[0] == spans[2] == ["Kovacs", "a@b.com", "E12345"]
    assert spans[10] == spans[12] == ["李明", "c@d.com", "Ng"]
    assert spans[20] == spans[22] == ["778812", "+44 20 7946 0958", "हिंदी"]
    assert spans[40] == spans[90] == []


def by_hand(texts, support, threshold):
    """(entity, term) above the threshold: document counts of words and e-mail addresses, over all documents."""
    mail = re.compile(pii.PATTERNS["email"].replace("++", "+").replace(r"(?:\G|(?<![A-Za-z0-9._%+-]))", ""))
    words = lambda t: list(dict.fromkeys(w for w in re.split(r"[^\w]+|_", t.lower()) if w))
    docs = [({f"0:{m[0].lower()}" for m in mail.finditer(t)}, tuple(words(mail.sub(" ", t))), set(words(t))) for t in texts]
    contexts = defaultdict(lambda: defaultdict(int))
    for held, outside, _ in docs:
        for e in held:
            contexts[e][outside] += 1
    seen = defaultdict(int)
    for held, outside, every in docs:
        for w in set(outside) if held else every:
            seen[w] += 1
    out, n = set(), len(texts)
    for e, found in contexts.items():
        if len(found) < 2:
            continue
        here = sum(found.values())
        for t in {w for c in found for w in c}:
            both = sum(k for c, k in found.items() if t in c)
            if sum(t in c for c in found) >= min(support, len(found)) and math.log(both / n / (seen[t] / n * here / n)) / -math.log(here / n) >= threshold:
                out.add((e, t))
    return out


def test_disclosure_equals_mutual_information_by_hand(spark):
    rng = random.Random(12)
    names, common = [f"name{i}" for i in range(12)], [f"word{i}" for i in range(25)]
    texts = []
    for _ in range(260):
        w = rng.choices(common, k=rng.randint(1, 6))
        if rng.random() < 0.4:
            who = rng.randrange(12)
            w += [f"u{who}@mail.org"] * rng.randint(1, 2) + [names[who]] * (rng.random() < 0.9) + [names[rng.randrange(12)]] * (rng.random() < 0.1)
        rng.shuffle(w)
        texts.append(" ".join(w))
    texts += texts[:6] * 2
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    based = docs.select(F.col("doc_id").alias("rk"), "text", pii.base_spans(F.col("text")).alias("spans")).where(F.size("spans") > 0)
    for support, threshold in ((3, 0.8), (2, 0.5)):
        got = {(r.entity, r.term) for r in pii.revealing_terms(docs, based, "text", support, threshold).collect()}
        assert got == by_hand(texts, support, threshold) and got


def test_running_over_long_arrays(spark):
    n = 300
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x.cast("int")).alias("v"), F.array().cast("array<int>").alias("none"))
    r = df.select(pii.running(F.col("v"), lambda a, b: a + b).alias("sums"), pii.running(F.col("v"), lambda a, b: F.greatest(a, b)).alias("tops"), pii.running(F.col("none"), lambda a, b: a + b).alias("none")).first()
    assert r.sums == [i * (i + 1) // 2 for i in range(n)] and r.tops == list(range(n)) and r.none == []
    many = " ".join(f"u{i}@x.org" for i in range(400))
    (one,) = pii.find(frame(spark, [(1, many, "s")])).collect()
    assert [(s.start, s.end, s.value) for s in one.spans] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"\S+", many)]
    assert pii.sanitize(frame(spark, [(1, many, "s")])).first().text == " ".join(["[EMAIL]"] * 400)


def test_fingerprints_of_text_ids(spark):
    rows = [("b", "Two"), ("a10", "One one"), ("a2", None), (None, "Zero")]
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    order = [None, "a10", "a2", "b"]
    texts = {d: t or "" for d, t in rows}
    for d, after in zip(order, order[1:] + order[:1]):
        t, half = texts[d], len(texts[d]) // 2
        assert got[d].edited_sha256 == hashlib.sha256((t[: len(t) - half] + texts[after][:half]).encode()).hexdigest()


def test_redact_overlaps_and_empty(spark):
    t = "+4111111111111111 x"
    (r,) = pii.sanitize(frame(spark, [(1, t, "s")])).collect()
    assert base(t) and "4111" not in r.text and r.text.endswith(" x")
    assert pii.find(frame(spark, [])).count() == 0 and pii.sanitize(frame(spark, [])).count() == 0
