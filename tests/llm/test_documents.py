"""Operators on single documents: quality rules, personal data, classifiers, tokens, licenses, benchmark items."""

import collections
import math
import random
import re
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegauge.llm import decontamination, licenses, pii, quality_classifier, quality_rules, sentencepiece, toxicity, training
from sitegauge.llm.common import crc_fold

DOCS = "doc_id long, text string, lang string, source string"


def base_counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if seen[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_by_brute_force(spark, odd):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "b", "c|", "é", "D#"]) for _ in range(rng.randint(0, 60))) + "\n" * rng.randint(0, 2) + "a b\n \na b\x0b" for _ in range(200)]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], DOCS).unionByName(odd.select("doc_id", "text", "lang", "source"))
    for r, t in [(r, r.text) for r in quality_rules.measure(df, carry=True).select("*", "row__.text").collect()]:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(t)


def test_every_language_has_a_reference(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(70)), f"l{i % 70}", "s") for i in range(280)]
    df = spark.createDataFrame(rows, DOCS)
    limits = quality_rules.Limits()
    refs = quality_rules.fit(quality_rules.measure(df), limits)
    assert refs.count() == 70 and refs.where("word_q IS NULL").count() == 70
    assert quality_rules.judge(df).where("kept").count() == 280


def test_both_distances_are_from_one_language(spark):
    rng = random.Random(5)
    of = lambda words, n=120: " ".join(rng.choice(words) for _ in range(n))
    en, de = quality_rules.COMMON_WORDS["en"] + ["house", "tree"], quality_rules.COMMON_WORDS["de"] + ["haus", "baum"]
    rows = [(i, of(en), "en", "s") for i in range(30)] + [(100 + i, of(de), "de", "s") for i in range(30)]
    rows += [(200, of(de), "en", "s"), (201, of(de), None, "s"), (202, of(en), "xx", "s"), (203, of(["zzz", "qq"]), None, "s")]
    got = {r.doc_id: (r.kept, r.word_distance) for r in quality_rules.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i][0] for i in [*range(30), *range(100, 130)])
    # German text said to be English is far from English; without a language, or in one of its own, a text has the nearest
    assert not got[200][0] and got[200][1] > 0.6 and got[202][1] < 0.3
    assert not got[203][0]


def test_quality_rejects_junk_and_keeps_prose(spark):
    rng = random.Random(2)
    words = "the of and to in a is that for it was with house tree river stone garden letter window summer".split()
    prose = [" ".join(rng.choice(words) for _ in range(120)).capitalize() + "." for _ in range(60)]
    junk = [" ".join(w.upper() + "!!" for w in p.split()) for p in prose[:5]] + [p.replace(" ", "### ") for p in prose[5:10]]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(prose + junk)], DOCS)
    kept = {r.doc_id for r in quality_rules.judge(df).where("kept").collect()}
    assert kept == set(range(60))
    assert {r.doc_id for r in quality_rules.keep_good(df).collect()} == kept
    assert quality_rules.keep_good(df).columns == df.columns


def test_quality_odd_and_empty(odd, none):
    rows = quality_rules.judge(odd).collect()
    assert len(rows) == 9 and all(r.base_failed and not r.kept for r in rows if r.n_words < 50)
    assert quality_rules.judge(none).count() == 0 and quality_rules.keep_good(none).columns == none.columns


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        g = re.sub("[^0-9]", "", m[0])
        if 12 <= len(g) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(g[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_pii_base_by_brute_force(spark):
    rng = random.Random(5)
    bits = ["a@b.cc", "x_d@e.ff", "@", "a@b", ".", "+1 (743) 555-3824", "+49", "227.5.221.1", "1.2.3", "256.1.1.1", "007.08.9.010", "4111 1111 1111 1111", "4111-1111-1111-1112", "é", " ", "_", "12", "-", "(", "+", "token = \"ab12cd34ef56ab12cd34\""]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(600)]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert got[i].base == want, t
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))
        assert got[i].n_email == want.count("email") and got[i].n_card == want.count("card")


def test_pii_adds_what_convinces(spark):
    texts = [f"Login with password = Ab3{i:04d}xYz99Qw77 then call us." for i in range(40)] + ["plain words = nothing here"] * 40
    got = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert all("secret:" in r.spans for r in got[:40]) and all(r.spans == "" for r in got[40:])


def test_pii_odd_and_empty(odd, none):
    rows = pii.find(odd).collect()
    assert len(rows) == 9 and pii.find(none).count() == 0
    assert all(r.base == "" for r in rows if r.doc_id in (1, 2, 3, 4, 5, 6))


def test_expectation_maximisation_finds_the_better_labeler():
    rng = random.Random(1)
    count = collections.Counter()
    for _ in range(4000):
        y = rng.random() < 0.5
        votes = [y if rng.random() < p else not y for p in (0.95, 0.85, 0.75)]
        count[0, (*(1 if v else 0 for v in votes), 2)] += 1
    post = pii.expectation_maximisation([(k, v, n) for (k, v), n in count.items()])
    assert post[0, (1, 1, 1, 2)] > 0.95 and post[0, (0, 0, 0, 2)] < 0.05 and post[0, (1, 0, 0, 2)] > post[0, (0, 0, 1, 2)]


def labelled(spark, n=600):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = [rng.choice(words) for _ in range(rng.randint(60, 120))]
        if bad:
            at = rng.randint(0, 50)
            text[at : at + 3] = ["vile", "nasty", "awful"]
        junk = i % 5 == 1
        rows.append((i, " ".join(w + "###" if junk else w for w in text)))
        labels.append((i, 0 if junk else 1, 1 if bad else 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(scored, labels, label):
    rows = scored.join(labels, "doc_id").where("held_out").select("predicted", label).collect()
    return sum(r[0] == r[1] for r in rows) / len(rows)


def test_classifiers_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    assert accuracy(quality_classifier.score(docs, quality_classifier.fit(docs, labels)), labels, "quality") > 0.95
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).cache()
    assert accuracy(scored, labels, "toxic") > 0.95
    assert scored.where("predicted = 1").where(F.size("passages") == 0).count() == 0


def test_held_out_labels_never_matter(spark):
    docs, labels = labelled(spark, 200)
    flipped = labels.withColumn("quality", F.when(crc_fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality_classifier.fit(docs, labels), quality_classifier.fit(docs, flipped))


def test_classifiers_odd_and_empty(spark, odd, none, no_labels):
    weights, model = quality_classifier.fit(odd, no_labels), toxicity.fit(odd, no_labels)
    for scored in (quality_classifier.score(odd, weights), toxicity.score(odd, model)):
        rows = scored.collect()
        assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
    assert quality_classifier.score(none, weights).count() == 0 and toxicity.score(none, model).count() == 0
    nulls = spark.createDataFrame([(None, 1, 1), (3, None, None), (4, 0, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert len(quality_classifier.score(odd, quality_classifier.fit(odd, nulls)).collect()) == 9


def maximal_by_definition(scores):
    """Maximal segments by recursion: the best one, shortest and first, then those on either side of it."""

    def find(lo, hi):
        best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        a, b = -best[2], -best[2] - best[1]
        return [*find(lo, a), (a, b, best[0]), *find(b, hi)]

    return find(0, len(scores))


def test_segments_by_definition():
    rng = random.Random(3)
    for _ in range(300):
        scores = [float(rng.choice([-3, -2, -1, 1, 2, 4])) + rng.random() / 7 for _ in range(rng.randint(0, 14))]
        got = toxicity.segments(np.array(scores))
        want = maximal_by_definition(scores)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want])


def test_segments_take_linear_time():
    def falling(n):
        out = np.tile([1.0, -1.5], n // 2)  # every segment starts lower than the one before
        began = time.process_time()
        assert len(toxicity.segments(out)) == n // 2
        return time.process_time() - began

    falling(1000)
    assert min(falling(80_000) for _ in range(3)) < 4 * min(falling(40_000) for _ in range(3))


def test_toxicity_by_brute_force(spark):
    docs, labels = labelled(spark, 400)
    mild = (F.col("doc_id") % 8 == 0) | (F.col("doc_id") % 11 == 0)  # stands in clean texts too
    docs = docs.withColumn("text", F.when(mild, F.concat("text", F.lit(" mild mild"))).otherwise(F.col("text")))
    text, toxic = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.toxic for r in labels.collect()}
    learns = {r.doc_id: r.s for r in labels.where(crc_fold(F.col("doc_id")) != 0).select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4)) > 0).alias("s")).collect()}
    count = [collections.Counter(), collections.Counter()]
    for i, for_scores in learns.items():
        if for_scores:
            count[toxic[i]].update({b for w in re.findall(r"[^\W_]+", text[i].lower()) for b in toxicity.bins_of(w)})
    n = [sum(c.values()) for c in count]
    weight = toxicity.PRIOR * sum(n)

    def odds(b):
        prior = weight * (count[0][b] + count[1][b]) / sum(n) + 1e-3
        p, q = count[1][b] + prior, count[0][b] + prior
        delta = math.log(p / (n[1] + weight - p)) - math.log(q / (n[0] + weight - q))
        return delta**3 / (delta**2 + toxicity.HALF_Z**2 * (1 / p + 1 / q))

    table = {b: float(np.float32(odds(b))) for b in {*count[0], *count[1]}}
    model = toxicity.fit(docs, labels)
    assert set(np.flatnonzero(model.table)) <= set(table) and all(model.table[b] == pytest.approx(x, rel=1e-5, abs=1e-6) for b, x in table.items())

    def score(w):
        own = [table.get(b, 0.0) for b in toxicity.bins_of(w)]
        return (max(own) if max(own) > 0 else min(own)) - toxicity.COST

    def segments(t):
        scores = [score(w) for w in re.findall(r"[^\W_]+", t.lower())]
        return len(scores), [x for _, _, x in maximal_by_definition(scores)]

    found = {i: segments(text[i]) for i, s in learns.items() if not s}
    chance = sorted(round(x / toxicity.STEP) for i, (_, xs) in found.items() if not toxic[i] for x in xs)
    assert chance
    quantile = lambda q: chance[max(0, math.ceil(q * len(chance)) - 1)] * toxicity.STEP
    rate = min(5.0, max(0.2, math.log(10) / max(quantile(0.95) - quantile(0.5), toxicity.STEP)))
    log_k = math.log(len(chance) / 2 / sum(k for i, (k, _) in found.items() if not toxic[i])) + rate * quantile(0.5)
    assert (model.rate, model.log_k) == (pytest.approx(rate, rel=1e-6), pytest.approx(log_k, rel=1e-6))
    for r in toxicity.score(docs, model).where("doc_id % 10 = 0").collect():
        k, xs = segments(text[r.doc_id])
        beyond = [b for b in (rate * x - log_k - math.log(max(1, k)) for x in xs) if b >= -math.log(toxicity.MAX_EXPECTED)]
        want = 1 / (1 + math.exp(-(model.slope * min(sum(beyond), toxicity.MAX_EXCESS) + model.bias)))
        assert r.score == pytest.approx(want, rel=1e-4) and len(r.passages) == len(beyond)


def test_training_sample_keeps_its_bounds(spark):
    docs = spark.createDataFrame([(i // 500, f"text {i}") for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    ids = [r.doc_id for r in training.sample(docs, labels, "quality", 10).collect()]
    assert len(ids) == len(set(ids)) > 0
    many = spark.createDataFrame([(i, "x" * 100) for i in range(2000)], "doc_id long, text string")
    marks = many.select("doc_id", F.lit(1).alias("quality"))
    assert training.sample(many, marks, "quality", 10_000, 20_000).count() < 260


def test_training_by_brute_force():
    rng = random.Random(9)
    hashes = quality_classifier.WordHashes()
    data = [(*quality_classifier.features(" ".join(rng.choice("ab cd ef GH 12 x!".split()) for _ in range(rng.randint(0, 30))), hashes), float(rng.random() < 0.5)) for _ in range(80)]
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    a, b, l1, l2 = quality_classifier.ALPHA, quality_classifier.BETA, quality_classifier.L1, quality_classifier.L2
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((b + math.sqrt(n[i])) / a + l2)
    for _ in range(quality_classifier.EPOCHS):
        for bins, values, y in data:
            w = {int(i): weight(int(i)) for i in bins}
            p = 1 / (1 + math.exp(-sum(w[int(i)] * float(x) for i, x in zip(bins, values, strict=True))))
            for i, x in zip(bins.tolist(), values.tolist(), strict=True):
                g = (p - y) * x
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / a * w[i]
                n[i] += g * g
    got = quality_classifier.train(data)
    assert np.flatnonzero(got).size and all(got[i] == pytest.approx(weight(i), rel=1e-4, abs=1e-6) for i in z)
    text = "ab GH 12 ab ab"
    bins, values = quality_classifier.features(text, hashes)
    assert quality_classifier.score_text(text, got, hashes) == pytest.approx(1 / (1 + math.exp(-float(got[bins] @ values))), rel=1e-5)


@pytest.fixture(scope="module")
def tokenizer():
    return sentencepiece.load()


def test_viterbi_by_brute_force(tokenizer):
    pieces, unigram = sentencepiece.read_model(sentencepiece.MODEL)
    scores = dict(zip([p for p, _, _ in pieces], sentencepiece.log_scores(pieces, unigram), strict=True))
    known = {p for p, _, k in pieces if k == sentencepiece.NORMAL}

    def best(s):
        value = [0.0] + [float("-inf")] * len(s)
        for e in range(1, len(s) + 1):
            for b in range(e):
                if s[b:e] in known:
                    value[e] = max(value[e], value[b] + scores[s[b:e]])
            if s[e - 1] not in known:
                value[e] = max(value[e], value[e - 1] + tokenizer.unknown)
        return value[-1]

    for text in ["hello world", "internationalisation of things", "日本語 x", "a  b", "tab\tand\nline", "🙂🙂"]:
        ids = tokenizer.encode(text)
        marked = (" " + text).replace(" ", "▁")
        cost, i = 0.0, 0
        while i < len(ids):
            if ids[i] in tokenizer.byte_ids:
                n = 1
                while tokenizer.byte_ids.index(ids[i]) >= 0xC0 and i + n < len(ids) and ids[i + n] in tokenizer.byte_ids and 0x80 <= tokenizer.byte_ids.index(ids[i + n]) < 0xC0:
                    n += 1
                cost, i = cost + tokenizer.unknown, i + n
            else:
                cost, i = cost + tokenizer.scores[ids[i]], i + 1
        assert cost == pytest.approx(best(marked)), text


def model_file(path, pieces):
    """A unigram model of (piece, score) and all byte pieces, as a protocol buffer."""
    field = lambda number, data: bytes([number << 3 | 2, *varint(len(data))]) + data

    def varint(n):
        out = []
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return [*out, n]

    def piece(text, score, kind):
        return field(1, field(1, text.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", score) + bytes([3 << 3, kind]))

    own = [piece("<unk>", 0.0, sentencepiece.UNKNOWN), *(piece(f"<0x{b:02X}>", 0.0, sentencepiece.BYTE) for b in range(256))]
    path.write_bytes(b"".join([*own, *(piece(t, s, sentencepiece.NORMAL) for t, s in pieces)]) + field(2, bytes([3 << 3, 1])))


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_over_random_vocabularies(tmp_path, seed):
    rng = random.Random(seed)
    letters = "ab\u00e9\u2581\u65e5c" if seed % 2 else "abc\n\U0001f642"
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(60)} | {"\u2581"}
    if seed % 3 == 0:  # no marker within a piece, so that texts are cut
        words = {w for w in words if "\u2581" not in w.lstrip("\u2581")}
    scores = {w: float(np.float32(-rng.uniform(0.5, 12))) for w in words}
    model_file(tmp_path / "m.model", scores.items())
    t = sentencepiece.load(str(tmp_path / "m.model"))
    model_file(tmp_path / "bare.model", [("a", -1.0)])
    with pytest.raises(ValueError, match="white space"):
        sentencepiece.load(str(tmp_path / "bare.model"))
    ids = {t.surface[i].decode().replace(" ", "\u2581"): i for i in range(257, len(t.surface))}
    for n in [0, 1, 2, 7, 30, 200, 4000]:
        text = "".join(rng.choice("abc\u00e9 \u65e5\n\U0001f642z") for _ in range(n))
        marked = (" " + text).replace(" ", "\u2581") if text else ""
        best = [0.0] + [-math.inf] * len(marked)
        for e in range(1, len(marked) + 1):
            for b in range(max(0, e - 5), e):
                if marked[b:e] in scores:
                    best[e] = max(best[e], best[b] + scores[marked[b:e]])
            if marked[e - 1] not in scores:
                best[e] = max(best[e], best[e - 1] + t.unknown)
        got = t.encode(text)
        assert t.decode(got) == text
        cost, k = 0.0, 0
        while k < len(got):
            if got[k] in t.byte_ids:
                first = t.byte_ids.index(got[k])
                k += 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                cost += t.unknown
            else:
                cost, k = cost + scores[next(w for w, i in ids.items() if i == got[k])], k + 1
        assert cost == pytest.approx(best[-1], rel=1e-6)


def test_round_trips(tokenizer):
    rng = random.Random(2)
    letters = " \n\t▁aebé日🙂'\x00\r"
    texts = ["", " ", "  ", "▁", "▁▁ ▁"] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(500)]
    for t, ids in zip(texts, tokenizer.encode_batch(texts), strict=True):
        assert tokenizer.decode(np.frombuffer(ids, np.int32).tolist()) == t


def test_tokenize_odd_and_empty(odd, none):
    got = sentencepiece.tokenize(odd)
    assert got.columns == [c for c in odd.columns if c != "tokens"] + ["tokens", "n_tokens", "n_byte_tokens", "round_trip"]
    rows = got.collect()
    assert len(rows) == 9 and all(r.round_trip for r in rows) and all(r.n_tokens == 0 for r in rows if not r.text)
    assert sentencepiece.tokenize(none).count() == 0


def test_licenses_are_found_where_they_stand(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    filler = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, planted = [], []
    for i, (name, text) in enumerate(licenses.TEMPLATES.items()):
        for k in range(8):
            rows.append((100 * i + k, f"{filler(rng.randint(0, 200))} {text.upper() if k % 2 else text}\n{filler(rng.randint(0, 200))}"))
            planted.append((100 * i + k, name))
    rows += [(9000 + i, filler(300)) for i in range(50)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(r.doc_id, r.template) for r in got}
    assert len(found) == len(got) and set(planted) <= found
    within = {(a, b) for a in licenses.TEMPLATES for b in licenses.TEMPLATES if " ".join(licenses.TEMPLATES[b].lower().rstrip(".").split()) in licenses.TEMPLATES[a].lower()}
    of = dict(planted)
    assert all((of[x], t) in within for x, t in found - set(planted))
    texts = dict(rows)
    for r in got:
        assert texts[r.doc_id][r.start : r.end].lower() in " ".join(licenses.TEMPLATES[r.template].lower().split()) and r.containment == 1.0


def test_licenses_bands_keep_their_promise():
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8)
    for t in scanner.templates:
        worst = 0.8 * len(t.own) / (2 * t.block + 0.2 * len(t.own))
        assert 1 - (1 - worst) ** scanner.bands[t.block] >= licenses.CONFIDENCE


def test_licenses_partly_there(spark):
    words = licenses.TEMPLATES["GPL-3.0"].split()
    most, half = " ".join([*words[:30], "other", *words[31:]]), " ".join(words[: len(words) // 2])
    got = licenses.scan(spark.createDataFrame([(1, most), (2, half)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.template) for r in got] == [(1, "GPL-3.0")]


def naive_occurrences(words, template, containment):
    """Every set of shingles whose starts lie close enough, tried one by one."""
    k = min(licenses.WORDS, len(template))
    cut = lambda ws: [tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)]
    own, places = cut(template), collections.defaultdict(list)
    for i, x in enumerate(own):
        places[x].append(i)
    drift = int((1 - containment) * len(places))
    hits = [(p - o, p, x) for p, x in enumerate(cut(words)) for o in places.get(x, ())]
    found = []
    for start in sorted({h[0] for h in hits}):
        near = [(p, x) for s, p, x in hits if start <= s <= start + drift]
        first = {}
        for p, x in sorted(near):
            first.setdefault(x, p)
        if len(first) >= containment * len(places) - 1e-9:
            found.append((-len(first), min(first.values()), max(first.values())))
    out = []
    for n, a, b in sorted(found):
        if all(b < c or a > e for c, e, _ in out):
            out.append((a, b, -n / len(places)))
    return [(a, b + k, c) for a, b, c in sorted(out)]


def test_license_occurrences_by_brute_force():
    rng = random.Random(12)
    templates = {"long": " ".join(f"t{i}" for i in range(60)), "loop": "a b c d e f a b c d e g", "pair": "one two", "MIT": licenses.TEMPLATES["MIT"], "BSD-whole": licenses.TEMPLATES["BSD-whole"]}
    scanner = licenses.Scanner(templates, 0.8)
    n = 0
    for _ in range(150):
        words = []
        for _ in range(rng.randint(1, 4)):
            own = licenses._WORD.findall(rng.choice(list(templates.values())).lower())
            for _ in range(rng.choice([0, 0, 1, 2, len(own) // 20])):
                at = rng.randrange(len(own))
                own[at : at + rng.randint(0, 1)] = ["odd"] * rng.randint(0, 2)
                own = own or ["odd"]
            words += own[: rng.choice([len(own), len(own), len(own) * 3 // 4])] + [f"f{rng.randrange(99)}" for _ in range(rng.choice([0, 0, 2, 40]))]
        text = " ".join(words)
        at = [m.span() for m in licenses._WORD.finditer(text)]
        want = {(name, at[a][0], at[b - 1][1], c) for name, t in templates.items() for a, b, c in naive_occurrences(words, licenses._WORD.findall(t.lower()), 0.8)}
        got = {(x["template"], x["start"], x["end"], x["containment"]) for x in scanner.find(text)}
        assert got == want, text
        n += len(want)
    assert n > 200


def test_licenses_side_by_side(spark):
    t = licenses.TEMPLATES["ISC"]
    rows = [(1, f"{t} {t}\n{t}"), (2, f"copies with or without fee is hereby granted {'word ' * 9}{t}")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("template = 'ISC'").orderBy("doc_id", "start").collect()
    assert [dict(rows)[r.doc_id][r.start : r.end] for r in got] == [t.rstrip(".")] * 4


def test_licenses_odd_and_empty(odd, none):
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0
    assert licenses.scan(odd, {}).count() == 0 and licenses.scan(odd, {"e": "", "s": "one two"}).count() == 2


def edit_distance_inside(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p):
        new = [i + 1]
        for j, x in enumerate(t):
            new.append(min(row[j] + (c != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_myers_by_dynamic_programming():
    rng = random.Random(6)
    for _ in range(300):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 70)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 90)))
        distance, end = decontamination.myers(p, t)
        assert distance == edit_distance_inside(p, t)
        assert edit_distance_inside(p[::-1], t[:end][::-1]) == distance


def test_items_are_found_within_their_budget_by_brute_force(spark):
    rng = random.Random(8)
    letters = "abcdefghij klmno"
    some = lambda n: "".join(rng.choice(letters) for _ in range(n))
    items = [(i, some(rng.randint(60, 120))) for i in range(12)]
    docs = []
    for i in range(120):
        text = some(rng.randint(0, 300))
        if i % 2:
            item = list(items[i % 12][1])
            for _ in range(rng.randint(0, 9)):
                at = rng.randrange(len(item))
                item[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "z"])
            text = f"{text[:100]} {''.join(item).upper()} {text[100:]}"
        docs.append((i, text))
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, t in docs:
        for k, q in items:
            plain, item = decontamination.normalise(t), decontamination.normalise(q)
            assert ((i, k) in got) == (edit_distance_inside(item, plain) <= int(len(item) * decontamination.ERROR_SHARE))


def test_items_of_any_length_by_brute_force(spark):
    rng = random.Random(18)
    some = lambda n: "".join(rng.choice("abcde fg") for _ in range(n))
    items = [(i, t) for i, n in enumerate([1, 2, 3, 5, 8, 12, 15, 16, 17, 20, 25, 31, 32, 40, 80, 150, 200]) if (t := some(n)).strip()]
    docs = []
    for i in range(150):
        item = list(rng.choice(items)[1])
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            at = rng.randrange(len(item) + 1)
            item[at : at + rng.randint(0, 1)] = rng.choice(["", "z"])
        docs.append((i, some(rng.randint(0, 40)) + rng.choice(["", " "]) + "".join(item) + rng.choice(["", " ", "."]) + some(rng.randint(0, 40))))
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, t in docs:
        for k, q in items:
            plain, item = decontamination.normalise(t), decontamination.normalise(q)
            budget = int(len(item) * decontamination.ERROR_SHARE)
            exact = any(decontamination.whole_words(plain, m, m + len(item)) for m in range(len(plain)) if plain.startswith(item, m))
            assert ((i, k) in got) == (edit_distance_inside(item, plain) <= budget if budget else exact), (t, q)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK", 3)
    items = [(i if i else None, f"item number {i} has a few words of its own") for i in range(10)]
    docs = spark.createDataFrame([(i, f"before {t} after", "kept") for i, t in items], "doc_id long, text string, leaks string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id or 0) for r in decontamination.matches(docs, bench).collect() if r.distance == 0) == [(i, i) for i in range(10)]
    one = decontamination.decontaminate(docs, bench.where("item_id > 3"))
    assert one.columns == docs.columns and all(r.leaks == "kept" for r in one.collect())


def test_positions_of_items(spark):
    item = "The quick brown fox jumps over the lazy dog and runs"
    text = "İ start  " + item.replace(" ", " \n ") + " end"
    r = decontamination.matches(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [(x.item_id, text[x.start : x.end].split(), x.distance) for x in r] == [(5, item.split(), 0)]


def test_decontaminate_odd_and_empty(spark, odd, none):
    items = spark.createDataFrame([(1, None), (None, "x" * 99), (2, ""), (3, "shorter"), (4, "x" * 50), (4, "x" * 50)], "item_id long, text string")
    clean = decontamination.decontaminate(odd, items)
    assert {r.doc_id for r in odd.collect()} - {r.doc_id for r in clean.collect()} == {5}
    assert decontamination.decontaminate(odd, items.limit(0)).count() == 9 and decontamination.matches(none, items).count() == 0
    assert decontamination.decontaminate(odd.drop("leaks"), items).columns == odd.drop("leaks").columns
