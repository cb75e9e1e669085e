"""Operators on the whole corpus: line dedup, near-dedup, sharding, and the pipeline."""

import collections
import itertools
import random
import re
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sitegauge.llm import common, line_dedup, near_dedup, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_boilerplate_lines_as_in_sql(spark):
    rng = random.Random(1)
    shared = [f"a line that stands on many pages, number {i}" for i in range(12)]
    rows = []
    for i in range(400):
        own = [prose(rng, 8) for _ in range(rng.randint(0, 4))]
        own += [s for k, s in enumerate(shared) if rng.random() < 0.02 * k] + ["short"] * (i % 3) + [" \t", ""] * (i % 2) + ["Les."] * (i % 50 == 3)
        rng.shuffle(own)
        rows.append((i, "\n".join(own), "en", f"s{i % 14}" if i % 7 else None, 0))
    rows += [(1000, None, "en", "s1", 0), (1001, "", "en", "s2", 0), (1002, "\n\n", "en", "s3", 0)]
    df = spark.createDataFrame(rows, DOCS)
    documents = df.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    want = sorted(con.execute(line_dedup.oracle_sql()).fetchall())
    got = sorted(tuple(r) for r in line_dedup.clean(df).select("doc_id", "n_lines", "n_dropped", "text").collect())
    assert got == want and sum(r[2] for r in got) > 100


def test_exact_counts_decide_near_the_threshold(spark):
    rows = [(100 * n + i, f"this line is on exactly {n:02d} of the sites", "en", f"s{i % n}", 0) for n in range(2, 9) for i in range(2 * n)]
    df = spark.createDataFrame(rows, DOCS)
    dropped = line_dedup.clean(df, lg_k=4).groupBy("text").agg(F.sum("n_dropped").alias("d"), F.count("*").alias("n")).collect()
    by = {r.text: (r.d, r.n) for r in dropped}
    for n in range(2, 9):
        line = f"this line is on exactly {n:02d} of the sites"
        assert by[line] == ((0, 2 * n) if n < 5 else (0, 1))


def test_line_stage_takes_short_lines(spark):
    rows = [(i, f"own {i}\nLes.\n \n\nö", "en", f"s{i % 12}", 20) for i in range(24)]
    got = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert got == {i: f"own {i}\n \n" if i else rows[0][1] for i in range(24)}


def test_line_stage_sees_passages_under_a_hot_source(spark):
    passage = prose(random.Random(2), 60)
    rows = [(i, f"own {i}\n{passage}", "en", f"s{i}" if i % 2 else "hot", 9) for i in range(12)]
    got = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert got == {i: f"own {i}" if i else rows[0][1] for i in range(12)}


def test_line_dedup_odd_and_empty(odd, none):
    rows = line_dedup.clean(odd).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in rows) == sorted((r.doc_id or -1, r.text or "") for r in odd.collect())
    assert line_dedup.clean(odd).columns == [*odd.columns, "n_lines", "n_dropped"] and line_dedup.clean(none).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        e = np.unique(rng.integers(1, 2**62, 200).astype(np.uint64))
        a = rng.integers(0, 9, len(e))
        b = np.where(rng.random(len(e)) < rng.random(), a, rng.integers(0, 9, len(e)))
        x, y = (e[a > 0], a[a > 0]), (e[b > 0], b[b > 0])
        same = (near_dedup.bag_min_hash(*x, size=256) == near_dedup.bag_min_hash(*y, size=256)).mean()
        errors.append(same - near_dedup.overlap(x, y))
    assert abs(np.mean(errors)) < 4 * 0.5 / np.sqrt(256 * 60) and np.std(errors) < 0.05


def brute_classes(texts, least=near_dedup.SIMILARITY):
    bags = {i: collections.Counter(zip(*(t.split()[k:] for k in range(5)), strict=False)) if len(t.split()) >= 5 else collections.Counter([tuple(t.split())] if t.split() else []) for i, t in texts.items()}
    up = {i: i for i in texts}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(sorted(texts), 2):
        both, either = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
        if texts[i] == texts[j] or (either and both >= least * either):
            up[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in texts}


def test_near_copies_by_brute_force(spark):
    rng = random.Random(9)
    texts, i = {}, 0
    for size in (1, 2, 3, 5, 40):
        for _ in range(6):
            words = prose(rng, rng.randint(40, 200)).split()
            for _ in range(size):
                own = list(words)
                for _ in range(rng.randint(0, max(1, len(words) // 40))):
                    own[rng.randrange(len(own))] = f"x{rng.randrange(1000)}"
                texts[i] = " ".join(own)
                i += 1
    texts |= {i: "one two", i + 1: "one two", i + 2: "one two three", i + 3: "", i + 4: "", i + 5: "rep rep rep rep rep rep rep", i + 6: "rep rep rep rep rep"}
    df = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()}
    assert got == brute_classes(texts)
    assert {r.doc_id for r in near_dedup.keep_first(df).collect()} == set(got.values())


def family(seed, pairs=100):
    """A text, edited copies at about 0.8 to it, and a copy at about 0.8 to each of these."""
    rng = random.Random(seed)
    base = prose(rng, 150, 10_000).split()
    out = [" ".join(base)]
    for k in range(pairs):
        own = list(base)
        for at in rng.sample(range(4, 146, 6), 3):
            own[at] = f"y{k}at{at}"
        out.append(" ".join(own))
        for at in rng.sample(range(4, 146, 6), 3):
            own[at] = f"z{k}at{at}"
        out.append(" ".join(own))
    return out


def test_near_copies_far_from_their_centre(spark):
    texts = dict(enumerate(t for seed in (3, 7) for t in family(seed)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()} == brute_classes(texts)


def test_texts_without_ids_and_repeated_ids(spark):
    rng = random.Random(4)
    words = prose(rng, 60).split()
    near = " ".join([*words[:30], "other", *words[31:]])
    rows = [(None, " ".join(words)), (3, near), (None, "alone " + prose(rng, 20)), (None, "alone without a copy"), (5, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (5, "another text of id five")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.classes(df).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.class_size) for r in got) == [(0, 0, 1), (0, 0, 1), (0, 3, 2), (3, 3, 2), (5, 5, 1), (5, 5, 3), (5, 5, 3), (5, 5, 3)]
    kept = sorted((r.doc_id or 0, r.text) for r in near_dedup.keep_first(df).collect())
    assert kept == sorted([(0, rows[2][1]), (0, rows[3][1]), (3, near), (5, "a b c d e f"), (5, "another text of id five")])


@pytest.mark.parametrize(("block", "chars"), [(5, 10**9), (10**9, 3000)])
def test_cells_of_few_texts_lose_no_link(spark, monkeypatch, block, chars):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "BLOCK_CHARS", chars)
    texts = dict(enumerate(family(11, 30)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()} == brute_classes(texts)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in [*range(1, 30), *range(40, 42)]], "u binary, v binary")
    got = {r.node[0]: r.label[0] for r in near_dedup.components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, **{i: 40 for i in range(40, 43)}}


def test_near_dedup_odd_and_empty(odd, none):
    rows = near_dedup.classes(odd).collect()
    assert len(rows) == 9
    by = {r.doc_id: r.class_id for r in rows}
    assert by[2] == by[1] == 1 and by[6] == 6 and by[3] == 3  # a null text counts as empty
    assert near_dedup.keep_first(odd).where("doc_id IS NULL").count() == 1
    assert near_dedup.keep_first(odd).where("doc_id = 6").count() == 1  # repeated rows are copies
    assert near_dedup.classes(none).count() == 0 and near_dedup.keep_first(none).columns == none.columns


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    index = sharding.hilbert_index(cells, bits)
    path = cells[np.argsort(index)]
    assert sorted(index) == list(range(len(cells))) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_shards_hold_equal_counts_in_order(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(0, 9)) if i % 3 else "hot text", rng.choice(["en", "de", None]), f"src{rng.randrange(9)}", rng.randrange(1000)) for i in range(1003)]
    df = spark.createDataFrame(rows, DOCS)
    got = sharding.assign(df).collect()
    texts = {r[0]: r[1] for r in rows}
    assert sorted(r.doc_id for r in got) == list(range(1003)) and {r.law for r in got} == {"rows"}
    sizes = collections.Counter(r.shard for r in got)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    keys = [(r.hilbert, r.text_crc32, r.doc_id) for r in ordered]
    assert keys == sorted(keys)
    assert all(r.size == len(texts[r.doc_id].encode()) + 8 and r.grown_shard is None for r in got)
    spread = collections.defaultdict(set)
    for r in got:
        spread[r.shard].add(rows[r.doc_id][2])
    assert np.mean([len(x) for x in spread.values()]) < 2


def test_sources_that_share_a_prefix_stay_apart(spark):
    names = [f"https://www.site-{i:02d}.example" for i in range(16)]

    def index(of):
        df = spark.createDataFrame([(i, f"t{i}", "en", of(i % 17), 5) for i in range(340)], DOCS)
        return {r.doc_id: r.hilbert for r in sharding.assign(df).collect()}
    got = index(lambda k: names[k] if k < 16 else None)
    assert len(set(got.values())) == 17 and got == index(lambda k: f"{k:02d}" if k < 16 else None)


def test_sharding_odd_and_empty(odd, none, spark, tmp_path):
    rows = sharding.assign(odd).collect()
    assert len(rows) == 9 and len({(r.shard, r.slot) for r in rows}) == 9 and all(r.slot == 0 for r in rows)
    assert sharding.assign(none).count() == 0
    df = spark.createDataFrame([(i, f"t{i}", "en", "s", i) for i in range(30)], DOCS)
    sharding.write_shards(df, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.groupBy("shard").count().collect() and back.count() == 30
    rows = [(None, "a"), (None, "b"), (7, "c"), (7, "c"), (7, None)]
    sharding.write_shards(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS), str(tmp_path / "odd"), 2)
    assert sorted(str((r.doc_id, r.text)) for r in spark.read.parquet(str(tmp_path / "odd")).collect()) == sorted(map(str, rows))


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Cluster:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master, getCheckpointDir = "spark://x:7077", staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Cluster)


def test_pipeline_decides_stage_by_stage(spark, tmp_path):
    rng = random.Random(5)
    common = "the of and to in a is that for it was with on by".split()

    def text(n=120):
        return " ".join(rng.choice(common) if rng.random() < 0.4 else f"word{''.join(rng.choice('abcdefgh') for _ in range(4))}" for _ in range(n)) + "."

    item = text(40)
    clean = [text() for _ in range(40)]
    docs = [*clean, clean[0], " ".join("other" if k == 7 else w for k, w in enumerate(clean[1].split())), text() + " " + item.upper(), " ".join(w.upper() + "!!" for w in text().split()), "too short"]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(docs)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == set(range(40))
    assert out.where("NOT round_trip").count() == 0 and out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-dedup", "benchmark decontamination", "SentencePiece"]


def test_stages_take_odd_rows(spark, odd, none, tmp_path):
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        for df in (odd, none):
            assert stage(spark, df, str(tmp_path)).count() <= 9


def test_nothing_else_imports_the_subpackage():
    import pathlib

    top = pathlib.Path(line_dedup.__file__).parents[1]
    for f in top.rglob("*.py"):
        if f.parent.name != "llm":
            assert not re.search(r"(from|import)\s+[\w.]*\bllm\b", f.read_text()), f
    assert "sitegauge.llm" in sys.modules
