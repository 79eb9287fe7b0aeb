"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from probelake.llm import bpe_count, html_extract, language_id, mixing, near_dup, packing, quality_model, quality_rules, toxicity, vector_dup
from probelake.llm.common import connected_components, crc_mod

GPT, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
CLASH = [
    "n", "id", "kept", "size", "score", "component_id", "digest", "regs", "length", "label", "m", "row", "copies", "pattern",
    "target", "bucket"
]


def prose(rng, n, words="the of and to in house river stone walks green old small under light".split()):
    return " ".join(rng.choice(words) + rng.choice(["", "", "er", "ing", "ly"]) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    texts = [prose(rng, rng.randint(60, 160)) for _ in range(40)]
    near = texts[0].split()
    near[5] = "changed"
    texts += [
        texts[0], texts[0].upper().lower(), " ".join(near), None, "", "   \n ", "one", prose(rng, 9000), "#$%& " * 80,
        "same line here\n" * 60, "x" * 50_000, "naïve 日本 😀 " * 40
    ]
    out = [(i, t, "en" if i % 3 else "de", None if i % 11 == 0 else f"s{i % 4}") for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, "no id but some words here", None, None), (None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string"
    ).withColumn("n_chars", F.length("text").cast("long"))
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(i, int(i % 5 != 1), int(i % 7 == 2)) for i in range(40)] + [(3, None, None), (None, 1, 1), (2, 1, 0)],
        "doc_id long, quality int, toxic int"
    )


def empty(docs):
    return docs.where("false")


def brute_rules(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c, covered = collections.Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, rows):
    got = quality_rules.quality_verdicts(docs).collect()
    assert sorted(
        map(str, ((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got))
    ) == sorted(map(str, ((r[0], *brute_rules(r[1])) for r in rows)))
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept) and bool(r.reasons) == (not r.kept)
    assert quality_rules.quality_verdicts(empty(docs)).count() == 0
    kept = quality_rules.quality_filter(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_token_counts(docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(GPT)
    got = {(r.doc_id, r.n_bytes): (r.n_tokens, r.over_limit) for r in bpe_count.token_counts(docs, GPT).collect()}
    for i, t, *_ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i, len((t or "").encode())] == (n, n > 512)
    assert bpe_count.token_counts(empty(docs), GPT).count() == 0


def test_mixing(docs, rows):
    got = mixing.mix_sources(docs, F.array("source"), mixing.cycle_weights).collect()
    again = mixing.mix_sources(docs.repartition(5), F.array("source"), mixing.cycle_weights).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    total, biggest = sum(r.size for r in got), max(r.size for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.pattern[0]].append(r)
        assert 0 <= r.taken <= 2 * r.size
    assert sum(rs[0].target for rs in by.values()) == pytest.approx(min(1.5 * total, sum(rs[0].target for rs in by.values())))
    for rs in by.values():
        assert rs[0].source_size == sum(r.size for r in rs) and rs[0].target <= 2 * rs[0].source_size + 1e-6
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= biggest
    assert mixing.mix_sources(empty(docs), F.array("source"), mixing.cycle_weights).count() == 0
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    copies = collections.Counter()
    for r in got:
        copies[r.doc_id] += r.copies
    # every value of every row that is taken, as often as it is taken
    times = collections.Counter(map(tuple, out.collect()))
    source = {tuple(r) for r in docs.collect()}
    assert set(times) <= source and sum(times.values()) == sum(r.copies for r in got)
    for i in copies:
        assert sum(n for row, n in times.items() if row[0] == i) == copies[i]


def test_mixing_equal_rows_and_one_hot_source(spark):
    """Rows that repeat are counted, not told apart, and still fill the target."""
    rows = [(1, "a b c d", "s")] * 300 + [(i, "w " * (i % 7), "s" if i % 3 else "t") for i in range(2, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df, F.array("source"), mixing.cycle_weights).collect()
    assert len(got) == len(rows)
    for x in ("s", "t"):
        of = [r for r in got if r.pattern == [x]]
        assert abs(sum(r.taken for r in of) - of[0].target) <= 6 and all(0 <= r.taken <= 2 * r.size for r in of)
    assert mixing.mixed_documents(df).count() == sum(r.copies for r in got)


def test_mixing_shared_documents(spark):
    df = spark.createDataFrame(
        [(i, "w " * 10, ["a"] if i % 3 == 0 else ["a", "b"] if i % 3 == 1 else ["b"]) for i in range(60)],
        "doc_id long, text string, sources array<string>"
    )
    got = mixing.mix_sources(df, F.col("sources"), lambda names: {"a": 3.0, "b": 1.0}, share=1.0).collect()
    assert {tuple(r.pattern) for r in got} == {("a",), ("a", "b"), ("b",)}
    assert abs(sum(r.taken for r in got) - 600) <= 30


def test_packing(docs, rows):
    got = packing.pack_documents(docs, WORD).collect()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.update(
            (i, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k,
            at in enumerate(range(0, len(ids), 2048))
        )
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        assert [o for o, _ in sorted(items)] == list(
            np.cumsum([0, *[n for _, n in sorted(items)]])[:-1]
        ) and sum(n for _, n in items) <= 2048
    assert len(bins) <= 1.05 * sum(r.length for r in got) / 2048 + 1
    assert packing.pack_documents(empty(docs), WORD).count() == 0


def components(ids, links):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def brute_near(rows, k, percent):
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    links = [
        (a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return {i: (len(sets[i]), c) for i, c in components(sets, links).items()}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, k, percent):
    got = near_dup.near_duplicates(docs, k, percent).collect()
    want = brute_near(rows, k, percent)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert near_dup.near_duplicates(empty(docs)).count() == 0


def test_near_duplicate_chains(spark):
    """One large group of near copies, most pairs of which are not linked directly."""
    rng = random.Random(9)
    base, texts = [f"w{i}" for i in range(120)], []
    for _ in range(400):
        t = list(base)
        for at in rng.sample(range(120), rng.randint(1, 9)):
            t[at] = f"x{rng.randint(0, 30)}"
        texts.append(" ".join(t))
    rows = [(i, t) for i, t in enumerate(texts)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_near(rows, 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_drop_near_duplicates(docs, rows):
    out = near_dup.drop_near_duplicates(docs)
    want = brute_near(rows, 5, 80)
    assert out.columns == docs.columns
    assert sorted(
        r.doc_id for r in out.where("doc_id IS NOT NULL").collect()
    ) == sorted(i for i, (_, c) in want.items() if c == i)
    assert out.where("doc_id IS NULL").count() == 2


def test_unlike_texts_of_one_id_stay(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame(
        [(1, a, 1), (1, b, 2), (2, a, 3), (2, b + " more", 4), (3, b, 5), (1, a, 6)], "doc_id long, text string, n int"
    )
    out = near_dup.drop_near_duplicates(df)
    assert out.columns == ["doc_id", "text", "n"]
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, a), (1, b)]
    assert {(r.doc_id, r.component_id) for r in near_dup.near_duplicates(df, 3, 85).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_near_duplicates_in_open_buckets(spark):
    """Buckets whose centres leave several components, in small blocks, as the whole search finds them."""
    rng = random.Random(31)
    core, texts = [f"w{i}" for i in range(200)], []
    for group in range(6):
        mid = list(core)
        for at in rng.sample(range(200), 12):
            mid[at] = f"g{group}"
        for _ in range(25):
            t = list(mid)
            for at in rng.sample(range(200), rng.randint(0, 4)):
                t[at] = f"x{rng.randint(0, 9)}"
            texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(near_dup, "BLOCK", 20)
        patch.setattr(near_dup, "BLOCK_BYTES", 30_000)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, 3, 85).collect()}
    assert got == brute_near(list(enumerate(texts)), 3, 85)


def test_scratch_tables_go(spark, tmp_path):
    import os

    from probelake.llm import common

    kept = common.store(spark.range(5).toDF("x"), "kept")
    root = common.scratch_root(spark)
    gone = common.store(spark.range(5).toDF("x"), "gone")
    path = gone.inputFiles()[0].removeprefix("file://")
    common.drop_stored(gone)
    assert not os.path.exists(path) and kept.count() == 5
    assert root.split("/probelake-")[0]


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(40)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = components({x for e in links for x in e}, links)
    assert got == {i: c for i, c in want.items() if any(i in e and e[0] != e[1] for e in links)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_vectors(spark, monkeypatch, small):
    if small:  # many pivots, cells and blocks
        for name, value in {"CELL": 20, "BLOCK": 25, "GROUP": 4, "MOST_PIVOTS": 16, "COPIES": 99.0}.items():
            monkeypatch.setattr(vector_dup, name, value)
    rng = np.random.RandomState(3)
    centre = rng.randn(12, 16)
    vecs = [(centre[i % 12] + rng.randn(16) * rng.choice([0.02, 0.05, 0.3])).tolist() for i in range(300)]
    rows = [(1000 - i, v, i % 2) for i, v in enumerate(vecs)] + [
        (1001, vecs[0], 0), (1002, vecs[0], 1), (1003, None, 0), (1004, [0.0] * 16, 0), (1005, [float("nan")] * 16, 0),
        (1006, [None, 1.0], 0), (1007, vecs[0], None), (1008, [1.0, 0.0], 0), (1009, [2.0, 0.0], 0), (1010, [], 0),
        (1011, (3 * np.array(vecs[0])).tolist(), 0)
    ]
    df = spark.createDataFrame(
        rows, "vec_id long, embedding array<double>, label int"
    ).withColumn("id", F.lit(1)).withColumn("digest", F.lit("x"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dup.vector_duplicates(df).collect()}
    usable = {
        i: (np.array(v, float), x) for i, v,
        x in rows if v and x is not None and None not in v and np.isfinite(v).all() and any(v)
    }
    links = [
        (a, b) for a in usable for b in usable if a < b and usable[a][1] == usable[b][1] and len(usable[a][0]) == len(usable[b][0]) and usable[a][0] @ usable[b][0] / np.linalg.norm(usable[a][0]) / np.linalg.norm(usable[b][0]) >= 0.98
    ]
    n = collections.Counter(x for e in links for x in e)
    comp = components([r[0] for r in rows], links)
    assert got == {i: (n[i], comp[i], comp[i] == i) for i, *_ in rows}
    # different vectors that share an id link by their values only
    shared = spark.createDataFrame(
        [
            (1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (4, [0.02, 1.0], 0),
            (5, [1.0, 0.0], 0), (5, [1.0, 0.0], 0)
        ],
        "vec_id long, embedding array<double>, label int"
    )
    out = sorted((r.vec_id, r.n_links, r.component_id) for r in vector_dup.vector_duplicates(shared).collect())
    assert out == [(1, 2, 1), (1, 3, 1), (2, 3, 1), (3, 2, 1), (4, 2, 1), (5, 3, 1), (5, 3, 1)]
    assert vector_dup.vector_duplicates(df.where("false")).count() == 0


def test_pages(spark):
    good = '<html><body><nav><a href="/">Home</a></nav><article><h1>T</h1><p>a  b &amp; c</p><p>d</p></article><footer>&copy; x</footer></body></html>'
    rows = [
        (1, "u", good), (1, "u", good), (2, None, None), (None, "v", ""),
        (3, "w", "<article><p>" + "long " * 200_000 + "</p></article>"), (4, "x", "plain text only")
    ]
    df = spark.createDataFrame(
        rows, "page_id long, url string, html string"
    ).withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(0))
    got = html_extract.extract_pages(df).collect()
    text = {(r.page_id, r.url): r.text for r in got}
    assert len(got) == 6 and text[1, "u"] == "T\na b & c\nd" and text[2, None] == "" and text[None, "v"] == ""
    assert all(r.n_chars == len(r.text) for r in got) and len(text[3, "w"]) == 999_999
    assert html_extract.extract_pages(df.where("false")).count() == 0


def test_language(spark, docs):
    rng = random.Random(1)
    german = "der die und nicht schön straße ein haus fluss".split()
    rows = [(i, prose(rng, 30) if i % 2 else prose(rng, 30, german), "en" if i % 2 else "de") for i in range(80)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train_filters(train, crc_mod(F.col("doc_id"), 4) != 2)
    got = {r.doc_id: r for r in language_id.identify(train, model).collect()}
    assert sum(got[i].lang_pred == x for i, _, x in rows) >= 78
    out = language_id.identify(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out) and {r.lang_pred for r in out} <= {"en", "de", "und"}
    none = language_id.train_filters(train.where("false"), F.lit(True))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}
    assert language_id.identify(empty(docs), model).count() == 0


def test_quality_model(docs, labels):
    model = quality_model.train_quality(docs, labels, crc_mod(F.col("id"), 5) != 0)
    out = quality_model.score_quality(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    same = {r.score for r in out if r.doc_id == 3}
    assert len(same) == 1
    none = quality_model.train_quality(docs, labels.where("false"), F.lit(True))
    assert {r.score for r in quality_model.score_quality(docs, none).collect()} == {0.5}
    assert quality_model.score_quality(empty(docs), model).count() == 0


def test_toxicity(spark, docs):
    rng = random.Random(6)
    bad = ["idiot", "moron", "1d10t", "m0ron", "idiiiot", "i d i o t"]
    rows = [
        (
            i, prose(rng, 40) + " " + (rng.choice(bad[:2] if i < 120 else bad) if i % 2 else "") + " " + prose(rng, 10)
        ) for i in range(160)
    ]
    train, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(
        [(i, i % 2) for i in range(120)], "doc_id long, toxic int"
    )
    model = toxicity.train_toxicity(train, labels, crc_mod(F.col("id"), 5) != 0)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(train, model).collect()}
    assert sum((got[i] >= 0.5) == bool(i % 2) for i in range(160)) >= 156
    kept = toxicity.drop_toxic(train.withColumn("score", F.lit("clash")), model)
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == sum(s < 0.5 for s in got.values())
    out = toxicity.score_toxicity(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    none = toxicity.train_toxicity(docs, labels.where("false"), F.lit(True))
    assert {r.score for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}
    assert toxicity.score_toxicity(empty(docs), model).count() == 0


def test_pipeline(spark, tmp_path, docs, labels, rows):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, source = at.columns, {tuple(r) for r in at.collect()}
    ids = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path)).cache()
        assert at.columns == columns, name
        found = at.collect()
        assert {tuple(r) for r in found} <= source, name  # every value of every column as it was
        ids[name] = collections.Counter(r.doc_id for r in found)
    verdicts = {r.doc_id: r.kept for r in quality_rules.quality_verdicts(docs).collect()}
    assert set(ids["quality_rules"]) == {i for i, kept in verdicts.items() if kept}
    assert set(ids["toxicity"]) <= set(ids["quality_rules"]) and max(ids["near_duplicates"].values()) == 1
    clean = [r for r in rows if r[0] in ids["toxicity"]]
    near = brute_near(clean, 5, 80)
    assert set(ids["near_duplicates"]) - {None} == {i for i, (_, c) in near.items() if i == c}
    assert max(ids["mixing"].values()) <= 2
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert last and max(r.offset + r.length for r in last) <= 2048
    whole = collections.Counter(r.doc_id for r in last if r.piece == 0)
    assert whole == ids["mixing"]
    nothing = empty(docs)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0
