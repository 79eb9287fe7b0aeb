"""The methods behind the operators, without Spark."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

import public_tokenizers
from probelake.llm import bpe_count, html_extract, language_id, mixing, packing, quality_model, set_sketch, toxicity, vector_dup
from probelake.llm.near_dup import Shingler, _alike


TEXTS = [
    "", " ", "a", "Hello world", "  two  spaces\n\nline \t tab\r\n", "don't we'll I'M", "über naïve ☃ 😀 日本語 ١٢٣",
    "aaaaaaaaaaaaa aaaaaa", "x" * 3000, "<|endoftext|> a <|endoftext|><|endoftext|>", "a\x1cb\x85c\xa0d e", "1234567 12.5%",
    "é é ﬁ İ ǅ", "***### $$$ %%%", "<|startoftext|> q"
]


def test_counts_equal_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    counter, library = bpe_count.ArrayBpe(bpe_count.read_vocabulary(path)), Tokenizer.from_file(path)
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choices("aAbé  \n.'s1<|>*☃", k=rng.randint(0, 60))) for _ in range(300)]
    assert counter.count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_chunk_ids_equal_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, library = packing.ChunkTokenizer(bpe_count.read_vocabulary(path).decode(), memo=20), Tokenizer.from_file(path)
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choices("aAbÉ  \n.'s1<|>*☃-ß,", k=rng.randint(0, 60))) for _ in range(300)]
    for t, ids in zip(texts, tokenizer.ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_chunk_ids_of_a_frequent_word_are_looked_up_once():
    """A text's cost is in its bytes and distinct words: no Python object is made or looked up for each word."""
    from tokenizers import Tokenizer

    path, looked_up = public_tokenizers.path("word_bpe_49k.json"), []

    class Counting(packing.Memo):
        def reader(self, keys, make):
            get = super().reader(keys, make)
            return lambda key: looked_up.append(key) or get(key)

    tokenizer, library = packing.ChunkTokenizer(bpe_count.read_vocabulary(path).decode()), Tokenizer.from_file(path)
    tokenizer.pieces = Counting()
    texts = ["The cat, the HAT; 12 cats\n" * 500] * 10
    want = library.encode(texts[0], add_special_tokens=False).ids
    assert all(np.frombuffer(ids, "<u4").tolist() == want for ids in tokenizer.ids(texts))
    assert len(looked_up) == 8  # the cat , hat ; 1 2 cats


def test_chunk_ids_of_slices_and_borders():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, library = packing.ChunkTokenizer(bpe_count.read_vocabulary(path).decode()), Tokenizer.from_file(path)
    letters = "".join(map(chr, range(0xA0, 0x100)))
    texts = [
        "skipped", None, "ab", "cd", "", "1", "23", "<", "|endoftext|>", "a<|endoftext|>b", "<|", *letters, letters, "x×y", "été ÉTÉ",
        "a\u0301b", "a\x0bb\x1cc", "don't", "it", "'s", "", "x" * 500, "É" * 300 + " ok", " \n\t", "!" * 450, None, "Ü"
    ]
    for column in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(texts[:9]), pa.array([None, "", None, ""])):
        part = column.slice(1)
        for t, ids in zip(part.to_pylist(), tokenizer.ids(part), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids, t
    assert tokenizer.ids([]) == []
    broken = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, 2], np.int32)), pa.py_buffer(b"\xc3a")])
    with pytest.raises(pa.ArrowInvalid):
        tokenizer.ids(broken)


def test_sketch_merges_and_estimates():
    rng = np.random.RandomState(0)
    m, errors = 192, []
    for j in (0.5, 0.8, 0.85, 0.95, 1.0):
        both = int(1000 * j)
        pool = rng.randint(0, 2**63, 1000, np.int64).astype(np.uint64)
        rest = (1000 - both) // 2
        a, b = np.unique(pool[: both + rest]), np.unique(np.r_[pool[:both], pool[both + rest :]])
        ra, rb, ru = (set_sketch.registers(x, np.array([0]), m)[0] for x in (a, b, np.unique(np.r_[a, b])))
        assert (set_sketch.merge(ra, rb) == ru).all()
        est = set_sketch.estimate(
            np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]), np.array([len(a)]), np.array([len(b)]), m
        )[0]
        errors.append(abs(est - both / len(np.unique(np.r_[a, b]))))
    assert max(errors) < 0.12


def test_shingles_and_exact_links():
    s = Shingler(3).sets(["A b c d", "a B C d", "a b", "a  b", "b a", "", None, "a b c d e"])
    assert [len(x) for x in s] == [2, 2, 1, 1, 1, 0, 0, 3]
    assert (s[0] == s[1]).all() and (s[2] == s[3]).all() and s[2][0] != s[4][0]
    assert _alike(s[0], s[7], 66) and not _alike(s[0], s[7], 67)


def test_water_fill():
    t = mixing.water_fill({"a": 10, "b": 100, None: 100}, {"a": 5, "b": 2, None: 1}, 315, 2)
    assert t["a"] == 20 and t["b"] == pytest.approx(295 * 2 / 3) and sum(t.values()) == pytest.approx(315)
    assert mixing.water_fill({"a": 1}, {"a": 1}, 99, 2) == {"a": 2}
    assert mixing.water_fill({"a": 0, "b": 4}, {"a": 1, "b": 1}, 6, 2) == {"a": 0, "b": 6}


def test_flow_prefers_first_repetitions():
    patterns = {("a",): 100.0, ("a", "b"): 100.0, ("b",): 50.0}
    flow = mixing.route(patterns, {"a": 150.0, "b": 100.0}, 2)
    assert sum(flow[p].get("a", 0) for p in patterns) == pytest.approx(150)
    assert sum(flow[p].get("b", 0) for p in patterns) == pytest.approx(100)
    assert all(sum(f.values()) <= patterns[p] + 1e-6 for p, f in flow.items())


def test_flow_equals_exhaustive_search():
    """Whole-numbered networks: every split of every pattern's words is tried."""
    import itertools

    rng = random.Random(12)
    for _ in range(40):
        names = ["a", "b", "c"][: rng.randint(1, 3)]
        sets = [p for k in range(1, len(names) + 1) for p in itertools.combinations(names, k)]
        patterns = {p: float(rng.randint(0, 2)) for p in rng.sample(sets, rng.randint(1, min(3, len(sets))))}
        targets = {x: float(rng.randint(0, 4)) for x in names}
        ways = [
            [w for w in itertools.product(range(int(2 * size) + 1), repeat=len(p)) if sum(w) <= 2 * size] for p,
            size in patterns.items()
        ]
        best = None
        for chosen in itertools.product(*ways):
            given = dict.fromkeys(names, 0)
            for p, w in zip(patterns, chosen, strict=True):
                for x, n in zip(p, w, strict=True):
                    given[x] += n
            if all(given[x] <= targets[x] for x in names):
                cost = sum(max(0, sum(w) - size) for w, size in zip(chosen, patterns.values(), strict=True))
                value = (sum(map(sum, chosen)), -cost)
                best = value if best is None else max(best, value)
        flow = mixing.route(patterns, targets, 2)
        taken = {p: sum(flow[p].values()) for p in patterns}
        assert (sum(taken.values()), -sum(max(0.0, t - patterns[p]) for p, t in taken.items())) == pytest.approx(best)
        assert all(sum(flow[p].get(x, 0) for p in patterns) <= targets[x] + 1e-6 for x in names)


def test_flow_of_many_patterns():
    rng, patterns = random.Random(3), {}
    while len(patterns) < 20_000:
        patterns[tuple(sorted(rng.sample(range(50), rng.randint(1, 5))))] = rng.randint(1, 1000)
    size: dict = {}
    for p, n in patterns.items():
        for x in p:
            size[x] = size.get(x, 0) + n
    targets = mixing.water_fill(size, {x: 1.0 + x % 3 for x in size}, 1.5 * sum(patterns.values()), 2)
    begun = time.time()
    flow = mixing.route(patterns, targets, 2)
    assert time.time() - begun < 30
    for x in size:
        assert sum(f.get(x, 0) for f in flow.values()) == pytest.approx(targets[x], rel=1e-6)


def test_packing_choice_uses_all_capacities():
    rng = random.Random(8)
    counts: dict[int, int] = {}
    for _ in range(2000):
        x = min(2048, int(rng.lognormvariate(5.5, 1)) + 1)
        counts[x] = counts.get(x, 0) + 1
    plans = [packing.VectorPacker(2048, weights=w).pack(dict(counts)) for w in ((1.0, 0.05, 0.05), (1.0, 0.0, 0.0))]
    assert plans[0][0] != plans[1][0]
    least = -(-sum(k * v for k, v in counts.items()) // 2048)
    assert all(bins <= least + 2 for _, bins in plans)


@pytest.mark.parametrize(
    "limits", [{}, {"max_docs": 3}, {"max_attention": 500_000.0}, {"max_docs": 5, "max_attention": 900_000.0}]
)
@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packer_holds_all_limits(limits, rule):
    rng = random.Random(1)
    counts: dict[int, int] = {}
    top = 700 if "max_attention" in limits else 2048
    for _ in range(3000):
        x = min(top, int(rng.paretovariate(0.7) * 20))
        counts[x] = counts.get(x, 0) + 1
    packer = packing.VectorPacker(2048, limits.get("max_docs"), limits.get("max_attention"), rule)
    plan, bins = packer.pack(counts)
    load: dict[int, list] = {}
    seen: dict[int, set] = {}
    for length, rank, n, first, offset in plan:
        ranks = set(range(rank, rank + n))
        assert not ranks & seen.setdefault(length, set())
        seen[length] |= ranks
        for i in range(n):
            load.setdefault(first + i, []).append((offset, length))
    assert {k: len(v) for k, v in seen.items()} == counts and len(load) == bins
    for items in load.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048 and len(items) <= limits.get("max_docs", 10**9) and sum(x * x for _, x in items) <= limits.get("max_attention", 1e18)
    if not limits:
        assert bins <= 1.02 * sum(k * v for k, v in counts.items()) / 2048 + 1


def test_parser_is_lenient():
    p = html_extract.parse(
        '<p>a<p>b <b>c</i><div>d</p>e<script>var x="</p>"</script><!-- no --><br>f&amp;g &lt;x</div><ul><li>1<li>2</ul><td>q'
    )
    assert [t for _, t in p.segments] == ["a", "b c", "d", "e f&g <x", "1", "2", "q"]
    assert html_extract.parse("").segments == [] and html_extract.parse("<<<a <b").segments
    assert [t for _, t in html_extract.parse("<p title='a>b\">x</p>y" * 50).segments]


def test_messages_equal_enumeration():
    import itertools

    rng = np.random.RandomState(2)
    parent, n = np.array([-1, 0, 0, 1, 1, 2]), 6
    depth = np.array([0, 1, 1, 2, 2, 2])
    f = html_extract.Forest(rng.randn(n, html_extract.N_FEATURES), np.array([2, 0, 1, 2, 0, 1]), parent, depth)
    model = html_extract.TreeModel(rng.randn(html_extract.N_FEATURES) / 3, rng.randn(3, 2, 2))
    p, pair = model.marginals(f)
    total, mass, joint = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for y in itertools.product((0, 1), repeat=n):
        e = np.exp(
            sum(y[i] * (f.x[i] @ model.w) for i in range(n)) + sum(
                model.edge[f.kind[i], y[parent[i]], y[i]] for i in range(1, n)
            )
        )
        total += e
        mass += e * np.array(y)
        for i in range(1, n):
            joint[i, y[parent[i]], y[i]] += e
    assert np.allclose(p, mass / total) and np.allclose(pair[1:], joint[1:] / total)


def test_held_out_pages():
    model, rng = html_extract.train(150), random.Random(77)
    right = blocks = 0
    for _ in range(60):
        page = html_extract.parse(html_extract.labelled_page(rng))
        p, _ = model.marginals(html_extract.Forest.of([page]))
        for b, _ in page.segments:
            right += (p[b] > 0.5) == (page.marks[b] == "1")
            blocks += 1
    assert right / blocks > 0.97


def test_filters_tell_languages_apart():
    rng = random.Random(3)
    make = lambda s: " ".join("".join(rng.choices(s, k=rng.randint(1, 3))) for _ in range(60))
    langs = {"aa": ["ta", "ri", "mo"], "bb": ["sch", "en", "ung"], "cc": ["eau", "oi", "é"]}
    masks = np.zeros((1, language_id.POSITIONS), np.uint64)
    for i, s in enumerate(langs.values()):
        for h, _ in language_id.grams([make(s) for _ in range(20)]):
            for at in language_id._positions(h):
                masks[0, at] |= np.uint64(1 << i)
    model = language_id.LanguageFilters(list(langs), masks)
    texts = [make(s) for s in langs.values()] + [None, "", "123 !", "ta"]
    lang, score = model.predict(texts)
    assert lang[:3] == list(langs) and lang[3:6] == ["und"] * 3 and lang[6] == "aa"
    assert all(0 <= x <= 1 for x in score)


def test_restores_disguised_words():
    corpus = "the silly idiot was a moron and the stupid clown said idiot moron stupid clown trash " * 40
    s = toxicity.symbols("  " + corpus + "  ")
    counts = np.bincount((s[:-2] * 62 + s[1:-1]) * 62 + s[2:], minlength=62**3).reshape(62, 62, 62)
    r = toxicity.Restorer(toxicity.CharacterModel(counts).log_p)
    for disguised in ("1d10t", "id1ot!!", "idiiiiot", "i.d.i.o.t", "m0r0n***", "$tupid", "(clown),", "tra$h"):
        want = {"1": "idiot"}.get(disguised[0], None)
        got = r.restore(disguised.lower())
        assert got in ("idiot", "moron", "stupid", "clown", "trash"), (disguised, got, want)
    reader = toxicity.FeatureReader(r.log_p if isinstance(r.log_p, np.ndarray) else np.array(r.log_p), None)
    assert toxicity.feature_hashes("idiot")[0] in reader.of(["you i d i o t !"])[0]
    assert reader.of([None, "", "!! ... --"]) == [set(), set(), set()]


def test_attention_learns_bags():
    rng = np.random.RandomState(0)
    x, of, y = [], [], []
    for i in range(200):
        bad = i % 2
        k = rng.randint(1, 9)
        bag = rng.randn(k, 5) * 0.3
        if bad:
            bag[rng.randint(k), 0] += 4
        x.append(bag)
        of += [i] * k
        y.append(1.0 - bad)
    model = quality_model.fit(np.concatenate(x), np.array(of), np.array(y), np.ones(200), steps=200)
    s = model.forward(np.concatenate(x), np.array(of), 200)
    assert ((s["p"] > 0.5) == np.array(y)).mean() > 0.97
    assert np.allclose(np.add.reduceat(s["att"], s["starts"]), 1)


def test_passage_features_are_of_whole_texts():
    x, of = quality_model.passage_features(["a b c", "", None, "w " * 130 + "END"])
    assert of.tolist() == [0, 1, 2, 3, 3, 3] and (x[1] == 0).all()
    one, _ = quality_model.passage_features(["w " * 130 + "END"])
    assert np.allclose(one, x[3:])


def test_pivots_are_apart():
    rng = np.random.RandomState(1)
    x = rng.randn(50, 8)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[10:30] = x[10]
    p = x[vector_dup.choose_pivots(x, 12, 0.5)]
    d = ((p[:, None] - p[None]) ** 2).sum(2) + 9 * np.eye(len(p))
    assert 1 < len(p) <= 12 and d.min() > 0.25


def test_word_class_of_native_split():
    assert re.findall(r"[^\x20\x09-\x0D]+", "a\x0bb\x1cc d") == ["a", "b\x1cc", "d"]


def test_long_pieces_equal_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    counter, library = bpe_count.ArrayBpe(bpe_count.read_vocabulary(path)), Tokenizer.from_file(path)
    rng = random.Random(14)
    texts = [
        "".join(rng.choices(of, k=n)) for n in (300, 450, 3000) for of in (
            "ab", "aaaaab", "abcdefghijklmnopqrstuvwxyz", "aé日😀"
        ) for _ in range(4)
    ] + ["a" * 5001]
    assert counter.count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("of", ["abcdefghijklmnopqrstuvwxyz", "x"])
def test_hostile_pieces_are_counted_in_time(of):
    counter = bpe_count.ArrayBpe(bpe_count.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
    begun = time.time()
    assert counter.count(["".join(random.Random(1).choices(of, k=2_000_000))])[0] > 10_000
    assert time.time() - begun < 30


def _hostile_pages(n):
    return {
        "unclosed": "<a " * (n // 3), "nested": "<div>" * (n // 5),
        "stray ends": "<div>" * (n // 10) + "</section>" * (n // 20), "inline": "<b>" * (n // 8) + "<div></div>" * (n // 20),
        "items": "<div>" * (n // 10) + "<li></li>" * (n // 18), "name": "<div " + "a" * n + ">x",
        "quotes": '<a ">" ' * (n // 7), "sections": "<![CDATA[" * (n // 9), "less than": "<" * n,
        "ends": "<i><div>" + "<b>" * (n // 6) + "</i>" * (n // 8),
    }


@pytest.mark.parametrize("name", list(_hostile_pages(20)))
def test_hostile_pages_are_parsed_in_time(name):
    model, begun = html_extract.train(60), time.time()
    html_extract.extract(model, [_hostile_pages(2_000_000)[name]])
    assert time.time() - begun < 90


def test_pages_not_made_by_the_generator():
    """Written by hand, without the generator's layouts; menus and the like by markup or by their links."""
    pages = {
        "<html><head><title>x</title></head><body><div id='banner-top' class='masthead'><p>The Daily Note</p></div><main><h1>Bread at home</h1><p>Flour, water and salt.</p><p>Bake it for <b>one</b> hour.</p>"
        "</main><div class='comments'><p>Great, thanks!</p></div><footer><p>Imprint</p></footer></body></html>": "Bread at home\nFlour, water and salt.\nBake it for one hour.",
        "<body><nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></nav><article><h2>Rain</h2><p>It rained all day.</p><aside>Read more</aside><ul><li>Monday: rain</li><li>Tuesday: rain</li></ul>"
        "<script>var a = '<p>no</p>';</script><p>It will rain again.</p></article><div class='cookie-notice'><p>We use cookies.</p></div></body>": "Rain\nIt rained all day.\nMonday: rain\nTuesday: rain\nIt will rain again.",
        "<body><header><p>Site</p></header><div class='content'><p>First &lt;b&gt; line.</p><blockquote>A  quote\n\there.</blockquote><form><p>Join us</p><input></form><p>Last line.</p></div><div class='sidebar'><p>Also on this site</p></div></body>": "First <b> line.\nA quote here.\nLast line.",
    }
    assert html_extract.extract(html_extract.train(), list(pages)) == list(pages.values())


def _plain_features(text):
    """The passage features of one text in plain Python."""
    found = [(m.group(), m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    out = []
    for at in range(0, max(1, len(found)), quality_model.PASSAGE):
        part = found[at : at + quality_model.PASSAGE]
        ws = [w for w, _, _ in part]
        if not ws:
            out.append([0.0] * quality_model.FEATURES)
            continue
        chars, n = sum(map(len, ws)), len(ws)
        kind = lambda c: "U" if c.isupper() else "L" if c.isalpha() else "D" if c.isdigit() else "S" if c in "#*$%&|<>~^=+@_\\/{}[]" else "P" if c in ".,;:!?" else "R"
        share = [sum(kind(c) == k for w in ws for c in w) / chars for k in "LUDSPR"]
        earlier = [w for w, _, _ in found[:at]]
        triples = [tuple(earlier[i : i + 3]) for i in range(len(earlier))]
        whole = [w for w, _, _ in found]
        tri = lambda i: (tuple(whole[i : i + 3])) if i + 2 < len(whole) else None
        seen = {tri(i) for i in range(at) if tri(i)}
        again = 0
        for i in range(at, at + n):
            if tri(i) and tri(i) in seen:
                again += 1
            seen.add(tri(i))
        lines = sum(i + 1 < len(found) and "\n" in text[found[i][2] : found[i + 1][1]] for i in range(at, at + n))
        same = sum(i > 0 and whole[i] == whole[i - 1] for i in range(at, at + n))
        out.append([
            *share, chars / n / 10, sum(len(w) ** 2 for w in ws) / n / 100, sum(len(w) <= 3 for w in ws) / n,
            sum(len(w) >= 15 for w in ws) / n, (n - len(set(ws))) / n, same / n, again / n, lines / n,
            min(n / quality_model.PASSAGE, 1.0), sum(kind(w[-1]) == "S" for w in ws) / n,
        ])
        assert triples is not None
    return out


def test_passage_features_equal_plain_python():
    rng = random.Random(5)
    vocabulary = ["the", "River", "a", "99", "stone,", "##", "x$", "walks", "incomprehensibility", "no!", "über", "日本", "B2"]
    for n in (0, 1, 5, 64, 65, 200):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\n", "  "]) for _ in range(n)) + ("end." if n else "")
        got, _ = quality_model.passage_features([text])
        want = np.array(_plain_features(text))
        # the last two words of a text have no window of three of their own in plain Python
        assert got.shape == want.shape and np.allclose(np.delete(got, 12, 1), np.delete(want, 12, 1)), n
        assert np.abs(got[:, 12] - want[:, 12]).max() <= 2 / quality_model.PASSAGE + 1e-9


def test_attention_gradients_equal_differences():
    """One step of learning moves every weight against the slope measured by small differences."""
    rng = np.random.RandomState(1)
    x, of, y = rng.randn(30, 4), np.repeat(np.arange(10), 3), (np.arange(10) % 2).astype(float)
    before, after = (quality_model.fit(x, of, y, np.ones(10), width=3, steps=k, shrink=0.0) for k in (0, 1))

    def loss(model):
        p = model.forward(x, of, 10)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name in ("we", "be", "wv", "wu", "wa", "wc", "bc"):
        value, moved = getattr(before, name), getattr(after, name) - getattr(before, name)
        for at in np.ndindex(value.shape):
            old, slope = value[at], 0.0
            for sign in (1, -1):
                value[at] = old + sign * 1e-5
                slope += sign * loss(before) / 2e-5
            value[at] = old
            if abs(slope) > 1e-5:  # the first step of Adam has the slope's sign and a fixed length
                assert np.sign(moved[at]) == -np.sign(slope) and abs(moved[at]) == pytest.approx(0.03, rel=0.01)


def test_viterbi_equals_all_readings():
    """Every path through the lattice of a short token is scored by itself."""
    import itertools

    corpus = "the idiot said a silly lie to all his sad old clowns and left its shell " * 30
    s = toxicity.symbols("  " + corpus + "  ")
    log_p = toxicity.CharacterModel(
        np.bincount((s[:-2] * 62 + s[1:-1]) * 62 + s[2:], minlength=62**3).reshape(62, 62, 62)
    ).log_p
    restorer, rng = toxicity.Restorer(log_p), random.Random(6)

    def score(letters, cost):
        a = b = 0
        for c in letters:
            cost += float(log_p[a, b, toxicity.symbol(c)])
            a, b = b, toxicity.symbol(c)
        return cost + float(log_p[a, b, 0])

    for _ in range(60):
        token = "".join(rng.choices("aiilssdto1034$!.", k=rng.randint(1, 6)))
        options = []
        for i, c in enumerate(token):
            if c.isalpha():
                options.append([(c, 0.0)] + ([("", toxicity.SKIP_REPEAT)] if i and token[i - 1] == c else []))
            else:
                skip = toxicity.KEEP_ODD if c.isdigit() else toxicity.SKIP_SEPARATOR
                options.append(
                    [(x, toxicity.IMITATE) for x in toxicity.IMITATES.get(c, "")] + [("", skip), (c, toxicity.KEEP_ODD)]
                )
        best = max(score("".join(o for o, _ in path), sum(c for _, c in path)) for path in itertools.product(*options))
        got = restorer.decode(token)
        reached = max(
            score(got, sum(c for _, c in path)) for path in itertools.product(*options) if "".join(o for o, _ in path) == got
        )
        assert reached == pytest.approx(best, abs=1e-4), token


def test_tokens_without_letters_are_read():
    corpus = "you are an ass and a leet clown who says shit to the ass of a leet shit " * 50
    s = toxicity.symbols("  " + corpus + "  ")
    r = toxicity.Restorer(
        toxicity.CharacterModel(np.bincount((s[:-2] * 62 + s[1:-1]) * 62 + s[2:], minlength=62**3).reshape(62, 62, 62)).log_p
    )
    assert r.restore("455") == "ass" and r.restore("1337") == "leet" and r.restore("$#!7") == "shit" and r.restore("--") == ""


def test_long_tokens_are_restored_in_time():
    r = toxicity.Restorer(np.full((62, 62, 62), -4.0, np.float32))
    begun = time.time()
    for token in ("1" * 200_000, "a" * 200_000, "." * 100_000 + "a"):
        r.restore(token)
    assert time.time() - begun < 60


def test_filters_equal_exact_gram_sets():
    """Apart from false positives a filter names exactly the languages that hold an n-gram."""
    rng = random.Random(7)
    words = {"aa": "tal rim mor tar".split(), "bb": "schon ende ungut".split()}
    texts = {k: [" ".join(rng.choices(v, k=40)) for _ in range(10)] for k, v in words.items()}
    held = {k: {int(x) for h, _ in language_id.grams(v) for x in h} for k, v in texts.items()}
    cut = lambda t: [f" {t} "[i : i + n] for n in language_id.SIZES for i in range(len(t) + 3 - n)]
    plain = {k: {g for t in v for g in cut(t)} for k, v in texts.items()}
    assert {k: len(v) for k, v in held.items()} == {k: len(v) for k, v in plain.items()}
    masks = np.zeros((1, language_id.POSITIONS), np.uint64)
    for i, k in enumerate(words):
        for at in language_id._positions(np.array(sorted(held[k]), np.uint64)):
            masks[0, at] |= np.uint64(1 << i)
    model = language_id.LanguageFilters(list(words), masks)
    probe = [" ".join(rng.choices(words["aa"] + words["bb"], k=12)) for _ in range(20)]
    hits, total = model.hits(probe)
    for row, t, n in zip(hits, probe, total, strict=True):
        assert n == len(cut(t))
        for i, k in enumerate(words):
            assert row[i] == pytest.approx(sum(g in plain[k] for g in cut(t)), abs=0.5)


def test_memo_is_bounded_in_bytes():
    from probelake.llm.common import Memo

    memo, asked = Memo(limit=50_000), []
    for k in range(40):
        keys = {f"{k}-{i}" for i in range(100)} | {"again", "long" * 5000}
        get = memo.reader(keys, lambda new: [asked.append(x) or x.upper() for x in new])
        assert all(get(x) == x.upper() for x in keys)
        assert memo.held < 50_000 + 102 * 200 and "long" * 5000 not in memo and "long" * 5000 not in memo.old
    assert asked.count("again") == 1


def test_pivots_of_two_levels_miss_no_pair():
    rng = np.random.RandomState(4)
    x = rng.randn(900, 3)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    radius = float(np.sqrt(2 - 2 * 0.98))
    pairs = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.98), strict=True) if i != j}
    for n, groups in ((2, 128), (20, 128), (64, 5)):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(vector_dup, "GROUP", groups)
            centres, pivots = vector_dup.pivot_groups(x, n, 0.0)
        assert len(centres) == (1 if n <= groups else 8)
        rows, cells, core = vector_dup.assign_cells(x, centres, pivots, radius)
        assert np.bincount(rows[core], minlength=900).tolist() == [1] * 900
        own = dict(zip(rows[core].tolist(), cells[core].tolist(), strict=True))
        there = set(zip(rows.tolist(), cells.tolist(), strict=True))
        assert all((j, own[i]) in there for i, j in pairs)
        assert len(rows) < 900 * sum(map(len, pivots)) or n == 2


def test_many_pivots_hold_little_memory():
    """20,000 pivots: distances are held by blocks, never all by all."""
    import tracemalloc

    rng = np.random.RandomState(2)
    x = rng.randn(22_000, 8).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tracemalloc.start()
    centres, pivots = vector_dup.pivot_groups(x, vector_dup.MOST_PIVOTS, 0.0)
    vector_dup.assign_cells(x[:2000], centres, pivots, 0.05)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, pivots)) > 15_000 and peak < 500e6
