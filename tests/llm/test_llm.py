"""Every operator on awkward rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from limpid.llm.ann import nearest
from limpid.llm.decontaminate import contamination
from limpid.llm.jaccard import divide_skip, jaccard_components, need
from limpid.llm.langid import identify, learn
from limpid.llm import linededup, phrases
from limpid.llm.licenses import NOTICES, SHINGLE, Templates, apart, known_templates, scan_licenses
from limpid.llm.linededup import dedup_lines
from limpid.llm.ngramlm import score_texts
from limpid.llm.packing import OpenBins, pack
from limpid.llm.phrases import Codes, remove_repeats
from limpid.llm.queries import TOKENIZER
from limpid.llm.secrets import scan_secrets

SPACE = re.compile("[^ \t-\r]+")
A = " ".join(f"w{i}" for i in range(60))
LINE = "A line that is long enough to count."
ROWS = [
    (1, A, "s1"), (2, A + " more", "s2"), (2, A + " more", "s2"), (3, "other " + A[:240], "s1"), (4, None, None), (5, "", "s3"), (None, "no id " + A[:50], "s3"),
    (7, f"{LINE}\nshort\n {LINE.upper()} ", "s1"), (8, LINE, "s2"), (9, f"x\n{LINE}\t", "s2"), (10, "é" * 5, "s1"), (11, "same " * 200, "s1"), (12, 'token = "abcdEFGH12345678" AKIAABCDEFGHIJKL0', "s1"),
    (13, "Ünïcode " + "0123456789abcdef" * 3 + " password: short", "s2"), (14, "Released under the MIT License. 12 ... !", "s1"), (15, "1 2 3 !!", "s2"), (16, "long " * 30000, "s1"),
]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3).coalesce(2)
    return spark.createDataFrame(df.collect(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA + ", lang string")


def low(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def words(t):
    return SPACE.findall(t or "")


def test_divide_skip():
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.choice(10**6, 300, replace=False).astype(np.uint64)
    sets = [np.unique(np.r_[base[rng.random(300) > 0.07], rng.choice(10**6, 5).astype(np.uint64)]) for _ in range(40)]
    linked = {(i, j) for i in range(40) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= need(len(sets[i]) + len(sets[j]), 85)}
    found = {(max(p), min(p)) for p in divide_skip(sets, 85)}
    assert found <= linked

    def parts(pairs):
        up = [*range(40)]
        for _ in up:
            for a, b in pairs:
                up[a] = up[b] = min(up[a], up[b])
        return up

    assert parts(found) == parts(linked)


def test_lines(docs, none):
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    where = defaultdict(set)
    for d, t, _ in ROWS:
        for x in (t or "").split("\n"):
            where[key(x)].add(d if d is not None else -1)
    expected = []
    for d, t, _ in ROWS:
        own = (t or "").split("\n")
        left = [x for x in own if not (len(key(x)) >= 20 and len(where[key(x)]) >= 3 and max(where[key(x)]) != d)]
        expected.append((d, len(own), len(own) - len(left), "\n".join(left)))
    got = dedup_lines(docs, batches=3, fanout=2).select("doc_id", "n_lines", "n_dropped", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr) and sum(e[2] for e in expected) == 3
    assert dedup_lines(none).count() == 0


def test_secrets(docs, none):
    kinds = [("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32)]
    expected = sorted((d, sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(kinds) for m in re.finditer(p, t or "", re.A) if len(m[g]) >= n)) for d, t, _ in ROWS if d is not None)
    got = sorted((r.doc_id, [(x.start, x.kind, x.end) for x in r.findings if x.kind < 3]) for r in scan_secrets(docs).collect() if r.doc_id is not None)
    assert got == expected and sum(len(x) for _, x in got) == 3
    assert scan_secrets(none).count() == 0


def test_secret_ownership(spark):
    """Generic tokens and who holds a value: one owner's looks live, several owners' or very many documents' doesn't."""
    token, other, base = "Zx9" + "aB3" * 8, "Qw7" + "cD4" * 8, "token=abcdEFGH12345678"
    rows = [(1, f"{token} x", "a"), (2, f"{other} {base}", "a"), (3, f"{other}", "b"), (4, f"key {base} {token}", "a"), (4, f"again {token}", "b2"), (None, f"{base}", None)]
    rows += [(i, "AKIAABCDEFGHIJKL9 Mn5" + "eF6" * 8, "hot") for i in range(100, 112)] + [(50, "Kk1" + "gH2" * 8 + " token=" + "Kk1" + "gH2" * 8, "c")]
    rows += [(60, " ".join(["deadbeef" * 4, "Vv8" + "iJ9" * 8] * 3000), "d")]
    got = {(r.doc_id, len(r.findings)): r.findings for r in scan_secrets(spark.createDataFrame(rows, SCHEMA)).collect()}
    found = lambda d: [(x.start, x.kind, x.end, x.n_repos, x.n_owners, x.live) for k, v in got.items() if k[0] == d for x in v]
    assert found(1) == [] and found(3) == []  # both tokens have two owners
    assert found(2) == [(28, 0, 50, 3, 2, False)] and found(None) == [(0, 0, 22, 3, 2, False)]
    assert found(100) == [(0, 1, 17, 12, 1, False)]  # one owner, but twelve documents; the generic token likewise
    assert [x[:3] for x in found(50)] == [(0, 3, 27), (28, 0, 61)] and all(x[5] for x in found(50))
    many = found(60)
    assert len(many) == 6000 and many[0][:3] == (0, 2, 32) and many[1][:3] == (33, 3, 60) and many[-1][2] == 60 * 3000 + 3000 - 1 + 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    library, out = Tokenizer.from_file(TOKENIZER["path"]), pack(docs, **TOKENIZER).collect()
    ids = {d: library.encode(t or "", add_special_tokens=False).ids + [0] for d, t, _ in ROWS}
    for r in out:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own)) == r.ids_crc32
    assert sum(r.length for r in out) == sum(len(ids[d]) for d, _, _ in ROWS)
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:] + [(sum(n for _, n in own), 0)], strict=True)) and sum(n for _, n in own) <= 2048
    assert pack(none, **TOKENIZER).count() == 0
    few = OpenBins(10, 1)
    assert [few.place(n) for n in (6, 6, 4, 10)] == [(0, 0), (1, 0), (1, 6), (2, 0)]


def test_nearest(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)] + [(60, None), (61, [0.0, 0.0, 0.0]), (62, [1.0, None, 2.0]), (63, [float("nan"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (64, [1.0])]
    got = defaultdict(list)
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=20).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    for q in (0, 20, 40):
        assert got[q] == sorted((i for i in range(60) if i != q), key=lambda i: (-round(cos(rows[q][1], rows[i][1]), 9), i))[:5]
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_nearest_recall(spark):
    """Thousands of rows in several lists, queries by 20 against all: recall against brute force; huge and tiny vectors;
    ids in several rows."""
    import numpy as np

    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 24)) + 2 * rng.normal(size=(30, 24))[rng.integers(0, 30, 4000)]
    x[7], x[8], x[40], x[60] = x[20] * 1e200, x[20] * 1e-200, x[20] * 1e250, x[60] * 1e-250
    ids = [*range(3990), *range(10)]  # ten ids stand twice
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in nearest(rows, every=20, per_list=200, probes=2, cell=256, block=16).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, round(r.score, 9)))
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits, total = 0, 0
    for q in range(20, 3990, 20):
        best: dict[int, float] = {}
        for i, s in zip(ids, x @ x[q], strict=True):
            if i != q:
                best[i] = max(best.get(i, -2), round(float(s), 9))
        want = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:5]
        hits, total = hits + len({s for _, s in want} & {s for _, s in got[q]}), total + len({s for _, s in want})
        assert len({i for i, _ in got[q]}) == 5
    assert hits / total >= 0.999 and {7, 8, 40} <= {i for i, _ in got[20]}


def test_nearest_hot_group(spark):
    """A third of all rows are near copies: their nearest are found whole."""
    import numpy as np

    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 32))
    x[::3] = x[0] + 0.02 * rng.normal(size=(1000, 32))
    x[3::300] = 2 * x[0]  # the same direction as the first query
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in nearest(rows, every=150).collect():
        got[r.query_id].append(round(r.score, 9))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 3000, 150):
        assert sorted(got[q], reverse=True) == np.round(np.sort(np.delete(x @ x[q], q))[::-1][:5], 9).tolist()


def test_lm(docs, none):
    import math

    tokens = lambda t: [*words(low(t)), None]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    c = Counter(x for d, t, _ in ROWS if not held(d) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    expected = sorted((str(d), held(d), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens(t)), 4)) for d, t, _ in ROWS)
    for frequent in (1 << 20, 10):
        got = score_texts(docs, frequent=frequent).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == expected
    assert all(r.score <= 0 for r in got) and score_texts(none).count() == 0


def test_lm_bigrams(docs):
    """Scores against brute force with every bigram, those seen once too."""
    import math

    tokens = lambda t: [*words(low(t)), None]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    train = [tokens(t) for d, t, _ in ROWS if not held(d)]
    one, two = Counter(x for t in train for x in t), Counter(p for t in train for p in zip(["", *t], t))
    n, v = sum(one.values()), len(one)
    one[""] = len(train)
    near = lambda c: 2 ** (c.bit_length() - 1) if c else 0

    def score(t):
        alone = lambda b: (near(one[b]) + 0.1) / (n + 0.1 * (v + 1))
        p = [0.5 * alone(b) + 0.5 * max(near(two[a, b]) - 0.75, 0) / (2 ** one[a].bit_length() - 1) if one[a] else alone(b) for a, b in zip(["", *t], t)]
        return sum(map(math.log10, p))

    got = sorted((str(r.doc_id), round(r.score, 4)) for r in score_texts(docs).collect())
    assert got == sorted((str(d), round(score(tokens(t)), 4)) for d, t, _ in ROWS) and 1 in two.values()


def test_masses():
    """What a context gives to all words is 1 at most, by counts as the filter holds them, and each is more than 0."""
    import numpy as np

    from limpid.llm.ngramlm import LogFrequencyFilter, level, probability

    rng = np.random.default_rng(8)
    text = rng.zipf(1.3, 40_000) % 500
    text[::997] = 600  # some words are followed by all kinds
    word, count = np.unique(text, return_counts=True)
    pairs, times = np.unique(text[:-1] * 1000 + text[1:], return_counts=True)
    mixed = lambda x: np.random.default_rng(1).integers(1, 2**63, 10**6, dtype=np.int64).astype(np.uint64)[x]
    held = LogFrequencyFilter(np.r_[mixed(word), mixed(pairs + 1000)], np.r_[level(count), level(times)], 12)
    one = held.levels(mixed(word))
    before = text[:-1]  # the last word is no context, its count is one too many at most
    for a in np.unique(before):
        seen = pairs[pairs // 1000 == a]
        pair = np.zeros(len(word), np.int64)
        pair[np.searchsorted(word, seen % 1000)] = held.levels(mixed(seen + 1000))
        p = probability(one, pair, np.full(len(word), one[np.searchsorted(word, a)]), len(text), len(word), 0.5)
        assert (p > 0).all() and 0.2 < p.sum() <= 1
    assert probability(one, np.zeros(len(word), int), np.zeros(len(word), int), len(text), len(word), 0.5).sum() <= 1
    for c in ([2] * 7 + [1], [4] * 7 + [2], [3] * 5, [1] * 9):  # counts whose middles add up to more
        p = probability(np.zeros(len(c), int), level(np.array(c)), np.full(len(c), level(np.array([sum(c)]))[0]), 10**9, 10**6, 1.0)
        assert p.sum() <= 1


def test_filter_grows():
    """As many bits an entry however many entries: few n-grams that it doesn't hold are found."""
    import numpy as np

    from limpid.llm.ngramlm import LogFrequencyFilter

    keys = np.random.default_rng(5).integers(0, 2**63, 400_000, dtype=np.int64).astype(np.uint64)
    for n in (2_000, 200_000):
        levels = np.arange(n) % 4 + 1
        own = LogFrequencyFilter(keys[:n], levels, 12)
        got = own.levels(keys[:n])
        assert own.bits >= 12 * levels.sum() and (got >= levels).all() and (got > levels).mean() < 0.01 and (own.levels(keys[-n:]) > 0).mean() < 0.01


def test_language(spark, none):
    text = {"en": "the quick brown fox jumps over the lazy dog and the cat", "fr": "le renard brun saute par dessus le chien et le chat dort"}
    rows = [(i, text[k] + f" {i}", k) for i, k in enumerate(["en", "fr"] * 15)] + [(90, None, "en"), (91, "12 !", "en"), (92, text["en"], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify(df, learn(df)).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[:30]) and got[90].lang_pred == got[91].lang_pred == "und" and got[92].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert learn(none) == () and identify(df, ()).first().lang_pred == "und" and identify(none, ()).count() == 0


def naive_parse(text: bytes, sample: bytes) -> int:
    """Phrases of a text, segment by segment: the longest match in the sample from where the last phrase ended."""
    import numpy as np

    from limpid.llm.langid import SEGMENT, symbols

    code = lambda x: "".join(map(chr, symbols(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0].tolist()))
    text, sample, n = code(text), code(sample), 0
    for lo in range(0, len(text), SEGMENT):
        part, at = text[lo : lo + SEGMENT], 0
        while at < len(part):
            end = at + 1
            while end <= len(part) and part[at:end] in sample:
                end += 1
            at, n = max(at + 1, end - 1), n + 1
    return n


def test_language_brute_force(spark):
    """Predictions and scores of texts that weren't learned from, against a naive parser."""
    import math
    import random

    rng = random.Random(4)
    words_of = {"en": "the quick brown fox jumps over lazy dogs while seven wizards make toxic brew for evil queens".split(), "fr": "le renard brun saute par dessus un chien qui dort pendant que sept sorciers préparent du poison".split(), "de": "der schnelle braune fuchs springt über den faulen hund während sieben zauberer gift für böse königinnen brauen".split()}
    rows = [(i, " ".join(rng.choices(words_of[k], k=rng.choice([3, 20, 200]))), k) for i, k in enumerate(["en", "fr", "de"] * 20)]
    samples = learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert held and not any(t.encode() in s for _, s in samples for _, t, _ in held if len(t) > 200)
    got = {r.doc_id: r for r in identify(spark.createDataFrame(held, "doc_id long, text string, lang string"), samples).collect()}
    from limpid.llm.langid import Automata

    bits = Automata(samples).bits
    for d, t, k in held:
        cost = sorted((naive_parse(t.encode(), s) * b, name) for (name, s), b in zip(samples, bits, strict=True))
        assert got[d].lang_pred == cost[0][1] == k and math.isclose(got[d].score, 1 - cost[0][0] / cost[1][0], abs_tol=1e-9)
    odd = identify(spark.createDataFrame([(1, "½ ²³ Ⅷ 12"), (2, "***the$$$fox%%%jumps***over***"), (3, None), (4, "")], "doc_id long, text string"), samples).orderBy("doc_id").collect()
    assert [r.lang_pred for r in odd] == ["und", "en", "und", "und"]


def test_licenses_brute_force(spark):
    """Occurrences against exact containment of every template in every window, without bands."""
    import random

    import numpy as np

    rng, every = random.Random(9), known_templates()
    some = {k: every[k] for k in ("mit-full", "gpl-2.0-header", "gpl-3.0-header", "isc", "mit", "apache-2.0-header", "apache-2.0", "zlib")}
    texts = []
    for i in range(60):
        t = rng.choice([*some.values()]).split()
        for _ in range(rng.choice([0, 1, 3, 10])):
            t[rng.randrange(len(t))] = "changed"
        filler = lambda: " ".join(rng.choices("lorem ipsum dolor sit amet under the license".split(), k=rng.randrange(80)))
        texts.append((i, f"{filler()} {' '.join(t)} {filler()} {rng.choice([*some.values()])}", "s"))
    low_words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", low(t))
    shingles = lambda w: [tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)]
    sets = {k: set(shingles(low_words(v))) for k, v in some.items()}
    got = {r.doc_id: [tuple(x) for x in r.licenses] for r in scan_licenses(spark.createDataFrame(texts, SCHEMA), templates=some).collect()}
    missed = 0
    for d, t, _ in texts:
        own, found = shingles(low_words(t)), []
        for name, mine in sets.items():
            size = 1 << (len(mine) - 1).bit_length()
            for lo in range(0, len(own), size):
                hit = [i for i in range(lo, min(lo + 2 * size, len(own))) if own[i] in mine]
                there = len({own[i] for i in hit})
                if there >= 0.8 * len(mine):
                    found.append((there, there / len(mine), name, hit[0], hit[-1] + SHINGLE))
        expected = apart(found)
        missed += len(set(expected) - set(got[d]))
        assert len(got[d]) <= len(expected)
    assert missed == 0
    assert len(Templates(some, 0.1).salts) > 256 and np.all([len(x) for x in got.values()])


def test_licenses(spark, docs, none):
    every = known_templates()
    body = [(i, f"{A} {t} {A}", "s") for i, t in enumerate(every.values())]
    got = {r.doc_id: {x.license for x in r.licenses} for r in scan_licenses(spark.createDataFrame(body, SCHEMA)).collect()}
    assert all(name in got[i] for i, name in enumerate(every)) and len(every) > len(NOTICES) > 20
    assert {r.doc_id for r in scan_licenses(docs).collect() if r.licenses} == {14} and scan_licenses(none).count() == 0


def test_decontamination_blocks(spark):
    """Blocks keep to their bytes, whatever an item's length or copies."""
    import pickle

    from pyspark.sql import functions as F

    from limpid.llm.decontaminate import Items, blocks_of, windows

    items = spark.createDataFrame([(str(i), "copied " * 3 + A[:60]) for i in range(300)] + [("long", " ".join(f"x{i}" for i in range(5000)))], "id string, text string")
    rows, n = blocks_of(windows(items, 10), 1 << 16)
    assert n > 1
    for k in range(0, n, 7):
        own = Items([(r.id, bytes(r.words)) for r in rows.filter(F.col("block") == k).collect()])
        assert len(pickle.dumps((own, own.prefixes({})))) < 1 << 16


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, A[:100]), (2, "é" * 5), (3, None), (4, "..."), (None, "ünïcode")], "item_id long, text string")
    got = {(r.doc_id, r.n_hit): r.hit_items for r in contamination(docs, items).collect()}
    assert got[(10, 1)] == ["2"] and all(k in {x[0] for x in got} for k in (1, 2, 3)) and got[(5, 0)] == []
    assert Counter(map(repr, sorted(got.items(), key=repr))) == Counter(map(repr, sorted({(r.doc_id, r.n_hit): r.hit_items for r in contamination(docs, items, block_bytes=64).collect()}.items(), key=repr)))
    assert contamination(none, items).count() == 0 and contamination(docs, items.limit(0)).filter("n_hit > 0").count() == 0


def test_clashing_columns(spark, docs):
    from pyspark.sql import functions as F

    inner = {c: F.lit(1) for c in ("phrase_doc", "phrase_row", "phrase_spans", "line_doc", "line_row", "line_gone", "doc", "dk", "__doc", "text_", "h", "sig")}
    more = docs.withColumns(inner).withColumns({"n_words": F.lit(-1), "kept": F.lit("x"), "n_lines": F.lit(0), "lang_pred": F.lit(""), "licenses": F.lit(1), "extra": F.lit(7)})
    items = spark.createDataFrame([(1, A[:100])], "item_id long, text string")
    for out in (remove_repeats(more), dedup_lines(more), identify(more, ()), scan_licenses(more), contamination(more, items)):
        assert out.count() == len(ROWS) and out.agg(F.min("extra"), F.min("line_doc"), F.min("phrase_doc"), F.min("__doc")).first()[:] == (7, 1, 1, 1) and len(set(out.columns)) == len(out.columns)
    assert scan_secrets(more).count() == jaccard_components(more).count() == score_texts(more).count() == len(ROWS)
    assert pack(more, **TOKENIZER).select("doc_id").distinct().count() == len({d for d, _, _ in ROWS})
    vectors = spark.createDataFrame([(i, [1.0, float(i)], 1, 2) for i in range(9)], "vec_id long, embedding array<double>, list int, code int")
    assert nearest(vectors, every=4, top=2).count() == 6


def without_repeats(texts, window=35):
    """Words left of each text, and how many there were."""
    every = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in every for i in range(len(w) - window + 1))
    out = []
    for w in every:
        gone = {i + j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(window)}
        out.append((len(w), [x for i, x in enumerate(w) if i not in gone]))
    return out


def smallest_linked(rows, width, percent):
    """For each (id, text) row the set's size and the smallest id reachable, -1 standing for a null id."""
    sets = []
    for _, t in rows:
        w = words(low(t))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    up = [-1 if d is None else d for d, _ in rows]
    ids = list(up)
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if ids[i] == ids[j] or (a and b and 100 * len(a & b) >= percent * len(a | b)):
                    up[i] = up[j] = min(up[i], up[j])
    return [(len(s), m) for s, m in zip(sets, up, strict=True)]


def test_word_codes():
    codes = Codes()
    every = {codes[b"%d" % i] for i in range(1_100_000)}
    assert len(every) == 1_100_000 and all(len(x) == 3 for x in every)


@pytest.mark.parametrize("wide", [2000, 1])
def test_phrases(docs, none, wide):
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in remove_repeats(docs, wide=wide).collect()), key=repr)
    expected = [(d, n, n - len(w), " ".join(w)) for (d, _, _), (n, w) in zip(ROWS, without_repeats([t for _, t, _ in ROWS]), strict=True)]
    assert got == sorted(expected, key=repr) and sum(e[2] for e in expected) > 30000
    assert remove_repeats(none).count() == 0


def test_phrases_need_automata(docs, monkeypatch):
    """What the automata match decides alone: with none of their phrases nothing is removed."""
    real = phrases.confirmed
    monkeypatch.setattr(phrases, "confirmed", lambda *args: real(*args).limit(0))
    assert {r.n_removed for r in remove_repeats(docs).collect()} == {0}
    assert phrases.locate([], [b"a b"]) == [[]] and phrases.locate([b"b c", b"c d"], [b"a b c d e", b"x"]) == [[1, 4], []]
    assert phrases.recurring([b"a b c d", b"x b c d"], [1, 1], 2) == [b"b c d"] and phrases.recurring([b"a b"], [1], 2) == []


def test_phrases_salted(docs):
    """Shards whose segments several tasks share."""
    got = sorted(((r.doc_id, r.n_removed) for r in remove_repeats(docs, most=400).collect()), key=repr)
    assert got == sorted(((r.doc_id, r.n_removed) for r in remove_repeats(docs).collect()), key=repr)


def test_lines_need_the_anti_join(docs, monkeypatch):
    """What the merge-anti-join finds decides alone which keys are new: without it, those of later batches are lost."""
    of = lambda: sum(r.n_dropped for r in dedup_lines(docs, batches=16).collect())
    whole = of()
    monkeypatch.setattr(linededup.LineRuns, "unseen", staticmethod(lambda own, run: own.limit(0)))
    assert whole == 3 and of() < whole


@pytest.mark.parametrize("block", [4096, 2])
def test_jaccard(docs, none, block):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in jaccard_components(docs, block=block).collect())
    expected = sorted((-1 if d is None else d, *x) for (d, _, _), x in zip(ROWS, smallest_linked([r[:2] for r in ROWS], 4, 85), strict=True))
    assert got == expected and any(d != c for d, _, c in expected)
    assert jaccard_components(none).count() == 0


@pytest.mark.parametrize("hubs", [1, 8])
def test_jaccard_large_blocks(spark, monkeypatch, hubs):
    """Blocks far over their size: chains that no hub reaches, near copies, and texts that share one passage only."""
    import random

    from limpid.llm import jaccard

    monkeypatch.setattr(jaccard, "HUBS", hubs)
    rng, rows = random.Random(2), []
    rows += [(i, " ".join(f"c{j}" for j in range(2 * i, 2 * i + 60))) for i in range(25)]
    base = [f"b{j}" for j in range(200)]
    for i in range(30):
        t = list(base)
        t[rng.randrange(200)] = f"x{i}"
        rows.append((100 + i, " ".join(t)))
    rows += [(200 + i, "one passage that all of these share " + " ".join(f"y{i}_{j}" for j in range(rng.choice([5, 30, 31])))) for i in range(30)]
    rng.shuffle(rows)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), block=4).collect())
    assert got == sorted((d, *x) for (d, _), x in zip(rows, smallest_linked(rows, 4, 85), strict=True)) and len({c for _, _, c in got}) == 32


def test_near_duplicates_of_repeated_ids(spark):
    """Of rows with one id one stays, of rows without an id one of each text; columns may have any name."""
    import corpus_pipeline

    rows = [(1, "a b c d e f", 1), (1, "a b c d e f", 2), (1, None, 3), (2, "z y x w v u", 4), (None, "n o p q r s", 5), (None, "n o p q r s", 6), (None, "k l m", 7), (None, None, 8), (None, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `near.doc` int").withColumn("near_n", F.col("`near.doc`"))
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()), key=repr)
    assert got == sorted([(1, "a b c d e f"), (2, "z y x w v u"), (None, "n o p q r s"), (None, "k l m"), (None, None), (None, "")], key=repr)


def test_pipeline_stages(spark, tmp_path):
    """Each stage on what the one before kept, against brute force."""
    import corpus_pipeline

    rows = [(d, t, "en" if d and d % 2 else None, s, None if t is None else len(t), 7) for d, t, s in ROWS] + [(20, "hit " + " ".join(f"b{i}" for i in range(12)), "en", "s9", 1, 7)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"B{i}" for i in range(12))), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs.collect())
    texts = lambda k: sorted(((r.doc_id, r.text) for r in kept[k]), key=repr)
    assert texts(0) == sorted(((d, t) for d, t, *_ in rows if any(x.isalpha() for x in t or "")), key=repr)
    assert sum(r.text != a for r in kept[1] for a in [dict(texts(0))[r.doc_id]]) == 2 and len(kept[1]) == len(kept[0])
    own = texts(1)
    linked = smallest_linked(own, 5, 80)
    chosen = {(d, t) for (d, t), (_, m) in zip(own, linked, strict=True) if m == (-1 if d is None else d)}
    assert texts(2) == sorted(chosen, key=repr) and len(kept[2]) < len(kept[1])
    assert texts(3) == sorted(((d, t) for d, t in texts(2) if d != 20), key=repr) and len(kept[3]) == len(kept[2]) - 1
    assert {r.doc_id for r in kept[4]} == {d for d, _ in texts(3)} and kept[4]
