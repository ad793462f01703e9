"""The training-data operators against brute force, round trips and edge rows."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from tracelake.llm import bpe, decontaminate, language, licenses, preference, quality, simhash, toxicity, warc, winnow

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string"
LONG = "word " * 30_000


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and very long texts, ties, repeated rows, columns with clashing names."""
    rows = [(1, None, None, None, None, 1.0, "x"), (2, "", "en", "s", 0, None, None), (3, "one", "en", "s", 3, 2.0, "y"), (3, "one", "en", "s", 3, 2.0, "y"), (None, "no id here", None, "s", 1, 0.0, None), (5, LONG, "en", "s", len(LONG), 0.0, None), (6, "Zwölf Boxkämpfer 漢字 🙂\r\n\t x", "de", "s", 1, 0.0, None)]
    return spark.createDataFrame(rows, DOCS)


def text_of(edge):
    return sorted((r["doc_id"] or -1, r["text"] or "") for r in edge.collect())


def codec():
    import public_tokenizers as p

    return bpe.codec(open(p.path(bpe.VOCABULARY), "rb").read(), p.PATTERN)


def test_bpe_tree_equals_library():
    c, r = codec(), random.Random(1)
    for alphabet in ("ab 's\n", "é漢 1,\t　'll", "aaaa"):
        for n in (0, 1, 7, 50, 400):
            text = "".join(r.choice(alphabet) for _ in range(n))
            for leaf in (1, 3, 16):
                ids = bpe.encode(text, c.encode_ordinary, leaf)
                assert ids == c.encode_ordinary(text)
                assert bpe.decode(ids, c.decode_bytes, leaf) == text.encode()


def test_bpe_edges(edge):
    import public_tokenizers as p

    got = bpe.encode_documents(edge, p.path(bpe.VOCABULARY), p.PATTERN).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got) == sorted((i, len(codec().encode_ordinary(t))) for i, t in text_of(edge))
    assert all(r["decoded_sha256"] in {hashlib.sha256(t.encode()).hexdigest() for _, t in text_of(edge)} for r in got)


def components(fps: dict[int, int], radius: int) -> dict[int, int]:
    ids, parent = list(fps), {}
    for i in ids:
        parent[i] = i

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= radius:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_masks_cover_every_pair_within_the_radius():
    r = random.Random(2)
    for level in (0, 1, 3):
        tables = simhash.masks(3, level)
        for _ in range(500):
            d = sum(1 << b for b in r.sample(range(64), r.randrange(4)))
            assert any(d & m == 0 for m in tables)


@pytest.mark.parametrize("hot", [512, 4])
def test_simhash_components(spark, hot):
    r, base = random.Random(3), [random.Random(4).getrandbits(64), 0]
    fps = {i: base[i % 2] ^ sum(1 << b for b in r.sample(range(64), r.randrange(5))) for i in range(60)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in set(fps.values())]
    from pyspark.sql import functions as F

    members = spark.createDataFrame(signed, "fp long").select(F.lit(0).cast("long").alias("grp"), "fp")
    got = {x["node"]: x["root"] for x in simhash.components(simhash.links(members, 3, hot)).collect()}
    want = components(dict(enumerate(sorted({f[0] % (1 << 64) for f in signed}))), 3)
    values = sorted({f[0] % (1 << 64) for f in signed})
    mine = collections.defaultdict(set)
    for f in values:
        s = f - (1 << 64) if f >> 63 else f
        mine[got.get(s, s)].add(f)
    theirs = collections.defaultdict(set)
    for i, f in enumerate(values):
        theirs[want[i]].add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_components_do_not_multiply_the_estimated_size(spark):
    """Components of components: the planner's estimate stays that of the tables, as its digits take the driver's memory."""
    way = list(range(300))
    random.Random(3).shuffle(way)
    e = spark.createDataFrame(list(zip(way, way[1:])), "a long, b long")
    for _ in range(2):
        got = simhash.components(e)
        e = got.selectExpr("node AS a", "root AS b")
    assert sorted(map(tuple, got.collect())) == [(i, 0) for i in range(1, 300)]
    assert int(got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 1_000_000


def test_simhash_edges(edge, spark):
    got = simhash.near_duplicates(edge).collect()
    assert len(got) == 7
    assert {r["fingerprint"] for r in got if r["doc_id"] in (1, 2)} == {"0" * 16}
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert simhash.near_duplicates(edge.limit(0)).count() == 0


def test_deduplicated(spark, edge):
    r = random.Random(5)
    words = [f"w{r.randrange(10**6)}" for _ in range(300)]
    near, far = words[:], [f"v{r.randrange(10**6)}" for _ in range(300)]
    near[150] = "other"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(words).upper()), (5, None), (6, "")]
    got = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3, 5]
    assert simhash.deduplicated(edge).columns == edge.columns


def shingled(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.mark.parametrize("hot", [256, 3])
def test_deduplicated_finds_every_similar_pair(spark, hot):
    """Appended blocks, truncations and scattered changes, each with its original alone, against brute force."""
    r, texts, common = random.Random(11), [], [f"c{i}" for i in range(12)]
    for i in range(72):
        w = common + [f"w{r.randrange(10**6)}" for _ in range(240)]
        n = r.randrange(10, 62)
        if i % 3 == 0:
            copy = w + [f"v{r.randrange(10**6)}" for _ in range(n)]
        elif i % 3 == 1:
            copy = w[: len(w) - n]
        else:
            copy = w[:]
            for at in r.sample(range(len(w)), n // 10):
                copy[at] = f"v{r.randrange(10**6)}"
        texts += [" ".join(w), " ".join(copy)]
    sets = [shingled(t) for t in texts]
    want = [k for k in range(len(texts)) if not (k % 2 and len(sets[k] & sets[k - 1]) / len(sets[k] | sets[k - 1]) >= 0.8)]
    assert 72 < len(want) < 120
    got = simhash.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), hot=hot)
    assert sorted(x["doc_id"] for x in got.collect()) == want


@pytest.mark.parametrize("hot", [256, 4])
def test_deduplicated_keeps_one_row_of_a_group(spark, hot):
    """Copies that are similar to their original alone, one of them with the least id, and a chain of edits."""
    r = random.Random(12)
    base = [f"w{r.randrange(10**6)}" for _ in range(300)]
    texts = []
    for i in range(12):
        w = base[:]
        for at in range(5 + 20 * (i % 12), 230 + 5 * i, 60)[:5]:
            w[at] = f"v{r.randrange(10**6)}"
        texts.append(w)
    texts.insert(7, base)
    chain = [f"u{r.randrange(10**6)}" for _ in range(300)]
    for i in range(5):
        texts.append(chain[:])
        for at in range(20 * i, 20 * i + 20):
            chain[at] = f"x{r.randrange(10**6)}"
    sets, n = [shingled(" ".join(w)) for w in texts], len(texts)
    near = {(i, j) for i in range(n) for j in range(n) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    assert all((7, i) in near for i in range(13)) and (0, 1) not in near and (13, 15) not in near and all((i, i + 1) in near for i in range(13, 17))
    got = simhash.deduplicated(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string"), hot=hot)
    assert sorted(x["doc_id"] for x in got.collect()) == [0, 13]


def test_deduplicated_links_by_fingerprints_first(spark, monkeypatch):
    """Near copies within op5's radius go without the exact step, which then leaves them out; others need it. Shared bits alone
    are no link."""
    r, texts = random.Random(21), []
    for i in range(24):
        w = [f"w{r.randrange(10**6)}" for _ in range(300)]
        copy = w[:]
        for at in r.sample(range(300), 1 + i % 5):
            copy[at] = f"v{r.randrange(10**6)}"
        texts += [w, copy]
    texts += [["a", "b", "c", "d"], ["a", "b", "c", "e"]]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    far = [bin(simhash.fingerprint(" ".join(texts[k])) ^ simhash.fingerprint(" ".join(texts[k + 1]))).count("1") > simhash.RADIUS for k in range(0, 48, 2)]
    sets = [shingled(" ".join(w)) for w in texts]
    assert 4 < sum(far) < 20 and all(len(sets[k] & sets[k + 1]) / len(sets[k] | sets[k + 1]) >= 0.8 for k in range(0, 48, 2))
    met, groups = [], simhash.candidate_groups
    monkeypatch.setattr(simhash, "candidate_groups", lambda *a: met.append(groups(*a)) or met[-1])
    assert sorted(x["doc_id"] for x in simhash.deduplicated(d).collect()) == [*range(0, 48, 2), 48, 49]
    assert met[0].count() == 2 * sum(far)
    posted = simhash._posted
    monkeypatch.setattr(simhash, "_posted", lambda *a: lambda batches: (b.slice(0, 0) for b in posted(*a)(batches)))
    want = [k + j for k, f in zip(range(0, 48, 2), far) for j in range(1 + f)]
    assert sorted(x["doc_id"] for x in simhash.deduplicated(d).collect()) == [*want, 48, 49]
    monkeypatch.setattr(simhash, "near_duplicates", lambda docs: docs.selectExpr("doc_id", "0L as component_id"))
    assert sorted(x["doc_id"] for x in simhash.deduplicated(d).collect()) == [*range(0, 48, 2), 48, 49]


def test_decontamination_edges(spark, edge):
    bench = spark.createDataFrame([(1, " ".join(["word"] * 14)), (2, "ONE"), (3, None), (4, "!!")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.digest(decontaminate.search(edge, bench)).collect()}
    assert (got[5]["n_words"], got[5]["n_hit"], got[5]["n_items"], got[5]["contaminated"]) == (30_000, 30_000, 1, True)
    assert got[3]["items_sha256"] == hashlib.sha256(b"2").hexdigest() and got[1]["n_words"] == 0 and not got[1]["contaminated"]
    blocks = decontaminate.digest(decontaminate.search(edge, bench, block_words=1)).collect()
    assert sorted(map(str, blocks)) == sorted(map(str, decontaminate.digest(decontaminate.search(edge, bench)).collect()))
    kept = decontaminate.clean(edge, bench)
    assert kept.columns == edge.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 6]
    assert decontaminate.clean(edge, bench.limit(0)).count() == 7


def test_proximity():
    q = decontaminate.Queries([("1", "alpha beta gamma")], 13)
    near = lambda text, slop: decontaminate._hits(decontaminate.Shard([text]), q, slop)[2][0]
    assert near("alpha x beta gamma", 1) == [0] and near("alpha x y beta gamma", 1) == [] and near("beta alpha gamma", 3) == []


def test_index_equals_brute_force(spark):
    """Phrases and proximity of random texts and items: null and repeated ids, items in several rows and blocks, shards."""
    r = random.Random(21)
    text = lambda n, most=6: " ".join(r.choice("abcdefgh"[:most]) for _ in range(r.randrange(n)))
    docs = [(i if i % 7 else None, r.choice([None, "", text(9), text(60), text(60).upper() + " é7"])) for i in range(60)]
    items = [(r.choice([None, *range(12)]), r.choice([None, "", text(5), text(9)])) for _ in range(30)]
    window, slop = 4, 2
    want = []
    for doc_id, t in docs:
        w = decontaminate.words(t)
        hit, exact, close = set(), set(), set()
        for item_id, x in items:
            v = decontaminate.words(x)
            for i in range(max(1, len(v) - window + 1) if v else 0):
                q = v[i : i + window]
                found = [a for a in range(len(w) - len(q) + 1) if w[a : a + len(q)] == q]
                hit |= {a + j for a in found for j in range(len(q))}
                if found:
                    exact.add(item_id)
                for a in range(len(w)):  # in order from a, in as few words as can be
                    at, ok = a - 1, w[a] == q[0]
                    for term in q:
                        at = next((j for j in range(at + 1, len(w)) if w[j] == term), None) if ok else None
                        ok = at is not None
                        if not ok:
                            break
                    if ok and at - a < len(q) + slop:
                        close.add(item_id)
        want.append((str(doc_id), len(w), sorted(hit), *[sorted(str(x) for x in s if x is not None) for s in (exact, close)]))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_words in (1000, 7):
        got = decontaminate.search(d, bench, window=window, slop=slop, block_words=block_words).collect()
        mine = [(str(x["doc_id"]), x["n_words"], sorted({p for a, b in x["spans"] for p in range(a, b)}), x["items"], x["near_items"]) for x in got]
        assert sorted(mine) == sorted(want)
    assert decontaminate.search(d.limit(0), bench).count() == 0 and decontaminate.search(d, bench.limit(0)).where("size(items) > 0").count() == 0


def plain_tokens(text):
    """Tokens one character at a time: East Asian ones alone; of a run the last 12 or fewer as they are, else up to the first of 24
    that may end a token, else one character."""
    east = lambda c: 0x2E80 <= ord(c) <= 0xD7FF or 0x20000 <= ord(c) <= 0x3FFFF
    blank = lambda c: c in " \t\n\x0b\f\r"
    inner = lambda c: c in "bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ56789+%~"
    out, i = [], 0
    while i < len(text):
        if blank(text[i]):
            i += 1
            continue
        end = i
        while end < len(text) and not blank(text[end]) and not east(text[end]):
            end += 1
        if end == i:
            end = i + 1
        elif end - i > 12:
            stops = [j for j in range(i, min(end, i + 24)) if not inner(text[j])]
            end = stops[0] + 1 if stops else i + 1
        out.append(text[i:end])
        i = end
    return out


def brute_winnow(text, k, w, spark):
    tokens = plain_tokens(text)
    from pyspark.sql import functions as F

    rows = [t for t in tokens] or [text]
    h = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(F.hash("t").bitwiseAND(winnow.PRIME) % winnow.PRIME).collect()]
    grams = []
    for i in range(len(h) - k + 1):
        v = 0
        for x in h[i : i + k]:
            v = (v * winnow.BASE + x) % winnow.PRIME
        grams.append(v)
    out = []
    for i in range(max(1, len(grams) - w + 1)):
        part = grams[i : i + w]
        low = min(part)
        at = i + max(j for j, x in enumerate(part) if x == low)
        if (low, at) not in out:
            out.append((low, at))
    return out


def test_shifted_text_keeps_its_fingerprint(spark):
    """One character more in front, with and without blanks: Thai letters, an address, digits, consonants, Greek, East Asian."""
    r = random.Random(7)
    letters = {"thai": "".join(map(chr, range(0x0E01, 0x0E2F))), "url": "abcdefghijklmnopqrstuvwxyz0123456789/?&=%-._", "digits": "0123456789", "consonants": "bcdfghjkl", "greek": "αβγδεζηθικλμ", "east": "漢字仮名交文章例", "prose": "etaoin shrdlu "}
    texts = {k: "".join(r.choice(v) for _ in range(3000)) for k, v in letters.items()}
    rows = [(k, t, c + t) for k, t in texts.items() for c in (v for v in ("x", letters[k][0], letters[k][0] * 7))]
    df = spark.createDataFrame(rows, "k string, a string, b string")
    for c in "ab":
        df = winnow.minima(df, c, f"{c}_mins")
    got = df.select("k", winnow.likeness(winnow.hashes(df["a_mins"]), winnow.hashes(df["b_mins"])).alias("same")).collect()
    assert min((x["same"], x["k"]) for x in got)[0] >= 0.9, sorted((x["same"], x["k"]) for x in got)


def test_winnowing_equals_brute_force(spark, edge):
    text = "a b c a b c a b c d e 漢字 f averyveryverylongword a b c"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(s["hash"], s["position"]) for s in winnow.fingerprints(d).first()["selected"]]
    assert got == brute_winnow(text, winnow.K, winnow.W, spark)
    e = {r["doc_id"]: r for r in winnow.edited(edge).collect()}
    assert len(winnow.edited(edge).collect()) == 7 and e[1]["edited_text"] == "" and winnow.edited(edge.limit(0)).count() == 0
    assert e[6]["edited_text"] == "Zwölf Boxkämpfer 漢字 🙂\r\n\t x"[:-8] + LONG[:8]


def test_quality_rules_hold(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = quality.learn(docs, labels)
    x = quality.scored(docs, rules).join(labels, "doc_id").collect()
    right = sum((r["score"] >= 0.7) == (r["quality"] == 1) for r in x) / len(x)
    assert right > 0.85 and len(rules.rules) > 0
    none = quality.learn(docs, labels.limit(0))
    assert none.rules == [] and quality.scored(docs, none).first()["score"] == 0.5


def test_classifiers_take_edge_rows(spark, edge):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, None), (5, 1, 0), (5, 0, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.scored(edge, quality.learn(edge, labels)).count() == 7
    model = toxicity.learn(edge, labels)
    assert all(0 <= r["score"] <= 1 for r in toxicity.scored(edge, model).collect())
    got = language.identify(edge, language.learn(edge)).collect()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2)} == {"und"} and len(got) == 7
    assert language.identify(edge, language.Model({})).where("lang_pred <> 'und'").count() == 0


def test_network_gradient():
    import numpy as np

    net, r = toxicity.Network(hidden=3), np.random.default_rng(0)
    args = (r.integers(0, 99, (4, 5)), r.integers(0, 6, (4, 5)), toxicity.letters(["", "a", "word", "ab", "zé", "x" * 16]), r.standard_normal((4, 5, 2)).astype(np.float32), np.arange(5) < np.array([[5], [3], [1], [4]]), np.array([1, 0, 1, 0], np.float32), np.ones(4, np.float32))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    grad = net.step(*args)
    for name in ("uf", "wb", "a", "o", "bf", "uc", "wc", "bc"):
        i = tuple(0 for _ in net.p[name].shape)
        keep, loss = net.p[name][i], []
        for d in (1e-2, -1e-2):
            net.p[name][i] = keep + d
            net.step(*args)
            loss.append(net.loss)
        net.p[name][i] = keep
        assert abs((loss[0] - loss[1]) / 2e-2 - grad[name][i]) < 2e-3


def test_toxicity_on_unseen_rows(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.scored(docs, toxicity.learn(docs, labels)).join(labels, "doc_id").collect()
    unseen = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum((r["score"] >= 0.5) == (r["toxic"] == 1) for r in unseen) / len(unseen) > 0.85


def longest(text, at, corpus):
    n = 0
    while at + n < len(text) and text[at : at + n + 1] in corpus:
        n += 1
    return n


def test_cross_parsing_equals_brute_force():
    """Phrases of random symbols, and whole texts of several scripts: parsed in segments, compared by entropy."""
    r = random.Random(6)
    corpus = [r.randrange(2, 6) for _ in range(80)]
    trans = language.automaton(corpus, 8)
    joined = "".join(map(str, corpus))
    for n in (1, 5, 40):
        text = [r.randrange(2, 8) for _ in range(n)]
        at = count = 0
        while at < n:
            at += max(1, longest("".join(map(str, text)), at, joined))
            count += 1
        assert language.phrases(np.array([text], np.int32), np.array([n]), trans).tolist() == [count]
    alphabets = {"el": "αβγδε ", "ja": "日本語文字 ", "ru": "абвгд ", "xx": "abcde "}
    make = lambda k, n: "".join(r.choice(alphabets[k]) for _ in range(n))
    samples = {k: [make(k, 300) for _ in range(4)] for k in alphabets}
    model, lut = language.Model(samples, 900), language.letters()
    texts = [make(k, n) for k in alphabets for n in (3, 200, 900)] + [make("el", 400) + make("ru", 300).upper(), "12 !", None, "\U00020000 x"]
    trained = {k: " ".join(bytes(language.symbols(t, lut)).decode()[:225] for t in v)[:900].encode() for k, v in samples.items()}
    for text, name, score in zip(texts, *language.classify(texts, model, lut)):
        s = " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split()).encode()
        assert bytes(language.symbols(text, lut)).strip() == s
        s = bytes(language.symbols(text, lut))
        entropy = {}
        for k, t in trained.items():
            count = 0
            for a in range(0, len(s), language.SEGMENT):
                part, at = s[a : a + language.SEGMENT], 0
                while at < len(part):
                    at += max(1, longest(part, at, t))
                    count += 1
            entropy[k] = count * np.log2(max(2, len(t))) / max(1, len(s))
        best = min(entropy, key=lambda k: (entropy[k], k))
        rest = min(v for k, v in entropy.items() if k != best)
        assert (name, round(score, 9)) == ((best, round(1 - entropy[best] / rest, 9)) if s else ("und", 0))


def test_warc_round_trip(spark):
    big = "<p>\r\n\r\nWARC/1.1\r\n" + "é" * 100
    rows = [(1, "http://a/", None), (2, None, big), (3, "u", big), (3, "u", big), (4, "u", "x" * 99), (5, "u", "x" * 99), (None, "u", "y" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(pages).collect()
    kinds = sorted((c["page_id"] or -1, c["response"]["type"], c["response"]["html"]) for c in got)
    assert kinds == [(-1, "response", "y" * 200), (1, "response", ""), (2, "response", big), (3, "revisit", None), (3, "revisit", None), (4, "response", "x" * 99), (5, "response", "x" * 99)]
    assert all(c["response"]["refers_to"] == "<urn:capture:response:2:0>" for c in got if c["page_id"] == 3)
    assert warc.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [1 << 24, 64])
def test_warc_equals_brute_force(spark, bits):
    """Few bits: every page is taken for a repeated one, and comes out the same. Payloads full of line ends."""
    r = random.Random(8)
    payload = lambda: "".join(r.choice(["\r", "\n", "\r\n", "\r\n\r\n", "ab", "é", "WARC/1.1\r\n"]) for _ in range(r.randrange(60)))
    some = [payload() for _ in range(25)]
    rows = [(r.choice([None, *range(150)]), r.choice(["u", None, "v"]), r.choice(some)) for _ in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = warc.shared_path(spark, "test")
    warc.write(warc.captures(pages, bits=bits), path)
    got = warc.assemble(warc.read(spark, path)).collect()
    size = lambda t: len(t.encode())
    first = {t: min((p is None, p or 0) for p, _, x in rows if x == t) for t in some if any(x == t for _, _, x in rows)}
    kinds = collections.Counter()
    for t in first:
        same = [(p is None, p or 0) for p, _, x in rows if x == t]
        for i, p in enumerate(sorted(same)):
            kinds[(None if p[0] else p[1], hashlib.sha256(t.encode()).hexdigest(), "revisit" if i and size(t) >= 100 else "response")] += 1
    assert collections.Counter((c["page_id"], c["response"]["digest"], c["response"]["type"]) for c in got) == kinds
    assert all(c["response"]["own_digest"] == c["response"]["digest"] and c["response"]["html"] in some for c in got if c["response"]["type"] == "response")
    ids = {(c["response"]["record_id"]): c["response"] for c in got}
    assert len(ids) == len(got) and all(ids[c["response"]["refers_to"]]["digest"] == c["response"]["digest"] and ids[c["response"]["refers_to"]]["type"] == "response" for c in got if c["response"]["type"] == "revisit")


def test_preference_pairs(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, None, None), (3, 0, "assistant", "a"), (3, 0, "assistant", "a")]
    c = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r["pair_id"]: r for r in preference.paired(preference.echo_pairs(c)).collect()}
    assert set(got) == {1, 2, 3} and got[1]["prompt"] == "<|user|>\nhi<|end|>\n" and got[1]["chosen"] == "<|assistant|>\nyo<|end|>\n"
    assert (got[2]["n_common"], got[2]["prompt"], got[2]["chosen"], got[2]["rejected"]) == (1, "<|user|>\n<|end|>\n", "", "")
    s = got[1]["chosen_spans"][0]
    assert got[1]["chosen"][s["start"] : s["end"]] == "yo<|end|>\n" and got[3]["chosen"] == "" and got[3]["n_common"] == 2


def test_license_scan(spark, edge):
    rows = [(1, "intro\nReleased under the MIT License.\nend"), (2, "the license of the word"), (3, "Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3.")]
    model = licenses.train(["alpha beta gamma delta", "le mot juste est la", "der und die das"] * 40)
    found = {r["doc_id"]: [f["family"] for f in r["found"]] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert found == {1: ["MIT"], 2: [], 3: ["CC-BY-NC-4.0", "GPL-3.0"]}
    assert licenses.scan(edge, model).where("size(found) > 0").count() == 0


def test_license_notices_wrapped_or_inside_a_long_line(spark):
    import textwrap

    filler = " ".join(["alpha beta gamma delta"] * 60)
    notices = [(f, max(licenses.NOTICES[f], key=len)) for f in ("MIT", "BSD", "ISC", "Apache-2.0", "GPL-3.0", "AGPL-3.0")]
    rows, want = [], {}
    for k, (f, t) in enumerate(notices):
        rows += [(2 * k, "intro\n\n" + "\n".join(f" * {x}" for x in textwrap.wrap(t, 60)) + "\n *\nend"), (2 * k + 1, f"{filler} {t} {filler}")]
        want |= {2 * k: [f], 2 * k + 1: [f]}
    rows.append((99, "permission is hereby\n\ngranted free of charge"))
    model = licenses.train(["alpha beta gamma delta", "le mot juste est la", "der und die das"] * 40)
    found = {r["doc_id"]: [x["family"] for x in r["found"]] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert found == want | {99: []}


def test_standard_headers_name_their_licence():
    """Headers as they stand in source files, and short marks; nothing of another family."""
    import textwrap

    gnu = "This {what} is free software{a} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{b} either version {v} of the License, or (at your option) any later version.\n\nThis {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details."
    headers = {
        "GPL-2.0": gnu.format(what="program", a=";", b=";", kind="", v="2"), "GPL-3.0": gnu.format(what="program", a=":", b=",", kind="", v="3"), "LGPL-2.1": gnu.format(what="library", a=";", b=";", kind="Lesser ", v="2.1"),
        "LGPL-3.0": gnu.format(what="library", a=":", b=",", kind="Lesser ", v="3"), "AGPL-3.0": gnu.format(what="program", a=":", b=",", kind="Affero ", v="3"),
        "Apache-2.0": 'Copyright 2020 Someone\n\nLicensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "MIT": "Copyright (c) 2020 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    }
    model = licenses.train([f"alpha beta gamma delta {i} the of and software version" for i in range(300)])
    for family, text in headers.items():
        for mark in ("", "// ", " * "):
            for width in (60, 76, 10_000):
                lines = [x for part in text.split("\n\n") for x in [*(f"{mark}{y}" for y in textwrap.wrap(part, width)), mark.rstrip()]]
                assert {h[0] for _, h in model.found(lines)} == {family}, (family, mark, width)
    for family, ids in licenses.IDENTIFIERS.items():
        for x in ids:
            for line in (f"// SPDX-License-Identifier: {x}", f"# SPDX-License-Identifier: {x}", f"/* SPDX-License-Identifier: {x} */"):
                assert [h[0] for _, h in model.found(["int x;", line, "", "int y;"])] == [family], line


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    assert [n for n, _ in p.STAGES] == ["quality", "toxicity", "near_dedup", "decontamination", "bpe"]
    for _, stage in p.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    assert p.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_postings_are_read_few_at_a_time(spark, tmp_path, monkeypatch):
    """A group of the index's rows, which a reader holds whole, does not grow with the shards of a task."""
    import pyarrow.parquet as pq

    from tracelake.llm import decontaminate

    monkeypatch.setitem(decontaminate._NARROW, "parquet.block.size", str(1 << 16))
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(9000))) for i in range(12)], "doc_id long, text string").coalesce(1)
    decontaminate.build(docs, str(tmp_path / "index"), keep=("doc_id", "text"), most_chars=50_000)
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "index").glob("*.parquet")]
    assert sum(f.num_rows for f in files) == 12
    assert max(f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)) <= 2
