"""Periodic runs, token files and fill-in-the-middle forms against plain re-statements, and rows that could break them."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tracelake.llm import fim, periodic, queries, tokenfile

DOCS = "doc_id long, text string, lang string, n long, start long, output string, `a.b` string"
LONG = "word " * 30_000 + "tail"


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and very long texts, ties, repeated rows, columns with clashing names."""
    texts = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "no id here"), (5, LONG), (6, "Zwölf  Boxkämpfer 漢字 🙂\r\n\t x "), (7, " \t\n"), (8, "a <P> b"), (9, "<|endoftext|> x<S y>"), (3, "another"), (3, None), (12, "a b c " * 9)]
    return spark.createDataFrame([(i, t, "en", 1, 2, "o", None) for i, t in texts], DOCS)


def documents(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# --- runs ----------------------------------------------------------------------------------------------------------------


def plain_runs(words, least=12):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - s
            if i > s and length >= max(least, 2 * q) and not any(words[s + d : s + length] == words[s : s + length - d] for d in range(1, q)):
                out.append((s, length, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("few", [0, 4, 10**9])
def test_runs_equal_brute_force(few, monkeypatch):
    monkeypatch.setattr(periodic, "FEW", few)
    r = random.Random(few)
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 100:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for least in (2, 12):
        for _ in range(40):
            texts = []
            for _ in range(r.randrange(1, 6)):
                n, letters = r.choice([0, 1, 2, 5, 20, 90]), "abcde"[: r.choice([1, 2, 3, 5])]
                w = [r.choice(letters).encode() for _ in range(n)]
                if n and r.random() < 0.4:
                    a = r.randrange(n)
                    p = 1 + r.randrange(max(1, (n - a) // 2))
                    w = w[:a] + (w[a : a + p] * n)[: n - a]
                texts.append(w)
            texts.append([c.encode() for c in r.choice(fibonacci)])
            found, kept = periodic.with_runs(texts, least)
            assert found == [plain_runs(w, least) for w in texts]
            for w, own, left in zip(texts, found, kept):
                gone = {i for s, length, q in own for i in range(s + q, s + length)}
                assert left == [x for i, x in enumerate(w) if i not in gone]


def test_smaller_halves_move_a_position_a_logarithmic_number_of_times():
    ids = np.array([1] * 4096 + [2])
    c, moved = periodic.Classes(ids), 0
    while len(c.small):
        moved += len(c.small)
        c.refine()
    assert moved <= 13 * len(ids)


def test_run_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op11_periodic_runs"](spark, sf).collect()}
    want = [plain_row(i, t) for i, t in documents(docs) if len((t or "").split()) < 700]
    assert len(want) > 100 and any(w[1] for w in want)
    assert len(got) == docs.count()
    for w in want:
        assert tuple(got[w[0]][c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) == w


def test_runs_edges(spark, edge):
    got = periodic.periodic_runs(edge, keep=("doc_id", "a.b", "start"), edit="doc_id").toDF("doc_id", "ab", "own_start", *"n_runs start length period exponent_milli runs_sha256 collapsed_sha256 runs collapsed".split()).collect()
    want = [plain_row(i, t) for i, t in documents(edge) if t != LONG]
    mine = [tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in got if r["doc_id"] != 5]
    assert sorted(mine, key=str) == sorted(want, key=str)
    long = next(r for r in got if r["doc_id"] == 5)
    assert (long["start"], long["length"], long["period"], long["collapsed"]) == (0, 30_000, 1, "word tail")
    assert periodic.periodic_runs(edge.limit(0)).count() == 0


# --- token files ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1, 7, 64, 4096])
def test_codec_round_trip(block):
    r = random.Random(block)
    for _ in range(60):
        ids, n = [], r.choice([0, 1, 2, 59, 60, 61, 200, 5000])
        while len(ids) < n:
            bits = r.choice([1, 2, 3, 8, 12, 15, 16, 20, 32, 59, 60, 61, 64])
            ids += [r.getrandbits(bits) for _ in range(r.choice([1, 3, 70]))]
        ids = np.array(ids[:n], np.uint64)
        words, n_words, n_escaped = tokenfile.pack(ids, block)
        n_ids = np.minimum(block, n - block * np.arange(len(n_words)))
        assert (tokenfile.unpack(words, n_words, n_escaped, n_ids) == ids).all()
    assert len(tokenfile.pack(np.ones(600, np.uint64))[0]) == 10


def expected(rows, end=1):
    import public_tokenizers as p
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(p.path(tokenfile.VOCABULARY)), 0, []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [end]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_query_equals_library(spark, sf):
    rows = sorted(documents(spark.read.parquet(f"{sf}/documents.parquet")))
    assert sorted(map(tuple, queries.QUERIES["op12_token_files"](spark, sf).collect())) == expected(rows)


def test_words_are_encoded_as_the_library_does():
    import public_tokenizers as p

    with open(p.path(tokenfile.VOCABULARY), encoding="utf-8") as f:
        e = tokenfile.Encoder(f.read())
    assert e.by_words
    r = random.Random(2)
    letters = "ab<|>'sStTrReE 1２é́ͅΣσςİß漢🙂‍\n\t\x0b\x0c\r\x1c\x85\xa0 　.,—"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(3000)] + ["", "<|ENDOFTEXT|>", "x<|endoftext|>y"]
    ids, n = e.encode(texts)
    assert np.split(ids, np.cumsum(n)[:-1]).__len__() == len(texts)
    for t, got in zip(texts, np.split(ids, np.cumsum(n)[:-1])):
        assert got.tolist() == e.library.encode(t, add_special_tokens=False).ids


def test_token_files_edges(spark, edge, tmp_path, monkeypatch):
    import public_tokenizers as p

    path, tokenizer = f"file://{tmp_path}/t", p.path(tokenfile.VOCABULARY)
    tokenfile.write_tokens(edge, path, tokenizer, 1)
    (tmp_path / "t" / "part-000000-lost.ids").write_bytes(b"of a task that was lost")
    rows = sorted(tokenfile.read_tokens(spark, path, ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((i for i, _ in documents(edge)), key=lambda i: (i is not None, i))
    assert [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows]])[:-1].tolist()
    assert all(len(r["ids"]) == r["n_tokens"] and r["ids"][-1] == 1 and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted((str(i), n, c) for i, _, n, c in expected(documents(edge)))
    tokenfile.write_tokens(edge.limit(0), path + "0", tokenizer)
    assert tokenfile.read_tokens(spark, path + "0").count() == 0


def test_slices_of_a_file(spark, tmp_path, monkeypatch):
    """Ids given as arrays; many slices and batches a file."""
    r, path = random.Random(3), f"file://{tmp_path}/t"
    rows = [(i, [r.getrandbits(r.choice([3, 16, 32])) for _ in range(r.choice([0, 1, 50, 9000]))]) for i in range(60)]
    spark.dataSource.register(tokenfile.TokenFiles)
    spark.createDataFrame(rows, "doc_id long, ids array<long>").coalesce(1).write.format("token_files").mode("append").save(path)
    monkeypatch.setattr(tokenfile, "READ_IDS", 10_000)
    monkeypatch.setattr(tokenfile, "BATCH_IDS", 3_000)
    reader, got = tokenfile._Reader(path, True), []
    assert len(reader.partitions()) > 5
    for part in reader.partitions():
        for b in reader.read(part):
            got += [(x["doc_id"], x["ids"]) for x in b.to_pylist()]
    assert got == rows


# --- forms ---------------------------------------------------------------------------------------------------------------


def plain_form(doc_id, text, rate=50):
    text = text or ""
    units = re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, len(units), "plain", None, None, text)
    spm = h[3] % 100 < 80
    return (doc_id, len(units), "spm" if spm else "psm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}")


@pytest.mark.parametrize("batch", [1, 40, 4 << 20])
def test_forms_equal_brute_force(spark, edge, batch):
    r = random.Random(4)
    made = [(100 + i, "".join(r.choice("ab <PSM>\n\x0bé漢🙂") for _ in range(r.randrange(60)))) for i in range(300)]
    docs = edge.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    try:
        fim.BATCH_BYTES, had = batch, fim.BATCH_BYTES
        for rate in (50, 100):
            df = fim.fill_in_middle(docs, fim_percent=rate)
            got = df.select("*", fim.restored(df["output"], df["form"]).alias("back")).collect()
            want = [plain_form(i, t, rate) for i, t in documents(docs)]
            assert sorted((tuple(x)[:6] for x in got), key=str) == sorted(want, key=str)
            texts = {(x["doc_id"], x["back"]) for x in got}
            assert texts == {(i, t or "") for i, t in documents(docs)}
    finally:
        fim.BATCH_BYTES = had


def test_forms_keep_clashing_columns(edge):
    got = fim.fill_in_middle(edge, keep=("n", "output", "a.b"))
    assert got.columns == ["n", "output", "a.b", "doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert len(got.collect()) == edge.count()
    assert fim.fill_in_middle(edge.limit(0)).count() == 0
