"""Terms in texts: automata in arrays against one search a term."""

import random

import numpy as np
import pytest

from tracelake.operators import privacy, terms


def plain(text, words):
    return sorted((s["start"], -s["end"], s["kind"], s["text"]) for t, k in words for s in privacy.occurrences(text or "", t, k))


def made(words):
    texts = sorted({t.encode() for t, _ in words})
    return terms.Automaton.of(texts), texts


@pytest.mark.parametrize("seed", range(4))
def test_automaton_equals_one_search_a_term(seed, monkeypatch):
    monkeypatch.setattr(terms, "LANE", [1, 7, 64, 512][seed])
    r = random.Random(seed)
    for _ in range(60):
        letters = r.choice(["ab", "abc", "aé漢"])
        words = {"".join(r.choice(letters) for _ in range(r.choice([1, 2, 3, 4, 9]))) for _ in range(r.randrange(1, 25))}
        texts = ["".join(r.choice(letters) for _ in range(r.choice([0, 1, 5, 60, 200]))) for _ in range(6)]
        auto, own = made([(w, "") for w in words])
        raw = [t.encode() for t in texts]
        offsets = np.cumsum([0, *map(len, raw)])
        end, term = auto.find(np.frombuffer(b"".join(raw), np.uint8), offsets)
        got = sorted(zip(end.tolist(), term.tolist()))
        whole = b"".join(raw)
        want = sorted((e, i) for i, w in enumerate(own) for a, b in zip(offsets, offsets[1:]) for e in range(a + len(w), b + 1) if whole[e - len(w) : e] == w)
        assert got == want


@pytest.mark.parametrize("shard", [20, 8 << 20])
def test_occurrences_and_redaction(spark, shard, monkeypatch):
    monkeypatch.setattr(terms, "SHARD_BYTES", shard)
    r = random.Random(shard)
    words = [("Ann", "person_name"), ("Ann Lee", "person_name"), ("aa", "org"), ("aaa", "street_address"), ("", "org"), ("漢字", "org"), ("a@b.com", "org"), ("é", "org"), ("Ann", "zz"), (None, "org")]
    texts = [(1, None), (2, ""), (3, "Ann Lee and Annex; mail a@b.com aaaaaaa"), (3, "Ann Lee and Annex; mail a@b.com aaaaaaa"), (4, "漢字漢字é " * 2000), *[(10 + i, "".join(r.choice("Ann Leeaé漢字 @b.com") for _ in range(200))) for i in range(30)]]
    df = spark.createDataFrame(texts, "doc long, `te.xt` string")
    own = terms.build(spark.createDataFrame(words, "text string, kind string"))
    assert (len(own.shards) == 1) == (shard > 100)
    used = [(t, k) for t, k in words if t and k != "zz"]
    got = terms.occurrences(df, own, "te.xt").collect()
    assert sorted((x["doc"], str(x["te.xt"]), [(s["start"], -s["end"], s["kind"], s["text"]) for s in x["terms"]]) for x in got) == sorted((d, str(t), plain(t, used)) for d, t in texts)

    def redacted(text):
        if text is None:
            return None
        for s in reversed(privacy.merged(privacy.detected(text) + [s for t, k in sorted(used, key=lambda w: w[1]) for s in privacy.occurrences(text, t, k)])):
            text = text[: s["start"]] + f"[REDACTED:{privacy.KINDS[s['kind']][1]}]" + text[s["end"] :]
        return text

    assert sorted((x["doc"], str(x["redacted"])) for x in terms.redacted(df, own, "te.xt").collect()) == sorted((d, str(redacted(t))) for d, t in texts)
    own.remove(spark)
    none = terms.build(spark.createDataFrame([], "text string, kind string"))
    assert none.shards == [] and terms.occurrences(df, none, "te.xt").where("size(terms) > 0").count() == 0


def test_many_terms(monkeypatch):
    """A hundred thousand terms: found are those that were put in."""
    r = random.Random(9)
    words = sorted({"".join(r.choice("abcdefghij") for _ in range(8)).encode() for _ in range(100_000)})
    auto, planted = terms.Automaton.of(words), r.sample(range(len(words)), 500)
    text = b" ".join(words[i] for i in planted)
    end, term = auto.find(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert sorted(term.tolist()) == sorted(planted) and end.max() == len(text)


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_ranks_over_ranges(spark, partitions):
    """Groups that fill one range, many, or share one; nulls; few values that tie."""
    r = random.Random(int(partitions))
    rows = [(r.choice(["a", "a", "a", "a", "b", None]), r.choice([None, *range(50)]), i) for i in range(700)] + [("lone", 1, 1)]
    had = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows, "g string, o long, tie long")
        got = sorted((str(x["g"]), x["n"], str(x["o"]), x["tie"]) for x in privacy.ranks(df, "g", ["o", "tie"]).collect())
        assert privacy.ranks(df.limit(0), "g", ["o", "tie"]).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)
    want = []
    for g in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        want += [(str(g), i + 1, str(o), t) for i, (_, o, t) in enumerate(own)]
    assert got == sorted(want)
