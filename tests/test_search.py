"""Search with an index, and ignore files of repositories."""

import random
import re

import pytest

from tracelake.operators import documents, ignore


def test_needed_trigrams_never_rule_out_a_match():
    r = random.Random(1)
    pieces = ["abc", "ab", "Kelvin", "x+", "(def)", "(?:gh|ij)", "[kl]m", "no?", ".", "^", "$", r"\d+", "é", r"\.", "(?i:zzz)", "q{2,3}", "straße", "tail"]
    checked = 0
    for _ in range(4000):
        pattern = "".join(r.choice(pieces) for _ in range(r.randrange(1, 6)))
        flags = r.choice([0, re.I])
        text = "".join(r.choice(["abc", "ABC", "ab", "Kelvin", "kelvin", "x", "xx", "def", "DEF", "gh", "ij", "km", "lm", "no", "n", "7", "é", "É", ".", "zzz", "ZZZ", "qq", "qqq", "straße", "tail", " "]) for _ in range(14))
        if re.search(pattern, text, flags):
            checked += 1
            lowered = text.encode().lower()
            for three in documents.needed_trigrams(pattern, flags == re.I):
                assert bytes([three >> 16, three >> 8 & 255, three & 255]) in lowered, (pattern, text)
    assert checked > 300
    t = documents.needed_trigrams
    assert t("Licen[cs]e") == {documents._trigram(x) for x in (b"lic", b"ice", b"cen")} and t("abc|def") == set() and t("(abc)?x") == set() and t("(") == set() and t(r"\Qabc\E") == set()
    assert t("(?x)a b c") == set() and t("KISS", True) == set() and t("(?i)abcd") == {documents._trigram(b"abc"), documents._trigram(b"bcd")}


@pytest.mark.parametrize("pattern", ["needle", "ne+dle [a-c]", "x|needle", "Éa b"])
@pytest.mark.parametrize("ignore_case", [False, True])
def test_index_gives_the_same_rows(spark, tmp_path, pattern, ignore_case):
    texts = [("a", "one\nneedle a\nthree\nneedle c needle b"), ("b", "NEEDLE\nneeedle B"), ("c", None), ("d", ""), ("e", "x\nÉa b\néA b"), ("f", "no\nthing")]
    docs = spark.createDataFrame(texts, "key string, text string")
    documents.write_trigrams(docs, str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(documents.searched_by_index(docs, index, pattern, context=1, ignore_case=ignore_case)) == rows(documents.searched(docs, pattern, context=1, ignore_case=ignore_case))


def test_files_that_are_ruled_out_are_not_read(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "s").mkdir(parents=True)
    for name, text in (("a.txt", "needle"), ("s/b.txt", "x\nthe needle"), ("s/c.txt", "other")):
        (root / name).write_text(text)
    documents.write_trigrams(documents.repository_texts(spark, str(root)).selectExpr("path as key", "text"), str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    (root / "s" / "c.txt").write_text("needle that the index does not know")  # would be found if it were read
    found = documents.search_repository(spark, str(root), index, "need(le)")
    assert sorted((r["key"], r["line"], r["col"]) for r in found.collect()) == [("a.txt", 1, 1), ("s/b.txt", 2, 5)]
    assert documents.search_repository(spark, str(root), index, "absent").count() == 0
    assert documents.search_repository(spark, str(root), index, "need(le)", most_files=1).count() == 2
    assert documents.truncated(found, 2) and not documents.truncated(found, 3)


CASES = [
    (".gitignore", "*.log\n!keep.log\n/build\ndocs/*.md\n#c\n\\#odd\ntemp/\n a b \nspace\\ \n**/deep/x\nfoo/**\na/**/z\n[ab]?.c\n[!x]y.d\nopen[\n"),
    ("sub/.gitignore", "!*.log\nonly.txt\n/rooted\nbuild\n"),
    ("sub/in/.gitignore", "keep.log\n"),
    (".ignore", "!special.log\nextra\n"),
    ("foo/.gitignore", "!back\n"),
]
KEPT = "keep.log docs/a.txt docs/in/a.md x/build/f odd sub/a.log sub/x/b.log sub/other.txt temp x/rooted sub/x/rooted deepx ab.cc xy.d special.log d/special.log x/docs/a.md open[ k.txt foo/back".split()
GONE = "a.log x/a.log build build/f docs/a.md #odd d/temp/f temp/f x/deep/x deep/x foo/a a/z a/b/z a/b/c/z ax.c zy.d sub/only.txt sub/x/only.txt sub/rooted sub/build/f sub/in/keep.log extra x/extra/f .hidden x/.h/f".split()


def test_rules_of_nested_ignore_files(spark):
    files = spark.createDataFrame(CASES, "path string, text string")
    kept_temp = [p for p in KEPT if p != "temp"] + ["x/temp"]  # a file named as a folder-only rule
    paths = spark.createDataFrame([(p,) for p in kept_temp + GONE + ["space ", " a b"]] + [(None,)], "path string")
    got = {r["path"] for r in ignore.kept(paths, ignore.rules(files)).collect()}
    assert got == set(kept_temp), (got - set(kept_temp), set(kept_temp) - got)
    none = spark.createDataFrame([], "path string, text string")
    assert {r["path"] for r in ignore.kept(paths, ignore.rules(none)).collect()} == {r["path"] for r in paths.collect() if r["path"] and not re.search(r"(^|/)\.", r["path"])}


def test_repository_honours_ignore_files(spark, tmp_path):
    root = tmp_path / "repo"
    for name, text in ((".gitignore", "*.log\n"), (".ignore", "!.shown\nsecret/\n"), ("a.txt", "x"), ("a.log", "x"), (".shown", "x"), (".other", "x"), ("secret/b.txt", "x"), ("s/c.txt", "x")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    paths = lambda: sorted(r["path"] for r in documents.repository_texts(spark, str(root)).collect())
    assert paths() == [".shown", "a.log", "a.txt", "s/c.txt"]
    (root / ".git").mkdir()
    assert paths() == [".shown", "a.txt", "s/c.txt"]
