import json
import random
import re
import tracemalloc

import duckdb
import pytest
from pyspark.sql import functions as F

from gramforge.functions import text
from gramforge.functions import trigrams as T
from gramforge.functions.dialect import BadPattern, to_java
from gramforge.functions.ignore import Rules, glob_to_regex, kept, read_rules
from gramforge.operators import index as I
from gramforge.operators.index import Plan


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_lines(spark):
    got = column(spark, ["", "a\n", "a\n\n", "ab\r\ncd", "ab\r\r\n", "a", "\n", "\r"], text.lines)
    assert got == [[], ["a"], ["a", ""], ["ab", "cd"], ["ab\r"], ["a"], [""], [""]]


def test_is_text(spark):
    values = [b"", b"a", b"x" * 10 + b"\0", b"b" * 9000 + b"\0", b"b" * 8191 + b"\0", b"b" * 8192 + b"\0"]
    assert column(spark, values, text.is_text, "binary") == [False, True, False, True, False, True]


def test_fold_is_ascii_only(spark):
    assert column(spark, ["ABCxyzÀÉ"], text.fold) == ["abcxyzÀÉ"]


def test_paths(spark):
    paths = ["a/b/c.tar.gz", ".gitignore", "a/.hid", "a.", "dir.d/name", "x.py"]
    assert column(spark, paths, text.extension) == [".gz", "", "", ".", "", ".py"]
    assert column(spark, paths, text.basename) == ["c.tar.gz", ".gitignore", ".hid", "a.", "name", "x.py"]
    assert column(spark, ["/r/a/b", "/r", "/other/a", "/ra"], lambda c: text.relative(c, "/r")) == ["a/b", "", "/other/a", "a"]


def test_json_string(spark):
    values = ['a"b\\c\n\r\t', "\x01é漢", "plain"]
    for v, got in zip(values, column(spark, values, text.json_string), strict=True):
        assert json.loads('"' + got + '"') == v
    assert column(spark, ["é\x02"], lambda c: text.json_string(c, ascii_bytes=True)) == ["\\u00c3\\u00a9\\u0002"]


def test_indexable(spark):
    values = ["ab", "abc", "});", "a" * 512, "a" * 513, "a" * 511 + "\r", "a" * 512 + "\r", "éé"]
    assert column(spark, values, text.indexable) == [False, True, False, True, False, True, False, False]


def brute_trigrams(content: bytes, everything=False):
    out = set()
    for line in content.split(b"\n"):
        if everything:
            line = line.lower()
        elif len(line) > 512 or not re.search(rb"[0-9A-Za-z]", line):
            continue
        out |= {line[i] << 16 | line[i + 1] << 8 | line[i + 2] for i in range(len(line) - 2)}
    return sorted(out)


@pytest.mark.parametrize("content", [b"", b"a", b"ab\n", b"abc", b"\n\n\n", b"a b c\n});\nABCabc\xc3\xa9\r\n", b"x" * 512 + b"\n" + b"y1" * 300, b"};)\nab\nabc\n\nabcd", b"abc\n", bytes(range(256))])
def test_trigrams(content):
    for everything in (False, True):
        assert T.of_content(content, everything).tolist() == brute_trigrams(content, everything)


@pytest.mark.parametrize("everything", [False, True])
def test_a_long_text_is_cut(monkeypatch, everything):
    text = b"ab\n" + b"Cd" * 900 + b"\n{ }\n" + b"ef gh\n" * 40 + b"x" * 513 + b"\n\nyZ1"
    for size in (600, 601, 640, 1024):
        monkeypatch.setattr(T, "PIECE_BYTES", size)
        assert T.of_content(text, everything).tolist() == brute_trigrams(text, everything)


@pytest.mark.parametrize("text", [b"some words\n" * 1_000_000, b"words " * 2_000_000])
def test_a_long_text_takes_little_memory(text):
    tracemalloc.start()
    try:
        for everything in (False, True):
            T.of_content(text, everything)
        assert tracemalloc.get_traced_memory()[1] < 64 << 20
    finally:
        tracemalloc.stop()


def test_lists_of_a_bounded_number_of_pairs(spark):
    """A task begins the list of a trigram that all texts have anew, and it ends as one."""
    draw = random.Random(1)
    texts = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=500)) + "\nthe" for _ in range(4_000)]
    corpus = spark.createDataFrame(enumerate(texts), "file_id long, content string").coalesce(1)
    most = T.partial_lists(corpus, I.SEGMENT_BITS).agg(F.max(F.size("file_ids"))).first()[0]
    assert 0 < most <= T.MOST_PAIRS // 400
    whole = I.posting_lists(corpus).agg(F.max(F.size("file_ids")), F.sum(F.size("file_ids"))).first()
    assert tuple(whole) == (4_000, sum(len(brute_trigrams(t.encode())) for t in texts))


def test_pairs_of_some_trigrams(spark):
    corpus = spark.createDataFrame([(1, "of the"), (2, "xyz"), (3, None), (4, "THE the")], "file_id long, content string")
    asked = T.of_pattern(b"the")
    assert sorted(map(tuple, T.with_trigrams(corpus, only=asked).collect())) == [(1, asked), (2, []), (3, []), (4, asked)]
    assert sorted(r.file_id for r in I.pairs(corpus, only=asked).collect()) == [1, 4]


def test_patterns_and_plans():
    assert T.of_pattern(b"ab") == [] and T.of_pattern(b"aaaa") == [0x616161]
    assert T.of_pattern("éa".encode()) == [12822881]
    assert T.is_noise(int.from_bytes(b"} )", "big")) and not T.is_noise(int.from_bytes(b"a )", "big"))
    own = T.of_pattern(b"tion, the")
    df = {t: 10 - i for i, t in enumerate(own)}
    assert Plan.of(b"tion, the", df).required == sorted(own, key=lambda t: df[t])[:4]
    assert Plan.of(b"tion, the", {}).nothing
    assert Plan.of(b"ab", {}) == Plan([])
    mixed = b"foo(); }\t"
    asked = [t for t in T.of_pattern(mixed) if not T.is_noise(t)]
    assert not Plan.of(mixed, {t: 1 for t in asked}).nothing  # noise that is missing doesn't matter
    noisy = b"} ){ (;[]"
    assert len(T.of_pattern(noisy)) > 4 and Plan.of(noisy, {}).nothing
    assert len(Plan.of(noisy, {t: 1 for t in T.of_pattern(noisy)}).required) == 4


def test_delta(spark):
    ids = spark.createDataFrame([([1, 4, 9, 100],), ([7],), ([],)], "x array<long>")
    rows = ids.select("x", T.delta_encoded(F.col("x")).alias("d")).select("x", "d", T.delta_decoded(F.col("d")).alias("y")).collect()
    assert rows[0].d == [1, 3, 5, 91] and all(r.x == r.y for r in rows)


# pattern, texts that match, texts that don't
DIALECT = [
    ("a.c", ["abc", "a\rc"], ["a\nc"]),
    ("x$", ["x"], ["x\r"]),
    (r"\ba", ["éa", "a", " a"], ["ba"]),
    (r"a\B", ["ab"], ["a", "aé"]),
    ("[[:alpha:]]k", ["ak"], ["1k"]),
    ("[[:^digit:]]", ["a"], ["1"]),
    (r"(?P<year>\d{4})", ["2024"], ["202"]),
    (r"(?P<a_b>x)", ["x"], ["y"]),
    (r"a\sb", ["a b", "a\tb"], ["a\x0bb"]),
    (r"a\Sb", ["a\x0bb"], ["a b"]),
    (r"\v", ["\x0b"], ["\n", "\x0c"]),
    ("[a[b]", ["[", "a", "b"], ["c"]),
    ("[a&&b]", ["&", "a", "b"], ["c"]),
    ("[]a]", ["]", "a"], ["b"]),
    ("[^]a]", ["b"], ["]", "a"]),
    ("a{,5}", ["a{,5}"], ["aaa"]),
    ("a{2", ["a{2"], ["aa"]),
    ("a{2}$", ["aa"], ["a"]),
    (r"\x41\x{42}\103", ["ABC"], ["abc"]),
    (r"\pL+\p{Greek}", ["aα"], ["ab"]),
    (r"\p{^L}", ["1"], ["a"]),
    (r"\Qa.b\E+", ["a.b", "a.bb"], ["axb"]),
    ("(?i)abc", ["ABC"], ["abd"]),
    ("^(?P<n>a)(?P<n>b)$", ["ab"], ["a"]),
    ("^((a{10}){5}b){2}$", ["a" * 50 + "b" + "a" * 50 + "b"], ["a" * 50 + "b"]),
    ("x*", ["", "y"], []),
    ("a|b|", ["c"], []),
    (r"[\d\s-]", ["1", " ", "-"], ["a"]),
    ("[a-c]", ["b"], ["-"]),
    ("#", ["#"], ["a"]),
]
REFUSED = ["(", "a)", "(a)\\1", "(?=a)", "(?!a)", "(?<=a)b", "(?<!a)b", "(?<n>a)", "a++", "a*+", "a**", "*a", "a{1001}", "a{3,2}", "(a{500}){3}", "(a|(?:b{2,}c{9}){12}){10}", "\\Z", "\\G", "\\k", "(?>a)", "[a", "[[:foo:]]", "a\\", "(?U)a+", "|*", "\\8", "[z-a]", "(?x)a"]


def test_dialect(spark):
    for pattern, good, bad in DIALECT:
        rows = spark.createDataFrame([(t, True) for t in good] + [(t, False) for t in bad], "t string, want boolean")
        for r in rows.select("t", "want", F.col("t").rlike(to_java(pattern)).alias("got")).collect():
            assert r.got == r.want, (pattern, r.t)


@pytest.mark.parametrize("pattern", REFUSED)
def test_refused(pattern):
    with pytest.raises(BadPattern):
        to_java(pattern)


def test_validity():
    """Patterns made of pieces are refused where another RE2 refuses them; one that repeats a flag group is left out."""
    rng = random.Random(5)
    pieces = ["a", "b", "(", "(?:", "(?i)", "(?i:", ")", "{2}", "{10}", "{100}", "{500}", "{3,}", "{2,40}", "{0}", "{0,3}", "*", "+", "?", "|", "[ab]", "\\d", "(?P<n>", "(?P<k>", "x{", "]", "}", "\\Qa.\\E"]
    patterns = ["((a{10}){10}){10}", "((a{10}){10}){11}", "(a{1000}){0,1}", "(a{1000})*", "(a{2}?){500}", "(a{2}?){501}", "[a{2}]{1000}", "(a(?i)b{500}){3}"]
    patterns += ["".join(rng.choices(pieces, k=rng.randint(1, 9))) for _ in range(4000)]
    con = duckdb.connect()
    for p in patterns:
        if re.search(r"\(\?i\)[*+?{]", p):
            continue
        try:
            con.execute("SELECT regexp_matches('abc', $1)", [p])
            valid = True
        except duckdb.Error:
            valid = False
        try:
            to_java(p)
            ours = True
        except BadPattern:
            ours = False
        assert ours == valid, p


def test_folding(spark):
    assert column(spark, ["é", "É", "straße"], lambda c: c.rlike(to_java("É", ignore_case=True))) == [True, True, False]


def test_rules(spark):
    assert read_rules("# c\n\nbuild/ \t\r\n*.o\n") == ["build/", "*.o"]
    r = Rules.of(["build/", "*.d/", "pkg/out/", "*.o", "docs/*.html", "!x", "/abs"])
    assert (r.dir_names, r.dir_globs, r.dir_paths, r.names, r.paths) == (["build"], ["*.d"], ["pkg/out"], ["*.o", "!x"], ["docs/*.html", "/abs"])
    paths = {
        "a/build/x": False, "build/x": False, "build": True, "a/b.d/c": False, "b.d": True, "pkg/out/x": False, "a/pkg/out/x": True,
        "x.o": False, "d/x.o": False, "x.o/y": False, "docs/a.html": False, "docs/b/a.html": True, "!x": False, "x": True, "abs": True, "mybuild/x": True,
    }
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    got = {x.p: x.k for x in rows.select("p", kept(F.col("p"), r).alias("k")).collect()}
    assert got == paths
    only = {x.p: x.k for x in rows.select("p", kept(F.col("p"), r, files_only=True).alias("k")).collect()}
    assert only["a/build/x"] and not only["x.o"] and only["x.o/y"]


def test_globs():
    for glob, good, bad in (("a[!b]c", ["axc"], ["abc"]), ("a?", ["ab"], ["a", "a/"]), ("*.[ch]", ["x.c", ".h"], ["x.cc", "d/x.c"]), ("a\\*", ["a*"], ["ab"]), ("[", ["["], ["a"]), ("[]-]x", ["]x", "-x"], ["ax"])):
        regex = re.compile(glob_to_regex(glob, path=True))
        assert all(regex.fullmatch(x) for x in good) and not any(regex.fullmatch(x) for x in bad), glob
