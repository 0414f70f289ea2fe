import io
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from gramforge import cli
from gramforge.operators import index as I
from gramforge.operators import sink
from gramforge.operators.scan import Pattern, scan
from gramforge.operators.search import Search
from gramforge.plans import catalogue
from gramforge.sources.corpus import from_tree
from gramforge.streaming import watch

SF = "/root/testdata/sf0.001"
# FIXED VALUES: files and matching lines by scan, candidates and matches by the compat index, over sf0.001.
GOLDEN = {"of the": (63, (49, 102), (44, 97)), "tion": (129, (138, 904), (129, 895)), "é": (200, (23, 171), (23, 171)), "çon": (6, (7, 7), (6, 6)), "tion, the": (45, (13, 14), (7, 8))}


@pytest.fixture(scope="module")
def corpus(spark):
    return catalogue.corpus(spark, SF).cache()


@pytest.fixture(scope="module")
def indexes(corpus, tmp_path_factory):
    at = tmp_path_factory.mktemp("index")
    return {m: I.TrigramIndex.build(corpus, str(at / m), m) for m in ("compat", "lossless")}


def totals(df):
    r = df.agg(F.count("*"), F.coalesce(F.sum("match_count"), F.lit(0))).first()
    return r[0], r[1]


@pytest.mark.parametrize("pattern", GOLDEN)
def test_golden(corpus, indexes, pattern):
    cand, scanned, indexed = GOLDEN[pattern]
    search = Search(corpus, indexes["compat"]).literal(pattern).files_only()
    assert indexes["compat"].candidates(pattern).count() == cand
    assert totals(search.without_index().to_df()) == scanned
    assert totals(search.to_df()) == indexed
    assert totals(search.with_index(indexes["lossless"]).to_df()) == scanned


def test_case(corpus, indexes):
    search = Search(corpus, indexes["compat"]).literal("THE", ignore_case=True).files_only()
    assert totals(search.without_index().to_df()) == (143, 994)
    assert totals(search.to_df()) == (1, 6)
    assert totals(search.with_index(indexes["lossless"]).to_df()) == (143, 994)


def test_index_totals(indexes):
    r = indexes["compat"].stats().first()
    assert (r.trigrams, r.pairs) == (5040, 79409)


def test_properties(corpus, indexes):
    """Indexed results are part of the scan's, candidates hold them, and a literal is its escaped regular expression."""
    for p in ("ing", "a b", "(", "z", "er. "):
        ids = lambda df: {r.file_id for r in df.select("file_id").collect()}
        scanned = Search(corpus).literal(p).without_index().files_only().to_df()
        indexed = ids(Search(corpus, indexes["compat"]).literal(p).files_only().to_df())
        assert indexed <= ids(scanned) and indexed <= ids(indexes["compat"].candidates(p))
        assert ids(Search(corpus, indexes["lossless"]).literal(p).files_only().to_df()) == ids(scanned)
        escaped = "".join("\\" + c if not c.isalnum() and c != " " else c for c in p)
        assert totals(Search(corpus).regex(escaped).files_only().to_df()) == totals(scanned)


def rows(spark, texts):
    return spark.createDataFrame([(i, f"f{i}.txt", t) for i, t in enumerate(texts)], "file_id long, path string, content string")


def test_records(spark):
    df = rows(spark, ["x é the the\nno\r\nthe\r\n", None, "", "a\0the", "THE\n"])
    got = scan(df, Pattern("the")).collect()
    assert [(r.file_id, r.match_count, r.total_lines, r.density) for r in got] == [(0, 2, 3, 2 / 3)]
    assert [tuple(m) for m in got[0].matches] == [(1, "x é the the", 5, 3), (3, "the", 0, 3)]
    got = scan(df, Pattern("x*", regex=True)).orderBy("file_id").first()
    assert [tuple(m)[2:] for m in got.matches] == [(0, 1), (0, 0), (0, 0)]
    empty = scan(df, Pattern("")).orderBy("file_id").first()
    assert empty.match_count == 3 and {tuple(m)[2:] for m in empty.matches} == {(0, 0)}


def test_order_limit_and_rules(spark):
    df = rows(spark, ["a\nb", "a", "a\na\nb", "a"])
    assert [r.file_id for r in Search(df).literal("a").to_df().collect()] == [1, 3, 2, 0]
    assert [r.file_id for r in Search(df).literal("a").limit(2).to_df().collect()] == [1, 3]
    assert Search(df).literal("a").limit(-1).to_df().count() == 4
    assert Search(df).literal("a").ignore("f1.*", "f2.txt").to_df().count() == 2
    assert Search(df).literal("a").ext("txt").to_df().count() == 0
    for bad in ("(", "(a)\\1", "(?=a)"):
        assert Search(df).regex(bad).to_df().collect() == []


def test_index_version_and_existence(spark, indexes, tmp_path):
    df = rows(spark, ["abc"])
    index = I.TrigramIndex.build(df, str(tmp_path / "i"))
    with pytest.raises(FileExistsError):
        I.TrigramIndex.build(df, str(tmp_path / "i"), if_exists="error")
    (tmp_path / "i/manifests/00000007.json").write_text(json.dumps({"version": 1, "mode": "compat", "layers": {}}))
    assert Search(df, index).literal("abc").to_df().collect() == []
    with pytest.raises(I.IndexMismatch):
        I.TrigramIndex(spark, str(tmp_path / "none")).candidates("abc")


def test_changes_equal_rebuilding(spark, tmp_path):
    before = ["alpha one", "beta two", "gamma three", "delta four"]
    index = I.TrigramIndex.build(rows(spark, before), str(tmp_path / "i"))
    changed = spark.createDataFrame([(1, "f1.txt", "omega two"), (4, "f4.txt", "alpha new")], "file_id long, path string, content string")
    index.apply(changed, spark.createDataFrame([(0,)], "file_id long"))
    after = {1: "omega two", 2: "gamma three", 3: "delta four", 4: "alpha new"}
    fresh = I.TrigramIndex.build(spark.createDataFrame([(i, f"f{i}.txt", t) for i, t in after.items()], "file_id long, path string, content string"), str(tmp_path / "j"))
    ids = lambda i, p: sorted(r.file_id for r in i.candidates(p).collect())
    for _ in range(2):
        for p in ("alpha", "beta", "omega", "two", "a", "new", "four"):
            assert ids(index, p) == ids(fresh, p), p
        index.compact()
    assert index.stats().first() == fresh.stats().first()


def against_sql(spark, tmp_path, name, rows):
    """A query's rows and its SQL's over documents given as (doc_id, source, text)."""
    spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("lang", F.lit("en")).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = catalogue.QUERIES[name](spark, str(tmp_path))
    return sorted(map(tuple, got.collect())), sorted(con.sql(catalogue.ORACLE_SQL[name]).select(*got.columns).fetchall())


@pytest.mark.parametrize("name", ["index_delete", "index_upsert"])
def test_an_empty_text_is_no_file_to_change(spark, tmp_path, name):
    got, want = against_sql(spark, tmp_path, name, [(1, "src1", ""), (2, "src1", "abc"), (3, "src2", "hen"), (4, "src3", "of the"), (5, "src1", None)])
    assert got == want


def test_the_rarest_trigrams_of_what_is_left(spark, tmp_path):
    """"hen" is the most frequent trigram of the pattern where deleted files count, and the rarest where they don't."""
    rows = [(1, "src1", "abc"), *((i, "src3", "of the") for i in range(2, 5)), *((i, "src2", "hen") for i in range(5, 10))]
    got, want = against_sql(spark, tmp_path, "index_upsert", rows)
    assert got == want == [(1,)]


def test_stream_of_changes(spark, tmp_path):
    index = I.TrigramIndex.build(rows(spark, ["alpha", "beta"]), str(tmp_path / "i"))
    folder = tmp_path / "changes"
    schema = "path string, op string, content binary"
    spark.createDataFrame([("f0.txt", "modify", b"gamma"), ("n.txt", "create", b"alpha beta"), (".gramforge/x", "modify", b"alpha"), ("gone", "delete", None)], schema).coalesce(1).write.parquet(str(folder))
    q = watch.keep_updated(spark.readStream.schema(schema).parquet(str(folder)), index, str(tmp_path / "c"), availableNow=True)
    q.awaitTermination(120)
    paths = lambda p: sorted(r.path for r in index.candidates(p).collect())
    assert paths("alpha") == ["n.txt"] and paths("gamma") == ["f0.txt"] and paths("beta") == ["f1.txt", "n.txt"]


@pytest.fixture
def tree(tmp_path):
    files = {"a.py": b"import os\nprint(1)\n", ".hid/b.py": b"import re\n", "_x/c.txt": b"import\n", "build/d.py": b"import x\n", "e.o": b"import\n", "empty.py": b"", "bin.dat": b"import\0", "sub/é.py": b"x = 1\n# import \xff\n", ".gitignore": b"build/\n*.o\n"}
    for name, data in files.items():
        at = tmp_path / "t" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data)
    return tmp_path / "t"


def test_tree(spark, tree):
    files = from_tree(spark, str(tree))
    got = {r.path: r.file_id for r in files.select("path", "file_id").collect()}
    assert sorted(got) == [".gitignore", ".hid/b.py", "_x/c.txt", "a.py", "bin.dat", "empty.py", "sub/é.py"]
    assert sorted(got.values()) == list(range(7)) and [p for p, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(got)
    found = Search(files).literal("import").ext(".py").to_df().collect()
    assert [(r.path, r.match_count) for r in found] == [(".hid/b.py", 1), ("a.py", 1), ("sub/é.py", 1)]
    with pytest.raises(Exception, match="nowhere"):
        from_tree(spark, str(tree / "nowhere")).count()


def test_watching_a_tree(spark, tree, tmp_path):
    index = I.TrigramIndex.build(from_tree(spark, str(tree)), str(tmp_path / "i"))
    (tree / "new.py").write_bytes(b"fresh words\n")
    q = watch.watch_tree(spark, str(tree), index, str(tmp_path / "c"))
    try:
        q.processAllAvailable()
        assert [r.path for r in index.candidates("fresh").collect()] == ["new.py"]
        (tree / "a.py").unlink()
        (tree / "new.py").write_bytes(b"other words here\n")
        os.utime(tree / "new.py", (1, 1))
        q.processAllAvailable()
        assert index.candidates("fresh").collect() == [] and [r.path for r in index.candidates("print").collect()] == []
    finally:
        q.stop()


def test_sinks(spark):
    df = rows(spark, ['say "the"\\\tend\né', "the"])
    found = scan(df, Pattern("the")).orderBy("file_id")
    out = [json.loads(r.json) for r in sink.json_rows(found).orderBy("file_id").collect()]
    assert out[0] == {"file": "f0.txt", "match_count": 1, "density": 0.5, "matches": [{"line": 1, "content": 'say "the"\\\tend'}]}
    assert json.loads(sink.json_document(found))[1]["file"] == "f1.txt"
    assert sink.json_document(found.limit(0)) == "[\n\n]\n"
    assert sink.text_document(found) == 'f0.txt\n     1  say "the"\\\tend\n\nf1.txt\n     1  the\n'
    assert sink.text_document(scan(df, Pattern("the"), files_only=True).orderBy("file_id")) == "f0.txt  1 match \nf1.txt  1 match \n"


def test_command_line(spark, tree):
    def run(*args):
        out = io.StringIO()
        assert cli.main([*args, "-p", str(tree)], spark, out) == 0
        return out.getvalue()

    assert [x["file"] for x in json.loads(run("import", "--json", "--files-only", "--no-index", "-t", ".py"))] == [".hid/b.py", "a.py", "sub/é.py"]
    assert len(json.loads(run("import", "--json", "--reindex"))) == 4
    assert run("IMPORT", "-i", "--files-only", "--limit", "1", "--no-index").count("\n") == 1
    assert json.loads(run("(", "-r", "--json")) == []
    assert cli.main(["x", "-p", str(tree / "nowhere")], spark) == 1


def escaped(data):
    named = {0x22: '\\"', 0x5C: "\\\\", 10: "\\n", 13: "\\r", 9: "\\t"}
    return "".join(named.get(b, chr(b) if 0x20 <= b < 0x80 else f"\\u{b:04x}") for b in data)


def test_json_escape_of_all_lines(spark, tmp_path):
    texts = ["é" * 30 + ' "q" \\ \t\x01\x7f end', "short", "x" * 5000 + "ç\r\n\r\r\n", "", "a" * 39 + "\n" + "b" * 40 + "\n🙂"]
    spark.createDataFrame([(i, "s", "en", t) for i, t in enumerate(texts)], "doc_id long, source string, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.file_id, r.line): r.escaped for r in catalogue.QUERIES["json_escape_lines"](spark, str(tmp_path)).collect()}
    lines = {i: t.encode().removesuffix(b"\n").split(b"\n") for i, t in enumerate(texts) if t}
    assert got == {(i, k + 1): escaped(x.removesuffix(b"\r")) for i, own in lines.items() for k, x in enumerate(own)}


def test_indexed_search_after_changes_of_the_tree(spark, tree, tmp_path):
    """Files that come or go behind the index's back shift numbers, not what is found in the others."""
    index = I.TrigramIndex.build(from_tree(spark, str(tree)), str(tmp_path / "i"))
    found = lambda p: sorted(r.path for r in Search(from_tree(spark, str(tree)), index).literal(p).ext(".py").to_df().collect())
    every = [".hid/b.py", "a.py", "sub/é.py"]
    assert found("import") == every
    (tree / ".a.py").write_bytes(b"nothing\n")
    assert found("import") == every and found("print") == ["a.py"]
    (tree / ".hid/b.py").unlink()
    (tree / ".a.py").unlink()
    assert found("import") == every[1:]
    (tree / "b.py").write_bytes(b"import fresh words\n")
    q = watch.watch_tree(spark, str(tree), index, str(tmp_path / "c"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert found("fresh") == ["b.py"] and found("import") == ["a.py", "b.py", "sub/é.py"]


def test_command_line_with_an_index_of_some_types(spark, tree):
    def run(*args):
        out = io.StringIO()
        assert cli.main(["import", "--json", "--files-only", *args, "-p", str(tree)], spark, out) == 0
        return [x["file"] for x in json.loads(out.getvalue())]

    py = [".hid/b.py", "a.py", "sub/é.py"]
    assert sorted(run("--reindex", "-t", ".py")) == py and sorted(run("-t", ".py")) == py and sorted(run()) == py


def test_long_line_with_nul(spark):
    """The fixture's row 7 is split and scanned by a registered query."""
    got = catalogue.QUERIES["line_split_edge"](spark, SF).filter("file_id = 7").orderBy("line").collect()
    assert [bytes.fromhex(r.content) for r in got] == (b"b" * 9000 + b"\0b\nb").split(b"\n")
    assert [tuple(r) for r in catalogue.QUERIES["crlf_strip"](spark, SF).filter("file_id = 7").collect()] == [(7, 2, 2)]


def test_a_batch_that_died_is_run_again(spark, tmp_path, monkeypatch):
    """A batch dies after its lists are written, and is run again, twice: nothing is lost and nothing counts twice."""
    index = I.TrigramIndex.build(rows(spark, ["alpha", "beta"]), str(tmp_path / "i"))
    changes = spark.createDataFrame([(f"n{i}.txt", "create", b"omega words") for i in range(5)] + [("f0.txt", "delete", None)], "path string, op string, content binary")
    with monkeypatch.context() as m:
        m.setattr(I.TrigramIndex, "_publish", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            watch.apply_changes(index, changes, batch=("s", 3))
    paths = lambda p: sorted(r.path for r in index.candidates(p).collect())
    assert paths("omega") == [] and paths("alpha") == ["f0.txt"]
    for _ in range(2):
        watch.apply_changes(index, changes, batch=("s", 3))
        assert paths("omega") == [f"n{i}.txt" for i in range(5)] and paths("alpha") == [] and paths("beta") == ["f1.txt"]
    assert len(index.manifest().layers) == 2
    watch.apply_changes(index, changes.limit(0), batch=("s", 4))
    assert len(index.manifest().layers) == 2


def test_readers_see_one_state(spark, tmp_path):
    index = I.TrigramIndex.build(rows(spark, ["alpha one", "beta two"]), str(tmp_path / "i"))
    index.apply(spark.createDataFrame([(1, "f1.txt", "alpha two")], "file_id long, path string, content string"))
    before = index.candidates("alpha")
    state = index.manifest()
    index.compact()
    assert before.count() == 2 and index.candidates("alpha", state=state).count() == 2  # the state before is still there
    I.TrigramIndex.build(rows(spark, ["gamma"]), index.path)
    index.vacuum()
    assert [r.path for r in index.candidates("gamma").collect()] == ["f0.txt"] and index.candidates("alpha").count() == 0
    assert len(os.listdir(tmp_path / "i/layers")) == 2
    index.vacuum(1)
    assert len(os.listdir(tmp_path / "i/layers")) == 1


def test_only_candidates_are_read(spark, tmp_path):
    """Of a table stored by id, other row groups and pages are left out, and lines are split behind the join; of a tree,
    only the candidates' files are opened."""
    texts = [f"plain words {i}\n" * 50 + ("needleword\n" if i in (777, 15000) else "") for i in range(20000)]
    df = spark.createDataFrame([(i, f"f{i}.txt", t) for i, t in enumerate(texts)], "file_id long, path string, content string")
    df.coalesce(1).write.option("parquet.block.size", 1 << 20).option("parquet.page.row.count.limit", 100).parquet(str(tmp_path / "docs"))
    corpus = spark.read.parquet(str(tmp_path / "docs"))
    index = I.TrigramIndex.build(corpus, str(tmp_path / "i"))
    out = Search(corpus, index).literal("needleword").files_only().found()
    assert sorted(r.file_id for r in out.collect()) == [777, 15000]
    plan = out._jdf.queryExecution().executedPlan().executedPlan().plan()  # the final one, of the stage that gives the result
    shown = plan.toString()
    assert "PushedFilters: [Or(" in shown and shown.index("Contains") < shown.index("BroadcastHashJoin") + 200 and shown.count("split(") <= 3
    leaves = [plan.collectLeaves().apply(i) for i in range(plan.collectLeaves().size())]
    read = [x.metrics().get("numOutputRows").get().value() for x in leaves if "parquet" in x.nodeName()]
    assert len(read) == 1 and read[0] < 4000


def test_only_candidate_files_are_opened(spark, tree, tmp_path, monkeypatch):
    index = I.TrigramIndex.build(from_tree(spark, str(tree)), str(tmp_path / "i"))
    plan = Search(from_tree(spark, str(tree)), index).literal("print").found()._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" not in plan and "Python" in plan or "MapInArrow" in plan
    (tree / "a.py").unlink()  # a candidate that is gone is passed over
    assert Search(from_tree(spark, str(tree)), index).literal("print").to_df().collect() == []


def test_ranges_of_ids():
    from gramforge.operators.search import ranges

    assert ranges([1, 2, 3, 10, 11, 50], 3) == [(1, 3), (10, 11), (50, 50)]
    assert ranges([1, 2, 3, 10, 11, 50], 2) == [(1, 11), (50, 50)]
    assert ranges([5], 4) == [(5, 5)] and ranges([1, 2, 3], 64) == [(1, 3)]


def test_bootstrap(spark, tree, monkeypatch):
    def run(*args):
        out = io.StringIO()
        assert cli.main([*args, "-p", str(tree)], spark, out) == 0
        return out.getvalue()

    assert "7 files" in run("--init") and "trigrams" in run("--init", "--yes")
    monkeypatch.setattr("sys.stdin", io.StringIO("n\n"))
    assert run("--init").endswith("kept\n")
    found = json.loads(run("import", "--json-bytes", "--files-only"))
    assert "sub/\u00c3\u00a9.py" in [x["file"] for x in found]


def test_inline_flags(spark):
    df = rows(spark, ["ÉA", "é", "x"])
    hits = lambda p: sorted(r.file_id for r in scan(df, Pattern(p, regex=True)).collect())
    assert hits("(?i)éa") == [0] and hits("(?i:é)") == [0, 1] and hits("é") == [1] and hits("(?i)É(?-i)a") == [] and hits("(?i)É(?-i:A)") == [0]
