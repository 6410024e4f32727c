import io
import zipfile

import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packwright.operators import chunks, fuse, graph, lexical, maintain
from packwright.plans import settings
from packwright.sources import files, sinks
from packwright.streaming import sessions


def test_python_and_braced_chunks(spark):
    py = "import os\n\n@x\ndef a(b):\n    return os.c(b)\n\nclass D:\n    def m(self):\n        pass\n"
    js = 'function f(a) {\n  if (a) { return "}"; }\n  // }\n}\nclass G {\n}\n'
    rows = spark.createDataFrame([("a.py", py, "python"), ("b.js", js, "javascript"), ("c.py", "def broken(:\n  x", "python"), ("d.py", None, "python")], "path string, content string, language string")
    got = {(r["path"], r["symbols_defined"][0]): (r["start_line"], r["end_line"]) for r in chunks.chunk_code(rows).collect()}
    assert got == {("a.py", "a"): (3, 5), ("a.py", "D"): (7, 9), ("b.js", "f"): (1, 4), ("b.js", "G"): (5, 6), ("c.py", "broken"): (1, 2)}


def test_split_large_keeps_text(spark):
    text = "\n".join("x" * 40 + f" {i}" for i in range(200))
    rows = spark.createDataFrame([("a.py", 1, 200, text, ["f"], ["g"], "python")], chunks.CHUNK)
    got = chunks.split_large(rows).orderBy("start_line").collect()
    assert "\n".join(r["content"] for r in got) == text and [bool(r["symbols_defined"]) for r in got] == [True] + [False] * (len(got) - 1)
    assert all(len("".join(r["content"].split())) <= chunks.LARGE for r in got)


def test_compress(spark):
    src = 'def f(a):\n    """Say."""\n    return a\nx = 1'
    rows = spark.createDataFrame([("a.py", src, 0.9), ("b.py", src, 0.4), ("c.py", src, 0.1), ("d.py", src, None), ("e.txt", src, 0.1)], "path string, content string, score double")
    got = {r["path"]: r["content"] for r in chunks.compress(rows).collect()}
    assert got["a.py"] == got["d.py"] == got["e.txt"] == src
    assert got["b.py"] == "def f(a):\n    # ... implementation\nx = 1" and '"""Say."""' in got["c.py"] and "return" not in got["c.py"]


def test_compress_takes_any_name(spark):
    """A class is one in Python even if its name starts with a digit; words of other languages open nothing there."""
    src = "def 1x()\nclass 017_\n  body\n\n\tbody\nfunction f stays"
    rows = spark.createDataFrame([("a.py", src, 0.4)], "path string, content string, score double")
    assert chunks.compress(rows).first()["content"] == "def 1x()\n    # ... implementation\nclass 017_\n    # ... implementation\nfunction f stays"


def test_summary_line_trims_blanks_only(spark):
    from packwright.functions import text as X

    rows = spark.createDataFrame([("0990 a",), ("  # b\n  \n 11 c 1 ",), ("// d\n#\n",)], "t string")
    assert [r[0] for r in rows.select(X.summary_line(F.col("t"))).collect()] == ["0990 a", "11 c 1", ""]


def test_pagerank_star_and_cycle(spark):
    star = spark.createDataFrame([("main", "helper"), ("utils", "helper")], "src string, dst string")
    ranks = {r["node"]: r["rank"] for r in graph.pagerank(star, 30).collect()}
    assert max(ranks, key=ranks.get) == "helper" and abs(sum(ranks.values()) - 1) < 1e-9
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    assert all(abs(r["rank"] - 1 / 3) < 1e-9 for r in graph.pagerank(ring, 5).collect())


@pytest.mark.parametrize("one_task", [0, 10**6])
@pytest.mark.parametrize("spread", [True, False])
def test_pagerank_settles(spark, one_task, spread):
    """Against the linear system, in one task and by joins; a repeated edge counts once."""
    import numpy as np

    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("e", "d"), ("a", "b"), ("f", "f")]
    names = sorted({x for e in edges for x in e})
    move = np.zeros((len(names), len(names)))
    for s, d in set(edges):
        move[names.index(d), names.index(s)] = 1 / len({y for x, y in edges if x == s})
    if spread:
        move[:, move.sum(axis=0) == 0] = 1 / len(names)
    want = np.linalg.solve(np.eye(len(names)) - 0.85 * move, np.full(len(names), 0.15 / len(names)))
    got = {r["node"]: r["rank"] for r in graph.pagerank(spark.createDataFrame(edges, "src string, dst string"), 100, tolerance=1e-4, spread=spread, one_task=one_task).collect()}
    assert all(abs(got[n] - w / want.sum()) < 1e-3 for n, w in zip(names, want, strict=True)) and abs(sum(got.values()) - 1) < 1e-9
    none = spark.createDataFrame([], "src string, dst string")
    assert graph.pagerank(none, one_task=one_task).count() == 0


def test_call_path(spark):
    nodes = spark.createDataFrame([(f"f{k}#{n}", "function", n) for k, n in enumerate("abcd")] + [(f"f{k}", "file", f"f{k}") for k in range(4)], "id string, kind string, name string")
    edges = spark.createDataFrame([(f"f{k}", "CONTAINS", f"f{k}#{n}") for k, n in enumerate("abcd")] + [("f0", "CALLS", "f1#b"), ("f1", "CALLS", "f2#c"), ("f1", "CALLS", "f0#a")], "src string, relation string, dst string")
    assert graph.call_path(edges, nodes, "a", "c") == ["a", "b", "c"] and graph.call_path(edges, nodes, "a", "a") == ["a"]
    assert graph.call_path(edges, nodes, "a", "d") == [] and graph.call_path(edges, nodes, "a", "c", 1) == []


def test_index_is_made_anew_when_stale(spark, tmp_path):
    from packwright.operators import index

    files_ = spark.createDataFrame([(1, "a.py", "def loadUser(x): pass"), (2, "b.py", None), (3, "c.py", "user user_name")], "id int, path string, text string")
    folder = f"file://{tmp_path}/index"
    first, made = index.load_fresh(files_, folder)
    assert made and index.load_fresh(files_, folder)[1] is False
    assert {r["path"] for r in index.bm25(first, ["user"]).collect()} == {"a.py", "c.py"}
    more = files_.unionByName(spark.createDataFrame([(4, "d.py", "user")], files_.schema))
    assert [tuple(r) for r in index.changes(first, more).collect()] == [("d.py", "added")]
    again, made = index.load_fresh(more, folder)
    assert made and again.manifest.count() == 4
    (tmp_path / "index/totals").rename(tmp_path / "index/lost")  # a broken index is made anew, too
    assert index.load_fresh(more, folder)[0].totals.first()["n"] == 4


ODD = ["", "a", "getHTTPResponse2Code snake_case __init__ _x 9lives 12ab_34 x1 A1B2 99", "é日loadUser ABCDef\x00tail0 İstanbul", "aB", "Bc", "1", "2x", "userUser user_USER " * 9, "_", "x" * 40 + "Y" * 40]


@pytest.mark.parametrize("step", [1 << 20, 1, 7])
def test_terms_by_arrays_are_those_by_expressions(spark, monkeypatch, step):
    """Over whole batches, slices of them and steps that end within a text."""
    import pyarrow as pa

    from packwright.functions import text as X
    from packwright.functions import words

    monkeypatch.setattr(words, "STEP", step)
    want = [set(r[0]) for r in spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "k int, t string").orderBy("k").select(X.identifier_parts(F.col("t"))).collect()]
    for lo in (0, 3):
        rows, terms = words.terms_of(pa.array(ODD).slice(lo))
        got = [set() for _ in ODD[lo:]]
        for k, t in zip(rows.tolist(), terms.to_pylist(), strict=True):
            got[k].add(t)
        assert got == want[lo:]


def test_postings_are_runs_by_term(spark, tmp_path):
    """A row a term and run, whatever its number of files; equal ids and texts without terms stay; both ways of scoring agree."""
    from packwright.operators import index

    rows = [(k // 2, f"{k}.py", f"user load{k % 3}" if k % 5 else None) for k in range(200)]
    files_ = spark.createDataFrame(rows, "id int, path string, text string").repartition(3)
    index.save(files_, f"file://{tmp_path}/index")
    held, runs = index.load(spark, f"file://{tmp_path}/index"), spark.read.parquet(f"file://{tmp_path}/index/postings")
    assert runs.where("term is not null").count() == runs.select("run", "term").where("term is not null").distinct().count() <= 5 * runs.select("run").distinct().count()
    want = sorted((i, p, len(t.split()), x) if t else (i, p, 1, "") for i, p, t in rows for x in (t or " ").split(" ")[: 2 if t else 1])
    assert sorted(map(tuple, held.postings.collect())) == [w for w in want if w]
    assert held.totals.first()["n"] == 200 and abs(held.totals.first()["avgdl"] - len(want) / 200) < 1e-12
    ours = {r["id"]: r["s"] for r in index.bm25(held, ["load1", "user"]).groupBy("id").agg(F.sum("score").alias("s")).collect()}
    theirs = {r["id"]: r["score"] for r in lexical.bm25(files_.select("id", "text"), ["load1", "user"]).collect()}
    assert ours.keys() == theirs.keys() and all(abs(ours[k] - theirs[k]) < 1e-9 for k in ours)


def test_index_reads_texts_once(spark, tmp_path):
    """One pass over the files leaves the hashes of the texts that it split; a null text has the hash of an empty one."""
    import hashlib

    from packwright.operators import index

    rows = [(k, f"{k}.py", f"user {k} é" if k % 5 else None) for k in range(40)]
    seen = spark.sparkContext.accumulator(0)

    def read(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    files_ = spark.createDataFrame(rows, "id int, path string, text string").repartition(3).mapInArrow(read, "id int, path string, text string")
    index.save(files_, f"file://{tmp_path}/index")
    assert seen.value == 40
    assert {tuple(r) for r in index.load(spark, f"file://{tmp_path}/index").manifest.collect()} == {(p, hashlib.sha256((t or "").encode()).hexdigest()) for _, p, t in rows}


def test_bm25_splits_texts_once(spark):
    """What it plans on reads only what its one pass over the texts has left."""
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    assert "documents.parquet" not in lexical.bm25(texts, ["erin"])._jdf.queryExecution().optimizedPlan().toString() + " ".join(lexical.bm25(texts, ["erin"]).inputFiles())


def test_retrieve_adds_named_files_and_reranks(spark):
    from packwright.functions import udfs
    from packwright.operators import retrieval

    semantic = spark.createDataFrame([("a.py", 0.9), ("tests/b.py", 0.8), ("c.py", 0.1)], "path string, score double")
    structural = spark.createDataFrame([("c.py", 0.5)], "path string, score double")
    held = spark.createDataFrame([("a.py", ["x"]), ("tests/b.py", []), ("c.py", ["y"]), ("d.py", ["loaduser"]), ("e.py", ["z"])], "path string, symbols array<string>")
    asked = retrieval.Query(tokens=("loaduser",), kind="symbol", rules=("c.py",))
    got = [r["path"] for r in retrieval.retrieve(semantic, structural, held, asked, 10).collect()]
    assert got[0] == "c.py" and set(got) == {"a.py", "tests/b.py", "c.py", "d.py"}
    texts = held.select("path", F.col("path").alias("text"))
    by_length = udfs.reranker("q", texts, lambda: lambda q, t: [len(x) for x in t], "length")
    assert retrieval.retrieve(semantic, structural, held, asked, 10, by_length).first()["path"] == "tests/b.py"


def test_query_and_pack(spark):
    from packwright.operators import retrieval

    scores = spark.createDataFrame([("a.py", 0.9), ("b.py", 0.8), ("c.py", 0.2)], "path string, score double")
    held = spark.createDataFrame([("a.py", "password = hunter22", 4), ("b.py", "same", 1), ("c.py", "same", 1), ("g.py", "graph", 1)], "path string, content string, tokens long")
    chosen = retrieval.choose(scores, held, 100, graph_files=spark.createDataFrame([("g.py",), ("a.py",)], "path string"), compress=True)
    pack = retrieval.query_and_pack(chosen, "md", {"query": "q"})
    assert pack.paths == ["a.py", "b.py", "g.py", "c.py"] and pack.tokens == 7 and "hunter22" not in pack.text and "[DEDUPLICATED: b.py" in pack.text
    assert "REDACTED" in retrieval.query_and_pack(chosen, "xml", {}).text
    with pytest.raises(ValueError):
        retrieval.query_and_pack(retrieval.choose(scores, held, 1), "xml", {})


def test_plugged_in_functions(spark):
    import numpy as np

    from packwright.functions import udfs

    files_ = spark.createDataFrame([(1, "a b", "h1"), (2, None, "h2"), (3, "a b", "h1")], "id int, text string, sha256 string")
    cache = spark.createDataFrame([("h2", [7.0])], "sha256 string, vector array<float>")
    embed = udfs.embedder(lambda: lambda texts: np.array([[len(t)] for t in texts]), "length")
    assert {r["id"]: list(r["vector"]) for r in udfs.embedded(files_, cache, embed).collect()} == {1: [3.0], 2: [7.0], 3: [3.0]}
    count = udfs.token_counter(lambda: lambda t: len(t.split()), "words")
    assert [r[0] for r in files_.select(count(F.col("text"))).collect()] == [2, 0, 2]
    assert abs(np.linalg.norm(files_.limit(1).select(udfs.embedder()(F.col("text"))).first()[0]) - 1) < 1e-6


def test_arrow_functions_and_scanner(spark):
    js = "const f = (a, b) => {\n  return '}' + `}\n}` // }\n};\nlet g = x => x;\nclass A {\n  m() { /* } */ }\n}\n"
    rows = spark.createDataFrame([("a.js", js, "javascript")], "path string, content string, language string")
    got = {r["symbols_defined"][0]: (r["start_line"], r["end_line"]) for r in chunks.chunk_code(rows).collect()}
    assert got == {"f": (1, 4), "g": (5, 5), "A": (6, 8)}
    parts = chunks.split_by(chunks.chunk_code(rows), lambda content, language: [(1, 1), (2, content.count("\n") + 1)] if "\n" in content else [(1, 1)])
    assert sorted((r["start_line"], r["end_line"], len(r["symbols_defined"])) for r in parts.collect()) == [(1, 1, 1), (2, 4, 0), (5, 5, 1), (6, 6, 1), (7, 8, 0)]


def test_module_resolution_takes_longest(spark):
    refs = spark.createDataFrame([("x.py", "pkg.util.run"), ("x.py", "nothing")], "path string, ref string")
    mods = spark.createDataFrame([("src/run.py",), ("src/util/run.py",)], "file string")
    assert [tuple(r) for r in graph.resolve_modules(refs, mods).collect()] == [("x.py", "pkg.util.run", "src/util/run.py")]


def test_bm25_prefers_rare_terms(spark):
    rows = spark.createDataFrame([("auth", "login password token"), ("session", "token user"), ("db", "query table"), ("none", None), ("utils", "format date")], "id string, text string")
    got = [r["id"] for r in lexical.top_k(lexical.bm25(rows.fillna(""), ["login", "token"]), 2).collect()]
    assert got == ["auth", "session"]


@given(st.lists(st.floats(0, 1), min_size=1, max_size=20))
def test_budget_rule_is_a_prefix(sizes):
    total, n = 0, 0
    for s in sizes:
        if total + s > 5:
            break
        total, n = total + s, n + 1
    running = pd.Series(sizes).cumsum()
    assert (running <= 5 + 1e-12).sum() >= n


def test_keyword_matches():
    assert fuse.keyword_matches("authentication", "authorize") is False and fuse.keyword_matches("config", "configuration")


def test_scan_filter_and_pack(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("def a(): pass\n")
    (tmp_path / "src/b.py").write_bytes(b"x = '\xe9'\n")
    (tmp_path / "c.md").write_text("# T\nhi <b>\n")
    found = files.scan_files(spark, f"file://{tmp_path}")
    assert {r["path"]: r["content"] for r in found.collect()} == {"src/a.py": "def a(): pass\n", "src/b.py": "x = 'é'\n", "c.md": "# T\nhi <b>\n"}
    assert [r["path"] for r in files.filter_globs(found, ["**/*.py"], files.ignore_patterns("# no\nsrc/b*\n")).collect()] == ["src/a.py"]
    rows = found.select("path", F.lit(0.5).alias("score"), F.lit(1).alias("tokens"), F.lit("Dependency").alias("reason"), "content")
    assert "hi &lt;b&gt;" in sinks.pack_xml(rows, {"query": "q"})
    with zipfile.ZipFile(io.BytesIO(sinks.pack_zip(rows, "q"))) as z:
        assert sorted(z.namelist()) == ["REVIEW_CONTEXT.md", "files/c.md", "files/src/a.py", "files/src/b.py"]
    assert sinks.pack_yaml(rows, {"query": "q"}).startswith("context:\n")


def test_set_equality_and_upsert(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    got = maintain.upsert(a, b, ["k"])
    assert maintain.same_sets(got, spark.createDataFrame([(3, "w"), (2, "z"), (1, "x")], "k int, v string"))


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = sessions.rate_limit_stream(stream).writeStream.format("memory").queryName("limited").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    both = spark.table("limited").join(sessions.rate_limit(events).withColumnRenamed("allowed", "batch"), ["user_id", "event_id"])
    assert both.count() == events.count() and both.where("allowed != batch").count() == 0


def test_settings_fall_back_field_by_field():
    got = settings.settings_from({"format": "pdf", "token_budget": 5, "semantic_weight": 1.5, "include_patterns": ["*.py"], "unknown": 1, "include_tests": 1})
    assert (got.format, got.token_budget, got.semantic_weight, got.include_patterns, got.include_tests) == ("zip", 5, 0.6, ("*.py",), False)
    assert settings.settings_from(None) == settings.settings_from([1]) == settings.Settings()


def test_limits_paths_and_intents():
    assert settings.checked_limit(50) == 50
    for bad in (0, 51):
        with pytest.raises(ValueError):
            settings.checked_limit(bad)
    assert settings.inside("/a/b", "c/../d.py") == "/a/b/d.py" and settings.inside("/a/b", ".") == "/a/b"
    for bad in ("../bc/x", "/etc/passwd"):
        with pytest.raises(ValueError):
            settings.inside("/a/b", bad)
    assert settings.graph_intent("who calls auth.login?") == ("callers_of", "auth.login")
    assert settings.graph_intent("what breaks on change of parse_config") == ("impact_of", "parse_config")
    assert settings.graph_intent("find callers of foo") == ("callers_of", "foo") and settings.graph_intent("who imports utils") == ("impact_of", "utils")
    assert settings.graph_intent("refactor db.py") == ("impact_of", "db.py") and settings.graph_intent("session handling") == ("none", "")


def test_walk_leaves_out_ignored_and_hidden(spark, tmp_path):
    for name in ("a.py", "build/b.py", "lib/build/c.py", ".cache/d.py", "lib/e.min.js", "lib/f.js", "lib/__init__.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / ".gitignore").write_text("# made\nbuild/\n*.min.js\n!keep.py\n")
    assert {r["path"] for r in files.walk(spark, str(tmp_path)).collect()} == {"a.py", "lib/f.js", "lib/__init__.py"}
    assert ".cache/d.py" in {r["path"] for r in files.walk(spark, "file://" + str(tmp_path), hidden=True).collect()}
    (tmp_path / ".gitignore").unlink()
    got = files.walk(spark, str(tmp_path)).collect()
    assert len(got) == 6 and {(r["content"], r["size"]) for r in got} == {("x", 1)}


def test_agent_lines_of_nothing(spark):
    assert [r["line"] for r in sinks.agent_lines(spark.createDataFrame([], "path string"), {"path": F.col("path")}).collect()] == ['{"type":"meta","total":0}']
