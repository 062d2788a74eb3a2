"""Steps that have to hold at any size: tokens from bytes, tasks of a bounded size, and the results that they keep."""

import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmatch import partitions
from quillmatch.functions import names as N
from quillmatch.functions import tokenbytes as B
from quillmatch.operators import graph
from quillmatch.operators import tokens as K
from quillmatch.plans import ORACLE, QUERIES, match_queries
from quillmatch.sources import code as C

from .test_queries import normal

PATTERN = re.compile(
    rb"""//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)|"[^"\\]*(?:\\.[^"\\]*)*"?|'[^'\\]*(?:\\.[^'\\]*)*'?|[0-9][A-Za-z0-9_.]*|[_A-Za-z][0-9A-Za-z_]*"""
    rb"""|::|\?\.|->|=>|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|[^\t\n\x0B\f\r ]"""
)
ALIASES = {k.encode(): v.encode() for k, v in K.ALIASES.items()}
PIECES = ["a", "B", "_", "_x", "1", "2.5", ".", "..", "i8", "I_8", "str", "arrow", "ArrayVec", '"', "'", "\\", '\\"', "/", "//", "/*", "*/", "\n", " ", "\t", "\r", ";", "@", "#", "=", ">", "-", "<", "!", ":", "::", "?", "&", "|", "+", "*", "%", "é", "Å", "…", "漢", "😀", "\x85", "\xa0"]


def plain(text: str) -> list[str]:
    out = []
    for m in PATTERN.finditer(text.encode()):
        t = m[0].decode("ISO-8859-1")
        if t.startswith(("//", "/*")) or t in ";@#":
            continue
        if t[0] in "\"'":
            t = "str"
        elif t[0] in "0123456789":
            t = f"num:{t}"
        elif re.match("[A-Za-z_]", t):
            t = t.lower().replace("_", "")
            t = K.ALIASES.get(t, t)
        else:
            t = {"::": ".", "?.": ".", "->": "arrow", "=>": "arrow"}.get(t, t)
        out += [t] * (t != "")
    return out


def odd_texts(n: int) -> list[str]:
    rng = np.random.default_rng(3)
    return ["".join(rng.choice(PIECES, rng.integers(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("size", [1 << 20, 200])
def test_tokens_from_bytes(size):
    texts = odd_texts(4000)
    of, wanted = {}, [plain(t) for t in texts]
    for i, j, t in B.each_chunk(pa.array(texts), ALIASES, size):
        for d in range(i, j):
            span = range(t.ptr[d - i], t.ptr[d - i + 1])
            assert [t.term(k, ALIASES) for k in span] == wanted[d], texts[d]
            for k, w in zip(span, wanted[d]):
                assert of.setdefault(w, t.hash[k]) == t.hash[k]
    assert len(set(of.values())) == len(of)  # a hash of its own for each term


def runs(text: str) -> set[tuple]:
    w = plain(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.mark.parametrize("most", [None, 10])  # as known hashes, and by a join
def test_kgrams_from_bytes(spark, most):
    texts = odd_texts(400) + ["one two three four five six", None, "one two three four five"]
    items = ["zero one two three four five six seven", "a few", *(t for t in texts[:40] if len(plain(t)) > 6)]
    rows = K.kgram_rows(spark.createDataFrame(list(enumerate(items)), "item long, text string"), "item").distinct()
    known = K.known_kgrams(rows, most)
    assert (known is None) == (most == 10)
    docs = spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)], "doc long, text string")  # two texts of each id
    found = K.kgram_rows(docs, "doc", known).distinct()
    got = {(r["doc"], r["item"]): r["n"] for r in found.join(rows, "g").groupBy("doc", "item").agg(F.count("*").alias("n")).collect()}
    of = {d: set().union(*(runs(t or "") for t in texts[2 * d : 2 * d + 2])) for d in range((len(texts) + 1) // 2)}
    want = {(d, i): len(g & runs(x)) for d, g in of.items() for i, x in enumerate(items)}
    assert got == {k: n for k, n in want.items() if n}
    if known is not None:
        assert found.count() == sum(len(g & set().union(*map(runs, items))) for g in of.values())  # others don't leave the workers


def test_frequencies_from_bytes(spark, monkeypatch):
    texts = [*odd_texts(300), "b b a", None, "a c", "_1 1"]
    keys = [None, 7, 7, *range(10, 10 + len(texts) - 5), 7, 8]  # a key of three texts, and a text without one
    units = spark.createDataFrame(list(zip(keys, texts)), "doc_id long, text string").repartition(3)
    n, docs = {}, {}
    for key, text in zip(keys, texts):
        for w in plain(text or ""):
            n[w] = n.get(w, 0) + 1
            docs.setdefault(w, set()).update([key] if key is not None else [])
    want = {w: (n[w], len(docs[w])) for w in n}
    for gathered, repeated in ((1 << 18, 1 << 20), (5, 1 << 20), (5, 0)):  # all at the end, as they come, and by key
        monkeypatch.setattr(K, "GATHERED", gathered)
        monkeypatch.setattr(K, "REPEATED", repeated)
        assert {r["term"]: (r["n"], r["docs"]) for r in K.frequencies(units, "doc_id").collect()} == want
    monkeypatch.setattr(K, "REPEATED", 1 << 20)
    plan = K.frequencies(units.filter("doc_id > 8"), "doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "regexp_extract_all" not in plan  # no rows of key and term are shuffled


GRAPH = "dependency_degrees ranked_by_dependents leaf_units root_units top_importers corpus_summary symbol_duplicates_ranked priority_ladder missing_by_dependents next_actions status_order task_init task_assign".split()


@pytest.fixture
def odd_parts(spark, tmp_path):
    """Parts without a name, a type or a key, imports of and by what is no part, and on request two parts of one key."""

    def make(shared: bool) -> str:
        data = tmp_path / str(shared)
        part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").filter("p_partkey < 120")
        blank = lambda c, k: F.when(F.col("p_partkey") == k, None).otherwise(F.col(c)).alias(c)
        part = part.select(*(blank(c, {"p_name": 5, "p_type": 6, "p_partkey": 7}[c]) if c in ("p_name", "p_type", "p_partkey") else c for c in part.columns))
        if shared:
            part = part.unionByName(part.filter("p_partkey IN (2, 3)").withColumn("p_name", F.when(F.col("p_partkey") == 2, "other name").otherwise(F.col("p_name"))))
        part.write.parquet(f"{data}/part.parquet")
        line = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
        blank = lambda c, k: F.when(F.col("l_orderkey") % 97 == k, None).otherwise(F.col(c)).alias(c)
        line.select(*(blank(c, {"l_partkey": 1, "l_suppkey": 2}[c]) if c in ("l_partkey", "l_suppkey") else c for c in line.columns)).write.parquet(f"{data}/lineitem.parquet")
        spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(f"{data}/events.parquet")
        return str(data)

    return make


@pytest.mark.parametrize("shared", [False, True])
def test_graph_of_odd_parts(spark, odd_parts, shared, monkeypatch):
    data, duck = odd_parts(shared), duckdb.connect()
    for t in ("part", "lineitem", "events"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet/*.parquet'")
    monkeypatch.setattr(graph, "ITEMS", 1 << 20 if shared else 3)  # beyond the bound, a join
    for name in GRAPH:
        if shared and name in ("task_assign", "status_order"):
            continue  # ties of equal rows
        df = QUERIES[name](spark, data)
        columns = sorted(df.columns)
        cursor = duck.execute(ORACLE[name])
        order = [[d[0] for d in cursor.description].index(c) for c in columns]
        assert sorted(tuple(normal(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(normal(r[i]) for i in order) for r in cursor.fetchall()), name


def test_graph_moves_ids_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(partitions, "ROWS", 500)
    plan = QUERIES["dependency_degrees"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert int(re.search(r"hashpartitioning\(importer#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)[1]) >= 6000 // 500
    texts = re.compile(r"Exchange hashpartitioning\((importer|target)[^\n]*string")
    assert not texts.search(plan) and not re.search(r"hashpartitioning\(l_partkey#\d+L, l_suppkey", plan)  # as before: pairs, then pairs with names


COVERAGE = ["bag_coverage", "function_name_coverage", "type_coverage", "stub_mismatch"]


@pytest.mark.parametrize("rows", [1 << 18, 300])
def test_coverage_of_odd_rows(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(partitions, "ROWS", rows)
    line = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").filter("l_orderkey < 400")
    hot = line.withColumn("l_orderkey", F.when(F.col("l_orderkey") < 100, 1).otherwise(F.col("l_orderkey")))  # many rows of one pair
    blank = lambda c, k: F.when(F.hash("l_partkey", "l_suppkey", "l_extendedprice") % 11 == k, None).otherwise(F.col(c)).alias(c)
    odd = {"l_orderkey": 1, "l_returnflag": 2, "l_linestatus": 3, "l_quantity": 4}
    hot.select(*(blank(c, odd[c]) if c in odd else c for c in hot.columns)).write.parquet(f"{tmp_path}/lineitem.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    for name in COVERAGE:
        df = QUERIES[name](spark, str(tmp_path))
        plan = df._jdf.queryExecution().executedPlan().toString()
        columns = sorted(df.columns)
        cursor = duck.execute(ORACLE[name])
        order = [[d[0] for d in cursor.description].index(c) for c in columns]
        assert sorted(tuple(normal(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(normal(r[i]) for i in order) for r in cursor.fetchall()), name
        assert len(re.findall(r"\n[^\n]*Exchange hash", plan)) == 1 and "Join" not in plan  # one shuffle, in as many parts as the rows need
        assert int(re.search(r"hashpartitioning\(pair#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)[1]) >= line.filter("l_quantity < 9" if name == "stub_mismatch" else "true").count() // rows


def test_parsers_hand_on_rows_in_parts(spark):
    class Files:  # in place of a table: gives what would run in a worker
        sparkSession = spark  # noqa: N815

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    page = "<html><body>" + "<p>a<b>c</b></p>" * 500 + "</body></html>"
    texts = pa.RecordBatch.from_pydict({"unit": [str(k) for k in range(100)], "lang": ["html"] * 100, "text": [page] * 99 + [None]})
    sizes = [b.num_rows for b in C.parse_nodes(Files(), {})(iter([texts]))]
    assert sum(sizes) == 99 * 1003 and max(sizes) < C.PART_ROWS + 1003
    rust = pa.RecordBatch.from_pydict({"unit": ["a"] * 50, "lang": ["rust"] * 50, "text": ["fn a() { b(c); }\n" * 400] * 50})
    assert max(b.num_rows for b in C.symbols(Files())(iter([rust]))) < C.PART_ROWS + 400


def test_units_are_matched_where_they_are_spread(spark, monkeypatch):
    monkeypatch.setattr(partitions, "ROWS", 30)  # 200 parts, in a file that one task reads
    src, tgt = match_queries.corpora(spark, "/root/testdata/sf0.001")
    assert src.rdd.getNumPartitions() >= 200 // 30 and tgt.rdd.getNumPartitions() >= 200 // 30
    plan = spark.range(1).select(N.match_keys(F.col("id").cast("string")), N.base_key(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan  # an array of parts was walked for each key, and split anew for each part


def test_match_key_by_parts(spark):
    pieces = ["a", "B_c", "-", ".", "..", "/", "./", "src/", "/src/", ".rs", "é", "\n", "x.y"]
    rng = np.random.default_rng(5)
    paths = ["", *("".join(rng.choice(pieces, rng.integers(0, 8))) for _ in range(400))]
    package = lambda p: "".join(c.lower() if "A" <= c <= "Z" else c for c in p if c not in "_-")

    def plain(path: str) -> str:
        *dirs, last = re.sub(r"^(\./)+", "", path).split("/")
        return "/".join(package(d) for d in (*dirs, re.sub(r"(?<=.)\.[^.]*$", "", last)))

    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", N.match_key(F.col("p")).alias("k"), N.base_key(F.col("p")).alias("b"))
    assert [(r["k"], r["b"]) for r in df.collect()] == [(plain(p), plain(p).split("/")[-1]) for p in paths]
