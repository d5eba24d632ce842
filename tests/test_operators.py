"""Operators on small inputs, against plain versions and stated rules."""

import random
import re

import pytest

from pyspark.sql import functions as F

from faultline.functions import errors as E
from faultline.functions import normalize as N
from faultline.operators import flows as FL
from faultline.operators import graph as G
from faultline.operators import matching as J
from faultline.operators import mining as P
from faultline.operators import rca as R
from faultline.operators import trace as T
from faultline.sources import dot, logs, sinks

MESSAGES = ["no exception", "room service", "error: x", "Timed out", "code 404 here", "x:404", "404\"", "all fine", "", "DEPRECATED api", "WARN: a", "cannot allocate memory", "Access DENIED", "crashed now"]


def test_categories_like_python(spark):
    frame = spark.createDataFrame([(m,) for m in MESSAGES], "message string")
    for row in frame.select("message", E.category(F.col("message")).alias("c")).collect():
        assert row.c == E.python_category(row.message), row.message


def test_error_word_is_an_exception_and_zoom_is_out_of_memory(spark):
    frame = spark.createDataFrame([("error: x",), ("zoom",)], "message string").select(E.category(F.col("message")).alias("c"))
    assert [r.c for r in frame.collect()] == ["EXCEPTION", "OUT_OF_MEMORY"]


def test_traceback_lines(spark):
    text = 'Traceback (most recent call last):\n  File "a.py", line 3, in f\n    x()\nValueError: bad\nafter: Error'
    java = "java.lang.X: boom\n\tat a.B.c(B.java:1)"
    frame = spark.createDataFrame([(text,), (java,)], "m string").select(E.traceback_lines(F.col("m")).alias("t"), E.has_traceback(F.col("m")).alias("h"))
    first, second = frame.collect()
    assert first.t == ["Traceback (most recent call last):", 'File "a.py", line 3, in f', "ValueError: bad"]
    assert second.h and second.t == []


def test_normalized_keeps_iso_times_with_a_t(spark):
    frame = spark.createDataFrame([("At 2024-01-01T10:00:00 and 2024-01-01 10:00:00  x",)], "m string")
    assert frame.select(N.normalized(F.col("m"), "trace")).first()[0] == "at 2024-01-01t10:<NUM>:<NUM> and <TIMESTAMP> x"


def test_leader_clusters_like_a_plain_loop(spark):
    rng = random.Random(3)
    words = "alpha beta gamma delta eps zeta eta theta".split()
    data = [(k, float(k), rng.choice("ab"), "error: " + " ".join(rng.sample(words, 6))) for k in range(60)]
    frame = P.detect(spark.createDataFrame(data, "row_id long, timestamp double, service string, message string"))
    got = sorted((r.pattern_id, r["count"]) for r in P.similar_patterns(frame, 0.7).collect())
    leaders, counts = [], []
    for _, _, service, message in data:
        own = frozenset(message.replace(":", " ").split())
        best, at = 0.0, None
        for i, (s, other) in enumerate(leaders):
            if s == service and (score := len(own & other) / len(own | other)) >= 0.7 and score > best:
                best, at = score, i
        if at is None:
            leaders.append((service, own))
            counts.append(0)
            at = len(leaders) - 1
        counts[at] += 1
    assert got == sorted((f"{s}:EXCEPTION:{i}", counts[i]) for i, (s, _) in enumerate(leaders))


EDGES = [("f::a", "f::b"), ("f::b", "u::c"), ("u::c", "u::d"), ("u::d", "f::a")]


def edges(spark):
    return spark.createDataFrame([(a, b, "CALL") for a, b in EDGES], "caller string, callee string, kind string")


def test_call_graph_classes(spark):
    roots = spark.createDataFrame([("f::a",)], "root string")
    found = {(r.caller, r.callee): r["class"] for r in G.call_graph(roots, edges(spark), 9).collect()}
    assert found == {EDGES[0]: "internal", EDGES[1]: "outbound", EDGES[2]: "external_chain", EDGES[3]: "external_chain"}
    assert G.call_graph(roots, edges(spark), 1).count() == 1 and G.reach(roots, edges(spark), 1).count() == 2


def test_parallel_edges_stay(spark):
    twice = edges(spark).unionAll(edges(spark))
    assert G.call_graph(spark.createDataFrame([("f::a",)], "root string"), twice, 1).count() == 2


def test_flows_join_by_structure(spark):
    data = [(0, 0.0, "f", "a", "f::a", False), (1, 1.0, "f", "x", "f::x", False), (2, 9.0, "f", "b", "f::b", True), (3, 99.0, "f", "z", "f::z", False)]
    calls = spark.createDataFrame(data, "row_id long, timestamp double, service string, method string, qualified_name string, is_error boolean")
    assert [r.flow for r in FL.flows(calls, edges(spark)).orderBy("row_id").collect()] == [0, 0, 0, 1]
    table = FL.flow_table(FL.flows(calls, edges(spark)), edges(spark)).orderBy("flow_id").collect()
    assert table[0].root_methods == ["f::a", "f::x"] and table[0].leaf_methods == ["f::x", "f::b"] and table[0].error_count == 1


def test_sessions_across_time_spans(spark):
    times = [3599.5, 3600.5, 7300.0, 20000.0, 20001.9]
    calls = spark.createDataFrame([(k, t) for k, t in enumerate(times)], "row_id long, timestamp double")
    assert [r.session for r in FL.time_sessions(calls).orderBy("row_id").collect()] == [0, 0, 1, 2, 2]


def test_window_without_error_is_everything(spark):
    calls = spark.createDataFrame([(0, 5.0, False), (1, 90.0, False)], "row_id long, timestamp double, is_error boolean")
    assert FL.error_window(calls).count() == 2


def test_backward_trace_takes_the_latest_evidence(spark):
    links = spark.createDataFrame([("s::m1", "s::m0", "CALL"), ("s::m2", "s::m0", "CALL"), ("s::m3", "s::m2", "CALL")], "caller string, callee string, kind string")
    said = spark.createDataFrame([(0, 91.0, "s", "in m1"), (1, 95.0, "s", "in m2"), (2, 90.0, "s", "in m3"), (3, 100.0, "s", "m1 too late")], "row_id long, timestamp double, service string, message string")
    errors = spark.createDataFrame([(7, "s", "m0", 100.0)], "error_id long, service string, method string, at double")
    row = T.backward_trace(errors, links, said, 10.0).first()
    assert row.execution_path == ["s::m3", "s::m2", "s::m0"] and row.duration == 10.0
    # evidence at exactly the window's length never counts
    assert T.backward_trace(errors, links, said, 5.0).first().execution_path == ["s::m0"]


def test_match_of_equal_scores_takes_the_first(spark):
    methods = spark.createDataFrame([("s", 0, "a", "A", ["abc", "xyz"]), ("s", 1, "b", "B", ["abc", "uvw"])], "service string, rec_idx int, name string, full_name string, tokens array<string>")
    said = spark.createDataFrame([(0, 0.0, "s", "abc"), (1, 0.0, "s", "none of it"), (2, 0.0, "t", "abc")], "row_id long, timestamp double, service string, message string")
    assert [r.method for r in J.match(said, methods).orderBy("row_id").collect()] == ["a", "<unknown>", "<unknown>"]


def test_csv_rules(spark, tmp_path):
    (tmp_path / "a.csv").write_text('timestamp, container_name,message\n1.5,a,"x, ""q""\nline2"\nbad,b,dropped\n2,null,None\n,c,dropped too\n3, z ,"  lead"\n4,,\n1d,svc,no\n')
    got = [tuple(r)[1:] for r in logs.read_csv(spark, str(tmp_path / "a.csv")).orderBy("row_id").collect()]
    assert got == [(1.5, "a", 'x, "q"\nline2'), (2.0, "unknown", ""), (3.0, "z", "  lead"), (4.0, "unknown", "")]


DOT = """digraph g {
 node [shape=box];
 "1" [label="METHOD" NAME="handle" FULL_NAME="s.handle" LINE_NUMBER="3" CODE="say &quot;hello world&quot;"];
 "2" [label="CALL" NAME="save"]; "3" [label="CALL" NAME="info"];
 "4" [label="METHOD" NAME="<init>"];
 "1" -> "2" [label="AST"]; "1" -> "2" [label="AST"]; "2" -> "3" [label="AST"]; "1" -> "4" [label="CFG"];
}"""


def test_dot_to_method_index(spark, tmp_path):
    (tmp_path / "svc").mkdir()
    (tmp_path / "svc" / "export.dot").write_text(DOT)
    nodes, links = dot.read_dot(spark, f"{tmp_path}/*/export.dot")
    assert nodes.count() == 4 and links.count() == 4
    roots = nodes.where("label = 'METHOD'").select("service", F.col("node_id").alias("root"))
    index = J.method_index(nodes, G.subtree(roots, dot.ast_edges(links), ["service"])).collect()
    assert len(index) == 1 and index[0].callee_names == ["save"]
    assert index[0].tokens == ["handle", "hello", "info", "save", "say", "world"] and index[0].call_tokens == ["info", "save"]


def test_other_dialect():
    nodes, _ = dot.parse('digraph { a [label=<METHOD<BR/>x>]; "b c" [label="<CALL> name: \\"go\\""]; a -> "b c" }')
    assert dot._label(nodes["b c"]) == "CALL" and dot._named(nodes["b c"]) == "go"


def test_cache_and_documents(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a")], "x int, y string")
    sinks.save_cache({"t": frame}, str(tmp_path / "cache"), "k1")
    assert sinks.load_cache(spark, str(tmp_path / "cache"), "k1")["t"].collect() == frame.collect()
    assert sinks.load_cache(spark, str(tmp_path / "cache"), "k2") is None and sinks.load_cache(spark, str(tmp_path / "none"), "k") is None
    errors = P.detect(spark.createDataFrame([(0, 1.0, "s", "ValueError: x")], "row_id long, timestamp double, service string, message string"))
    sinks.write_document({"errors": errors}, str(tmp_path / "doc"))
    assert logs.read_errors_json(spark, str(tmp_path / "doc")).first().exception_type == "ValueError"
    assert "EXCEPTION" in sinks.report(errors)


def test_stream(spark, tmp_path):
    from faultline.streaming import live

    data = spark.createDataFrame([(k, float(k // 2), "s", "ValueError: x") for k in range(6)], "row_id long, timestamp double, service string, message string")
    data.write.parquet(str(tmp_path / "in"))
    job = live.activity(live.read_logs(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("seconds").outputMode("complete").trigger(availableNow=True).start()
    job.awaitTermination(60)
    assert sorted(r["count"] for r in spark.table("seconds").collect()) == [2, 2, 2]


def test_structural_flows_of_a_stream(spark, tmp_path):
    from faultline.streaming import live

    schema = "row_id long, timestamp double, service string, qualified_name string"
    batches = [[(0, 0.0, "s", "a"), (1, 1.0, "s", "x"), (5, 0.0, "t", "a")], [(2, 9.0, "s", "b"), (3, 99.0, "s", "z"), (6, 50.0, "t", "c")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        calls = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        job = live.structural_flows(calls, [("a", "b")]).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        job.awaitTermination(120)
    assert {r.row_id: r.flow for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 5: 0, 6: 1}


def test_subtree_of_a_long_chain(spark):
    links = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(120)], "src string, dst string")
    found = G.subtree(spark.createDataFrame([("n0",), ("n118",)], "root string"), links)
    assert {r.root: r["count"] for r in found.groupBy("root").count().collect()} == {"n0": 121, "n118": 3}


def test_flows_like_a_plain_fold(spark):
    rng = random.Random(8)
    names = [f"s::m{k}" for k in range(9)]
    links = [(a, b) for a in names[:6] for b in names[:6] if a != b and rng.random() < 0.3]
    data, t = [], 0.0
    for k in range(300):
        t += rng.choice([0.5, 1.0, 3.0])
        data.append((k, t, "s", "m", rng.choice(names), False))
    near = set(links) | {(b, a) for a, b in links}
    flow, members, last, expected = -1, set(), None, []
    for _, at, _, _, name, _ in data:
        if last is None or (at - last > 2.0 and not any((name, x) in near for x in members)):
            flow, members = flow + 1, set()
        members.add(name)
        last = at
        expected.append(flow)
    calls = spark.createDataFrame(data, "row_id long, timestamp double, service string, method string, qualified_name string, is_error boolean")
    pairs = spark.createDataFrame([(a, b, "CALL") for a, b in links], "caller string, callee string, kind string")
    assert [r.flow for r in FL.flows(calls, pairs).orderBy("row_id").collect()] == expected


def test_arrows_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(FL, "BLOCK", 5)
    names = ["f::a", "f::b", "u::c", "u::d"]
    rng = random.Random(2)
    data = [(k, k * 0.4, rng.choice(names)) for k in range(60)]
    got = {(r.from_row, r.to_row) for r in FL.arrows(spark.createDataFrame(data, "row_id long, timestamp double, qualified_name string"), edges(spark), ahead=4).collect()}
    assert got == {(i, j) for i, a, x in data for j, b, y in data if i < j <= i + 4 and b - a <= 2.0 and (x, y) in EDGES}


def test_backward_trace_takes_the_first_edge_of_ties(spark):
    links = spark.createDataFrame([("s::a", "s::m0", "CALL", 2), ("s::b", "s::m0", "CALL", 1)], "caller string, callee string, kind string, ord long")
    said = spark.createDataFrame([(0, 95.0, "s", "a and b")], "row_id long, timestamp double, service string, message string")
    errors = spark.createDataFrame([(7, "s", "m0", 100.0)], "error_id long, service string, method string, at double")
    row = T.backward_trace(errors, links, said, 10.0).first()
    assert row.execution_path == ["s::b", "s::m0"] and [x.confidence for x in row.path] == [0.5, None]


def test_numbers_in_order(spark):
    from faultline.operators.ordering import numbered

    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x")).repartition(7)
    assert numbered(rows, "n", "x").where("n <> x").count() == 0


def test_checkpoints_are_shared(spark):
    from faultline.session import checkpoint_dir

    class Cluster:
        class sparkContext:
            master = "spark://somewhere:7077"
            getConf = staticmethod(dict)

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError):
        checkpoint_dir(Cluster)


def test_answer_of_a_model():
    found = R.parse_ranking("RANKING:\n1. [cart] - [HIGH] - first to fail\n2. pay-ment - LOW - later\n\nROOT_CAUSE: [cart]\nEXPLANATION: it failed first.")
    assert found["root_cause"] == "cart" and found["explanation"] == "it failed first."
    assert [(r["service"], r["confidence"]) for r in found["ranking"]] == [("cart", "HIGH"), ("pay-ment", "LOW")]
    assert R.parse_ranking("no idea") == {"ranking": [], "root_cause": "", "explanation": ""}


def test_flow_connections_like_all_pairs(spark, monkeypatch):
    """Equal times, equal rows and rows without a method, by short stretches; few rows in, so before all pairs came from one task."""
    monkeypatch.setattr(FL, "STRETCH", 4)
    monkeypatch.setattr(FL, "SHARES", 3)
    rng = random.Random(8)
    names = ["a::f", "a::g", "b::f", "b::h"]
    calls = [(rng.randrange(3), k, float(rng.randrange(20)), rng.choice(names)) for k in range(80)]
    calls += calls[:5] + [(1, 90, 3.0, None), (None, 91, 3.0, "a::f"), (0, 92, None, "a::f"), (0, 93, float("nan"), "a::g")]
    edges = [("a::f", "a::g", "CALL"), ("a::f", "b::f", "CALL"), ("b::f", "a::f", "CALL"), ("a::g", "a::g", "CALL"), ("b::h", "a::f", "RETURN")]
    linked = {p for c, d, kind in edges if kind == "CALL" for p in ((c, d), (d, c))}
    key = lambda r: (r[2] is not None, r[2] != r[2], r[2] if r[2] is not None and r[2] == r[2] else 0.0, r[1])
    wanted = sorted((a[0], a[1], b[1], a[3][0] != b[3][0]) for a in calls for b in calls if a[0] is not None and a[0] == b[0] and (a[3], b[3]) in linked and key(a) < key(b))
    got = FL.flow_connections(spark.createDataFrame(calls, "flow long, row_id long, timestamp double, qualified_name string"), spark.createDataFrame(edges, "caller string, callee string, kind string"))
    assert sorted(tuple(r) for r in got.collect()) == wanted and wanted
    assert got.rdd.getNumPartitions() >= FL.TASKS * spark.sparkContext.defaultParallelism


def test_flow_connections_makes_pairs_last(spark, monkeypatch):
    """Both loops that make pairs are compiled into the stage that counts them, and no array is filtered for each call; blocks in small pieces."""
    monkeypatch.setattr(FL, "STRETCH", 16)
    monkeypatch.setattr(FL, "PIECE", 5)
    calls = [(k % 2, k, float(k // 3), "a::f" if k % 3 else "b::g") for k in range(120)]
    got = FL.flow_connections(spark.createDataFrame(calls, "flow long, row_id long, timestamp double, qualified_name string"), spark.createDataFrame([("a::f", "b::g", "CALL"), ("a::f", "a::f", "CALL")], "caller string, callee string, kind string"))
    wanted = sorted((a[0], a[1], b[1], a[3] != b[3]) for a in calls for b in calls if a[0] == b[0] and "a::f" in (a[3], b[3]) and a[1] < b[1])
    assert sorted(tuple(r) for r in got.collect()) == wanted
    counted = got.groupBy().count()
    assert counted.collect()[0][0] == len(wanted)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    stage = re.search(r"\*\((\d+)\) HashAggregate\(keys=\[\], functions=\[partial_count", plan).group(1)
    assert plan.count(f"*({stage}) Generate explode") == 2 and "filter(" not in plan
