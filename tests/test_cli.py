"""The commands, end to end, on a small log file and graph."""

import json

import pytest

from faultline import cli

LOG = 'timestamp,container_name,message\n1.0,shop,place order started\n2.0,shop,"timeout: place order failed, connection refused"\n2.5,shop,charge card done\n30.0,shop,place order error\n'
GRAPH = """digraph shop {
1 [label=METHOD NAME=place_order FULL_NAME=place_order CODE="place order"]
2 [label=CALL NAME=charge_card CODE="charge_card(order)"]
4 [label=CALL NAME=charge_card CODE="charge_card(again)"]
3 [label=METHOD NAME=charge_card FULL_NAME=charge_card CODE="charge card"]
1 -> 2 [label=AST]
1 -> 4 [label=AST]
}"""


@pytest.fixture
def files(tmp_path):
    (tmp_path / "services" / "shop").mkdir(parents=True)
    (tmp_path / "services" / "shop" / "export.dot").write_text(GRAPH)
    (tmp_path / "logs.csv").write_text(LOG)
    return tmp_path


def rows(path):
    return [json.loads(x) for p in sorted(path.glob("part-*")) for x in p.read_text().splitlines()]


def document(path):
    return json.loads("".join(p.read_text() for p in sorted(path.glob("part-*"))))


def test_errors_and_patterns(spark, files, capsys):
    cli.main(["errors", "--csv", f"{files}/logs.csv", "--out", f"{files}/out", "--quiet"], spark)
    found = document(files / "out" / "errors.json")
    assert found["summary"][0]["total_errors"] == len(found["errors"]) >= 1
    assert [r["timestamp"] for r in found["errors"]] == sorted(r["timestamp"] for r in found["errors"])
    assert sum(r["count"] for r in found["errors_by_type"]) == len(found["errors"])
    cli.main(["errors", "--csv", f"{files}/logs.csv", "--out", f"{files}/out", "--formats", "text"], spark)
    text = "".join(p.read_text() for p in sorted((files / "out" / "errors.txt").glob("part-*")))
    assert text.startswith("Errors: ") and "Error #1\n" in text and "Errors: " in capsys.readouterr().out
    cli.main(["patterns", "--json", f"{files}/out/errors.json", "--out", f"{files}/again", "--quiet"], spark)
    assert sum(r["count"] for r in rows(files / "again" / "patterns.json")) == len(found["errors"])
    for strategy in cli.STRATEGIES:
        cli.main(["patterns", "--csv", f"{files}/logs.csv", "--out", f"{files}/out", "--strategy", strategy], spark)
        assert sum(r["count"] for r in rows(files / "out" / "patterns.json")) == len(found["errors"])


def test_graph_commands(spark, files):
    common = ["--csv", f"{files}/logs.csv", "--services-dir", f"{files}/services", "--out", f"{files}/out"]
    for again in ([], [], ["--rebuild-cache"]):  # built, read, built again
        cli.main(["window", *common, *again], spark)
    assert {r["qualified_name"] for r in rows(files / "out" / "nodes.json")} == {"shop::place_order", "shop::charge_card"}
    assert "shop" in (next((files / "out" / "prompt.txt").glob("part-*"))).read_text()
    both = document(files / "out" / "llm_input_flows.json")
    assert sum(len(f["method_sequence"]) for f in both["execution_flows"]) == both["summary"][0]["total_method_calls"] == len(document(files / "out" / "llm_input.json")["method_sequence"])
    assert both["summary"][0]["total_flows"] == len(both["execution_flows"]) and both["lifecycle_events"] == []
    analysis = document(files / "out" / "analysis.json")
    assert analysis["root_cause"] == "shop" and analysis["ranking"][0]["service"] == "shop"
    cli.main(["window", *common, "--model", "test_cli:shout", "--quiet"], spark)
    assert document(files / "out" / "analysis.json")["explanation"] == "LOUD"
    cli.main(["steps", *common], spark)
    context = document(files / "out" / "6_context.json")
    assert context["summary"][0]["total_errors"] == 2 and context["recommendations"] and context["path_totals"][0]["call_paths"] == 1
    assert {r["root"]: r["n_internal"] for r in rows(files / "out" / "4_call_paths.json")}["shop::place_order"] == 1
    cli.main(["trace", *common], spark)
    intra = rows(files / "out" / "2_intra.json")
    assert all(0 <= r["confidence"] <= 1 for r in intra) and rows(files / "out" / "2_backward.json")
    # the syntax tree has the call twice, and no log names it before the first error
    assert [(r["error_name"], r["all_internal_calls"], r["matched_calls"]) for r in sorted(intra, key=lambda r: r["error_name"])] == [("error_0000", ["charge_card"] * 2, 0), ("error_0001", ["charge_card"] * 2, 0)]
    assert rows(files / "out" / "0_summary.json")[0]["analyzed"] == 2


def shout(_):
    return "EXPLANATION: LOUD"
