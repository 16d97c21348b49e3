import json
import random
import re
from collections import Counter

from glyphmill.llm import tool_calls as T
from glyphmill.llm.queries import op9_tool_calls

SCHEMAS = [
    ("f", "x", "integer", True), ("f", "y", "string", False), ("f", "z", "number", False),
    ("g", "a", "object", True), ("g", "l", "array", False), ("g", "b", "boolean", False), (None, "x", "string", True),
]


def linked(spark, calls, results):
    calls = spark.createDataFrame(calls, "call_id string, conv_id bigint, position bigint, tool string, arguments string, level int")
    results = spark.createDataFrame(results, "call_id string, position bigint, content string, status string")
    schemas = spark.createDataFrame(SCHEMAS, "tool string, field string, type string, required boolean")
    return {r.call_id: r for r in T.link(calls, results, schemas).collect()}


def call(name, needs=(), position=0, tool="f", arguments=None):
    given = json.dumps({"x": 1, "refs": [{"$ref": n} for n in needs]}) if arguments is None else arguments
    return (name, 1, position, tool, given, 9)


def test_statuses(spark):
    calls = [call("a"), call("b"), call("a", position=7), call("c", ["c"]), call("d", ["c"]), (None, 1, 0, "f", "{}", 1)]
    results = [("a", 5, "late", "s"), ("a", 3, "y", "s"), ("a", 3, "x", "s"), ("z", 1, "?", "s"), ("c", 1, None, "s"), (None, 1, "n", "s")]
    out = linked(spark, calls, results)
    assert {k: r.status for k, r in out.items()} == {"a": "linked", "b": "unanswered", "c": "cyclic", "d": "cyclic", "z": "orphan"}
    assert json.loads(out["a"].json)["result"] == "x" and out["a"].position == 0 and out["a"].result_position == 3
    assert linked(spark, [], []) == {}


def test_levels_against_plain_recursion(spark):
    rng = random.Random(6)
    needs = {f"c{k}": [f"c{k - 1}"] for k in range(1, 70)} | {"c0": []}
    for k in range(60):
        needs[f"m{k}"] = rng.sample(sorted(needs), rng.randint(0, 3)) + (["nobody"] if k % 9 == 0 else [])
    needs |= {"r1": ["r2"], "r2": ["r3"], "r3": ["r1"], "r4": ["r1"], "r5": ["r4", "c3"], "r6": ["r6"]}

    def level(name, above=()):
        if name in above:
            return None
        below = [level(n, (*above, name)) for n in needs[name] if n in needs]
        return None if None in below else 1 + max(below, default=-1)

    out = linked(spark, [call(k, v) for k, v in needs.items()], [])
    assert {k: r.level for k, r in out.items()} == {k: level(k) for k in needs}


def test_problems(spark):
    cases = {
        '{"x": 3}': [], '{"y": "s", "x": 3}': [], '{"x": "3"}': ["integer expected:x"], "{}": ["missing:x"],
        '{"x": 1, "z": 2}': [], '{"x": 1, "z": 2.5}': [], '{"x": 1, "z": "2"}': ["number expected:z"],
        '{"x": null}': ["integer expected:x"], '{"x": 1, "w": 1, "v": 0}': ["unexpected:v", "unexpected:w"],
        "[1]": ["malformed"], "nonsense{": ["malformed"], "": ["malformed"],
    }
    calls = [call(f"k{n}", arguments=a) for n, a in enumerate(cases)]
    calls += [("null", 1, 0, "f", None, 1), call("g1", tool="g", arguments='{"a": {}, "l": [], "b": true}'), call("g2", tool="g", arguments='{"a": 1}')]
    calls += [call("u", tool="unheard", arguments="{}"), call("n", tool=None, arguments="{}")]
    out = linked(spark, calls, [])
    for n, problems in enumerate(cases.values()):
        assert out[f"k{n}"].problems == problems, list(cases)[n]
    assert out["null"].problems == ["malformed"] and out["g1"].problems == [] and out["g2"].problems == ["object expected:a"]
    assert out["u"].problems == out["n"].problems == ["unknown"]


def test_canonical_json(spark):
    given = '{ "b": [1, {"z": "é\\n", "a": null}], "a": 1.50, "x": 2 }'
    out = linked(spark, [call("k", arguments=given)], [("k", 1, 'say "hi"', "s")])
    assert out["k"].json == json.dumps(
        {"arguments": '{"a":1.5,"b":[1,{"a":null,"z":"é\\n"}],"x":2}', "id": "k", "result": 'say "hi"', "tool": "f"},
        ensure_ascii=False, separators=(",", ":"), sort_keys=True,
    )


def test_no_row_vanishes(spark):
    given = [call("a"), call("a", position=7), call("a", position=7), call("c", ["c"])]
    given += [(None, 1, p, "f", '{"$ref": "a"}', 1) for p in (0, 0)] + [(None, 1, 5, "f", '{"$ref": "c"}', 1), (None, None, None, None, None, None)]
    calls = spark.createDataFrame(given, "call_id string, conv_id bigint, position bigint, tool string, arguments string, level int")
    answers = [("a", 5, "late"), ("a", 3, "x"), ("z", 1, "?"), ("z", 2, "?"), (None, 1, "n"), (None, 1, "n")]
    results = spark.createDataFrame(answers, "call_id string, position bigint, content string")
    schemas = spark.createDataFrame(SCHEMAS, "tool string, field string, type string, required boolean")
    rows = sorted((r.call_id or "", r.status, -1 if r.level is None else r.level) for r in T.link_all(calls, results, schemas).collect())
    assert rows == [
        ("", "cyclic", -1), ("", "orphan", -1), ("", "orphan", -1), ("", "unanswered", 0), ("", "unanswered", 1), ("", "unanswered", 1),
        ("a", "duplicate", 0), ("a", "duplicate", 0), ("a", "linked", 0), ("a", "surplus", -1), ("c", "cyclic", -1), ("z", "orphan", -1), ("z", "orphan", -1),
    ]


def test_turns_without_a_conversation_link_with_nothing(spark, tmp_path):
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for c in (None, None, 1) for t in range(4)]
    turns += [(1, None, "user", "x"), (1, 9, "system", "s"), (1, 8, None, "s")]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = [(r.conv_id, r.status) for r in op9_tool_calls(spark, str(tmp_path)).collect()]
    want = {(None, "unanswered"): 4, (None, "orphan"): 4, (1, "linked"): 2, (1, "unanswered"): 1, (1, "other"): 2}
    assert Counter(rows) == want


def test_identifiers_with_escapes(spark):
    names = ['quo"te', "back\\slash", "tab\there", "ünï😀", "plain", "a" * 20_000]
    calls = [call("root")] + [call(name, ["root"]) for name in names] + [call(f"of {k}", [name]) for k, name in enumerate(names)]
    out = linked(spark, calls, [])
    assert all(out[name].level == 1 for name in names) and all(out[f"of {k}"].level == 2 for k in range(len(names)))


def test_whole_numbers_beyond_64_bits_are_integers(spark):
    given = {"a": "9223372036854775807", "b": "9223372036854775808", "c": "1" * 38, "d": "1.5", "e": '"1"'}
    out = linked(spark, [call(k, arguments=f'{{"x": {v}}}') for k, v in given.items()], [])
    assert {k: out[k].problems for k in given} == {
        "a": [], "b": [], "c": [], "d": ["integer expected:x"], "e": ["integer expected:x"],
    }


def test_statuses_problems_and_json_against_a_plain_version(spark):
    """Whole rows said once more in Python, over random calls, results and references."""
    rng = random.Random(11)
    names = [f"n{k}" for k in range(60)]
    calls, results = [], []
    for position, name in enumerate(rng.choices(names, k=90)):
        tool = rng.choice(["f", "f", "g", "h", None])
        given = {k: rng.choice([1, "s", 2.5, True, None, [1], {"k": 1}]) for k in rng.sample("xyzalbq", rng.randint(0, 3))}
        given |= {"refs": [{"$ref": n} for n in rng.sample(names, rng.randint(0, 1))]} if rng.random() < 0.3 else {}
        arguments = rng.choice([json.dumps(given)] * 6 + ["no json", "[1]", None])
        calls.append((name, position % 3, position, tool, arguments, 0))
    for position, name in enumerate(rng.choices([*names, "lost"], k=50)):
        results.append((name, position, rng.choice(["r", "", None]), "s"))
    first, answers = {}, {}
    for row in sorted(calls, key=lambda r: r[2]):
        first.setdefault(row[0], row)
    for row in sorted(results, key=lambda r: r[1]):
        answers.setdefault(row[0], row)
    needs = {}
    for name, row in first.items():
        found = set(re.findall(T.REFERENCE, row[4] or ""))
        needs[name] = [n for n in found if n in first]

    def level(name, above=()):
        if name in above:
            return None
        below = [level(n, (*above, name)) for n in needs[name]]
        return None if None in below else max(below, default=-1) + 1

    def kind(value):
        return {bool: "boolean", int: "integer", float: "number", str: "string", list: "array", dict: "object", type(None): "null"}[type(value)]

    def problems(tool, arguments):
        try:
            parsed = json.loads(arguments)
        except (TypeError, ValueError):
            return ["malformed"]
        if not isinstance(parsed, dict):
            return ["malformed"]
        fields = [s for s in SCHEMAS if s[0] == tool and tool is not None]
        if not fields:
            return ["unknown"]
        out = [f"unexpected:{k}" for k in parsed if k not in {f for _, f, _, _ in fields}]
        for _, name, wanted, required in fields:
            if name not in parsed:
                out += [f"missing:{name}"] if required else []
            elif kind(parsed[name]) != wanted and (wanted, kind(parsed[name])) != ("number", "integer"):
                out.append(f"{wanted} expected:{name}")
        return sorted(out)

    out = linked(spark, calls, results)
    assert set(out) == set(first) | set(answers)
    for name, row in out.items():
        if name not in first:
            assert row.status == "orphan" and row.level is None and json.loads(row.json)["id"] == name
            continue
        _, conv, position, tool, arguments, _ = first[name]
        assert (row.conv_id, row.position, row.tool, row.level) == (conv, position, tool, level(name))
        assert row.status == ("cyclic" if row.level is None else "linked" if name in answers else "unanswered")
        assert row.problems == problems(tool, arguments), (name, arguments)
        written = json.loads(row.json)
        assert written.get("result") == (answers[name][2] if name in answers else None) and list(written) == sorted(written)
        if row.problems != ["malformed"]:
            assert written["arguments"] == json.dumps(json.loads(arguments), sort_keys=True, separators=(",", ":"))
