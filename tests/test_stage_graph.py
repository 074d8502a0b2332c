import random

import pytest

from orderledger.operators.stage_graph import (
    dependency_edges,
    duplicate_stages,
    graph_findings,
    graph_verdicts,
    lookup_dependencies,
    missing_dependencies,
    normalized_stages,
    orderable_stages,
    place_stages,
    stage_inputs,
    stage_issues,
    topological_order,
    unresolved_stages,
)

SCHEMA = "pipeline_id bigint, position int, name string, dependencies array<string>"


def frame(spark, graphs):
    rows = [
        (graph, place, name, deps)
        for graph, stages in graphs.items()
        for place, (name, deps) in enumerate(stages)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def ready_list_order(stages):
    """The order of a first-in-first-out ready list, or None with a cycle."""
    met, order, queue = set(), [], [n for n, deps in stages if not deps]
    while queue:
        met.add(queue[0])
        order.append(queue.pop(0))
        queue += [n for n, deps in stages if n not in met and n not in queue and set(deps) <= met]
    return order if len(order) == len(stages) else None


def random_graph(rng):
    names = [f"s{i}" for i in range(rng.randint(1, 9))]
    place = names[:]
    rng.shuffle(place)
    cyclic = rng.random() < 0.3
    stages = []
    for name in place:
        pool = names if cyclic else names[: names.index(name)]
        stages.append((name, rng.sample(pool, min(len(pool), rng.choice([0, 1, 1, 2, 3])))))
    return stages


def test_order_equals_a_ready_list_on_random_graphs(spark):
    rng = random.Random(7)
    graphs = {g: random_graph(rng) for g in range(150)}
    stages = normalized_stages(frame(spark, graphs))
    placed = place_stages(orderable_stages(stages)).cache()
    got = {}
    for row in topological_order(placed).collect():
        got.setdefault(row.pipeline_id, {})[row.place] = row.name
    expected = {g: ready_list_order(stages) for g, stages in graphs.items()}
    assert {g: [names[i] for i in range(len(names))] for g, names in got.items()} == {
        g: order for g, order in expected.items() if order is not None
    }
    stuck = {r.pipeline_id for r in unresolved_stages(placed).collect()}
    assert stuck == {g for g, order in expected.items() if order is None}


def test_findings_and_verdicts(spark):
    graphs = {
        1: [("a", []), (" b ", [" a ", "", "a"])],
        2: [("a", []), ("z", []), ("a", ["z"]), ("z", [])],
        3: [("a", ["ghost", "b"]), ("b", ["x"])],
        4: [("a", []), ("b", ["a", "d"]), ("c", ["b"]), ("d", ["c"]), ("e", ["d"])],
        5: [("a", ["a"])],
    }
    stages = normalized_stages(frame(spark, graphs))
    assert [tuple(r) for r in dependency_edges(stages.where("pipeline_id = 1")).collect()] == [
        (1, 1, "b", 0, "a")
    ]
    assert {(r.name, r.copies) for r in duplicate_stages(stages).collect()} == {("a", 2), ("z", 2)}
    assert {r.message for r in missing_dependencies(stages).collect()} == {
        "a -> ghost", "b -> x",
    }
    assert stage_inputs(stages.where("pipeline_id = 1")).count() == 2
    verdicts = {r.pipeline_id: tuple(r)[1:] for r in graph_verdicts(stages).collect()}
    assert verdicts == {
        1: ("ok", 0, None),
        2: ("duplicate", 2, "Duplicate stage names are not allowed:"),
        3: ("missing", 2, "Unknown stage dependencies:"),
        4: ("cycle", 4, "Stage graph contains a cycle or unresolved dependencies:"),
        5: ("cycle", 1, "Stage graph contains a cycle or unresolved dependencies:"),
    }
    found = graph_findings(stages).orderBy("place", "dependency_order", "text").collect()
    texts = {(g, rule): [r.text for r in found if (r.pipeline_id, r.rule) == (g, rule)] for g, (rule, *_) in verdicts.items()}
    assert texts[2, "duplicate"] == ["a", "z"] and texts[3, "missing"] == ["a -> ghost", "b -> x"]
    assert texts[4, "cycle"] == ["b", "c", "d", "e"] and texts[5, "cycle"] == ["a"]


def test_every_finding_of_a_large_graph_is_listed(spark):
    stages = normalized_stages(frame(spark, {1: [(f"s{i}", [f"ghost{i}"]) for i in range(1500)]}))
    found = graph_findings(stages)
    [verdict] = graph_verdicts(stages, found).collect()
    assert (verdict.verdict, verdict.problems) == ("missing", 1500) and found.count() == 1500


def test_two_stage_cycle(spark):
    stages = normalized_stages(
        frame(spark, {1: [("first_stage", ["second_stage"]), ("second_stage", ["first_stage"])]})
    )
    stuck = unresolved_stages(place_stages(stages)).collect()
    assert {r.name for r in stuck} == {"first_stage", "second_stage"}


def test_a_hot_graph_with_one_dependency_for_all(spark):
    stages = normalized_stages(
        frame(spark, {1: [(f"s{i}", ["s0"] if i else []) for i in range(3000)], 2: [("a", [])]})
    )
    order = topological_order(place_stages(stages))
    places = {r.name: r.place for r in order.where("pipeline_id = 1").collect()}
    assert places == {f"s{i}": i for i in range(3000)}


def test_a_lone_text_is_one_dependency(spark):
    stages = spark.createDataFrame(
        [(1, 0, "a", " b "), (1, 1, "b", None)], "pipeline_id int, position int, name string, dependencies string"
    )
    assert {r.name: r.dependencies for r in normalized_stages(stages).collect()} == {"a": ["b"], "b": []}


def test_stage_definition_issues(spark):
    stages = spark.createDataFrame(
        [(1, 0, " ", None), (1, 1, "a", None), (1, 2, "b", "b.py")],
        "pipeline_id int, position int, name string, source string",
    )
    found = stage_issues(stages).orderBy("position").collect()
    assert [r.message for r in found] == [
        "Stage name cannot be empty.", "Stage 'a' does not define a source.",
    ]


@pytest.mark.parametrize(
    "key, found",
    [("load", ["n"]), ("load.v1.py", ["f"]), ("load.v1", ["s"]), ("/jobs/load.v1.py", ["p"]), ("other", [])],
)
def test_dependency_lookup_takes_the_first_matching_key(spark, key, found):
    stages = spark.createDataFrame([(1, "load", "/jobs/load.v1.py")], "pipeline_id int, name string, path string")
    keys = ["load", "load.v1.py", "load.v1", "/jobs/load.v1.py"]
    values = dict(zip(keys, "nfsp"))
    present = keys[keys.index(key):] if key in keys else ["other"]
    mapping = spark.createDataFrame(
        [(1, k, [values.get(k, "none")]) for k in present],
        "pipeline_id int, key string, dependencies array<string>",
    )
    assert lookup_dependencies(stages, mapping).collect()[0].dependencies == found


def test_a_long_chain_takes_few_rounds(spark, tmp_path):
    import os
    import time

    from orderledger.sources.shared import shared_dir

    n = 200
    chain = [(f"s{i}", [f"s{i - 1}"] if i else []) for i in range(n)]
    order = random.Random(3).sample(chain, n)
    ring = [(f"s{i}", [f"s{(i + 1) % 7}"]) for i in range(7)] + [("behind", ["s3", "free"]), ("free", [])]
    twice = [(f"{c}{i}", [f"{c}{i - 1}"] if i else []) for i in range(12) for c in "ba"]
    stages = normalized_stages(frame(spark, {1: order, 2: ring, 3: twice}))
    root, start = shared_dir(spark), time.time()
    before = set(os.listdir(root))
    placed = place_stages(orderable_stages(stages)).cache()
    assert {r.name: r.level for r in placed.where("pipeline_id = 1").collect()} == {f"s{i}": i for i in range(n)}
    [folder] = [f for f in set(os.listdir(root)) - before if f.startswith("stage-rounds")]
    assert len(os.listdir(os.path.join(root, folder))) <= 16
    assert {r.name for r in unresolved_stages(placed).collect()} == {f"s{i}" for i in range(7)} | {"behind"}
    places = {(r.pipeline_id, r.name): r.place for r in topological_order(placed, most=3).collect()}
    assert places == {
        **{(1, f"s{i}"): i for i in range(n)},
        **{(3, name): k for k, name in enumerate(ready_list_order(twice))},
    }
    assert time.time() - start < 60


def test_ladders_and_wide_levels(spark):
    ladder = [(f"s{i}", [f"s{k}" for k in (i - 1, i - 2, i - 5) if k >= 0]) for i in range(30)]
    wide = [(f"a{i}", []) for i in range(9)] + [(f"b{i}", [f"a{(i * 4) % 9}", f"a{i}"]) for i in range(9)]
    wide += [(f"c{i}", [f"b{(i * 7) % 9}", f"a{i}"]) for i in range(9)]
    graphs = {1: ladder, 2: wide, 3: []}
    placed = place_stages(orderable_stages(normalized_stages(frame(spark, graphs))))
    got = {}
    for row in topological_order(placed, most=2).collect():
        got.setdefault(row.pipeline_id, {})[row.place] = row.name
    assert {g: [names[i] for i in range(len(names))] for g, names in got.items()} == {
        g: ready_list_order(stages) for g, stages in graphs.items() if stages
    }
