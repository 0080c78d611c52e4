"""Hand-traced cases of identifier extraction."""

import random

import pytest
from pyspark.sql import functions as F

from lakekit.operators.extract import block_rows, extract_ids, field_ids, notebook_ids

G = "11111111-aaaa-4bbb-8ccc-000000000001"
H = "22222222-aaaa-4bbb-8ccc-000000000002"
K = "33333333-aaaa-4bbb-8ccc-000000000003"

NOTEBOOK_CASES = {
    "checked name": (f'# META "default_lakehouse": "{G}"', [("default_lakehouse", G)]),
    "other name": (f'# META "other": "{G}"', []),
    "id outside a block": (f'# META "id": "{G}"', []),
    "id inside a block": (
        f'# META "known_lakehouses": [\n# META "id": "{G}"\n# META ]\n# META "id": "{H}"',
        [("known_lakehouses", G)],
    ),
    "only marker lines change the block": (
        f'# META "known_lakehouses": [\n]\n# META "id": "{G}"',
        [("known_lakehouses", G)],
    ),
    "the closing line is outside": (f'# META "known_lakehouses": [\n# META "id": "{G}" ]', []),
    "inline list": (f'# META "known_lakehouses": ["{G}", "{H}"]', [("known_lakehouses", G), ("known_lakehouses", H)]),
    "inline objects give the first": (
        f'# META "known_lakehouses": [{{"id": "{G}"}}, {{"id": "{H}"}}]',
        [("known_lakehouses", G)],
    ),
    "a line that opens never closes": (
        f'# META "known_lakehouses": [{{"id": "{G}"}}]\n# META "id": "{K}"',
        [("known_lakehouses", G), ("known_lakehouses", K)],
    ),
    "no marker": (f'x = "{G}"', []),
    "second block": (
        f'# META "known_lakehouses": [\n# META ]\n# META "id": "{G}"\n# META "known_lakehouses": [\n# META "id": "{H}"',
        [("known_lakehouses", H)],
    ),
}

FIELD_CASES = {
    "every field with every id": (
        f'"workspaceId": "{G}", "artifactId": "{H}"',
        [("artifactId", G), ("artifactId", H), ("workspaceId", G), ("workspaceId", H)],
    ),
    "line based": (f'"workspaceId":\n"{G}"', []),
    "no word boundary": (f'"connectionId": "ff{G}00"', [("connectionId", G)]),
    "name must be quoted": (f'workspaceId: "{G}"', []),
}


@pytest.mark.parametrize(
    ("extract", "cases"), [(notebook_ids, NOTEBOOK_CASES), (field_ids, FIELD_CASES)], ids=["notebook", "fields"]
)
def test_cases(spark, extract, cases):
    df = spark.createDataFrame([(name, text) for name, (text, _) in cases.items()], "name string, text string")
    found = {name: [] for name in cases}
    for r in extract(df).collect():
        found[r.name].append((r.field_name, r.id))
    assert {n: sorted(v) for n, v in found.items()} == {n: sorted(want) for n, (_, want) in cases.items()}


def test_context_is_the_stripped_line(spark):
    df = spark.createDataFrame([(f'\t  # META "default_lakehouse": "{G}"  \n',)], "text string")
    got = notebook_ids(df).first()
    assert (got.line_no, got.context) == (1, f'# META "default_lakehouse": "{G}"')


def test_tabs_and_carriage_returns_stay_apart(spark, as_rows):
    df = spark.createDataFrame([(f'# META\t"known_lakehouses": [\r\n# META\t"id":\t"{G}"\r\n',)], "text string")
    assert as_rows(notebook_ids(df).select("line_no", "field_name", "id")) == [(2, "known_lakehouses", G)]


def test_all_ids_of_a_line(spark, as_rows):
    df = spark.createDataFrame([(f"{G}{H} {G}",)], "line string")
    assert as_rows(extract_ids(df).select("id")) == [(G,), (G,), (H,)]


def test_block_rows_agree_with_a_plain_walk(spark):
    rng = random.Random(7)
    # One group holds most rows, and chunks are far smaller than it.
    data = [(rng.choice(["h", "h", "h", "a", None]), at, rng.choice(["open", "close", "", "", ""])) for at in range(3000)]
    df = spark.createDataFrame(data, "g string, at int, kind string").repartition(7)
    got = block_rows(df, ["g"], "at", F.col("kind") == "open", F.col("kind") == "close", partitions=30)
    state, expected = {}, {}
    for group, at, kind in data:
        if kind:
            state[group] = kind == "open"
        expected[at] = state.get(group, False)
    assert {r["at"]: r.inside for r in got.collect()} == expected


def test_sparse_positions_carry_one_row_per_partition(spark, monkeypatch):
    """Time stamps in microseconds with wide gaps, several group columns, partitions without any turn."""
    from lakekit.operators import extract

    rng = random.Random(3)
    data, at = [], 0
    for _ in range(2000):
        at += rng.choice([1, 10**6, 10**12])
        kind = rng.choice(["open", "close"]) if rng.random() < 0.01 else ""
        data.append((rng.choice([1, 2]), rng.choice(["x", "x", "x", None]), at, kind, "more"))
    df = spark.createDataFrame(data, "a int, b string, at long, kind string, line string").repartition(5)
    written = {}
    plain = extract.stored
    monkeypatch.setattr(extract, "stored", lambda rows, label: written.setdefault(label, plain(rows, label)))
    got = block_rows(df, ["a", "b"], "at", F.col("kind") == "open", F.col("kind") == "close", partitions=40)
    state, expected = {}, {}
    for a, b, at, kind, _ in data:
        if kind:
            state[a, b] = kind == "open"
        expected[at] = state.get((a, b), False)
    assert got.columns == [*df.columns, "inside"]
    assert {r["at"]: r.inside for r in got.collect()} == expected
    assert written["block-carry"].count() <= 40
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.undo()
    assert block_rows(df.limit(0), ["a"], "at", F.col("kind") == "open", F.lit(False)).count() == 0
    whole = block_rows(df, [], "at", F.col("kind") == "open", F.col("kind") == "close")
    assert whole.count() == 2000


def test_rows_that_share_a_position_close_before_they_open(spark):
    df = spark.createDataFrame([("g", 1, "open"), ("g", 1, "close"), ("g", 1, ""), ("g", 2, "")], "g string, at int, kind string")
    got = block_rows(df, ["g"], "at", F.col("kind") == "open", F.col("kind") == "close")
    assert sorted((r["at"], r.kind, r.inside) for r in got.collect()) == [(1, "", False), (1, "close", False), (1, "open", True), (2, "", True)]
