import json

from loomspan.operators import drift as S

SCHEMA = "run_id long, dataset string, seq int, body string, json_body string, fields string, kinds string"


def files(spark, rows):
    return spark.createDataFrame([(i, d, s, b, j, "clash", "clash") for i, d, s, b, j in rows], SCHEMA)


def tsv(head, *rows):
    return "\n".join(["\t".join(head)] + ["\t".join(r) for r in rows]) + "\n"


def changes(spark, rows):
    return {(r.run_id, r.side, r.field, r.change_kind) for r in S.schema_changes(S.file_schemas(files(spark, rows))).collect()}


def test_changes_of_columns(spark):
    rows = [
        (1, "d", 1, tsv("abc", ["1", "n/a", "x"]), None), (2, "d", 2, tsv("acb", ["2", "y", "3"]), None),  # order alone; b gets its first type
        (3, "d", 3, tsv(["a", "B", "c"], ["1", "true", "n/a"]), None),  # b -> B between a and c? it stood last: c moved too
        (4, "d", 4, tsv(["a", "B", "c", "e"], ["n/a", "false", "z", "1"]), None), (5, "d", 5, tsv(["B", "c", "e"], ["true", "1", "1"]), None), (6, "d", 6, None, None), (7, "d", 7, tsv(["a", "B", "c", "e"], ["q", "true", "2", "1"]), None),
    ]
    got = changes(spark, rows + rows)
    assert (4, "confounds", "e", "added") in got and (5, "confounds", "a", "removed") in got and (7, "confounds", "a", "added") in got
    assert (7, "confounds", "a", "retyped") not in got  # added again: only added
    assert (5, "confounds", "c", "retyped") in got  # text, then number
    assert not [x for x in got if x[0] == 2]


def test_rename_carries_the_type(spark):
    rows = [(1, "d", 1, tsv(["a", "b", "c"], ["1", "2", "3"]), None), (2, "d", 2, tsv(["a", "x", "c"], ["1", "yes", "3"]), None), (3, "d", 3, tsv(["a", "x", "c"], ["1", "5", "3"]), None)]
    assert changes(spark, rows) == {(2, "confounds", "x", "renamed"), (2, "confounds", "x", "retyped"), (3, "confounds", "x", "retyped")}


def test_json_side_passes_over_missing_files(spark):
    j = lambda **a: json.dumps({"c0": a, "c1": a, "note": 3})
    rows = [(1, "d", 1, None, j(m="CSF", v=0.1)), (2, "d", 2, None, None), (3, "d", 3, None, "{broken"), (4, "d", 4, None, "{}"), (5, "d", 5, None, j(m=None, v=[1], w=True)), (6, "d", 6, None, j(m={"a": 1}, v=[2], w="x"))]
    assert changes(spark, rows) == {(5, "confounds_json", "v", "retyped"), (5, "confounds_json", "w", "added"), (6, "confounds_json", "m", "retyped"), (6, "confounds_json", "w", "retyped")}


def test_between():
    assert S.between(["a", "b", "c"], ["a", "x", "c"]) == ([("b", "x")], [], [])
    assert S.between(["a", "b"], ["b", "a"]) == ([], [], [])
    assert S.between(["a", "b", "c"], ["a", "c", "x"]) == ([], ["x"], ["b"])
    assert S.between(["a", "b", "c", "d"], ["a", "x", "y", "d"]) == ([("b", "x"), ("c", "y")], [], [])


def test_types():
    assert [S.kind_of_text(v) for v in ("1", "-1.5e-3", "1,02", "true", "n/a", "", "<0.0", ".5")] == ["number", "number", "text", "boolean", None, None, "text", "number"]
    assert S.join_kinds("number", "boolean") == "text" and S.join_kinds(None, "list") == "list"
    assert S.table_schema(tsv("ab", ["1", "x"], ["true"])) == {"a": "text", "b": "text"}
    assert S.table_schema(None) == {} and S.table_schema("") == {}


def test_unified_table(spark):
    rows = [(1, "d", 1, tsv(["a", "b", "T"], ["1", "x", "5"]), '{"c": {"k": 1, "K": [1]}}'), (2, "d", 2, tsv(["a", "y", "T"], ["true", "z", "n/a"]), None), (3, "e", 1, None, None)]
    t = S.unified(files(spark, rows), "confounds")
    got = {r.run_id: r for r in t.collect()}
    assert dict(t.dtypes)["a"] == "string" and got[1].b == "x" and got[2].b == "z" and got[1]["T_"] == 5.0 and got[2]["T_"] is None
    c = S.unified(files(spark, rows), "confounds_json").collect()
    assert len(c) == 1 and c[0].component == "c"
    assert S.unified(files(spark, []), "confounds").count() == 0


def test_blocks_give_what_one_fold_gives(spark):
    import random

    rng = random.Random(5)
    rows = []
    for d in ("x", "y", None):
        names = list("abcd")
        for seq in range(1, 15):
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(names))
                what = rng.randint(0, 3)
                if what == 0:
                    names[k] = names[k] + "_"
                elif what == 1 and len(names) > 2:
                    names.pop(k)
                elif what == 2:
                    names.insert(k, f"n{seq}{k}")
                else:
                    rng.shuffle(names)
            cells = [rng.choice(["n/a", "n/a", "1", "true", "x"]) for _ in names]
            rows.append((len(rows), d, None if seq == 14 and d == "y" else seq, tsv(names, cells) if seq % 6 else None, None))
    s = S.file_schemas(files(spark, rows))
    whole = sorted(map(str, S.schema_changes(s, 10_000).collect()))
    assert len(whole) > 20
    for block in (1, 2, 5):
        assert sorted(map(str, S.schema_changes(s, block).collect())) == whole
