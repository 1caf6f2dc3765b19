import datetime
import itertools
from datetime import datetime as D

from loomspan.operators import fragments as G

P = "/a/sub-1/func/sub-1_task-r_run-1_feature-f_atlas-A_chunk-%s_timeseries.tsv"
SCHEMA = "frag_id long, path string, sidecar string, n_bytes long, modified_at timestamp_ntz, body string, series string, t int"


def frags(spark, rows):
    return spark.createDataFrame([(i, p, None, 0, m, b, "clash", 1) for i, p, m, b in rows], SCHEMA)


def body(ts, head=True, nl="\n", value=0.5):
    return nl.join((["t\tr0"] if head else []) + [f"{t}\t{value}" for t in ts]) + nl


T0, T1 = D(2020, 1, 1), D(2021, 1, 1)
ROWS = [
    (1, P % 0, T0, body(range(5))), (2, P % 1, T0, body(range(5, 9), head=False, nl="\r\n")), (3, P.replace("/", "\\") % 2, T1, body(range(7, 12), value=0.9)),
    (4, "sub-1_atlas-A_task-r_run-1_feature-f_timeseries.tsv.gz", T0, "t\tr0\n8.0\t 1\n7.0\t 2\n"), (5, P % 3, T0, "t\tr0\n"), (6, P % 4, T0, None), (7, P % 5, T0, ""),
    (8, None, T0, body(range(5))), (9, "noise.tsv", T0, body(range(5))), (10, P.replace("sub-1_", "sub-2_") % 0, T0, body(range(100))), (11, P % 9, T0, body([200, 201, 200])),
]


def test_overlaps(spark):
    f = frags(spark, ROWS + ROWS)
    got = {(r.frag_lo, r.frag_hi) for r in G.overlapping(G.footers(f).dropDuplicates(["frag_id"])).collect()}
    assert got == {(2, 3), (2, 4), (3, 4)}


def test_many_copies_in_one_series(spark):
    rows = [(i, P % i, T0, body(range(300))) for i in range(12)] + [(50, P % 50, T0, body([299]))]
    got = {(r.frag_lo, r.frag_hi) for r in G.overlapping(G.footers(frags(spark, rows))).collect()}
    assert got == set(itertools.combinations([*range(12), 50], 2))


def test_each_volume_once(spark):
    out = G.consolidate(frags(spark, ROWS + ROWS)).collect()
    lines = [x for r in out if r.series.startswith("1|") for x in r.body.split("\n")]
    ts = [int(float(x.split("\t")[0])) for x in lines]
    assert sorted(ts) == [*range(12), 200, 201]
    assert {x for x in lines if x.split("\t")[0] in ("7", "8")} == {"7\t0.9", "8\t0.9"}  # the later delivery
    one = next(r for r in out if r.series.startswith("1|"))
    assert one.n_volumes == 14 and one.n_copied == 1  # the first fragment went over as it stands


def test_large_series_is_cut(spark):
    out = G.consolidate(frags(spark, [(i, P % i, T0, body(range(10 * i, 10 * i + 10))) for i in range(6)]), target_bytes=120).collect()
    assert len(out) > 1 and sum(r.n_volumes for r in out) == 60


def test_a_hot_series_of_ten_thousand_deliveries(spark):
    rows = [(i, P % 0, datetime.timedelta(seconds=i) + T0, body(range(i % 40, i % 40 + 5), value=i)) for i in range(10_000)]
    out = G.consolidate(frags(spark, rows)).collect()
    lines = [x.split("\t") for r in out for x in r.body.split("\n")]
    assert [int(t) for t, _ in lines] == list(range(44))
    assert all(int(v) == max(i for i in range(9_900, 10_000) if i % 40 <= int(t) < i % 40 + 5) for t, v in lines)


def test_interleaving_fragments_come_out_by_volume(spark):
    rows = [(1, P % 0, T0, body(range(0, 200, 2))), (2, P % 1, T1, body(range(1, 200, 2))), (3, P % 2, None, body([5, 6, 5000, 9000]))]
    out = G.consolidate(frags(spark, rows)).collect()
    assert [int(x.split("\t")[0]) for r in out for x in r.body.split("\n")] == [*range(200), 5000, 9000]
    assert sum(r.n_volumes for r in out) == 202


def test_empty(spark):
    assert G.consolidate(frags(spark, [])).count() == 0
    assert G.overlapping(G.footers(frags(spark, []))).count() == 0


def test_totals_agree(spark, tiny):
    assert all(r.n_before == r.n_after for r in G.p4_check(spark, tiny).collect())


def test_small_series_share_files(spark):
    rows = [(i, P.replace("sub-1_", f"sub-{i % 40}_") % i, f"/a/{i % 40}-{i % 2}.json" if i % 3 else None, 0, T0, body(range(5 * i, 5 * i + 5)), "clash", 1) for i in range(400)]
    f = spark.createDataFrame(rows, SCHEMA)
    total = sum(len(x) + 1 for r in rows for x in r[5].split("\n")[1:-1])
    for target in (10**6, 2000):
        out = G.packed(G.consolidate(f, target)).collect()
        assert len(out) == -(-total // target)  # 1 or a few, not one for each of 40 series
        assert all(abs(r.n_bytes - target) <= 100 for r in out[:-1] if len(out) > 1 and r.file < len(out) - 1)
        seen = {}
        for r in out:
            assert len(r.body) == r.n_bytes - 1 and sum(e.n_volumes for e in r.footer) == r.n_volumes
            for e in r.footer:
                lines = r.body[e.offset : e.offset + e.n_bytes].split("\n")
                assert len(lines) == e.n_volumes and int(lines[0].split("\t")[0]) == e.first_t and int(lines[-1].split("\t")[0]) == e.last_t
                for x in lines:
                    assert (key := (e.series.split("|")[0], int(x.split("\t")[0]))) not in seen
                    seen[key] = e.sidecar
        assert seen == {(str(i % 40), t): r[2] for i, r in enumerate(rows) for t in range(5 * i, 5 * i + 5)}
