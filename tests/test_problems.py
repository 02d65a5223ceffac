"""Problems 1 to 7 against brute force, and their edge cases."""

import datetime as dt
import json
import random
from collections import defaultdict
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from almazara.operators import drift, fill, history, intervals, references, rolling, timestamps
from almazara.plans import reference_queries

D = dt.date


def day(n):
    return D(2024, 1, 1) + dt.timedelta(n)


# ------------------------------------------------------------------------------------------------ intervals

SPANS = "who string, a date, b date, entity string, s int, e int, next string"


def test_intervals_equal_day_sets(spark):
    rng = random.Random(5)
    rows = [(rng.choice("xyz"), day(rng.randint(0, 80)), day(rng.randint(0, 80)), "clash", 1, 2, "n") for _ in range(60)]
    rows += rows[:7] + [(None, day(0), day(3), "", 0, 0, ""), ("x", None, day(3), "", 0, 0, ""), ("x", day(3), None, "", 0, 0, "")]
    got = {tuple(r) for r in intervals.covered_spans(spark.createDataFrame(rows, SPANS), "who", "a", "b").collect()}
    want = set()
    for who in "xyz":
        covered = sorted({day(k) for w, a, b, *_ in rows if w == who and a and b for k in range((a - day(0)).days, (b - day(0)).days + 1)})
        runs = []
        for d in covered:
            if runs and (d - runs[-1][1]).days == 1:
                runs[-1][1] = d
            else:
                runs.append([d, d])
        want |= {(who, "period", a, b) for a, b in runs}
        want |= {(who, "gap", x[1] + dt.timedelta(1), y[0] - dt.timedelta(1)) for x, y in zip(runs, runs[1:])}
    assert got == want


def test_intervals_of_nothing(spark):
    assert intervals.covered_spans(spark.createDataFrame([], SPANS), "who", "a", "b").collect() == []
    far = spark.createDataFrame([("x", D(1, 1, 1), D(9999, 12, 31), "", 0, 0, "")], SPANS)
    assert [tuple(r)[1:] for r in intervals.covered_spans(far, "who", "a", "b").collect()] == [("period", D(1, 1, 1), D(9999, 12, 31))]


# ------------------------------------------------------------------------------------------------ references

CHILD = "id long, code long, a date, b date, spans string, k0 int, period string, reason string"
PARENT = "code long, f date, t date, spans string"
FK = references.ForeignKey("child", "parent", ["code"], ["code"], ["a", "b"], ["f", "t"])


def test_orphans_and_reasons(spark):
    parents = [(1, day(10), day(20), ""), (1, day(30), None, ""), (2, None, day(5), ""), (3, day(50), None, ""), (4, None, None, ""), (5, day(9), day(3), ""), (None, None, None, "")]
    cases = [(1, 21, 29, "between"), (1, 20, 25, None), (1, 0, 9, "later"), (1, 40, 41, None), (2, 6, 9, "deleted"), (2, 5, 9, None), (3, 0, 1, "later"), (4, 0, 0, None), (9, 0, 1, "missing"), (5, 4, 5, "between")]
    rows = [(i, c, day(a), day(b), "x", 0, "p", "r") for i, (c, a, b, _) in enumerate(cases)] + [(90, None, day(0), day(1), "", 0, "", ""), (91, 9, None, day(1), "", 0, "", ""), (92, 9, day(2), day(1), "", 0, "", "")]
    df, master = spark.createDataFrame(rows, CHILD), spark.createDataFrame(parents, PARENT)
    got = {r.id: r.reason for r in references.direct_orphans(df, master, FK, ["id"]).collect()}
    assert got == {i: r for i, (*_, r) in enumerate(cases) if r}
    assert {r.reason for r in references.direct_orphans(df, master.limit(0), FK, ["id"]).collect()} == {"missing"}
    assert references.direct_orphans(df.limit(0), master, FK, ["id"]).collect() == []


def test_cascade_reaches_a_fixpoint(spark):
    a = spark.createDataFrame([(1, 1)], "id long, code long")
    b = spark.createDataFrame([(1, 1), (2, 7), (3, 7)], "id long, code long")
    c = spark.createDataFrame([(1, 1), (2, 2), (3, None), (4, 9)], "id long, b_id long")
    e = spark.createDataFrame([(1, 2), (2, 1)], "id long, c_id long")
    keys = [references.ForeignKey("b", "a", ["code"], ["code"]), references.ForeignKey("c", "b", ["b_id"], ["id"]), references.ForeignKey("e", "c", ["c_id"], ["id"])]
    rows = references.orphan_cascade({"a": a, "b": b, "c": c, "e": e}, keys, dict.fromkeys("abce", "id")).collect()
    assert {(r.table_name, r.row_id, r.origin, r["round"]) for r in rows} == {("b", 2, "direct", 0), ("b", 3, "direct", 0), ("c", 4, "direct", 0), ("c", 2, "inherited", 1), ("e", 1, "inherited", 2)}
    found = spark.createDataFrame(rows, "table_name string, row_id long, reference string, period string, reason string, origin string, round int")
    assert {(r.table_name, r.origin): r.orphans for r in references.orphan_report(found).collect()} == {("b", "direct"): 2, ("c", "direct"): 1, ("c", "inherited"): 1, ("e", "inherited"): 1}


def test_inheritance_goes_by_the_time_of_the_child(spark):
    master = spark.createDataFrame([(7, day(60), None)], "m long, f date, t date")
    parents = spark.createDataFrame([(1, 5, 7, day(0), day(30)), (2, 5, 7, day(60), day(90)), (3, 6, 7, day(60), day(90))], "id long, code long, m long, a date, b date")
    children = spark.createDataFrame([(1, 5, day(3), day(9)), (2, 5, day(61), day(62)), (3, 5, day(20), day(70)), (4, 6, day(61), day(62)), (5, 5, day(40), day(50)), (6, 5, None, day(3))], "id long, code long, a date, b date")
    keys = [references.ForeignKey("p", "m", ["m"], ["m"], ["a", "b"], ["f", "t"]), references.ForeignKey("c", "p", ["code"], ["code"], ["a", "b"], ["a", "b"])]
    rows = references.orphan_cascade({"m": master, "p": parents, "c": children}, keys, {"p": "id", "c": "id", "m": "m"}).collect()
    assert {(r.table_name, r.row_id, r.reason, r["round"]) for r in rows} == {("p", 1, "later", 0), ("c", 5, "between", 0), ("c", 1, "orphaned_parent", 1)}


def test_a_deep_chain_and_a_cycle_come_to_rest(spark):
    n = 12
    tables = {"t0": spark.createDataFrame([(1, 99)], "id long, up long")} | {f"t{i}": spark.createDataFrame([(1, 1), (2, None)], "id long, up long") for i in range(1, n)}
    tables["root"] = spark.createDataFrame([(1, None)], "id long, up long")
    keys = [references.ForeignKey("t0", "root", ["up"], ["id"])] + [references.ForeignKey(f"t{i}", f"t{i - 1}", ["up"], ["id"]) for i in range(1, n)]
    keys.append(references.ForeignKey("root", f"t{n - 1}", ["up"], ["id"]))
    got = {(r.table_name, r["round"]) for r in references.orphan_cascade(tables, keys, dict.fromkeys(tables, "id")).collect()}
    assert got == {(f"t{i}", i) for i in range(n)}
    loop = {"a": spark.createDataFrame([(1, 2), (2, 9)], "id long, up long")}
    rows = references.orphan_cascade(loop, [references.ForeignKey("a", "a", ["up"], ["id"])], {"a": "id"}).collect()
    assert {(r.row_id, r.origin) for r in rows} == {(2, "direct"), (1, "inherited")}


# ------------------------------------------------------------------------------------------------ timestamps

TYPED = "id long, v string, file string, zone string, pos long, p string, n int, wall long, utc string"


def _normal(spark, values, zone="Europe/Madrid", file="f", position=False):
    rows = [(i, v, file, zone, i, "x", 1, 2, "y") for i, v in enumerate(values)]
    t = timestamps.Typed("v", "id", "file", "zone", "pos" if position else None)
    out = timestamps.normalise(spark.createDataFrame(rows, TYPED), t).withColumn("text", timestamps.instant_text(F.col("utc_seconds"))).collect()
    assert len(out) == len(values) and all((r.time_status == "normal") == (r.utc_seconds is not None) for r in out)
    return {r.row_id: (r.text, r.local_day, r.time_status) for r in out}


def test_formats(spark):
    cases = {
        "2024-03-02T10:11:12Z": "2024-03-02T10:11:12Z", " 2024-03-02  10:11:12 ": "2024-03-02T09:11:12Z", "2024-03-02T10:11": "2024-03-02T09:11:00Z", "2024-07-02T10:11:12.999+0530": "2024-07-02T04:41:12Z",
        "20240302T101112Z": "2024-03-02T10:11:12Z", "20240302101112": "2024-03-02T09:11:12Z", "2024/3/2 0:01:02": "2024-03-01T23:01:02Z", "1709374272": "2024-03-02T10:11:12Z", "1709374272999": "2024-03-02T10:11:12Z",
        "2 de marzo de 2024, 10:11 h": "2024-03-02T09:11:00Z", "2 MAR 2024 10:11 WET": "2024-03-02T10:11:00Z", "2024-07-02 10:00:00 Atlantic/Canary": "2024-07-02T09:00:00Z", "45353.5": "2024-03-02T11:00:00Z",
        "31/1/2024 12:05:00 AM": "2024-01-30T23:05:00Z", "31/1/2024 12:05:00 PM": "2024-01-31T11:05:00Z", "31.01.2024 10:00:00 CEST": "2024-01-31T08:00:00Z", "31-01-24 10.05": "2024-01-31T09:05:00Z", "2024-02-29": "2024-02-28T23:00:00Z",
        "2024-03-31 02:30:00": "2024-03-31T01:30:00Z", "2024-10-27 02:30:00": "2024-10-27T00:30:00Z",
    }
    got = _normal(spark, list(cases))
    assert {v: got.get(i, (None,))[0] for i, v in enumerate(cases)} == cases


def test_every_value_has_a_status(spark):
    bad = {
        None: "null", "": "unreadable", "  ": "unreadable", "n/a": "unreadable", "pendiente": "unreadable", "12-34": "unreadable", "1" * 50_000: "unreadable", "2 de brumario de 2024": "unreadable",
        "0000-00-00 00:00:00": "out_of_range", "2023-02-29": "out_of_range", "2024-13-01": "out_of_range", "2024-04-31 10:00": "out_of_range", "2024-01-01 24:00:00": "out_of_range", "2024-01-01 10:60": "out_of_range",
        "31/31/2024": "out_of_range", "10/1/2024 13:00:00 PM": "out_of_range", "2024-01-01 10:00 XYZ/Nowhere": "zone_unknown", "2024-01-01 10:00 abcd": "zone_unknown", "2024-01-01 10:00 IST": "zone_unknown",
    }
    got = _normal(spark, list(bad))
    assert {v: got[i][2] for i, v in enumerate(bad)} == bad and all(g[:2] == (None, None) for g in got.values())
    assert _normal(spark, ["2024-01-01 10:00"], zone=None)[0] == (None, None, "zone_unknown")
    assert _normal(spark, ["2024-01-01T10:00:00Z"], zone=None)[0] == ("2024-01-01T10:00:00Z", None, "normal")
    assert _normal(spark, []) == {}


def test_abbreviations_of_the_zone_database(spark):
    cases = {"2024-01-01 10:00 EST": "2024-01-01T15:00:00Z", "2024-07-01 10:00 EDT": "2024-07-01T14:00:00Z", "2024-07-01 10:00 MSK": "2024-07-01T07:00:00Z", "2024-07-01 10:00 CEST": "2024-07-01T08:00:00Z"}
    got = _normal(spark, list(cases))
    assert {v: got[i][0] for i, v in enumerate(cases)} == cases
    assert _normal(spark, ["2024-01-01 10:00 IST"], zone="Asia/Kolkata")[0][0] == "2024-01-01T04:30:00Z"
    assert _normal(spark, ["2024-01-01 10:00 IST"], zone="Asia/Jerusalem")[0][0] == "2024-01-01T08:00:00Z"
    regions, sure, own = timestamps.zone_names()
    assert regions["europe/madrid"] == "Europe/Madrid" and "ist" not in sure and own["asia/kolkata ist"] == 19_800


def test_order_of_day_and_month_is_of_the_file(spark):
    assert _normal(spark, ["1/2/2024", "1/13/2024"])[0][1] == D(2024, 1, 2)
    assert _normal(spark, ["1/2/2024", "13/1/2024"])[0][1] == D(2024, 2, 1)
    assert _normal(spark, ["1/2/2024"])[0][1] == D(2024, 2, 1)
    rows = [(1, "1/2/2024", "f", "UTC"), (2, "3/4/2024", "f", "UTC")]
    df = spark.createDataFrame(rows, "id long, v string, file string, zone string")
    hint = F.when(F.col("id") == 1, F.unix_date(F.lit("2024-01-03").cast("date"))).otherwise(F.unix_date(F.lit("2024-03-05").cast("date")))
    got = timestamps.normalise(df, timestamps.Typed("v", "id", "file", "zone"), hint).collect()
    assert {r.local_day for r in got} == {D(2024, 1, 2), D(2024, 3, 4)}


def test_second_occurrence_by_position(spark):
    got = _normal(spark, ["2024-10-27T01:00", "2024-10-27T02:00", "27/10/2024 2:00", "2024-10-27T03:00", "13/10/2024 1:00"], position=True)
    assert [got[i][0] for i in range(4)] == ["2024-10-26T23:00:00Z", "2024-10-27T00:00:00Z", "2024-10-27T01:00:00Z", "2024-10-27T02:00:00Z"]
    assert _normal(spark, ["2024-10-27T02:00"], position=True)[0][0] == "2024-10-27T00:00:00Z"


def test_random_local_times_equal_zoneinfo(spark):
    rng = random.Random(2)
    zones = ["Europe/Madrid", "Europe/Lisbon", "Atlantic/Canary"]
    rows = []
    for i in range(400):
        t = dt.datetime(2024, rng.choice([3, 10]), rng.choice([26, 27, 30, 31]), rng.randint(0, 4), rng.randint(0, 59), rng.randint(0, 59))
        rows.append((i, t.isoformat(" "), "f", zones[i % 3]))
    out = timestamps.normalise(spark.createDataFrame(rows, "id long, v string, file string, zone string"), timestamps.Typed("v", "id", "file", "zone")).collect()
    assert len(out) == 400
    for r in out:
        local = dt.datetime.fromisoformat(rows[r.row_id][1]).replace(tzinfo=ZoneInfo(rows[r.row_id][3]), fold=0)
        assert r.utc_seconds == int(local.timestamp())


# ------------------------------------------------------------------------------------------------ filling

DAYS = "id long, r string, d date, wd string, a long, b double, stat double, fill_group string"


def test_reasons_and_fill(spark):
    rows = [(i, "x", day(i), "abcdefg"[i % 7], 10 + i % 3, 100.0 + 10 * (i % 3), 0.0, "c") for i in range(60)]
    rows += [(100, "x", day(100), "a", None, 200.0, 0.0, ""), (101, "x", day(101), "a", 20, float("nan"), 0.0, ""), (102, "x", day(102), "a", -1, None, 0.0, ""), (103, "x", day(103), "a", 99999, 110.0, 0.0, ""),
             (104, "x", day(104), "a", 0, 100.0, 0.0, ""), (105, "x", day(105), "a", 0, 0.0, 0.0, ""), (106, "x", day(106), "a", 0, -999.0, 0.0, ""), (107, "x", day(0), "a", None, 100.0, 0.0, ""), (108, None, None, None, None, None, 0.0, ""), (109, "x", day(1), "b", 11, 110.0, 0.0, "")]
    df = fill.usable_pair(spark.createDataFrame(rows, DAYS), "r", "a", "b")
    reasons = {r.id: (r.a__reason, r.b__reason) for r in df.where("id >= 100").collect()}
    assert reasons == {100: ("null", None), 101: (None, "nan"), 102: ("impossible", "null"), 103: ("absurd", None), 104: ("contradicted", None), 105: (None, None), 106: (None, "impossible"), 107: ("null", None), 108: ("null", "null"), 109: (None, None)}
    good = {c: F.when(F.col(f"{c}__reason").isNull() & (F.col(c) > 0), F.col(c)) for c in "ab"}
    known = {c: F.when(F.col(f"{c}__reason").isNull(), F.col(c)) for c in "ab"}
    rules = [
        fill.Dependency("a", ("r", "d")), fill.Dependency("b", ("r", "d")), fill.Dependency("a", ("r",)),
        fill.Dependency("a", ("r",), good["a"] / good["b"], lambda x: F.round(known["b"] * x), 0.1, "a/b"), fill.Dependency("b", ("r",), good["b"] / good["a"], lambda x: known["a"] * x, 0.1, "b/a"),
    ]
    out = fill.fill(df, ("a", "b"), rules, [fill.Fallback("a", "all", (), F.avg(known["a"]), F.round), fill.Fallback("b", "weekday", ("wd",), F.avg(known["b"]))])
    got = {r.id: (r.a__filled_value, r.a__source, r.a__filled, r.b__filled_value, r.b__source) for r in out.collect()}
    assert len(got) == len(rows) and got[0][:3] == (10, None, False) and got[105][:3] == (0, None, False) and set(out.columns) >= set(df.columns)
    assert got[100][:3] == (20, "fd:r->a/b", True) and got[103][1] == "fd:r->a/b" and got[101][4] == "fd:r->b/a" and abs(got[101][3] - 200) < 10
    assert got[107][:2] == (10, "fd:r+d")  # an exact dependency goes before a metric one
    assert got[102][1] == "group:all" and got[102][4] == "group:weekday" and got[106][3:] == (0.0, "fd:r->b/a")  # a closed day
    assert got[108][1] == "group:all" and got[108][3:] == (None, "none")


def test_dependencies_are_verified(spark):
    df = spark.createDataFrame([(1, 1, 5, None), (1, 1, 5, None), (2, 1, 6, None), (2, 1, 7, None), (3, 2, 8, None), (None, 2, 8, None), (4, 4, 99, "null"), (4, 4, 1, None)], "p int, q int, v int, v__reason string")
    rules = [fill.Dependency("v", det, within=w) for det, w in ((("p",), 0.0), (("p", "q"), 0.0), (("p",), 0.2), (("q",), 0.05))]
    e = fill.mine(df, rules)[2]
    assert [(x.groups, x.violations) for x in e] == [(2, 1), (2, 1), (2, 0), (2, 1)]
    assert not e[0].holds(0.05) and e[2].holds(0.0) and not fill.Evidence(rules[0], 0, 0).holds(1.0)


def test_large_dictionaries_are_not_broadcast(spark):
    """Their files are small (compressed, of all dictionaries), what the driver would build of them is not."""
    n = 150_000
    df = spark.range(2 * n).select((F.col("id") % n).alias("k"), F.lit("g").alias("g"), F.when((F.col("id") < n) | (F.col("id") % 3 > 0), F.col("id") % n).alias("v"))
    df = fill.keep(df.withColumn("v__reason", F.when(F.col("v").isNull(), "null")))
    out = fill.fill(df, ("v",), [fill.Dependency("v", ("k",))], [fill.Fallback("v", "g", ("g",), F.min("v"))])
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 1  # by k, and by the only g
    r = out.agg(F.count_if("v__filled").alias("filled"), F.count_if(F.col("v__filled_value") == F.col("k")).alias("right"), F.count_if(F.col("v__source") == "fd:k").alias("fd")).first()
    assert (r.filled, r.right, r.fd) == (n // 3, 2 * n, n // 3)
    assert fill._small({0: fill.BROADCAST_BYTES, 1: 5, 2: 7}) == {1, 2} and fill._small({0: 1 << 40}) == set()


def test_days_in_all_guises(spark):
    rows = [(i, "f", day(i), i) for i in range(30)] + [(40, "f", None, 30), (41, "f", D(1970, 1, 1), 31), (42, "f", D(2001, 5, 5), 32), (43, "f", D(9999, 12, 31), 33), (44, None, D(2001, 5, 5), 1), (45, "g", None, 1), (46, "f", None, 3)]
    df = fill.usable_day(spark.createDataFrame(rows, "id long, f string, d date, n long"), "f", "d").withColumns({"block": F.floor(F.col("n") / 8), "__entry0": F.lit(7), "stat0": F.lit(8)})
    assert {r.id: r.d__reason for r in df.where("id >= 40").collect()} == {40: "null", 41: "stand_in", 42: "absurd", 43: "stand_in", 44: None, 45: "null", 46: "null"}
    place = lambda x: F.date_from_unix_date((F.col("n") + F.round(x)).cast("int"))
    offset = F.when(F.col("d__reason").isNull(), F.unix_date("d") - F.col("n"))
    made = fill.fill(df, ("d",), [fill.Dependency("d", ("f", "n")), fill.Dependency("d", ("f", "block"), offset, place, label="d-n")], [fill.Fallback("d", "place", ("f",), F.avg(offset), place)])
    out = {r.id: (r.d__filled_value, r.d__source, r["__entry0"]) for r in made.collect()}
    assert out[40] == (day(30), "fd:f+block->d-n", 7) and out[43] == (day(33), "group:place", 7) and out[45] == (None, "none", 7) and out[46][:2] == (day(3), "fd:f+block->d-n")
    empty = spark.createDataFrame([], "id long, f string, d date, n long")
    assert fill.fill(fill.usable_day(empty, "f", "d"), ("d",), [fill.Dependency("d", ("f", "n"))], [fill.Fallback("d", "all", (), F.max("d"))]).collect() == []
    assert fill.fill(fill.usable_day(empty, "f", "d"), ("d",), []).collect() == []


# ------------------------------------------------------------------------------------------------ drift

RAW = "dataset string, feed string, source_file string, file_date date, received_at timestamp_ntz, line_no long, payload string, n int, no int, kind string"


def _raw(files):
    rows = []
    for n, (feed, records) in enumerate(files):
        for i, r in enumerate(records):
            rows.append(("ventas", feed, f"{feed}_{n}.json", day(n), dt.datetime(2024, 1, 1) + dt.timedelta(n), i, r if isinstance(r, str) else json.dumps(r), 0, 0, ""))
    return rows


def test_changes(spark):
    files = [("A", [{"importe": 1.5, "mesa": "1"}, {"importe": 1.5, "mesa": "1"}, '{"importe": 1']), ("A", [{"IMPORTE": None, "Mesa ": "2"}]), ("A", [{"importe_total": "1,5"}]), ("A", [{"Importe total": None, "iva": 2}]), ("A", [{"amount": {"valor": 3.0}, "iva": True}]), ("B", [{"x": 1}]), ("B", ["[1]", "null", "", "nope"]), ("B", [{"x": 1, "": 2, "--": 3}])]
    rows = _raw(files)
    rows += [(*r[:4], r[4] + dt.timedelta(9), *r[5:6], json.dumps({"late": 1}), *r[7:]) for r in rows[:1]] + [("ventas", None, "z", day(1), None, 1, '{"a": 1}', 0, 0, ""), ("ventas", "C", "c", None, None, 1, '{"a": 1}', 0, 0, ""), ("ventas", "A", "A_0.json", day(0), dt.datetime(2024, 2, 1), 9, None, 0, 0, "")]
    foot = drift.footers(drift.readable(spark.createDataFrame(rows, RAW)))
    got = {(r.source_file, r.field_name, r.change_kind) for r in drift.changes(foot).collect()}
    assert got == {("A_2.json", "importe_total", "renamed"), ("A_2.json", "importe_total", "retyped"), ("A_2.json", "mesa", "removed"), ("A_3.json", "iva", "added"), ("A_4.json", "amount", "renamed"), ("A_4.json", "amount", "retyped"), ("A_4.json", "iva", "retyped")}
    assert drift.changes(drift.footers(drift.readable(spark.createDataFrame([], RAW)))).collect() == []


def test_one_table(spark):
    files = [
        ("A", [{"articulo": 7, "Descripción": "Té", "CANTIDAD": "00012", "importe": "1.470,43", "mesa": 1}]),
        ("A", [{"codigo": " 8", "nombre_articulo": " ", "uds": 2, "amount": {"valor": 2.5, "moneda": "EUR"}, "departamento": {"cod": 3}}] * 2),
        ("A", [{"article_code": "x", "importe": [3.5, "EUR"], "units": None, "total_linea": None}]),
        ("A", [{"importe_total": "z", "importe": 4, "Importe": 5, "MESA": "a", "mesa": "b", "units": {"n": 1}}]),
    ]
    out = {r.source_file: r for r in drift.consistent(drift.records(spark.createDataFrame(_raw(files), RAW)), "ventas").collect()}
    assert len(out) == 4
    a, b, c, d = (out[f"A_{i}.json"] for i in range(4))
    assert (a.article_code, a.article_name, a.units, a.amount, a.other) == (7, "Té", 12.0, 1470.43, {"mesa": "1"})
    assert (b.article_code, b.article_name, b.units, b.amount, b.department_code) == (8, None, 2.0, 2.5, "3")
    assert {k: json.loads(v) for k, v in b.other.items()} == {"amount": {"valor": 2.5, "moneda": "EUR"}, "departamento": {"cod": 3}}
    assert (c.article_code, c.amount, c.units) == (None, 3.5, None) and c.other["article_code"] == "x" and json.loads(c.other["importe"]) == [3.5, "EUR"]
    # by the order of the alias table, then of the alphabet; what lost is kept
    assert (d.amount, d.units) == (5.0, None) and json.loads(d.other.pop("units")) == {"n": 1}
    assert d.other == {"importe_total": "z", "importe": "4", "MESA": "a", "mesa": "b"}
    assert drift.consistent(drift.records(spark.createDataFrame([], RAW)), "ventas").collect() == []


# ------------------------------------------------------------------------------------------------ history


def test_history_equals_a_fold(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, rng.choice("xy"), day(rng.randint(0, 60)), rng.choice([None, "á", "b"]), rng.choice([None, 1, 2]), rng.randint(0, 3), "clash", 0, True) for i in range(300)]
    rows += [(900, None, day(0), "q", 1, 0, "", 0, True), (901, "x", None, "q", 1, 0, "", 0, True)] + rows[:5]
    df = spark.createDataFrame(rows, "id long, e string, at date, n string, c int, g int, changed string, version int, is_checkpoint boolean")
    snaps = history.snapshots(df, ["e"], "at", ["n", "c"], ["g", "id"])
    store = history.delta_store(snaps, ["e"], "at", ["n", "c"], every=3)
    got = {(r.e, r.valid_from): (r.n, r.c, r.valid_to, tuple(r.changed)) for r in history.reconstruct(store, ["e"], ["n", "c"]).collect()}
    want = {}
    for e in "xy":
        state, versions = {"n": None, "c": None}, []
        for at in sorted({r[2] for r in rows if r[1] == e and r[2]}):
            seen = sorted((r for r in rows if r[1] == e and r[2] == at), key=lambda r: (r[5], r[0]))
            new = {"n": next((r[3] for r in reversed(seen) if r[3] is not None), None), "c": next((r[4] for r in reversed(seen) if r[4] is not None), None)}
            changed = tuple(a for a in ("n", "c") if new[a] is not None and state[a] is not None and new[a] != state[a])
            fresh = any(new[a] is not None and state[a] is None for a in ("n", "c"))
            state = {a: state[a] if new[a] is None else new[a] for a in state}
            if changed or fresh or not versions:
                versions.append([at, state["n"], state["c"], changed])
        for v, nxt in zip(versions, [*versions[1:], None]):
            want[e, v[0]] = (v[1], v[2], nxt[0] - dt.timedelta(1) if nxt else None, v[3])
    assert got == want
    full = {(r.e, r.version): r for r in store.collect()}
    assert all((r.kind == "checkpoint") == (v % 3 == 0) and r.segment == v // 3 for (_, v), r in full.items())
    assert any(r.kind == "patch" and r.n is None for r in full.values())
    empty = history.snapshots(df.limit(0), ["e"], "at", ["n", "c"], ["g", "id"])
    nothing = history.write_store(history.delta_store(empty, ["e"], "at", ["n", "c"]), str(tmp_path / "empty"))
    assert history.reconstruct(nothing, ["e"], ["n", "c"]).collect() == []
    written = history.write_store(store, str(tmp_path / "store"))
    assert {p.name for p in (tmp_path / "store").iterdir() if p.is_dir()} == {"kind=checkpoint", "kind=patch"}
    again = {(r.e, r.valid_from): (r.n, r.c, r.valid_to, tuple(r.changed)) for r in history.reconstruct(written, ["e"], ["n", "c"]).collect()}
    assert again == want
    lost = next(k for k, r in sorted(full.items()) if r.kind == "patch" and k[1] % 3 == 1)
    without = history.reconstruct(store.where(f"not (e = '{lost[0]}' and version = {lost[1]})"), ["e"], ["n", "c"]).collect()
    assert {(r.e, r.valid_from): (r.n, r.c, r.valid_to, tuple(r.changed)) for r in without if r.e == lost[0]} != {k: v for k, v in want.items() if k[0] == lost[0] and k[1] != full[lost].valid_from}


def test_a_store_grown_in_steps_equals_one_made_at_once(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice("xyz"), day(rng.randint(0, 90)), rng.choice([None, "á", "A", "b"]), rng.choice([None, 1, 2])) for i in range(260)]
    df = spark.createDataFrame(rows, "id long, e string, at date, n string, c int")
    how = {"n": F.lower(F.col("n"))}
    snaps = lambda d: history.snapshots(d, ["e"], "at", ["n", "c"], ["id"])
    key = lambda r: (r.e, r.version)
    whole = sorted(history.delta_store(snaps(df), ["e"], "at", ["n", "c"], how, every=3).collect(), key=key)
    path = str(tmp_path / "grown")
    grown = history.write_store(history.delta_store(snaps(df.where(F.col("at") < day(30))), ["e"], "at", ["n", "c"], how, every=3), path)
    for a, b in ((30, 61), (61, 99)):
        part = snaps(df.where((F.col("at") >= day(a)) & (F.col("at") < day(b))))
        new, late = history.append(grown, part, ["e"], "at", ["n", "c"], how, every=3)
        assert late.count() == 0
        grown = history.write_store(new.select(*grown.columns), path, "append")
    assert [tuple(r) for r in sorted(grown.collect(), key=key)] == [tuple(r) for r in whole]
    new, late = history.append(grown, snaps(df), ["e"], "at", ["n", "c"], how, every=3)
    reached = {e: max(r.valid_from for r in whole if r.e == e) for e in "xyz"}
    assert new.count() == 0 and {(r.e, r["at"]) for r in late.collect()} == {(r[1], r[2]) for r in rows if r[2] <= reached[r[1]]}


# ------------------------------------------------------------------------------------------------ trailing sums


@pytest.mark.parametrize("windows", [[1], [7, 30], [2, 3, 64]])
def test_trailing_sums_equal_plain_sums(spark, windows):
    rng = random.Random(4)
    rows = [(rng.choice("xy"), day(rng.randint(0, 90)), rng.choice([None, 1, 2, -3]), float(rng.randint(0, 9)), "s", 1) for _ in range(70)] + [(None, day(1), 1, 1.0, "", 0), ("x", None, 1, 1.0, "", 0), ("z", day(3), None, 2.0, "", 0)]
    df = spark.createDataFrame(rows, "e string, d date, v long, m double, s string, e0 int")
    out = rolling.trailing_sums(df, ["e"], "d", {"v": F.col("v"), "m": F.col("m")}, windows)
    cols = [f"{k}_{w}" for k in "vm" for w in windows]
    got = {(r.e, r.on_day): tuple(r[c] for c in cols) for r in rolling.unfold(out, ["e"], cols).collect()}
    by = defaultdict(lambda: [0, 0.0])
    for e, d, v, m, *_ in rows:
        if e and d:
            by[e, d][0] += v or 0
            by[e, d][1] += m
    want = {}
    for e in "xyz":
        days = [d for x, d in by if x == e]
        for k in range((max(days) - min(days)).days + 1):
            on = min(days) + dt.timedelta(k)
            want[e, on] = tuple(sum(by[e, on - dt.timedelta(j)][i] for j in range(w) if (e, on - dt.timedelta(j)) in by) for i in (0, 1) for w in windows)
    assert got == want


def test_latest_version_wins_with_ties(spark):
    rows = [("x", 1, None, 1, 5), ("x", 1, 3, 1, 6), ("x", 1, 3, 2, None), ("y", 1, None, 1, 7)]
    df = spark.createDataFrame(rows, "e string, k int, at int, id int, v int")
    assert {(r.e, r.v) for r in rolling.latest_versions(df, ["e", "k"], ["at", "id"], ["v"]).collect()} == {("x", None), ("y", 7)}
    none = spark.createDataFrame([], "e string, d date, v int")
    assert rolling.trailing_sums(none, ["e"], "d", {"v": F.col("v")}, [7]).collect() == []
    with pytest.raises(ValueError):
        rolling.trailing_sums(df, ["e"], "d", {"v": F.col("v")}, [0])


def test_fill_accuracy_on_hidden_values(spark):
    from almazara.plans import data_problems as P

    sf = "/root/testdata/sf0.01"

    def hide(df, target, key):
        known = (F.xxhash64(key) % 20 == 0) & F.col(f"{target}__reason").isNull()
        return df.withColumn("truth", F.when(known, F.col(target))).withColumn(f"{target}__reason", F.when(known, "hidden").otherwise(F.col(f"{target}__reason")))

    for target in ("num_tickets", "facturacion"):
        out = P._fill_daily(hide(P._daily_rows(spark, sf), target, "diaria_id")).where("truth is not null")
        r = out.agg((F.sum(F.abs(F.col(f"{target}__filled_value") - F.col("truth"))) / F.sum("truth")).alias("wape"), F.count_if(F.col(f"{target}__filled_value").isNull()).alias("lost"), F.avg(F.col(f"{target}__source").startswith("fd:").cast("int")).alias("fd")).first()
        assert r.wape < 0.1 and r.lost == 0 and r.fd > 0.5
    out = P._fill_weather(hide(P._weather_rows(spark, sf), "date", "md_id")).where("truth is not null")
    r = out.agg(F.avg((F.col("truth") == F.col("date__filled_value")).cast("int")).alias("right"), F.avg(F.col("date__source").startswith("fd:").cast("int")).alias("fd")).first()
    assert r.right > 0.95 and r.fd > 0.5


def test_hourly_weather_takes_every_readable_hour_on_its_local_day(spark, tmp_path):
    """Brute force by Python's zone database: ISO, offsets, Z, epoch milliseconds and day-first times, one unreadable."""
    zone = ZoneInfo("Atlantic/Canary")
    at = dt.datetime(2024, 7, 1, 0, 30, tzinfo=zone)
    texts = ["2024-07-01T00:30", "2024-06-30T23:30:00Z", "2024-07-01T01:30:00+02:00", str(int(at.timestamp() * 1000)), "01/07/2024 00:30", "2024-06-30 22:00", "no time", None]
    days = [at.date()] * 5 + [dt.date(2024, 6, 30)]
    schema = "mh_id long, source_file string, row_no long, event_location string, time string, temperature_2m double, rain_mm double, timezone string"
    spark.createDataFrame([(i, "f.csv", i, "here", t, float(i), 1.0 if i else float("nan"), None if i == 1 else "Atlantic/Canary") for i, t in enumerate(texts)], schema).write.parquet(str(tmp_path / "meteo_horaria.parquet"))
    spark.createDataFrame([("r", "here", "Atlantic/Canary")], "restaurant string, event_location string, timezone string").write.parquet(str(tmp_path / "locales.parquet"))
    want = {d: (sum(1.0 for i, x in enumerate(days) if x == d and i), sum(i for i, x in enumerate(days) if x == d) / days.count(d)) for d in set(days)}
    got = {r.date: (r.rain_mm, r.temperature_2m) for r in reference_queries.daily_weather_hourly(spark, str(tmp_path)).collect()}
    assert got == want
