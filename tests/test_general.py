"""Heavy keys, packed fields, broken references: defined results for nulls, ties, repeated rows, empty tables, extra columns."""

import datetime as dt
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from strandmill.operators import packed as P
from strandmill.operators import skew as S
from strandmill.operators.orphans import Source, Target, broken_references, broken_report, reference_key

T = dt.datetime


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_heavy_keys_count_nulls_and_repeats(spark):
    data = [("a", "x")] * 3 + [("b", None)] * 1 + [(None, "x")] * 96
    df = spark.createDataFrame(data, "m string, g string").withColumn("field", F.lit("clash")).withColumn("n_rows", F.lit(7))
    assert rows(S.heavy_keys(df, ["m", "g"], 3).select("field", "key_value")) == [("g", "x"), ("m", "a")]
    assert S.heavy_keys(df.limit(0), ["m", "g"], 3).count() == 0


def test_per_key_matches_brute_force(spark):
    rng = random.Random(5)
    data = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice(["p", "q", None]), rng.randint(0, 9)) for _ in range(500)]
    df = spark.createDataFrame(data, "m string, s string, v int")
    got = {r.key_value: (r.n_rows, r.total, r.kinds) for r in S.per_key(df, ["m"], {"total": F.sum("v")}, {"kinds": F.col("s")}).collect()}
    want = {}
    for m in {d[0] for d in data}:
        mine = [d for d in data if d[0] == m]
        want[m] = (len(mine), sum(d[2] for d in mine), len({d[1] for d in mine} - {None}))
    assert got == want


def test_salted_join_equals_plain_join(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(200)] + [(999, None)], "i int, k string")
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("k6", 3), ("zzz", 4)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(S.salted_join(left, right, "k", how, F.col("i"), salts=4)) == rows(left.join(right, "k", how))
    assert S.hot_keys(left, F.col("k")) == ["hot"]
    assert S.hot_fields(left, {"k": F.col("k")})["k"] == ["hot"]


PACKED = [
    ("1;2;3", ["1", "2", "3"]),
    ("  99069082 ", ["99069082"]),
    ('["83833034", "86329427"]', ["83833034", "86329427"]),
    ('"91425084 | 88548611 | 83834984"', ["91425084", "88548611", "83834984"]),
    ("PMID:87949017,81048348", ["PMID:87949017", "81048348"]),
    (",80142458; 97816340 / 94803828\t94879664 96954733；87848718", ["80142458", "97816340", "94803828", "94879664", "96954733", "87848718"]),
    ('"6680:91059412" | "row ""2""; page 13"', ["6680:91059412", 'row "2"; page 13']),
    ("'789:81837007,584:96686358'", ["789:81837007", "584:96686358"]),
    ('["plate 1/73"]', ["plate 1/73"]),
    ('["table 3, line 75", "6581:96586339"]', ["table 3, line 75", "6581:96586339"]),
    ("93098196\n'98643140'\t91130746,", ["93098196", "98643140", "91130746"]),
    ('"6576:89262109"; ;"row ""5""; page 32"', ["6576:89262109", 'row "5"; page 32']),
    ("-", []),
    ("NA", []),
    ("", []),
    (None, []),
    ("12;-;NA;;13", ["12", "13"]),
]


def test_packed_fields(spark):
    filler = [(f"f{i}", f"{i}:8{i}; {i + 1}:9{i}" if i % 2 else f'"{i}:8{i}"') for i in range(200)] + [(f"w{i}", f'"table {i}, line {i}"') for i in range(10)]
    data = [(f"k{i}", raw) for i, (raw, _) in enumerate(PACKED)]
    df = spark.createDataFrame(data + data[:3] + filler, "id string, refs string").withColumn("tbl", F.lit("clash")).withColumn("raw", F.lit(1))
    got = {}
    for r in P.split_packed(P.packed_fields([("t", df, "id", ["refs"])])).collect():
        assert (r.tbl, r.field) == ("t", "refs")
        got.setdefault(r.row_key, {})[r.pos] = r.item
    for i, (_, want) in enumerate(PACKED):
        mine = got.get(f"k{i}", {})
        assert [mine[p] for p in sorted(mine)] == want and sorted(mine) == list(range(1, len(want) + 1)), PACKED[i]
    assert P.split_packed(P.packed_fields([("t", df.limit(0), "id", ["refs"])])).count() == 0


def test_packed_round_trip_random_dialects():
    rng = random.Random(7)
    code = P.ValueCode({("kind", "ref"): 9000, ("kind", "words"): 200, ("symbol", "a"): 1500, ("symbol", "0"): 400, ("symbol", " "): 600, ("symbol", "end"): 200})
    for _ in range(300):
        vals = [str(rng.randint(10**6, 10**8)) for _ in range(rng.randint(1, 8))]
        sep = rng.choice([";", ",", "|", "/", "、", "；", "，", "\t", "\n", " ", "; ", " | "])
        quote = rng.choice(["", '"', "'"])
        text = sep.join(f"{quote}{v}{quote}" for v in vals)
        assert P.values(text, P.choose(P.outline(text), code), code) == vals, text


def test_very_long_packed_field_is_linear():
    code = P.ValueCode({("kind", "ref"): 100})
    text = ";".join(str(10**7 + i) for i in range(40_000))
    assert len(P.values(text, P.choose(P.outline(text), code), code)) == 40_000


def brute_broken(refs, parents):
    spans = {}
    for key, since, until in parents:
        spans.setdefault(key, []).append((since, until))
    out = set()
    for field, row, at, ref in refs:
        if ref is None or ref.strip() in ("", "-", "NA"):
            continue
        k = ref.strip()
        k = k.split(":", 1)[0].lower() + ":" + k.split(":", 1)[1] if ":" in k else k
        month = at.strftime("%Y-%m") if at else None
        if k not in spans:
            out.add((field, row, month, "missing"))
        elif at:
            begun = [(s, u) for s, u in spans[k] if s is None or s <= at]
            if not begun:
                out.add((field, row, month, "late"))
            elif all(u is not None and u <= at for _, u in begun):
                out.add((field, row, month, "deleted"))
    return out


def test_broken_references_against_brute_force(spark):
    rng = random.Random(3)
    day = lambda n: T(2025, 1, 1) + dt.timedelta(days=n)
    parents = [(f"x:{i}", day(rng.randint(0, 60)) if i % 9 else None, day(rng.randint(30, 200)) if i % 4 == 0 else None) for i in range(40)]
    parents += parents[:5]
    parents += [(f"x:{i % 12}", day(rng.randint(0, 200)), day(rng.randint(30, 220)) if i % 5 else None) for i in range(50)]  # keys that come and go, one of them hot
    shapes = ["X:{0}", "x:{0}", " X:{0}", "x:{0}\t", "x:{0}-y"]
    refs = []
    for i in range(400):
        n = 0 if i % 3 == 0 else rng.randint(0, 45)  # one key holds a third
        ref = rng.choice(shapes).format(n) if i % 11 else rng.choice([None, "", "-", "NA", " "])
        refs.append((f"r{i}", None if i % 50 == 49 else day(rng.randint(0, 220)), ref))
    refs += refs[:20]
    nodes = spark.createDataFrame([(k.upper() if n % 2 else k, a, r) for n, (k, a, r) in enumerate(parents)], "id string, a timestamp, r timestamp").withColumn("key", F.lit("clash"))
    table = spark.createDataFrame(refs, "row string, t timestamp, s string").withColumn("target_key", F.lit(1))
    src, tgt = [Source("tab", table, "row", "t", {"s": "node"})], [Target("node", nodes, "id", "a", "r")]
    got = {(r.field, r.row_key, r.ref_period, r.reason) for r in broken_references(src, tgt).collect()}
    assert got == brute_broken([("s", a, b, c) for a, b, c in refs], parents)
    assert sum(r.n for r in broken_report(src, tgt).collect()) == len(got)
    assert broken_references([Source("tab", table.limit(0), "row", "t", {"s": "node"})], tgt).count() == 0
    none = broken_references(src, [Target("node", nodes.limit(0), "id", "a", "r")])
    assert {r.reason for r in none.collect()} == {"missing"}


def test_parent_removed_and_added_again(spark):
    nodes = spark.createDataFrame([("A", T(2025, 1, 1), T(2025, 2, 1)), ("A", T(2025, 6, 1), None)], "id string, a timestamp, r timestamp")
    refs = spark.createDataFrame([("r1", T(2025, 1, 15), "A"), ("r2", T(2025, 3, 1), "A"), ("r3", T(2025, 7, 1), "A"), ("r4", T(2024, 7, 1), "A"), ("r5", None, "A"), ("r6", None, "B")], "row string, t timestamp, s string")
    got = rows(broken_references([Source("tab", refs, "row", "t", {"s": "n"})], [Target("n", nodes, "id", "a", "r")]).select("row_key", "reason"))
    assert got == [("r2", "deleted"), ("r4", "late"), ("r6", "missing")]


def test_reference_key(spark):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in ("MeSH:D1", " mesh:D1\t", "E-aB", "-", None)], "x string").select(reference_key(F.col("x"))).collect()]
    assert got == ["mesh:D1", "mesh:D1", "E-aB", None, None]


def test_no_forbidden_calls():
    import pathlib

    root = pathlib.Path(__file__).resolve().parent.parent / "strandmill"
    for p in root.rglob("*.py"):
        assert "localCheckpoint" not in p.read_text(), p


@pytest.mark.parametrize("unit", ['"a;', '"12345", ', "word and more; ", '"', "'1' | "])
def test_packed_parse_is_linear(unit):
    code = P.ValueCode({("kind", "ref"): 9000, ("kind", "words"): 200, ("symbol", "a"): 1500})

    def took(n):
        text = unit * (n // len(unit))
        began = time.process_time()
        P.values(text, P.choose(P.outline(text), code), code)
        return time.process_time() - began

    took(20_000)
    assert took(400_000) < 40 * max(took(40_000), 0.01)  # ten times as long; a quadratic parse would take a hundred times


@pytest.mark.parametrize("text", ["x" * 50, "((", '"', "'a", '["', "a''b"])
def test_odd_packed_texts_do_not_fail(text):
    code = P.ValueCode({})
    assert isinstance(P.values(text, P.choose(P.outline(text), code), code), list)
    assert re.sub(r"\d+", "0", text) == P.outline(text)
