"""Table functions, relaxed wishes, shards and state: edge cases, lost tasks, restarts."""

import json
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from partlake.functions import tables
from partlake.operators import relaxation
from partlake.plans import tools
from partlake.sources import shards
from partlake.streaming import recent


# --- table functions --------------------------------------------------------------------
def test_table_functions(spark):
    arrangements = spark.createDataFrame([(1, 5, 10.0), (2, 9, 20.0), (3, 30, None)], "id long, n_signal long, amps double")
    definitions = spark.createDataFrame([("finish", "W", "olive"), ("finish", "F", "nickel"), ("class", "W", "x")], "category string, code string, meaning string")
    catalog = spark.createDataFrame([("a",), ("a",), ("b",)], "vendor string")
    texts = spark.createDataFrame([(1, "A.b a.B"), (2, "axb"), (3, None)], "id long, text string")
    names = tables.register(spark, {"arrangements": arrangements, "definitions": definitions, "catalog": catalog, "texts": texts})
    assert len(names) == 6

    def rows(sql):
        return sorted(tuple(r) for r in spark.sql(sql).collect())

    assert rows("SELECT id FROM search_arrangements(6, NULL)") == [(2,), (3,)]
    assert rows("SELECT q.x, a.id FROM VALUES (1), (9) q(x), LATERAL search_arrangements(q.x, q.x + 4) a") == [(1, 1), (9, 2)]
    assert rows("SELECT * FROM lookup_definition('FINISH', 'w')") == [("W", "olive")]
    assert rows("SELECT * FROM list_manufacturers()") == [("a", 2), ("b", 1)]
    assert rows("SELECT * FROM search_documents('a.B')") == [(1, 2)]
    got = dict((f, c) for f, c, _ in rows("SELECT * FROM decode_part_number('d38999/26 wb-35 PN')"))
    assert got == {"series": "III", "sheet": "26", "class": "W", "size": "B", "insert": "35", "contact": "P", "key": "N"}
    assert rows("SELECT meaning FROM decode_part_number('D38999/26WB35P') WHERE field = 'size'") == [("11",)]
    errors = [rows(f"SELECT field, meaning FROM decode_part_number('{t}')") for t in ("x", "D38999/99WB35PN", "D38999/26??")]
    assert errors[:2] == [[("error", "not a pin")], [("error", "unsupported sheet")]] and errors[2][0][0] == "error"
    assert rows("SELECT * FROM decode_part_number(NULL)") == []
    assert rows("SELECT signal FROM pin_table('uart', 1)") == [("GND",), ("RX",), ("TX",)]
    assert rows("SELECT * FROM pin_table('lamp', 2)") == [("lamp #1", "22D"), ("lamp #2", "22D")]
    assert rows("SELECT * FROM pin_table('uart', NULL)") == []


# --- wishes -----------------------------------------------------------------------------
def plain_branch(i, s):
    """The ladder in words."""
    i, s = (i or "").lower().strip(), (s or "").lower().strip()
    any_ = lambda *ws: any(w in i for w in ws)
    ethernet = any_("ethernet", "rj45", "cat5", "cat6", "1000base", "100base", "10gbase", "gigabit")
    fast = "10g" in i or "10g" in s or "cat6a" in s or any_("high-speed", "high_speed", "highspeed")
    if any_("hdmi"):
        return "hdmi"
    if any_("displayport", "dp"):
        return "displayport"
    if fast:
        return "fast_ethernet" if ethernet else "fast"
    if ethernet:
        return "ethernet"
    if any_("usb", "type-c", "type_c"):
        return "usb_c" if any_("usb-c", "usb_c", "type-c", "type_c") else "usb3" if any_("usb3", "usb 3", "superspeed") or "3" in s else "usb"
    return "any"


def plain_serves(branch, i, f):
    i, f = (i or "").lower(), (f or "").lower()
    fast = "10g" in i or "high-speed" in i or "speedmaster" in f or "machforce" in f
    ethernet = "ethernet" in i or "rj45" in i
    return {
        "hdmi": "hdmi" in i, "displayport": "displayport" in i or "dp" in f, "fast_ethernet": fast or ethernet, "fast": fast, "ethernet": ethernet,
        "usb": "usb" in i, "usb_c": "usb" in i and ("usb-c" in i or "usb 3.2" in i or "usb3cftv" in f), "usb3": "usb" in i and not ("2.0" in i and "3" not in i), "any": True,
    }[branch]


def test_relax(spark):
    rng = random.Random(3)
    asked = ["ethernet", "RJ45", "10gbase", "usb", "usb3", "USB-C", "type_c", "hdmi", "mini dp", "highspeed", "lamp", "", None]
    faces = ["Ethernet", "RJ45 Cat6", "10G Ethernet", "USB 2.0", "USB 2.0 / 3.0", "USB 3.2", "USB-C", "HDMI", "DisplayPort", "high-speed", None]
    requests = [(k, rng.choice(asked), rng.choice(["", "10g", "cat6a", "3.0", None]), rng.choice(["a", "b", "c", None]), rng.choice([None, 1, 2, 3])) for k in range(80)]
    families = [(f"m{k}", rng.choice(faces), rng.choice(["x", "dp1", "usb3cftv", "speedmaster", None]), rng.choice("ab"), rng.randint(0, 3)) for k in range(25)]
    r = spark.createDataFrame(requests, "request int, interface string, speed string, vendor string, least int").withColumn("branch", relaxation.branch("interface", "speed"))
    f = spark.createDataFrame(families, "name string, face string, family string, maker string, size int").withColumn("served", relaxation.branches_served("face", "family"))
    wishes = {"vendor": F.col("maker") == F.col("vendor"), "size": F.col("size") >= F.col("least")}
    for bound in (1000, 0):
        got = defaultdict(set)
        for x in relaxation.relax(r, f, wishes, broadcast_rows=bound).collect():
            got[x.request].add((x.name, x.depth, tuple(x.given_up) if x.given_up is not None else None))
        for k, i, s, vendor, least in requests:
            able = [(n, [vendor is None or m == vendor, least is None or z >= least]) for n, face, fam, m, z in families if plain_serves(plain_branch(i, s), face, fam)]
            depth = {n: next((d for d, ok in enumerate(met) if not ok), 2) for n, met in able}
            best = max(depth.values(), default=None)
            stay = [(n, met) for n, met in able if depth[n] == best]
            up = tuple(w for j, w in enumerate(("vendor", "size")) if not all(met[j] for _, met in stay))
            assert got[k] == ({(n, best, up) for n, _ in stay} if stay else {(None, None, None)}), (k, i, s)


# --- shards -----------------------------------------------------------------------------
SHARD = "k long, t string, x double, a array<int>"


def shard_rows():
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "", "é\n\"q\"", "x" * rng.randint(0, 300)]), rng.choice([None, 1.5]), rng.choice([None, [], [1, 2]])) for i in range(500)]
    return rows + [(900, "y" * 5000, None, None)]


def test_shards(spark, tmp_path):
    rows, path = shard_rows(), f"file://{tmp_path}/s"
    df = spark.createDataFrame(rows, SHARD).repartition(5)
    shards.write_shards(df, path, "partNumbers", ["k"], 2000, {"title": "é"})
    index = json.load(open(f"{tmp_path}/s/index.json"))
    meta = index[shards.META]
    assert index["title"] == "é" and meta["record_count"] == len(rows) and meta["shard_count"] == len(meta["shards"]) > 10
    assert set(os.listdir(tmp_path / "s")) - {f for f in os.listdir(tmp_path / "s") if f.startswith(".")} == {"index.json", *meta["shards"]}
    keys = []
    for s in meta["shards"]:
        body = open(f"{tmp_path}/s/{s}", "rb").read()
        records = json.loads(body)
        assert s.startswith("part_numbers_") and (len(body) <= 2000 or len(records) == 1)
        keys += [r["k"] for r in records]
    assert keys == sorted(r[0] for r in rows)  # the order over all shards
    norm = lambda r: (r[0], r[1], r[2], tuple(r[3]) if r[3] is not None else None)
    assert sorted(norm(r) for r in shards.read_shards(spark, path, SHARD).collect()) == sorted((norm(r) for r in rows))
    # a shorter table replaces it, and what a lost task left goes with it
    open(tmp_path / "s" / "part_numbers_000009_00000-lost.json", "w").write("[{")
    shards.write_shards(df.where("k < 3"), path, "partNumbers", ["k"], 2000)
    assert sorted(r.k for r in shards.read_shards(spark, path, SHARD).collect()) == [0, 1, 2]
    assert len([f for f in os.listdir(tmp_path / "s") if f.endswith(".json")]) == 1 + shards.read_index(path)[shards.META]["shard_count"]
    shards.write_shards(df.limit(0), path, "partNumbers", ["k"])
    assert shards.read_shards(spark, path, SHARD).collect() == []


def test_failed_write_leaves_the_old_table(spark, tmp_path):
    """A task that fails: no file of the new write is listed or stays, the index is the old one."""
    path = f"file://{tmp_path}/s"
    df = spark.createDataFrame([(i, "x" * 50, None, None) for i in range(100)], SHARD)
    shards.write_shards(df, path, "rows", ["k"], 500)
    before = sorted(f for f in os.listdir(tmp_path / "s") if f.endswith(".json"))
    bad = df.withColumn("t", F.when(F.col("k") == 99, F.raise_error(F.lit("lost"))).otherwise(F.col("t")))
    with pytest.raises(Exception, match="lost"):
        shards.write_shards(bad, path, "rows", ["k"], 500)
    assert sorted(r.k for r in shards.read_shards(spark, path, SHARD).collect()) == list(range(100))
    assert set(before) <= set(os.listdir(tmp_path / "s"))


def test_bundle_and_lists(spark, tmp_path):
    a = spark.createDataFrame([(2, "x"), (1, "y"), (3, "x"), (4, None)], "k int, n string")
    with pytest.raises(FileNotFoundError, match="missing: b, c"):
        shards.write_bundle({"a": (a, ["k"]), "c": (None, []), "b": (None, [])}, f"{tmp_path}/b")
    assert not os.path.exists(f"{tmp_path}/b")
    shards.write_bundle({"a": (a, ["k"]), "z": (a.limit(0), ["k"])}, f"{tmp_path}/b")
    index = json.load(open(f"{tmp_path}/b/index.json"))
    assert index["a"]["record_count"] == 4 and index["z"]["record_count"] == 0
    shards.write_details_and_list(a, f"{tmp_path}/d", "k", "n")
    listed = shards.read_shards(spark, f"{tmp_path}/d/list", "n string, __key int").orderBy("__key").collect()
    assert [r.n for r in listed] == ["y", "x"] and shards.read_index(f"{tmp_path}/d/details")["count"] == 4


# --- state ------------------------------------------------------------------------------
def plain_recent(rows, cap):
    """Prepend, drop the earlier one, cut; toggle pins."""
    lists, pins = defaultdict(list), defaultdict(set)
    for user, _, name, pin in sorted(rows, key=lambda r: r[1]):
        if user is None or name is None:
            continue
        if pin:
            pins[user] ^= {name}
        else:
            lists[user] = [name, *[x for x in lists[user] if x != name]][:cap]
    users = set(lists) | {u for u, p in pins.items() if p}
    return {u: sorted(pins[u]) + [n for n in lists[u] if n not in pins[u]] for u in users}


def test_recent_lists_over_restarts(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, 3, None]), i, rng.choice(["a", "b", "c", "d", "e", "f", None]), rng.choice([True, False, False, None])) for i in range(200)]
    schema = "user_id long, at long, name string, pin boolean"
    source, sink, state = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    seen = []
    for part in (rows[:50], rows[120:], rows[50:120]):  # later rows first: the order of arrival does not matter
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(source)
        seen += part
        tools.run_recent(spark, spark.createDataFrame([], schema).schema, source, sink, state, cap=4)  # a new query, from the checkpoint
        got = defaultdict(list)
        for r in recent.latest_lists(spark.read.schema(recent.OUT).parquet(sink)).orderBy("user_id", "place").collect():
            got[r.user_id].append(r.name)
        if part is not rows[120:]:
            assert dict(got) == {u: x for u, x in plain_recent(seen, 4).items() if x}

