"""Findings list a bounded number of members, relations all of them."""

from pyspark.sql import functions as F

from auditloom.operators import ranking, shadowing


def test_a_name_on_very_many_servers(spark):
    many = spark.range(1500).select(F.format_string("s%04d", "id").alias("server"), F.lit("read").alias("name"), (F.col("id") % 2).cast("string").alias("description"), F.lit(0).alias("ord"))
    odd = spark.createDataFrame([("a", "one", "x", 0), ("a", "one", "x", 1), ("b", "two", None, 0), ("c", "two", None, 0), (None, "two", "y", 0), ("d", None, "z", 0), ("e", None, "z", 0)], "server string, name string, description string, ord int")
    tools = many.unionByName(odd)
    found = {r.name: r for r in shadowing.name_collisions(tools).collect()}
    assert found.keys() == {"read", "two", None}
    assert found["read"].servers == [f"s{i:04d}" for i in range(shadowing.LISTED)] and (found["read"].n_servers, found["read"].n_descriptions, found["read"].severity) == (1500, 2, "high")
    assert (found["two"].servers, found["two"].n_servers, found["two"].severity) == (["b", "c"], 2, "medium") and found[None].servers == ["d", "e"]
    members = [(r.name, r.server) for r in shadowing.collision_members(tools).collect()]
    assert sorted(members, key=str) == sorted([("read", f"s{i:04d}") for i in range(1500)] + [("two", "b"), ("two", "c"), (None, "d"), (None, "e")], key=str)


def test_a_key_with_very_many_spellings(spark):
    spelled = spark.range(400).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("server"), F.concat(F.lit("read"), F.repeat(F.lit("_"), F.col("id").cast("int")), F.lit("file")).alias("name"))
    rows = shadowing.near_duplicate_names(spelled.unionByName(spark.createDataFrame([("x", "a_b"), ("x", "ab"), ("y", None), ("z", "only"), ("w", "only")], "server string, name string"))).collect()
    assert len(rows) == 1 and rows[0].key == "readfile"
    names = sorted("read" + "_" * i + "file" for i in range(400))
    assert rows[0].names == names[: shadowing.LISTED] and rows[0].servers == sorted(f"s{i}" for i in range(400))[: shadowing.LISTED]


def test_least_members_limits_before_the_shuffle(spark):
    listed = ranking.least_members(spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (1, None), (2, "c"), (None, "d")], "k int, m string"), "k", "m", 1)
    assert sorted(((r.k, r.ms) for r in listed.collect()), key=str) == [(1, ["a"]), (2, ["c"]), (None, ["d"])]
    assert "WindowGroupLimit" in listed._jdf.queryExecution().toString()
