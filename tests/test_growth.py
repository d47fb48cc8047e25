"""Steps whose work must not grow faster than their tables: many rows that share keys."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from hustings.operators import guide, identity, split


def test_results_of_one_race_with_many_namesakes(spark):
    """Two billion pairs of rows, six of names."""
    k = F.col("id")
    listed = spark.range(45000).select(F.lit(1).alias("race_id"), k.alias("cand_id"), F.when(k % 3 == 0, "ann").otherwise("al").alias("first"), F.when(k % 2 == 0, "j").alias("middle"), F.lit("lee").alias("last"))
    feed = spark.range(45000).select(F.lit(1).alias("race_id"), k.alias("position"), F.when(k % 2 == 0, "ann").alias("first"), F.lit(None).cast("string").alias("middle"), F.lit("lee").alias("last"))
    begun = time.time()
    got = {r.position: r.cand_id for r in guide.match_results(listed, feed).where("cand_id is not null").collect()}
    assert time.time() - begun < 20
    assert got == {0: 3, 1: 0}


def test_printed_surnames_with_many_members(spark):
    k = F.col("id")
    text = lambda c: F.concat(F.lit("n"), c.cast("string"))
    members = spark.range(40000).select(k.alias("member_key"), text(F.when(k < 2, k).otherwise(9)).alias("surname"), F.lit("A").alias("chamber"), (k % 2 == 0).alias("current"))
    members = members.unionByName(members.where("member_key = 0"))
    names = spark.range(40000).select(k.alias("name_id"), text(F.when(k < 3, k).otherwise(9)).alias("surname"), F.when(k < 40, "A").otherwise(F.lit("B")).alias("chamber"))
    begun = time.time()
    got = {r.name_id: (r.member_key, r.stage, r.status) for r in identity.staged(names, members).collect()}
    assert time.time() - begun < 20
    assert [got[i] for i in (0, 1, 2, 3, 50)] == [(0, 1, "found"), (1, 2, "found"), (None, None, "unknown"), (None, 1, "ambiguous"), (None, 3, "ambiguous")]


def test_candidates_and_officials_of_one_name(spark):
    k = F.col("id")
    officials = spark.range(40000).select(k.alias("official_key"), F.when(k == 7, "Alexander Roe").otherwise(F.lit("Ann Lee")).alias("name"), F.lit("ny").alias("state"), F.lit(None).cast("string").alias("bioguide"), F.array(F.lit("s1")).alias("seats"))
    officials = officials.unionByName(officials.where("official_key = 7"))
    candidates = spark.range(40000).select(k.alias("cand_key"), F.when(k == 1, "Alexander Roe").when(k == 2, "Alex Roe").otherwise(F.lit("Ann Lee")).alias("name"), F.lit("ny").alias("state"), F.lit(None).cast("string").alias("bioguide"), (k % 2 == 0).alias("incumbent"), F.array(F.lit("s1")).alias("seats"))
    begun = time.time()
    got = {r.cand_key: (r.official_key, r.tier) for r in identity.match_officials(candidates, officials).collect()}
    assert time.time() - begun < 25
    assert [got[i] for i in (1, 2, 3, 4)] == [(7, "name"), (7, "seat"), (None, "ambiguous"), (None, "ambiguous")]


def test_unmatched_candidates_are_dealt_out(spark):
    k = F.col("id")
    matches = spark.range(4000).select(k.alias("cand_key"), F.when(k < 4, k % 2).alias("official_key"), F.lit("none").alias("tier"))
    races = spark.range(4000).select(k.alias("cand_key"), F.when(k % 100 != 0, 1).alias("race_id"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = identity.one_per_race(matches, races).withColumn("at", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert {r.cand_key: r.official_key for r in got if r.cand_key < 5} == {0: 0, 1: 1, 2: 0, 3: None, 4: None}
    assert len({r.at for r in got}) == 4


def test_printed_names_with_many_namesakes(spark):
    k = F.col("id")
    members = spark.range(40000).select(k.alias("member_key"), F.when(k == 5, "Zoe").otherwise(F.lit("Ann")).alias("given"), F.lit("Lee").alias("family"), F.when(k == 6, "D").otherwise(F.lit("R")).alias("party"), F.lit("A").alias("chamber"))
    members = members.unionByName(members.where("member_key in (5, 6)"))
    names = spark.range(40000).select(k.alias("name_id"), F.lit("A").alias("chamber"), F.when(k == 1, "Zoe Lee").when(k == 2, "Bo Lee").otherwise(F.lit("Ann Lee")).alias("printed"), F.when(k == 3, "D").otherwise(F.lit("R")).alias("party"))
    begun = time.time()
    got = {r.name_id: (r.member_key, r.stage, r.status) for r in identity.resolve_names(names, members).collect()}
    assert time.time() - begun < 25
    assert [got[i] for i in (1, 2, 3, 4)] == [(5, 1, "found"), (None, None, "unknown"), (6, 1, "found"), (None, 1, "ambiguous")]


def test_differences_of_keys_that_repeat(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (None, "x")], "k long, l string")
    b = spark.createDataFrame([(2, "x"), (3, "x"), (3, "x"), (None, "x")], "k long, l string")
    found = identity.set_differences(a, b, ["k", "l"])
    assert sorted(((r.k or 0), r.l, r.status) for r in found.collect()) == [(0, "x", "extra"), (0, "x", "missing"), (1, "x", "missing"), (3, "x", "extra")]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_tally_counts_each_position_once(spark):
    rows = [(1, "D", "yes"), (1, "D", None), (1, None, "no"), (1, "I", "present"), (2, "R", "absent")]
    found = split.roll_tally(spark.createDataFrame(rows, "roll_id long, party string, choice string"))
    want = {(1, "D", 1, 0, 0, 0), (1, "other", 0, 1, 1, 0), (1, "total", 1, 1, 1, 0), (2, "R", 0, 0, 0, 1), (2, "total", 0, 0, 0, 1)}
    assert {tuple(r[c] for c in ("roll_id", "bucket", "n_yes", "n_no", "n_present", "n_absent")) for r in found.collect()} == want
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_statewide_races_of_one_state_are_dealt_out(spark):
    k = F.col("id")
    addresses = spark.range(300).select(k.alias("address_id"), F.substring(F.concat(F.lit("NY"), k.cast("string")), 1, 2).alias("state"), F.lit("3").alias("cd"), F.lit(None).cast("string").alias("sd"), F.lit(None).cast("string").alias("ad"), (k == 5).alias("in_city"))
    races = spark.range(400).select(F.when(k == 0, "nyc-prop-1").otherwise(F.concat(F.lit("r"), k.cast("string"))).alias("race_id"), F.substring(F.concat(F.lit("ny"), k.cast("string")), 1, 2).alias("state"), F.when(k == 0, "ballot-measure").otherwise(F.lit("governor")).alias("office"))
    kept = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = guide.races_for(addresses, races).withColumn("at", F.spark_partition_id()).collect()
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    assert len(got) == len({(r.address_id, r.race_id) for r in got}) == 300 * 399 + 1
    assert len({r.at for r in got}) > 1


def test_rows_of_ballots_are_stored_briefly(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(guide, "DEALT", 4)
    k = F.col("id")
    none = F.lit(None).cast("string")
    addresses = spark.range(0, 20000, numPartitions=2).select(F.when(k != 7, k).alias("address_id"), F.lit("NY").alias("state"), none.alias("cd"), none.alias("sd"), none.alias("ad"), (k % 3 == 0).alias("in_city"))
    races = spark.range(200).select(F.concat(F.when(k == 0, "nyc-prop-").otherwise(F.lit("r")), k.cast("string")).alias("race_id"), F.lit("ny").alias("state"), F.when(k == 0, "ballot-measure").otherwise(F.lit("governor")).alias("office"))
    guide.races_for(addresses, races).write.parquet(str(tmp_path / "rows"))
    got = spark.read.parquet(str(tmp_path / "rows"))
    rows, nulls, city, pairs = got.agg(F.count(F.lit(1)), F.count_if(F.col("address_id").isNull()), F.count_if(F.startswith("race_id", F.lit("nyc-"))), F.sum(F.xxhash64("address_id", "race_id").cast("decimal(38,0)"))).first()
    assert (rows, nulls, city) == (20000 * 199 + 6667, 199, 6667)
    asked = addresses.select("address_id", "in_city").join(races.select("race_id")).where("in_city or race_id <> 'nyc-prop-0'")
    assert pairs == asked.agg(F.sum(F.xxhash64("address_id", "race_id").cast("decimal(38,0)"))).first()[0]
    assert sum(f.stat().st_size for f in (tmp_path / "rows").glob("*.parquet")) < rows / 2
