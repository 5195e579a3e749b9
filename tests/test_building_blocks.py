"""Positions, lags, joins, quantiles, z-scores against brute force."""

import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.functions.scalar import clip, money, percent, ratio
from shelfcast.functions.service_level import z_score
from shelfcast.operators.joins import null_safe_join
from shelfcast.operators.ordinal import lag_by_position, with_global_position, with_position
from shelfcast.operators.quantiles import exact_quantiles, exact_quantiles_by
from shelfcast.sources import readers, schemas
from shelfcast.sources.storage import new_path, shared_folder, stage

PROBS = [0.0, 0.1, 0.33, 0.5, 0.9, 0.99, 1.0]


def skewed_rows(n=400, seed=3):
    """One store holds a third of the rows; few dates, so that blocks repeat."""
    rng = random.Random(seed)
    keys = set()
    while len(keys) < n:
        store = 1 if rng.random() < 0.34 else rng.randint(2, 9)
        keys.add((rng.randint(0, 30), store, f"f{rng.randint(0, 40):02d}"))
    keys = list(keys)
    rng.shuffle(keys)
    return [(d, s, f, float(rng.randint(0, 50))) for d, s, f in keys]


@pytest.fixture(scope="module")
def rows():
    return skewed_rows()


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "date int, store int, family string, x double")


def test_position_in_whole_table(frame, rows):
    got = {(r.date, r.store, r.family): r.pos for r in with_position(frame, [], ["date", "store", "family"]).collect()}
    want = {k: i for i, k in enumerate(sorted((d, s, f) for d, s, f, _ in rows))}
    assert got == want


def test_position_within_scope(frame, rows):
    got = {(r.date, r.store, r.family): r.pos for r in with_position(frame, ["store"], ["date", "family"]).collect()}
    for store in {s for _, s, _, _ in rows}:
        mine = sorted((d, f) for d, s, f, _ in rows if s == store)
        assert [got[d, store, f] for d, f in mine] == list(range(len(mine)))


@pytest.mark.parametrize("block", [5, 8, 1000])
def test_lag_over_blocks(frame, rows, block):
    placed = with_position(frame, ["store"], ["date", "family"])
    out = lag_by_position(placed, ["store"], "pos", "x", 4, "lagged", block_rows=block).collect()
    assert len(out) == len(rows)
    for store in {s for _, s, _, _ in rows}:
        mine = sorted((r for r in out if r.store == store), key=lambda r: r.pos)
        for i, r in enumerate(mine):
            assert r.lagged == (mine[i - 4].x if i >= 4 else None)


def test_null_keys_meet_and_no_row_is_lost(spark):
    rows = [(None, 1, 1.0), (None, None, 2.0), (1, 1, 3.0), (1, None, None), (1, 2, 5.0)]
    df = spark.createDataFrame(rows, "store int, day int, x double")
    dim = spark.createDataFrame([(None, "none"), (1, "one")], "store int, name string")
    got = {(r.store, r.day): r.name for r in null_safe_join(df, dim, ["store"]).collect()}
    assert got == {(s, d): "none" if s is None else "one" for s, d, _ in rows}
    for order in (["day"], ["day", "x"], ["store", "day", "x"]):
        placed = with_position(df, ["store"], order).collect()
        assert sorted(((r.store or 0, r.day or 0), r.pos) for r in placed) == [((0, 0), 0), ((0, 1), 1), ((1, 0), 0), ((1, 1), 1), ((1, 2), 2)]
    with pytest.raises(ValueError):
        lag_by_position(df, ["store"], "day", "x", 5, "y", block_rows=4)


def test_positions_in_the_whole_table(spark):
    values = [random.Random(1).choice([0.5, 1.5, i * 0.25]) for i in range(400)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v double, i int").repartition(5)
    got = sorted((r.pos, r.v, r.i) for r in with_global_position(df, ["v", "i"]).collect())
    assert got == [(k, v, i) for k, (v, i) in enumerate(sorted((v, i) for i, v in enumerate(values)))]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 150])
def test_quantiles_of_few_values(spark, n):
    values = [float(random.Random(n).randint(0, 9)) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = exact_quantiles(df, "v", PROBS)
    assert got.n == n
    assert got.values == pytest.approx(list(np.quantile(values, PROBS)))


def test_quantiles_of_many_values_with_a_hot_value(spark):
    df = spark.range(130_000).select(
        F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7.0).alias("v")
    )
    values = [r.v for r in df.collect()]
    got = exact_quantiles(df, "v", PROBS)
    assert got.values == pytest.approx(list(np.quantile(values, PROBS)), rel=1e-12)


def test_quantiles_by_group(spark):
    df = spark.range(3000).select(
        (F.col("id") % 3).cast("int").alias("g"), F.pmod(F.xxhash64("id"), F.lit(997)).cast("double").alias("v")
    )
    rows = df.collect()
    got = {r.g: r["values"] for r in exact_quantiles_by(df, "g", "v", [0.25, 0.5]).collect()}
    for g in range(3):
        assert got[g] == pytest.approx(list(np.quantile([r.v for r in rows if r.g == g], [0.25, 0.5])))


def test_quantiles_of_a_hundred_thousand_groups(spark):
    df = spark.range(300_000).select((F.col("id") % 100_000).alias("g"), F.pmod(F.xxhash64("id"), F.lit(97)).cast("double").alias("v"))
    got = exact_quantiles_by(df, "g", "v", [0.5, 1.0])
    want = df.groupBy("g").agg(F.sort_array(F.collect_list("v")).alias("all"))
    wrong = got.join(want, "g").where("n <> 3 or values[0] <> all[1] or values[1] <> all[2]")
    assert got.count() == 100_000 and wrong.count() == 0


@pytest.mark.parametrize("slack", [0.0, 0.02])
def test_a_bracket_that_misses_is_found_and_widened(spark, slack):
    """With a coarse sketch and no slack most brackets miss their rank."""
    values = [(None if i % 5 == 0 else i % 5, float(random.Random(i).randint(0, 4000)) if i % 11 else None) for i in range(4000)]
    df = spark.createDataFrame(values, "g int, v double")
    got = {r.g: (r.n, r["values"]) for r in exact_quantiles_by(df, "g", "v", PROBS, accuracy=4, slack=slack).collect()}
    for g in (None, 1, 2, 3, 4):
        own = [v for k, v in values if k == g and v is not None]
        assert got[g][0] == len(own) and got[g][1] == pytest.approx(list(np.quantile(own, PROBS)))


def test_quantiles_of_nothing(spark):
    assert exact_quantiles(spark.createDataFrame([], "v double"), "v", [0.5]).n == 0


def test_z_score_table_and_quantile(spark):
    levels = [0.5, 0.6, 0.85, 0.875, 0.9, 0.95, 0.97, 0.98, 0.985, 0.99, 0.995, 0.999, 0.9999999]
    out = spark.createDataFrame([(x,) for x in levels], "p double").select("p", z_score(F.col("p")).alias("z"))
    table = {0.85: 1.036, 0.90: 1.282, 0.95: 1.645, 0.97: 1.881, 0.98: 2.054, 0.99: 2.326, 0.995: 2.576, 0.999: 3.090}
    for r in out.collect():
        assert r.z == pytest.approx(table.get(r.p, NormalDist().inv_cdf(r.p)), abs=1e-9)


def test_scalars_keep_null(spark):
    one = spark.createDataFrame([(None, 2.0, 0.0)], "n double, a double, z double")
    r = one.select(
        clip(F.col("n"), 0, 1).alias("c"), ratio(F.col("a"), F.col("z"), 7.0).alias("r"),
        ratio(F.col("a"), F.col("z"), None).alias("m"),
    ).first()
    assert (r.c, r.r, r.m) == (None, 7.0, None)


def test_money_and_percent_text(spark):
    values = [None, 0.0, 999.4, 350_000.0, 12_500_000.0, 35_932_003_490.69, -2_000_000.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(money(F.col("v"))).collect()]
    assert got == ["$0", "$0", "$999", "$350K", "$12.5M", "$35.93B", "$-2.0M"]
    assert [r[0] for r in df.select(money(F.col("v"), 1)).collect()][5] == "$35.9B"
    assert [r[0] for r in df.select(percent(F.col("v"))).collect()][:2] == ["0%", "0.0%"]


def test_missing_table_is_empty(spark):
    df = readers.read_table_or_empty(spark, new_path(spark, "nothing"), schemas.RISK)
    assert df.count() == 0 and "composite_risk_score" in df.columns


def test_staged_table_lives_in_the_shared_folder(spark, frame):
    staged = stage(frame, "t")
    assert staged.count() == frame.count()
    assert all(f"{shared_folder(spark)}/shelfcast/" in f and "/staged/" in f for f in staged.inputFiles())
