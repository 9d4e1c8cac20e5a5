"""Files of a growing table: as many as its rows ask for, not one for each leaf; a first batch is written in its parts."""
import glob

from pyspark.sql import functions as F

from pricematch.sinks.growing import GrowingState

SCHEMA = "k string, v int, seq int"


def test_leaves_share_files(spark, tmp_path):
    state = GrowingState(spark, str(tmp_path / "s"), SCHEMA, ["k"], most_rows=5)
    state.create(spark.createDataFrame([], SCHEMA))
    batch = spark.createDataFrame([(f"k{i}", 0, i) for i in range(600)], SCHEMA).repartition(3)
    assert state.insert_absent(batch, ["seq"], "run#0")[2] == 600
    leaves = state.leaves(1)
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for kind in ("state", "filter"):
        assert 1 <= len(glob.glob(f"{tmp_path}/s/{kind}-000000000001/**/*.parquet", recursive=True)) <= most < len(leaves) / 8
    stored = spark.read.parquet(f"{tmp_path}/s/state-000000000001")
    assert stored.count() == 600 and stored.groupBy("__leaf").count().where("count > 20").isEmpty()
    assert state.insert_absent(batch, ["seq"], "run#1")[2] == 0 and state.read(2).count() == 600


def test_keys_in_question_are_looked_up_alike_where_they_are_few_or_many(spark, tmp_path, monkeypatch):
    from pricematch.sinks import growing

    for most in (growing._SENT, 0):
        monkeypatch.setattr(growing, "_SENT", most)
        state = GrowingState(spark, str(tmp_path / f"s{most}"), SCHEMA, ["k"], most_rows=50)
        state.create(spark.createDataFrame([], SCHEMA))
        state.insert_absent(spark.createDataFrame([(f"k{i}", 0, i) for i in range(600)] + [(None, 0, 600)], SCHEMA), ["seq"])
        again = spark.createDataFrame([(f"k{i}", 1, i) for i in range(590, 620)] + [(None, 1, 620)], SCHEMA)
        assert state.insert_absent(again, ["seq"])[2] == 21
        assert state.read(2).where("k IS NULL").count() == 2 and state.read(2).count() == 622


def test_bits_of_a_key_are_no_lambda(spark, tmp_path):
    state = GrowingState(spark, str(tmp_path / "s"), SCHEMA, ["k"])
    placed = spark.range(3).select(F.concat(F.lit("k"), "id").alias("k"), F.lit("0-0").alias("__leaf"))
    shown = state._filter_of(placed)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in shown and "Filter" not in shown
