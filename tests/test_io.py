import pytest
from pyspark.sql import functions as F

from quern import diagnostics
from quern.sources import io
from quern.sources.readers import checked_name, jdbc_options


def test_files(session, vendas, tmp_path):
    for kind in ("parquet", "json", "orc"):
        getattr(vendas.write, kind)(str(tmp_path / kind))
        assert getattr(session.read, kind)(str(tmp_path / kind)).count() == 12
    vendas.write.csv(str(tmp_path / "v.csv"))
    assert dict(session.read.csv(str(tmp_path / "v.csv")).dtypes)["valor"] == "double"
    assert io.read_table(str(tmp_path / "v.csv"), session=session).count() == 12
    assert io.read_parquet(str(tmp_path / "parquet"), session=session).count() == 12
    with pytest.raises(ValueError):
        io.read_table("x.unknown", session=session)


def test_modes(session, vendas):
    session.sql("DROP TABLE IF EXISTS vendas_t")
    vendas.write.saveAsTable("vendas_t")
    with pytest.raises(Exception, match="already exists"):
        vendas.write.saveAsTable("vendas_t")
    vendas.write.mode("ignore").saveAsTable("vendas_t")
    vendas.write.mode("append").saveAsTable("vendas_t")
    assert session.table("vendas_t").count() == 24
    vendas.write.mode("overwrite").saveAsTable("vendas_t")
    assert session.table("vendas_t").count() == 12
    with pytest.raises(ValueError):
        vendas.write.mode("error").insertInto("vendas_t")
    vendas.write.mode("ignore").insertInto("vendas_t")
    vendas.limit(2).write.mode("append").insertInto("vendas_t")
    assert session.table("vendas_t").count() == 14
    vendas.write.mode("overwrite").insertInto("vendas_t")
    assert session.table("vendas_t").count() == 12
    with pytest.raises(ValueError):
        vendas.write.mode("sometimes")
    with pytest.raises(ValueError):
        vendas.write.storageType("diagonal")
    session.sql("DROP TABLE vendas_t")


def test_buckets_save_a_shuffle(session, vendas):
    for name in ("left_b", "right_b"):
        session.sql(f"DROP TABLE IF EXISTS {name}")
        vendas.write.bucketBy(4, "id").saveAsTable(name)
    joined = session.table("left_b").join(session.table("right_b").withColumnRenamed("valor", "w"), "id")
    assert "Exchange hashpartitioning" not in joined.df.hint("merge")._jdf.queryExecution().executedPlan().toString()
    for name in ("left_b", "right_b"):
        session.sql(f"DROP TABLE {name}")


def test_load_data(session, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text("junk line\na,b\n1,x\n2,y\n")
    session.sql("DROP TABLE IF EXISTS loaded")
    assert session.read.load_data(str(path), "loaded", skiprows=1).count() == 2
    session.sql("DROP TABLE loaded")
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b\n1,2\n3\n4,5\n")
    assert session.read.load_data(str(bad), "loaded", maxerrors=5).count() >= 2
    session.sql("DROP TABLE loaded")
    with pytest.raises(ValueError):
        checked_name("no; drop")


def test_foreign(session, vendas, tmp_path):
    vendas.write.parquet(str(tmp_path / "f"))
    frame = session.read.parquet(str(tmp_path / "f"), foreign=True, name="far_vendas")
    assert frame.count() == 12 and session.foreign.is_foreign("far_vendas") and not session.foreign.is_persistent("far_vendas")
    session.foreign.create_from_query("far_sum", "SELECT sum(valor) AS s FROM far_vendas")
    assert session.table("far_sum").first()["s"] == 1910.0
    session.foreign.drop("far_sum")
    assert "far_sum" not in session.foreign.tables()
    with pytest.raises(ValueError):
        session.foreign.register_file_table("x", "xls")


def test_jdbc_options():
    assert jdbc_options("jdbc:x", "s.t", user="u") == {"url": "jdbc:x", "dbtable": "s.t", "user": "u"}
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "t; drop")


def test_rdds(session):
    context = session.sparkContext
    rdd = context.parallelize(range(100), 4)
    assert len(rdd.sample(False, 0.25, 3).collect()) == 25 and rdd.map(lambda x: x + 1).first() == 1
    assert rdd.takeOrdered(2, ascending=False) == [99, 98] and rdd.filter(lambda x: x > 97).union(rdd.filter(lambda x: x < 1)).count() == 3
    assert context.parallelize([(1, "a")]).toDF().columns == ["col_0", "col_1"] and context.parallelize([5]).toDF().columns == ["value"]
    with pytest.raises(IndexError):
        context.parallelize([], 1).first()
    total = context.accumulator(0)
    rdd.foreach(total.add)
    assert total.value == 4950 and context.broadcast([1]).value == [1]


def test_diagnostics(session, vendas, capsys):
    names = {d.name for d in diagnostics.list_functions()}
    assert {"skewness", "upper", "corr", "row_number"} <= names and diagnostics.get_function("nothing") is None
    assert "unknown" in diagnostics.explain_function("nothing") and "native" in diagnostics.explain_function("upper")
    assert "| corr |" in diagnostics.generate_migration_markdown() and "| upper | scalar | native |" in diagnostics.generate_compatibility_markdown()
    assert diagnostics.table_stats(vendas)["rows"] == 12
    assert diagnostics.suggest_layout(vendas, filtered=["valor"], equal=["estado"]) == {"partition_by": ["estado"], "bucket_or_sort_by": ["valor"]}
    assert diagnostics.run([]) == 0 and "ok" in capsys.readouterr().out


def test_stream_windows(spark, vendas, tmp_path):
    from quern import streaming

    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streaming.files(spark, str(tmp_path / "in"), source.schema, per_trigger=1)
    counts = streaming.tumbling(stream, "ts", "6 hours", ["event_type"], [F.count(F.lit(1)).alias("n")], late="60 days")
    run = counts.writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    run.processAllAvailable()
    run.stop()
    batch = source.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    assert spark.table("tumbled").agg(F.sum("n"), F.count(F.lit(1))).first() == batch.agg(F.sum("n"), F.count(F.lit(1))).first()
    one = streaming.deduplicated(streaming.files(spark, str(tmp_path / "in"), source.schema), "ts", ["user_id"], late="60 days")
    run = one.writeStream.outputMode("append").format("memory").queryName("firsts").start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("firsts").count() == source.select("user_id").distinct().count()
