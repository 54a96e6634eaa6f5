from weftgraph import GraphSession, NodeMapping
from weftgraph.sources.snapshots import snapshot
from weftgraph.streaming.views import MaterializedView


def test_refresh(spark):
    """A view stays as it was until it is refreshed, through additions, changes and deletions."""
    g = GraphSession(spark)
    g.execute("CREATE (:Boat {name: 'Ark', tons: 900}), (:Boat {name: 'Skiff', tons: 2}), (:Boat {name: 'Barge', tons: 300})")
    view = MaterializedView(g, "MATCH (b:Boat) WHERE b.tons >= $least RETURN b.name AS name, b.tons * 2 AS twice", {"least": 100})
    now = lambda: sorted(tuple(r) for r in view.rows.collect())
    assert now() == [("Ark", 1800), ("Barge", 600)]
    g.execute("MATCH (b:Boat {name: 'Skiff'}) SET b.tons = 150")
    g.execute("MATCH (b:Boat {name: 'Ark'}) DELETE b")
    assert now() == [("Ark", 1800), ("Barge", 600)]
    assert view.refresh() is view.rows and now() == [("Barge", 600), ("Skiff", 300)]


def test_follow_a_stream(spark, tmp_path):
    """Two files of readings, one at a time: each micro-batch is written and joins the table behind the nodes."""
    g = GraphSession(spark)
    schema = "rid long, probe string, celsius double"
    mapping = NodeMapping("Reading", spark.createDataFrame([(0, "roof", -1.0)], schema), "rid")
    g.register_node(mapping)
    view = MaterializedView(g, "MATCH (r:Reading) WHERE r.celsius < 10 RETURN r.probe AS probe, count(*) AS n, min(r.celsius) AS low")
    for k, batch in enumerate(([(1, "roof", 4.0), (2, "well", 11.5)], [(3, "well", 9.0), (4, "roof", 30.0), (5, "roof", -7.5)])):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    batches = []

    def take(batch):
        mapping.table = mapping.table.unionByName(snapshot(batch))
        batches.append(1)

    q = view.follow(stream, take, checkpointLocation=str(tmp_path / "cp"), trigger={"availableNow": True})
    q.awaitTermination()
    assert len(batches) >= 2
    assert sorted(tuple(r) for r in view.rows.collect()) == [("roof", 3, -7.5), ("well", 1, 9.0)]
