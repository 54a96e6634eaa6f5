import json

import pytest

from weftgraph import (
    ExecuteError, Explain, ForeignKeyEdge, GraphSession, InternalError, JunctionEdge, Modified, MultiValue, NodeMapping,
    PropertyGraphStore, Rows, UnknownProperty, UnsupportedClause, UnsupportedExpr,
)


def rows(g, text, params=None):
    return g.execute(text, params).values()


def column(g, text, params=None):
    return sorted((r[0] for r in rows(g, text, params)), key=str)


@pytest.fixture(scope="module")
def library(spark):
    """Four authors, six books of three of them, and citations with a page."""
    g = GraphSession(spark)
    authors = spark.createDataFrame([(11, "Ines", 1931), (12, "Omar", 1950), (13, "Petra", 1950), (14, "Quentin", None)], "aid long, name string, born long")
    books = [(501, "Tides", 12, 210), (502, "Salt", 11, 95), (503, "Dunes", 12, 340), (504, "Reefs", 13, 95), (505, "Kelp", 12, 120), (506, "Anonymous", None, 60)]
    g.register_node(NodeMapping("Author", authors, "aid"))
    g.register_node(NodeMapping("Book", spark.createDataFrame(books, "bid long, title string, by long, pages long"), "bid"))
    g.register_edge(ForeignKeyEdge("WRITTEN_BY", "Book", "Author", "by"))
    cited = [(501, 502, 7), (503, 502, 12), (503, 501, 99), (505, 503, 3), (506, 506, 1)]
    g.register_edge(JunctionEdge("CITES", "Book", "Book", spark.createDataFrame(cited, "src_book long, dst_book long, page long"), "src_book", "dst_book"))
    return g


def test_foreign_key(library):
    got = rows(library, "MATCH (b:Book)-[:WRITTEN_BY]->(a:Author) WHERE b.pages < 200 RETURN b.title, a.name ORDER BY b.title")
    assert got == [["Kelp", "Omar"], ["Reefs", "Petra"], ["Salt", "Ines"]]
    assert column(library, "MATCH (a:Author {born: 1950})<-[:WRITTEN_BY]-(b) RETURN b.title") == ["Dunes", "Kelp", "Reefs", "Tides"]
    got = rows(library, "MATCH (b:Book)-[:WRITTEN_BY]->(a:Author) RETURN a.name AS n, count(b) AS c, max(b.pages) AS m ORDER BY c DESC, n")
    assert got == [["Omar", 3, 340], ["Ines", 1, 95], ["Petra", 1, 95]]


def test_junction(library):
    assert column(library, "MATCH (a:Book)-[c:CITES]->(b:Book {title: 'Salt'}) RETURN c.page") == [12, 7]
    assert column(library, "MATCH (b:Book {title: 'Tides'})-[:CITES]-(x) RETURN x.title") == ["Dunes", "Salt"]
    # A loop is one edge, also without a direction.
    assert rows(library, "MATCH (b:Book)-[:CITES]-(b) RETURN b.title") == [["Anonymous"]]
    got = rows(library, "MATCH (a:Book)-[:CITES]->(b:Book)-[:CITES]->(c:Book) WHERE a <> b RETURN a.title, c.title ORDER BY a.title, c.title")
    assert got == [["Dunes", "Salt"], ["Kelp", "Salt"], ["Kelp", "Tides"]]


def test_return_whole_nodes_and_edges(library):
    got = rows(library, "MATCH (b:Book {bid: 504})-[r:WRITTEN_BY]->(a) RETURN b, r, a")[0]
    assert got[0] == {"id": 504, "labels": ["Book"], "properties": {"title": "Reefs", "by": 13, "pages": 95}}
    assert (got[1]["type"], got[1]["startNodeId"], got[1]["endNodeId"]) == ("WRITTEN_BY", 504, 13)
    assert got[2]["properties"] == {"name": "Petra", "born": 1950}
    assert rows(library, "MATCH (b:Book {bid: 504}) RETURN *") == [[got[0]]]
    edge = rows(library, "MATCH (:Book {bid: 505})-[c:CITES]->(:Book) RETURN c")[0][0]
    assert (edge["type"], edge["startNodeId"], edge["endNodeId"], edge["properties"]["page"]) == ("CITES", 505, 503, 3)


def test_raw_return(spark, library):
    raw = GraphSession(spark)
    raw.catalog = library.catalog.copy()
    raw.catalog.raw_return = True
    got = raw.compile("MATCH (b:Book)-[c:CITES]->(d:Book) WHERE c.page = 99 RETURN b, c, d.title AS cited")
    assert got.columns == ["bid", "title", "by", "pages", "source_id", "target_id", "type", "page", "cited"]
    assert [tuple(r) for r in got.collect()] == [(503, "Dunes", 12, 340, 503, 501, "CITES", 99, "Tides")]
    assert [tuple(r) for r in raw.compile("MATCH (a:Author) RETURN a ORDER BY a.name LIMIT 1").collect()] == [(11, "Ines", 1931)]


def test_optional_keeps_rows(library):
    got = rows(library, "MATCH (a:Author) OPTIONAL MATCH (b:Book)-[:WRITTEN_BY]->(a) WHERE b.pages > 100 RETURN a.name, b.title ORDER BY a.name, b.title")
    assert got == [["Ines", None], ["Omar", "Dunes"], ["Omar", "Kelp"], ["Omar", "Tides"], ["Petra", None], ["Quentin", None]]
    assert rows(library, "OPTIONAL MATCH (a:Author {name: 'Zoe'}) RETURN count(a), count(*)") == [[0, 1]]


def test_text_ids_and_rivers(spark):
    g = GraphSession(spark)
    flows = [("Salzach", 225, "Inn"), ("Inn", 518, "Donau"), ("Isar", 292, "Donau"), ("Donau", 2850, None)]
    g.register_node(NodeMapping("River", spark.createDataFrame(flows, "name string, km long, into string"), "name"))
    g.register_edge(ForeignKeyEdge("FLOWS_INTO", "River", "River", "into"))
    assert column(g, "MATCH (a:River {name: 'Salzach'})-[:FLOWS_INTO*1..4]->(b:River) RETURN b.name") == ["Donau", "Inn"]
    assert column(g, "MATCH (a:River {name: 'Donau'})<-[:FLOWS_INTO*1..9]-(b:River) RETURN b.km") == [225, 292, 518]
    p = rows(g, "MATCH p = (a:River)-[:FLOWS_INTO*2]->(b:River) RETURN p, length(p)")
    assert [[x["id"] for x in q[0]] for q in p] == [["Salzach", None, "Inn", None, "Donau"]] and p[0][1] == 2
    # With a cycle, no path meets a river twice.
    g.execute("MATCH (d:River {name: 'Donau'}) SET d.into = 'Salzach'")
    assert column(g, "MATCH (a:River {name: 'Inn'})-[:FLOWS_INTO*1..9]->(b:River) RETURN b.name") == ["Donau", "Salzach"]


def test_documents_holds_and_tags_together(spark):
    """Properties in a JSON column, a table of tags, and rows held back by others, in one query that sorts by JSON."""
    g = GraphSession(spark)
    held = lambda **k: json.dumps(k)
    parcels = [
        (1, held(status="packed", zone=4, kilos=2.5)), (2, held(status="packed", zone=4, kilos=0.5)), (3, held(status="sent", zone=4, kilos=9)),
        (4, held(status="packed", zone=7, kilos=1)), (5, held(status="packed", zone=4, kilos=2.5, fragile=True)), (6, held(status="packed", zone=4)),
        (7, held(status="lost")), (8, None),
    ]
    tags = spark.createDataFrame([(1, "ice"), (2, "ice"), (2, "van"), (5, "glass"), (6, "bike")], "parcel long, tag string")
    table = spark.createDataFrame(parcels, "pid long, doc string")
    g.register_node(NodeMapping("Parcel", table, "pid", json_col="doc", multi_values={"tags": MultiValue(tags, "parcel", "tag")}))
    waits = spark.createDataFrame([(1, 3), (5, 7), (6, 4)], "waiting long, waited long")
    g.register_edge(JunctionEdge("WAITS_FOR", "Parcel", "Parcel", waits, "waiting", "waited"))
    got = rows(
        g,
        "MATCH (p:Parcel) WHERE p.status = 'packed' AND (p.zone = 4 OR p.zone = 7) "
        "AND NOT EXISTS { (p)-[:WAITS_FOR]->(q:Parcel) WHERE q.status = 'lost' } "
        "AND (NOT ('ice' IN p.tags) OR 'van' IN p.tags OR p.kilos > 2) RETURN p.pid, p.kilos ORDER BY p.kilos DESC, p.pid",
    )
    assert [r[0] for r in got] == [1, 4, 2, 6]
    assert rows(g, "MATCH (p:Parcel {pid: 2}) WITH properties(p) AS m, p.tags AS t RETURN m.status, size(t)") == [["packed", 2]]
    assert g.execute("MATCH (p:Parcel) WHERE p.status = 'lost' SET p.status = 'found', p.zone = 1") == Modified(2)
    assert rows(g, "MATCH (p:Parcel {pid: 7}) RETURN p.status, p.zone + 0") == [["found", 1.0]]


def test_key_to_other_column_and_bridges(spark):
    g = GraphSession(spark)
    g.register_node(NodeMapping("Shift", spark.createDataFrame([("night", "D2")], "name string, desk string"), "name"))
    staff = spark.createDataFrame([("s1", "D1"), ("s2", "D2"), ("s3", "D2"), ("D2", "D9")], "sid string, desk string")
    g.register_node(NodeMapping("Staff", staff, "sid"))
    g.register_edge(ForeignKeyEdge("COVERED_BY", "Shift", "Staff", "desk", "desk"))
    assert column(g, "MATCH (x:Shift)-[:COVERED_BY]->(p:Staff) RETURN p.sid") == ["s2", "s3"]
    assert column(g, "MATCH (x:Shift), (p:Staff) WHERE p.desk = x.desk OR p.sid = x.desk RETURN p.sid") == ["D2", "s2", "s3"]


@pytest.fixture
def store(spark):
    g = GraphSession(spark)
    g.execute(
        "CREATE (v:Player {name: 'Vera', games: 12, clubs: ['north', 'east'], home: {hall: {seats: 80}}})-[:BEAT {moves: 41}]->(w:Player {name: 'Wim', games: 4})"
        "-[:BEAT {moves: 23}]->(x:Player:Retired {name: 'Xu', games: 30})"
    )
    return g


def test_store_reads(store):
    assert column(store, "MATCH (p:Player) WHERE p.games >= 12 RETURN p.name") == ["Vera", "Xu"]
    assert column(store, "MATCH (p:Player:Retired) RETURN p.games") == [30]
    assert column(store, "MATCH (v:Player {name: 'Vera'})-[:BEAT*1..3]->(p:Player) RETURN p.name") == ["Wim", "Xu"]
    assert rows(store, "MATCH (a)-[r:BEAT {moves: 23}]->(b) RETURN b.name, r.moves + 1, type(r), a.nothing") == [["Xu", 24, "BEAT", None]]
    assert rows(store, "MATCH (p {name: 'Vera'}) RETURN p.home.hall.seats = 80, 'east' IN p.clubs, size(p.clubs), p['games']") == [[True, True, 2, 12]]
    assert rows(store, "MATCH (p:Player) RETURN count(p) AS c, sum(p.games) AS s, collect(p.nothing) AS l") == [[3, 46.0, [None, None, None]]]
    n = rows(store, "MATCH (p {name: 'Wim'}) RETURN p")[0][0]
    assert n["labels"] == ["Player"] and n["properties"] == {"name": "Wim", "games": 4}


def test_store_writes(store):
    assert store.execute("MATCH (p:Player) WHERE p.games < 20 SET p.games = p.games + 1, p.active = true") == Modified(4)
    assert rows(store, "MATCH (p:Player) RETURN p.name, p.games, p.active ORDER BY p.name") == [["Vera", 13, True], ["Wim", 5, True], ["Xu", 30, None]]
    store.execute("MATCH (v {name: 'Vera'})-[r:BEAT]->(w) SET r.moves = 6, v:Champion")
    assert rows(store, "MATCH (c:Champion)-[r]->(b) RETURN r.moves") == [[6]]
    assert store.execute("MATCH (x {name: 'Xu'}), (v {name: 'Vera'}) CREATE (x)-[:COACHES {hours: 1.5}]->(v)-[:HOLDS]->(t:Cup {year: 9})") == Modified(3)
    assert rows(store, "MATCH (x)-[r:COACHES]->(v)-[:HOLDS]->(t) RETURN x.name, r.hours, t.year") == [["Xu", 1.5, 9]]
    assert store.execute("MATCH (p {name: 'Wim'}) DELETE p") == Modified(1)
    assert rows(store, "MATCH ()-[r:BEAT]->() RETURN count(*)") == [[0]]
    assert store.execute("MATCH (p:Champion) DETACH DELETE p") == Modified(3)
    assert column(store, "MATCH (n) RETURN labels(n)[0]") == ["Cup", "Player"]
    assert rows(store, "MATCH (p {name: 'Xu'}) SET p.games = 31 RETURN p.games") == [[31]]


def test_of_several_values_the_greatest_is_set(store):
    """Both Vera and Wim reach Xu, so two values are bound to one node; numbers compare as numbers."""
    store.execute("MATCH (p:Player)-[:BEAT*1..2]->(x:Retired) SET x.rank = p.games")
    assert rows(store, "MATCH (x:Retired) RETURN x.rank") == [[12]]


def test_removals_without_a_clause(store):
    from weftgraph.operators import writes
    from weftgraph.plans.engine import Engine

    engine = Engine(store.spark, store.catalog, None, False)
    ids = store.compile("MATCH (p:Player) WHERE p.games > 10 RETURN id(p) AS id")
    assert writes.remove_property(engine, ids, "games") == 2
    assert rows(store, "MATCH (p:Player) WHERE p.games IS NOT NULL RETURN p.name") == [["Wim"]]
    ids = store.compile("MATCH (p:Player) RETURN id(p) AS id")
    assert writes.remove_label(engine, ids, "Retired") == 1
    assert rows(store, "MATCH (p:Retired) RETURN count(*)") == [[0]] and rows(store, "MATCH (p:Player) RETURN count(*)") == [[3]]


def test_shortest_paths(spark):
    """Stops of a tram: a ring of five, and a shortcut."""
    g = GraphSession(spark)
    g.execute("CREATE (a:Stop {k: 'a'})-[:TO]->(b:Stop {k: 'b'})-[:TO]->(c:Stop {k: 'c'})-[:TO]->(d:Stop {k: 'd'})-[:TO]->(e:Stop {k: 'e'})-[:TO]->(a), (b)-[:TO]->(d), (a)-[:TO]->(x:Stop {k: 'x'})-[:TO]->(d)")
    ask = "MATCH p = {}((s:Stop {{k: 'a'}})-[:TO*]->(t:Stop)) RETURN t.k, length(p) ORDER BY t.k"
    assert rows(g, ask.format("shortestPath")) == [["b", 1], ["c", 2], ["d", 2], ["e", 3], ["x", 1]]
    assert rows(g, ask.format("allShortestPaths")) == [["b", 1], ["c", 2], ["d", 2], ["d", 2], ["e", 3], ["e", 3], ["x", 1]]
    # From two hops on: the nearer way to d is passed over.
    longer = "MATCH p = shortestPath((s:Stop {k: 'b'})-[:TO*2..5]->(t:Stop)) RETURN t.k, length(p) ORDER BY t.k"
    assert rows(g, longer) == [["a", 3], ["d", 2], ["e", 2], ["x", 4]]
    got = json.loads(json.dumps(rows(g, "MATCH (s:Stop {k: 'd'}) RETURN local_graph(id(s), 1) AS g")[0][0]))
    assert len(got["nodes"]) == 5 and len(got["edges"]) == 5


def test_store_tables_and_files(spark, tmp_path):
    make = lambda data, schema: spark.createDataFrame(data, schema)
    tables = {
        "nodes": make([(1,), (2,)], "id long"), "property_keys": make([(1, "name"), (2, "age"), (3, "meta")], "id long, key string"),
        "node_labels": make([(1, "P"), (2, "P"), (2, "Q")], "node_id long, label string"),
        "node_props_text": make([(1, 1, "x"), (2, 1, "y")], "node_id long, key_id long, value string"),
        "node_props_int": make([(1, 2, 5)], "node_id long, key_id long, value long"),
        "node_props_json": make([(2, 3, '{"a": {"b": 1}}')], "node_id long, key_id long, value string"),
        "edges": make([(9, 1, 2, "T")], "id long, source_id long, target_id long, type string"),
        "edge_props_real": make([(9, 2, 1.5)], "edge_id long, key_id long, value double"),
    }
    g = GraphSession(spark)
    g.catalog.store = PropertyGraphStore.from_tables(spark, tables)
    ask = "MATCH (a:P)-[r:T]->(b:Q) RETURN a.name, a.age = 5, b.meta.a.b = 1, r.age = 1.5"
    assert rows(g, ask) == [["x", True, True, True]]
    g.save(str(tmp_path / "g"))
    assert rows(GraphSession(spark, str(tmp_path / "g")), ask) == [["x", True, True, True]]


def test_errors(spark, library):
    with pytest.raises(UnknownProperty):
        library.compile("MATCH (b:Book) RETURN b.nothing")
    with pytest.raises(UnsupportedExpr):
        library.compile("RETURN no_such_function(1)")
    with pytest.raises(InternalError):
        library.compile("RETURN $missing")
    with pytest.raises(InternalError):
        library.compile("RETURN nobody")
    with pytest.raises(UnsupportedClause):
        library.compile("MATCH (b:Book)")
    with pytest.raises(UnsupportedExpr):
        library.compile("MATCH (b:Book) RETURN b.title LIMIT 'x'")
    with pytest.raises(ExecuteError):
        GraphSession(spark).compile("CREATE (n:X)")


def test_explain_does_not_write(store):
    assert isinstance(store.execute("EXPLAIN MATCH (n) SET n.games = 0"), Explain)
    assert rows(store, "MATCH (n {name: 'Wim'}) RETURN n.games") == [[4]]
    assert isinstance(store.execute("MATCH (n) RETURN n.games"), Rows)


def test_like_option(spark):
    ask = "RETURN 'Hello' STARTS WITH 'he' AS a, 'Hello' CONTAINS 'L_' AS b"
    assert rows(GraphSession(spark), ask) == [[False, False]]
    assert rows(GraphSession(spark, sqlite_like=True), ask) == [[True, True]]


def test_functions_passed_on(spark):
    g = GraphSession(spark)
    one = lambda e: rows(g, f"RETURN {e} AS v")[0][0]
    assert one("strftime('%Y/%m/%d %H-%M-%S %j %w %%', '2024-03-05 06:07:08')") == "2024/03/05 06-07-08 065 2 %"
    assert one("datetime('2024-03-05T06:07:08')") == "2024-03-05 06:07:08" and one("time('2024-03-05 06:07:08')") == "06:07:08"
    assert one("julianday('2000-01-01 12:00:00')") == 2451545.0 and one("unixepoch('1970-01-02')") == 86400
    assert one("printf('%05d|%s', 42, 'x')") == "00042|x" and one("substr('harbour', 2, 3)") == "arb"
    assert one("typeof(1.5)") == "real" and one("hex('Az')") == "417A" and one("unicode('A')") == 65 and one("char(72, 233, 8364)") == "Hé€"
    assert one("concat('a', 1, 'b')") == "a1b" and one("concat_ws('-', 'a', 'b')") == "a-b" and one("iif(2 > 1, 'y', 'n')") == "y"
    assert one("pow(2, 10)") == 1024.0 and one("mod(7, 4)") == 3.0 and one("log2(8)") == 3.0 and round(one("atan2(1, 1)"), 6) == 0.785398
    assert one("greatest(3, 9, 4)") == 9 and one("least(3, null)") is None and one("trunc(-2.7)") == -2 and one("ceiling(2.1)") == 3
    df = g.compile("RETURN json_object('k', 1, 'l', 'x\"y') AS a, json_array(1, 'b', null) AS b, json_type('{\"p\": [1]}') AS c, json_type('{\"p\": 2.5}', 'p') AS d, json_type('{\"p\": \"t\"}', 'p') AS e")
    assert tuple(df.first()) == ('{"k":1,"l":"x\\"y"}', '[1,"b",null]', "object", "real", "text")
