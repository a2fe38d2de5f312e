"""Unit tests of the library without the training-data operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom import catalog
from driftloom.functions import dialect, formatting
from driftloom.operators import diff, filters, generate, graph, index, mutate, ordering
from driftloom.plans import scripts
from driftloom.sources import files
from driftloom.streaming import events as ev

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    want = c.sql(catalog.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda r: tuple("" if v is None else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r)
    assert sorted(key(r) for r in got.select(*columns).collect()) == sorted(key(r) for r in want.select(*[f'"{x}"' for x in columns]).fetchall())


def test_whole_orders_return_every_row(spark):
    tables = {"ord1_sort_stack": "customer", "ord2_default_order": "part", "ord3_true_first": "customer", "ord4_missing_first": "documents", "ord5_rank_sort": "part", "ord7_reference_order": "lineitem", "ord9_directories_first": "pages", "sql8_order_nulls": "events"}
    for name, table in tables.items():
        n = files.table(spark, SF, table).count()
        assert sorted(r.position for r in catalog.QUERIES[name](spark, SF).collect()) == list(range(1, n + 1))


def test_diff_labels_and_roundtrip(spark):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, None)], "k int, v string")
    right = spark.createDataFrame([(2, "b"), (3, "c"), (4, None), (5, "e")], "k int, v string")
    d = diff.two_sided_diff(left, right, ["k"])
    assert rows(d.select("k", "side", diff.change_label(F.col("side")))) == [(1, "LEFT", "delete"), (2, "BOTH", "edit"), (5, "RIGHT", "add")]
    assert diff.two_sided_diff(diff.apply_diff(left, d, ["k"]), right, ["k"]).count() == 0


@pytest.mark.parametrize(("pattern", "regex", "want"), [("RIGHT", False, True), ("^ri.*g$", True, True), ("INVALID", False, False), ("(", True, False), ("right (s", True, True)])
def test_text_match(spark, pattern, regex, want):
    assert spark.createDataFrame([("right (string",)], "s string").select(filters.text_match(F.col("s"), pattern, regex)).first()[0] is (want if pattern != "(" else True)


def test_text_match_of_null_is_false(spark):
    assert spark.createDataFrame([(None,)], "s string").select(filters.text_match(F.col("s"), "x")).first()[0] is False


def test_sort_stack():
    s = ordering.SortStack().choose("a").choose("b").choose("b")
    assert s.keys == [("b", True), ("a", False)]
    assert s.choose("a").keys == [("a", False), ("b", True)]
    assert [k for k, _ in ordering.default_stack().keys] == ["location", "type", "change", "name"]


def test_range_join_finds_each_pair_once(spark):
    p = spark.createDataFrame([("f", i) for i in range(-3, 30)], "g string, p long")
    r = spark.createDataFrame([("f", s, n) for s, n in ((0, 5), (3, 17), (-2, 1), (9, 0))], "g string, s long, n long")
    want = sorted(("f", i, s, n) for i in range(-3, 30) for s, n in ((0, 5), (3, 17), (-2, 1)) if s <= i < s + n)
    assert rows(index.range_join(p, r, "g", "p", "s", "n", 4).select("g", "p", "s", "n")) == want


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    assert rows(graph.closure(e, spark.createDataFrame([("a",)], "id string"))) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert rows(graph.closure(e, spark.createDataFrame([("d",)], "id string"), 1, reverse=True)) == [("c", 1), ("d", 0)]
    dag = spark.createDataFrame([("x", "y"), ("y", "z"), ("x", "z")], "src string, dst string")
    assert rows(graph.layers(dag, spark.createDataFrame([(i,) for i in "xyz"], "id string"))) == [("x", 2), ("y", 1), ("z", 0)]


def test_rewrite_applies_all_edits(spark):
    t = spark.createDataFrame([(1, "hello wörld"), (2, "same")], "k int, text string")
    e = spark.createDataFrame([(1, 6, 5, "there"), (1, 0, 1, "J")], "k int, offset int, length int, new_text string")
    assert rows(index.rewrite(t, e, "k")) == [(1, "Jello there"), (2, "same")]


def test_generator_domains():
    s = generate.ColumnSpec
    assert s("d", "date").domain() == 36526
    assert s("b", "bit", length=5).domain() == 32 and s("b", "bit", length=0).domain() == 0
    assert s("t", "text", length=4).domain() == 26**4 and s("b", "boolean").domain() == 2
    assert s("t", "time", start=0, end=generate.parse_bound("time", "05:30:00")).domain() == 19_800_001
    assert s("t", "timestamp", end=dt.datetime(1970, 1, 1, 0, 1, 40)).domain() == 101
    assert s("t", "timestamptz", start=(dt.datetime(1970, 1, 1), "Z"), end=(dt.datetime(1970, 1, 1, 8), "Z")).domain() == 28_800_001
    assert s("i", "integer", end=10**12).domain() == 2**31 - 1
    assert generate.parse_step("PT1M") == dt.timedelta(minutes=1) and generate.parse_step("PT8H") == dt.timedelta(hours=8)


def test_generator_checks():
    with pytest.raises(ValueError, match="ISO date"):
        generate.parse_bound("date", "INVALID STRING")
    with pytest.raises(ValueError, match="fewer"):
        generate.validate("t", "20", [generate.ColumnSpec("i", end=5, unique=True)])
    with pytest.raises(ValueError, match="no generator"):
        generate.ColumnSpec("x", "other", generate.INCREMENT)
    assert generate.generators("other") == [generate.ANY]
    assert generate.kind_of("Int64", "CH")[0] == "integer" and generate.kind_of("bit(3)") == ("bit", 3)


@pytest.mark.parametrize(("lo", "hi"), [(1, 2**63 - 1), (-100, 100), (400, 400), (-50, -1)])
def test_random_integers_stay_in_bounds(spark, lo, hi):
    g = generate.generate(spark, [generate.ColumnSpec("i", "bigint", start=lo, end=hi, not_null=True)], 500)
    a, b = g.agg(F.min("i"), F.max("i")).first()
    assert lo <= a <= b <= hi


def test_random_reals_and_bits(spark):
    g = generate.generate(spark, [generate.ColumnSpec("r", "double", start=6.1, end=6.2, not_null=True), generate.ColumnSpec("b", "bit", length=7, not_null=True)], 300)
    assert g.where("r >= 6.1 AND r < 6.2 AND b RLIKE '^[01]{7}$'").count() == 300


def test_formatting(spark):
    df = spark.createDataFrame([([1, None], {"a": [2]}, None)], "a array<int>, m map<string,array<int>>, n string")
    k = T.MapType(T.StringType(), T.ArrayType(T.IntegerType()))
    got = df.select(formatting.render(F.col("a"), T.ArrayType(T.IntegerType())), formatting.render(F.col("m"), k), formatting.cell(F.col("n"), T.StringType()), formatting.csv_line(F.lit("it's"), F.col("n"))).first()
    assert tuple(got) == ("[1, NULL]", "{a=[2]}", "<NULL>", "'it''s',NULL")


def test_dialect(spark):
    got = spark.range(1).select(
        dialect.pg_log(F.lit(100.0)), dialect.pg_initcap(F.lit("a-b cD")), dialect.pg_chr(F.lit(1046)), dialect.pg_trunc(F.lit(-2.7)), dialect.pg_substr(F.lit("hello"), F.lit(-1), F.lit(4)), dialect.pg_regexp_replace(F.lit("banana"), "an", "<&>")
    ).first()
    assert math.isclose(got[0], 2) and tuple(got)[1:] == ("A-B Cd", "Ж", -2, "he", "b<&>ana")


def test_scripts():
    assert [s for _, s in scripts.split_script("a; -- x;\n b ';' ; $$ c; $$;")] == ["a", "b ';'", "$$ c; $$"]
    assert scripts.fill("select", columns="*", table="t") == "SELECT * FROM t" and "select" in scripts.templates_for("<sel")
    assert scripts.templates_for("<C", "expression") == ["case"] and "case" not in scripts.templates_for("", "statement")
    assert scripts.too_long_to_parse("a\nb", 1) and not scripts.too_long_to_parse("a\nb", 0)


def test_sources(spark, tmp_path):
    import zipfile

    (tmp_path / "p" / "sub").mkdir(parents=True)
    (tmp_path / "p" / "sub" / "a.sql").write_text("SELECT 1")
    with zipfile.ZipFile(tmp_path / "l.zip", "w") as z:
        z.writestr("b.sql", "SELECT 2")
        z.writestr("c.txt", "no")
    got = files.libraries(spark, [str(tmp_path / "p"), str(tmp_path / "l.zip"), str(tmp_path / "p")])
    assert sorted(r.text for r in got.collect()) == ["SELECT 1", "SELECT 2"]
    for path in ("jdbc:x", "https://host/l.zip"):
        with pytest.raises(ValueError):
            files.libraries(spark, [path])
    every = files.libraries(spark, [str(tmp_path / "p"), "https://host/l.zip", "jdbc:x"], fetch=lambda url: str(tmp_path / "l.zip"), connect=lambda spark, url: files.stream_of(spark, "SELECT 3", url))
    assert sorted(r.text for r in every.collect()) == ["SELECT 1", "SELECT 2", "SELECT 3"]
    below = {"a": ["b", "c"], "b": ["a", "d"], "c": [], "d": ["jdbc:x"]}
    assert files.library_plan(["a", "c"], below.__getitem__) == [("LOCAL", "a"), ("LOCAL", "b"), ("LOCAL", "d"), ("JDBC", "jdbc:x"), ("LOCAL", "c")]
    assert files.stub(got)() is got
    assert files.version_gate(None, (1,)) is False and files.version_gate("9.0", (1, 2)) is False and files.version_gate("x", (1,)) and files.version_gate("1.1", (1, 2))
    assert files.jdbc_options("PG", "u")["readOnly"] == "true" and [files.kind_of_source(p) for p in ("jdbc:a", "https://a", "/a")] == ["JDBC", "URL", "LOCAL"]
    df = spark.createDataFrame([("n", "secret")], "name string, pass string")
    files.write_xml(files.export_connections(df, False).select("name"), str(tmp_path / "x"), "c")
    assert files.read_xml(spark, str(tmp_path / "x"), "c", "name string").first()[0] == "n"
    key = F.lit("0123456789abcdef0123456789abcdef")
    assert df.select(files.decrypt(files.encrypt(F.col("pass"), key), key)).first()[0] == "secret"
    files.write_objects(df.withColumn("kind", F.lit("a")), str(tmp_path / "o"), "kind", partial=True)
    files.write_csv_lines(df, str(tmp_path / "csv"))
    assert spark.read.text(str(tmp_path / "csv")).first()[0] == "'n','secret'"


def test_project_listing_order(spark, tmp_path):
    for name in ("b.sql", "a/z.sql", "a/sub/y.sql", "c/x.sql", "a/note.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    assert [r.text for r in files.project(spark, str(tmp_path)).collect()] == ["a/sub/y.sql", "a/z.sql", "c/x.sql", "b.sql"]


def test_snapshots_scripts_and_stored_entries(spark, tmp_path):
    df = spark.createDataFrame([("k", 1)], "name string, n int")
    files.write_snapshot(df, str(tmp_path / "s"))
    assert files.read_snapshot(spark, str(tmp_path / "s"), "name string, n int").collect() == df.collect()
    with pytest.raises(ValueError):
        files.read_snapshot(spark, str(tmp_path / "s"), "name string, n long")
    path = files.write_temporary_sql(spark.createDataFrame([("SELECT 'é'",)], "text string"), str(tmp_path))
    assert spark.read.text(path).first()[0] == "SELECT 'é'" and "é".encode() in b"".join(p.read_bytes() for p in (tmp_path / path.rsplit("/", 1)[1]).glob("part-*"))
    key = F.lit("0123456789abcdef0123456789abcdef")
    entries = spark.createDataFrame([("<a/>",)], "x string").select(F.array(files.encrypt(F.col("x"), key), F.base64(F.aes_encrypt(F.col("x"), key, F.lit("ECB"))), F.col("x"), F.lit("junk"), F.lit(None)).alias("e")).select(F.explode("e").alias("e"))
    assert [r.x for r in entries.select(files.read_stored(F.col("e"), key).alias("x")).collect()] == ["<a/>"] * 3 + [None, None]


def test_live_schema_statements():
    assert "WHERE table_schema IN ('a', 'b''c')" in files.catalog_query("PG", ["a", "b'c"]) and "pg_catalog" in files.catalog_query("PG") and "system.columns" in files.catalog_query("CH")
    assert files.ms_url("h", 1, "d") == "jdbc:sqlserver://h:1;databaseName={d}" and files.ms_url("h", 1, "d}x", True, "dom").endswith("databaseName=d}x;integratedSecurity=true;authenticationScheme=NTLM;domain=dom")


def test_parquet_table(spark, tmp_path):
    t = mutate.ParquetTable(spark, str(tmp_path / "t"), "k int, v string")
    assert t.read().count() == 0
    t.insert(spark.createDataFrame([(1, "a"), (2, None)], "x long, y string"))
    t.insert(spark.createDataFrame([(3,)], "x int"), ["k"])
    first = t.parts()
    t.update({"v": F.concat("v", F.lit("!"))}, F.col("v").isNotNull())
    assert rows(t.read().fillna("-")) == [(1, "a!"), (2, "-"), (3, "-")] and first[1] in t.parts() and first[0] not in t.parts()  # only the part with a hit is rewritten
    assert rows(t.delete(F.col("v") == "a!", returning=True)) == [(1, "a!")] and rows(t.read().select("k")) == [(2,), (3,)]
    assert rows(t.read(2).select("k")) == [(1,), (2,), (3,)]  # readers of older versions see theirs
    with pytest.raises(mutate.StaleVersion):
        t._commit(0, [])
    with pytest.raises(ValueError):
        t.insert(spark.createDataFrame([(3,)], "x int"), ["k", "v"])
    t.truncate()
    assert t.read().count() == 0 and t.vacuum() > 0 and t.delete() is None


def test_deep_graphs_are_followed_to_their_end(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(15)], "src long, dst long")
    assert graph.required_by_selection(chain, spark.createDataFrame([(0,)], "id long")).count() == 15
    assert graph.closure(chain, spark.createDataFrame([(0,)], "id long")).count() == 11  # ten steps unless told otherwise


def test_long_unique_texts(spark):
    got = generate.generate(spark, [generate.ColumnSpec("t", "text", length=30, unique=True), generate.ColumnSpec("b", "bit", generate.INCREMENT)], 50).collect()
    assert len({r.t for r in got}) == 50 and {r.b for r in got} == {None}
    assert {len(r.x) for r in spark.range(3).select(generate.letters(F.col("id"), 20).alias("x")).collect()} == {20}


def test_debounce_in_batch_and_stream(spark, tmp_path):
    at = [dt.datetime(2024, 1, 1, 0, 0, s) for s in (0, 1, 2, 30, 31)]
    df = spark.createDataFrame([(i, "u", t) for i, t in enumerate(at)], "event_id long, k string, ts timestamp")
    assert [r.event_id for r in ev.debounce(df, "k", 5000).orderBy("event_id").collect()] == [2, 4]
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = ev.debounce_stream(stream, "k", "event_id", 5000, "0 seconds").writeStream.format("memory").queryName("bursts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.event_id for r in spark.table("bursts").collect()) == [2, 4]
    q = ev.daily_counts_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["k"]).writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.n for r in spark.table("days").collect()] == [5]


def test_unselected_dependents(spark):
    n = spark.createDataFrame([("a", None, "RIGHT", False), ("b", "a", "BOTH", True), ("c", "b", "LEFT", False), ("d", "b", "RIGHT", False)], "id string, parent_id string, side string, selected boolean")
    assert rows(graph.unselected_dependents(n)) == [("a", "RIGHT"), ("c", "LEFT")]
    assert rows(graph.unselected_dependents(n.where("false"))) == []


def test_lookup_gives_empty_lists(spark):
    i = spark.createDataFrame([("a", 2), ("a", 1)], "k string, v int")
    assert rows(index.lookup(i, spark.createDataFrame([("a",), ("z",), ("z",)], "k string"), "k", "v")) == [("a", [1, 2]), ("z", [])]


def test_first_range(spark):
    p = spark.createDataFrame([("g", 1, 70), ("g", 2, 5)], "g string, id int, at long")
    r = spark.createDataFrame([("g", 60, 20), ("g", 65, 10)], "g string, lo long, n long")
    assert rows(index.first_range(p, r, "g", "at", "lo", "n", ["id"])) == [(1, 60)]


def test_status_flags(spark):
    c = spark.createDataFrame([("a", "added"), ("a", "same"), ("b", "untracked"), ("c", "same")], "path string, kind string")
    assert rows(ev.status_flags(c, "path", "kind", ["added", "modified"], "untracked")) == [("a", True, False), ("b", True, True), ("c", False, False)]


def test_levels(spark):
    from driftloom.functions import levels

    got = spark.range(1).select(levels.object_level(F.lit("CH"), F.lit("FUNCTION")), levels.object_level(F.lit("PG"), F.lit(None).cast("string")), levels.danger_text(F.lit("UPDATE")), levels.danger_text(F.lit("SELECT")))
    assert list(got.first()) == ["SCHEMA", "UNKNOWN", "UPDATE statement", None]


def test_event_file_name_is_javas_uuid(spark):
    import uuid
    from hashlib import md5

    label = "x y" * 20
    name = "a-" + label.replace(" ", "+")
    want = uuid.UUID(bytes=md5(name.encode()).digest(), version=3)
    assert spark.range(1).select(files.event_file_name(F.lit("a"), F.lit(label)), files.event_file_name(F.lit("a"), F.lit("b c"))).first()[:] == (str(want), "a-b+c")


def test_jobs(spark, tmp_path):
    from driftloom.streaming import jobs

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sql").write_text("SELECT 1\n")
    seen = jobs.changed_files(spark, str(tmp_path / "in"))
    start = lambda: seen.writeStream.format("memory").queryName("files").option("checkpointLocation", str(tmp_path / "c")).start()
    q = jobs.single_flight(spark, "files", start)
    q.processAllAvailable()
    assert [r.text for r in spark.table("files").collect()] == ["SELECT 1\n"]
    again = jobs.single_flight(spark, "files", lambda: jobs.periodic(seen.writeStream, 24).format("noop").queryName("files").start())
    assert not q.isActive and [x.id for x in spark.streams.active if x.name == "files"] == [again.id]
    again.stop()
    cache, made = jobs.IdleCache(1), []
    make = lambda: made.append(1) or spark.range(3)
    assert cache.get("k", make, 0).count() == 3 and cache.get("k", make, 30).count() == 3 and made == [1]
    assert cache.expire(80) == [] and cache.expire(90) == ["k"]
    cache.get("k", make, 100)
    cache.invalidate("k")
    assert cache.get("k", make, 101).count() == 3 and made == [1, 1, 1]


def test_batches_stop_at_the_first_failure(spark):
    assert [(s, e is None) for _, s, e in scripts.run_batches(spark, "SELECT 1; SELEC 2; SELECT 3")] == [("SELECT 1", True), ("SELEC 2", False)]
