"""All queries of the library and their SQL.  A query is a function of (spark, sf_dir); ``sql`` is what DuckDB runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import dialect, formatting, levels
from .operators import diff, filters, generate, graph, index, ordering
from .plans import scripts
from .sources import files
from .streaming import events as ev

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_t = files.table
_SIDES = """l AS (SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 10 <> 0),
r AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 2 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 20 = 2 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 10 <> 1)"""


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of customer that differ by a fixed rule."""
    c, k = _t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), F.col("c_custkey")
    right = c.where(k % 10 != 1).withColumn("c_acctbal", F.when(k % 10 == 2, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))).withColumn("c_mktsegment", F.when(k % 20 == 2, None).otherwise(F.col("c_mktsegment")))
    return c.where(k % 10 != 0), right


# ---- diff and sets --------------------------------------------------------------------------


@query(f"""WITH {_SIDES}
SELECT coalesce(l.c_custkey, r.c_custkey) AS c_custkey, CASE WHEN r.c_custkey IS NULL THEN 'LEFT' WHEN l.c_custkey IS NULL THEN 'RIGHT' ELSE 'BOTH' END AS side,
  CASE WHEN r.c_custkey IS NULL THEN 'delete' WHEN l.c_custkey IS NULL THEN 'add' ELSE 'edit' END AS to_project,
  CASE WHEN r.c_custkey IS NULL THEN 'CREATE' WHEN l.c_custkey IS NULL THEN 'DROP' ELSE 'ALTER' END AS to_database,
  l.c_acctbal AS c_acctbal_left, r.c_acctbal AS c_acctbal_right
FROM l FULL JOIN r ON l.c_custkey = r.c_custkey
WHERE l.c_custkey IS NULL OR r.c_custkey IS NULL OR l.c_name IS DISTINCT FROM r.c_name OR l.c_acctbal IS DISTINCT FROM r.c_acctbal OR l.c_mktsegment IS DISTINCT FROM r.c_mktsegment""")
def jon1_two_sided_diff(spark, d):
    out = diff.two_sided_diff(*_sides(spark, d), ["c_custkey"])
    side = F.col("side")
    return out.select("c_custkey", "side", diff.change_label(side).alias("to_project"), diff.change_label(side, True).alias("to_database"), "c_acctbal_left", "c_acctbal_right").orderBy("side", "c_custkey")


@query("SELECT 0::BIGINT AS n")
def jon2_roundtrip(spark, d):
    left, right = _sides(spark, d)
    after = diff.apply_diff(left, diff.two_sided_diff(left, right, ["c_custkey"]), ["c_custkey"])
    return diff.two_sided_diff(after, right, ["c_custkey"]).agg(F.count("*").alias("n"))


@query(f"""WITH {_SIDES}, b AS (SELECT l.c_custkey, l.c_acctbal a1, r.c_acctbal a2, l.c_mktsegment m1, r.c_mktsegment m2 FROM l JOIN r USING (c_custkey))
SELECT c_custkey, 'c_acctbal' AS "column" FROM b WHERE a1 IS DISTINCT FROM a2 UNION ALL SELECT c_custkey, 'c_mktsegment' FROM b WHERE m1 IS DISTINCT FROM m2""")
def jon3_changed_columns(spark, d):
    return diff.changed_columns(*_sides(spark, d), ["c_custkey"])


@query("SELECT l_orderkey, l_partkey % 50 AS bucket, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def jon11_duplicates(spark, d):
    return diff.duplicates(_t(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 50).alias("bucket")), ["l_orderkey", "bucket"])


_NODES = """n AS (SELECT 'o' || o_orderkey AS id, 'c' || o_custkey AS parent_id, o_orderpriority AS name FROM orders
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_mktsegment FROM customer
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 'r' || r_regionkey, NULL, r_name FROM region)"""


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """The tree region, nation, customer, order."""

    def level(table, p, key, parent, pp, name):
        up = F.concat(F.lit(pp), parent) if parent else F.lit(None).cast("string")
        return _t(spark, d, table).select(F.concat(F.lit(p), key).alias("id"), up.alias("parent_id"), F.col(name).alias("name"))

    return level("orders", "o", "o_orderkey", "o_custkey", "c", "o_orderpriority").unionByName(level("customer", "c", "c_custkey", "c_nationkey", "n", "c_mktsegment")).unionByName(level("nation", "n", "n_nationkey", "n_regionkey", "r", "n_name")).unionByName(level("region", "r", "r_regionkey", None, "", "r_name"))


@query(f"""WITH {_NODES}, i AS (SELECT id FROM n WHERE id LIKE 'c%7'), x AS (
SELECT n.* FROM n WHERE id IN (FROM i) OR parent_id IN (FROM i) OR EXISTS (SELECT 1 FROM n m WHERE m.id IN (FROM i) AND m.parent_id = n.parent_id AND m.name = n.name))
SELECT DISTINCT id, name FROM x""")
def jon12_expand_fragments(spark, d):
    nodes = _nodes(spark, d)
    return diff.expand_fragments(nodes, nodes.where("id LIKE 'c%7'")).select("id", "name")


@query(f"WITH {_NODES} SELECT DISTINCT coalesce(parent_id, id) AS id FROM n WHERE name LIKE '%U%'")
def jon13_promote_to_root(spark, d):
    return diff.promote_to_root(_nodes(spark, d).where("name LIKE '%U%'"))


@query(f"WITH {_NODES}, i AS (SELECT id FROM n WHERE id LIKE 'c%1' OR id LIKE 'o%1') SELECT id FROM n WHERE id IN (FROM i) AND parent_id IN (FROM i)")
def jon14_children_in_input(spark, d):
    nodes = _nodes(spark, d)
    return diff.children_in_input(nodes, nodes.where("id LIKE 'c%1' OR id LIKE 'o%1'")).select("id")


@query("SELECT l_partkey, p_name, p_brand, count(*) AS uses FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 25 GROUP BY ALL")
def jon5_reference_lookup(spark, d):
    parts = _t(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    return _t(spark, d, "lineitem").select("l_partkey").groupBy("l_partkey").agg(F.count("*").alias("uses")).join(parts, "l_partkey").select("l_partkey", "p_name", "p_brand", "uses")


@query("""SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber AS holds FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
  AND a.l_quantity::BIGINT >= b.l_linenumber * 5 AND a.l_quantity::BIGINT < b.l_linenumber * 5 + 12""")
def jon7_point_in_range(spark, d):
    li = _t(spark, d, "lineitem")
    points = li.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("at"))
    ranges = li.select("l_orderkey", F.col("l_linenumber").alias("holds"), (F.col("l_linenumber") * 5).cast("bigint").alias("lo"), F.lit(12).cast("bigint").alias("len"))
    return index.range_join(points, ranges, "l_orderkey", "at", "lo", "len", 16).select("l_orderkey", "l_linenumber", "holds")


@query("""SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
  AND a.o_orderdate < b.o_orderdate + INTERVAL 30 DAY AND b.o_orderdate < a.o_orderdate + INTERVAL 30 DAY""")
def jon8_interval_overlap(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("lo"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAY")).alias("hi"))
    a, b = o.select(*[F.col(c).alias(f"a_{c}") for c in o.columns]), o.select(*[F.col(c).alias(f"b_{c}") for c in o.columns])
    on = (F.col("a_o_custkey") == F.col("b_o_custkey")) & (F.col("a_o_orderkey") < F.col("b_o_orderkey")) & index.overlaps(F.col("a_lo"), F.col("a_hi"), F.col("b_lo"), F.col("b_hi"))
    return a.join(b, on).select(F.col("a_o_orderkey").alias("a"), F.col("b_o_orderkey").alias("b"))


@query("SELECT s_suppkey, n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON s_nationkey = n_nationkey")
def jon4_metadata_lookup(spark, d):
    n = _t(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return _t(spark, d, "supplier").join(n, "s_nationkey", "left").select("s_suppkey", "n_name")


# ---- filters ---------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') AND regexp_matches(p_brand, '(?i)brand#[1-3]') AND contains(lower(p_type), 'e')")
def flt1_text_match(spark, d):
    p = _t(spark, d, "part")
    return p.where(filters.text_match(F.col("p_name"), "A") & filters.text_match(F.col("p_brand"), "brand#[1-3]", True) & filters.name_match(F.col("p_type"), F.col("p_name"), "E")).select("p_partkey", "p_name")


@query(f"""WITH {_NODES}, h AS (SELECT * FROM n WHERE contains(lower(name), 'auto'))
SELECT DISTINCT id, name FROM n WHERE contains(lower(name), 'auto') OR parent_id IN (SELECT id FROM h) OR id IN (SELECT parent_id FROM h)""")
def flt3_self_parent_child(spark, d):
    return filters.matches_self_parent_or_child(_nodes(spark, d), filters.text_match(F.col("name"), "AUTO")).select("id", "name")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_discount >= 0.03 AND l_quantity > 20 AND year(l_shipdate) >= 1990""")
def flt10_conjunction(spark, d):
    c = F.col
    cond = filters.conjunction(filters.any_of(c("l_returnflag"), ["A", "R"]), filters.any_of(c("l_linestatus"), []), c("l_discount") >= 0.03, c("l_quantity") > 20, F.year("l_shipdate") >= 1990, None)
    return _t(spark, d, "lineitem").where(cond).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey FROM part WHERE NOT (regexp_matches(p_brand, '#1') AND p_size < 20 OR p_brand = 'Brand#22' AND p_size >= 20)")
def flt11_ignore_rules(spark, d):
    own = spark.createDataFrame([("#1", True, ["small"])], "pattern string, is_regex boolean, types array<string>")
    project = spark.createDataFrame([("Brand#22", False, ["large"])], own.schema)
    p = _t(spark, d, "part").withColumn("kind", F.when(F.col("p_size") < 20, "small").otherwise("large"))
    return filters.ignored(p, own.unionByName(project), "p_brand", "kind").select("p_partkey")


@query("SELECT p_partkey, p_name, instr(upper(p_name), 'E') AS at FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND instr(upper(p_name), 'E') > 0")
def flt15_completion(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("type"))
    return filters.complete(p, "e", ["Brand#11", "Brand#12", "Brand#13"]).select("p_partkey", F.col("name").alias("p_name"), F.col("at").cast("bigint").alias("at"))


@query("SELECT * FROM (VALUES ('DROP TABLE t', 'DROP TABLE'), ('ALTER TABLE t DROP COLUMN c', 'DROP COLUMN'), ('ALTER SEQUENCE s RESTART', 'RESTART')) t(sql, danger)")
def flt14_danger_gate(spark, d):
    script = "DROP TABLE t; SELECT ';'; ALTER TABLE t DROP COLUMN c; UPDATE t SET a = 1; -- x;\nALTER SEQUENCE s RESTART"
    return filters.danger_gate(spark.createDataFrame(scripts.split_script(script), "at int, sql string"), ["UPDATE"]).select("sql", "danger")


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 99, 'NEW'")
def flt23_duplicate_guard(spark, d):
    n = _t(spark, d, "nation").select("n_nationkey", "n_name")
    new = spark.createDataFrame([(99, "NEW")], n.schema).unionByName(n)
    return filters.insert_unless_present(n, new)


@query("SELECT page_id, split_part(url, '/', 3) AS host FROM pages WHERE url LIKE 'http%' AND split_part(url, '/', 1) IN ('http:', 'https:')")
def flt20_path_predicate(spark, d):
    return _t(spark, d, "pages").where(filters.starts_in(F.col("url"), ["http:", "https:"])).select("page_id", F.split("url", "/")[2].alias("host"))


# ---- aggregation ------------------------------------------------------------------------------


@query("""SELECT l_orderkey, count(*) AS total, count_if(l_quantity > 25) AS selected,
  (count_if(l_quantity > 25) BETWEEN 1 AND count(*) - 1) OR ((count_if(l_quantity > 25) > 0) <> (l_orderkey % 2 = 0)) AS gray FROM lineitem GROUP BY l_orderkey""")
def agg2_tri_state(spark, d):
    return diff.tri_state(_t(spark, d, "lineitem"), "l_orderkey", F.col("l_quantity") > 25, F.col("l_orderkey") % 2 == 0)


@query("SELECT count(*) AS total, count_if(c_acctbal > 0) AS selected, bool_or(c_acctbal < -900) AS any_low FROM customer")
def agg1_counts(spark, d):
    return _t(spark, d, "customer").agg(F.count("*").alias("total"), F.count_if(F.col("c_acctbal") > 0).alias("selected"), F.bool_or(F.col("c_acctbal") < -900).alias("any_low"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def agg4_group_lists(spark, d):
    return ordering.group_lists(_t(spark, d, "nation"), "n_regionkey", "n_nationkey", "n_name").select("n_regionkey", F.array_join("values", ",").alias("names"))


@query("SELECT n_nationkey, n_regionkey, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS group_pos FROM nation")
def agg5_group_flatten(spark, d):
    return ordering.group_flatten_order(_t(spark, d, "nation").select("n_nationkey", "n_regionkey"), "n_regionkey", "n_nationkey").orderBy("group_pos", "n_nationkey")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_event_type FROM events GROUP BY 1")
def agg6_last_actor(spark, d):
    return ev.last_per_key(_t(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])


@query("SELECT event_type, user_id % 10 AS label, ts::DATE::VARCHAR AS day, count(*) AS n FROM events GROUP BY ALL")
def agg8_daily_counts(spark, d):
    return ev.daily_counts(_t(spark, d, "events").withColumn("label", F.col("user_id") % 10), ["event_type", "label"]).withColumn("day", F.col("day").cast("string"))


@query("""WITH d AS (SELECT event_type, ts::DATE::VARCHAR AS day, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, day, n FROM d
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY day DESC) = 1""")
def agg8_current_counters(spark, d):
    return ev.current_counters(_t(spark, d, "events"), ["event_type"]).withColumn("day", F.col("day").cast("string"))


@query("SELECT ts::DATE::VARCHAR AS day, sum(event_id % 7)::BIGINT AS total FROM events GROUP BY 1 HAVING sum(event_id % 7) > 0")
def agg9_day_rollover(spark, d):
    return ev.rollover(_t(spark, d, "events").withColumn("v", F.col("event_id") % 7), "v").select(F.col("day").cast("string").alias("day"), "total")


@query("""WITH p AS (SELECT page_id, string_split(split_part(url, '://', 2), '/') AS s FROM pages),
u AS (SELECT unnest(range(1, len(s) + 1)) AS i, s FROM p) SELECT DISTINCT array_to_string(s[:i - 1], '/') AS parent, array_to_string(s[:i], '/') AS child FROM u""")
def agg13_result_tree(spark, d):
    return index.result_tree(_t(spark, d, "pages").select(F.split("url", "://")[1].alias("path")), "path")


# ---- ordering ----------------------------------------------------------------------------------


@query("SELECT user_id, max(ts) AS last_used FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200")
def lim1_most_recent(spark, d):
    return ordering.most_recent(_t(spark, d, "events"), "user_id", "ts", 200)


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 11")
def lim3_newest_per_group(spark, d):
    return ordering.newest_per_group(_t(spark, d, "events").select("event_id", "user_id"), "user_id", F.desc("event_id"), 11)


# ---- graph and index -----------------------------------------------------------------------------


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).where("parent_id IS NOT NULL").select(F.col("parent_id").alias("src"), F.col("id").alias("dst"))


@query(f"""WITH RECURSIVE {_NODES}, r(id, depth) AS (SELECT 'r1', 0 UNION ALL SELECT n.id, r.depth + 1 FROM r JOIN n ON n.parent_id = r.id WHERE r.depth < 2)
SELECT id, min(depth)::INT AS depth FROM r GROUP BY 1""")
def grf1_closure(spark, d):
    return graph.closure(_edges(spark, d), spark.createDataFrame([("r1",)], "id string"), 2)


@query(f"""WITH RECURSIVE {_NODES}, r(id) AS (SELECT id FROM n WHERE id LIKE 'o%99' UNION SELECT n.parent_id FROM r JOIN n ON n.id = r.id WHERE n.parent_id IS NOT NULL)
SELECT id FROM r WHERE id NOT LIKE 'o%99'""")
def grf5_required_by_selection(spark, d):
    up = _edges(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.required_by_selection(up, _nodes(spark, d).where("id LIKE 'o%99'")).select("id")


@query(f"WITH {_NODES} SELECT id, CASE left(id, 1) WHEN 'r' THEN 0 WHEN 'n' THEN 1 WHEN 'c' THEN 2 ELSE 3 END::INT AS layer FROM n")
def mut3_dependency_layers(spark, d):
    up = _edges(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.layers(up, _nodes(spark, d))


@query(f"""WITH RECURSIVE {_NODES}, r(id) AS (SELECT 'n3' UNION ALL SELECT n.id FROM r JOIN n ON n.parent_id = r.id) SELECT id FROM r""")
def grf6_subtree(spark, d):
    return graph.propagate_down(_nodes(spark, d), spark.createDataFrame([("n3",)], "id string")).select("id")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, upper(c_name) || '!' FROM customer WHERE c_custkey % 10 = 0")
def idx5_incremental(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_name")
    changed = c.where("c_custkey % 10 = 0").withColumn("c_name", F.concat(F.upper("c_name"), F.lit("!")))
    return index.incremental(c, changed, c.where("c_custkey % 10 = 5"), "c_custkey")


@query("SELECT doc_id, CASE WHEN length(text) >= 10 THEN 'X' || substr(text, 4, 4) || 'YY' || substr(text, 9) ELSE text END AS text FROM documents")
def mut1_rewrite(spark, d):
    t = _t(spark, d, "documents").select("doc_id", "text")
    edit = lambda at, n, new: F.struct(F.lit(at).alias("offset"), F.lit(n).alias("length"), F.lit(new).alias("new_text"))
    edits = t.where(F.length("text") >= 10).select("doc_id", F.explode(F.array(edit(7, 1, "YY"), edit(0, 3, "X"))).alias("e")).select("doc_id", "e.*")
    return index.rewrite(t, edits, "doc_id")


@query("SELECT doc_id, string_split(text, chr(10))[3] AS line FROM documents")
def src15_nth_line(spark, d):
    return _t(spark, d, "documents").select("doc_id", index.nth_line(F.col("text"), 2).alias("line"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 10 = 3")
def mut4_concurrency_check(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", F.col("c_name").alias("text"))
    return index.unchanged(c, c.withColumn("text", F.when(F.col("c_custkey") % 10 == 3, F.concat("text", F.lit("x"))).otherwise(F.col("text"))), "c_custkey")


# ---- events --------------------------------------------------------------------------------------


@query("SELECT event_id, user_id FROM events QUALIFY coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) - ts >= INTERVAL 6 HOUR, true)")
def str1_debounce(spark, d):
    return ev.debounce(_t(spark, d, "events"), "user_id", 6 * 3600 * 1000).select("event_id", "user_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-06-01' - INTERVAL 132 DAY")
def str3_ttl(spark, d):
    return ev.unexpired(_t(spark, d, "events"), F.lit("2024-06-01").cast("timestamp_ntz")).select("event_id")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def str2_tumbling(spark, d):
    return ev.tumbling(_t(spark, d, "events"), "1 hour", ["event_type"])


# ---- rendering -------------------------------------------------------------------------------------


@query(r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 60 THEN substr(t, 1, 60) || ' <...> ' ELSE t END AS preview FROM f""")
def prj6_preview(spark, d):
    return _t(spark, d, "documents").select("doc_id", formatting.preview(F.col("text")).alias("preview"))


@query("SELECT vec_id, '[' || label || ', NULL, {a=' || vec_id || ', b=NULL}]' AS text FROM embeddings")
def prj8_render_nested(spark, d):
    kind = T.ArrayType(T.StringType())
    inner = F.create_map(F.lit("a"), F.col("vec_id").cast("string"), F.lit("b"), F.lit(None).cast("string"))
    value = F.array(F.col("label").cast("string"), F.lit(None).cast("string"), formatting.render(inner, T.MapType(T.StringType(), T.StringType())))
    return _t(spark, d, "embeddings").select("vec_id", formatting.render(value, kind).alias("text"))


@query("""SELECT conv_id, turn, '''' || conv_id || ''',''' || replace(role, '''', '''''') || ''',' || CASE WHEN turn % 3 = 0 THEN 'NULL' ELSE '''' || replace(text, '''', '''''') || '''' END AS line FROM conversations""")
def prj9_csv_line(spark, d):
    c = _t(spark, d, "conversations")
    return c.select("conv_id", "turn", formatting.csv_line(F.col("conv_id"), F.col("role"), F.when(F.col("turn") % 3 != 0, F.col("text"))).alias("line"))


@query("SELECT string_agg('^' || r_name || '$', '|' ORDER BY r_name) || '|^\\Qa.b\\E$' AS pattern FROM region")
def prj10_selection_pattern(spark, d):
    names = F.array_append(F.sort_array(F.collect_list("r_name")), F.lit("a.b"))
    return _t(spark, d, "region").agg(formatting.selection_pattern(names).alias("pattern"))


@query("SELECT s_suppkey, 'jdbc:postgresql://' || s_name || ':5432/db' AS pg, 'jdbc:sqlserver://' || s_name || ':1433;databaseName={db}' AS ms, 'TBL ' || s_name AS label, CASE WHEN s_suppkey % 2 = 0 THEN '*' ELSE '' END || s_name AS owner FROM supplier")
def prj11_urls_and_labels(spark, d):
    n = F.col("s_name")
    return _t(spark, d, "supplier").select("s_suppkey", formatting.connection_url("PG", n, F.lit(5432), F.lit("db")).alias("pg"), formatting.connection_url("MS", n, F.lit(1433), F.lit("db")).alias("ms"), formatting.node_label(F.lit("TABLE"), n).alias("label"), formatting.user_label(n, F.col("s_suppkey") % 2 == 0).alias("owner"))


@query("""SELECT 'INSERT INTO region (r_regionkey, r_name)' || chr(10) || 'VALUES' || chr(10) || string_agg('(' || r_regionkey || ', ''' || r_name || '''::text)', ',' || chr(10) ORDER BY r_regionkey) || ';' AS script FROM region""")
def snk1_insert_script(spark, d):
    return generate.insert_script(_t(spark, d, "region").select("r_regionkey", "r_name"), "region", "r_regionkey", {"r_name": "text"})


# ---- generated rows ----------------------------------------------------------------------------------


@query("""SELECT 5 + i * 3 AS i, (1.5 + i * 0.25)::DOUBLE AS r, (DATE '2020-01-01' + (i * 2)::INT)::VARCHAR AS d, (86399000000 + i * 1000000) % 86400000000 AS t, TIMESTAMP '2020-01-01' + to_milliseconds(i * 1500) AS ts, i = 0 AS b, NULL::VARCHAR AS x, NULL::VARCHAR AS y, NULL::VARCHAR AS z, 'k' AS c, 'data' AS a
FROM range(1000) t(i)""")
def gen_increment_constant(spark, d):
    import datetime as dt

    s, inc = generate.ColumnSpec, generate.INCREMENT
    specs = [
        s("i", "integer", inc, 5, step=3), s("r", "double", inc, 1.5, step=0.25), s("d", "date", inc, dt.date(2020, 1, 1), step=2), s("t", "time", inc, 86_399_000_000),
        s("ts", "timestamp", inc, dt.datetime(2020, 1, 1), step=1500), s("b", "boolean", inc, True), s("c", "text", generate.CONSTANT, "k"), s("a", "other", generate.ANY), s("x", "text", inc), s("y", "bit", inc), s("z", "json", inc),
    ]
    return generate.generate(spark, specs, 1000).withColumn("i", F.col("i").cast("bigint")).withColumn("d", F.col("d").cast("string"))


@query("SELECT 1000::BIGINT AS n, 1000::BIGINT AS ids, true AS bounds, true AS bits, true AS texts, true AS nulls, true AS dates")
def gen_random(spark, d):
    s = generate.ColumnSpec
    specs = [s("i", "integer", start=-500, end=499, unique=True), s("j", "integer", start=400, end=410), s("b", "bit", length=5, not_null=True), s("t", "text", length=9, not_null=True), s("u", "text", length=3, unique=True), s("d", "date", not_null=True), s("js", "json", length=6)]
    g = generate.generate(spark, specs, 1000, 3)
    ok = lambda c: F.bool_and(c)
    return g.agg(
        F.count("*").alias("n"), F.count_distinct("i").alias("ids"), (ok(F.col("i").between(-500, 499)) & ok(F.coalesce(F.col("j").between(400, 410), F.lit(True))) & (F.count_distinct("u") == 1000)).alias("bounds"), ok(F.col("b").rlike("^[01]{5}$")).alias("bits"),
        ok(F.col("t").rlike("^[a-z][a-z ]{0,8}$") & ~F.contains("t", F.lit("  "))).alias("texts"), F.count_if(F.col("j").isNull()).between(10, 120).alias("nulls"), ok(F.year("d").between(1970, 2070)).alias("dates"),
    )


# ---- functions of the dialect -------------------------------------------------------------------------


@query(r"""SELECT p_partkey, log10(p_retailprice) AS lg, trunc(-p_retailprice)::DOUBLE AS tr, concat(p_brand, NULL, p_type) AS cc, regexp_replace(p_name, '([aeiou])', '<\1>') AS r1, regexp_replace(p_name, '([aeiou])', '<\1>', 'g') AS rg, p_size // 4 AS dv, substr(p_name, 1, 1) AS sb, chr(1040 + p_size) AS ch, lower(hex(p_brand)) AS hx FROM part""")
def fn_dialect(spark, d):
    p, c = _t(spark, d, "part"), F.col
    return p.select(
        "p_partkey", dialect.pg_log(c("p_retailprice")).alias("lg"), dialect.pg_trunc(-c("p_retailprice")).alias("tr"), dialect.pg_concat(c("p_brand"), F.lit(None).cast("string"), c("p_type")).alias("cc"), dialect.pg_regexp_replace(c("p_name"), "([aeiou])", r"<\1>").alias("r1"),
        dialect.pg_regexp_replace(c("p_name"), "([aeiou])", r"<\1>", "g").alias("rg"), dialect.pg_div(c("p_size"), F.lit(4)).cast("int").alias("dv"), dialect.pg_substr(c("p_name"), F.lit(-1), F.lit(3)).alias("sb"), dialect.pg_chr(c("p_size") + 1040).alias("ch"), dialect.pg_encode(c("p_brand"), "hex").alias("hx"),
    )


@query("""SELECT o_orderpriority, sum(o_orderkey)::BIGINT AS s, count(CASE WHEN o_orderkey % 3 = 0 THEN 1 END) AS n3, max(dayofweek(o_orderdate))::INT AS dow, len(list(CASE WHEN o_orderkey % 3 = 0 THEN 1 END))::INT AS with_nulls FROM orders GROUP BY 1""")
def fn_dialect_aggregates(spark, d):
    third = F.when(F.col("o_orderkey") % 3 == 0, 1)
    return _t(spark, d, "orders").groupBy("o_orderpriority").agg(dialect.pg_sum(F.col("o_orderkey")).cast("bigint").alias("s"), F.count(third).alias("n3"), F.max(dialect.pg_dow(F.col("o_orderdate"))).alias("dow"), F.size(dialect.pg_array_agg(third)).alias("with_nulls"))


@query("SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, lag(o_orderkey) OVER w AS prev, ntile(4) OVER w AS q FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def fn_window(spark, d):
    return _sql(spark, d, "orders", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, lag(o_orderkey) OVER w AS prev, ntile(4) OVER w AS q FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")


@query("SELECT event_type, (props->>'k')::BIGINT AS k, count(*) AS n FROM events GROUP BY ALL")
def fn_json(spark, d):
    return _t(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k")).agg(F.count("*").alias("n"))


# ---- the SQL surface ------------------------------------------------------------------------------------


def _sql(spark: SparkSession, d: str, tables: str, text: str) -> DataFrame:
    """Runs a script over views of the tables; its last statement is the result."""
    for t in tables.split():
        _t(spark, d, t).createOrReplaceTempView(t)
    return scripts.run_script(spark, text)


def _both(name: str, tables: str, text: str, oracle: str | None = None) -> None:
    def run(spark, d):
        return _sql(spark, d, tables, text)

    run.__name__ = name
    query(oracle or text)(run)


_both("sql6_case", "lineitem", "SELECT l_returnflag, CASE l_linestatus WHEN 'O' THEN 'open' ELSE 'final' END AS status, sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS big FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, CASE l_linestatus WHEN 'O' THEN 'open' ELSE 'final' END AS status, sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END)::BIGINT AS big FROM lineitem GROUP BY l_returnflag, l_linestatus")
_both("sql7_group_by", "orders", scripts.fill("group", column="o_orderstatus", table="orders"))
_both("sql9_grouping_sets", "customer", "SELECT c_mktsegment, c_nationkey, count(*) AS n, max(c_acctbal) AS hi FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
_both("sql17_recursive", "nation", "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 20) SELECT r.n, n_name FROM r JOIN nation ON n_nationkey = r.n")
_both("sql18_lateral", "region nation", "SELECT r_name, x.n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey AND n_name > 'I') x")
_both("sql19_ordinality", "documents", "SELECT doc_id, pos + 1 AS ord, line FROM documents LATERAL VIEW posexplode(split(text, '\\n')) t AS pos, line", "SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1))::INT AS ord, unnest(string_split(text, chr(10))) AS line FROM documents")
_both("sql25_constraints", "orders lineitem", "SELECT 'fk' AS kind, count(*) AS n FROM lineitem LEFT ANTI JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 'unique', count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'check', count(*) FROM lineitem WHERE NOT l_quantity > 1", "SELECT 'fk' AS kind, count(*) AS n FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 'unique', count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'check', count(*) FROM lineitem WHERE NOT l_quantity > 1")
_both("sql13_lambda_function", "part", "CREATE OR REPLACE TEMPORARY FUNCTION plus_three(a INT) RETURNS INT RETURN a + 3; SELECT p_partkey, plus_three(p_size) AS s FROM part", "SELECT p_partkey, p_size + 3 AS s FROM part")
_both("sql14_clamped_sum", "part", "CREATE OR REPLACE TEMPORARY FUNCTION clamped_sum(a INT, b INT) RETURNS INT RETURN greatest(a + b, 0); SELECT p_partkey, clamped_sum(p_size, -20) AS s FROM part", "SELECT p_partkey, greatest(p_size - 20, 0) AS s FROM part")
_both("sql16_aggregate", "part", "SELECT p_brand, aggregate(collect_list(p_size), 0, (a, x) -> a + x, a -> a * 1.0D) / count(p_size) AS mean FROM part GROUP BY p_brand", "SELECT p_brand, sum(p_size)::DOUBLE / count(p_size) AS mean FROM part GROUP BY p_brand")
_both("sql26_sequence", "nation", "SELECT n_nationkey, 555888 + 555 * (row_number() OVER (ORDER BY n_nationkey) - 1) AS id FROM nation")


@query("SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)) GROUP BY 1")
def sql29_dependent_rows(spark, d):
    c = _t(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    o = _t(spark, d, "orders").join(c, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    return _t(spark, d, "lineitem").join(o, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))


# ---- more filters, lookups and graph queries -----------------------------------------------------------------


@query(f"WITH {_NODES} SELECT id FROM n WHERE contains(lower(parent_id || '.' || id), 'n1.c')")
def flt2_name_filter(spark, d):
    n = _nodes(spark, d)
    return n.where(filters.name_match(F.col("name"), F.concat_ws(".", "parent_id", "id"), "N1.c")).select("id")


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#12' AND len(string_split(p_brand || '/' || p_type || '/' || p_name || '.sql', '/')) = 3")
def flt21_schema_file(spark, d):
    path = F.concat_ws("/", "p_brand", "p_type", F.concat("p_name", F.lit(".sql")))
    return _t(spark, d, "part").where(filters.is_schema_file(path, "Brand#12")).select("p_partkey")


_STATES = f"""{_NODES}, s AS (SELECT id, parent_id, CASE WHEN right(id, 1) IN ('1', '3', '5', '7', '9') THEN 'LEFT' ELSE 'RIGHT' END AS side, id LIKE 'c%4' AS selected FROM n)"""


@query(f"""WITH RECURSIVE {_STATES}, up(id) AS (SELECT parent_id FROM s WHERE selected UNION SELECT s.parent_id FROM up JOIN s ON s.id = up.id WHERE s.parent_id IS NOT NULL)
SELECT id, side FROM s WHERE NOT selected AND (side = 'LEFT' AND parent_id IN (SELECT id FROM s WHERE selected) OR side = 'RIGHT' AND id IN (SELECT id FROM up))""")
def flt24_unselected_dependents(spark, d):
    side = F.when(F.right("id", F.lit(1)).isin("1", "3", "5", "7", "9"), "LEFT").otherwise("RIGHT")
    return graph.unselected_dependents(_nodes(spark, d).select("id", "parent_id", side.alias("side"), F.col("id").like("c%4").alias("selected")))


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def jon6_definition_lookup(spark, d):
    return _t(spark, d, "part").join(_t(spark, d, "lineitem").where("l_quantity > 49"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 40 OR l_suppkey % 5 = p_partkey % 5")
def jon9_rename_scope(spark, d):
    parts = _t(spark, d, "part").select("p_partkey", "p_size")
    scope = (F.col("p_size") > 40) | (F.col("l_suppkey") % 5 == F.col("p_partkey") % 5)
    return _t(spark, d, "lineitem").join(parts, (F.col("l_partkey") == F.col("p_partkey")) & scope).select("l_orderkey", "l_linenumber")


@query(f"""WITH {_SIDES} SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT l.c_custkey FROM l LEFT JOIN r USING (c_custkey)
WHERE r.c_custkey IS NULL OR l.c_acctbal IS DISTINCT FROM r.c_acctbal OR l.c_mktsegment IS DISTINCT FROM r.c_mktsegment)""")
def jon10_override_semi_join(spark, d):
    changed = diff.two_sided_diff(*_sides(spark, d), ["c_custkey"]).where(F.col("side") != diff.RIGHT)
    return _t(spark, d, "orders").join(changed, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("""SELECT a.l_orderkey, a.l_linenumber, min(b.l_linenumber * 5)::BIGINT AS lo FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
  AND a.l_quantity::BIGINT >= b.l_linenumber * 5 AND a.l_quantity::BIGINT < b.l_linenumber * 5 + 12 GROUP BY ALL""")
def jon16_first_range(spark, d):
    li = _t(spark, d, "lineitem")
    points = li.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("at"))
    ranges = li.select("l_orderkey", (F.col("l_linenumber") * 5).cast("bigint").alias("lo"), F.lit(12).cast("bigint").alias("len"))
    return index.first_range(points, ranges, "l_orderkey", "at", "lo", "len", ["l_orderkey", "l_linenumber"], 16)


@query(f"""WITH RECURSIVE {_NODES}, r(id) AS (SELECT id FROM n WHERE parent_id IN ('n3', 'n7') UNION ALL SELECT n.id FROM r JOIN n ON n.parent_id = r.id)
SELECT id FROM r WHERE id NOT LIKE '%5'""")
def grf2_drop_dependants(spark, d):
    return graph.dependants_on_side(_edges(spark, d), spark.createDataFrame([("n3",), ("n7",)], "id string"), _nodes(spark, d).where("id NOT LIKE '%5'"))


@query(f"WITH {_NODES} SELECT parent_id AS src, id AS dst FROM n WHERE parent_id LIKE 'n%'")
def grf3_neighbours(spark, d):
    return graph.neighbours(_edges(spark, d), _nodes(spark, d).where("id LIKE 'n%'"))


@query(f"""WITH RECURSIVE {_NODES}, e AS (SELECT parent_id AS src, id AS dst FROM n WHERE parent_id IS NOT NULL UNION ALL SELECT 'extra', 'r1'),
r(id, depth) AS (SELECT 'extra', 0 UNION ALL SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.id WHERE depth < 3) SELECT id, depth::INT AS depth FROM r""")
def grf4_extra_edges(spark, d):
    edges = _edges(spark, d).unionByName(spark.createDataFrame([("extra", "r1")], "src string, dst string"))
    return graph.closure(edges, spark.createDataFrame([("extra",)], "id string"), 3)


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey % 7 <> 0 UNION ALL SELECT DISTINCT o_custkey, -o_custkey FROM orders WHERE o_custkey % 7 = 0")
def idx1_upsert(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey")
    return index.upsert(o, o.where("o_custkey % 7 = 0").select("o_custkey", (-F.col("o_custkey")).alias("o_orderkey")).distinct(), "o_custkey")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey % 7 <> 0")
def idx2_delete(spark, d):
    return index.delete(_t(spark, d, "orders").select("o_custkey", "o_orderkey"), _t(spark, d, "customer").where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")


@query("SELECT c_custkey AS o_custkey, count(o_orderkey)::INT AS n, coalesce(min(o_orderkey), -1) AS first FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def idx4_lookup(spark, d):
    found = index.lookup(_t(spark, d, "orders"), _t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "o_orderkey")
    return found.select("o_custkey", F.size("values").alias("n"), F.coalesce(F.get("values", F.lit(0)), F.lit(-1)).alias("first"))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_custkey % 2 <> 0 ELSE c_custkey % 2 = 0 END AS selected FROM customer")
def mut5_invert_selection(spark, d):
    selected = F.col("c_custkey") % 2 == 0
    return _t(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, ~selected).otherwise(selected).alias("selected"))


@query("SELECT user_id, bool_or(event_type IN ('click', 'view', 'error')) AS changed, bool_or(event_type = 'error') AS untracked FROM events GROUP BY 1")
def agg7_status_flags(spark, d):
    return ev.status_flags(_t(spark, d, "events"), "user_id", "event_type", ["click", "view"], "error")


@query("SELECT DISTINCT event_type AS component, user_id % 10 AS action FROM events")
def agg10_distinct_types(spark, d):
    return ev.distinct_types(_t(spark, d, "events").select(F.col("event_type").alias("component"), (F.col("user_id") % 10).alias("action"), "ts")).select("component", "action")


@query("SELECT event_id, event_type || ' ' || user_id AS label, (row_number() OVER (PARTITION BY user_id ORDER BY event_id))::INT AS row FROM events")
def prj5_outline_and_row_number(spark, d):
    row = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return _t(spark, d, "events").select("event_id", formatting.outline_label(F.col("event_type"), F.col("user_id")).alias("label"), row.alias("row"))


@query("SELECT p_partkey, regexp_replace(p_name, '\\s', '-', 'g') AS name, 'run ' || p_brand || ' as ' || p_type AS command FROM part")
def prj12_names_and_placeholders(spark, d):
    c = F.col
    return _t(spark, d, "part").select("p_partkey", formatting.sanitise(c("p_name")).alias("name"), formatting.fill_placeholders(F.lit("run %db% as %user%"), {"db": c("p_brand"), "user": c("p_type")}).alias("command"))


@query("SELECT event_id, 'k' AS name, props->>'k' AS value FROM events WHERE props->>'k' IS NOT NULL")
def prj17_map_entries(spark, d):
    return formatting.entries(_t(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("p")), "event_id", "p").where("name = 'k'")


_both("sql11_views", "customer", "CREATE OR REPLACE TEMPORARY VIEW rich AS SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_acctbal > 5000; SELECT * FROM rich", "SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_acctbal > 5000")
_both("sql15_table_function", "region nation", "CREATE OR REPLACE TEMPORARY FUNCTION nations_of(k INT) RETURNS TABLE(nation STRING) RETURN SELECT n_name FROM nation WHERE n_regionkey = k; SELECT r_name, f.nation FROM region, LATERAL nations_of(r_regionkey) f", "SELECT r_name, n_name AS nation FROM region JOIN nation ON n_regionkey = r_regionkey")
_both("sql20_xml_table", "region", "SELECT r_regionkey, explode(from_xml(concat('<r><a>', r_regionkey, '</a><a>9</a></r>'), 'a array<int>').a) AS a FROM region", "SELECT r_regionkey, unnest([r_regionkey, 9]) AS a FROM region")
_both("sql21_named_arguments", "part", "CREATE OR REPLACE TEMPORARY FUNCTION difference(a INT, b INT) RETURNS INT RETURN a - b; SELECT p_partkey, difference(b => 1, a => p_size) AS s FROM part", "SELECT p_partkey, p_size - 1 AS s FROM part")
_both("sql22_functional_dependency", "customer orders", "SELECT c_custkey, any_value(c_name) AS c_name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
_both("sql27_row_policy", "customer", "CREATE OR REPLACE TEMPORARY VIEW own_rows AS SELECT * FROM customer WHERE c_nationkey = 7; SELECT c_custkey, c_mktsegment FROM own_rows WHERE c_acctbal > 0", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey = 7 AND c_acctbal > 0")
_both("sql28_dictionary", "supplier nation", "SELECT s_suppkey, coalesce(n_name, '') AS nation FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey <> 2")
_both("sql30_composite", "nation", "SELECT n_nationkey, c.f2 AS f2, c.f1 + 1 AS f1 FROM (SELECT n_nationkey, named_struct('f1', n_regionkey, 'f2', n_name) AS c FROM nation)", "SELECT n_nationkey, n_name AS f2, n_regionkey + 1 AS f1 FROM nation")
_both("sql_set_operations", "customer supplier", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT c_nationkey + 100 FROM customer EXCEPT SELECT s_nationkey + 100 FROM supplier)")
_both("sql_cube", "part", "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY CUBE (p_brand, p_size)")

# ---- families of the function vocabulary ------------------------------------------------------------------------

_both("fn_math", "part", "SELECT p_partkey, abs(-p_size) AS a, CAST(ceil(p_retailprice) AS BIGINT) AS c, CAST(floor(p_retailprice) AS BIGINT) AS f, round(sqrt(p_retailprice), 6) AS q, round(ln(p_retailprice), 6) AS l, round(exp(p_size / 10.0e0), 4) AS e, round(power(p_size, 1.5e0), 6) AS w, CAST(sign(p_size - 25) AS INT) AS s, p_size % 7 AS m, greatest(p_size, 20) AS g, least(p_size, 20) AS k, round(degrees(p_size * 1e0), 6) AS dg, round(atan2(p_size * 1e0, 2e0), 6) AS at, round(cbrt(p_size), 6) AS cb FROM part")
_both("fn_string", "part", "SELECT p_partkey, upper(p_name) AS u, length(p_name) AS n, reverse(p_name) AS r, lpad(p_name, 12, '*') AS lp, rpad(p_name, 12, '*') AS rp, repeat(p_brand, 2) AS rt, left(p_name, 3) AS lf, right(p_name, 3) AS rg, position('a' IN p_name) AS po, replace(p_name, 'a', 'b') AS re, trim(concat(' ', p_name, ' ')) AS tr, translate(p_name, 'aeiou', '12345') AS tl, split_part(p_brand, '#', 2) AS sp, ascii(p_name) AS ac, md5(p_name) AS md, substring(p_name, 2, 4) AS sb FROM part", "SELECT p_partkey, upper(p_name) AS u, length(p_name)::INT AS n, reverse(p_name) AS r, lpad(p_name, 12, '*') AS lp, rpad(p_name, 12, '*') AS rp, repeat(p_brand, 2) AS rt, left(p_name, 3) AS lf, right(p_name, 3) AS rg, position('a' IN p_name)::INT AS po, replace(p_name, 'a', 'b') AS re, trim(concat(' ', p_name, ' ')) AS tr, translate(p_name, 'aeiou', '12345') AS tl, split_part(p_brand, '#', 2) AS sp, ascii(p_name) AS ac, md5(p_name) AS md, substring(p_name, 2, 4) AS sb FROM part")
_both("fn_datetime", "orders", "SELECT o_orderkey, extract(year FROM o_orderdate) AS y, extract(quarter FROM o_orderdate) AS q, extract(month FROM o_orderdate) AS m, extract(day FROM o_orderdate) AS dd, extract(week FROM o_orderdate) AS w, extract(doy FROM o_orderdate) AS dy, CAST(last_day(o_orderdate) AS STRING) AS ld, CAST(CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS STRING) AS nm FROM orders", "SELECT o_orderkey, extract(year FROM o_orderdate)::INT AS y, extract(quarter FROM o_orderdate)::INT AS q, extract(month FROM o_orderdate)::INT AS m, extract(day FROM o_orderdate)::INT AS dd, extract(week FROM o_orderdate)::INT AS w, extract(doy FROM o_orderdate)::INT AS dy, CAST(last_day(o_orderdate) AS VARCHAR) AS ld, CAST(CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS nm FROM orders")
_both("fn_statistics", "lineitem", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_discount), 6) AS cp, round(stddev_samp(l_quantity), 6) AS ss, round(var_pop(l_quantity), 4) AS vp, round(regr_slope(l_extendedprice, l_quantity), 3) AS rs, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, bool_and(l_quantity > 0) AS ba, bit_xor(l_orderkey) AS bx, bit_or(l_linenumber) AS bo, count(DISTINCT l_suppkey) AS nd FROM lineitem GROUP BY l_returnflag")
_both("fn_percentile", "lineitem", "SELECT l_returnflag, percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity) AS med, percentile_disc(0.9) WITHIN GROUP (ORDER BY l_linenumber) AS p90 FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity) AS med, percentile_disc(0.9) WITHIN GROUP (ORDER BY l_linenumber)::DOUBLE AS p90 FROM lineitem GROUP BY l_returnflag")
_both("fn_window_more", "orders", "SELECT o_orderkey, dense_rank() OVER w AS dr, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd, lead(o_orderkey, 2) OVER w AS ld, first_value(o_orderkey) OVER w AS fv, nth_value(o_orderkey, 2) OVER w AS nv, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS fr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
_both("fn_array", "part", "SELECT p_partkey, size(a) AS n, array_contains(a, 'x') AS has, array_join(array_sort(a), '-') AS srt, array_join(array_distinct(array_sort(a)), '-') AS dst, element_at(a, 1) AS hd FROM (SELECT p_partkey, split(p_name, ' ') AS a FROM part)", "SELECT p_partkey, len(a)::INT AS n, list_contains(a, 'x') AS has, array_to_string(list_sort(a), '-') AS srt, array_to_string(list_sort(list_distinct(a)), '-') AS dst, a[1] AS hd FROM (SELECT p_partkey, string_split(p_name, ' ') AS a FROM part)")


# ---- levels, labels and further filters ---------------------------------------------------------------

_KINDS = ["TABLE", "INDEX", "FUNCTION", "POLICY", "STATISTICS", "ROLE", "COLUMN"]


@query("""WITH p AS (SELECT p_partkey, ['PG', 'MS', 'CH'][p_partkey % 3 + 1] AS dialect, ['TABLE', 'INDEX', 'FUNCTION', 'POLICY', 'STATISTICS', 'ROLE', 'COLUMN'][p_size % 7 + 1] AS kind FROM part)
SELECT p_partkey, dialect, kind, CASE kind WHEN 'TABLE' THEN 'CONTAINER' WHEN 'INDEX' THEN 'SUB_ELEMENT' WHEN 'FUNCTION' THEN if(dialect = 'CH', 'SCHEMA', 'CONTAINER')
  WHEN 'POLICY' THEN CASE dialect WHEN 'CH' THEN 'SCHEMA' WHEN 'PG' THEN 'SUB_ELEMENT' ELSE 'UNKNOWN' END
  WHEN 'STATISTICS' THEN CASE dialect WHEN 'PG' THEN 'CONTAINER' WHEN 'MS' THEN 'SUB_ELEMENT' ELSE 'UNKNOWN' END
  WHEN 'ROLE' THEN if(dialect = 'PG', 'UNKNOWN', 'SCHEMA') ELSE 'UNKNOWN' END AS level FROM p""")
def prj3_object_level(spark, d):
    pick = lambda values, n: F.element_at(F.array(*[F.lit(x) for x in values]), (n + 1).cast("int"))
    p = _t(spark, d, "part").select("p_partkey", pick(["PG", "MS", "CH"], F.col("p_partkey") % 3).alias("dialect"), pick(_KINDS, F.col("p_size") % len(_KINDS)).alias("kind"))
    return p.withColumn("level", levels.object_level(F.col("dialect"), F.col("kind")))


@query("""SELECT * FROM (VALUES ('ASSEMBLY', 'SCHEMA'), ('CONSTRAINT', 'SUB_ELEMENT'), ('INDEX', 'SUB_ELEMENT'), ('ROLE', 'SCHEMA'), ('SCHEMA', 'SCHEMA'), ('STATISTICS', 'SUB_ELEMENT'),
  ('TRIGGER', 'SUB_ELEMENT'), ('USER', 'SCHEMA')) t(type, level)""")
def prj4_types_for_levels(spark, d):
    return levels.types_at(spark, "MS", "SCHEMA", "SUB_ELEMENT")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '*' ELSE '' END || CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS label FROM events")
def prj2_user_label(spark, d):
    user = F.when(F.col("event_id") % 3 != 0, F.col("event_type"))
    return _t(spark, d, "events").select("event_id", formatting.user_label(user, F.col("event_id") % 2 == 0).alias("label"))


@query("""SELECT * FROM (VALUES (0, 12, 'DROP TABLE t', 'DROP TABLE statement'), (14, 30, 'ALTER TABLE t ALTER c TYPE int', 'ALTER COLUMN ... TYPE statement'),
  (45, 18, 'UPDATE t SET a = 1', 'UPDATE statement')) t("offset", "length", sql, warning)""")
def flt25_danger_annotation(spark, d):
    found = spark.createDataFrame(scripts.split_script("DROP TABLE t; ALTER TABLE t ALTER c TYPE int;UPDATE t SET a = 1; SELECT 1"), "at int, sql string")
    return filters.danger_gate(found, []).select(F.col("at").alias("offset"), F.length("sql").alias("length"), "sql", levels.danger_text(F.col("danger")).alias("warning"))


@query(f"WITH {_NODES} SELECT n.id, n.name FROM n LEFT JOIN n p ON p.id = n.parent_id WHERE contains(lower(CASE WHEN n.parent_id IS NULL THEN n.name ELSE p.name END), 'asia')")
def flt4_container_filter(spark, d):
    return filters.in_container(_nodes(spark, d), "ASIA").select("id", "name")


@query(f"""WITH {_NODES}, u AS (SELECT *, 'user' || right(id, 1) AS owner FROM n), h AS (SELECT * FROM u WHERE contains(owner, 'user7') AND length(id) > 3)
SELECT id, owner FROM u WHERE id IN (SELECT id FROM h) OR parent_id IN (SELECT id FROM h) OR id IN (SELECT parent_id FROM h)""")
def flt5_user_filter(spark, d):
    nodes = _nodes(spark, d).withColumn("owner", F.concat(F.lit("user"), F.expr("right(id, 1)")))
    return filters.matches_self_parent_or_child(nodes, filters.text_match(F.col("owner"), "USER7") & (F.length("id") > 3)).select("id", "owner")


@query(f"""WITH {_NODES}, h AS (SELECT * FROM n WHERE left(id, 1) = 'n') SELECT id FROM n WHERE id IN (SELECT id FROM h) OR parent_id IN (SELECT id FROM h) OR id IN (SELECT parent_id FROM h)""")
def flt6_type_filter(spark, d):
    nodes = _nodes(spark, d).withColumn("type", F.expr("left(id, 1)"))
    return filters.matches_self_parent_or_child(nodes, filters.any_of(F.col("type"), ["n"])).select("id")


@query(f"WITH {_NODES}, h AS (SELECT * FROM n WHERE id LIKE '%3') SELECT id FROM n WHERE id IN (SELECT id FROM h) OR id IN (SELECT parent_id FROM h)")
def flt7_side_filter(spark, d):
    nodes = _nodes(spark, d).withColumn("side", F.when(F.col("id").endswith("3"), "LEFT").otherwise("BOTH"))
    return filters.matches_self_or_child(nodes, filters.any_of(F.col("side"), ["LEFT"])).select("id")


@query(f"""WITH {_NODES}, h AS (SELECT * FROM n WHERE id LIKE '%77') SELECT id FROM n WHERE id IN (SELECT id FROM h) OR parent_id IN (SELECT id FROM h) OR id IN (SELECT parent_id FROM h)""")
def flt8_local_changes(spark, d):
    nodes = _nodes(spark, d).withColumn("changed", F.when(F.col("id").endswith("77"), True))
    return filters.matches_self_parent_or_child(nodes, F.col("changed")).select("id")


@query("SELECT doc_id FROM documents WHERE lang IS NULL AND source IS NOT NULL AND n_chars >= 0")
def flt9_hide_library(spark, d):
    c = _t(spark, d, "documents")
    return c.where(filters.conjunction(F.col("lang").isNull(), filters.is_outline(F.col("source"), F.col("n_chars")))).select("doc_id")


@query("""SELECT p_partkey FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#12') AND NOT regexp_matches(p_type, 'A$')""")
def flt12_ignore_union(spark, d):
    one = lambda *rules: spark.createDataFrame([(p, r, []) for p, r in rules], "pattern string, is_regex boolean, types array<string>")
    rules = filters.ignore_lists(one(("Brand#11:", True), ("A$", True)), None, one(("Brand#12:", True)), one(("A$", True)))
    p = _t(spark, d, "part").withColumn("name", F.concat_ws(":", "p_brand", "p_type"))
    return filters.ignored(p, rules, "name", "p_type").select("p_partkey")


@query("SELECT page_id FROM pages WHERE url = (SELECT min(url) FROM pages)")
def flt17_same_file(spark, d):
    p = _t(spark, d, "pages")
    return p.join(p.agg(F.min("url").alias("url")), "url", "left_semi").select("page_id")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 1 AND s_nationkey = (SELECT min(s_nationkey) FROM supplier WHERE s_suppkey % 2 = 1) ORDER BY s_suppkey LIMIT 1")
def flt18_connection_pick(spark, d):
    s = _t(spark, d, "supplier").withColumn("dialect", F.when(F.col("s_suppkey") % 2 == 1, "PG").otherwise("MS"))
    least = s.where("dialect = 'PG'").agg(F.min("s_nationkey").alias("s_nationkey"))
    named = s.join(least, "s_nationkey", "left_semi").withColumn("name", F.lit("main")).withColumn("position", F.col("s_suppkey"))
    return filters.pick_connection(named, "PG", "main").select("s_suppkey", "s_name")


@query("SELECT doc_id FROM documents WHERE lang IS NOT NULL AND trim(lang) <> '' AND source IS NOT NULL AND trim(source) <> ''")
def flt19_not_blank(spark, d):
    return _t(spark, d, "documents").where(filters.not_blank(F.col("lang"), F.col("source"))).select("doc_id")


# ---- further joins, counts and orders --------------------------------------------------------------------


@query(f"""WITH {_SIDES} SELECT coalesce(l.c_custkey, r.c_custkey) AS c_custkey FROM l FULL JOIN r ON l.c_custkey = r.c_custkey
WHERE (l.c_custkey IS NULL OR r.c_custkey IS NULL OR l.c_acctbal IS DISTINCT FROM r.c_acctbal OR l.c_mktsegment IS DISTINCT FROM r.c_mktsegment) AND NOT regexp_matches(coalesce(l.c_name, r.c_name), '1$')""")
def jon2_edits_only(spark, d):
    rules = spark.createDataFrame([("1$", True, [])], "pattern string, is_regex boolean, types array<string>")
    edits = diff.two_sided_diff(*_sides(spark, d), ["c_custkey"]).withColumn("name", F.coalesce("c_name_left", "c_name_right"))
    return filters.ignored(edits, rules, "name", "side").select("c_custkey")


@query("SELECT o_orderkey, o_orderpriority AS path FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 4 <> 0 AND o_orderpriority IN (SELECT o_orderpriority FROM orders WHERE o_orderpriority < '3')")
def jon15_by_path(spark, d):
    o = _t(spark, d, "orders")
    elements = o.select("o_orderkey", F.col("o_orderpriority").alias("path"), F.when(F.col("o_orderstatus") == "F", "RIGHT").otherwise("LEFT").alias("side"), F.when(F.col("o_orderkey") % 4 == 0, "lib").alias("library"))
    return diff.by_path(elements, o.where("o_orderpriority < '3'").select(F.col("o_orderpriority").alias("path"))).select("o_orderkey", "path")


@query("SELECT o_orderkey, coalesce(bool_or(l_returnflag = 'R'), false) AS any_returned FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def agg3_any_child(spark, d):
    hit = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"))
    return _t(spark, d, "orders").select("o_orderkey").join(hit, "o_orderkey", "left").withColumn("any_returned", F.coalesce("any_returned", F.lit(False)))


@query("SELECT event_type, user_id, max(event_id) AS position FROM events GROUP BY ALL")
def agg11_history(spark, d):
    return _t(spark, d, "events").groupBy("event_type", "user_id").agg(F.max("event_id").alias("position"))


@query("""WITH p AS (SELECT string_split(split_part(url, '://', 2), '/') AS s FROM pages), u AS (SELECT unnest(range(1, len(s))) AS i, s FROM p)
SELECT array_to_string(s[:i], '/') AS directory, count(*) AS "count" FROM u GROUP BY 1""")
def agg12_file_count(spark, d):
    return files.count_files(_t(spark, d, "pages").select(F.split("url", "://")[1].alias("path")).where("contains(path, '/')"))


@query("SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_name)::INT AS by_name, row_number() OVER (ORDER BY n_nationkey)::INT AS by_offset FROM nation")
def ord8_outline_order(spark, d):
    rank = lambda c: F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(c))
    return _t(spark, d, "nation").select("n_nationkey", "n_name", rank("n_name").alias("by_name"), rank("n_nationkey").alias("by_offset"))


@query("SELECT min(event_id) AS event_id FROM events WHERE event_type = 'purchase'")
def lim2_first_match(spark, d):
    return _t(spark, d, "events").where("event_type = 'purchase'").select("event_id").orderBy("event_id").limit(1)


@query("SELECT doc_id FROM documents WHERE len(string_split(text, chr(10))) <= 3")
def lim4_line_gate(spark, d):
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    return _t(spark, d, "documents").where(lines <= 3).select("doc_id")


@query("SELECT event_type, event_id FROM events")
def idx3_flatten(spark, d):
    held = _t(spark, d, "events").groupBy("event_type", (F.col("event_id") % 64).alias("part")).agg(F.collect_list("event_id").alias("ids"))
    return held.select("event_type", F.explode("ids").alias("event_id"))


# ---- further sinks and statements ----------------------------------------------------------------------------


@query("""WITH e AS (SELECT event_id, event_type || '-' || user_id || CASE WHEN event_id % 2 = 0 THEN '_with_a_label_that_is_longer_than_forty' ELSE '' END AS n FROM events), m AS (SELECT *, md5(n) AS h FROM e)
SELECT event_id, CASE WHEN length(n) > 40 THEN h[1:8] || '-' || h[9:12] || '-3' || h[14:16] || '-' || translate(h[17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:] ELSE n END AS file FROM m""")
def snk7_event_file_name(spark, d):
    label = F.concat("user_id", F.when(F.col("event_id") % 2 == 0, "_with_a_label_that_is_longer_than_forty").otherwise(""))
    return _t(spark, d, "events").select("event_id", files.event_file_name(F.col("event_type"), label).alias("file"))


@query(f"WITH {_NODES} SELECT DISTINCT parent_id || ' -> ' || id AS line FROM n WHERE parent_id IS NOT NULL")
def snk11_dependency_lines(spark, d):
    return graph.lines(_edges(spark, d))


@query("SELECT event_id, 'type=' || event_type || '&user=' || user_id AS request FROM events")
def snk12_ping_text(spark, d):
    return _t(spark, d, "events").select("event_id", files.ping({"type": F.col("event_type"), "user": F.col("user_id").cast("string")}).alias("request"))


@query("SELECT 4 AS statements, 1 AS failed, 'TABLE_OR_VIEW_NOT_FOUND' AS error")
def mut6_batches(spark, d):
    report = scripts.run_batches(spark, "SELECT 1; SELECT ';'; -- c\nSELECT * FROM no_such_table_here; SELECT 2", stop=False)
    return spark.createDataFrame(report, "at int, sql string, error string").agg(F.count("*").cast("int").alias("statements"), F.count("error").cast("int").alias("failed"), F.max("error").alias("error"))


_both("sql1_select", "nation", "SELECT * FROM nation")
_both("sql10_conversions", "part", "SELECT p_partkey, to_char(p_size, '000') AS c, CAST(to_number(to_char(p_size, '000'), '000') AS INT) AS n, CAST(to_date('15.01.2024', 'dd.MM.yyyy') AS STRING) AS d, decode(encode(p_brand, 'UTF-8'), 'UTF-8') AS t FROM part", "SELECT p_partkey, printf('%03d', p_size) AS c, p_size AS n, '2024-01-15' AS d, p_brand AS t FROM part")


# ---- orders: every row with its place ---------------------------


@query("SELECT c_custkey, c_mktsegment, c_acctbal, c_nationkey, row_number() OVER (ORDER BY c_mktsegment, c_acctbal DESC, c_custkey) AS position FROM customer")
def ord1_sort_stack(spark, d):
    stack = ordering.SortStack().choose("c_custkey").choose("c_acctbal").choose("c_acctbal").choose("c_mktsegment")
    return ordering.ranked(stack.sort(_t(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")))


@query("SELECT p_partkey, p_brand, p_type, p_size, row_number() OVER (ORDER BY p_type, p_brand, p_size, p_partkey) AS position FROM part")
def ord2_default_order(spark, d):
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("name"), F.col("p_size").alias("change"), F.col("p_brand").alias("type"), F.col("p_type").alias("location"))
    return ordering.ranked(ordering.default_stack().sort(p)).select(F.col("name").alias("p_partkey"), F.col("type").alias("p_brand"), F.col("location").alias("p_type"), F.col("change").alias("p_size"), "position")


@query("SELECT c_custkey, c_acctbal > 0 AS checked, row_number() OVER (ORDER BY c_acctbal > 0 DESC, c_custkey) AS position FROM customer")
def ord3_true_first(spark, d):
    stack = ordering.SortStack().choose("c_custkey").choose("checked")
    return ordering.ranked(stack.sort(_t(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") > 0).alias("checked")), ("checked",)))


@query("SELECT doc_id, lang, row_number() OVER (ORDER BY lang ASC NULLS FIRST, doc_id) AS position FROM documents")
def ord4_missing_first(spark, d):
    return ordering.ranked(_t(spark, d, "documents").select("doc_id", "lang").orderBy(F.asc_nulls_first("lang"), "doc_id"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS rank, row_number() OVER (ORDER BY rank, p_partkey) AS position FROM part")
def ord5_rank_sort(spark, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("SCHEMA", "TABLE", "VIEW", "INDEX")]), (F.col("p_size") % 4 + 1).cast("int"))
    return ordering.ranked(_t(spark, d, "part").select("p_partkey", ordering.rank_of(kind).alias("rank")).orderBy("rank", "p_partkey"))


@query("SELECT p_partkey, p_name, row_number() OVER (ORDER BY instr(lower(p_name), 'a') > 1, p_name, p_partkey) AS position FROM part WHERE contains(lower(p_name), 'a')")
def ord6_prefix_first(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_name").where("contains(lower(p_name), 'a')")
    return ordering.ranked(p.orderBy(F.instr(F.lower("p_name"), "a") > 1, "p_name", "p_partkey"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS position FROM lineitem")
def ord7_reference_order(spark, d):
    return ordering.ranked(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber").orderBy("l_orderkey", "l_linenumber"))


@query("SELECT page_id, url, row_number() OVER (ORDER BY url LIKE '%/' DESC, url, page_id) AS position FROM pages")
def ord9_directories_first(spark, d):
    return ordering.ranked(ordering.by_directory(_t(spark, d, "pages").select("page_id", "url"), F.col("url").endswith("/"), "url", "page_id"))


@query("SELECT event_id, v, row_number() OVER (ORDER BY v ASC NULLS LAST, event_id) AS position FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS v FROM events)")
def sql8_order_nulls(spark, d):
    return ordering.ranked(_sql(spark, d, "events", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS v FROM events ORDER BY v ASC NULLS LAST, event_id"))


from . import catalog_more  # noqa: E402, F401  registers further queries
