"""Further queries: statements that change data, generators whose whole domain is known, and the function vocabulary."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from .catalog import _both, _sql, _t, query
from .functions import dialect
from .operators import generate, mutate
from .session import shared_dir
from .sources import files


def _copy(spark, d, name: str, *columns: str) -> mutate.ParquetTable:
    """A table of its own, holding a copy of one of the inputs."""
    rows = _t(spark, d, name).select(*columns) if columns else _t(spark, d, name)
    out = mutate.ParquetTable(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", rows.schema)
    out.insert(rows)
    return out


# ---- statements that change data ------------------------------------------------------------------


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey + 100, NULL FROM nation UNION ALL SELECT 9, 'NEW'")
def sql2_insert(spark, d):
    t = _copy(spark, d, "region", "r_regionkey", "r_name")
    t.insert(_t(spark, d, "nation").select(F.col("n_nationkey") + 100), ["r_regionkey"])
    t.insert(spark.createDataFrame([(9, "NEW")], "k int, name string"))
    return t.read()


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders")
def sql3_update(spark, d):
    t = _copy(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    t.update({"o_orderstatus": F.lit("X"), "o_totalprice": F.col("o_totalprice") * 2}, F.col("o_orderstatus") == "F")
    return t.read()


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE NOT (l_quantity > 25 AND l_returnflag = 'R')")
def sql4_delete(spark, d):
    t = _copy(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    t.delete((F.col("l_quantity") > 25) & (F.col("l_returnflag") == "R"))
    return t.read().select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey < 5")
def sql5_truncate(spark, d):
    t = _copy(spark, d, "supplier", "s_suppkey", "s_name")
    t.truncate()
    t.insert(_t(spark, d, "supplier").where("s_nationkey < 5").select("s_suppkey", "s_name"))
    return t.read()


@query("""SELECT s_suppkey, s_acctbal * 2 AS s_acctbal, 'updated' AS what FROM supplier WHERE s_nationkey < 5
UNION ALL SELECT s_suppkey, s_acctbal, 'deleted' FROM supplier WHERE s_nationkey > 20
UNION ALL SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN s_acctbal * 2 ELSE s_acctbal END, 'left' FROM supplier WHERE s_nationkey <= 20""")
def sql23_returning(spark, d):
    t = _copy(spark, d, "supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    new = t.update({"s_acctbal": F.col("s_acctbal") * 2}, F.col("s_nationkey") < 5, returning=True)
    gone = t.delete(F.col("s_nationkey") > 20, returning=True)
    named = lambda df, what: df.select("s_suppkey", "s_acctbal", F.lit(what).alias("what"))
    return named(new, "updated").unionByName(named(gone, "deleted")).unionByName(named(t.read(), "left"))


@query("SELECT p_partkey, left(lower(p_name), 1) AS part_key FROM part WHERE left(lower(p_name), 1) BETWEEN 'a' AND 'm'")
def sql12_list_partition(spark, d):
    """Written in folders by the expression; the filter reads only those it names."""
    path = f"{shared_dir(spark)}/by-letter-{uuid.uuid4().hex}"
    _t(spark, d, "part").select("p_partkey", F.left(F.lower("p_name"), F.lit(1)).alias("part_key")).write.partitionBy("part_key").parquet(path)
    return spark.read.schema("p_partkey long, part_key string").parquet(path).where("part_key BETWEEN 'a' AND 'm'")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def sql20_into(spark, d):
    """SELECT INTO: a new table of the rows."""
    rows = _t(spark, d, "orders").where("o_totalprice > 100000").select("o_orderkey", "o_totalprice")
    t = mutate.ParquetTable(spark, f"{shared_dir(spark)}/big-orders-{uuid.uuid4().hex}", rows.schema)
    t.insert(rows)
    return t.read()


@query("SELECT count(*) AS total, 0::BIGINT AS outside, 0::BIGINT AS repeated, true AS near FROM lineitem")
def sql20_tablesample(spark, d):
    """A tenth of the rows by chance: all from the table, none twice, as many as the chance allows (six standard deviations)."""
    keys = ["l_orderkey", "l_linenumber"]
    whole = _t(spark, d, "lineitem").select(*keys)
    sample = _sql(spark, d, "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem TABLESAMPLE (10 PERCENT) REPEATABLE (7)").groupBy(*keys).agg(F.count("*").alias("n"))
    both = whole.groupBy(*keys).agg(F.count("*").alias("m")).join(sample, keys, "full")
    out = both.agg(F.sum("m").alias("total"), F.count_if(F.col("m").isNull()).alias("outside"), F.count_if(F.col("n") > F.col("m")).alias("repeated"), F.sum("n").alias("s"))
    return out.select("total", "outside", "repeated", (F.abs(F.col("s") - F.col("total") * 0.1) <= 6 * F.sqrt(F.col("total") * 0.09)).alias("near"))


# ---- generators: unique values over a whole domain are that domain, in some order ------------------------


def _generated(spark, rows: int, *specs: generate.ColumnSpec):
    return generate.generate(spark, list(specs), rows, 11)


@query("SELECT (-500 + i)::BIGINT AS v FROM range(1000) t(i)")
def gen11_random_integer_domain(spark, d):
    return _generated(spark, 1000, generate.ColumnSpec("v", "integer", start=-500, end=499, unique=True)).select(F.col("v").cast("long").alias("v"))


@query("SELECT (DATE '2024-01-01' + i::INT)::VARCHAR AS v FROM range(366) t(i)")
def gen13_random_date_domain(spark, d):
    return _generated(spark, 366, generate.ColumnSpec("v", "date", start=dt.date(2024, 1, 1), end=dt.date(2024, 12, 31), unique=True)).select(F.col("v").cast("string").alias("v"))


@query("SELECT 36000000000 + i * 1000 AS v FROM range(2001) t(i)")
def gen14_random_time_domain(spark, d):
    """Milliseconds, both ends included."""
    return _generated(spark, 2001, generate.ColumnSpec("v", "time", start=36_000_000_000, end=36_002_000_000, unique=True)).select(F.col("v").cast("long").alias("v"))


@query("SELECT TIMESTAMP '2024-02-28 23:59:59' + to_milliseconds(i) AS v, TIMESTAMP '2024-02-28 22:59:59' + to_milliseconds(j) AS tz, '+01:00' AS tz_offset FROM range(3001) t(i) POSITIONAL JOIN range(3001) u(j)")
def gen15_random_timestamp_domain(spark, d):
    a, b = dt.datetime(2024, 2, 28, 23, 59, 59), dt.datetime(2024, 2, 29, 0, 0, 2)
    hour = dt.timedelta(hours=1)
    specs = generate.ColumnSpec("v", "timestamp", start=a, end=b, unique=True), generate.ColumnSpec("z", "timestamptz", start=(a - hour, "+01:00"), end=(b - hour, "+01:00"), unique=True)
    out = spark.range(3001).select(*[s.column(F.col("id"), 11, 3001).alias(s.name) for s in specs])  # the check before a run counts seconds
    left = out.select(F.row_number().over(_by("v")).alias("k"), "v")
    right = out.select(F.row_number().over(_by("z")).alias("k"), F.col("z.instant").alias("tz"), F.col("z.offset").alias("tz_offset"))
    return left.join(right, "k").drop("k")


def _by(name: str):
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).orderBy(name)  # some thousand generated rows


@query("SELECT i = 0 AS v FROM range(2) t(i)")
def gen16_random_boolean_domain(spark, d):
    return _generated(spark, 2, generate.ColumnSpec("v", "boolean", unique=True))


@query("SELECT 'B''' || right(bin(1024 + i), 10) || '''' AS v FROM range(1024) t(i)")
def gen17_random_bit_domain(spark, d):
    bits = _generated(spark, 1024, generate.ColumnSpec("v", "bit", length=10, unique=True))
    return bits.select(generate.literal(F.col("v"), bits.schema["v"].dataType, bits=True).alias("v"))


@query("SELECT chr(97 + (i // 26)::INT) || chr(97 + (i % 26)::INT) AS v FROM range(676) t(i)")
def gen18_random_text_domain(spark, d):
    return _generated(spark, 676, generate.ColumnSpec("v", "text", length=2, unique=True))


@query("SELECT TIMESTAMP '2020-01-01 09:00:00' + to_milliseconds(i * 90500) AS instant, '+03:00' AS zone FROM range(500) t(i)")
def gen8_increment_timestamptz(spark, d):
    s = generate.ColumnSpec("v", "timestamptz", generate.INCREMENT, (dt.datetime(2020, 1, 1, 9), "+03:00"), step=90_500)
    return _generated(spark, 500, s).select(F.col("v.instant").alias("instant"), F.col("v.offset").alias("zone"))


@query("SELECT 20000::BIGINT AS n, true AS inside, true AS even, true AS fair")
def gen12_random_real_and_boolean(spark, d):
    """The end is left out, deciles are even and the coin is fair within six standard deviations."""
    s = generate.ColumnSpec
    g = _generated(spark, 20_000, s("r", "double", start=-5.0, end=5.0, not_null=True), s("b", "boolean", not_null=True))
    deciles = [F.count_if(F.floor(F.col("r") + 5) == k).between(2000 - 255, 2000 + 255) for k in range(10)]
    even = deciles[0]
    for x in deciles[1:]:
        even = even & x
    return g.agg(F.count("*").alias("n"), F.bool_and((F.col("r") >= -5) & (F.col("r") < 5)).alias("inside"), even.alias("even"), F.count_if("b").between(10_000 - 425, 10_000 + 425).alias("fair"))


@query("""SELECT * FROM (VALUES ('bigint', 2147483647), ('bit', 2147483647), ('boolean', 2), ('date', 36526), ('double', 2147483647), ('integer', 2147483647), ('json', 2147483647),
  ('other', 1), ('smallint', 32768), ('text', 2147483647), ('time', 86399001), ('timestamp', 2147483647), ('timestamptz', 2147483647), ('tinyint', 256)) t(kind, n)""")
def gen24_domain_sizes(spark, d):
    kinds = ["bigint", "bit", "boolean", "date", "double", "integer", "json", "other", "smallint", "text", "time", "timestamp", "timestamptz", "tinyint"]
    return spark.createDataFrame([(k, generate.ColumnSpec("c", k).domain()) for k in kinds], "kind string, n int")


_DDL = "CREATE TABLE emp (id integer NOT NULL, code varchar(7) UNIQUE, pay numeric(10,2), since timestamp with time zone NOT NULL, flags bit(3), CONSTRAINT emp_pk PRIMARY KEY (id))"


@query("""SELECT * FROM (VALUES (0, 'id', 'integer', 255, true, true), (1, 'code', 'text', 7, true, false), (2, 'pay', 'numeric', 255, false, false),
  (3, 'since', 'timestamptz', 255, false, true), (4, 'flags', 'bit', 3, false, false)) t(place, name, kind, length, is_unique, not_null)""")
def gen28_ddl_to_specs(spark, d):
    specs = generate.specs_from_ddl(_DDL)
    return spark.createDataFrame([(k, s.name, s.kind, s.length, s.unique, s.not_null) for k, s in enumerate(specs)], "place int, name string, kind string, length int, is_unique boolean, not_null boolean")


@query("SELECT * FROM (VALUES ('dropped', 'id,since'), ('deleted', 'id,code,since,flags'), ('swapped', 'code,id,pay,since,flags'), ('retyped', 'integer,bit,numeric,timestamptz,bit')) t(what, columns)")
def gen29_edit_columns(spark, d):
    specs = generate.specs_from_ddl(_DDL)
    names = lambda s: ",".join(c.name for c in s)
    out = [("dropped", names(generate.drop_optional(specs))), ("deleted", names(generate.delete(specs, "pay"))), ("swapped", names(generate.swap(specs, 0, 1))), ("retyped", ",".join(c.kind for c in generate.retype(specs, "code", "bit")))]
    return spark.createDataFrame(out, "what string, columns string")


@query("""SELECT * FROM (VALUES ('date', '2024-02-29', 'ok'), ('date', '29.02.2024', 'error'), ('time', '01:02:03', 'ok'), ('time', '25:00', 'error'),
  ('timestamp', '2024-02-29T01:02:03Z', 'ok'), ('timestamptz', '2024-02-29T01:02:03+03:00', 'ok'), ('timestamp', 'today', 'error')) t(kind, input, result)""")
def gen31_parse_bounds(spark, d):
    def tried(kind, text):
        try:
            generate.parse_bound(kind, text)
        except ValueError:
            return "error"
        return "ok"

    cases = [("date", "2024-02-29"), ("date", "29.02.2024"), ("time", "01:02:03"), ("time", "25:00"), ("timestamp", "2024-02-29T01:02:03Z"), ("timestamptz", "2024-02-29T01:02:03+03:00"), ("timestamp", "today")]
    return spark.createDataFrame([(k, x, tried(k, x)) for k, x in cases], "kind string, input string, result string")


# ---- sources: schemas as a live load returns them ---------------------------------------------------------


@query("""SELECT 'public' AS table_schema, n_name AS table_name, 'id integer NOT NULL, v' || n_regionkey || ' text DEFAULT ''x''' AS ddl FROM nation""")
def src4_schema_ddl(spark, d):
    n = _t(spark, d, "nation")
    one = n.select(F.lit("public").alias("table_schema"), F.col("n_name").alias("table_name"), F.lit("id").alias("column_name"), F.lit(1).alias("ordinal_position"), F.lit("integer").alias("data_type"), F.lit("NO").alias("is_nullable"), F.lit(None).cast("string").alias("column_default"))
    two = n.select(F.lit("public").alias("table_schema"), F.col("n_name").alias("table_name"), F.concat(F.lit("v"), "n_regionkey").alias("column_name"), F.lit(2).alias("ordinal_position"), F.lit("text").alias("data_type"), F.lit("YES").alias("is_nullable"), F.lit("'x'").alias("column_default"))
    loaded = files.live_schema(spark, "PG", {}, load=lambda spark, options, statement: two.unionByName(one))
    return files.schema_ddl(loaded)


@query("""SELECT url, row_number() OVER (ORDER BY url)::BIGINT AS position FROM (SELECT DISTINCT split_part(url, '/', 3) || '/a.sql' AS url FROM pages)""")
def src9_listing_order(spark, d):
    """Directories of one file each, listed by name."""
    rows = _t(spark, d, "pages").select(F.concat(F.split("url", "/")[2], F.lit("/a.sql")).alias("url")).distinct()
    from .operators import ordering

    return ordering.ranked(rows.orderBy(files.listing_order(F.col("url")))).select("url", "position")


# ---- function vocabulary, by family ----------------------------------------------------------------------

_both("fn_trigonometry", "part", "SELECT p_partkey, round(sin(p_size), 9) AS a, round(cos(p_size), 9) AS b, round(tan(p_size), 6) AS c, round(asin(p_size / 100.0D), 9) AS e, round(acos(p_size / 100.0D), 9) AS f, round(atan(p_size), 9) AS g, round(atan2(p_size, 3), 9) AS h, round(cot(p_size), 6) AS i, round(degrees(p_size), 6) AS j, round(radians(p_size), 9) AS k, round(sinh(p_size / 50.0D), 9) AS l, round(cosh(p_size / 50.0D), 9) AS m, round(tanh(p_size), 9) AS o, round(asinh(p_size), 9) AS p, round(acosh(p_size + 1), 9) AS q, round(atanh(p_size / 100.0D), 9) AS r FROM part",
      "SELECT p_partkey, round(sin(p_size), 9) AS a, round(cos(p_size), 9) AS b, round(tan(p_size), 6) AS c, round(asin(p_size / 100.0), 9) AS e, round(acos(p_size / 100.0), 9) AS f, round(atan(p_size), 9) AS g, round(atan2(p_size, 3), 9) AS h, round(cot(p_size), 6) AS i, round(degrees(p_size), 6) AS j, round(radians(p_size), 9) AS k, round(sinh(p_size / 50.0), 9) AS l, round(cosh(p_size / 50.0), 9) AS m, round(tanh(p_size), 9) AS o, round(asinh(p_size), 9) AS p, round(acosh(p_size + 1), 9) AS q, round(atanh(p_size / 100.0), 9) AS r FROM part")
_both("fn_numbers", "part", "SELECT p_partkey, abs(-p_size) AS a, ceil(p_retailprice) AS b, floor(p_retailprice) AS c, round(exp(p_size / 10.0D), 6) AS e, round(power(p_size, 2), 6) AS g, round(cbrt(p_size), 9) AS h, sign(p_retailprice - 1000) AS i, p_size % 7 AS j, round(pi(), 9) AS k, factorial(p_size % 10) AS l, greatest(p_size, 10) AS m, least(p_size, 10) AS n, bit_count(p_size) AS o FROM part",
      "SELECT p_partkey, abs(-p_size) AS a, ceil(p_retailprice)::BIGINT AS b, floor(p_retailprice)::BIGINT AS c, round(exp(p_size / 10.0), 6) AS e, round(power(p_size, 2), 6) AS g, round(cbrt(p_size), 9) AS h, sign(p_retailprice - 1000)::DOUBLE AS i, p_size % 7 AS j, round(pi(), 9) AS k, factorial(p_size % 10)::BIGINT AS l, greatest(p_size, 10) AS m, least(p_size, 10) AS n, bit_count(p_size)::INT AS o FROM part")
_both("fn_dates", "orders", "SELECT o_orderkey, date_trunc('MONTH', o_orderdate) AS a, date_part('YEAR', o_orderdate) AS b, date_part('QUARTER', o_orderdate) AS c, extract(DAY FROM o_orderdate) AS e, last_day(o_orderdate) AS f, make_date(2024, 1 + CAST(o_orderkey % 12 AS INT), 1) AS g, datediff(o_orderdate, DATE '1990-01-01') AS h, weekofyear(o_orderdate) AS i, dayofyear(o_orderdate) AS j FROM orders",
      "SELECT o_orderkey, date_trunc('MONTH', o_orderdate)::TIMESTAMP AS a, date_part('year', o_orderdate)::INT AS b, date_part('quarter', o_orderdate)::INT AS c, extract(DAY FROM o_orderdate)::INT AS e, last_day(o_orderdate) AS f, make_date(2024, 1 + (o_orderkey % 12)::INT, 1) AS g, date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::INT AS h, week(o_orderdate)::INT AS i, dayofyear(o_orderdate)::INT AS j FROM orders")
_both("fn_strings", "part", "SELECT p_partkey, upper(p_name) AS a, lpad(p_name, 30, '*') AS b, rpad(p_name, 3, '*') AS c, reverse(p_name) AS e, repeat(p_brand, 2) AS f, translate(p_name, 'abc', 'xyz') AS g, replace(p_name, 'a', '') AS h, split_part(p_type, ' ', 1) AS i, locate('a', p_name) AS j, md5(p_name) AS k, sha2(p_name, 256) AS l, left(p_name, 3) AS m, right(p_name, 3) AS n, char_length(p_name) AS o, octet_length(p_name) AS p, ascii(p_name) AS q, concat_ws('-', p_brand, p_type) AS r, overlay(p_name PLACING 'XX' FROM 2 FOR 1) AS s, format_string('%05d|%s', p_size, p_brand) AS t, btrim(p_name, 'ab') AS u, startswith(p_name, 'a') AS v FROM part",
      "SELECT p_partkey, upper(p_name) AS a, CASE WHEN length(p_name) > 30 THEN left(p_name, 30) ELSE lpad(p_name, 30, '*') END AS b, rpad(p_name, 3, '*') AS c, reverse(p_name) AS e, repeat(p_brand, 2) AS f, translate(p_name, 'abc', 'xyz') AS g, replace(p_name, 'a', '') AS h, split_part(p_type, ' ', 1) AS i, instr(p_name, 'a')::INT AS j, md5(p_name) AS k, sha256(p_name) AS l, left(p_name, 3) AS m, right(p_name, 3) AS n, length(p_name)::INT AS o, strlen(p_name)::INT AS p, ascii(p_name) AS q, concat_ws('-', p_brand, p_type) AS r, left(p_name, 1) || 'XX' || substr(p_name, 3) AS s, printf('%05d|%s', p_size, p_brand) AS t, trim(p_name, 'ab') AS u, starts_with(p_name, 'a') AS v FROM part")
_both("fn_arrays", "orders", "SELECT o_custkey, array_sort(array_agg(o_orderkey)) AS a, array_sort(concat(array_agg(o_orderkey), array(0))) AS b, array_sort(array_remove(array_agg(o_orderkey % 3), 0)) AS c, size(array_distinct(array_agg(o_orderkey % 3))) AS e, array_position(array_sort(array_agg(o_orderkey % 3)), 2) AS f, array_repeat(7, 3) AS g, array_sort(transform(array_agg(o_orderkey % 3), x -> CASE WHEN x = 1 THEN 9 ELSE x END)) AS h, element_at(array_sort(array_agg(o_orderkey)), 1) AS i, array_contains(array_agg(o_orderkey % 3), 2) AS j FROM orders GROUP BY o_custkey",
      "SELECT o_custkey, list_sort(array_agg(o_orderkey)) AS a, list_sort(list_concat(array_agg(o_orderkey), [0])) AS b, list_sort(list_filter(array_agg(o_orderkey % 3), lambda x: x <> 0)) AS c, len(list_distinct(array_agg(o_orderkey % 3)))::INT AS e, coalesce(list_position(list_sort(array_agg(o_orderkey % 3)), 2), 0)::BIGINT AS f, [7, 7, 7] AS g, list_sort(list_transform(array_agg(o_orderkey % 3), lambda x: CASE WHEN x = 1 THEN 9 ELSE x END)) AS h, list_sort(array_agg(o_orderkey))[1] AS i, list_contains(array_agg(o_orderkey % 3), 2) AS j FROM orders GROUP BY o_custkey")
_both("fn_bit_and_boolean_aggregates", "part", "SELECT p_brand, bit_and(p_size) AS a, bit_or(p_size) AS b, bit_xor(p_size) AS c, bool_and(p_size > 1) AS e, bool_or(p_size > 49) AS f, every(p_size > 0) AS g FROM part GROUP BY p_brand", "SELECT p_brand, bit_and(p_size) AS a, bit_or(p_size) AS b, bit_xor(p_size) AS c, bool_and(p_size > 1) AS e, bool_or(p_size > 49) AS f, bool_and(p_size > 0) AS g FROM part GROUP BY p_brand")
_both("fn_statistics", "lineitem", "SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS a, round(stddev_samp(l_quantity), 6) AS b, round(var_pop(l_quantity), 4) AS c, round(var_samp(l_quantity), 4) AS e, round(corr(l_quantity, l_extendedprice), 6) AS f, round(covar_pop(l_quantity, l_extendedprice), 2) AS g, round(regr_slope(l_extendedprice, l_quantity), 4) AS h, round(regr_r2(l_extendedprice, l_quantity), 6) AS i, regr_count(l_extendedprice, l_quantity) AS j, mode(CAST(l_linenumber AS INT)) IS NOT NULL AS k FROM lineitem GROUP BY l_returnflag",
      "SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS a, round(stddev_samp(l_quantity), 6) AS b, round(var_pop(l_quantity), 4) AS c, round(var_samp(l_quantity), 4) AS e, round(corr(l_quantity, l_extendedprice), 6) AS f, round(covar_pop(l_quantity, l_extendedprice), 2) AS g, round(regr_slope(l_extendedprice, l_quantity), 4) AS h, round(regr_r2(l_extendedprice, l_quantity), 6) AS i, regr_count(l_extendedprice, l_quantity)::BIGINT AS j, mode(l_linenumber) IS NOT NULL AS k FROM lineitem GROUP BY l_returnflag")
_both("fn_json_parts", "events", "SELECT event_id, get_json_object(props, '$.k') AS a, json_object_keys(props) AS b, to_json(named_struct('k', event_id)) AS c, json_array_length('[1,2,3]') AS e, from_json(props, 'k BIGINT').k AS f FROM events", "SELECT event_id, props->>'$.k' AS a, json_keys(props) AS b, '{\"k\":' || event_id || '}' AS c, 3 AS e, (props->>'$.k')::BIGINT AS f FROM events")
_both("fn_series", "nation", "SELECT n_nationkey, explode(sequence(0, n_nationkey, 2)) AS s FROM nation", "SELECT n_nationkey, unnest(generate_series(0, n_nationkey, 2))::INT AS s FROM nation")
_both("fn_conditionals", "events", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END, 0) AS a, nullif(event_id % 2, 0) AS b, value IS NOT DISTINCT FROM NULL AS c, event_type LIKE '%i%' AS e, event_type RLIKE '^(click|view)$' AS f, event_type ILIKE 'SIGN%' AS g, value BETWEEN 10 AND 20 AS h FROM events", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END, 0) AS a, nullif(event_id % 2, 0) AS b, value IS NOT DISTINCT FROM NULL AS c, event_type LIKE '%i%' AS e, regexp_matches(event_type, '^(click|view)$') AS f, event_type ILIKE 'SIGN%' AS g, value BETWEEN 10 AND 20 AS h FROM events")


@query("SELECT c_custkey, c_acctbal // 1 IS NOT NULL AS whole, initcap_name AS name FROM (SELECT *, 'Customer#' || lpad(c_custkey::VARCHAR, 9, '0') AS initcap_name FROM customer)")
def fn_dialect_names(spark, d):
    c = _t(spark, d, "customer")
    return c.select("c_custkey", F.col("c_acctbal").isNotNull().alias("whole"), dialect.pg_initcap(F.concat(F.lit("customer#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))).alias("name"))
