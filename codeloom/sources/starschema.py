"""The graph of symbols that the star-schema tables project to.

Nations and brands are modules, customers and suppliers classes, orders methods, parts functions. Orders call
the parts of their lines, parts call a supplier and each other; line flags give the resolution labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Graph:
    """Nodes and edges over one folder of tables; every method is lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    def nations(self) -> DataFrame:
        return self.t("nation").selectExpr(
            "n_nationkey AS nk", "concat('r', n_regionkey, '.n', n_nationkey) AS module",
            "concat('src/r', n_regionkey, '/n', n_nationkey, '.py') AS file", "n_name",
        )

    def customers(self) -> DataFrame:
        # nations are a fixed list of 25
        return self.t("customer").join(F.broadcast(self.nations()), F.col("c_nationkey") == F.col("nk")).selectExpr(
            "c_custkey AS ck", "concat(module, '::C', c_custkey) AS qname", "module", "file", "c_name AS signature",
            "CAST(c_mktsegment = 'MACHINERY' AS INT) AS is_test", "CAST(2000000 + c_custkey * 10 AS INT) AS start_line",
            "CAST(2000008 + c_custkey * 10 AS INT) AS end_line", "IF(c_custkey % 9 = 0, array('1-BOOT'), CAST(array() AS ARRAY<STRING>)) AS decorators",
        )

    def suppliers(self) -> DataFrame:
        return self.t("supplier").join(F.broadcast(self.nations()), F.col("s_nationkey") == F.col("nk")).selectExpr(
            "s_suppkey AS sk", "concat(module, '::S', s_suppkey) AS qname", "module", "file", "s_name AS signature"
        )

    def parts(self) -> DataFrame:
        return self.t("part").selectExpr(
            "p_partkey AS pk", "concat('parts.b', regexp_extract(p_brand, '([0-9]+)', 1)) AS module", "p_name", "p_brand", "p_type",
        ).selectExpr("*", "concat(module, '::p', pk) AS qname", "concat('src/parts/', substring(module, 7), '.py') AS file")

    def orders(self, ends: bool = True) -> DataFrame:
        """The methods; without `ends` they have no end_line, which takes the number of their lines."""
        lines = self.t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))
        o = self.t("orders").join(self.customers().select("ck", "qname", "module", "file", "is_test"), F.col("o_custkey") == F.col("ck"))
        o = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left") if ends else o
        end = ["CAST((o_orderkey % 1000) * 10 + 1 + coalesce(n_lines, 0) AS INT) AS end_line"] if ends else []
        return o.selectExpr(
            "o_orderkey AS ok", "concat(qname, '.o', o_orderkey) AS qname", "qname AS parent", "module", "file",
            "array(o_orderpriority, concat('st-', o_orderstatus)) AS decorators", "is_test", "CAST((o_orderkey % 1000) * 10 + 1 AS INT) AS start_line",
            *end, "o_orderstatus", "o_totalprice",
        )

    def nodes(self, ends: bool = True) -> DataFrame:
        """id, qname, kind, file, start_line, end_line, signature, parent, is_test, decorators; end_line only with `ends`."""
        cols = ["id", "qname", "kind", "file", "start_line", "end_line", "signature", "parent", "is_test", "decorators"]
        none, bare = "CAST(NULL AS STRING)", "CAST(array() AS ARRAY<STRING>)"
        brands = self.parts().select("module", "file").distinct().selectExpr("module", "file", "CAST(substring(module, 8) AS BIGINT) AS k")
        end = "end_line" if ends else "0"
        found = (
            self.nations().selectExpr("CAST(1000000000000 + nk AS BIGINT)", "module", "'module'", "file", "1", "1", "n_name", none, "0", bare)
            .union(brands.selectExpr("2000000000000 + k", "module", "'module'", "file", "1", "1", "module", none, "0", bare))
            .union(self.customers().selectExpr("3000000000000 + ck", "qname", "'class'", "file", "start_line", "end_line", "signature", "module", "is_test", "decorators"))
            .union(self.suppliers().selectExpr("4000000000000 + sk", "qname", "'class'", "file", "1", "1", "signature", "module", "0", bare))
            .union(self.orders(ends).selectExpr("5000000000000 + ok", "qname", "'method'", "file", "start_line", end, "concat('o', ok)", "parent", "is_test", "decorators"))
            .union(self.parts().selectExpr("6000000000000 + pk", "qname", "'function'", "file", "1", "1", "p_name", "module", "0", bare))
            .toDF(*cols)
        )
        return found if ends else found.drop("end_line")

    def calls(self) -> DataFrame:
        """source, target, kind, resolution, ord, rule_id: the call edges, numbered within their source; all six labels occur."""
        label = (
            "CASE WHEN l_returnflag = 'N' THEN 'resolved' WHEN l_returnflag = 'A' THEN 'dynamic' "
            "ELSE element_at(array('unresolved', 'candidate', 'external', 'semantic'), CAST(l_linenumber % 4 + 1 AS INT)) END"
        )
        # dealt out by order once: calls are grouped, numbered and named there
        lines = self.t("lineitem").selectExpr("l_orderkey", "l_partkey", f"{label} AS resolution", "l_linenumber").repartition("l_orderkey").groupBy(
            "l_orderkey", "l_partkey", "resolution"
        ).agg(F.min("l_linenumber").alias("ln"))
        lines = lines.withColumn("ord", F.row_number().over(W.partitionBy("l_orderkey").orderBy("ln", "l_partkey", "resolution")).cast("long"))
        parts = self.parts().selectExpr("pk", "qname AS target")
        rule = "IF(resolution = 'semantic', IF(ord % 2 = 0, 'R1', 'R2'), NULL) AS rule_id"
        made = lines.join(self.orders(False).selectExpr("ok", "qname AS source"), F.col("ok") == F.col("l_orderkey")).join(
            parts, F.col("pk") == F.col("l_partkey")
        ).selectExpr("source", "target", "resolution", "ord")
        return made.unionByName(self.part_calls()).selectExpr("source", "target", "'call' AS kind", "resolution", "ord", rule)

    def part_calls(self) -> DataFrame:
        """source, target, resolution, ord of the calls of parts: their supplier and the next part; all are resolved, with an ord over 1,000,000."""
        parts = self.parts().selectExpr("pk", "qname AS target")
        least = self.t("lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("s"))
        supplied = least.join(self.parts().selectExpr("pk", "qname AS source"), F.col("pk") == F.col("l_partkey")).join(
            self.suppliers().selectExpr("sk", "qname AS target"), F.col("sk") == F.col("s")
        ).selectExpr("source", "target", "'resolved' AS resolution", "1000001L AS ord")
        step = self.parts().selectExpr("pk AS p", "qname AS source", "CASE WHEN pk % 5 <> 0 THEN pk - 1 ELSE pk + 4 END AS next")
        chained = step.join(parts, F.col("next") == F.col("pk")).selectExpr("source", "target", "'resolved' AS resolution", "1000002L AS ord")
        return supplied.unionByName(chained)

    def contains(self) -> DataFrame:
        return self.nodes().where("parent IS NOT NULL").selectExpr(
            "parent AS source", "qname AS target", "'contains' AS kind", "'resolved' AS resolution", "id AS ord"
        )

    def imports(self) -> DataFrame:
        pairs = (
            self.t("lineitem").select("l_orderkey", "l_suppkey").distinct()
            .join(self.t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.customers().selectExpr("ck", "module AS source"), F.col("o_custkey") == F.col("ck"))
            .join(self.suppliers().selectExpr("sk", "module AS target"), F.col("l_suppkey") == F.col("sk"))
        )
        return pairs.select("source", "target").distinct().where("source <> target").selectExpr(
            "source", "target", "'import' AS kind", "'resolved' AS resolution", "0L AS ord"
        )

    def extends(self) -> DataFrame:
        child = self.customers().where("ck > 0").selectExpr("qname AS source", "CAST(floor(ck / 10) AS BIGINT) AS base")
        return child.join(self.customers().selectExpr("ck", "qname AS target"), F.col("base") == F.col("ck")).selectExpr(
            "source", "target", "'extends' AS kind", "'resolved' AS resolution", "0L AS ord"
        )

    def edges(self, calls: DataFrame | None = None) -> DataFrame:
        """All edges; with calls that are known already these aren't made again."""
        return (self.calls() if calls is None else calls).unionByName(self.contains(), True).unionByName(self.imports(), True).unionByName(self.extends(), True)

    def hunks(self) -> DataFrame:
        """file, start, count of changed line ranges: some inside orders, some in the bodies of classes, some far outside of any."""
        o = self.orders()
        return o.where("ok % 97 = 0").selectExpr("file", "start_line + 1 AS start", "3 AS count").union(
            o.where("ok % 89 = 0").selectExpr("file", "start_line + 1000000", "2")
        ).union(self.customers().where("ck % 11 = 0").selectExpr("file", "start_line + 4", "2")).distinct()

    def numstat(self) -> DataFrame:
        """file, added, removed of all files that orders or parts are in; those of parts are binary."""
        o = self.orders().groupBy("file").agg(F.count("*").alias("added"), F.count_if(F.col("ok") % 2 == 0).alias("removed"))
        return o.unionByName(self.parts().select("file").distinct().selectExpr("file", "0L AS added", "0L AS removed"))

    def deleted_files(self) -> DataFrame:
        """file of the nations that are gone as a whole."""
        return self.nations().where("nk % 10 = 7").select("file")


#: The same projection in DuckDB, as common table expressions.
SQL = """
nations AS (SELECT n_nationkey AS nk, 'r' || n_regionkey || '.n' || n_nationkey AS module,
  'src/r' || n_regionkey || '/n' || n_nationkey || '.py' AS file, n_name FROM nation),
customers AS (SELECT c_custkey AS ck, module || '::C' || c_custkey AS qname, module, file, c_name AS signature,
  CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS is_test, CAST(2000000 + c_custkey * 10 AS INTEGER) AS start_line,
  CAST(2000008 + c_custkey * 10 AS INTEGER) AS end_line, CASE WHEN c_custkey % 9 = 0 THEN ['1-BOOT'] ELSE CAST([] AS VARCHAR[]) END AS decorators
  FROM customer JOIN nations ON c_nationkey = nk),
suppliers AS (SELECT s_suppkey AS sk, module || '::S' || s_suppkey AS qname, module, file, s_name AS signature
  FROM supplier JOIN nations ON s_nationkey = nk),
parts AS (SELECT p_partkey AS pk, 'parts.b' || regexp_extract(p_brand, '([0-9]+)', 1) AS module, p_name, p_brand, p_type,
  'parts.b' || regexp_extract(p_brand, '([0-9]+)', 1) || '::p' || p_partkey AS qname,
  'src/parts/b' || regexp_extract(p_brand, '([0-9]+)', 1) || '.py' AS file FROM part),
ords AS (SELECT o_orderkey AS ok, c.qname || '.o' || o_orderkey AS qname, c.qname AS parent, c.module, c.file,
  [o_orderpriority, 'st-' || o_orderstatus] AS decorators, c.is_test, CAST((o_orderkey % 1000) * 10 + 1 AS INTEGER) AS start_line,
  CAST((o_orderkey % 1000) * 10 + 1 + coalesce(n_lines, 0) AS INTEGER) AS end_line, o_orderstatus, o_totalprice
  FROM orders JOIN customers c ON o_custkey = ck
  LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
nodes AS (
  SELECT 1000000000000 + nk AS id, module AS qname, 'module' AS kind, file, 1 AS start_line, 1 AS end_line, n_name AS signature,
    CAST(NULL AS VARCHAR) AS parent, 0 AS is_test, CAST([] AS VARCHAR[]) AS decorators FROM nations
  UNION ALL SELECT DISTINCT 2000000000000 + CAST(substr(module, 8) AS BIGINT), module, 'module', file, 1, 1, module, NULL, 0, [] FROM parts
  UNION ALL SELECT 3000000000000 + ck, qname, 'class', file, start_line, end_line, signature, module, is_test, decorators FROM customers
  UNION ALL SELECT 4000000000000 + sk, qname, 'class', file, 1, 1, signature, module, 0, [] FROM suppliers
  UNION ALL SELECT 5000000000000 + ok, qname, 'method', file, start_line, end_line, 'o' || ok, parent, is_test, decorators FROM ords
  UNION ALL SELECT 6000000000000 + pk, qname, 'function', file, 1, 1, p_name, module, 0, [] FROM parts),
lines AS (SELECT l_orderkey, l_partkey, CASE WHEN l_returnflag = 'N' THEN 'resolved' WHEN l_returnflag = 'A' THEN 'dynamic'
  ELSE ['unresolved', 'candidate', 'external', 'semantic'][l_linenumber % 4 + 1] END AS resolution, min(l_linenumber) AS ln FROM lineitem GROUP BY ALL),
calls0 AS (
  SELECT o.qname AS source, p.qname AS target, 'call' AS kind, resolution,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY ln, l_partkey, resolution) AS ord
  FROM lines JOIN ords o ON ok = l_orderkey JOIN parts p ON pk = l_partkey
  UNION ALL SELECT p.qname, s.qname, 'call', 'resolved', 1000001
  FROM (SELECT l_partkey, min(l_suppkey) AS s FROM lineitem GROUP BY 1) m JOIN parts p ON pk = l_partkey JOIN suppliers s ON sk = m.s
  UNION ALL SELECT a.qname, b.qname, 'call', 'resolved', 1000002
  FROM parts a JOIN parts b ON b.pk = CASE WHEN a.pk % 5 <> 0 THEN a.pk - 1 ELSE a.pk + 4 END),
calls AS (SELECT *, CASE WHEN resolution = 'semantic' THEN CASE WHEN ord % 2 = 0 THEN 'R1' ELSE 'R2' END END AS rule_id FROM calls0),
contains_ AS (SELECT parent AS source, qname AS target, 'contains' AS kind, 'resolved' AS resolution, id AS ord FROM nodes WHERE parent IS NOT NULL),
imports AS (SELECT DISTINCT c.module AS source, s.module AS target, 'import' AS kind, 'resolved' AS resolution, 0 AS ord
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customers c ON o_custkey = ck JOIN suppliers s ON l_suppkey = sk
  WHERE c.module <> s.module),
extends_ AS (SELECT a.qname AS source, b.qname AS target, 'extends' AS kind, 'resolved' AS resolution, 0 AS ord
  FROM customers a JOIN customers b ON b.ck = a.ck // 10 WHERE a.ck > 0),
edges AS (SELECT * FROM calls UNION ALL SELECT *, NULL FROM contains_ UNION ALL SELECT *, NULL FROM imports UNION ALL SELECT *, NULL FROM extends_),
hunks AS (SELECT DISTINCT * FROM (SELECT file, start_line + 1 AS start, 3 AS count FROM ords WHERE ok % 97 = 0
  UNION ALL SELECT file, start_line + 1000000, 2 FROM ords WHERE ok % 89 = 0
  UNION ALL SELECT file, start_line + 4, 2 FROM customers WHERE ck % 11 = 0)),
numstat AS (SELECT file, count(*) AS added, count(*) FILTER (ok % 2 = 0) AS removed FROM ords GROUP BY 1
  UNION ALL SELECT DISTINCT file, 0, 0 FROM parts),
deleted_files AS (SELECT file FROM nations WHERE nk % 10 = 7)
"""
