"""Queries that write tables as the files readers expect, and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import adapter as A
from ..sources import readers, tables
from . import queries as Q
from . import sqltext as X

query, read = Q.query, Q.read
#: A library's file is one list, which one task reads whole.
_CASES_IN_A_FILE = 5000


@query("SELECT (conv_id * 1000 + turn)::VARCHAR AS hadm_id, text AS raw FROM conversations WHERE turn % 4 <> 0 AND trim(text) <> ''")
def completions_read(s, d):
    """Outputs as JSON lines; empty ones go."""
    x = read(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("hadm_id"), F.when(F.col("turn") % 4 == 0, " \n").otherwise(F.col("text")).alias("completion"))
    place = tables.new_place(s, "completions")
    x.select(F.to_json(F.struct("hadm_id", "completion")).alias("value")).write.mode("overwrite").text(place)
    return readers.completions(s, place)


@query("SELECT DISTINCT 'csv' AS source, o_custkey AS hadm_id FROM orders WHERE o_custkey % 5 <> 0 UNION ALL SELECT 'json', n_nationkey FROM nation WHERE n_nationkey % 7 <> 0 UNION ALL SELECT 'missing', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def ids_read(s, d):
    """Identifiers of a table and of lists, each once, and those without a row elsewhere."""
    place = tables.new_place(s, "ids")
    one = F.when(F.col("o_custkey") % 5 == 0, F.concat(F.lit("x"), "o_custkey")).otherwise(F.concat(F.lit(" "), "o_custkey"))
    read(s, d, "orders").select(one.alias("hadm_id"), "o_orderstatus").write.csv(f"{place}/csv", header=True)
    name = F.when(F.col("n_nationkey") % 7 == 0, "none").otherwise(F.col("n_nationkey").cast("string"))
    lists = read(s, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(name)).alias("value"))
    lists.repartition("n_regionkey").write.partitionBy("n_regionkey").text(f"{place}/json")
    found = readers.ids_from_csv(s, f"{place}/csv").withColumn("source", F.lit("csv")).unionByName(readers.ids_from_json(s, f"{place}/json").withColumn("source", F.lit("json")))
    missing = readers.missing_ids(read(s, d, "customer").select(F.col("c_custkey").alias("hadm_id")), read(s, d, "orders").select(F.col("o_custkey").alias("hadm_id")))
    return found.unionByName(missing.withColumn("source", F.lit("missing"))).select("source", "hadm_id")


_LINE = "concat_ws('|', cluster, keyword, value, ts)"


@query(f"SELECT hadm_id, (row_number() OVER (PARTITION BY hadm_id ORDER BY pos) - 1)::INT AS pos, {_LINE} AS line FROM ({A.FACTS}) f")
def truth_read(s, d):
    """Reference facts in five shapes: objects, objects and lines below a name, lines alone, a text."""
    f = A.from_sql(s, d, A.FACTS)
    line = F.concat_ws("|", "cluster", "keyword", "value", "ts")
    rows = f.groupBy("hadm_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(F.col("cluster").alias("C"), F.col("keyword").alias("K"), F.col("value").alias("V"), F.col("ts").alias("T")).alias("o"), line.alias("l")))).alias("_x"))
    objects, lines = F.transform("_x", lambda x: x["o"]), F.transform("_x", lambda x: x["l"])
    shape = F.col("hadm_id") % 5
    body = F.when(shape == 0, F.to_json(objects)).when(shape == 1, F.to_json(F.struct(F.array().cast("array<string>").alias("facts"), objects.alias("kvt_facts")))).when(shape == 2, F.to_json(F.struct(lines.alias("fact_lines")))).when(shape == 3, F.to_json(lines))
    text = F.to_json(F.struct(F.lit("").alias("text"), F.array_join(lines, "\n").alias("raw")))
    return readers.truth(rows.select(F.col("hadm_id").cast("string").alias("_id"), F.coalesce(body, text).alias("json"))).select("hadm_id", "pos", "line")


@query("SELECT 'c' || conv_id || '-' || turn AS id, role AS title, 'turn ' || turn AS description, trim(text) AS text FROM conversations WHERE turn % 5 <> 0 AND trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''")
def cases_read(s, d):
    """A library of cases in files of JSON lists, trimmed, without empty ones."""
    place = tables.new_place(s, "cases")
    x = read(s, d, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), F.concat(F.lit(" "), "role").alias("title"), F.concat(F.lit("turn "), "turn", F.lit(" ")).alias("description"), F.when(F.col("turn") % 5 == 0, " ").otherwise(F.trim("text")).alias("text"))
    files = 1 + x.count() // _CASES_IN_A_FILE
    part = F.pmod(F.xxhash64("id"), F.lit(files)).alias("part")
    lists = x.groupBy(part).agg(F.to_json(F.collect_list(F.struct("id", "title", "description", "text"))).alias("value"))
    lists.write.mode("overwrite").partitionBy("part").text(place)
    return readers.cases(s, place)


@query("SELECT c_custkey AS hadm_id, CASE WHEN c_custkey % 3 = 0 THEN 'again ' ELSE 'first ' END || c_name AS md FROM customer UNION ALL SELECT c_custkey + 10000000, 'new' FROM customer WHERE c_custkey % 3 = 0")
def artifacts_written(s, d):
    """Artifacts of a run, then of another one that replaces those of its documents."""
    place = f"{tables.new_place(s, 'artifacts')}/run"
    c = read(s, d, "customer").select(F.col("c_custkey").cast("bigint").alias("hadm_id"), "c_name")
    shown = lambda rows, text: readers.as_artifact(rows.withColumn("md", text), "stage1_md")
    readers.write_artifacts(shown(c, F.concat(F.lit("first "), "c_name")), place, "stage1_md", 8)
    again = c.filter("hadm_id % 3 = 0")
    more = shown(again, F.concat(F.lit("again "), "c_name")).unionByName(shown(again.withColumn("hadm_id", F.col("hadm_id") + 10_000_000), F.lit("new")))
    readers.write_artifacts(more, place, "stage1_md", 8)
    return s.read.parquet(place).filter("kind = 'stage1_md'").select("hadm_id", "md")


@query(f"WITH {X.normalized(A.LINES)} SELECT cluster, count(*) AS n, count(DISTINCT hadm_id) AS docs FROM best GROUP BY cluster")
def run_files(s, d):
    """Timings of a run as CSV and its summary as JSON, read back."""
    from ..operators import normalize as N

    place = tables.new_place(s, "run")
    summary = N.normalize(Q.lines(s, d)).groupBy("cluster").agg(F.count("*").alias("n"), F.count_distinct("hadm_id").alias("docs"))
    readers.write_run(summary.select("cluster", F.lit(1.5).alias("seconds")), summary, place)
    timings = s.read.csv(f"{place}/timings", header=True).filter("seconds = 1.5").select("cluster")
    return s.read.schema("cluster string, n bigint, docs bigint").json(f"{place}/summary").join(timings, "cluster", "left_semi")
