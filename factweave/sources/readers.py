"""Sources and sinks: notes, identifiers, model outputs, reference facts, artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import once, strip
from ..operators.recover import fact_line, first_json_object
from . import tables


def listing(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(hadm_id, path, mtime): the files ``name`` (a glob) of numeric folders, by their names and times alone; no content is read.

    A folder is named by digits, or by a partition column and digits; ``mtime`` is in seconds. Empty
    files are no artifacts: Spark's file sources skip them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/*/{name}")
    found = files.select(F.regexp_extract("path", r"/(?:[a-z_]+=)?([0-9]+)/[^/]+$", 1).alias("_id"), "path", "modificationTime").filter("_id <> ''")
    return found.select(F.col("_id").cast("bigint").alias("hadm_id"), "path", (F.unix_micros("modificationTime") / 1e6).alias("mtime"))


def done_range(files: DataFrame) -> DataFrame:
    """One row: the oldest and the newest file of a listing with their documents; nulls without any."""
    place = F.struct("mtime", "hadm_id")
    return files.agg(F.count("*").alias("done"), F.min_by("hadm_id", place).alias("oldest"), F.min("mtime").alias("oldest_mtime"), F.max_by("hadm_id", place).alias("newest"), F.max("mtime").alias("newest_mtime"))


def notes(spark: SparkSession, root: str, with_truth: bool = False, first: int | None = None) -> DataFrame:
    """(hadm_id, text) of a folder of numeric folders with ``ehr_<id>.txt``; ids come in path order, not numeric order.

    Of the ``first`` notes alone the contents are read: names are listed first, and the paths chosen among them.
    """
    files = listing(spark, root, "ehr_*.txt")
    if with_truth:
        files = files.join(listing(spark, root, "ground_truth_*.json").select("hadm_id"), "hadm_id", "left_semi")
    if first:
        paths = [r["path"] for r in files.select("path").orderBy("path").limit(first).collect()]
        if not paths:
            return spark.createDataFrame([], "hadm_id long, text string")
        rows = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("_path"))
    else:
        rows = spark.read.text(f"{root}/*/ehr_*.txt", wholetext=True).select("value", F.col("_metadata.file_path").alias("_path"))
    rows = rows.select(F.regexp_extract("_path", r"/([0-9]+)/ehr_[0-9]+\.txt$", 1).alias("_id"), F.col("value").alias("text")).filter("_id <> ''").select(F.col("_id").cast("bigint").alias("hadm_id"), "text")
    return rows.join(files.select("hadm_id"), "hadm_id", "left_semi") if with_truth and not first else rows


def truth_files(spark: SparkSession, root: str) -> DataFrame:
    path = F.col("_metadata.file_path")
    return spark.read.text(f"{root}/*/ground_truth_*.json", wholetext=True).select(F.regexp_extract(path, r"/([0-9]+)/ground_truth_[0-9]+\.json$", 1).alias("_id"), F.col("value").alias("json")).filter("_id <> ''")


def truth(files: DataFrame) -> DataFrame:
    """(hadm_id, pos, line) of reference facts: a list of lines or of objects, below one of five names or alone, or a text of lines."""
    j = F.col("json")
    names = ["$.facts", "$.toon_facts", "$.kvt_facts", "$.fact_lines", "$.lines"]
    body = F.coalesce(*[F.nullif(F.nullif(F.get_json_object(j, n), F.lit("[]")), F.lit("")) for n in names], j)
    objects = F.from_json(body, "array<map<string,string>>")
    found = F.coalesce(F.when(F.size(objects) > 0, F.transform(objects, fact_line)), F.from_json(body, "array<string>"), F.split(F.coalesce(F.nullif(F.get_json_object(j, "$.text"), F.lit("")), F.get_json_object(j, "$.raw")), "\r\n|[\n\r]"))
    return files.select(F.col("_id").cast("bigint").alias("hadm_id"), F.posexplode(F.transform(found, lambda x: strip(x))).alias("pos", "line")).filter(F.col("line").contains("|"))


def ids_from_csv(spark: SparkSession, path: str) -> DataFrame:
    """Distinct numeric identifiers of a table that must have the column hadm_id."""
    table = spark.read.csv(path, header=True)
    if "hadm_id" not in table.columns:
        raise ValueError("the table has no column hadm_id")
    return table.filter(strip(F.col("hadm_id")).rlike("^[0-9]+$")).select(strip(F.col("hadm_id")).cast("bigint").alias("hadm_id")).distinct()


def in_first_order(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """Distinct keys with the first of their places, which orders them as they are first met."""
    return rows.groupBy(key).agg(F.min(pos).alias(pos))


def ids_from_json(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("hadm_id"))
    return text.filter(F.col("hadm_id").rlike("^[0-9]+$")).select(F.col("hadm_id").cast("bigint").alias("hadm_id")).distinct()


def completions(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """(hadm_id, raw) of JSON lines; the limit counts all lines, empty completions go, a missing id is the line's number.

    Lines are numbered by their partition's place and the counts of those before it, in the order of files and splits.
    """
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("_i"), "value").select(F.shiftright("_i", 33).alias("_p"), F.col("_i").bitwiseAND((1 << 33) - 1).alias("_k"), "value")
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))  # one row per partition
    rows = rows.join(F.broadcast(before.select("_p", "_before")), "_p").withColumn("_n", F.col("_before") + F.col("_k"))
    rows = rows.filter(F.col("_n") < limit) if limit else rows
    got = rows.select(F.coalesce(F.get_json_object("value", "$.hadm_id"), F.concat(F.lit("row_"), F.col("_n").cast("string"))).alias("hadm_id"), F.get_json_object("value", "$.completion").alias("raw"))
    return got.filter(F.coalesce(strip(F.col("raw")), F.lit("")) != "")


def facts_text(spark: SparkSession, path: str, hadm_id: int = 0) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return text.select(F.lit(hadm_id).cast("bigint").alias("hadm_id"), F.posexplode(F.split("value", "\r\n|\n")).alias("pos", "line"))


def cases(spark: SparkSession, path: str) -> DataFrame:
    """The case library: id, title, description and text, trimmed, without empty ones."""
    names = ("id", "title", "description", "text")
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).json(path, multiLine=True)
    return rows.select(*[strip(F.col(c)).alias(c) for c in names]).filter("id <> '' AND text <> ''")


def missing_ids(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """What is still to do; also the test that one set of ids is within another."""
    return wanted.join(have, "hadm_id", "left_anti")


def ids_from_list(spark: SparkSession, text: str) -> DataFrame:
    """Identifiers of a comma-separated argument, in their order; anything but digits is an error."""
    parts = [x.strip() for x in (text or "").split(",") if x.strip()]
    bad = [x for x in parts if not (x.isascii() and x.isdigit())]
    if bad:
        raise ValueError(f"not an identifier: {bad[0]}")
    return spark.createDataFrame([(int(x),) for x in dict.fromkeys(parts)], "hadm_id long")


def ids_with_artifacts(spark: SparkSession, root: str, names: list[str], first: int | None = None) -> DataFrame:
    """Documents whose folder holds all the named files, the smallest identifiers first."""
    found = None
    for name in names:
        own = spark.read.format("binaryFile").load(f"{root}/*/{name}").select(F.regexp_extract("path", r"/([0-9]+)/[^/]+$", 1).alias("_id")).filter("_id <> ''").select(F.col("_id").cast("bigint").alias("hadm_id"))
        found = own if found is None else found.join(own, "hadm_id", "left_semi")
    return found.orderBy("hadm_id").limit(first) if first else found


def ids_for_run(spark: SparkSession, root: str, override: str | None = None, names: list[str] = ("stage1.md",)) -> DataFrame:
    """The documents of a run: those of a given list, else those its own list names, else those with artifacts."""
    if override:
        return ids_from_json(spark, override)
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/hadm_ids.json")
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return ids_from_json(spark, f"{root}/hadm_ids.json")
    return ids_with_artifacts(spark, root, list(names))


def evidence_claims(spark: SparkSession, path: str) -> DataFrame:
    """Claims with their evidence, trimmed, under their display names; what is missing is empty."""
    names = {"claim_id": "Claim ID", "claim": "Claim", "metric": "Metric", "status": "Status", "artifact": "Artifact"}
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).json(path, multiLine=True)
    return rows.select(*[F.coalesce(strip(F.col(n)), F.lit("")).alias(shown) for n, shown in names.items()])


#: The tables of a run's artifacts and their columns.
ARTIFACTS = {
    "stage1_raw": "hadm_id bigint, raw string, variant string, asked int, did_hygiene boolean, did_retry boolean, did_placeholder boolean, used_baseline boolean",
    "stage1_json": "hadm_id bigint, json string, json_ok boolean",
    "stage1_md": "hadm_id bigint, md string",
    "stage1_facts": "hadm_id bigint, pos bigint, line string",
    "stage1_meta": "hadm_id bigint, json_ok boolean, missing_keys array<string>, md_chars int, had_placeholders boolean",
    "stage2_raw": "hadm_id bigint, raw string, did_retry boolean",
    "stage2_facts": "hadm_id bigint, pos bigint, line string",
    "stage2_normalized": "hadm_id bigint, pos bigint, sub_pos int, cluster string, keyword string, value string, ts string",
}


def as_artifact(df: DataFrame, kind: str) -> DataFrame:
    """The columns of a kind of artifact in their types; a column that is missing is an error."""
    return df.select(*[F.col(n).cast(t).alias(n) for n, t in (c.split(" ", 1) for c in ARTIFACTS[kind].split(", "))])


def stage1_artifacts(answers: DataFrame, markdown: DataFrame, facts: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """The tables of the first stage: answers (see ``generation.first_stage``), their objects, Markdown, facts and what is known of each."""
    found = first_json_object(F.col("raw"))
    objects = once(answers, ["hadm_id", "json_ok", "raw"], json=found)
    have = F.coalesce(F.json_object_keys("json"), F.array().cast("array<string>"))
    meta = objects.join(markdown, "hadm_id", "left").select("hadm_id", "json_ok", F.array_except(F.array(*[F.lit(k) for k in keys]), have).alias("missing_keys"), F.length(F.coalesce("md", F.lit(""))).alias("md_chars"), F.coalesce(F.col("raw").contains("___"), F.lit(False)).alias("had_placeholders"))
    made = {"stage1_raw": answers, "stage1_json": objects, "stage1_md": markdown, "stage1_facts": facts, "stage1_meta": meta}
    return {kind: as_artifact(df, kind) for kind, df in made.items()}


def write_artifacts(df: DataFrame, path: str, kind: str, buckets: int = 64) -> None:
    """One table per kind of artifact, by buckets of documents; a run replaces the artifacts of the documents it holds.

    Buckets with a document of the run are rewritten with what they hold of other documents, so that
    a rerun gives no row twice; other buckets are not touched. The new buckets are staged whole before
    any is replaced, and a staged table that an earlier run has left is put in place first.
    """
    spark = df.sparkSession
    staged = f"{path}/_staged_{kind}"  # Spark's readers skip names that begin with an underscore
    mine = df.withColumn("kind", F.lit(kind)).withColumn("bucket", F.pmod(F.xxhash64("hadm_id"), F.lit(buckets)).cast("int"))

    def put() -> None:
        rows = spark.read.schema(mine.schema).parquet(staged)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "bucket").parquet(path)
        system, place = tables.place(spark, staged)
        system.delete(place, True)

    if tables.exists(spark, f"{staged}/_SUCCESS"):
        put()
    rows = mine
    if tables.exists(spark, f"{path}/kind={kind}"):
        old = spark.read.schema(mine.schema).parquet(path).filter(F.col("kind") == kind)
        kept = old.join(mine.select("bucket").distinct(), "bucket", "left_semi").join(mine.select("hadm_id").distinct(), "hadm_id", "left_anti")
        rows = mine.unionByName(kept.select(mine.columns))
    rows.write.mode("overwrite").parquet(staged)
    put()


def write_run(timings: DataFrame, summary: DataFrame, path: str) -> None:
    """A run's timings as CSV with a header and its summary as JSON lines."""
    timings.write.mode("overwrite").csv(f"{path}/timings", header=True)
    summary.write.mode("overwrite").json(f"{path}/summary")
