"""Plans, journals and run logs in files, and reports as CSV (SRC12-SRC14, SNK04, SNK05, SNK08, SF20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

JOURNAL = "run long, action long, seq long, bytes long, stamp long, kind string"
RUNS = "profile long, seq long, status string, score long"


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of a journal; of each file a broken last line is left out, an earlier one raises."""
    lines = spark.read.text(path).select(F.col("value"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")).where(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", JOURNAL, {"mode": "PERMISSIVE"}))
    last = lines.groupBy("file").agg(F.max("at").alias("last"))
    broken = F.col("r").isNull() | F.col("r.kind").isNull()
    marked = parsed.join(last, "file").where(~(broken & (F.col("at") == F.col("last"))))
    return marked.select(F.when(broken, F.raise_error(F.concat(F.lit("broken line in journal "), "file"))).otherwise(F.col("r")).alias("r")).select("r.*")


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of a run log; broken lines are skipped."""
    return spark.read.schema(RUNS).option("mode", "DROPMALFORMED").json(path).where("seq is not null")


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def seal(plan: DataFrame) -> str:
    """A plan's integrity: it does not depend on the order of rows or partitions."""
    row = F.to_json(F.struct(*sorted(plan.columns)), {"ignoreNullFields": "false"})
    parts = plan.select(F.sha2(row, 256).alias("h")).agg(
        F.count("*").alias("n"), *(F.sum(F.conv(F.substring("h", 1 + 14 * i, 14), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4))
    )
    return parts.select(F.sha2(F.concat_ws(":", *parts.columns), 256)).first()[0]


def write_plan(plan: DataFrame, path: str) -> str:
    """Write once; the seal is the name of a folder beside the rows' partitions."""
    made = seal(plan)
    plan.withColumn("seal", F.lit(made)).write.mode("errorifexists").json(path)
    return made


def read_plan(spark: SparkSession, path: str, schema: str = "path string, action string, target string, reason string") -> DataFrame:
    """A plan's rows; ValueError if they are not those that were sealed."""
    rows = spark.read.schema(f"{schema}, seal string").json(path)
    plan = rows.drop("seal")
    seals = [r[0] for r in rows.select("seal").distinct().limit(2).collect()]
    if len(seals) != 1 or seal(plan) != seals[0]:
        raise ValueError("the plan was changed after it was sealed")
    return plan


def safe(text: Column) -> Column:
    """A CSV field that no spreadsheet takes for a formula."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def write_csv(rows: DataFrame, path: str) -> None:
    """Semicolons, a header, guarded strings."""
    guarded = [safe(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in rows.schema.fields]
    rows.select(*guarded).write.mode("errorifexists").option("sep", ";").option("header", True).csv(path)
