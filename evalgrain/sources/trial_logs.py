"""Trial logs (one JSON object a line), public result tables and run outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalgrain.schemas import PUBLIC_TRIALS, TRIALS


def read_lines(spark: SparkSession, glob: str) -> DataFrame:
    """source, line_no (from 1, blank lines counted) and value of every line of the files.

    Line numbers come from the order of rows in a file's splits; the window is by file, so files number in parallel.
    """
    lines = spark.read.text(glob).select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("at"), "value", F.monotonically_increasing_id().alias("id"))
    return lines.select("source", F.row_number().over(Window.partitionBy("source").orderBy("at", "id")).cast("long").alias("line_no"), "value")


def _kind(value: Column) -> Column:
    """'' for a JSON object, else why a line is none."""
    parsed = F.try_parse_json(value)
    shape = F.schema_of_variant(parsed)
    return F.when(parsed.isNull(), "corrupt_record").when(~shape.startswith("OBJECT"), "invalid_record").otherwise("")


def parse_lines(lines: DataFrame) -> DataFrame:
    """lines (source, line_no, value) with record (TRIALS), problem, and whether a record is terminal, unscored, quarantined.

    The three views overlap: terminal has a whole-number rank and a finish time; unscored is all but a completed record
    with a verdict; quarantined has no terminal identity. Bad lines keep their length and SHA-256. Blank lines go.
    """
    rows = lines.where(F.trim("value") != "").withColumn("problem", _kind(F.col("value")))
    record = F.from_json("value", TRIALS)
    rows = rows.withColumn("record", F.when(F.col("problem") == "", record))
    terminal = F.coalesce(F.get_json_object("value", "$.subset_rank").rlike("^-?[0-9]+$"), F.lit(False)) & (F.coalesce(F.get_json_object("value", "$.finished_at"), F.lit("")) != "") & (F.col("problem") == "")
    graded = F.coalesce((F.col("record.status") == "completed") & F.col("record.correct").isNotNull(), F.lit(False))
    bad = F.col("problem") != ""
    return rows.select(
        "source", "line_no", F.nullif("problem", F.lit("")).alias("problem"), F.when(bad, F.char_length("value")).alias("raw_line_chars"),
        F.when(bad, F.sha2("value", 256)).alias("raw_line_sha256"), "record", terminal.alias("terminal"), (~graded).alias("unscored"), (~terminal).alias("quarantined"),
    )


def strict_lines(lines: DataFrame) -> DataFrame:
    """Records of the lines; the job fails with source and number of a malformed one."""
    rows = lines.where(F.trim("value") != "").withColumn("problem", _kind(F.col("value")))
    where = F.concat(F.col("problem"), F.lit(" at "), F.col("source"), F.lit(":"), F.col("line_no").cast("string"))
    checked = F.when(F.col("problem") == "", F.from_json("value", TRIALS)).otherwise(F.raise_error(where).cast("void"))
    return rows.select("source", "line_no", checked.alias("record"))


def _as_filed(table: DataFrame) -> bool:
    """Whether a table's rows come from files with nothing but projections and filters in between."""
    node = table._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().head()
    return node.nodeName() == "LogicalRelation" and "_metadata" in {c.name() for c in (node.metadataOutput().apply(k) for k in range(node.metadataOutput().size()))}


def csv_checks(table: DataFrame, required: tuple[str, ...], expected_rows: int) -> DataFrame:
    """check, detail: one row for each check that a source table fails: columns, row count, and empty required fields with the
    numbers (from 0) of the first 10 rows that have them. A row's number is the rows of the parts before it, by one count a
    part, and its place in its part. The parts of a table as it is filed are stretches of files in the order of their names, as Spark deals
    them to partitions by size; those of any other table are its partitions."""
    spark = table.sparkSession
    missing = [c for c in required if c not in table.columns]
    if missing:
        return spark.createDataFrame([("missing_columns", ", ".join(missing))], "check string, detail string")
    empty = F.exists(F.array(*[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "" for c in required]), lambda x: x)
    id = F.monotonically_increasing_id()
    stretch = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")) if _as_filed(table) else F.shiftright(id, 33)
    marked = table.select(empty.alias("empty"), id.alias("id"), stretch.alias("part"))
    parts = marked.groupBy("part").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    before = parts.alias("a").join(parts.select(F.col("part").alias("earlier"), F.col("n").alias("m")), F.col("earlier") < F.col("part"), "left").groupBy("part").agg((F.coalesce(F.sum("m"), F.lit(0)) - F.first("low")).alias("before"))
    counts = marked.agg(F.count("*").alias("rows"), F.count_if("empty").alias("n_empty"))
    first = marked.where("empty").orderBy("part", "id").limit(10).join(before, "part").agg(F.array_join(F.array_sort(F.collect_list(F.col("before") + F.col("id"))).cast("array<string>"), ", ").alias("first"))
    wrong = counts.where(F.col("rows") != expected_rows).select(F.lit("row_count").alias("check"), F.concat(F.col("rows").cast("string"), F.lit(f" rows, not {expected_rows}")).alias("detail"))
    gaps = counts.where("n_empty > 0").join(first).select(F.lit("empty_fields").alias("check"), F.concat(F.col("n_empty").cast("string"), F.lit(" rows: "), "first").alias("detail"))
    return wrong.unionByName(gaps)


def parse_public(table: DataFrame) -> DataFrame:
    """Public trial rows (strings) with types: correct is 'true' in any case, numbers that can't be read are null."""
    number = lambda c: F.when(~F.coalesce(F.col(c), F.lit("")).isin("", "None"), F.col(c).try_cast("double"))
    return table.select(
        F.col("source_index").cast("long").alias("source_index"), F.col("attempt").cast("long").alias("attempt"),
        F.coalesce(F.lower(F.trim("correct")) == "true", F.lit(False)).alias("correct"), number("duration_seconds").alias("duration_seconds"), number("total_cost_usd").alias("total_cost_usd"),
    )


def read_public(spark: SparkSession, path: str) -> DataFrame:
    return parse_public(spark.read.schema(PUBLIC_TRIALS).option("header", "true").csv(path))


def duplicate_keys(table: DataFrame, key: tuple[str, ...] = ("source_index", "attempt")) -> DataFrame:
    """Keys that come more than once: an error for a public table."""
    return table.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def usage(responses: DataFrame, prices: DataFrame) -> DataFrame:
    """model, tokens and cost of chat responses with either naming of the counts; responses (model, usage as JSON text)."""
    count = lambda *paths: F.coalesce(*[F.nullif(F.get_json_object("usage", p).try_cast("long"), F.lit(0).cast("long")) for p in paths], F.lit(0).cast("long"))
    tokens = responses.select(
        "model", count("$.prompt_tokens", "$.input_tokens").alias("input_tokens"), count("$.completion_tokens", "$.output_tokens").alias("output_tokens"),
        count("$.prompt_tokens_details.cached_tokens", "$.input_tokens_details.cached_tokens").alias("cached_tokens"),
    )
    cost = (F.col("input_tokens") * F.coalesce("input_price", F.lit(0.0)) + F.col("output_tokens") * F.coalesce("output_price", F.lit(0.0))) / 1e6
    return tokens.join(prices, "model", "left").withColumn("cost_usd", cost).drop("input_price", "output_price")


def public_projection(trials: DataFrame) -> DataFrame:
    """Columns that may be published: no questions, answers or URLs; citations as a count."""
    m = lambda c: F.col(f"metrics.{c}").alias(c)
    return trials.select(
        "run_id", "item_id", "source_index", "subset_rank", "attempt", "status", "correct", "confidence", F.size("citations").cast("long").alias("citation_count"),
        m("duration_seconds"), m("steps"), m("search_calls"), m("page_opens"), m("input_tokens"), m("output_tokens"), m("total_cost_usd"),
    )


def write_ledgers(ledgers: DataFrame, summary: DataFrame, folder: str, parsed: DataFrame | None = None) -> None:
    """JSON folders: the ledgers by policy, the summary, and of parsed log lines (parse_lines()) those unscored and quarantined."""
    ledgers.write.partitionBy("policy").json(f"{folder}/ledgers")
    summary.write.json(f"{folder}/summary")
    for kind in ("unscored", "quarantined") if parsed is not None else ():
        parsed.where(kind).drop("terminal", "unscored", "quarantined").write.json(f"{folder}/{kind}")


def latest_entries(cache_log: DataFrame) -> DataFrame:
    """Keyed latest-wins view of a cache log: namespace, cache_key, response, created_at."""
    last = F.max_by("response", F.struct("created_at", "response"))
    return cache_log.groupBy("namespace", "cache_key").agg(last.alias("response"), F.max("created_at").alias("created_at"))


def cache_key(request: Column) -> Column:
    return F.sha2(request, 256)


def look_up(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """requests (namespace, cache_key) with response and hit; a miss has a null response."""
    return requests.join(entries.withColumn("hit", F.lit(True)), ["namespace", "cache_key"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
