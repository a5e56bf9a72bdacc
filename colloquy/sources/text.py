"""Readers and writers of the delimited text layouts. Rejected records come back as a second DataFrame with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.functions.text import join_fields, not_blank, parse_time, split_fields, split_list, strip, trim_comma

ROW_END = "[*ROWEND*]"

#: Fields of each thread layout, in order. Two layouts share a width, so the layout is always named by the caller.
THREAD_LAYOUTS = {
    "table": ("topic_id", "group_id", "user_id", "pubdate", "title", "content", "comment_list"),
    "crawl": ("topic_id", "group_id", "user_id", "title", "pubdate", "content"),
    "untitled": ("topic_id", "group_id", "user_id", "pubdate", "content", "comment_list"),
    "dataset": ("topic_id", "group_id", "user_id", "pubdate", "title", "content", "comment_list", "commenter_list"),
}
COMMENT_FIELDS = ("comment_id", "group_id", "topic_id", "user_id", "pubdate", "ref_comment_id", "content")
GROUP_FIELDS = ("group_id", "user_id", "pubdate", "description", "topic_list")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """S1. One row per line, stripped, with its file and its position there (for first-wins and last-wins)."""
    rows = spark.read.text(path)
    return rows.select(strip("value").alias("value"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("position"))


def records(spark: SparkSession, path: str, joint: str = "") -> DataFrame:
    """S2. One row per record ended by a [*ROWEND*] line; the lines of a record are stripped and joined without a separator
    (S3: with one space, by joint=' ')."""
    rows = spark.read.option("lineSep", f"\n{ROW_END}\n").text(path)
    text = F.regexp_replace("value", r"(\s*\n)?\Q" + ROW_END + r"\E\s*$", "")
    return rows.select(strip(F.regexp_replace(text, r"[ \t\r\f]*\n\s*", joint)).alias("value"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("position")).where(not_blank("value"))


def normalise(spark: SparkSession, source: str, target: str) -> None:
    """S3. Rewrite a multi-line file as one record a line."""
    records(spark, source, " ").select("value").write.mode("overwrite").text(target)


def _parsed(rows: DataFrame, names: tuple[str, ...], widths: tuple[int, ...], dated: bool = False) -> DataFrame:
    """P1, F3, B1. All records that aren't blank, read once: their fields, and the reason if they are rejected, for their width or for a
    date that does not parse (this also tells a wrong layout)."""
    split = rows.where(not_blank("value")).withColumn("parts", split_fields("value"))
    out = split.select("value", F.size("parts").alias("width"), *(F.get("parts", F.lit(i)).alias(n) for i, n in enumerate(names)), "file", "position")
    reason = F.when(~F.col("width").isin(*widths), F.concat(F.lit("fields: "), F.col("width").cast("string")))
    if dated:
        out = out.withColumn("at", parse_time(strip("pubdate")))
        reason = reason.when(F.col("at").isNull(), F.concat(F.lit("date: "), F.coalesce("pubdate", F.lit(""))))
    return out.withColumn("reason", reason)


def _parted(parsed: DataFrame, names: tuple[str, ...], widths: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """Good records and rejected ones."""
    good = parsed.where("reason is null")
    good = good.withColumn("pubdate", F.col("at")) if "at" in parsed.columns else good
    value = F.when(F.col("width").isin(*widths), join_fields(*names)).otherwise(F.col("value"))
    return good.select(*names, "file", "position"), parsed.where("reason is not null").select(value.alias("value"), "reason", "file", "position")


def _read(rows: DataFrame, names: tuple[str, ...], widths: tuple[int, ...], dated: bool = True) -> tuple[DataFrame, DataFrame]:
    return _parted(_parsed(rows, names, widths, dated), names, widths)


def read_threads(spark: SparkSession, path: str, layout: str = "table", multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    """Threads in a named layout, canonical, and rejects. A table record may lack its comment list (P2); one trailing comma of a
    list is dropped (P3); the untitled layout gets an empty title."""
    names = THREAD_LAYOUTS[layout]
    widths = (6, 7) if layout == "table" else (5, 6) if layout == "untitled" else (len(names),)
    good, bad = _read(records(spark, path) if multiline else lines(spark, path), names, widths)
    out = good
    if "title" not in names:
        out = out.withColumn("title", F.lit(""))
    out = out.withColumn("comment_ids", split_list(trim_comma("comment_list")) if "comment_list" in names else F.array().cast("array<string>"))
    extra = []
    if layout == "dataset":
        out = out.withColumn("commenters", split_list(trim_comma("commenter_list")))
        extra = ["commenters"]
    return out.select("topic_id", "group_id", "user_id", "pubdate", "title", "content", "comment_ids", *extra, "file", "position"), bad


def read_comments(spark: SparkSession, path: str, multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    """Comments and rejects; an empty quote is null."""
    good, bad = _read(records(spark, path) if multiline else lines(spark, path), COMMENT_FIELDS, (7,))
    return good.withColumn("ref_comment_id", F.nullif(F.trim("ref_comment_id"), F.lit(""))).select(*COMMENT_FIELDS, "file", "position"), bad


def scan_comments(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """What read_comments() gives, in one reading of the files: all records, rejected ones with their reason and without fields."""
    parsed = _parsed(records(spark, path) if multiline else lines(spark, path), COMMENT_FIELDS, (7,), dated=True)
    fields = {c: F.col(c) for c in COMMENT_FIELDS} | {"pubdate": F.col("at"), "ref_comment_id": F.nullif(F.trim("ref_comment_id"), F.lit(""))}
    return parsed.select(*(F.when(F.col("reason").isNull(), x).alias(c) for c, x in fields.items()), "reason", "file", "position")


def read_groups(spark: SparkSession, path: str, multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    good, bad = _read(records(spark, path) if multiline else lines(spark, path), GROUP_FIELDS, (5,))
    return good.withColumn("topic_ids", split_list("topic_list")).select("group_id", "user_id", "pubdate", "description", "topic_ids", "file", "position"), bad


def read_list(spark: SparkSession, path: str, name: str = "user_id", keep_blank: bool = False) -> DataFrame:
    """S4, S5, S8, S9. One stripped value a line; blank lines are dropped unless kept."""
    rows = lines(spark, path).withColumnRenamed("value", name)
    return rows if keep_blank else rows.where(not_blank(name))


def read_adjacency(spark: SparkSession, path: str, legacy_empty: bool = False) -> DataFrame:
    """S6. (user_id, neighbours): `uid[=]a,b` or the older `uid a,b,`. An empty list has no neighbours; legacy_empty gives it
    the one empty neighbour that a plain split makes (B5)."""
    rows = lines(spark, path).where(not_blank("value"))
    new = F.instr("value", "[=]") > 0
    head = F.when(new, F.substring_index("value", "[=]", 1)).otherwise(F.substring_index("value", " ", 1))
    rest = F.when(new, F.regexp_extract("value", r"^.*?\[=\](.*)$", 1)).otherwise(F.regexp_extract("value", r"^\S*\s+(.*)$", 1))
    found = split_list(trim_comma(rest))
    if legacy_empty:
        found = F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found)
    return rows.select(strip(head).alias("user_id"), found.alias("neighbours"), "file", "position")


def read_mutual(spark: SparkSession, path: str) -> DataFrame:
    """S7. `a b n` lines; pairs come back in canonical order."""
    raw = spark.read.csv(path, sep=" ", schema="x string, y string, n bigint")
    return raw.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "n")


def read_predictions(spark: SparkSession, path: str, positive: str = "1") -> DataFrame:
    """S11. Label and P(positive) of a prediction file, whose header names the order of the two probabilities. Headers, one a file, are
    broadcast, as the lines of a file would be one task of a join by file."""
    rows = lines(spark, path).where(not_blank("value")).withColumn("parts", F.split("value", r"\s+"))
    header = rows.where("parts[0] = 'labels'").select("file", F.array_position("parts", positive).cast("int").alias("at"))
    body = rows.where("parts[0] <> 'labels'")
    return body.join(F.broadcast(header), "file").select(F.col("parts")[0].try_cast("double").cast("int").alias("label"), F.element_at("parts", F.col("at")).try_cast("double").alias("prob"), "file", "position")


def write_predictions(frame: DataFrame, path: str, columns: dict[str, Column | str]) -> None:
    """S11. Prediction files of a label and two probabilities, given by their names in the header, which heads the file of each task."""
    shown = [(F.col(c) if isinstance(c, str) else c).cast("string").alias(name) for name, c in columns.items()]
    frame.select(*shown).write.mode("overwrite").csv(path, sep=" ", header=True)


def read_topic_index(spark: SparkSession, path: str) -> DataFrame:
    """S12. topic_id, true users, candidates."""
    good, _ = _read(lines(spark, path), ("topic_id", "t", "c"), (3,), dated=False)
    return good.select("topic_id", split_list("t").alias("true_users"), split_list("c").alias("candidates"), "file", "position")


def write_lines(frame: DataFrame, path: str, columns: list[Column | str], mode: str = "overwrite", end: bool = False) -> None:
    """S16, S20, S22. Write fields joined by [=]; with end, each record ends in a [*ROWEND*] line. Overwriting is the default, so a
    rerun gives the same file; mode='append' adds."""
    text = join_fields(*columns)
    frame.select((F.concat(text, F.lit(f"\n{ROW_END}")) if end else text).alias("value")).write.mode(mode).text(path)


def write_instances(frame: DataFrame, path: str, features: list[str], label: str = "label") -> None:
    """S10. LIBSVM lines: label (+1 or -1) and 1:value, 2:value, ..."""
    shown = [F.concat(F.lit(f"{i}:"), F.format_string("%.6f", F.col(f).cast("double"))) for i, f in enumerate(features, 1)]
    frame.select(F.concat_ws(" ", F.when(F.col(label) > 0, F.lit("+1")).otherwise(F.lit("-1")), *shown).alias("value")).write.mode("overwrite").text(path)


def write_topic_index(frame: DataFrame, path: str) -> None:
    """S12."""
    write_lines(frame, path, ["topic_id", F.concat_ws(",", "true_users"), F.concat_ws(",", "candidates")])


def export_segmented(frame: DataFrame, path: str, column: str, segment, drop: list[str] | None = None) -> None:
    """S21, P13. Drop surrogate ids, segment one text column, flatten newlines, write one record a line."""
    kept = frame.drop(*(drop or [])).withColumn(column, segment(F.col(column)))
    write_lines(kept, path, [F.regexp_replace(F.col(c).cast("string"), r"\s*\n\s*", " ") if t == "string" else F.col(c) for c, t in kept.dtypes if not t.startswith("array")])


def export_topics(threads: DataFrame, group_id: str, topic_ids: DataFrame, path: str) -> None:
    """S22. Threads of a group that are in a topic list, each id once (the first record wins)."""
    from colloquy.operators.relational import first_wins

    kept = first_wins(threads.where(F.col("group_id") == group_id).join(topic_ids.select("topic_id").distinct(), "topic_id", "left_semi"), ["topic_id"], ["file", "position"])
    write_lines(kept, path, ["topic_id", "group_id", "user_id", F.date_format("pubdate", "yyyy-MM-dd HH:mm:ss"), "title", "content", F.concat_ws(",", "comment_ids")])


#: S13. The stored tables and their columns.
TABLES = {
    "webpage": "url string, page_source string, keyword string",
    "groups": "group_id string, user_id string, pubdate timestamp, description string, topic_list string",
    "topics": "topic_id string, group_id string, user_id string, pubdate timestamp, title string, content string, comment_list string",
    "comments": "comment_id string, group_id string, topic_id string, user_id string, pubdate timestamp, ref_comment_id string, content string",
}


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """S13. The stored tables, as Parquet tables of the catalog."""
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def insert_rows(rows: DataFrame, name: str, database: str = "default") -> None:
    """S13, S14. Append rows to a stored table, by column name; columns that it lacks are left out."""
    rows.select(*rows.sparkSession.table(f"{database}.{name}").columns).write.mode("append").insertInto(f"{database}.{name}")


def scan_table(spark: SparkSession, name: str, database: str = "default") -> DataFrame:
    """S13. All rows of a stored table."""
    return spark.table(f"{database}.{name}")


def look_up(spark: SparkSession, name: str, key: str, value: str, database: str = "default") -> DataFrame:
    """S13. The rows with one key; the filter reaches the Parquet scan."""
    return spark.table(f"{database}.{name}").where(F.col(key) == value)


def topic_list(groups: DataFrame, group_id: str) -> DataFrame:
    """S13. The topic ids stored for a group, blanks dropped."""
    return groups.where(F.col("group_id") == group_id).select(F.explode(split_list("topic_list")).alias("topic_id"))


def write_results(frame: DataFrame, path: str) -> None:
    """S19. Results partitioned by R, run and K; a later read of one of them prunes to its folder."""
    frame.write.mode("overwrite").partitionBy("R", "run", "K").parquet(path)


def scan_results(spark: SparkSession, path: str, R: int | None = None, run: int | None = None, K: int | None = None) -> DataFrame:
    """S19. Stored results, of all R, runs and K or of given ones: only the folders asked for are listed and read."""
    rows = spark.read.parquet(path)
    for name, value in (("R", R), ("run", run), ("K", K)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows


def dump_threads(threads: DataFrame, comments: DataFrame) -> DataFrame:
    """S20. Human-readable lines (topic_id, place, value) of threads and their comments, in order: a head line, the content, then a line for
    each comment with its quoted comment, if any."""
    when = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    head = threads.select("topic_id", F.lit(0).alias("kind"), F.lit("").alias("at"), F.lit("").alias("id"), F.concat_ws(" ", F.lit("#"), F.coalesce("title", F.lit("")), F.lit("by"), "user_id", when("pubdate")).alias("value"))
    body = threads.select("topic_id", F.lit(1).alias("kind"), F.lit("").alias("at"), F.lit("").alias("id"), F.coalesce("content", F.lit("")).alias("value"))
    quoted = F.when(F.col("ref_comment_id").isNotNull(), F.concat(F.lit(" > "), "ref_comment_id")).otherwise("")
    said = comments.select("topic_id", F.lit(2).alias("kind"), when("pubdate").alias("at"), F.col("comment_id").alias("id"), F.concat(F.lit("- "), "comment_id", quoted, F.lit(" "), "user_id", F.lit(": "), F.coalesce("content", F.lit(""))).alias("value"))
    place = F.row_number().over(W.partitionBy("topic_id").orderBy("kind", "at", "id"))
    return head.unionByName(body).unionByName(said).withColumn("place", place).select("topic_id", "place", "value")


def union_pages(pages: DataFrame, size: int = 100) -> DataFrame:
    """S15. Paged lists (user_id, page, neighbours) as edges (src, dst), each once. Pages after a user's first short page are passed
    over, as a reader that asks page by page stops there."""
    short = F.when(F.size("neighbours") < size, F.col("page"))
    last = F.min(short).over(W.partitionBy("user_id"))
    kept = pages.withColumn("_last", last).where(F.col("_last").isNull() | (F.col("page") <= F.col("_last")))
    return kept.select(F.col("user_id").alias("src"), F.explode("neighbours").alias("dst")).distinct()


def save_model(model, path: str) -> None:
    """S18. Any fitted pipeline or model."""
    model.write().overwrite().save(path)
