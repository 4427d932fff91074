"""Sources and sinks: scans, appends, logs, transcripts, EAV records, graph files, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TRANSCRIPT = "type string, time string, data struct<content: array<struct<type: string, text: string>>, message: struct<content: array<struct<type: string, text: string>>>>"
# Containers in which a page's body is looked for, in order.
BODY_PATTERNS = (
    r'(?s)<div[^>]*class="[^"]*article-content[^"]*"[^>]*>(.*?)</div>',
    r"(?s)<article[^>]*>(.*?)</article>",
    r'(?s)<div[^>]*class="[^"]*content[^"]*"[^>]*>(.*?)</div>',
    r'(?s)data-layout="text"[^>]*>(.*?)</div>',
)


def scan_memories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def bulk_append(new: DataFrame, path: str, partition: str = "type") -> dict[str, int]:
    """Append to a partitioned table; returns how many rows went in and how many had no content
    (these are left out). The counts are observed while writing."""
    from pyspark.sql import Observation

    seen = Observation("append")
    ok = F.coalesce(F.length("content"), F.lit(0)) > 0
    watched = new.observe(seen, F.count_if(ok).alias("added"), F.count_if(~ok).alias("failed"))
    watched.filter(ok).write.mode("append").partitionBy(partition).parquet(path)
    return dict(seen.get)


def sessions_messages(msg: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions with their size and start, and messages, of a message log."""
    ses = msg.groupBy("session_id").agg(F.count(F.lit(1)).alias("message_count"), F.min("ts").alias("started_at"))
    return ses, msg


def transcripts_jsonl(lines: DataFrame) -> DataFrame:
    """``session_id, role, text, ts`` of transcript lines (session_id, line): the text blocks of the
    content, or of the message, joined. Malformed lines and lines without text are skipped."""
    j = lines.select("session_id", F.from_json("line", TRANSCRIPT).alias("j"))
    blocks = F.coalesce("j.data.content", "j.data.message.content")
    text = F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))), "")
    role = F.when(F.col("j.type").startswith("user"), "user").when(F.col("j.type").startswith("assistant"), "assistant").otherwise(F.col("j.type"))
    return j.select("session_id", role.alias("role"), text.alias("text"), F.col("j.time").alias("ts")).filter(F.col("role").isNotNull() & (F.coalesce(F.length("text"), F.lit(0)) > 0))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Lines of transcript files, session id from the parent folder; files may be compressed with
    any codec that Spark knows by its ending."""
    return spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("session_id"), F.col("value").alias("line"))


def channel_log_recent(log: DataFrame, limit: int = 80, channels: list[str] | None = None) -> DataFrame:
    """The newest rows of the channels, oldest first."""
    near = log.filter(F.col("channel").isin(channels)) if channels else log
    return near.orderBy(F.col("id").desc()).limit(limit).orderBy("id")


def channel_log_append(log: DataFrame, new: DataFrame, asof: float, max_chars: int = 10000) -> DataFrame:
    """The log with new rows (channel, role, content, ts), cut to max_chars, ids going on from the
    greatest; rows without a time get ``asof``."""
    top = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    order = W.partitionBy(F.lit(0)).orderBy("ts", "channel", "role", "content")  # a batch of new rows, not the log
    rows = new.select("channel", "role", F.substring("content", 1, max_chars).alias("content"), F.coalesce("ts", F.lit(float(asof))).alias("ts"))
    rows = rows.withColumn("r", F.row_number().over(order)).crossJoin(F.broadcast(top)).select((F.col("top") + F.col("r")).alias("id"), "channel", "role", "content", "ts")
    return log.unionByName(rows)


def eav_to_rows(eav: DataFrame, keys: list[str]) -> DataFrame:
    """One row an id, one text column a key; a value is its text, else its integer, else its float."""
    value = F.coalesce("string_value", F.col("int_value").cast("string"), F.col("float_value").cast("string"))
    return eav.groupBy("id").pivot("key", keys).agg(F.first(value, ignorenulls=True))


def merge_graph_batches(nodes: DataFrame, edges: DataFrame, default_node: str = "root") -> tuple[DataFrame, DataFrame]:
    """Nodes (file, pos, id, name) and edges (source, target, type) of many files as sets: the first
    node of an id wins, in the order of files; ends that no file describes get a default name."""
    first = F.row_number().over(W.partitionBy("id").orderBy("file", "pos"))
    own = nodes.withColumn("r", first).filter("r = 1").select("id", "name")
    e = edges.select("source", "target", "type").distinct()
    ends = e.select(F.explode(F.array("source", "target")).alias("id")).distinct().join(own, "id", "left_anti")
    return own.unionByName(ends.select("id", F.lit(default_node).alias("name"))), e


def metric_history_append(hist: DataFrame, row: DataFrame) -> DataFrame:
    """The history with one more run; a run of a day that is there already replaces it."""
    return hist.join(row.select("day"), "day", "left_anti").unionByName(row, allowMissingColumns=True)


def zones_to_records(zones: DataFrame) -> DataFrame:
    """``zone, project, status, content`` of desks (desk, zones: array of zone, items: array of
    title, status, points)."""
    z = zones.select("desk", F.explode("zones").alias("z")).select("desk", "z.zone", F.explode_outer("z.items").alias("i"))
    z = z.filter("i is not null")
    return z.select("desk", "zone", F.col("i.title").alias("project"), F.col("i.status").alias("status"), F.concat_ws(" ", F.col("i.title"), F.col("i.status"), F.array_join("i.points", " | ")).alias("content"))


def registry_fanout(projects: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and edges of projects (project, title, docs array, logs array): a registry row, one a
    document, one a log, one that sums up (id ``reg:``), and edges from logs to their project. Ids that exist are skipped."""
    reg = projects.select(F.concat(F.lit("reg:"), "project").alias("id"), F.col("title").alias("content"), F.lit("registry").alias("type"), "project")
    docs = projects.select("project", F.posexplode("docs").alias("i", "d")).select(F.concat(F.lit("doc:"), "project", F.lit(":"), "i").alias("id"), F.col("d").alias("content"), F.lit("doc_index").alias("type"), "project")
    logs = projects.select("project", F.posexplode("logs").alias("i", "l")).select(F.concat(F.lit("log:"), "project", F.lit(":"), "i").alias("id"), F.col("l").alias("content"), F.lit("work_log").alias("type"), "project")
    n = projects.agg(F.count(F.lit(1)).alias("p"), F.coalesce(F.sum(F.greatest(F.size("docs"), F.lit(0))), F.lit(0)).alias("d"), F.coalesce(F.sum(F.greatest(F.size("logs"), F.lit(0))), F.lit(0)).alias("l"))
    text = F.concat(F.col("p").cast("string"), F.lit(" projects, "), F.col("d").cast("string"), F.lit(" documents, "), F.col("l").cast("string"), F.lit(" logs"))
    summary = n.select(F.lit("reg:").alias("id"), text.alias("content"), F.lit("registry").alias("type"), F.lit(None).cast("string").alias("project"))
    new = reg.unionByName(docs).unionByName(logs).unionByName(summary).join(existing.select("id"), "id", "left_anti")
    edges = new.filter("type = 'work_log'").select(F.col("id").alias("from_id"), F.concat(F.lit("reg:"), "project").alias("to_id"), F.lit("related").alias("rel_type"))
    return new, edges


def scan_pending_lines(docs: DataFrame, markers: list[str], file: str = "doc_id", text: str = "text") -> DataFrame:
    """``file, line, keyword``: each line of more than three characters for each marker that it has."""
    lines = docs.select(F.col(file).alias("file"), F.explode(F.split(F.col(text), "\n")).alias("raw")).filter(F.length(F.trim("raw")) > 3)
    found = F.filter(F.array(*[F.lit(m) for m in markers]), lambda m: F.col("raw").contains(m))
    return lines.select("file", F.trim("raw").alias("line"), F.explode(found).alias("keyword"))


def append_audit_log(row: DataFrame, path: str) -> None:
    row.withColumn("date", F.to_date(F.col("at").cast("timestamp"))).write.mode("append").partitionBy("date").json(path)


def reflection_history(refl: DataFrame, asof_day: str, days: int = 3) -> DataFrame:
    """Runs (day, issues array, ...) of the last days, one row an issue; a run without issues has one
    row with a null."""
    near = refl.filter((F.datediff(F.lit(asof_day), F.col("day")) <= days) & (F.datediff(F.lit(asof_day), F.col("day")) >= 0))
    return near.select("day", "total", F.explode_outer("issues").alias("issue"))


def page_body_extract(pages: DataFrame, patterns=BODY_PATTERNS, min_chars: int = 100) -> DataFrame:
    """``page_id, title, body, n_chars``: of the containers, in the order of their patterns, the first
    with more than min_chars characters without tags, scripts and styles, spaces collapsed. Pages
    without such a container are dropped."""

    def long_enough(pattern: str) -> Column:
        inner = F.regexp_replace(F.regexp_extract("html", pattern, 1), r"(?is)<(script|style)[^>]*>.*?</\1>", "")
        plain = F.regexp_replace(F.regexp_replace(inner, r"<[^>]+>", ""), "&nbsp;", " ")
        # one element, so that the text is made once for its test and its value
        return F.try_element_at(F.filter(F.array(F.trim(F.regexp_replace(plain, r"\s+", " "))), lambda t: F.length(t) > min_chars), F.lit(1))

    body = F.coalesce(*[long_enough(p) for p in patterns])
    title = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return pages.select("page_id", title.alias("title"), body.alias("body")).filter(F.col("body").isNotNull()).withColumn("n_chars", F.length("body").cast("long"))


def page_markdown(bodies: DataFrame) -> DataFrame:
    return bodies.select("page_id", F.concat(F.lit("# "), "title", F.lit("\n\n"), "body").alias("markdown"))


def assign_batches(files: DataFrame, size: int = 1, suffix: str = ".py", path: str = "path", prefix: int = 2) -> DataFrame:
    """``batch, path``: files of a suffix, in the order of their paths, ``size`` to a batch. Ranks are
    taken among paths of one beginning, with offsets, so no task sees all."""
    own = files.filter(F.col(path).endswith(suffix)).select(F.col(path).alias("path"))
    own = own.withColumn("lane", F.substring("path", 1, prefix))
    rank = F.row_number().over(W.partitionBy("lane").orderBy("path"))
    sizes = own.groupBy("lane").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("lane", F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("lane").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = own.withColumn("r", rank).join(before, "lane")
    return placed.select(F.expr(f"(before + r - 1) div {size}").alias("batch"), "path")


def append_corrections(log: DataFrame, new: DataFrame, asof: float, kind: str = "correction") -> DataFrame:
    """The log with new entries (topic, detail), dated: corrections are open until they are fixed; entries of
    the kinds ``success`` and ``rule`` (a rule that changed) say so in their note and need no fixing."""
    if kind not in ("correction", "success", "rule"):
        raise ValueError(f"no kind {kind!r}")
    head = "" if kind == "correction" else f"{kind}: "
    rows = new.select("topic", "detail", F.lit(float(asof)).alias("ts"), F.lit(kind != "correction").alias("fixed"), F.concat(F.lit(f"{head}["), "topic", F.lit("] "), "detail").alias("note"))
    return log.unionByName(rows, allowMissingColumns=True)


def snapshot_manifest(df: DataFrame, key: str, severity: dict[str, str] | None = None) -> DataFrame:
    """``item, checksum, n_rows, severity`` for each value of a key: the checksum is the sum of the rows'
    128-bit digests (32 hex digits or more, since sums carry), which doesn't depend on their order and
    tells repeated rows from missing ones. In a digest a null differs from any text, and values can't
    run into each other."""
    cols = sorted(df.columns)
    part = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("~"))
    digest = F.md5(F.concat(*[part(c) for c in cols]))
    words = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    sev = F.lit("info")
    for k, v in (severity or {}).items():
        sev = F.when(F.col("item") == k, v).otherwise(sev)
    sums = [F.sum(w).alias(f"_w{i}") for i, w in enumerate(words)]  # of 32-bit words: exact in a long up to 2^31 rows
    out = df.groupBy(F.col(key).alias("item")).agg(*sums, F.count(F.lit(1)).alias("n_rows"))
    hexed = F.concat_ws("-", *[F.lower(F.hex(f"_w{i}")) for i in range(4)])
    return out.select("item", hexed.alias("checksum"), "n_rows", sev.alias("severity"))


def file_manifest(spark, folder: str, listed: DataFrame | None = None, pattern: str = "*") -> DataFrame:
    """``item, exists, size, mtime, checksum``: the files below a folder, by their path in it, with the
    SHA-256 of their bytes, read by Spark where they lie (any file system it knows); items of ``listed``
    (item) that aren't there have exists = false and nulls. Spark's reader leaves out empty files: they
    count as not there. Two manifests are compared by ``snapshot_diff``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    whole = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/")
    item = F.expr(f"substring(path, instr(path, '{whole}/') + {len(whole) + 1})")
    found = files.select(item.alias("item"), F.lit(True).alias("exists"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("checksum"))
    if listed is None:
        return found
    gone = listed.select("item").distinct().join(found.select("item"), "item", "left_anti").withColumn("exists", F.lit(False))
    return found.unionByName(gone, allowMissingColumns=True)
