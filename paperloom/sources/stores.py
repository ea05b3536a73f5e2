"""Readers and stores: documents, indexes with manifests, append-only logs, reports."""

from __future__ import annotations

import atexit
import hashlib
import json
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import commits

DOCUMENT = (
    "paper_id string, metadata map<string, string>, sections map<string, string>, "
    "raw_document struct<paper_id: string, pages_count: int, pages: array<struct<page_number: int, text: string, char_count: int>>>"
)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; if unset, one in the warehouse, or a temporary one where all run on this machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/intermediate"
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="paperloom-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return "file://" + _local[0]


_local: list[str] = []
#: Paths that new_path gave, in order, and that nothing has removed yet.
_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call returns, for what a plan writes on its way."""
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def drop_kept(spark: SparkSession) -> None:
    """Remove what plans wrote on their way; results that still read it are lost, so this is for when those are written or used up."""
    while _made:
        delete(spark, _made.pop())


def kept(rows: DataFrame, name: str) -> DataFrame:
    """Rows written to the shared folder and read again: they are made once, whatever executors are lost later."""
    path = new_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Processed documents, one JSON object a file; the schema is fixed, nothing is inferred."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).json(paths)


def read_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines, or a JSON array if the path ends in .json."""
    return spark.read.schema(schema).option("multiLine", path.endswith(".json")).json(path)


def read_pages(spark: SparkSession, paths: str | list[str], parse: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, page_number, text, char_count, error) of binary files; ``parse`` gives a file's page texts.

    A file that cannot be parsed gives one row with its error; the others go on.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(path, i, text, len(text), None) for i, text in enumerate(parse(bytes(content)), 1)]
                except Exception as error:  # noqa: BLE001  recorded in the row
                    rows.append((path, None, None, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["path", "page_number", "text", "char_count", "error"]).astype({"page_number": "Int32", "char_count": "Int32"})

    return files.mapInPandas(run, "path string, page_number int, text string, char_count int, error string")


def write_index(frames: dict[str, DataFrame], path: str, config: dict) -> dict:
    """Tables of an index below path, and a manifest of their row counts, written last."""
    counts = {}
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")
        counts[name] = frame.sparkSession.read.parquet(f"{path}/{name}").count()
    spark = next(iter(frames.values())).sparkSession
    manifest = {"version": "2.0", "config": config, "tables": counts}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def read_index(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """The tables of an index; an error if one has not the rows that the manifest says.

    An index of version 1 is one JSON object, of chunks and their tokens side by
    side: it is read as the tables chunks and tokens, if both are of one length.
    """
    if not exists(spark, f"{path}/manifest"):
        return _read_first_version(spark, path)
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    frames = {name: spark.read.parquet(f"{path}/{name}") for name in manifest["tables"]}
    for name, n in manifest["tables"].items():
        if frames[name].count() != n:
            raise ValueError(f"index table {name} doesn't match its manifest")
    return frames, manifest


def _read_first_version(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "chunks array<string>, tokenized_corpus array<array<string>>, tokenizer string").alias("i")).select("i.*")
    row = whole.select(F.size("chunks").alias("n"), F.size("tokenized_corpus").alias("m"), "tokenizer").first()
    if row is None or row["n"] != row["m"] or row["n"] < 0:
        raise ValueError(f"{path!r} is no index, or its chunks and tokens are not of one length")
    chunks = whole.select(F.posexplode("chunks").alias("pos", "chunk")).select("pos", F.get_json_object("chunk", "$.chunk_id").alias("chunk_id"), F.get_json_object("chunk", "$.text").alias("text"), "chunk")
    tokens = whole.select(F.posexplode("tokenized_corpus").alias("pos", "tokens"))
    return {"chunks": chunks, "tokens": tokens}, {"version": "1.0", "config": {"tokenizer": row["tokenizer"] or "word_v1"}, "tables": {"chunks": row["n"], "tokens": row["m"]}}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something is stored below path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def delete(spark: SparkSession, path: str) -> bool:
    """Remove what is stored below path; False if there was nothing."""
    if not exists(spark, path):
        return False
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True))


#: Batches that a store reads side by side, before upsert merges them; and the folders into which it may deal keys.
MERGE_AFTER, BUCKETS = 16, 64


def _done(state: dict | None, number: int) -> bool:
    return any(lo <= number <= hi for lo, hi in state["done"]) if state else False


def _with(ranges: list[list[int]], number: int) -> list[list[int]]:
    """Ascending ranges of numbers, with one more."""
    out: list[list[int]] = []
    for lo, hi in sorted([*ranges, [number, number]]):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def batches(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches that were delivered to the store at path, ascending."""
    state = commits.read(spark, path)[1]
    return [n for lo, hi in (state["done"] if state else []) for n in range(lo, hi + 1)]


def bucket_of(key: str) -> Column:
    """The folder of a key, in stores that have folders."""
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int")


def _write(rows: DataFrame, path: str, key: str, bucketed: bool) -> str:
    name = f"data-{uuid.uuid4().hex}"
    if bucketed:
        # A folder gets one file a batch.
        rows.withColumn("_bucket", bucket_of(key)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/{name}")
    else:
        rows.write.parquet(f"{path}/{name}")
    return name


def upsert(rows: DataFrame, path: str, key: str, batch: int | None = None, bucketed: bool = False) -> int:
    """Add a batch of rows to the store at path; of each key the row that was added last counts. Returns the batch's number.

    A batch gets the next number, or one that the caller gives so that a repeated
    delivery is told and left out. Rows lie in a folder of their own and count
    from the commit that names it: of two writers at once each gets its number.
    bucketed, which holds from the first batch on, deals rows to folders by key,
    so that readers of few keys open few. Many batches are merged to one.
    """
    spark = rows.sparkSession
    if batch is not None and _done(commits.read(spark, path)[1], int(batch)):
        return int(batch)
    name = _write(rows, path, key, bucketed)
    number: int | None = None

    def change(state: dict | None) -> dict | None:
        nonlocal number
        state = state or {"done": [], "folders": [], "bucketed": bucketed, "added": 0}
        number = int(batch) if batch is not None else max((hi for _, hi in state["done"]), default=0) + 1
        if _done(state, number):
            return None  # another delivery of the same batch came first
        added = state["added"] + 1
        return state | {"done": _with(state["done"], number), "folders": [*state["folders"], [added, name]], "added": added}

    after = commits.update(spark, path, change)
    if not any(f == name for _, f in after["folders"]):
        delete(spark, f"{path}/{name}")
    elif len(after["folders"]) > MERGE_AFTER:
        compact(spark, path, key)
    return number


def _read(spark: SparkSession, path: str, folders: list[list], buckets: Sequence[int] | None = None) -> DataFrame:
    """All rows of some folders with their batch's place among those added as _batch; merged ones have it in their rows."""
    out = None
    for merged in (False, True):
        some = {f"{path}/{name}": n for n, name in folders if name.startswith("merged-") == merged}
        if not some:
            continue
        rows = spark.read.option("mergeSchema", True)
        parts = []
        for folder, n in some.items():
            part = rows.parquet(folder)
            if buckets is not None:
                part = part.where(F.col("_bucket").isin([int(b) for b in buckets]))
            parts.append(part.drop("_bucket") if merged else part.drop("_bucket").withColumn("_batch", F.lit(n).cast("long")))
        for part in parts:
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _newest(rows: DataFrame, key: str) -> DataFrame:
    """The row of each key that was added last, with _batch."""
    fields = [c for c in rows.columns if c not in (key, "_batch")]
    kept = rows.groupBy(key).agg(F.max("_batch").alias("_batch"), F.max_by(F.struct(*fields) if fields else F.lit(0), "_batch").alias("_r"))
    return kept.select(key, *[F.col(f"_r.`{c}`").alias(c) for c in fields], "_batch")


def latest(spark: SparkSession, path: str, key: str, buckets: Sequence[int] | None = None) -> DataFrame | None:
    """The rows that upsert stored, the last of each key; None if there are none. buckets: only keys of these folders, of a store that has folders."""
    state = commits.read(spark, path)[1]
    if not state or not state["folders"]:
        return None
    return _newest(_read(spark, path, state["folders"], buckets if state["bucketed"] else None), key).drop("_batch")


def compact(spark: SparkSession, path: str, key: str) -> None:
    """Merge a store's batches to one, with the latest row of each key; batches that come meanwhile stay beside it.

    What was merged is removed when the next merge is done, for readers that began before.
    """
    state = commits.read(spark, path)[1]
    if not state or len(state["folders"]) < 2:
        return
    merged = state["folders"]
    name = "merged-" + _write(_newest(_read(spark, path, merged), key), f"{path}/tmp", key, state["bucketed"])
    source = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/tmp/{name.removeprefix('merged-')}")
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.rename(source, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"))
    gone: list[str] = []

    def change(now: dict | None) -> dict | None:
        gone[:] = []
        if any(f not in now["folders"] for f in merged):
            return None  # another merge came first
        gone[:] = now.get("old", [])
        rest = [f for f in now["folders"] if f not in merged]
        return now | {"folders": [[max(n for n, _ in merged), name], *rest], "old": [f for _, f in merged]}

    after = commits.update(spark, path, change)
    for folder in gone if any(f == name for _, f in after["folders"]) else [name]:
        delete(spark, f"{path}/{folder}")


def upsert_vectors(spark: SparkSession, path: str, new: DataFrame, key: str = "chunk_id", vector: str = "embedding", batch: int | None = None, recreate: bool = False) -> DataFrame:
    """Store a batch of vectors; of each key the latest batch counts. Returns what is stored.

    All vectors of a collection are of one dimension: one that differs within the batch, or from
    what is stored, is an error, before anything is written. Rows without key or
    vector are left out. recreate drops what was there.
    """
    rows = new.where(F.col(key).isNotNull() & (F.size(vector) > 0))
    sizes = {r[0] for r in rows.select(F.size(vector)).distinct().limit(2).collect()}
    if recreate:
        delete(spark, path)
    before = latest(spark, path, key)
    if before is not None:
        sizes |= {r[0] for r in before.select(F.size(vector)).distinct().limit(2).collect()}
    if len(sizes) > 1:
        raise ValueError(f"vectors of different dimensions: {sorted(sizes)}")
    if sizes:
        upsert(rows, path, key, batch)
    return latest(spark, path, key) if sizes else rows


def append_log(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def json_array(rows: DataFrame, key: str, column: str) -> DataFrame:
    """One row: the values of a column of JSON that are given, ordered by key, as one JSON array."""
    given = rows.where(F.col(column).isNotNull()).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(column).alias("v")))).alias("a"))
    return given.select(F.concat(F.lit("["), F.array_join(F.transform("a", lambda x: x["v"]), ","), F.lit("]")).alias("json"))


def export_json(rows: DataFrame, path: str, key: str, column: str) -> None:
    """The given values of a column of JSON, ordered by key, as one JSON array in one file.

    Lines are written by a sorted, single task, so no row has to hold them all.
    """
    ordered = rows.where(F.col(column).isNotNull()).repartition(1).sortWithinPartitions(key).select(F.col(column).alias("value"))

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = "["
        for pdf in batches:
            if len(pdf):
                values = pdf["value"].tolist()
                yield pd.DataFrame({"value": [before + values[0], *["," + v for v in values[1:]]]})
                before = ","
        yield pd.DataFrame({"value": ["[]" if before == "[" else "]"]})

    ordered.mapInPandas(lines, "value string").write.mode("overwrite").text(path)


def markdown_table(rows: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown; for reports, so a bounded number of rows."""
    got = rows.limit(most).collect()
    line = lambda cells: "| " + " | ".join(str(c) for c in cells) + " |"
    return "\n".join([line(rows.columns), line("---" for _ in rows.columns), *(line("" if v is None else v for v in r) for r in got)])


def load_prompt(path: str) -> dict[str, str]:
    """A prompt's parts from a file of ``name: text`` and ``name: |`` blocks; it must have system and user."""
    parts: dict[str, list[str]] = {}
    name, block = None, False
    with open(path, encoding="utf-8") as lines:
        for line in lines.read().splitlines():
            m = re.match(r"^([A-Za-z_]\w*):\s*(.*)$", line)
            if m:
                name, block = m[1], m[2].strip() in ("|", "|-", ">", ">-")
                parts[name] = [] if block else [m[2].strip().strip("'\"")]
            elif name and block:
                parts[name].append(line[2:] if line.startswith("  ") else line.strip())
    prompt = {k: "\n".join(v).strip() for k, v in parts.items()}
    if not prompt.get("system") or not prompt.get("user"):
        raise ValueError(f"prompt {path!r} needs the parts system and user")
    return prompt


#: A place in a template that is filled in.
FIELD = re.compile(r"\{\{\s*([A-Za-z_]\w*)\s*\}\}")


def render_prompt(template: str, values: dict[str, object]) -> str:
    """A template's {{ fields }} filled in; a missing one is an error, and so is a text that is then blank."""
    missing = sorted({name for name in FIELD.findall(template) if name not in values})
    if missing:
        raise KeyError(f"missing prompt variables: {missing}")
    out = FIELD.sub(lambda m: str(values[m[1]]), template)
    if not out.strip():
        raise ValueError("a rendered prompt must not be blank")
    return out


def rendered(template: str, **columns: Column) -> Column:
    """A template's {{ fields }} filled in by columns, row by row; a missing one is an error."""
    missing = sorted({name for name in FIELD.findall(template) if name not in columns})
    if missing:
        raise KeyError(f"missing prompt variables: {missing}")
    pieces = FIELD.split(template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(columns[p].cast("string"), F.lit("")) for i, p in enumerate(pieces)])


# ---- reports --------------------------------------------------------------


def write_report(frames: dict[str, DataFrame], path: str, title: str, most: int = 1000) -> str:
    """Each frame as JSON and CSV below path, and all as one Markdown report, which is returned.

    Files hold whole frames; the report, which people read, shows the first ``most`` rows and says so.
    """
    parts = [f"# {title}"]
    for name, frame in frames.items():
        frame.write.mode("overwrite").json(f"{path}/{name}.json")
        flat = frame.select(*[F.to_json(c).alias(c) if isinstance(frame.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(c) for c in frame.columns])
        flat.write.mode("overwrite").option("header", True).csv(f"{path}/{name}.csv")
        shown = markdown_table(frame, most)
        more = "" if shown.count("\n") < most + 1 else f"\n\nThe first {most} rows."
        parts.append(f"## {name}\n\n{shown}{more}")
    report = "\n\n".join(parts) + "\n"
    spark = next(iter(frames.values())).sparkSession
    spark.createDataFrame([(report,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report.md")
    return report


def read_rankings(spark: SparkSession, path: str, config: str | None = None, query: str | None = None) -> DataFrame:
    """(config, query_id, rank, result) of saved rankings, each result as JSON.

    A file holds a list of results, an object with ``results``, or one with
    ``rankings``: results by configuration and query, or by configuration alone.
    """
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    none = F.lit(None).cast("string")
    listed = F.when(F.col("v").startswith("["), F.col("v")).otherwise(F.get_json_object("v", "$.results"))
    flat = whole.select(none.alias("config"), none.alias("query_id"), F.from_json(listed, "array<string>").alias("r"))
    runs = whole.select(F.explode(F.from_json(F.get_json_object("v", "$.rankings"), "map<string,string>")).alias("config", "x"))
    keyed = runs.where(F.col("x").startswith("{")).select("config", F.explode(F.from_json("x", "map<string,string>")).alias("query_id", "y"))
    rows = runs.where(F.col("x").startswith("[")).select("config", F.explode(F.from_json("x", "array<string>")).alias("z"))
    by_row = rows.select("config", F.get_json_object("z", "$.query_id").alias("query_id"), F.get_json_object("z", "$.results").alias("y"))
    runs = keyed.unionByName(by_row).select("config", "query_id", F.from_json("y", "array<string>").alias("r"))
    found = flat.unionByName(runs).where("r IS NOT NULL").select("config", "query_id", F.posexplode("r").alias("pos", "result")).select("config", "query_id", (F.col("pos") + 1).alias("rank"), "result")
    if config is not None:
        found = found.where(F.col("config") == config)
    return found if query is None else found.where(F.col("query_id") == query)


def signatures(**parts: Column) -> Column:
    """As signature, of columns, row by row."""
    return F.sha2(F.to_json(F.struct(*[parts[name].alias(name) for name in sorted(parts)]), {"ignoreNullFields": "false"}), 256)


def signature(parts: dict[str, object]) -> str:
    """A hash of a run's inputs, the same for equal inputs in whatever order."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str, separators=(",", ":")).encode()).hexdigest()
