"""Parsed trajectories: JSON and tar import, the long step table, layout changes."""

from __future__ import annotations

import io
import json
import re
import sys
import tarfile
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOVE = ("STRUCT<name: STRING, move_type: STRING, category: STRING, base_power: INT, accuracy: DOUBLE, priority: INT, "
        "current_pp: INT, max_pp: INT>")
MEMBER = (f"STRUCT<name: STRING, hp_pct: DOUBLE, types: STRING, item: STRING, ability: STRING, lvl: INT, status: STRING, "
          f"effect: STRING, moves: ARRAY<{MOVE}>, atk_boost: INT, spa_boost: INT, def_boost: INT, spd_boost: INT, "
          "spe_boost: INT, accuracy_boost: INT, evasion_boost: INT, base_atk: INT, base_spa: INT, base_def: INT, "
          "base_spd: INT, base_spe: INT, base_hp: INT, tera_type: STRING, base_species: STRING>")
STATE = (f"STRUCT<format: STRING, player_active_pokemon: {MEMBER}, opponent_active_pokemon: {MEMBER}, "
         f"available_switches: ARRAY<{MEMBER}>, opponent_bench: ARRAY<{MEMBER}>, fainted_pokemon: ARRAY<{MEMBER}>, "
         f"opponent_fainted: ARRAY<{MEMBER}>, player_prev_move: {MOVE}, opponent_prev_move: {MOVE}, opponents_remaining: INT, "
         "player_conditions: STRING, opponent_conditions: STRING, weather: STRING, battle_field: STRING, forced_switch: BOOLEAN, "
         "battle_won: BOOLEAN, battle_lost: BOOLEAN, can_tera: BOOLEAN, opponent_teampreview: ARRAY<STRING>>")
TRAJECTORY_SCHEMA = f"states ARRAY<{STATE}>, actions ARRAY<INT>"


def read_trajectory_json(spark: SparkSession, roots: Sequence[str], schema: str = TRAJECTORY_SCHEMA,
                         multi_line: bool = True) -> DataFrame:
    """Trajectories from JSON files, with the file name that carries their metadata."""
    return (spark.read.schema(schema).option("recursiveFileLookup", True).option("multiLine", multi_line).json(list(roots))
            .withColumn("file_name", F.col("_metadata.file_name")))


_BODY = "archive STRING, file_name STRING, body STRING, error STRING"


def _text(name: str, data: bytes) -> tuple[str | None, str | None]:
    """Text of a JSON file, plain or in an LZ4 frame, and what is wrong with it."""
    try:
        if name.endswith(".lz4"):
            with pa.CompressedInputStream(pa.BufferReader(data), "lz4") as stream:
                data = stream.read()
        body = data.decode("utf-8")
        json.loads(body)
        return body, None
    except (OSError, ValueError) as error:
        return None, f"{type(error).__name__}: {error}"


def _opened(path: str) -> pa.NativeFile:
    """A file of any store that ``pyarrow.fs`` knows, for reads at any place."""
    system, name = pafs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path) if ":" in path else f"file://{path}")
    return system.open_input_file(name)


_INDEX = "archive STRING, file_name STRING, offset LONG, size LONG, error STRING"


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the JSON members of archives lie.  Only headers are read; what follows damage is a row with an error."""
    names = [c.split()[0] for c in _INDEX.split(", ")]
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
    for path in (p for batch in batches for p in batch.column(0).to_pylist()):
        rows: list[tuple] = []
        try:
            with _opened(path) as file, tarfile.open(fileobj=file, mode="r:") as tar:
                length = file.size()
                for entry in tar:
                    if entry.isfile() and entry.name.endswith((".json", ".json.lz4")):
                        short = entry.offset_data + entry.size > length
                        rows.append((path, entry.name.rsplit("/", 1)[-1], entry.offset_data, entry.size, "the archive ends in this member" if short else None))
                    tar.members.clear()  # tarfile keeps all it has seen
                    if len(rows) >= 1 << 14:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows = []
        except (tarfile.TarError, OSError) as error:
            rows.append((path, None, None, None, f"{type(error).__name__}: {error}"))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bodies of members, read by their byte ranges; an archive stays open while its members come."""
    names = [c.split()[0] for c in _BODY.split(", ")]
    path, file = None, None
    for batch in batches:
        rows, held = [], 0
        for archive, name, offset, size, error in zip(*[c.to_pylist() for c in batch.columns[:5]]):
            body = None
            if error is None:
                if archive != path:
                    if file:
                        file.close()
                    path, file = archive, _opened(archive)
                file.seek(offset)
                body, error = _text(name, file.read(size))
            rows.append((archive, name, body, error))
            held += size or 0
            if held > 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names)
    if file:
        file.close()


def archive_index(archives: DataFrame) -> DataFrame:
    """archive, file_name, offset, size, error of every JSON member of the tar archives whose paths are in the column
    ``archive``: one pass over the headers.  Stored, so that later reads go straight to the members."""
    return materialise(archives.select("archive").repartition("archive").mapInArrow(_headers, _INDEX), "archive-index")


def archive_bodies(index: DataFrame, target: int = 1 << 27) -> DataFrame:
    """archive, file_name, body, error of the members in an index.  Members are dealt to tasks by stretches of about ``target``
    bytes of their archive, so many tasks read one large archive."""
    stretch = F.floor(F.col("offset") / target)
    rows = index.repartition("archive", stretch).sortWithinPartitions("archive", "offset")
    return rows.mapInArrow(_bodies, _BODY)


def write_archives(bodies: DataFrame, path: str, roll_bytes: int = 1 << 28) -> DataFrame:
    """Tar archives below ``path`` with the JSON ``body`` of each row under its ``file_name``, in an LZ4 frame where that ends in
    ``.lz4``: archive, members.  Archives of failed attempts are not in the result."""
    def write(batches):
        made, out, tar, count = [], None, None, 0
        system, base = pafs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path) if ":" in path else f"file://{path}")
        system.create_dir(base, recursive=True)

        def close() -> None:
            if tar:
                tar.close()
                out.close()
                made.append((name, count))

        for batch in batches:
            for file_name, body in zip(batch.column("file_name").to_pylist(), batch.column("body").to_pylist()):
                if tar is None or out.tell() > roll_bytes:
                    close()
                    name, count = f"{path}/{uuid.uuid4().hex}.tar", 0
                    out = system.open_output_stream(f"{base}/{name.rsplit('/', 1)[-1]}")
                    tar = tarfile.open(fileobj=out, mode="w|")
                data = body.encode()
                if file_name.endswith(".lz4"):
                    sink = pa.BufferOutputStream()
                    with pa.CompressedOutputStream(sink, "lz4") as stream:
                        stream.write(data)
                    data = sink.getvalue().to_pybytes()
                entry = tarfile.TarInfo(file_name)
                entry.size = len(data)
                tar.addfile(entry, io.BytesIO(data))
                count += 1
        close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made]), pa.array([m[1] for m in made], pa.int64())], ["archive", "members"])

    return materialise(bodies.select("file_name", "body").mapInArrow(write, "archive STRING, members LONG"), "archives")


def _files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            body, error = _text(path, content)
            yield pd.DataFrame({"archive": [None], "file_name": [path.rsplit("/", 1)[-1]], "body": [body], "error": [error]})


def _decoded(spark: SparkSession, roots: Sequence[str], glob: str, read) -> DataFrame:
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
             .load(list(roots)).select("path", "content"))
    return files.mapInPandas(read, _BODY)


def archive_members(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """archive, file_name, body, error of every JSON member of the tar archives below ``roots``, plain or LZ4."""
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.tar")
             .load(list(roots)).select(F.col("path").alias("archive")))
    return archive_bodies(archive_index(found))


def compressed_files(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """The same of single LZ4 files."""
    return _decoded(spark, roots, "*.json.lz4", _files)


def parsed(bodies: DataFrame, schema: str = TRAJECTORY_SCHEMA) -> DataFrame:
    """Trajectories of the bodies without an error; those with one are for the quarantine table."""
    return bodies.where("error IS NULL").withColumn("_t", F.from_json("body", schema)).select("_t.*", "file_name")


def read_trajectory_archives(spark: SparkSession, roots: Sequence[str], schema: str = TRAJECTORY_SCHEMA) -> DataFrame:
    """Trajectories from tar archives, one row per member."""
    return parsed(archive_members(spark, roots), schema)


def to_steps(trajectories: DataFrame, keys: Sequence[str], states: str = "states", actions: str = "actions") -> DataFrame:
    """Long table (keys, t, state, action) from parallel arrays."""
    cells = F.arrays_zip(F.col(states).alias("state"), F.col(actions).alias("action"))
    return trajectories.select(*keys, F.posexplode(cells).alias("t", "_c")).select(
        *keys, "t", F.col("_c.state").alias("state"), F.col("_c.action").alias("action"))


def write_steps(steps: DataFrame, path: str, *partition_by: str, mode: str = "append") -> None:
    """Store steps; a job's files appear together when it commits."""
    rows = steps.hint("rebalance", *partition_by) if partition_by else steps
    rows.write.mode(mode).partitionBy(*partition_by).parquet(path)


def relayout(files: DataFrame, path: str = "path") -> DataFrame:
    """Model and format of pile files ``.../{model}/{folder}/{format}/{name}`` for storage by format."""
    part = lambda i: F.regexp_extract(F.col(path), r"([^/]+)/[^/]+/([^/]+)/([^/]+)$", i)
    return files.withColumn("model", part(1)).withColumn("format", part(2)).withColumn("file_name", part(3)).where("format <> ''")
