"""Versions of a set of tables: written beside each other, named by one pointer, checked before they count.

A version is a folder of tables that never changes, with a manifest of the rows and
a checksum of each. ``CURRENT`` names the version that readers see and is replaced in
one rename, so they see one version or the other, never half of one. Restoring points
to an older version once its tables agree with its manifest; the version that was
current stays where it is and its name is kept, so a restore can be taken back.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.session import remove_path

MANIFEST = "table_name string, n_rows bigint, checksum decimal(38,0), table_schema string"


class DamagedVersion(ValueError):
    """A version whose tables are not what its manifest says."""


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """Rows, and a checksum of them that doesn't depend on their order; floats by their bits, maps by their entries."""
    columns = [F.to_json(F.struct(f.name)) if "map" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema]
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*columns, F.lit(1)).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("s")).first()
    return row["n"], int(row["s"])


class Versions:
    """Versions of tables below ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _files(self):
        return self._path().getFileSystem(self._conf)

    def _folder(self, name: str) -> str:
        return f"{self.root}/versions/{name}"

    def names(self) -> list[str]:
        """Complete versions, the oldest name first."""
        files, top = self._files(), self._path("versions")
        found = [s.getPath().getName() for s in files.listStatus(top)] if files.exists(top) else []
        return sorted(n for n in found if files.exists(self._path("versions", n, "manifest", "_SUCCESS")))

    def _pointed(self, pointer: str) -> str | None:
        files, path = self._files(), self._path(pointer)
        if not files.exists(path):
            return None
        stream = files.open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip() or None
        finally:
            stream.close()

    def _point(self, pointer: str, name: str) -> None:
        """Write a pointer aside and rename it over the old one."""
        files, staged = self._files(), self._path(f".{pointer}.{uuid.uuid4().hex}")
        stream = files.create(staged, True)
        try:
            stream.write(bytearray(name.encode()))
        finally:
            stream.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self._conf)
        context.rename(context.makeQualified(staged), context.makeQualified(self._path(pointer)), options)

    def current(self) -> str | None:
        return self._pointed("CURRENT")

    def previous(self) -> str | None:
        """The version that was current before the last switch."""
        return self._pointed("PREVIOUS")

    def create(self, tables: Mapping[str, DataFrame], name: str, switch: bool = True) -> str:
        """Write a version; its manifest, of the rows as written, comes last and makes it complete. What fails leaves nothing."""
        if self._files().exists(self._path("versions", name)):
            raise FileExistsError(name)
        try:
            rows = []
            for key, df in tables.items():
                df.write.parquet(f"{self._folder(name)}/tables/{key}")
                written = self.spark.read.schema(df.schema).parquet(f"{self._folder(name)}/tables/{key}")
                rows.append((key, *fingerprint(written), df.schema.json()))
            manifest = self.spark.createDataFrame([(k, n, str(s), j) for k, n, s, j in rows], "table_name string, n_rows bigint, checksum string, table_schema string")
            manifest.withColumn("checksum", F.col("checksum").cast("decimal(38,0)")).coalesce(1).write.parquet(f"{self._folder(name)}/manifest")
        except BaseException:
            remove_path(self.spark, self._folder(name))
            raise
        if switch:
            self.switch(name)
        return name

    def manifest(self, name: str) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self._folder(name)}/manifest")

    def tables(self, name: str | None = None) -> dict[str, DataFrame]:
        """The tables of a version, by default the current one, which stays the same for whoever holds them."""
        name = name or self.current()
        if name is None:
            return {}
        rows = self.manifest(name).collect()  # a row a table
        return {r["table_name"]: self.spark.read.schema(T.StructType.fromJson(json.loads(r["table_schema"]))).parquet(f"{self._folder(name)}/tables/{r['table_name']}") for r in rows}

    def damage(self, name: str) -> dict[str, str]:
        """What is wrong with a version, by table; empty if it is as its manifest says."""
        if name not in self.names():
            return {"": "no such version"}
        out = {}
        for row in self.manifest(name).collect():
            try:
                found = fingerprint(self.tables(name)[row["table_name"]])
                if found != (row["n_rows"], int(row["checksum"])):
                    out[row["table_name"]] = f"{found[0]} rows of {row['n_rows']}, or other values"
            except Exception as error:  # noqa: BLE001  an unreadable file is damage, whatever the reader calls it
                out[row["table_name"]] = str(error).split("\n")[0][:300]
        return out

    def switch(self, name: str) -> None:
        """Make a version the current one."""
        if (was := self.current()) and was != name:
            self._point("PREVIOUS", was)
        self._point("CURRENT", name)

    def restore(self, name: str) -> str | None:
        """Go back to a version whose tables agree with its manifest; returns the name of the one set aside. Else nothing changes."""
        if wrong := self.damage(name):
            raise DamagedVersion(f"{name}: {wrong}")
        was = self.current()
        self.switch(name)
        return was

    def take_back(self) -> str:
        """Undo the last switch."""
        was = self.previous()
        if was is None:
            raise ValueError("there was no other version")
        self.switch(was)
        return was

    def prune(self, keep: int = 10) -> list[str]:
        """Remove all but the newest ``keep`` versions, the current and the previous one; returns the removed names."""
        spared = {self.current(), self.previous()}
        gone = [n for n in self.names()[: -keep or None] if n not in spared]
        for name in gone:
            remove_path(self.spark, self._folder(name))
        return gone
