"""Several tables in one commit, changed by small files beside large ones.

A repository is a folder. Data files are written first, under names that nobody knows yet; one manifest then names the
layers of every table, and it appears by one rename, which fails where that number is taken. So a commit of many tables is seen
whole or not at all, a writer that dies leaves only files that no manifest names, and of two writers that started from one
version the second loses and can try again. A reader keeps the manifest it has read.

Layers of a table, in order: `rows` are whole rows (of all owners, or anew of some, whose older layers then no longer count), `upsert` are rows
that replace those of their keys, `delete` are keys that went. What a commit writes is in proportion to what it changes. A
read merges: of each key the last upsert or delete counts, and the rows that no later one names pass through, by an anti join
whose small side are the changes. `compact` writes the rows of some owners, or all, anew and drops their changes.

Keys may hold nulls, which equal nulls. The owner column, where a table has one, is one of the keys.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioforge.sources.store import _without, upsert


class Conflict(RuntimeError):
    """Another writer has committed since this one began."""


class Version:
    """A repository as one manifest has it; later commits don't change what it reads."""

    def __init__(self, home: Repository, manifest: dict) -> None:
        self.home, self.manifest = home, manifest
        self.number, self.tables = manifest["number"], manifest["tables"]

    def layers(self, table: str) -> list[dict]:
        return self.tables[table]["layers"]

    def _files(self, table: str, layer: dict, columns: Sequence[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(self.tables[table]["schema"])
        if columns is not None:
            schema = StructType([schema[c] for c in columns])
        return self.home.spark.read.schema(schema).parquet(f"{self.home.path}/{layer['path']}")

    def read(self, table: str, where: Column | None = None) -> DataFrame:
        """The rows of a table; `where`, on the keys alone, is applied to every layer before they meet."""
        known = self.tables[table]
        schema, keys, owner = StructType.fromJson(known["schema"]), known["keys"], known["owner"]
        rows, changes, later = [], [], []
        for place in reversed(range(len(known["layers"]))):
            layer = known["layers"][place]
            part = self._files(table, layer, keys if layer["kind"] == "delete" else None)
            part = part if where is None else part.where(where)
            for owners in later:  # written anew further up
                part = part.where(~F.coalesce(F.col(owner).isin(owners), F.lit(False)))
            if layer["kind"] == "rows":
                rows.append(part)
                if layer["owners"] is None:
                    break
                later.append(layer["owners"])
            else:
                item = F.struct(*schema.names) if layer["kind"] == "upsert" else F.lit(None).cast(schema)
                changes.append(part.select(*keys, F.lit(place).alias("_place"), item.alias("_row")))
        out = self.home.spark.createDataFrame([], schema)
        for i, part in enumerate(rows):
            out = part if i == 0 else out.unionByName(part)
        if changes:
            every = changes[0]
            for part in changes[1:]:
                every = every.unionByName(part)
            last = every.groupBy(*keys).agg(F.max_by("_row", "_place").alias("_row"))
            out = _without(out, last, keys).unionByName(last.where("_row IS NOT NULL").select("_row.*"))
        return out.select(*schema.names)


class Transaction:
    """Changes that become visible together. Use as a context manager, or call `commit`."""

    def __init__(self, home: Repository, parent: Version) -> None:
        self.home, self.parent = home, parent
        self.tables = json.loads(json.dumps(parent.tables))

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.commit()

    def create(self, table: str, schema: StructType, keys: Sequence[str], owner: str | None = None, split: str | None = None, order: str | None = None) -> None:
        """`split` is a key by whose values the files are told apart in folders, `order` a key by which they are sorted."""
        if table in self.tables:
            raise ValueError(f"there is a table {table}")
        if owner is not None and owner not in keys:
            raise ValueError("the owner must be one of the keys")
        self.tables[table] = {"schema": schema.jsonValue(), "keys": list(keys), "owner": owner, "split": split, "order": order or owner, "layers": []}

    def _write(self, table: str, rows: DataFrame, kind: str, placed: bool = False, **more) -> None:
        known, path = self.tables[table], f"data/{table}/{uuid.uuid4().hex}"
        names = known["keys"] if kind == "delete" else [f["name"] for f in known["schema"]["fields"]]
        types = {f.name: f.dataType for f in StructType.fromJson(known["schema"])}
        rows = rows.select(*[F.col(c).cast(types[c]).alias(c) for c in names])
        if known["split"] and not placed:
            rows = rows.hint("rebalance", known["split"])  # few files a folder, and a large folder's rows in several
        by = [c for c in (known["split"], known["order"]) if c]
        if by:
            rows = rows.sortWithinPartitions(*by)  # so that the files' ranges tell owners apart
        out = rows.write.partitionBy(known["split"]) if known["split"] else rows.write
        out.parquet(f"{self.home.path}/{path}")
        known["layers"].append({"kind": kind, "path": path, **more})

    def upsert(self, table: str, rows: DataFrame, placed: bool = False) -> None:
        """Rows replace those of equal keys; of several rows of one key the greatest in column order stays.

        `placed` says that there is one row a key and that the partitions are those of the files, so nothing is shuffled.
        """
        keys = self.tables[table]["keys"]
        self._write(table, rows if placed else upsert(rows.limit(0), rows, keys), "upsert", placed)

    def delete(self, table: str, keys: DataFrame) -> None:
        """The rows of these keys go; keys that are not there do no harm."""
        self._write(table, keys.select(*self.tables[table]["keys"]).distinct(), "delete")

    def delete_where(self, table: str, owner_id, **equal) -> None:
        """The rows of an owner with all the given values go (one value, or a list of them)."""
        if not equal:
            raise ValueError("a deletion needs a document, version, rule or node")
        test = F.col(self.tables[table]["owner"]) == F.lit(owner_id)
        for name, value in equal.items():
            test &= F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == F.lit(value)
        self.delete(table, self.parent.read(table, F.col(self.tables[table]["owner"]) == F.lit(owner_id)).where(test))

    def replace(self, table: str, rows: DataFrame, groups: DataFrame) -> None:
        """All rows of the groups (values of some of the columns) go, and `rows` come."""
        named = groups.columns
        gone = groups.select(*[F.col(c).alias(f"_gone_{c}") for c in named]).distinct()
        now = self.parent.read(table).join(gone, [F.col(c).eqNullSafe(F.col(f"_gone_{c}")) for c in named], "left_semi")
        keys = self.tables[table]["keys"]
        self.delete(table, _without(now.select(*keys), rows, keys))
        self.upsert(table, rows)

    def become(self, table: str, rows: DataFrame, where: Column | None = None) -> None:
        """The table (or what `where`, on the keys, says of it) becomes `rows`; only rows that differ are written."""
        keys = self.tables[table]["keys"]
        names = [f["name"] for f in self.tables[table]["schema"]["fields"]]
        now = self.parent.read(table, where).select(*keys, F.struct(*names).alias("_now"))
        new = rows.select(*[F.col(c).alias(f"_key_{i}") for i, c in enumerate(keys)], F.struct(*names).alias("_new"))
        met = now.join(new, [F.col(c).eqNullSafe(F.col(f"_key_{i}")) for i, c in enumerate(keys)], "full")
        self.delete(table, met.where("_new IS NULL").select("_now.*"))
        self.upsert(table, met.where("_new IS NOT NULL AND NOT (_now <=> _new)").select("_new.*"))

    def rewrite(self, table: str, rows: DataFrame, owners: Sequence | None = None, placed: bool = False) -> None:
        """`rows` are the table from now on, or that of some owners; older layers no longer count. `placed` as in `upsert`."""
        self._write(table, rows, "rows", placed, owners=None if owners is None else list(owners))
        if owners is None:
            self.tables[table]["layers"] = self.tables[table]["layers"][-1:]

    def written(self, table: str) -> DataFrame:
        """The rows that this transaction wrote last for a table."""
        return Version(self.home, {"number": self.parent.number, "tables": self.tables})._files(table, self.tables[table]["layers"][-1])

    def commit(self) -> Version:
        return self.home._publish(self.parent.number + 1, self.tables)


class Repository:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._p("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _list(self, name: str) -> list[str]:
        at = self._p(name)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self._list("manifests") if n.isdigit())

    def at(self, number: int | None = None) -> Version:
        """The repository as it is now, or was; an empty one has the number 0."""
        number = max(self.versions(), default=0) if number is None else number
        if not number:
            return Version(self, {"number": 0, "tables": {}})
        text = self.spark.read.text(f"{self.path}/manifests/{number}", wholetext=True).first()[0]
        return Version(self, json.loads(text))

    def begin(self, parent: Version | None = None) -> Transaction:
        return Transaction(self, parent or self.at())

    def _publish(self, number: int, tables: dict) -> Version:
        manifest = {"number": number, "tables": tables}
        fresh = self._p(f"manifests/new-{uuid.uuid4().hex}")
        out = self._fs.create(fresh, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        pointer = self._p(f"manifests/{number}")
        if self._fs.exists(pointer) or not self._fs.rename(fresh, pointer):
            self._fs.delete(fresh, False)
            raise Conflict(f"another writer has committed version {number} of {self.path}")
        return Version(self, manifest)

    def change(self, work: Callable[[Transaction], None], tries: int = 3) -> Version:
        """`work` in a transaction, from the newest version again where another writer was faster."""
        for left in reversed(range(tries)):
            change = self.begin()
            work(change)
            try:
                return change.commit()
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def compact(self, table: str, owners: Sequence | None = None) -> Version:
        """The rows of these owners, or all, in one layer, without changes beside them."""
        change = self.begin()
        owner = change.tables[table]["owner"]
        rows = change.parent.read(table, None if owners is None else F.col(owner).isin(list(owners)))
        change.rewrite(table, rows.repartitionByRange(F.col(owner)) if owner else rows, owners)
        return change.commit()

    def drop_unused(self, keep: int = 1) -> int:
        """Delete manifests but the newest `keep`, and data that none of these names; writers must be at rest. The number of folders that went."""
        stay = self.versions()[-keep:]
        named = {layer["path"] for n in stay for t in self.at(n).tables.values() for layer in t["layers"]}
        gone = 0
        for name in self._list("manifests"):
            if not name.isdigit() or int(name) not in stay:
                self._fs.delete(self._p(f"manifests/{name}"), False)
        for table in self._list("data"):
            for name in self._list(f"data/{table}"):
                if f"data/{table}/{name}" not in named:
                    self._fs.delete(self._p(f"data/{table}/{name}"), True)
                    gone += 1
        return gone

    def size(self, table: str, layer: dict | None = None) -> int:
        """Bytes of a layer, or of all that is stored for a table."""
        at = self._p(layer["path"] if layer else f"data/{table}")
        return self._fs.getContentSummary(at).getLength()
