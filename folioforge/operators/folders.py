"""Folder trees: closures, paths, order, scopes, moves, deletion and uploads.

What asks for some trees walks down from their roots, level by level, and touches their folders alone; below WALK levels pointers
that double their reach take over, which are one row a folder. What needs all folders above all folders joins reaches that
double. A stored closure is patched: only the rows of folders that changed, or lie below those that did, are made anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions.ids import stable_uuid
from folioforge.functions.text import composed, natural_key
from folioforge.session import numbered, stored
from folioforge.sources.commits import Repository, Transaction, Version


#: Levels that a walk from given folders goes down, or up, one by one.
WALK = 24


def ancestors(folders: DataFrame) -> DataFrame:
    """(id, ancestor, distance): every folder with itself and all above it, by joins that double the reach.

    Each round is stored, so it is one join whatever came before, and the rounds end when nothing is added. A link that would close a cycle or name a missing parent ends the way up there.
    """
    up = folders.select("id", F.col("parent_id").alias("ancestor")).where("ancestor IS NOT NULL AND ancestor <> id")
    up = up.join(folders.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id", "ancestor", F.lit(1).alias("distance"))
    reach = stored(up, "folder-reach")
    size = reach.count()
    while True:
        a, b = reach.alias("a"), reach.alias("b")
        longer = a.join(b, F.col("a.ancestor") == F.col("b.id")).select(F.col("a.id").alias("id"), F.col("b.ancestor").alias("ancestor"), (F.col("a.distance") + F.col("b.distance")).alias("distance"))
        reach = stored(reach.unionByName(longer.where("id <> ancestor")).groupBy("id", "ancestor").agg(F.min("distance").alias("distance")), "folder-reach")
        before, size = size, reach.count()
        if size == before:
            break
    return reach.unionByName(folders.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance")))


def descendants(folders: DataFrame, roots: DataFrame) -> DataFrame:
    """(id) of all folders in the trees of roots(id), the roots themselves included."""
    links = folders.select("id", "parent_id")
    level = stored(folders.select("id").join(roots.select("id"), "id", "left_semi").distinct(), "folder-level")
    seen = level
    for _ in range(WALK):
        below = links.join(level.withColumnRenamed("id", "parent_id"), "parent_id").select("id").distinct()
        level = stored(below.join(seen, "id", "left_anti"), "folder-level")
        if level.isEmpty():
            return seen
        seen = seen.unionByName(level)
    return _below(folders, seen)


def _below(folders: DataFrame, roots: DataFrame) -> DataFrame:
    """`descendants` by pointers: each folder knows one above it, twice as far each round, and whether a root was passed on the way."""
    own = folders.select("id", "parent_id").join(roots.select("id", F.lit(True).alias("hit")), "id", "left")
    rows = stored(own.select("id", F.nullif("parent_id", "id").alias("up"), F.coalesce("hit", F.lit(False)).alias("hit")), "folder-pointers")
    most = rows.count()
    reach = 1
    while reach < 2 * most and not rows.where("up IS NOT NULL AND NOT hit").isEmpty():
        above = rows.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("hit").alias("_hit"))
        rows = stored(rows.join(above, "up", "left").select("id", F.nullif("_up", "id").alias("up"), (F.col("hit") | F.coalesce("_hit", F.lit(False))).alias("hit")), "folder-pointers")
        reach *= 2
    return rows.where("hit").select("id")


def patch(closure: DataFrame, folders: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gone, fresh): the rows of closure(id, ancestor, distance) that no longer hold, and those that now do, as `folders` are now.

    changed(id) names folders that were created, moved or deleted since. Made anew are these and what lay below them; all
    else keeps its rows. Any batch will do, moves within moved trees too.
    """
    changed = changed.select("id").distinct()
    below = closure.join(changed.withColumnRenamed("id", "ancestor"), "ancestor", "left_semi").select("id")
    touched = stored(changed.unionByName(below).distinct(), "closure-touched")
    inside = stored(folders.select("id", "parent_id").join(touched, "id", "left_semi"), "closure-inside")
    own = ancestors(inside)
    tops = inside.join(touched.withColumnRenamed("id", "parent_id"), "parent_id", "left_anti").where("parent_id IS NOT NULL")
    over = closure.join(tops.select(F.col("parent_id").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("parent_id"), F.col("ancestor").alias("_over"), F.col("distance").alias("_more"))
    outside = own.join(tops.select(F.col("id").alias("ancestor"), "parent_id"), "ancestor").join(over, "parent_id")
    outside = outside.select("id", F.col("_over").alias("ancestor"), (F.col("distance") + F.col("_more") + 1).alias("distance"))
    return closure.join(touched, "id", "left_semi"), own.select("id", "ancestor", "distance").unionByName(outside)


def patched(closure: DataFrame, folders: DataFrame, changed: DataFrame) -> DataFrame:
    """The closure of `folders`, from the one before the folders changed(id) changed."""
    gone, fresh = patch(closure, folders, changed)
    return closure.join(gone.select("id").distinct(), "id", "left_anti").unionByName(fresh)


def commit_closure(home: Repository, folders: DataFrame, changed: DataFrame, table: str = "folder_closure") -> Version:
    """`patch` on a closure in a repository, keyed by id and ancestor; what is written is in proportion to what changed."""

    def work(change: Transaction) -> None:
        gone, fresh = patch(change.parent.read(table), folders, changed)
        fresh = stored(fresh, "closure-fresh")
        change.delete(table, gone.join(fresh, ["id", "ancestor"], "left_anti"))
        change.upsert(table, fresh)

    return home.change(work)


def folder_paths(folders: DataFrame) -> DataFrame:
    """(id, depth, path, names): ids and names from the top down to the folder."""
    up = ancestors(folders).join(folders.select(F.col("id").alias("ancestor"), "name"), "ancestor")
    rows = up.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), F.col("ancestor").alias("a"), "name"))).alias("xs"))
    return rows.select("id", (F.size("xs") - 1).alias("depth"), F.transform("xs", lambda x: x["a"]).alias("path"), F.transform("xs", lambda x: x["name"]).alias("names"))


def flatten(folders: DataFrame) -> DataFrame:
    """(position, id, depth): the tree in pre-order, siblings by sort_order, name in natural order, then id.

    Folders whose parent is missing come after the tree as roots of their own, at depth 0.
    """
    up = ancestors(folders)
    ways = up.join(folders.select(F.col("id").alias("ancestor"), F.struct("sort_order", natural_key(F.col("name")).alias("k"), F.col("id").alias("i")).alias("key"), "parent_id"), "ancestor")
    rows = ways.groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "key"))), lambda x: x["key"]).alias("way"),
        F.max("distance").alias("depth"),
        F.max_by("parent_id", "distance").isNotNull().alias("orphan"),
    )
    return numbered(rows, ["orphan", "way"], "position").select("position", "id", "depth")


def content_counts(folders: DataFrame, documents: DataFrame) -> DataFrame:
    """(folder_id, folders, documents): children of each folder; the null row counts what lies at the top."""
    f = folders.groupBy(F.col("parent_id").alias("folder_id")).agg(F.count(F.lit(1)).alias("folders"))
    d = documents.groupBy("folder_id").agg(F.count(F.lit(1)).alias("documents"))
    both = f.withColumn("documents", F.lit(0).cast("long")).unionByName(d.withColumn("folders", F.lit(0).cast("long")))
    return both.groupBy("folder_id").agg(F.sum("folders").alias("folders"), F.sum("documents").alias("documents"))


def documents_in_scope(documents: DataFrame, folders: DataFrame, folder_id=None, recursive: bool = True) -> DataFrame:
    """The documents of a folder, with those of its subfolders if recursive; folder_id None: those at the top."""
    if folder_id is None:
        return documents.where("folder_id IS NULL")
    if not recursive:
        return documents.where(F.col("folder_id") == folder_id)
    inside = descendants(folders, folders.where(F.col("id") == folder_id))
    return documents.join(inside.withColumnRenamed("id", "folder_id"), "folder_id", "left_semi")


def can_move(folders: DataFrame, moves: DataFrame) -> DataFrame:
    """moves(id, target) with `allowed`: a folder must not move into its own tree; a null target is the top."""
    links = folders.select(F.col("id").alias("at"), F.col("parent_id").alias("_up"))
    way = stored(moves.where("target IS NOT NULL").select("id", "target", F.col("target").alias("at")).distinct(), "move-way")
    refused = None
    for level in range(WALK + 1):  # from the targets up, until nothing is above
        met = way.where("at = id").join(folders.select("id"), "id", "left_semi").select("id", "target")
        refused = met if refused is None else refused.unionByName(met)
        if level == WALK:
            whole = ancestors(folders).select(F.col("id").alias("at"), F.col("ancestor").alias("id"))
            refused = refused.unionByName(way.join(whole, ["at", "id"], "left_semi").select("id", "target"))
            break
        way = stored(way.where("at <> id").join(links, "at").where("_up IS NOT NULL").select("id", "target", F.col("_up").alias("at")), "move-way")
        if way.isEmpty():
            break
    refused = refused.distinct().withColumn("_in", F.lit(True))
    return moves.join(refused, ["id", "target"], "left").select("id", "target", F.col("_in").isNull().alias("allowed"))


def search_scope(documents: DataFrame, folders: DataFrame, folder_id=None, requested: DataFrame | None = None) -> DataFrame:
    """(document_id): the active documents of a folder's tree and of those asked for. An unknown folder is an error."""
    rows = documents.where("coalesce(deletion_status, 'active') = 'active'") if "deletion_status" in documents.columns else documents
    if folder_id is not None:
        if folders.where(F.col("id") == folder_id).isEmpty():
            raise ValueError("the folder does not exist")
        rows = documents_in_scope(rows, folders, folder_id)
    if requested is not None:
        rows = rows.join(requested.select("document_id"), "document_id", "left_semi")
    return rows.select("document_id").distinct()


def deletion_targets(folders: DataFrame, documents: DataFrame, selected: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(folders, documents, roots) that go with the selected(id) folders; roots have no selected folder above them."""
    missing = selected.join(folders, "id", "left_anti")
    if not missing.isEmpty():
        raise ValueError("a selected folder does not exist")
    closure = descendants(folders, selected)
    above = folders.join(closure.withColumnRenamed("id", "parent_id"), "parent_id", "left_semi").select("id")  # what lies in a tree without being its root
    inside = documents.join(closure.withColumnRenamed("id", "folder_id"), "folder_id", "left_semi")
    return closure, inside, selected.select("id").distinct().join(above, "id", "left_anti")


def delete_trees(folders: DataFrame, selected: DataFrame) -> DataFrame:
    """The folders that stay."""
    return folders.join(descendants(folders, selected), "id", "left_anti")


def move(rows: DataFrame, moves: DataFrame, column: str) -> DataFrame:
    """rows(id, column, ...) with the column set to `target` of moves(id, target) where there is one; of several the least, null first."""
    to = moves.groupBy("id").agg(F.min(F.struct("target")).alias("_to"))
    return rows.join(to, "id", "left").withColumn(column, F.when(F.col("_to").isNotNull(), F.col("_to.target")).otherwise(F.col(column))).drop("_to")


def upload_plan(entries: DataFrame) -> DataFrame:
    """(path, name, parent, depth) of all folders that relative paths name, by depth and path.

    Names are in composed form. Blank, '.' and '..' segments are refused, as are paths with different first segments.
    """
    parts = F.split(F.regexp_replace(composed(F.col("relative_path")), r"\\", "/"), "/")
    rows = entries.select(parts.alias("p"))
    bad = F.exists("p", lambda x: F.trim(x).isin("", ".", ".."))
    wrong = rows.agg(F.bool_or(bad).alias("bad"), F.count_distinct(F.element_at("p", 1)).alias("tops")).first()
    if wrong.bad:
        raise ValueError("a path has an empty or relative segment")
    if wrong.tops > 1:
        raise ValueError("all paths must lie in one folder")
    dirs = rows.where("size(p) > 1").select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda k: F.slice("p", F.lit(1), k))).alias("d")).distinct()
    path = lambda a: F.array_join(a, "/")
    return dirs.select(
        path(F.col("d")).alias("path"), F.element_at("d", -1).alias("name"), F.when(F.size("d") > 1, path(F.slice("d", F.lit(1), F.size("d") - 1))).alias("parent"), F.size("d").alias("depth")
    ).orderBy("depth", "path")


def ensure_tree(folders: DataFrame, plan: DataFrame, owner: str) -> DataFrame:
    """(path, id, parent_id, name, created): an existing folder of the same name (any case) is used again, level by level."""
    known = folder_paths(folders).select(F.lower(composed(F.array_join("names", "/"))).alias("_k"), "id").groupBy("_k").agg(F.min("id").alias("id"))
    made = stable_uuid(F.concat_ws(":", F.lit("folder"), F.lit(owner), F.lower("path")))
    rows = plan.withColumn("_k", F.lower("path")).join(known, "_k", "left").select("path", "parent", "name", "depth", F.coalesce(F.col("id").cast("string"), made).alias("id"), F.col("id").isNull().alias("created"))
    up = rows.select(F.col("path").alias("parent"), F.col("id").alias("parent_id"))
    return rows.join(up, "parent", "left").select("path", "id", "parent_id", "name", "created", "depth")
