"""Joins of documents, workspaces and members: semi- and anti-joins, roll-ups and keyed merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible_to(workspaces: DataFrame, members: DataFrame, user_id: int, role: str) -> DataFrame:
    """Workspaces that a user belongs to; admins and managers see all."""
    if role in ("admin", "manager"):
        return workspaces
    return workspaces.join(members.where(F.col("user_id") == user_id).select("workspace_id"), "workspace_id", "left_semi")


def missing_from(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key), key, "left_anti")


def with_pins(docs: DataFrame, pins: DataFrame) -> DataFrame:
    """Documents with their pinned workspaces (sorted, each once) and the watched workspace set last."""
    by_doc = pins.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.when(F.col("pinned"), F.col("workspace_id")))).alias("pinned_in"), F.max_by("workspace_id", F.when(F.col("watched"), F.col("pin_id"))).alias("watched_in"))
    return docs.join(by_doc, "doc_id", "left")


def merged(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """existing (key, value) after updates (key, action, new_key, value), one action for each key, judged against the existing rows: remove deletes; update replaces a key that exists, under a new
    key unless another row has that; add inserts a key that doesn't exist. Other actions are skipped."""
    old, taken = existing.select("key", F.col("value").alias("old")), existing.select(F.col("key").alias("new_key"), F.lit(True).alias("taken"))
    judged = updates.join(old, "key", "left").join(taken, "new_key", "left")
    free = F.col("taken").isNull() | (F.col("new_key") == F.col("key"))
    done = judged.where(((F.col("action") == "remove") & F.col("old").isNotNull()) | ((F.col("action") == "update") & F.col("old").isNotNull() & free) | ((F.col("action") == "add") & F.col("old").isNull()))
    return existing.join(done, "key", "left_anti").unionByName(done.where("action <> 'remove'").select(F.col("new_key").alias("key"), "value"))


def clamped(threshold: Column, top_n: Column, history: Column) -> tuple[Column, Column, Column]:
    """Workspace settings within their bounds, with defaults for what is missing: threshold 0 to 1 (0.25), top n from 1 (4), history from 0 (20)."""
    t, n, h = (F.expr(f"try_cast({c} as double)") for c in (threshold, top_n, history))
    return (F.when(t.isNull(), 0.25).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))), F.when(n.isNull(), 4).otherwise(F.greatest(F.lit(1.0), F.floor(n))).cast("long"),
            F.when(h.isNull(), 20).otherwise(F.greatest(F.lit(0.0), F.floor(h))).cast("long"))


def replaced_members(members: DataFrame, workspace_id: int, users: DataFrame) -> DataFrame:
    return members.where(F.col("workspace_id") != workspace_id).unionByName(users.select(F.lit(workspace_id).cast("long").alias("workspace_id"), "user_id"))


def same_file_elsewhere(docs: DataFrame) -> DataFrame:
    """id, name, others, first_id: rows (name, id) whose file name other rows have as well, with how many those are and the smallest id of all. One row for each, not one for each pair."""
    by_name = docs.groupBy("name").agg((F.count("*") - 1).alias("others"), F.min("id").alias("first_id")).where("others > 0")
    return docs.join(by_name, "name").select("id", "name", "others", "first_id")


def in_batches(rows: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """rows with their batch of `size` within a key, from 0."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return rows.withColumn("batch", F.floor(place / size).cast("long"))


def moved(asked: DataFrame, embedded: DataFrame, key: str, target: str) -> DataFrame:
    """target, moved, total, message: of the files asked to move, those that aren't embedded do."""
    known = embedded.select(key).distinct().withColumn("known", F.lit(True))
    counts = asked.join(known, key, "left").groupBy(target).agg(F.count_if(F.col("known").isNull()).alias("moved"), F.count("*").alias("total"))
    return counts.withColumn("message", F.concat("moved", F.lit("/"), "total", F.lit(" files moved. Unembed the others first.")))


def watched(docs: DataFrame, asked: DataFrame, without: DataFrame) -> DataFrame:
    """docs (doc_id, name) with watched: whether any copy of the file is among those asked to be watched, and not among those to leave alone."""
    names = asked.join(without.select("doc_id"), "doc_id", "left_anti").select("name").distinct().withColumn("asked", F.lit(True))
    return docs.join(names, "name", "left").select("doc_id", "name", F.coalesce("asked", F.lit(False)).alias("watched"))


def purged(stores: dict[str, DataFrame], gone: DataFrame, key: str) -> DataFrame:
    """store, key: what is left of each store after a purge."""
    rows = [df.join(gone.select(key).distinct(), key, "left_anti").select(F.lit(name).alias("store"), key) for name, df in stores.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def with_totals(files: DataFrame, key: str, order: str, size: str) -> DataFrame:
    """files with so_far (running sum of sizes; null counts 0), and files and total of their key."""
    w = Window.partitionBy(key)
    filled = files.withColumn(size, F.coalesce(size, F.lit(0)).cast("long"))
    return filled.withColumns({"so_far": F.sum(size).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)), "files": F.count("*").over(w), "total": F.sum(size).over(w)})


def all_variables(built_in: DataFrame, own: DataFrame, user: bool) -> DataFrame:
    """Built-in variables (with needs_user) and a user's own in one table; without a user, built-ins that need one are left out."""
    return (built_in if user else built_in.where("not needs_user")).drop("needs_user").unionByName(own, allowMissingColumns=True)


def running_place(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order)))
