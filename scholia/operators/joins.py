"""Joins between the platform's tables. Sides are broadcast only when Spark's own size check allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def notes_with_owner(notes: DataFrame, resources: DataFrame) -> DataFrame:
    """Notes and the user of the resource they belong to."""
    return (notes.drop("user_id").join(resources.select("resource_id", "user_id", "title"), "resource_id")
            .select("note_id", "title", "user_id", notes["created_at"]))


def note_owner_either(notes: DataFrame, resources: DataFrame) -> DataFrame:
    """Every (note, user) pair where the user owns the note itself or its resource.

    The OR spans both sides of a left join, so it is taken after the join: one row per distinct owner.
    """
    r = resources.select("resource_id", F.col("user_id").alias("_via"))
    owners = F.array_distinct(F.array_compact(F.array("user_id", "_via")))
    return notes.join(r, "resource_id", "left").select("note_id", F.explode(owners).alias("owner"))


def with_existing_parent(notes: DataFrame, resources: DataFrame, condition: Column) -> DataFrame:
    return notes.join(resources.filter(condition).select("resource_id"), "resource_id", "left_semi")


def below_concurrency(tasks: DataFrame, max_concurrent: int) -> DataFrame:
    """Pending tasks of users with fewer running tasks than allowed; 0 or less means no limit."""
    pending = tasks.filter(F.col("status") == "pending")
    if max_concurrent <= 0:
        return pending
    busy = (tasks.filter(F.col("status") == "running").groupBy("user_id").agg(F.count("*").alias("_n"))
            .filter(F.col("_n") >= max_concurrent).select("user_id"))
    return pending.join(busy, "user_id", "left_anti")


def resource_hierarchy(resources: DataFrame, subjects: DataFrame, groups: DataFrame) -> DataFrame:
    s = subjects.select("subject_id", F.col("name").alias("subject_name"), "group_id")
    g = groups.select("group_id", F.col("name").alias("group_name"))
    return (resources.join(s, "subject_id", "left").join(g, "group_id", "left")
            .select("resource_id", "title", "subject_id", "subject_name", "group_id", "group_name"))


def expand_scopes(scopes: DataFrame, subjects: DataFrame, resources: DataFrame) -> DataFrame:
    """Resources inside each scope (kind, target): one resource, a subject, a group or all of a user."""
    r = resources.select("resource_id", "title", "user_id", "subject_id")
    by = lambda kind: scopes.filter(F.col("scope_type") == kind).select("scope_id", F.col("target").alias("_t"))
    in_group = subjects.select("subject_id", "group_id").join(r, "subject_id")
    out = ["scope_id", "resource_id", "title"]
    return (by("resource").join(r, F.col("_t") == F.col("resource_id")).select(*out)
            .unionByName(by("subject").join(r, F.col("_t") == F.col("subject_id")).select(*out))
            .unionByName(by("group").join(in_group, F.col("_t") == F.col("group_id")).select(*out))
            .unionByName(by("all").join(r, F.col("_t") == F.col("user_id")).select(*out)))


def nested_children(parents: DataFrame, children: DataFrame, key: str, child_id: str, fields: list[str],
                    page: int = 1000) -> DataFrame:
    """Parents with an array of children, in pages: array size stays bounded however many children there are.

    Pages are hash buckets of the child id; their number grows with the children of the parent.
    """
    sizes = children.groupBy(key).agg(F.ceil(F.count("*") / page).cast("int").alias("_pages"))
    paged = (children.join(sizes, key)
             .withColumn("page", F.pmod(F.xxhash64(child_id), F.col("_pages")).cast("int")))
    packed = (paged.groupBy(key, "page")
              .agg(F.sort_array(F.collect_list(F.struct(child_id, *[f for f in fields if f != child_id]))).alias("items")))
    return (parents.join(packed, key, "left")
            .withColumn("page", F.coalesce("page", F.lit(0)))
            .withColumn("items", F.coalesce("items", F.array().cast(packed.schema["items"].dataType))))


def groups_with_ungrouped(groups: DataFrame, subjects: DataFrame, needle: str = "") -> DataFrame:
    """Group and subject rows with a last bucket for subjects without a group.

    A group stays if its own name or any subject matches; only matching subjects are listed.
    """
    q = needle.strip().lower()
    s = subjects.select(F.coalesce(F.col("group_id").cast("string"), F.lit("ungrouped")).alias("group_id"), "subject_id",
                        F.col("name").alias("subject_name"))
    loose = s.filter(F.col("group_id") == "ungrouped").limit(1).select("group_id", F.lit("Ungrouped Subjects").alias("name"))
    g = groups.select(F.col("group_id").cast("string").alias("group_id"), "name").unionByName(loose)
    if q:
        s = s.filter(F.lower("subject_name").contains(q))
    rows = g.join(s, "group_id", "left")
    if q:
        rows = rows.filter(F.lower("name").contains(q) | F.col("subject_id").isNotNull())
    return rows.select("group_id", "name", "subject_id", "subject_name",
                       (F.col("group_id") == "ungrouped").alias("is_last"))


def lookup_or_default(users: DataFrame, tiers: DataFrame, default: str = "free") -> DataFrame:
    """Tier row of each user, else the default tier's row."""
    cols = [c for c in tiers.columns if c != "tier"]
    own = tiers.withColumn("_hit", F.lit(True))
    fallback = tiers.filter(F.col("tier") == default).limit(1)
    pick = [F.when(F.col("_hit").isNotNull(), F.col(c)).otherwise(fallback.select(c).scalar()).alias(c) for c in cols]
    return (users.select("user_id", "tier").join(own, "tier", "left")
            .select("user_id", F.when(F.col("_hit").isNotNull(), F.col("tier")).otherwise(default).alias("tier"), *pick))


def invite_acceptors(invites: DataFrame, users: DataFrame) -> DataFrame:
    u = users.select(F.col("user_id").alias("accepted_by"), F.col("email").alias("accepted_by_email"),
                     F.coalesce(F.nullif("full_name", F.lit("")), F.nullif("nickname", F.lit("")), F.lit("N/A")).alias("_name"))
    return (invites.join(u, "accepted_by", "left")
            .select("token", "accepted_by_email",
                    F.when(F.col("accepted_by").isNotNull(), F.coalesce("_name", F.lit("N/A"))).alias("accepted_by_name")))


def json_members(notes: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(note, resource) for every id in the note's JSON list, each once."""
    ids = F.from_json(json_col, "array<bigint>")
    return (notes.select(id_col, F.explode(F.array_distinct(ids)).alias("resource_id"))
            .filter(F.col("resource_id").isNotNull()))


def related_content(notes: DataFrame, exercises: DataFrame) -> DataFrame:
    """Notes and exercises of each resource: direct ones, and merged ones that list it."""
    out = ["resource_id", "kind", "id", "relation", "created_at"]
    def branch(t: DataFrame, kind: str, id_col: str) -> DataFrame:
        base = t.select(F.col(id_col).alias("id"), "resource_id", "merged_ids", "created_at", F.lit(kind).alias("kind"))
        direct = base.filter(F.col("resource_id").isNotNull()).withColumn("relation", F.lit("direct"))
        merged = (base.filter(F.col("resource_id").isNull()).drop("resource_id")
                  .withColumn("resource_id", F.explode(F.array_distinct("merged_ids")))
                  .withColumn("relation", F.lit("merged")))
        return direct.select(*out).unionByName(merged.select(*out))
    return branch(notes, "note", "note_id").unionByName(branch(exercises, "exercise", "exercise_id"))


def owner_of_entities(entities: DataFrame, notes: DataFrame, resources: DataFrame) -> DataFrame:
    """Owner by entity type: a note's resource owner first, then its own user; else ``unowned``.

    Equal rows of ``notes`` count once. They are made distinct where they meet their resources, which comes first, so notes are shuffled twice and
    entities once.
    """
    n = notes.select(F.col("note_id").alias("entity_id"), F.col("resource_id").alias("_nr"), F.col("user_id").alias("_nu"))
    r1 = resources.select(F.col("resource_id").alias("_nr"), F.col("user_id").alias("_ru"))
    r2 = resources.select(F.concat(F.lit("rs_"), F.col("resource_id").cast("string")).alias("entity_id"),
                          F.col("user_id").alias("_own"))
    owned = n.repartition("_nr").distinct().join(r1, "_nr", "left").select("entity_id", F.coalesce("_ru", "_nu").alias("_no"))
    return (entities.join(owned, "entity_id", "left").join(r2, "entity_id", "left")
            .select("entity_id", F.coalesce(F.coalesce("_no", "_own").cast("string"), F.lit("unowned")).alias("owner")))
