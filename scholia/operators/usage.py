"""Per-user usage, study time, quotas and conversation summaries.

Facts of many tables get one column per metric and meet in one grouped aggregation: each table is
read once and only partial sums are shuffled, where a join per metric would shuffle each table.
"""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.exprs import exact_sum, falsy, ratio
from scholia.functions.ordered import top_per_key
from scholia.params import at

# Plan limits per tier, -1 for unlimited.
QUOTAS = ("resources", "subjects", "groups", "conversations", "messages", "exercises", "notes", "storage_gb")
TIERS = {
    "unlimited": ((-1, -1, -1, -1, -1, -1, -1, -1), None),
    "free": ((50, 10, 5, 100, 500, 20, 50, 5), "month"),
    "pro": ((500, 100, 50, -1, -1, 200, 500, 100), "month"),
    "early_tester": ((-1, -1, -1, -1, -1, -1, -1, -1), None),
}
PERIODICAL = ("conversations", "messages", "notes")


def period_start(as_of: datetime.datetime, period: str | None) -> Column:
    """Start of the current day, week (Monday) or month; anything else is the epoch."""
    if period in ("day", "week", "month"):
        return F.date_trunc(period, at(as_of)).cast("timestamp_ntz")
    return at(datetime.datetime(1970, 1, 1))


def stack(*facts: tuple[str, DataFrame, Column]) -> DataFrame:
    """user_id and one column per metric; metrics of the same table share its rows, so every fact table is read once."""
    tables: dict[int, tuple[DataFrame, list[Column]]] = {}
    for name, df, amount in facts:
        tables.setdefault(id(df), (df, []))[1].append(amount.cast("long").alias(name))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.select("user_id", *amounts) for df, amounts in tables.values()])


def per_user(users: DataFrame, names: list[str], *facts) -> DataFrame:
    """One row per user with the sum of each metric, 0 where there is nothing."""
    sums = stack(*facts).groupBy("user_id").agg(*[F.sum(n).alias(n) for n in names])
    return (users.select("user_id").join(sums, "user_id", "left")
            .select("user_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names]))


def notes_by_owner(notes: DataFrame, resources: DataFrame, *extra: Column) -> DataFrame:
    """Note counts per resource, then moved to the resource's user: notes shrink before the join."""
    counts = notes.groupBy("resource_id").agg(F.count("*").alias("n"), *extra)
    return counts.join(resources.select("resource_id", "user_id"), "resource_id")


def dashboard_summary(users, subjects, resources, messages, sessions, as_of, days: int = 7) -> DataFrame:
    since = at(as_of - datetime.timedelta(days=days))
    one = F.lit(1)
    return per_user(users, ["total_subjects", "total_notes", "questions_asked_7d", "study_time_7d_mins"],
                    ("total_subjects", subjects, one), ("total_notes", resources, one),
                    ("questions_asked_7d", messages.filter(F.col("created_at") >= since), one),
                    ("study_time_7d_mins", sessions.filter(F.col("created_at") >= since), F.coalesce("duration_minutes", F.lit(0))))


def progress_per_resource(resources: DataFrame, notes: DataFrame) -> DataFrame:
    """100 for a resource with a note, else 0."""
    noted = notes.select("resource_id").distinct().withColumn("_has", F.lit(100.0))
    return (resources.select("user_id", "resource_id", "title").join(noted, "resource_id", "left")
            .withColumn("completion", F.coalesce("_has", F.lit(0.0))).drop("_has"))


def progress(resources: DataFrame, notes: DataFrame) -> DataFrame:
    return (progress_per_resource(resources, notes).groupBy("user_id")
            .agg(F.count("*").alias("total_notes"), (exact_sum("completion") / F.count("*")).alias("overall_completion")))


def completion_status(resources: DataFrame, notes: DataFrame) -> DataFrame:
    c = F.col("completion")
    return (progress_per_resource(resources, notes).groupBy("user_id")
            .agg(F.count_if(c >= 100).alias("completed"), F.count_if((c > 0) & (c < 100)).alias("in_progress"),
                 F.count_if(c == 0).alias("not_started")))


def time_spent(sessions: DataFrame, resources: DataFrame) -> DataFrame:
    """Minutes and sessions per resource, and the user's totals in a row with kind ``total``.

    Sessions without a resource add no minutes, yet they count in the total number of sessions
    and so in the average's denominator.
    """
    by = (sessions.groupBy("user_id", "resource_id")
          .agg(F.sum(F.coalesce("duration_minutes", F.lit(0))).alias("total_minutes"), F.count("*").alias("sessions_count")))
    has = F.col("resource_id").isNotNull()
    total = (by.groupBy("user_id")
             .agg(F.coalesce(F.sum(F.when(has, F.col("total_minutes"))), F.lit(0)).alias("total_minutes"),
                  F.sum("sessions_count").alias("sessions_count")))
    titled = (by.filter(has).join(resources.select("resource_id", "title"), "resource_id", "left")
              .select("user_id", F.lit("resource").alias("kind"), "resource_id",
                      F.coalesce("title", F.lit("Unknown Resource")).alias("title"), "total_minutes", "sessions_count"))
    return titled.unionByName(total.select(
        "user_id", F.lit("total").alias("kind"), F.lit(None).cast("long").alias("resource_id"),
        F.lit(None).cast("string").alias("title"), "total_minutes", "sessions_count")
    ).withColumn("average_minutes", F.col("total_minutes") / F.col("sessions_count"))


def study_stats(sessions: DataFrame) -> DataFrame:
    """NULL durations are skipped by the sum, where a Python sum would fail."""
    total, tried, right = (F.coalesce(F.sum(c), F.lit(0)) for c in ("duration_minutes", "attempted", "correct"))
    return sessions.groupBy("user_id").agg(
        F.count("*").alias("total_sessions"), total.alias("total_study_time"),
        ratio(total, F.count("*")).alias("average_session_duration"), tried.alias("attempted"), right.alias("correct"),
        (ratio(right, tried) * 100).alias("average_accuracy"))


def study_calendar(sessions: DataFrame, as_of: datetime.datetime, days: int = 30) -> DataFrame:
    """Study and break minutes per user and day in one pass; a break is any type containing ``break``."""
    rest = F.lower("session_type").contains("break")
    minutes = F.coalesce("duration_minutes", F.lit(0))
    recent = sessions.filter(F.col("created_at") >= at(as_of - datetime.timedelta(days=days)))
    return (recent.groupBy("user_id", F.date_format("created_at", "yyyy-MM-dd").alias("date"))
            .agg(F.sum(F.when(rest, 0).otherwise(minutes)).alias("study_minutes"),
                 F.sum(F.when(rest, minutes).otherwise(0)).alias("break_minutes"), F.count("*").alias("sessions_count")))


def session_score(sessions: DataFrame) -> DataFrame:
    missing = F.coalesce("score", F.lit(0.0)) == 0
    computed = F.when(missing & (F.col("attempted") > 0), F.col("correct") / F.col("attempted") * 100).otherwise(F.col("score"))
    return sessions.select("id", computed.alias("score"))


def megabytes(size: Column) -> Column:
    return F.bround(size / F.lit(1024.0 * 1024.0), 2)


ADMIN_METRICS = ["notes_count", "subjects_count", "groups_count", "messages_count", "storage_bytes", "total_logins", "minutes"]


def _account_facts(resources, subjects, groups, messages, logs, sessions):
    one = F.lit(1)
    return [("subjects_count", subjects, one), ("groups_count", groups, one), ("messages_count", messages, one),
            ("storage_bytes", resources, F.col("file_size")), ("total_logins", logs, F.when(F.col("action") == "login", 1)),
            ("minutes", sessions, F.coalesce("duration_minutes", F.lit(0)))]


def user_admin_stats(users, notes, resources, subjects, groups, messages, logs, sessions) -> DataFrame:
    facts = _account_facts(resources, subjects, groups, messages, logs, sessions)
    facts.append(("notes_count", notes_by_owner(notes, resources), F.col("n")))
    return (per_user(users, ADMIN_METRICS, *facts)
            .withColumn("storage_mb", megabytes(F.col("storage_bytes"))).drop("storage_bytes"))


def user_stats(users, resources, subjects, groups, messages, logs, sessions, latest: int = 5) -> DataFrame:
    """Like the admin view, but ``notes_count`` counts resources here; with the newest log-ins."""
    facts = _account_facts(resources, subjects, groups, messages, logs, sessions)
    facts.append(("notes_count", resources, F.lit(1)))
    top = top_per_key(logs.filter(F.col("action") == "login").select("user_id", "created_at", "log_id"), ["user_id"],
                      [F.col("created_at").desc(), F.col("log_id")], latest)
    recent = top.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("rank", "created_at"))).alias("_l"))
    shown = F.transform("_l", lambda x: F.date_format(x["created_at"], "yyyy-MM-dd HH:mm:ss"))
    return (per_user(users, ADMIN_METRICS, *facts).join(recent, "user_id", "left")
            .withColumn("storage_mb", megabytes(F.col("storage_bytes")))
            .withColumn("recent_logins", F.coalesce(F.array_join(shown, ","), F.lit("")))
            .drop("storage_bytes", "total_logins", "_l"))


def count_per_parent(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    n = children.groupBy(key).agg(F.count("*").alias("child_count"))
    return parents.select(key).join(n, key, "left").select(key, F.coalesce("child_count", F.lit(0)).alias("child_count"))


def distinct_conversations(messages: DataFrame, as_of: datetime.datetime, period: str | None = None,
                           approximate: bool = False) -> DataFrame:
    kept = messages if period is None else messages.filter(F.col("created_at") >= period_start(as_of, period))
    if approximate:
        return kept.groupBy("user_id").agg(F.approx_count_distinct("conversation_id").alias("conversations"))
    # Distinct pairs first, so that a hot user is spread over many tasks.
    pairs = kept.filter(F.col("conversation_id").isNotNull()).select("user_id", "conversation_id").distinct()
    return pairs.groupBy("user_id").agg(F.count("*").alias("conversations"))


def period_counts(facts: DataFrame, as_of: datetime.datetime, period: str | None) -> DataFrame:
    return (facts.filter(F.col("created_at") >= period_start(as_of, period)).groupBy("user_id").agg(F.count("*").alias("n")))


def storage_used(resources: DataFrame) -> DataFrame:
    size = F.coalesce(F.sum("file_size"), F.lit(0))
    return resources.groupBy("user_id").agg(size.alias("bytes"), megabytes(size).alias("mb"),
                                            F.bround(size / F.lit(1024.0 ** 3), 2).alias("gb"))


def tier_limits(tier: Column, quota: str) -> tuple[Column, Column]:
    """Limit and reset period of one quota; an unknown tier is ``free``."""
    i = QUOTAS.index(quota)
    limit, period = F.lit(TIERS["free"][0][i]), F.lit(TIERS["free"][1] if quota in PERIODICAL else None).cast("string")
    for name, (limits, reset) in TIERS.items():
        limit = F.when(tier == name, limits[i]).otherwise(limit)
        period = F.when(tier == name, F.lit(reset if quota in PERIODICAL else None).cast("string")).otherwise(period)
    return limit, period


def quota_status(users, resources, subjects, groups, messages, exercises, notes, as_of: datetime.datetime) -> DataFrame:
    """Eight quota rows per user: used, limit, unlimited, reset period.

    Counts for every reset period come from one pass; the tier picks which applies.
    """
    periods = sorted({p for _, p in TIERS.values() if p})
    one = F.lit(1)
    fresh = [F.count_if(F.col("created_at") >= period_start(as_of, p)).alias(f"n_{p}") for p in periods]
    seen = messages.groupBy("user_id", "conversation_id").agg(F.max("created_at").alias("created_at"), F.count("*").alias("n"), *fresh)
    by_owner = notes_by_owner(notes, resources, *fresh)
    facts = [("resources", resources, one), ("subjects", subjects, one), ("groups", groups, one), ("exercises", exercises, one),
             ("storage_bytes", resources, F.col("file_size")), ("conversations", seen, one), ("messages", seen, F.col("n")),
             ("notes", by_owner, F.col("n"))]
    for p in periods:
        new = F.col("created_at") >= period_start(as_of, p)
        facts += [(f"conversations_{p}", seen, F.when(new, 1)), (f"messages_{p}", seen, F.col(f"n_{p}")),
                  (f"notes_{p}", by_owner, F.col(f"n_{p}"))]
    wide = per_user(users, [f[0] for f in facts], *facts).join(users.select("user_id", "tier"), "user_id")
    rows = []
    for quota in QUOTAS:
        limit, period = tier_limits(F.col("tier"), quota)
        used = F.bround(F.col("storage_bytes") / F.lit(1024.0 ** 3), 2) if quota == "storage_gb" else F.col(quota).cast("double")
        if quota in PERIODICAL:
            for p in periods:
                used = F.when(period == p, F.col(f"{quota}_{p}").cast("double")).otherwise(used)
        rows.append(F.struct(F.lit(quota).alias("quota"), used.alias("used"), limit.cast("long").alias("limit"),
                             (limit == -1).alias("unlimited"), period.alias("reset_period"),
                             (F.col("storage_bytes") / F.lit(1024.0 ** 3) if quota == "storage_gb" else used).alias("exact")))
    return wide.select("user_id", F.inline(F.array(*rows)))


def quota_check(status: DataFrame, new_bytes: int = 0) -> DataFrame:
    """Counts must stay below the limit; storage may reach it."""
    gb = F.col("exact") + F.lit(new_bytes / 1024.0 ** 3)
    ok = (F.col("limit") == -1) | F.when(F.col("quota") == "storage_gb", gb <= F.col("limit")).otherwise(F.col("used") < F.col("limit"))
    return status.select("user_id", "quota", ok.alias("allowed"))


def quota_cards(status: DataFrame) -> DataFrame:
    card = (F.when(F.col("quota").isin("resources", "notes", "exercises"), "items_processed")
            .when(F.col("quota").isin("conversations", "messages"), "chat_messages").otherwise(F.col("quota")))
    open_end = F.max((F.col("limit") == -1).cast("int")) == 1
    return (status.groupBy("user_id", card.alias("card"))
            .agg(exact_sum("used").alias("used"), F.when(open_end, F.lit(-1)).otherwise(F.sum("limit")).cast("long").alias("limit"),
                 open_end.alias("unlimited")))


# -- conversations ---------------------------------------------------------------------------


def conversation_list(messages: DataFrame) -> DataFrame:
    """One row per user and thread; the scope is the first of resource, subject, group that is set."""
    m = (messages.filter(F.col("conversation_id").isNotNull()).groupBy("user_id", "conversation_id")
         .agg(F.max("title").alias("title"), F.count("*").alias("message_count"), F.max("created_at").alias("last_message_at"),
              F.max("resource_id").alias("_r"), F.max("subject_id").alias("_s"), F.max("group_id").alias("_g"),
              F.bool_or("is_pinned").alias("is_pinned"), F.bool_or("is_favourite").alias("is_favourite")))
    scope = F.when(F.col("_r").isNotNull(), "resource").when(F.col("_s").isNotNull(), "subject").when(F.col("_g").isNotNull(), "group")
    return (m.select("user_id", "conversation_id", falsy("title", F.lit("Untitled Conversation")).alias("title"), "message_count",
                     "last_message_at", scope.alias("scope_type"), "is_pinned", "is_favourite")
            .orderBy(F.col("is_pinned").desc(), F.col("last_message_at").desc(), "conversation_id"))


def conversation_by_exercise(messages: DataFrame) -> DataFrame:
    return (messages.filter(F.col("conversation_id").isNotNull() & F.col("exercise_id").isNotNull())
            .groupBy("exercise_id", "conversation_id")
            .agg(F.max("title").alias("title"), F.count("*").alias("message_count"), F.max("created_at").alias("last_message_at"))
            .withColumn("title", falsy("title", F.lit("Untitled Conversation"))))


def conversation_admin(messages: DataFrame) -> DataFrame:
    """Grouped by id and title: a thread whose title changed gives one row per title."""
    return (messages.groupBy("conversation_id", "title")
            .agg(F.count("*").alias("message_count"), F.max("created_at").alias("last_message_at")))
