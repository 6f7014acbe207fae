"""Case queries: access scopes, paging, latest states, merges and constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Which rank may do what, and how sensitivities rank.
SENSITIVITY = {"normal": 0, "sensitive": 1, "protected": 2}
PER_PAGE, MOST_PER_PAGE = 25, 100
LIST_COLUMNS = ("document_number", "document_type", "issuing_state", "surname", "given_names", "date_of_birth", "nationality")


def scoped(rows: DataFrame, assignments: DataFrame, user: object | None = None, on: str = "case_id") -> DataFrame:
    """Row-level security: only rows of cases that the user is assigned to."""
    mine = assignments if user is None else assignments.where(F.col("user_id") == user)
    return rows.join(mine, [on] if user is not None else [on, "user_id"], "left_semi")


def page(rows: DataFrame, order: list[Column], number: int = 1, per_page: int = PER_PAGE) -> DataFrame:
    """One page with the number of all rows; a page past the end is empty.

    The count is a separate aggregate, so the page itself stays a bounded top-k
    instead of a window over everything; past the end no row enters it.
    """
    number, per_page = max(1, number), max(1, min(MOST_PER_PAGE, per_page))
    skip = (number - 1) * per_page
    total = rows.agg(F.count("*")).scalar()
    return rows.where(total > skip).orderBy(*order).offset(skip).limit(per_page).withColumn("total_count", total)


def optional(column: Column, value: object | None) -> Column:
    """Equality, or no restriction for None."""
    return F.lit(True) if value is None else column == value


def current(documents: DataFrame, versions: DataFrame, version: int | None = None) -> DataFrame:
    """Documents with the version asked for, or the one their pointer names."""
    wanted = F.coalesce(F.lit(version).cast("int"), F.col("current_version"))
    return documents.join(versions, (documents["id"] == versions["document_id"]) & (versions["version"] == wanted)).drop(versions["document_id"])


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key, by a combined maximum rather than a sort."""
    rest = [c for c in rows.columns if c not in key]
    newest = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_r")
    return rows.groupBy(*key).agg(newest).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def flags(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """Documents with whether any version failed its integrity check or was flagged by screening."""
    by = versions.groupBy(F.col("document_id").alias("_d")).agg(
        F.bool_or(F.col("integrity_failed_at").isNotNull()).alias("f"), F.bool_or(F.col("disposition").isNotNull() & (F.col("disposition") != "CLEAR")).alias("s")
    )
    return documents.join(by, documents["id"] == F.col("_d"), "left").withColumns({"integrity_failed": F.coalesce("f", F.lit(False)), "screening_flagged": F.coalesce("s", F.lit(False))}).drop("_d", "f", "s")


def access_decision(requests: DataFrame, permissions: DataFrame, assignments: DataFrame) -> DataFrame:
    """requests (user_id, rank, action, case_id) with ``allowed`` and ``reason``.

    Rank comes before case: no permission is ``rank``, creating a case needs none,
    a missing case is ``no_case_context``, else assignment decides.
    """
    held = permissions.select("rank", "action", F.lit(True).alias("_may"))
    mine = assignments.select("case_id", "user_id", F.lit(True).alias("_on")).distinct()
    reason = F.when(F.col("_may").isNull(), "rank").when(F.col("action") == "case.create", F.lit(None)).when(F.col("case_id").isNull(), "no_case_context").when(F.col("_on").isNull(), "not_assigned")
    return requests.join(held, ["rank", "action"], "left").join(mine, ["case_id", "user_id"], "left").withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull()).drop("_may", "_on")


def release_status(sensitivity: Column, ocr_status: Column, mime: Column, redaction_enabled: bool = True) -> Column:
    """How a document may leave; never the original of a protected one."""
    return (
        F.when(sensitivity != "protected", "original")
        .when(F.lit(not redaction_enabled), "redaction_unavailable")
        .when(F.coalesce(ocr_status, F.lit("")) != "done", "analysis_incomplete")
        .when(~(mime.startswith("text/") | (mime == "application/pdf")), "redaction_unsupported_format")
        .otherwise("redacted")
    )


def stale(status: Column, started: Column, as_of: Column, minutes: int = 15) -> Column:
    """Claimed, and for too long or at an unknown time."""
    return (status == "processing") & (started.isNull() | (started < as_of - F.expr(f"INTERVAL {minutes} MINUTES")))


def route(mime: Column) -> Column:
    return F.when(mime.startswith("text/"), "index").when((mime == "application/pdf") | mime.startswith("image/"), "recognise").otherwise("done")


def changed(before: Column, after: Column, names: list[str]) -> Column:
    """Map of the fields that differ to (from, to); null if none does."""
    pairs = F.map_from_entries(F.array(*[F.struct(F.lit(n).alias("k"), F.struct(before[n].cast("string").alias("from"), after[n].cast("string").alias("to")).alias("v")) for n in names]))
    out = F.map_filter(pairs, lambda k, v: ~v["from"].eqNullSafe(v["to"]))
    return F.when(F.size(out) > 0, out)


def ratchet(rows: DataFrame, key: str, order: str, sensitivity: str = "sensitivity") -> DataFrame:
    """Changes with whether they would lower the sensitivity, which is refused."""
    rank = F.create_map(*[F.lit(x) for kv in SENSITIVITY.items() for x in kv])[F.col(sensitivity)]
    before = F.lag(rank).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("refused", F.coalesce(rank < before, F.lit(False)))


def upsert(target: DataFrame, arrivals: DataFrame, key: list[str], order: str) -> DataFrame:
    """Target with arrivals merged by key; of several arrivals the last one counts."""
    last = latest(arrivals, key, [order]).drop(order)
    kept = target.join(last, key, "left_anti")
    return kept.unionByName(last.select(*target.columns))


def insert_new(target: DataFrame, arrivals: DataFrame, key: list[str]) -> DataFrame:
    """Arrivals whose key the target lacks, once each."""
    return arrivals.dropDuplicates(key).join(target, key, "left_anti")


def numbered(arrivals: DataFrame, existing: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Arrivals with the next free ``seq`` of their key."""
    top = existing.groupBy(*key).agg(F.max("seq").alias("_top"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return arrivals.join(top, key, "left").withColumn("seq", F.coalesce("_top", F.lit(0)) + nth).drop("_top")


def fan_out(alerts: DataFrame, assignments: DataFrame) -> DataFrame:
    """One notification for every officer on the alert's case."""
    return alerts.join(assignments.select("case_id", "user_id").distinct(), "case_id")


def mark_read(notes: DataFrame, user: object, at: Column) -> DataFrame:
    """Own notifications read; those read before keep their time."""
    return notes.withColumn("read_at", F.when(F.col("user_id") == user, F.coalesce("read_at", at)).otherwise(F.col("read_at")))


def repeated_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Violations of a unique key."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(rows: DataFrame, parents: DataFrame, key: list[str]) -> DataFrame:
    """Violations of a foreign key; a null key does not violate it."""
    return rows.where(" and ".join(f"{k} is not null" for k in key)).join(parents, key, "left_anti")


def altered(before: DataFrame, after: DataFrame, key: str, fixed: list[str]) -> DataFrame:
    """Rows whose immutable columns differ between two snapshots."""
    a, b = before.select(key, F.struct(*fixed).alias("was")), after.select(key, F.struct(*fixed).alias("now"))
    return a.join(b, key).where(~F.col("was").eqNullSafe(F.col("now")))


def permissions_of(permissions: DataFrame) -> DataFrame:
    """The actions of each rank as one sorted list."""
    return permissions.groupBy("rank").agg(F.array_sort(F.collect_set("action")).alias("permissions"))


def decision_context(requests: DataFrame, documents: DataFrame, cases: DataFrame, identities: DataFrame) -> DataFrame:
    """Requests by ``document_id`` with case, sensitivity, number and identities of the case; look-ups as joins.

    Requests for unknown documents stay, with nulls.
    """
    of = documents.select(F.col("id").alias("document_id"), "case_id")
    case = cases.select(F.col("id").alias("case_id"), "sensitivity", "case_number")
    named = identities.groupBy("case_id").agg(F.array_sort(F.collect_set("value")).alias("identities"))
    return requests.join(of, "document_id", "left").join(case, "case_id", "left").join(named, "case_id", "left")


def live_challenges(challenges: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """One-time codes that may still be tried: not used, not expired, attempts left, of an active user."""
    open_ = challenges.where(F.col("verified_at").isNull() & (F.col("expires_at") > as_of) & (F.col("attempts") < F.col("max_attempts")))
    return open_.join(users.where("is_active").select(F.col("id").alias("user_id")), "user_id", "left_semi")


def live_sessions(sessions: DataFrame, as_of: Column) -> DataFrame:
    """Sessions that have not expired."""
    return sessions.where(F.col("expires_at") >= as_of)


def unassigned(assignments: DataFrame, removals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assignments left, removals refused); removals: case_id, user_id, removed_by.  No one removes themselves."""
    refused = removals.where(F.col("user_id") == F.col("removed_by"))
    valid = removals.where(~F.col("user_id").eqNullSafe(F.col("removed_by")))
    return assignments.join(valid, ["case_id", "user_id"], "left_anti"), refused


def settled(events: DataFrame, key: str, order: str, status: str = "status", waiting: tuple[str, ...] = ("pending", "processing")) -> DataFrame:
    """The state of each key from its log of transitions: the newest that is not waiting, else the newest.

    So a failure is never left waiting, and a late ``pending`` undoes nothing.
    """
    done = ~F.col(status).isin(*waiting)
    rest = [c for c in events.columns if c not in (key, order)]
    best = F.max(F.struct(done.alias("_done"), order, *rest)).alias("_r")
    return events.groupBy(key).agg(best).select(key, F.col(f"_r.{order}").alias(order), *[F.col(f"_r.{c}").alias(c) for c in rest])


def watch_entries(arrivals: DataFrame) -> DataFrame:
    """Watchlist arrivals as stored: identifying columns in upper case, empty ones null, active."""
    upper = {c: F.nullif(F.upper(F.col(c).cast("string")), F.lit("")) for c in LIST_COLUMNS if c in arrivals.columns}
    return arrivals.withColumns(upper).withColumn("active", F.lit(True))


def deactivated(entries: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """Entries with ``active`` false where their id was withdrawn; none is deleted."""
    gone = withdrawn.select(F.col("id"), F.lit(True).alias("_gone")).distinct()
    return entries.join(gone, "id", "left").withColumn("active", F.col("active") & F.col("_gone").isNull()).drop("_gone")


def stripped(rows: DataFrame, hidden: tuple[str, ...] = ("embedding", "live_embedding")) -> DataFrame:
    """Rows without fields that begin with an underscore or hold embeddings, at every depth."""
    from pyspark.sql.types import ArrayType, DataType, StructType

    shown = lambda name: not name.startswith("_") and name not in hidden

    def clean(value: Column, kind: DataType) -> Column:
        if isinstance(kind, StructType):
            inner = F.struct(*[clean(value[f.name], f.dataType).alias(f.name) for f in kind.fields if shown(f.name)])
            return F.when(value.isNotNull(), inner)
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, (StructType, ArrayType)):
            return F.transform(value, lambda x: clean(x, kind.elementType))
        return value

    return rows.select(*[clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema.fields if shown(f.name)])
