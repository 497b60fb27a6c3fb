"""Backfills and migrations of permission fields: missing ones inferred, snapshots applied, rows brought to their second form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tokens by visibility, what no one may read, the unit of all, the fields of a permission projection.
BY_VISIBILITY = {"PUBLIC": "_PUBLIC", "INTERNAL": "_INTERNAL"}
NO_ACCESS, GLOBAL = "_NO_ACCESS", "global"
PERMISSION_FIELDS = ("acl_tokens", "source_index", "index_code", "owner_unit_code", "visible_unit_codes", "permission_version")
#: A line of a snapshot; list fields may be JSON arrays or comma-separated text.
SNAPSHOT = "source_name string, source string, target_index string, acl_tokens string, owner_unit_code string, dept_code string, visible_unit_codes string, permission_version string"


def codes(value: Column, wide: bool = False) -> Column:
    """Codes from text that historic exports wrote as a JSON array or with commas: trimmed, not empty, each once in order; null has none.

    ``wide`` takes full-width commas for commas too.
    """
    text = F.trim(F.replace(value, F.lit("，"), F.lit(",")) if wide else value)
    listed = F.when(text.startswith("["), F.from_json(text, "array<string>"))
    parts = F.coalesce(listed, F.split(text, ","))
    return F.coalesce(F.array_distinct(F.filter(F.transform(parts, lambda c: F.trim(c)), lambda c: F.coalesce(c != "", F.lit(False)))), F.array().cast("array<string>"))


def present(*values: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(v) != "", v) for v in values], F.lit(None).cast("string"))


def first_list(*values: Column, default: list[str]) -> Column:
    """The first list that isn't empty, else the default."""
    return F.coalesce(*[F.when(F.size(v) > 0, v) for v in values], F.array(*[F.lit(d) for d in default]).cast("array<string>"))


def inferred_tokens(tokens: Column, meta_tokens: Column, visibility: Column, meta_visibility: Column) -> Column:
    """A row's tokens, its metadata's, or by visibility (internal where none is given); what can't be proven is closed."""
    seen = F.upper(F.trim(F.coalesce(F.when(visibility != "", visibility), F.when(meta_visibility != "", meta_visibility), F.lit("INTERNAL"))))
    guess = F.coalesce(*[F.when(seen == v, F.lit(t)) for v, t in BY_VISIBILITY.items()], F.lit(NO_ACCESS))
    return F.when(F.size(tokens) > 0, tokens).when(F.size(meta_tokens) > 0, meta_tokens).otherwise(F.array(guess))


def backfill_tokens(rows: DataFrame, execute: bool = True) -> DataFrame:
    """``rows`` (acl_tokens, meta_acl_tokens arrays, visibility, meta_visibility, permission fields) with ``filled``: whether a field was null.

    Where any permission field is missing, tokens are inferred; without ``execute`` rows are only told apart.
    """
    missing = F.lit(False)
    for f in PERMISSION_FIELDS:
        missing = missing | F.col(f).isNull()
    guess = inferred_tokens(F.col("acl_tokens"), F.col("meta_acl_tokens"), F.col("visibility"), F.col("meta_visibility"))
    return rows.withColumns({"filled": missing, "acl_tokens": F.when(missing, guess).otherwise(F.col("acl_tokens")) if execute else F.col("acl_tokens")})


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot of JSON lines; blank lines are passed over, and a line that isn't JSON fails the run rather than lose rights."""
    return spark.read.schema(SNAPSHOT).option("mode", "FAILFAST").json(path).withColumn("line", F.monotonically_increasing_id())


def snapshot_records(raw: DataFrame, now: Column) -> DataFrame:
    """(source_name, target_index, acl_tokens, owner_unit_code, visible_unit_codes, permission_version): one for each source, its last line.

    Lines without a source are passed over; without tokens nobody may read; the version is ``now`` where it isn't a number.
    """
    name = F.trim(F.coalesce(F.when(F.col("source_name") != "", F.col("source_name")), F.col("source"), F.lit("")))
    owner = F.coalesce(present(F.coalesce(F.when(F.col("owner_unit_code") != "", F.col("owner_unit_code")), F.col("dept_code"))), F.lit(GLOBAL))
    owner = F.trim(owner)
    records = raw.select(
        name.alias("source_name"), F.trim(F.coalesce("target_index", F.lit(""))).alias("target_index"), first_list(codes(F.col("acl_tokens")), default=[NO_ACCESS]).alias("acl_tokens"), owner.alias("owner_unit_code"),
        F.when(F.size(codes(F.col("visible_unit_codes"))) > 0, codes(F.col("visible_unit_codes"))).otherwise(F.array(owner)).alias("visible_unit_codes"), F.coalesce(F.col("permission_version").try_cast("long"), now).alias("permission_version"), "line",
    ).where("source_name <> ''")
    last = F.max_by(F.struct(*[c for c in records.columns if c not in ("source_name", "line")]), "line").alias("r")
    return records.groupBy("source_name").agg(last).select("source_name", "r.*")


def apply_snapshot(rows: DataFrame, records: DataFrame, source: str) -> DataFrame:
    """``rows`` with the permission fields of their source's record, and ``updated``; rows of other sources stay as they are."""
    fields = ("acl_tokens", "owner_unit_code", "visible_unit_codes", "permission_version")
    side = records.select(F.col("source_name").alias("n_"), F.struct(*fields).alias("r_"))
    joined = rows.join(side, rows[source] == side["n_"], "left")
    has = F.col("n_").isNotNull()
    return joined.withColumns({"updated": has, **{f: F.when(has, F.col(f"r_.{f}")).otherwise(F.col(f)) for f in fields}}).drop("n_", "r_")


def second_form(rows: DataFrame, source_index: str, now: Column) -> DataFrame:
    """Rows in the form of the second index: the listed fields alone, with their defaults.

    ``rows`` has (id, content, display_content, chunk_granularity, parent_chunk_id, keywords, acl_tokens, visible_unit_codes,
    source_index, index_code, owner_unit_code, permission_version) as text and the same rights under ``meta`` (a struct).  A row's own
    value comes before its metadata's; blank ones don't count.
    """
    m = lambda f: F.col(f"meta.{f}")
    index = F.coalesce(present(F.col("source_index"), m("source_index")), F.lit(source_index))
    both = lambda f: codes(present(F.col(f), m(f)), wide=True)
    filled = lambda f: F.coalesce(f, F.lit("")).alias(f)
    return rows.select(
        "id", *[filled(f) for f in ("content", "display_content", "chunk_granularity", "parent_chunk_id")], codes(F.col("keywords"), wide=True).alias("keywords"), first_list(both("acl_tokens"), default=[NO_ACCESS]).alias("acl_tokens"),
        index.alias("source_index"), F.coalesce(present(F.col("index_code"), m("index_code")), index).alias("index_code"), F.coalesce(present(F.col("owner_unit_code"), m("owner_unit_code")), F.lit(GLOBAL)).alias("owner_unit_code"),
        first_list(both("visible_unit_codes"), default=[GLOBAL]).alias("visible_unit_codes"), F.coalesce(present(F.col("permission_version"), m("permission_version")).try_cast("long"), now).alias("permission_version"),
    )


def audit(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row: rows read, written, missing on either side; for the gate after a migration."""
    b, a = before.select(F.col(key).alias("k"), F.lit(1).alias("b")), after.select(F.col(key).alias("k"), F.lit(1).alias("a"))
    both = b.groupBy("k").agg(F.sum("b").alias("b")).join(a.groupBy("k").agg(F.sum("a").alias("a")), "k", "full")
    return both.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("read"), F.coalesce(F.sum("a"), F.lit(0)).alias("written"), F.count_if(F.col("a").isNull()).alias("missing"), F.count_if(F.col("b").isNull()).alias("extra"))
